"""cardloom: collectible-card analytics and corpus preparation on PySpark."""
