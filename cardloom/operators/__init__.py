"""Relational operators over card catalogs, collections and evidence."""
