"""Page layouts from brightness profiles: how well a grid's gutters fit, and which grid fits best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range of a pocket's width by its height.
ASPECT = (0.55, 0.95)
#: Half a gutter's width by the profile's length (2 places at least), the part of a cell that is its inside, what
#: keeps the score finite, and the grid of a page that none fits.
GUTTER, INSIDE, SMALL, DEFAULT = 0.012, (0.2, 0.8), 1e-6, (3, 3)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def gutter_score(profile: Column, cells: Column) -> Column:
    """How far the profile dips where cells meet, by the cells' median; 0 for one cell."""
    n = F.size(profile)
    half = F.greatest(F.lit(2), F.floor(GUTTER * n).cast("int"))
    place = lambda k: F.floor(k * n / cells).cast("int")
    part = lambda a, b: F.slice(profile, a + 1, F.greatest(b - a, F.lit(0)))
    dips = F.transform(F.sequence(F.lit(1), F.greatest(cells - 1, F.lit(1))), lambda k: F.array_min(part(F.greatest(place(k) - half, F.lit(0)), F.least(place(k) + half + 1, n))))
    inner = F.transform(F.sequence(F.lit(0), cells - 1), lambda k: _median(part(place(k + INSIDE[0]), place(k + INSIDE[1]))))
    mid = _median(inner)
    mean = F.aggregate(dips, F.lit(0.0), lambda s, x: s + x) / F.size(dips)
    return F.when(cells == 1, 0.0).otherwise((mid - mean) / (mid + SMALL))


def best_layout(pages: DataFrame, layouts: tuple[tuple[int, int], ...] = ((2, 2), (3, 3), (3, 4), (4, 3))) -> DataFrame:
    """page, rows, cols, score: the best grid of pages(page, col_profile, row_profile); grids of odd-shaped pockets are out.

    Of equal scores the greatest grid wins, by rows and then columns. A page that no grid fits has DEFAULT and no score.
    """
    grid = F.array(*(F.struct(F.lit(r).alias("rows"), F.lit(c).alias("cols")) for r, c in layouts))
    each = pages.select("page", "col_profile", "row_profile", F.explode(grid).alias("g")).select("*", "g.*")
    aspect = (F.size("col_profile") / F.col("cols")) / F.greatest(F.size("row_profile") / F.col("rows"), F.lit(SMALL))
    score = gutter_score(F.col("col_profile"), F.col("cols")) + gutter_score(F.col("row_profile"), F.col("rows"))
    fits = each.select("page", F.when((aspect > ASPECT[0]) & (aspect < ASPECT[1]), F.struct(score.alias("score"), "rows", "cols")).alias("g"))
    best = fits.groupBy("page").agg(F.max("g").alias("g"))
    return best.select("page", F.coalesce("g.rows", F.lit(DEFAULT[0])).alias("rows"), F.coalesce("g.cols", F.lit(DEFAULT[1])).alias("cols"), "g.score")
