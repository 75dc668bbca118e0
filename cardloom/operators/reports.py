"""Reports in Markdown. Counting is Spark's; what is written out is a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as T

#: Rows that a listing shows at most; the counts above it are of all.
LISTED = 500


def markdown(rows: DataFrame, limit: int = 40) -> str:
    """A table of at most limit rows."""
    return _table(rows.columns, rows.limit(limit).collect())


def _table(names: list[str], rows: list[Row]) -> str:
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def share(part: float | None) -> str:
    return "n/a" if part is None else f"{100 * part:.1f}%"


def _section(title: str, rows: DataFrame, limit: int) -> str:
    found = rows.limit(limit + 1).collect()
    more = f"\nThe first {limit}.\n" if len(found) > limit else ""
    return f"\n## {title}\n\n{_table(rows.columns, found[:limit])}{more}" if found else ""


def by_language(sets: DataFrame, cards: DataFrame, variants: DataFrame) -> DataFrame:
    """language, sets, cards, variants of a built catalog."""
    count = lambda df, name: df.groupBy("language").agg(F.count(F.lit(1)).alias(name))
    out = count(cards.withColumnRenamed("lang", "language"), "cards").join(count(sets.withColumnRenamed("lang", "language"), "sets"), "language", "left")
    out = out.join(count(variants.withColumn("language", T.language_of(F.col("card_id"))), "variants"), "language", "left")
    return out.fillna(0).select("language", "sets", "cards", "variants").orderBy("language")


def issues_by_set(issues: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """set, name, cards: how many cards of each set have an issue of a kind, most first."""
    own = issues.filter(F.col("kind") == kind).groupBy(T.set_of(F.col("ref")).alias("set")).agg(F.count(F.lit(1)).alias("cards"))
    return own.join(sets.select(F.col("id").alias("set"), "name"), "set", "left").select("set", "name", "cards").orderBy(F.desc("cards"), "set")


def catalog_report(sets: DataFrame, cards: DataFrame, variants: DataFrame, issues: DataFrame, meta: dict[str, str]) -> str:
    """What a build has made: counts by language, issues by kind, gaps, rarities, and all other issues."""
    kinds = issues.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "kind")
    named = issues.join(sets.select(F.col("id").alias("ref"), "name"), "ref", "left")
    gaps = named.filter("kind = 'missing_numbers'").select(F.col("ref").alias("set"), "name", "detail").orderBy("set")
    other = issues.filter("kind not in ('missing_numbers', 'missing_rarity')").select("kind", "ref", "detail").orderBy("kind", "ref", "detail")
    parts = ["# Catalog build\n", "".join(f"- {k}: {v}\n" for k, v in sorted(meta.items())), _section("Languages", by_language(sets, cards, variants), 100), _section("Issues", kinds, 100)]
    parts += [_section("Sets that lack numbers", gaps, LISTED), _section("Cards without a rarity, by set", issues_by_set(issues, sets, "missing_rarity"), 25), _section("Other issues", other, LISTED)]
    return "\n".join(p for p in parts if p)


def crosscheck_report(mapping: DataFrame, agreed: DataFrame, issues: DataFrame, ours: DataFrame, theirs: DataFrame, partner: str) -> str:
    """How two catalogs compare: sets matched, cards that agree (agreement()'s row), and issues kind by kind; ours and theirs
    are the sets(id) without a partner.
    """
    n = agreed.first()
    parts = [f"# Comparison with {partner}\n", f"- sets matched: {mapping.count()}\n- cards compared: {n.compared}, agreeing: {n.agree} ({share(n.share)})\n"]
    parts.append(_section("Issues", issues.groupBy("kind").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "kind"), 100))
    titles = {"xcheck_missing_from_catalog": f"Cards that only {partner} has", "xcheck_only_in_catalog": "Cards that only the catalog has", "xcheck_printed_total": "Printed totals", "xcheck_name": "Names", "xcheck_rarity": "Rarities"}
    parts += [_section(title, issues.filter(F.col("kind") == kind).select("ref", "detail").orderBy("ref", "detail"), 40) for kind, title in titles.items()]
    parts += [_section(f"Sets of {who} without a partner", df.select("id").orderBy("id"), LISTED) for who, df in (("the catalog", ours), (partner, theirs))]
    return "\n".join(p for p in parts if p)


def image_report(images: DataFrame, sets: DataFrame | None = None, top: int = 25) -> str:
    """What became of images(card_id, status, error): by language, the sets that lack most, and the first errors."""
    from .ingest import missing_by_set

    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    lang = images.groupBy(T.language_of(F.col("card_id")).alias("language")).agg(n("ok"), n("missing"), n("error")).orderBy("language")
    worst = missing_by_set(images.withColumn("set_id", T.set_of(F.col("card_id"))), top)
    if sets is not None:
        worst = worst.join(sets.select(F.col("id").alias("set_id"), "name"), "set_id", "left").select("set_id", "name", "missing", "total").orderBy(F.desc("missing"), "set_id")
    errors = images.filter("status = 'error'").select("card_id", "error").orderBy("card_id")
    return "\n".join(p for p in ["# Card images\n", _section("Languages", lang, 100), _section("Sets that lack most images", worst, top), _section("Errors", errors, 10)] if p)


def evaluation_report(found: DataFrame, layouts: DataFrame | None = None, wishes: DataFrame | None = None, seconds: float | None = None) -> str:
    """Recognition against labels: found are outcomes(), layouts(expected, found) of pages, wishes list_recall()'s pages.

    The threshold that is recommended is the least one with the target precision.
    """
    from . import evaluate as E

    a = E.accuracy(found).first()
    n = found.agg(F.countDistinct("photo").alias("pages"), F.count(F.lit(1)).alias("pockets"), F.count_if(F.col("truth").isNotNull() & (F.col("truth") != "?")).alias("cards")).first()
    lines = [f"- pages: {n.pages}, pockets: {n.pockets}, cards: {n.cards}"]
    if layouts is not None:
        lines.append(f"- layouts found: {share(layouts.agg(F.avg((F.col('expected') == F.col('found')).cast('double'))).first()[0])}")
    lines += [f"- best guess right: {share(a.top1)}, among the best: {share(a.topk)}", f"- empty pockets found: {share(a.empty_accuracy)}, cards taken for empty: {a.false_empty}"]
    if seconds is not None:
        lines.append(f"- seconds a page: {seconds / max(n.pages, 1):.2f}")
    if wishes is not None:
        w = E.list_recall(wishes).first()
        lines.append(f"- wishes found: {share(w.recall)}, spurious: {w.spurious or 0}")
    sweep = E.threshold_sweep(E.confirmable(found))
    best = E.recommended(sweep).first().threshold
    missed = found.filter(~F.coalesce(F.col("truth") == F.col("top"), F.col("truth").isNull() & (F.col("top").isNull() | (F.col("state") == "empty"))))
    missed = missed.select("photo", "pocket", "truth", "top", "probability", "status").orderBy("photo", "pocket")
    return "\n".join(p for p in ["# Recognition\n", "\n".join(lines) + "\n", _section("Thresholds", sweep.orderBy("threshold"), 100), f"Recommended threshold: {best}\n", _section("Misses", missed, LISTED)] if p)
