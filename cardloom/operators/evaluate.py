"""Evaluation of decisions against labels. Rates without a denominator are null."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
TARGET = 0.995


def _rate(hit: Column, of: Column) -> Column:
    return F.avg(F.when(of, hit.cast("double")))


def outcomes(labels: DataFrame, results: DataFrame, ranked: DataFrame, top_k: int = 4) -> DataFrame:
    """photo, pocket, truth, top, probability, in_top_k, status, state: labels beside results, pocket by pocket.

    labels(photo, pocket, truth) have null for an empty pocket and ? for a card out of the catalog; results(photo, pocket,
    state) are the pockets found, ranked(photo, pocket, rank, card_id, probability, status) their candidates. Pockets
    that only one side has don't count.
    """
    at = ["photo", "pocket"]
    few = ranked.filter(F.col("rank") <= top_k)
    best = few.filter("rank = 1").select(*at, F.col("card_id").alias("top"), "probability", "status")
    met = labels.select(*at, "truth").join(results.select(*at, "state"), at)
    hits = met.join(few.select(*at, F.col("card_id").alias("truth")), [*at, "truth"], "left_semi").select(*at, F.lit(True).alias("hit"))
    out = met.join(best, at, "left").join(hits, at, "left")
    status = F.when(F.col("state") == "empty", "empty").otherwise(F.coalesce("status", F.lit("review")))
    return out.select(*at, "truth", "top", F.coalesce("probability", F.lit(0.0)).alias("probability"), F.coalesce("hit", F.lit(False)).alias("in_top_k"), status.alias("status"), "state")


def confirmable(found: DataFrame) -> DataFrame:
    """correct, probability of the outcomes that hold a card, for threshold_sweep."""
    return found.filter("truth is not null").select(F.coalesce(F.col("top") == F.col("truth"), F.lit(False)).alias("correct"), "probability")


def accuracy(outcomes: DataFrame) -> DataFrame:
    """One row from outcomes(truth, top, in_top_k, state): truth null is an empty pocket, ? a card not in the catalog."""
    known = F.col("truth").isNotNull() & (F.col("truth") != "?")
    empty = F.col("truth").isNull()
    return outcomes.agg(
        _rate(F.coalesce(F.col("top") == F.col("truth"), F.lit(False)), known).alias("top1"), _rate(F.col("in_top_k"), known).alias("topk"),
        _rate(F.col("state") == "empty", empty).alias("empty_accuracy"), F.count_if(known & (F.col("state") == "empty")).alias("false_empty"),
    )


def threshold_sweep(outcomes: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, auto, precision, coverage over outcomes(correct, probability)."""
    each = outcomes.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    auto = F.col("probability") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(auto).alias("auto"), _rate(F.col("correct"), auto).alias("precision"), F.avg(auto.cast("double")).alias("coverage"))


def recommended(sweep: DataFrame, target: float = TARGET) -> DataFrame:
    """The least threshold that meets the target precision."""
    return sweep.agg(F.min(F.when(F.col("precision") >= target, F.col("threshold"))).alias("threshold"))


def list_recall(pages: DataFrame) -> DataFrame:
    """One row: recall of expected entries and number of spurious ones over pages(expected, found): arrays of ids."""
    hit = F.size(F.array_intersect("expected", "found"))
    out = pages.agg(F.sum(hit).alias("hit"), F.sum(F.size(F.array_distinct("expected"))).alias("wanted"), F.sum(F.size(F.array_except("found", "expected"))).alias("spurious"))
    return out.select(F.when(F.col("wanted") > 0, F.col("hit") / F.col("wanted")).alias("recall"), "spurious")


def subsets(trials: DataFrame, attempts: list[str], largest: int = 3) -> DataFrame:
    """subset, size, accuracy: the share of trials where any attempt of the subset (boolean columns) is right."""
    names = [c for k in range(1, largest + 1) for c in combinations(attempts, k)]
    either = lambda c: F.greatest(*(F.col(x).cast("int") for x in c), F.lit(0))
    row = trials.agg(*(F.avg(either(c).cast("double")).alias("+".join(c)) for c in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit("+".join(c)).alias("subset"), F.lit(len(c)).alias("size"), F.col(f"`{'+'.join(c)}`").alias("accuracy")) for c in names))).alias("s")).select("s.*")


def leave_one_out(trials: DataFrame, attempts: list[str]) -> DataFrame:
    """attempt, alone, lost: how often an attempt is right, and how much of what all together get right is lost without it."""
    right = lambda c: F.coalesce(F.col(c), F.lit(False))
    any_of = lambda cs: F.aggregate(F.array(*map(right, cs)), F.lit(False), lambda a, b: a | b) if cs else F.lit(False)
    share = lambda c: F.avg(c.cast("double"))
    row = trials.agg(*(F.struct(F.lit(a).alias("attempt"), share(right(a)).alias("alone"), (share(any_of(attempts)) - share(any_of([x for x in attempts if x != a]))).alias("lost")).alias(a) for a in attempts))
    return row.select(F.explode(F.array(*(F.col(f"`{a}`") for a in attempts))).alias("s")).select("s.*")


def half_width(p: Column, n: Column) -> Column:
    """Of the 95 % interval of a share."""
    return 1.96 * F.sqrt(p * (1 - p) / n)


def vote(reads: DataFrame) -> DataFrame:
    """key, number, total, votes of reads(key, attempt, number, total): attempts after the second equal read don't count;
    the most frequent number, the first on ties, and the most frequent total among its reads.
    """
    from pyspark.sql import Window

    from .catalog import most_common

    same = Window.partitionBy("key", "number", "total").orderBy("attempt")
    twice = reads.withColumn("_n", F.row_number().over(same)).filter("_n = 2").groupBy("key").agg(F.min("attempt").alias("_stop"))
    used = reads.join(twice, "key", "left").filter("attempt <= coalesce(_stop, attempt)")
    number = most_common(used.filter("number is not null"), ["key"], "number", "attempt").withColumnRenamed("n", "votes")
    total = most_common(used.filter("total is not null").join(number.select("key", "number"), ["key", "number"]), ["key"], "total", "attempt").select("key", "total")
    return number.join(total, "key", "left").select("key", "number", "total", "votes")
