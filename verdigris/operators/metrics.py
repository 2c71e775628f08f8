"""Ranking and calibration metrics over scored rows.

Ranks come from counts by distinct score.  These are dealt into ranges by one range shuffle; running sums are taken within
each range and what the ranges before add up to, a row for each range, is broadcast.  So no task sees all of the scores,
however many of them are distinct.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.staging import shared


def running(rows: DataFrame, order: str, sums: list[str], *, descending: bool = False) -> DataFrame:
    """rows (one for each value of `order`) with `<c>_before` for each of the sums: c added up over the rows before it.

    One range shuffle deals the rows into as many ranges as the session has shuffle partitions and writes them down with
    their range's number; sums within a range and what the ranges before add up to come from there."""
    by = F.desc(order) if descending else F.asc(order)
    dealt = shared(rows.repartitionByRange(by).withColumn("__range", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("__range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges alone
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    whole = whole.select("__range", *(zero(F.sum(f"__{c}").over(outer)).alias(f"__{c}") for c in sums))
    own = dealt.select("*", *(zero(F.sum(c).over(inner)).alias(f"__own_{c}") for c in sums)).join(F.broadcast(whole), "__range")
    return own.select(*rows.columns, *((F.col(f"__{c}") + F.col(f"__own_{c}")).alias(f"{c}_before") for c in sums))


def by_score(rows: DataFrame, label: str, score: str) -> DataFrame:
    """s, pos, neg for each distinct score; with how many positives and negatives lie below it."""
    n = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    return running(n, "s", ["pos", "neg"]).withColumnsRenamed({"pos_before": "pos_below", "neg_before": "neg_below"})


def mid_ranks(rows: DataFrame, score: str) -> DataFrame:
    """rows with mid_rank: the mean rank of equal scores."""
    n = rows.groupBy(F.col(score).alias("__s")).agg(F.count("*").alias("__n"))
    ranks = running(n, "__s", ["__n"]).select("__s", (F.col("__n_before") + (F.col("__n") + 1) / 2).alias("mid_rank"))
    return rows.join(ranks, F.col(score) == F.col("__s")).drop("__s")


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc (ties count half; null without both classes), n_pos, n_neg."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    pos, neg = F.sum("pos"), F.sum("neg")
    return by_score(rows, label, score).agg(F.try_divide(wins, (pos * neg).cast("double")).alias("auc"), F.coalesce(pos, F.lit(0)).alias("n_pos"), F.coalesce(neg, F.lit(0)).alias("n_neg"))


def ranked_checkpoints(rows: DataFrame, label: str, checkpoint: str, p: str) -> DataFrame:
    """checkpoint, auc, place of every checkpoint, the best first, ties by name; one whose rows are all of one class raises.
    rows: one for each checkpoint and case.  Checkpoints are few; each is ranked over ranges of its own scores."""
    names = [r[0] for r in rows.select(checkpoint).where(F.col(checkpoint).isNotNull()).distinct().orderBy(checkpoint).collect()]
    value = F.coalesce("auc", F.raise_error("a checkpoint has cases of one class only").cast("double"))
    found = [auc(rows.where(F.col(checkpoint) == n), label, p).select(F.lit(n).alias("checkpoint"), F.round(value, 9).alias("auc")) for n in names]
    if not found:
        return rows.sparkSession.createDataFrame([], "checkpoint string, auc double, place int")
    return reduce(DataFrame.union, found).withColumn("place", F.row_number().over(Window.orderBy(F.desc("auc"), "checkpoint")))


def components(rows: DataFrame, label: str, score: str, key: str, name: str) -> DataFrame:
    """DeLong's structural component of each row: the share of the other class on its right side."""
    n = by_score(rows, label, score)
    totals = rows.agg(F.count_if(F.col(label)).alias("__p"), F.count_if(~F.col(label)).alias("__q"))
    part = F.when(F.col(label), (F.col("neg_below") + F.col("neg") / 2) / F.col("__q")).otherwise((F.col("__p") - F.col("pos_below") - F.col("pos") / 2) / F.col("__p"))
    return rows.join(n, F.col(score) == F.col("s")).join(F.broadcast(totals), F.lit(True)).select(key, label, part.alias(name))


def delong(rows: DataFrame, label: str, base: str, candidate: str, key: str) -> DataFrame:
    """One row: both AUCs, their difference with SE, confidence interval, z, correlation."""
    a = components(rows, label, base, key, "va")
    b = components(rows, label, candidate, key, "vb").drop(label)
    v = a.join(b, key)
    one = lambda c, x: F.when(F.col(label) == c, F.col(x))
    stats = v.agg(
        F.avg(one(True, "va")).alias("auc_base"),
        F.avg(one(True, "vb")).alias("auc_candidate"),
        *(F.count(one(c, "va")).alias(f"n{int(c)}") for c in (True, False)),
        *(F.covar_samp(one(c, x), one(c, y)).alias(f"{x}{y}{int(c)}") for c in (True, False) for x, y in (("va", "va"), ("vb", "vb"), ("va", "vb"))),
    )
    cov = lambda n: F.col(f"{n}1") / F.col("n1") + F.col(f"{n}0") / F.col("n0")
    out = stats.select("auc_base", "auc_candidate", (F.col("auc_candidate") - F.col("auc_base")).alias("delta"), cov("vava").alias("var_base"), cov("vbvb").alias("var_candidate"), cov("vavb").alias("cov"))
    se = F.sqrt(F.greatest(F.col("var_base") + F.col("var_candidate") - 2 * F.col("cov"), F.lit(0.0)))
    z = NormalDist().inv_cdf(0.975)
    return out.select("auc_base", "auc_candidate", "delta", F.sqrt("var_base").alias("se_base"), se.alias("se"), (F.col("delta") - z * se).alias("low"), (F.col("delta") + z * se).alias("high"), F.try_divide(F.col("cov"), F.sqrt(F.col("var_base") * F.col("var_candidate"))).alias("rho"))


def average_precision(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Step sum of precision over distinct thresholds; null without positives."""
    n = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count("*").alias("n"))
    upto = lambda c: F.col(f"{c}_before") + F.col(c)
    steps = running(n, "s", ["pos", "n"], descending=True).select("pos", (upto("pos") / upto("n")).alias("precision"))
    return steps.agg(F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double")).alias("average_precision"))


def bins(rows: DataFrame, label: str, p: str, n: int = 15) -> DataFrame:
    b = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(p)).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))


def calibration(rows: DataFrame, label: str, p: str, n: int = 15) -> DataFrame:
    """Expected calibration error and the largest gap of a bin."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return bins(rows, label, p, n).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("max_gap"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def clopper_pearson_upper(hits: int, n: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound, by bisection on the binomial tail."""
    if n == 0 or hits >= n:
        return 1.0
    tail = lambda p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits + 1))
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > alpha else (low, mid)
    return (low + high) / 2


def minimum_detectable(se: float, alpha: float = 0.05, power: float = 0.8) -> float:
    return (NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)) * se


def fewest_negatives(a: Column, p: Column, target: Column) -> Column:
    """The least number of negatives for which Hanley and McNeil's standard error of an AUC of a with p positives is the target
    at most; null if none is.  The squared error is linear in 1 / n, so the number is a quotient, checked at both sides."""
    q1, q2 = a / (2 - a) - a * a, 2 * a * a / (1 + a) - a * a
    gain = target * target * p - q2
    n = F.greatest(F.ceil((a * (1 - a) + (p - 1) * q1 - q2) / gain), F.lit(1).cast("long"))
    fits = lambda k: hanley_mcneil(a, p, k) <= target
    return F.when(gain > 0, F.when((n > 1) & fits(n - 1), n - 1).when(fits(n), n).otherwise(n + 1))


def hanley_mcneil(auc: Column, pos: Column, neg: Column) -> Column:
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (pos - 1) * (q1 - auc * auc) + (neg - 1) * (q2 - auc * auc)) / (pos * neg))


def kth_largest(rows: DataFrame, score: str, k: Column | int) -> DataFrame:
    """One row, threshold: the k-th largest score, found on counts by distinct score."""
    n = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    k = F.lit(k) if isinstance(k, int) else k
    return running(n, "s", ["n"], descending=True).where(F.col("n_before") + F.col("n") >= k).agg(F.max("s").alias("threshold"))
