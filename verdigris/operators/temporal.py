"""Interval, as-of and nearest joins on a key and a time (or a number).

Each is an equi-join on the key and a bucket of the time, so a hot key's rows spread over its buckets and rows far apart
never meet; a window then picks the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.latest import first_by


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, below: int, above: int, how: str = "inner") -> DataFrame:
    """Pairs with −below <= other − at <= above on whole numbers; the right side keeps no key columns."""
    width = max(1, below + above)
    bucket = lambda c: F.floor(F.col(c) / width)
    lo, hi = F.floor((F.col(at) - below) / width), F.floor((F.col(at) + above) / width)
    l = left.withColumn("__b", F.explode(F.sequence(lo, hi)))
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys), bucket(other).alias("__rb"))
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__b") == F.col("__rb"), F.col(other) - F.col(at) >= -below, F.col(other) - F.col(at) <= above]
    joined = l.join(r, on).drop("__b", "__rb", *(f"__{k}" for k in keys))
    if how == "inner":
        return joined
    extra = [c for c in joined.columns if c not in left.columns]
    names = left.columns
    matched = joined.select(*names, F.struct(*extra).alias("__m"))
    grouped = matched.groupBy(*names).agg(F.collect_list("__m").alias("__ms"))
    out = left.join(grouped, names, "left").select(*names, F.explode_outer("__ms").alias("__m"))
    return out.select(*names, *(F.col(f"__m.{c}").alias(c) for c in extra))


def first_match(joined: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(joined, keys, order)


def first_reply(deliveries: DataFrame, replies: DataFrame, window: int) -> DataFrame:
    """(delivery, session, at) × (session, reply, reply_at): the earliest reply in (at, at + window], ties to the smaller reply; microseconds."""
    near = band_join(deliveries, replies, ["session_id"], "at", "reply_at", -1, window)
    return first_by(near, ["delivery_id"], [F.col("reply_at"), F.col("reply_id")])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, radius: int, row: str) -> DataFrame:
    """Each left row with the nearest right row within the radius, ties to the smaller `other`; unmatched rows are dropped."""
    near = band_join(left, right, keys, at, other, radius, radius)
    return first_by(near, [row], [F.abs(F.col(other) - F.col(at)), F.col(other)])


def nearest_ranges(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, key: str, width: int = 86_400_000_000) -> DataFrame:
    """at, key: for each distinct point the range that holds it, else the one whose edge is nearest; of equals the smallest key.

    Time is cut into buckets of `width`.  A range that holds a point is found in the buckets that it covers.  The nearest
    edge on a side is in the point's own bucket or is the outermost of the nearest bucket on that side that has any; these
    outermost edges, a row for each bucket, are the only ordered window."""
    b = lambda c: F.floor(F.col(c) / width)
    p = points.select(F.col(at).alias("at"), b(at).alias("b"))
    r = ranges.select(F.col(key).alias("key"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    covered = r.select("key", "lo", "hi", F.explode(F.sequence(b("lo"), b("hi"))).alias("b"))
    inside = p.join(covered, "b").where("at >= lo and at <= hi").select("at", F.lit(0).cast("long").alias("d"), "key")
    after = r.select("key", F.col("lo").alias("edge"), b("lo").alias("b"))
    before = r.select("key", F.col("hi").alias("edge"), b("hi").alias("b"))
    same = p.join(after.withColumn("later", F.lit(True)).union(before.withColumn("later", F.lit(False))), "b")
    same = same.where("if(later, edge > at, edge < at)").select("at", F.abs(F.col("edge") - F.col("at")).alias("d"), "key")
    outer = after.groupBy("b").agg(F.min(F.struct("edge", "key")).alias("first"))
    last = before.groupBy("b").agg(F.min(F.struct((-F.col("edge")).alias("edge"), "key")).alias("last"))
    days = p.select("b").distinct().join(outer, "b", "full").join(last, "b", "full")
    up, down = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("b", F.first("first", ignorenulls=True).over(up).alias("next"), F.last("last", ignorenulls=True).over(down).alias("prior"))
    met = p.join(days, "b")
    far = met.select("at", (F.col("next.edge") - F.col("at")).alias("d"), F.col("next.key").alias("key")).union(met.select("at", F.col("at") + F.col("prior.edge"), "prior.key")).where("key is not null")
    return inside.union(same).union(far).groupBy("at").agg(F.min(F.struct("d", "key"))["key"].alias(key))
