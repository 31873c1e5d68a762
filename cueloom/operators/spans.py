"""Interval algebra on spans (s, e) within keys. Overlaps meet by equality of time buckets, never by comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unite(spans: DataFrame, keys: list[str], slack: int = 0) -> DataFrame:
    """Spans that touch or lie within slack of each other become one."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    island = spans.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach + slack), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(w))
    return island.groupBy(*keys, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def _buckets(s: Column, e: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(s / width), F.floor(e / width)))


def intersect(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """What spans of a and b share, more than a point; where a key has no spans on one side, the other side stands. width: a usual span's length."""
    left = a.select(*keys, F.col("s").alias("s1"), F.col("e").alias("e1"), _buckets(F.col("s"), F.col("e"), width).alias("_b"))
    right = b.select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2"), _buckets(F.col("s"), F.col("e"), width).alias("_b"))
    met = left.join(right, [*keys, "_b"]).filter("s1 < e2 and s2 < e1")
    s, e = F.greatest("s1", "s2"), F.least("e1", "e2")
    # Two spans may meet in several buckets; the one where their overlap begins counts.
    both = met.filter(F.floor(s / width) == F.col("_b")).select(*keys, s.alias("s"), e.alias("e"))
    return both.unionByName(a.join(b, keys, "left_anti").select(*keys, "s", "e")).unionByName(b.join(a, keys, "left_anti").select(*keys, "s", "e"))


def near(points: DataFrame, others: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Points (t) with another point within tol, ends included."""
    a = points.withColumn("_b", F.explode(F.array(*[F.floor(F.col("t") / tol) + d for d in (-1, 0, 1)])))
    b = others.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("t").alias("_t"), F.floor(F.col("t") / tol).alias("_c")).distinct()
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_b") == F.col("_c"), F.abs(F.col("t") - F.col("_t")) <= tol]
    return a.join(b.hint("merge"), on, "left_semi").drop("_b").distinct()


def boundary_f1(reference: DataFrame, produced: DataFrame, keys: list[str], tol: int = 120) -> DataFrame:
    """keys, f1 over all keys of either side: null where there is no reference, 0 where nothing was produced. Points are distinct within a key."""
    count = lambda d, name: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    n = count(reference, "n_ref").join(count(produced, "n_got").hint("merge"), keys, "full_outer")
    n = n.join(count(near(reference, produced, keys, tol), "recalled").hint("merge"), keys, "left").join(count(near(produced, reference, keys, tol), "precise").hint("merge"), keys, "left").na.fill(0, ["n_ref", "n_got", "recalled", "precise"])
    r, p = F.col("recalled") / F.col("n_ref"), F.col("precise") / F.col("n_got")
    f1 = F.when(F.col("n_ref") == 0, F.lit(None)).when((F.col("n_got") == 0) | (F.col("recalled") + F.col("precise") == 0), 0.0).otherwise(2 * r * p / (r + p))
    return n.select(*keys, f1.cast("double").alias("f1"))


def next_start(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds inside (the point t lies in a span, ends included) and next (the least later span start).

    One pass over both sides sorted together: the furthest end of spans begun so far, and the next span's start looking ahead.
    """
    p = points.withColumns({"_k": F.lit(1), "_e": F.lit(None).cast("long"), "_o": F.col("t")})
    s = spans.select(*keys, F.col("s").alias("_o"), F.col("e").alias("_e"), F.lit(0).alias("_k"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("_o", "_k")
    reach = F.max("_e").over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("_k") == 0, F.col("_o"))).over(W.partitionBy(*keys).orderBy(F.desc("_o"), F.desc("_k")).rowsBetween(W.unboundedPreceding, -1))
    return both.withColumns({"inside": F.coalesce(reach >= F.col("_o"), F.lit(False)), "next": ahead}).filter("_k = 1").drop("_k", "_e", "_o")
