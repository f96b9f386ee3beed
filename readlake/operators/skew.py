"""Problem 3: per-key results where a few keys hold most rows.

Value-frequency compression: rows are counted by (key, value) first, with map-side combining, so that a hot key leaves each task as at
most one row per distinct value and is spread over all tasks by value. Distinct counts and modes are then plain mergeable aggregates
of the weighted values. Percentiles come from a radix descent over equal-width buckets of the value range, so no task ever sorts or
holds the values of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.session import clean_genome, clean_sequence, durable

#: Buckets of one level of the descent. Three levels cover a range of 2^36 values, as of genome positions; six any range of bigint.
BUCKETS = 4096


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, weight: the number of rows of each key and value; null keys and null values are keys and values of their own."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def key_counts(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows, n_values (rows with a value), n_distinct, mode (smallest of the most frequent values), mode_rows.

    An all-null key has n_values 0, n_distinct 0 and a null mode."""
    v = F.col("value").isNotNull()
    best = F.max(F.when(v, F.struct(F.col("weight").alias("w"), (-F.col("value")).alias("v"))))
    return (
        weighted.groupBy(*keys)
        .agg(
            F.sum("weight").alias("n_rows"),
            F.coalesce(F.sum(F.when(v, F.col("weight"))), F.lit(0)).alias("n_values"),
            F.count("value").alias("n_distinct"),
            best.alias("b"),
        )
        .select(*keys, "n_rows", "n_values", "n_distinct", (-F.col("b.v")).alias("mode"), F.col("b.w").alias("mode_rows"))
    )


def percentiles(weighted: DataFrame, keys: list[str], ps: tuple[float, ...], levels: int | None = None) -> DataFrame:
    """keys, p, quantile: the smallest value with at least a share p of the key's non-null rows at or below it (exact, discrete).

    The values are integers. Each level counts the rows of BUCKETS equal buckets of the still open range of (key, p), finds the bucket
    that holds the wanted rank and opens it; levels must satisfy BUCKETS^levels > range and by default follow from the greatest range (one row is taken for
    that, so weighted is best a durable table). Keys without a value have no row.
    """
    w = weighted.where("value is not null").withColumn("value", F.col("value").cast("bigint"))
    k = [F.col(c) for c in keys]
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in keys))
    ends = w.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("weight").alias("n"))
    open_ = ends.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in ps]))).select(
        *keys, "p", "lo", "hi", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("p"))).cast("bigint").alias("rank")
    )
    minus = "({0} - {1})"
    if levels is None:
        span = int(ends.agg(F.max(F.expr("cast(hi as decimal(20)) - lo"))).first()[0] or 0)
        levels = next(n for n in range(1, 7) if BUCKETS**n > span)
        if span >= 1 << 62:  # differences are no bigint
            minus = "(cast({0} as decimal(20)) - {1})"
    for _ in range(levels):
        # whole numbers throughout, a double would round ranges beyond 2^53
        width = F.expr(f"cast({minus.format('hi', 'lo')} div {BUCKETS} + 1 as bigint)")
        o = open_.withColumn("width", width)
        hit = w.alias("w").join(o.alias("o"), same("w", "o") & F.expr("w.value between o.lo and o.hi"))
        cut = hit.select(
            *[F.col(f"w.{c}").alias(c) for c in keys], "o.p", "o.lo", "o.hi", "o.rank", "o.width", F.expr(f"{minus.format('w.value', 'o.lo')} div o.width").alias("bucket"), "w.weight"
        )
        h = cut.groupBy(*keys, "p", "lo", "hi", "rank", "width", "bucket").agg(F.sum("weight").alias("rows"))
        win = Window.partitionBy(*k, "p").orderBy("bucket")
        h = h.withColumn("upto", F.sum("rows").over(win)).where("upto >= rank and upto - rows < rank")
        start = "cast(cast(lo as decimal(20)) + bucket * cast(width as decimal(20)) as bigint)"
        lo = F.expr(start)
        # no sum beyond hi, which may be the greatest bigint
        top = F.when(F.expr(f"{minus.format('hi', start)} < width"), F.col("hi")).otherwise(lo + (F.col("width") - 1))
        open_ = h.select(
            *keys, "p", lo.alias("lo"), top.alias("hi"), (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank")
        )
    return open_.select(*keys, "p", F.col("lo").alias("quantile"))


def hit_values(hits: DataFrame, value: str) -> DataFrame:
    """Weighted values of the hits per (genome_name, sequence), genome and sequence in clean form."""
    h = hits.select(clean_genome("genome_name").alias("genome_name"), clean_sequence("sequence").alias("sequence"), F.col(value).alias("v"))
    return compress(h, ["genome_name", "sequence"], "v")


def heavy_pairs(hits: DataFrame, share: float = 0.03, value: str = "map_quality") -> DataFrame:
    """genome_name, sequence, n_rows, n_distinct, mode, mode_rows of the pairs that hold at least share of all rows.

    Rows with a null genome or sequence count among all rows; a pair with a null is never returned. An empty table gives no row."""
    keys = ["genome_name", "sequence"]
    # a row for each pair, written once, so that the hits are read once for the counts and their sum
    per = durable(key_counts(hit_values(hits, value), keys))
    total = per.agg(F.sum("n_rows").alias("all_rows"))
    # one row by definition, so the broadcast is bounded
    return (
        per.crossJoin(F.broadcast(total))
        .where(F.col("genome_name").isNotNull() & F.col("sequence").isNotNull() & (F.col("n_rows") >= share * F.col("all_rows")))
        .drop("all_rows", "n_values")
    )


def pair_profile(hits: DataFrame, value: str = "start_pos", ps: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """genome_name, sequence, n_rows, n_distinct, mode, mode_rows, q25, q50, q75 of every pair: exact, however uneven the pairs."""
    keys = ["genome_name", "sequence"]
    w = durable(hit_values(hits, value))
    counts = key_counts(w, keys)
    q = percentiles(w, keys, ps)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(f"q{round(p * 100)}") for p in ps])
    c, d = counts.alias("c"), wide.alias("d")
    on = F.expr(" and ".join(f"c.{x} <=> d.{x}" for x in keys))
    return c.join(d, on, "left").select(*[f"c.{x}" for x in keys], "n_rows", "n_distinct", "mode", "mode_rows", *[f"q{round(p * 100)}" for p in ps])
