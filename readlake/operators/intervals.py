"""Interval joins by bins: both sides are cut into bins of a fixed width and joined by equality, so that no nested loop is planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.operators.blocked import with_neighbour

WIDTH = 1 << 14


def bins(start: Column, end: Column, width: int = WIDTH) -> Column:
    """The bins that [start, end] touches, end included; an empty list where a bound is null or end is before start."""
    lo, hi = F.floor(start / width), F.floor(end / width)
    return F.when(end >= start, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def overlap_pairs(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], l_range: tuple[str, str], r_range: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Rows of left and right (as structs l and r) whose keys are equal and whose closed ranges overlap, each pair once.

    A pair is kept in the first bin that both touch. Nulls match nothing. The join is an ordinary equi-join on key and bin, so AQE splits
    skewed bins; the output is bounded by the true overlaps."""
    a = left.select(F.struct("*").alias("l"), F.explode(bins(F.col(l_range[0]), F.col(l_range[1]), width)).alias("bin"))
    b = right.select(F.struct("*").alias("r"), F.explode(bins(F.col(r_range[0]), F.col(r_range[1]), width)).alias("r_bin"))
    ls, le, rs, re_ = F.col(f"l.{l_range[0]}"), F.col(f"l.{l_range[1]}"), F.col(f"r.{r_range[0]}"), F.col(f"r.{r_range[1]}")
    cond = F.col("bin") == F.col("r_bin")
    for x, y in on:
        cond = cond & (F.col(f"l.{x}") == F.col(f"r.{y}"))
    cond = cond & (ls <= re_) & (rs <= le) & (F.col("bin") == F.floor(F.greatest(ls, rs) / width))
    return a.join(b, cond).select("l", "r")


def overlap_filter(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], l_range: tuple[str, str], r_range: tuple[str, str], key: str, inside: bool = True, width: int = WIDTH) -> DataFrame:
    """Rows of left, unique by key, whose closed range overlaps a row of right (inside), or none (not inside)."""
    hit = overlap_pairs(left.select(key, *dict.fromkeys([x for x, _ in on]), *l_range), right.select(*dict.fromkeys([y for _, y in on]), *r_range), on, l_range, r_range, width)
    return left.join(hit.select(F.col(f"l.{key}").alias(key)).distinct(), key, "left_semi" if inside else "left_anti")


def in_regions(records: DataFrame, regions: DataFrame, inside: bool = True, key: str = "read_id") -> DataFrame:
    """Records, unique by key, with only the hits that overlap (inside) or do not overlap a region (chrom, start, end) of their sequence.

    A hit overlaps if start <= position + |length| and end >= position. Hits without position or length overlap nothing."""
    flat = records.select(key, F.posexplode("hit").alias("i", "h")).select(
        F.struct(key, "i").alias("id"), F.col("h.sequence").alias("s"), F.col("h.start_pos").alias("p"), (F.col("h.start_pos") + F.abs(F.col("h.aln_length"))).alias("e")
    )
    r = regions.select("chrom", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    found = overlap_filter(flat, r, [("s", "chrom")], ("p", "e"), ("start", "end"), "id").groupBy(F.col(f"id.{key}").alias(key)).agg(F.collect_set("id.i").alias("in__"))
    j = records.join(found, key, "left")
    has = lambda i: F.coalesce(F.array_contains("in__", i), F.lit(False))
    return j.withColumn("hit", F.filter("hit", lambda h, i: has(i) if inside else ~has(i))).drop("in__")


def as_of(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, payload: Sequence[str], block: int = 1 << 24) -> DataFrame:
    """points with the payload of the mark of greatest position at or below at, per keys; nulls where there is none.

    A union and a forward fill within blocks, linked across blocks (operators.blocked), so that no task holds a key. Marks of equal position:
    the one of greatest payload counts. Points with a null key or position find nothing."""
    ok = " and ".join(f"{k} is not null" for k in (*keys, at))
    m = marks.select(*keys, F.col(mark).cast("bigint").alias("x__"), F.struct(F.col(mark).alias("mark__"), *payload).alias("m__")).where(" and ".join(f"{k} is not null" for k in (*keys, "x__")))
    m = m.groupBy(*keys, "x__").agg(F.max("m__").alias("m__"))
    blk = F.floor(F.col("x__") / block)
    p = points.where(ok).select(F.struct("*").alias("p__"), *keys, F.col(at).cast("bigint").alias("x__")).withColumn("b__", blk)
    mb = m.withColumn("b__", blk)
    # the last mark of each block goes to the start of all later blocks of the key
    last = mb.groupBy(*keys, "b__").agg(F.max(F.struct("x__", "m__")).alias("e__"))
    spine = p.select(*keys, "b__").distinct().unionByName(last.select(*keys, "b__")).distinct().join(last, [*keys, "b__"], "left")
    w = Window.partitionBy(*keys).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    carried = spine.select(*keys, "b__", F.last("e__", ignorenulls=True).over(w)["m__"].alias("c__"))
    both = p.select(*keys, "b__", "x__", F.lit(1).alias("k__"), "p__").unionByName(mb.select(*keys, "b__", "x__", F.lit(0).alias("k__"), "m__"), allowMissingColumns=True)
    fill = Window.partitionBy(*keys, "b__").orderBy("x__", "k__").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("f__", F.last("m__", ignorenulls=True).over(fill)).where("k__ = 1").join(carried, [*keys, "b__"], "left")
    got = got.select("p__", F.coalesce("f__", "c__").alias("m__"))
    none = points.where(f"not coalesce({ok}, false)").select(F.struct("*").alias("p__"), F.lit(None).cast(got.schema["m__"].dataType).alias("m__"))
    return got.unionByName(none).select("p__.*", F.col("m__.mark__").alias(mark), *[F.col(f"m__.{c}").alias(c) for c in payload])


def find_contig(points: DataFrame, contigs: DataFrame, keys: Sequence[str] = ("genome_name", "sequence"), at: str = "start_pos") -> DataFrame:
    """points with range_start, range_end and offset of the contig that holds the position: the last one that starts at or before it, if it
    reaches it. contigs has the keys, range_start, range_end, offset."""
    found = as_of(points, contigs, keys, at, "range_start", ["range_end", "offset"])
    inside = F.col(at) < F.col("range_end")
    return found.withColumns({c: F.when(inside, F.col(c)) for c in ("range_start", "range_end", "offset")})


def translate_back(points: DataFrame, contigs: DataFrame, at: str = "position") -> DataFrame:
    """points (genome_name, a genome position) with sequence and the position within it: contig offsets are positions of the genome."""
    found = as_of(points, contigs, ["genome_name"], at, "offset", ["sequence", "range_start", "range_end"])
    inside = F.col(at) - F.col("offset") < F.col("range_end") - F.col("range_start")
    return found.withColumns({"sequence": F.when(inside, F.col("sequence")), "sequence_pos": F.when(inside, F.col(at) - F.col("offset") + F.col("range_start"))}).drop("range_start", "range_end", "offset")


def next_of(df: DataFrame, keys: list[str], position: str, payload: Column, name: str, block: int = 1 << 24) -> DataFrame:
    """df with the payload of the next row by position (unique within keys)."""
    return with_neighbour(df, keys, F.floor(F.col(position) / block), [F.col(position)], payload, name, forward=True)
