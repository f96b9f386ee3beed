"""Summaries: stream statistics, substitutions, drop counts. Single aggregates, combined map-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from readlake.functions.hits import best_hit
from readlake.functions.seq import effective_sequence
from readlake.operators.filters import multiplicity

Op = Callable[[DataFrame], DataFrame]


def stats(df: DataFrame) -> DataFrame:
    """One row: total, mapped, mapped_unique, distinct (records), bases, gc, squares of lengths, for all and for mapped records, GC percents.

    Counts are weighted by the reads that a record stands for (one at least), sums of bases aren't. A record is mapped if it has a hit,
    uniquely if its best hit's map quality is missing or at least 30. On an empty input counts are 0 and percents null."""
    s = effective_sequence(F.col("read"))
    n = F.coalesce(F.length(s), F.lit(0)).cast("bigint")
    gc = n - F.coalesce(F.length(F.translate(s, "GC", "")), F.lit(0))
    weight = F.greatest(multiplicity(df), F.lit(1)).cast("bigint")
    best = best_hit(F.col("hit"))
    flat = df.select(n.alias("n"), gc.alias("gc"), weight.alias("w"), best.isNotNull().alias("mapped"), F.coalesce(best["map_quality"] >= 30, F.lit(True)).alias("unique"))
    m, u = F.col("mapped"), F.col("mapped") & F.col("unique")
    total = lambda c, cond=None: F.coalesce(F.sum(F.when(cond, c) if cond is not None else c), F.lit(0).cast("bigint"))
    out = flat.agg(
        total(F.col("w")).alias("total"),
        total(F.col("w"), m).alias("mapped"),
        total(F.col("w"), u).alias("mapped_unique"),
        F.count(F.when(m, 1)).alias("distinct"),
        total(F.col("n")).alias("bases"),
        total(F.col("gc")).alias("gc_bases"),
        total(F.col("n") * F.col("n")).alias("square_length"),
        total(F.col("n"), m).alias("bases_mapped"),
        total(F.col("gc"), m).alias("gc_mapped"),
        total(F.col("n") * F.col("n"), m).alias("square_length_mapped"),
    )
    pc = lambda a, b: F.round(F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return out.withColumns({"gc_percent": pc("gc_bases", "bases"), "gc_percent_mapped": pc("gc_mapped", "bases_mapped")})


def mismatches(df: DataFrame) -> DataFrame:
    """ref, qry, n: how often each reference base meets each read base in the textual alignments of all hits; only A, C, G, T columns."""
    h = df.select(F.explode("hit").alias("h")).where("length(h.aln_ref) = length(h.aln_qry)")
    pairs = F.arrays_zip(F.split(F.upper("h.aln_ref"), "").alias("r"), F.split(F.upper("h.aln_qry"), "").alias("q"))
    p = h.select(F.explode(pairs).alias("p")).select("p.r", "p.q")
    p = p.where(F.col("r").isin("A", "C", "G", "T") & F.col("q").isin("A", "C", "G", "T"))
    return p.groupBy(F.col("r").alias("ref"), F.col("q").alias("qry")).agg(F.count(F.lit(1)).alias("n"))


def counted(name: str, op: Op) -> tuple[Op, Observation]:
    """The operator with an observation of the records before it (rows_in) and after it (rows_out)."""
    before, after = Observation(f"{name} in"), Observation(f"{name} out")
    wrapped = lambda df: op(df.observe(before, F.count(F.lit(1)).alias("rows_in"))).observe(after, F.count(F.lit(1)).alias("rows_out"))
    return wrapped, _Both(before, after)


class _Both:
    def __init__(self, before: Observation, after: Observation) -> None:
        self.before, self.after = before, after

    @property
    def get(self) -> dict:
        got = self.before.get | self.after.get
        return got | {"dropped": got["rows_in"] - got["rows_out"]}


def seed_statistics(df: DataFrame) -> DataFrame:
    """tag, reason, records and the summed counts of the mapping statistics of all records."""
    s = df.select(F.explode("aln_stats").alias("s"))
    total = lambda c: F.coalesce(F.sum(f"s.{c}"), F.lit(0)).alias(c)
    return s.groupBy(F.col("s.tag").alias("tag"), F.col("s.reason").alias("reason")).agg(F.count(F.lit(1)).alias("records"), total("num_raw_seeds"), total("num_useless"), total("num_clumps"))
