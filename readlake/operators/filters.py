"""Filters. Hit filters drop hits and keep the record; record filters drop the record. All are row-local column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions.hits import best_hit
from readlake.functions.seq import effective_length, effective_sequence, gc_percent

Op = Callable[[DataFrame], DataFrame]


def filter_hits(keep: Callable[[Column], Column], genomes: Sequence[str] = ()) -> Op:
    """Keeps the hits for which keep holds (null counts as no), and, where genomes are listed, all hits to other genomes."""

    def one(h: Column) -> Column:
        k = F.coalesce(keep(h), F.lit(False))
        return (~F.coalesce(h["genome_name"].isin(*genomes), F.lit(False)) | k) if genomes else k

    return lambda df: df.withColumn("hit", F.filter("hit", one))


def score_limit(length: Column, slope: float, intercept: float) -> Column:
    return slope * (length - intercept)


def filter_score(slope: float = 7.5, intercept: float = 20.0, genomes: Sequence[str] = ()) -> Op:
    """Hits whose score is at most slope * (read bases of the cigar - intercept); a missing score is 0."""
    return filter_hits(lambda h: F.coalesce(h["score"], F.lit(0)) <= score_limit(cg.query_length(h["cigar"]), slope, intercept), genomes)


def filter_total_score(slope: float = 7.5, intercept: float = 20.0, genomes: Sequence[str] = ()) -> Op:
    """Records whose scores, summed over the first hit to each listed genome (all hits without a list), are at most slope * (trimmed
    length - intercept)."""

    def op(df: DataFrame) -> DataFrame:
        hits = F.col("hit") if not genomes else F.array_compact(F.array(*[F.try_element_at(F.filter("hit", _genome(g)), F.lit(1)) for g in genomes]))
        total = F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + F.coalesce(h["score"], F.lit(0)))
        return df.where(total <= score_limit(effective_length(F.col("read")), slope, intercept))

    return op


def _genome(g: str) -> Callable[[Column], Column]:
    return lambda h: h["genome_name"] == g


def filter_mapq(least: int, genomes: Sequence[str] = ()) -> Op:
    """Hits whose map quality is missing (unique) or at least so high."""
    return filter_hits(lambda h: F.coalesce(h["map_quality"] >= least, F.lit(True)), genomes)


def ignore_hits(sequences: Sequence[str] = (), genomes: Sequence[str] = ()) -> Op:
    """Drops hits to the sequences, or to any sequence without a list, within the genomes."""
    return filter_hits(lambda h: ~F.coalesce(h["sequence"].isin(*sequences), F.lit(False)) if sequences else F.lit(False), genomes)


def only_genomes(genomes: Sequence[str]) -> Op:
    """Keeps only hits to the genomes; an empty list removes all hits."""
    return filter_hits(lambda h: h["genome_name"].isin(*genomes) if genomes else F.lit(False))


def filter_quality(least: float) -> Op:
    """Records with a quality whose mean is at least so high; without a quality, or with an empty one, a record is dropped."""
    q = F.col("read.quality")
    return lambda df: df.where((F.size(q) > 0) & (F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x) >= F.size(q) * least))


def filter_length(least: int = 0, most: int | None = None) -> Op:
    """Clears the hits of records whose trimmed length is outside the bounds; the record stays."""

    def op(df: DataFrame) -> DataFrame:
        n = effective_length(F.col("read"))
        ok = (n >= least) if most is None else n.between(least, most)
        return df.withColumn("hit", F.when(ok, F.col("hit")).otherwise(F.slice("hit", 1, 0)))

    return op


def filter_gc(least: int = 0, most: int = 100) -> Op:
    """Records whose whole GC percentage of the trimmed read is within the bounds; an empty trimmed read is dropped."""
    return lambda df: df.where(gc_percent(effective_sequence(F.col("read"))).between(least, most))


def _wanted(genomes: Sequence[str], sequences: Sequence[str]) -> Callable[[Column], Column]:
    def ok(h: Column) -> Column:
        g = h["genome_name"].isin(*genomes) if genomes else F.lit(True)
        s = h["sequence"].isin(*sequences) if sequences else F.lit(True)
        return F.coalesce(g & s, F.lit(False))

    return ok


def require_hit(genomes: Sequence[str] = (), sequences: Sequence[str] = ()) -> Op:
    """Records with a hit to one of the genomes and sequences; empty lists allow any."""
    return lambda df: df.where(F.exists("hit", _wanted(genomes, sequences)))


def require_best_hit(genomes: Sequence[str] = (), sequences: Sequence[str] = ()) -> Op:
    """The same of the best hit only."""

    def op(df: DataFrame) -> DataFrame:
        b = best_hit(F.col("hit"))
        return df.where(b.isNotNull() & _wanted(genomes, sequences)(b))

    return op


def multiplicity(df: DataFrame) -> Column:
    """Reads that a record stands for beyond itself: listed and counted members."""
    return F.coalesce(F.greatest(F.size("members"), F.lit(0)), F.lit(0)) + F.coalesce("nmembers", F.lit(0))


def filter_multi(least: int = 2) -> Op:
    """Records seen at least so often."""
    return lambda df: df.where(multiplicity(df) >= least)


def subsample(fraction: float, seed: int = 0) -> Op:
    """A pseudo-random part of the records, by a hash of seqid and seed: the same records in every run and partitioning."""
    return lambda df: df.where(F.pmod(F.xxhash64("read.seqid", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def glob_to_regex(pattern: Column) -> Column:
    """A shell pattern of *, ? and sets as a regular expression."""
    esc = F.regexp_replace(pattern, r"([.\\+^$(){}|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(esc, r"\*", ".*"), r"\?", "."), r"\[!", "[^"), F.lit("$"))


def select_policies(reads: DataFrame, policies: DataFrame) -> DataFrame:
    """read_id, min_seed_len, max_mismatches_in_seed, repeat_threshold, indices: every matching policy merged in file order.

    reads has read_id, seqid, sequence; policies has position, minlength, maxlength, name_pattern, the scalars and indices
    array<struct<name, wordsize, stride, cutoff, allow_near_perfect>>. The last policy that gives a scalar wins, lists are appended.
    Policies are a configuration of a few rows (at most 1000, checked), so they are broadcast. Reads without one have no row.
    """
    from readlake.session import collect_bounded

    n = len(collect_bounded(policies.select("position"), 1000, "policies"))
    p = F.broadcast(policies.alias("p")) if n else policies.alias("p")
    length = F.length("r.sequence")
    on = (
        (length >= F.coalesce("p.minlength", F.lit(0)))
        & (F.col("p.maxlength").isNull() | (length <= F.col("p.maxlength")))
        & (F.col("p.name_pattern").isNull() | F.regexp_like(F.col("r.seqid"), glob_to_regex(F.col("p.name_pattern"))))
    )
    j = reads.alias("r").join(p, on)
    last = lambda c: F.max_by(F.col(f"p.{c}"), F.when(F.col(f"p.{c}").isNotNull(), F.col("p.position"))).alias(c)
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p.position", "p.indices"))), lambda x: F.coalesce(x["indices"], F.array())))
    return j.groupBy("r.read_id").agg(last("min_seed_len"), last("max_mismatches_in_seed"), last("repeat_threshold"), lists.alias("indices"))
