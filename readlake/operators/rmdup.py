"""Duplicate removal with a Bayesian consensus per position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions.hits import hit_to
from readlake.functions.seq import effective_length
from readlake.operators.filters import multiplicity, score_limit
from readlake.schema import READ

LISTED = 8


def duplicate_key(hit: Column, read: Column) -> Column:
    """Coordinates that duplicates share: genome, sequence, start, length with strand, trimmed length."""
    return F.struct(hit["genome_name"].alias("genome_name"), hit["sequence"].alias("sequence"), hit["start_pos"].alias("start_pos"), hit["aln_length"].alias("aln_length"), effective_length(read).alias("length"))


def _ln(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-300)))


def remove_duplicates(slope: float = 7.5, intercept: float = 20.0, max_quality: int = 127, genomes: Sequence[str] = (), key: str = "read_id") -> Callable[[DataFrame], DataFrame]:
    """Records whose hit (to the genomes, or the best) is good and lies at equal coordinates become one, with a consensus.

    Good: score missing, 0, or at most slope * (trimmed length - intercept), rounded. Per position, the likelihood of base b is the product
    over reads of 1 - e where b was read and e / 3 elsewhere, e from the smaller of map quality (254 if missing) and base quality (30 if
    missing); the base of most likelihood in order A, C, T, G is called, with the Phred score of the others' share, rounded half up, at
    most max_quality. The read of smallest seqid gives its names and hits; seqid gets the prefix C_, the description goes; reads that were
    merged are members, listed up to eight, else counted. Records that are alone, badly aligned or unaligned pass with their quality
    capped. Bases are exploded to (coordinates, position) and combined map-side, so no group is ever collected but for its member list,
    which holds at most eight entries.
    """

    def op(df: DataFrame) -> DataFrame:
        h = hit_to(F.col("hit"), genomes)
        limit = F.floor(score_limit(effective_length(F.col("read")), slope, intercept) + 0.5)
        good = h.isNotNull() & (h["score"].isNull() | (h["score"] == 0) | (h["score"] <= limit))
        d = df.withColumn("dk__", F.when(good, duplicate_key(h, F.col("read")))).withColumn("mq__", h["map_quality"])
        sizes = d.where("dk__ is not null").groupBy("dk__").agg(F.count(F.lit(1)).alias("n__"), F.min(F.struct(F.col("read.seqid").alias("s"), F.col(key).alias("k"))).alias("first__")).where("n__ > 1")
        cap = F.col("read").withField("quality", F.transform("read.quality", lambda q: F.least(q, F.lit(max_quality))))
        alone = d.join(sizes.select("dk__"), "dk__", "left_anti").withColumn("read", cap).drop("dk__", "mq__")
        dup = d.join(sizes, "dk__")
        start = F.coalesce("read.trim_left", F.lit(0))
        bases = F.slice(F.split(F.upper("read.sequence"), ""), start + 1, F.greatest(F.lit(0), effective_length(F.col("read"))))
        quality = F.slice("read.quality", start + 1, F.greatest(F.lit(0), effective_length(F.col("read"))))
        at = dup.select("dk__", "mq__", F.posexplode(F.arrays_zip(bases.alias("b"), F.coalesce(quality, F.array_repeat(F.lit(30), F.length("read.sequence"))).alias("q"))).alias("pos", "x")).where("x.b is not null")
        e = F.pow(F.lit(10.0), F.least(F.coalesce("mq__", F.lit(254)), F.coalesce("x.q", F.lit(30))) / -10)
        votes = at.groupBy("dk__", "pos").agg(*[F.sum(F.when(F.col("x.b") == b, _ln(1 - e)).otherwise(_ln(e / 3))).alias(b) for b in "ACTG"])
        called = _call(votes, max_quality)
        consensus = called.groupBy("dk__").agg(F.array_sort(F.collect_list(F.struct("pos", "base", "q"))).alias("c__"))
        # the eight smallest members, and the number of all
        member = F.struct(F.col("read.seqid").alias("s"), F.col(key).alias("k"), F.col("read").alias("r"))
        groups = dup.groupBy("dk__").agg(
            F.sum(F.greatest(multiplicity(dup), F.lit(1)).cast("bigint")).alias("count__"),
            F.collect_list(F.when(F.col("n__") < LISTED, member)).alias("members__"),
        )
        keep = dup.where(F.col(key).eqNullSafe(F.col("first__.k")) & F.col("read.seqid").eqNullSafe(F.col("first__.s"))).join(consensus, "dk__", "left").join(groups, "dk__")
        none = F.lit(None)
        read = (
            F.col("read")
            .withField("seqid", F.concat(F.lit("C_"), F.col("read.seqid")))
            .withField("description", none.cast("string"))
            .withField("sequence", F.array_join("c__.base", ""))
            .withField("quality", F.col("c__.q"))
            .withField("trim_left", none.cast("int"))
            .withField("trim_right", none.cast("int"))
        )
        listed = F.col("count__") < LISTED
        merged = keep.withColumns(
            {
                "read": read,
                "members": F.when(listed, F.transform(F.array_sort("members__"), lambda m: m["r"])).otherwise(F.array().cast(f"array<{READ}>")),
                "nmembers": F.when(listed, F.lit(0)).otherwise(F.col("count__")).cast("int"),
            }
        )
        return alone.unionByName(merged.select(*alone.columns))

    return op


def _call(votes: DataFrame, max_quality: int) -> DataFrame:
    """Base of most log-likelihood in columns A, C, T, G (first of equals), and the Phred score of the rest's share."""
    cols = [F.col(b) for b in "ACTG"]
    top = F.greatest(*cols)
    base = F.coalesce(*[F.when(c == top, F.lit(b)) for b, c in zip("ACTG", cols, strict=True)])
    share = sum((F.exp(c - top) for c in cols[1:]), F.exp(cols[0] - top))
    rest = (share - 1) / share
    q = F.when(rest > 0, F.floor(F.log10(rest) * -10 + 0.5)).otherwise(max_quality)
    return votes.select("*", base.alias("base"), F.least(F.lit(max_quality), q).cast("int").alias("q"))
