"""Seeded random genomes and reads with known origin. All randomness is a hash of position or read number, so results don't depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions.seq import reverse_complement
from readlake.operators.transforms import fetch_bases, reference_chunks


def uniform(*what: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 40)).cast("double") / float(1 << 40)


def random_genome(spark: SparkSession, name: str, length: int, seed: int = 1, contig: int = 1 << 16) -> DataFrame:
    """genome_name, sequence, offset, range_start, range_end, bases: one sequence chr1 of uniform A, C, G, T, in contigs of bounded length."""
    d = spark.range(0, -(-length // contig)).withColumn("s", F.col("id") * contig)
    n = F.least(F.lit(contig), F.lit(length) - F.col("s"))
    letters = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.substr(F.lit("ACGT"), F.pmod(F.xxhash64(F.col("s") + i, F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1)))
    return d.select(
        F.lit(name).alias("genome_name"), F.lit("chr1").alias("sequence"), (F.col("s") + F.col("id")).alias("offset"), F.col("s").alias("range_start"), (F.col("s") + n).alias("range_end"), F.array_join(letters, "").alias("bases")
    )


def sample_reads(contigs: DataFrame, genome_length: int, n: int = 100_000, mean: float = 50, deviation: float = 15, mutation: float = 0.014, gaps: float = 0.0, quality: int = 40, seed: int = 1) -> DataFrame:
    """read_id, seqid (origin), sequence, quality, sequence_name, strand, start, len: reads of both strands, lengths about normal (at least 1), with substitutions,
    and, by half of gaps each, lost and doubled bases."""
    s = F.lit(seed)
    u = lambda k, *more: uniform(F.col("read_id"), F.lit(k), s, *more)
    normal = F.sqrt(F.log(F.greatest(F.lit(1e-12), u(1))) * -2) * F.cos(u(2) * (2 * math.pi))
    r = contigs.sparkSession.range(n).withColumnRenamed("id", "read_id")
    r = r.withColumn("len", F.least(F.lit(genome_length), F.greatest(F.lit(1), F.round(normal * deviation + mean))).cast("bigint"))
    r = r.withColumn("start", F.floor(u(3) * (F.lit(genome_length) - F.col("len") + 1))).withColumn("end", F.col("start") + F.col("len"))
    r = r.withColumn("strand", F.when(u(4) < 0.5, "-").otherwise("+"))
    g = contigs.select("genome_name", "sequence").limit(1)
    places = r.join(F.broadcast(g))  # one row
    bases = fetch_bases(places.select("read_id", "genome_name", "sequence", "start", "end"), reference_chunks(contigs), "read_id")
    j = places.withColumnRenamed("sequence", "sequence_name").join(bases, "read_id")
    fwd = F.split(F.when(F.col("strand") == "-", reverse_complement(F.col("bases"))).otherwise(F.col("bases")), "")

    def change(b: Column, i: Column) -> Column:
        x, y = u(5, i), u(6, i)
        other = F.substr(F.translate(F.lit("ACGT"), "", ""), F.floor(y * 4).cast("int") + 1, F.lit(1))
        new = F.when(other == b, F.translate(b, "ACGT", "CGTA")).otherwise(other)
        return F.when(x < gaps / 2, "").when(x < gaps, F.concat(b, other)).when(x < gaps + mutation, new).otherwise(b)

    text = F.array_join(F.transform(fwd, change), "")
    name = F.concat_ws(":", F.col("read_id").cast("string"), "genome_name", "sequence_name", "strand", F.col("start").cast("string"), F.col("len").cast("string"))
    return j.select("read_id", name.alias("seqid"), text.alias("sequence"), F.array_repeat(F.lit(quality), F.length(text)).alias("quality"), "sequence_name", "strand", "start", "len")


def match_probability(p: float, k: int, length: int, stride: int = 1, mismatches: int = 0) -> float:
    """Probability that a read of the length has, at some multiple of stride, a stretch of k bases with at most so many mismatches, each base matching by p.

    A chain over (matches since the last mismatch, since the one before, ...), for stride 1; larger strides shorten the read by what they may
    miss."""
    states = {tuple([0] * (mismatches + 1)): 1.0}
    hit = 0.0
    for _ in range(length - (stride - 1)):
        new: dict = {}
        for runs, w in states.items():
            for ok, q in ((True, p), (False, 1 - p)):
                nxt = tuple(r + 1 for r in runs) if ok else (0, *(r + 1 for r in runs[:-1]))
                nxt = tuple(min(r, k) for r in nxt)
                if nxt[-1] >= k:
                    hit += w * q
                else:
                    new[nxt] = new.get(nxt, 0.0) + w * q
        states = new
    return hit
