"""Mapping of reads: seeds, alignment of each candidate, choice of the best and its map quality."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.phred import sum_of
from readlake.mapping.align import Aligner, align, align_exact, seed_quality
from readlake.mapping.index import IndexSpec, genome_words, seed_reads, word_counts
from readlake.operators.filters import select_policies
from readlake.operators.intervals import translate_back
from readlake.operators.transforms import CHUNK, fetch_bases, reference_chunks
from readlake.session import collect_bounded, durable

CANDIDATE = "read_id long, genome_name string, back boolean, start long, stop long, score double, cigar array<struct<op:string,len:int>>"
#: Reference bases beyond the read on either side of a candidate.
SLACK = 12


def genome_coordinates(contigs: DataFrame) -> DataFrame:
    """Contigs (genome_name, offset, bases) as one sequence per genome, for fetching bases by genome position."""
    return contigs.select("genome_name", F.lit("").alias("sequence"), F.col("offset").alias("range_start"), "bases")


def align_candidates(aligner: Aligner, least: int = 1, seed_mismatches: int = 0):
    """An Arrow-batched function from candidates (read, window of reference, its seeds) to alignments; rows beyond the acceptance limit are left out, and
    those without a seed of least bases with at most seed_mismatches."""
    a = aligner
    complement = str.maketrans("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b.itertuples():
                s = c.sequence.upper()
                ref = c.bases.upper()
                strand = s.translate(complement)[::-1] if c.back else s
                first = [len(s) + x["query_pos"] if c.back else x["query_pos"] - 1 for x in c.seeds]
                pairs = [(ref[x["ref_pos"] - c.start :][: x["size"]].replace("U", "T"), strand[i:][: x["size"]]) for x, i in zip(c.seeds, first, strict=True)]
                if not any(seed_quality(u, v, seed_mismatches, least) for u, v in pairs):
                    continue
                q = None if c.quality is None else list(c.quality)
                if c.back:
                    ref = ref.translate(complement)[::-1]
                limit = a.max_penalty_per_nuc * len(s)
                got = align_exact(s, q, ref, a, limit) or align(s, q, ref, a, limit)
                if got:
                    score, i, j, cigar = got
                    lo, hi = (c.end - j, c.end - i) if c.back else (c.start + i, c.start + j)
                    rows.append((c.read_id, c.genome_name, c.back, lo, hi, score, [{"op": o, "len": n} for o, n in cigar]))
            yield pd.DataFrame(rows, columns=["read_id", "genome_name", "back", "start", "stop", "score", "cigar"])

    return run


def map_reads(reads: DataFrame, contigs: DataFrame, index: DataFrame, spec: IndexSpec, aligner: Aligner | None = None, least: int = 16, mismatches: int = 0, repeat_threshold: int | None = None, counts: DataFrame | None = None, chunk: int = CHUNK, seed_mismatches: int = 0) -> DataFrame:
    """read_id, genome_name, sequence, start_pos, aln_length, score, map_quality, cigar, reason: the best hit of each read to each genome.

    reads: read_id, sequence, quality array<int>; contigs: genome_name, sequence, offset, range_start, range_end, bases. The score is the rounded Phred penalty; map quality is the
    Phred score of the share of all other alignments, null for the only one, at most the aligner's. Reads with seeds but no alignment within
    max_penalty_per_nuc have the reason bad_alignment, those with too many seeds too_many_seeds, those without a seed repeats_only if some of their words lie at
    cutoff or more places, else no_seeds. Every read has a row for each genome. Alignments that end in one place count once.
    counts are the word_counts of the genomes before any cutoff; if not given, they are made from the contigs. chunk is the length of the pieces in which
    reference is fetched: little more than a contig where contigs are short and many. Seeds, found with mismatches in each word, are aligned only where least
    bases match with at most seed_mismatches."""
    a = aligner or Aligner()
    counts = word_counts(genome_words(contigs, spec)) if counts is None else counts
    seeds, stats = seed_reads(reads, index, spec, least, mismatches, repeat_threshold, counts, contigs.select("genome_name").distinct())
    r = reads.select("read_id", "sequence", "quality")
    j = seeds.join(r, "read_id").withColumn("back", F.col("query_pos") < 0)
    n = F.length("sequence")
    begin = F.when(F.col("back"), F.col("ref_pos") - (n + F.col("query_pos"))).otherwise(F.col("ref_pos") - F.col("query_pos") + 1)
    # seeds of one neighbourhood have one window
    j = j.withColumn("start", F.greatest(F.lit(0), begin - SLACK)).withColumn("end", begin + n + SLACK)
    window = ["read_id", "genome_name", "back", "start"]
    j = j.groupBy(*window).agg(F.max("end").alias("end"), F.first("sequence").alias("sequence"), F.first("quality").alias("quality"), F.collect_list(F.struct("ref_pos", "query_pos", "size")).alias("seeds")).withColumn("id", F.struct("read_id", "genome_name", "back", "start"))
    chunks = reference_chunks(genome_coordinates(contigs), chunk)
    w = fetch_bases(j.select("id", "genome_name", F.lit("").alias("sequence"), "start", "end"), chunks, "id", chunk)
    c = j.join(w, "id").select("read_id", "genome_name", "back", "start", "end", "sequence", "quality", "bases", "seeds")
    found = c.mapInPandas(align_candidates(a, least, seed_mismatches), CANDIDATE)
    once = found.groupBy("read_id", "genome_name", "back", "start", "stop").agg(F.min(F.struct("score", "cigar")).alias("x"))
    best = once.groupBy("read_id", "genome_name").agg(F.min(F.struct("x.score", "start", "stop", "back", "x.cigar")).alias("b"), F.collect_list("x.score").alias("scores"))
    # alignments of a read are bounded by its seeds; the share of all but the best, in the log domain
    rest = F.slice(F.array_sort("scores"), 2, 1 << 30)
    share = sum_of(rest) - sum_of(F.col("scores"))
    mapq = F.when(F.size("scores") > 1, F.least(F.lit(a.max_mapq), F.floor(share + 0.5))).cast("int")
    best = best.select("read_id", "genome_name", F.col("b.start").alias("position"), F.when(F.col("b.back"), F.col("b.start") - F.col("b.stop")).otherwise(F.col("b.stop") - F.col("b.start")).cast("int").alias("aln_length"), F.floor(F.col("b.score") + 0.5).cast("int").alias("score"), mapq.alias("map_quality"), "b.cigar")
    # taken several times by the as-of join, alignments are made once
    best = durable(best)
    placed = translate_back(best, contigs.select("genome_name", "sequence", "offset", "range_start", "range_end"), "position")
    hits = placed.select("read_id", "genome_name", "sequence", F.col("sequence_pos").alias("start_pos"), "aln_length", "score", "map_quality", "cigar")
    out = stats.select("read_id", "genome_name", F.col("reason").alias("r__")).join(hits, ["read_id", "genome_name"], "left")
    reason = F.coalesce("r__", F.when(F.col("score").isNull(), "bad_alignment").otherwise("aligned"))
    return out.select("read_id", "genome_name", "sequence", "start_pos", "aln_length", "score", "map_quality", "cigar", reason.alias("reason"))


def map_by_policy(reads: DataFrame, contigs: DataFrame, policies: DataFrame, aligner: Aligner | None = None, chunk: int = CHUNK) -> DataFrame:
    """What map_reads gives, each read looked up as the policies that match it say: word size, stride and cutoff of each index (a genome by name),
    least seed length, mismatches in a seed, and repeat threshold.

    reads has seqid besides; policies: see select_policies. Reads that no policy matches, or whose policies name no index, have a row of
    reason no_policy for each genome. Of several entries for one genome the last counts; a genome that isn't in contigs gives no row.
    Reads are mapped in as many passes as there are different ways, at most 1000, over indices that are made once each."""
    how = ["min_seed_len", "max_mismatches_in_seed", "repeat_threshold", "indices"]
    chosen = durable(select_policies(reads, policies).where("size(indices) > 0").withColumn("way", F.to_json(F.struct(*how), {"ignoreNullFields": "false"})))
    ways = collect_bounded(chosen.groupBy("way").agg(F.first(F.struct(*how)).alias("h")), 1000, "ways of lookup")
    words: dict[tuple, DataFrame] = {}
    rest = reads.join(chosen.select("read_id").distinct(), "read_id", "left_anti").select("read_id")
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("sequence", "string"), ("start_pos", "bigint"), ("aln_length", "int"), ("score", "int"), ("map_quality", "int"), ("cigar", "array<struct<op:string,len:int>>"))]
    # genomes are few
    out = rest.crossJoin(F.broadcast(contigs.select("genome_name").distinct())).select("read_id", "genome_name", *nulls, F.lit("no_policy").alias("reason"))
    for r in sorted(ways, key=lambda r: r["way"]):
        h = r["h"]
        mine = reads.join(chosen.where(F.col("way") == r["way"]).select("read_id"), "read_id", "left_semi").select("read_id", "sequence", "quality")
        for ix in {i["name"]: i for i in h["indices"]}.values():
            spec = IndexSpec(ix["wordsize"] or 12, ix["stride"] or 4, cutoff=ix["cutoff"])
            c = contigs.where(F.col("genome_name") == ix["name"])
            at = (ix["name"], spec.k, spec.stride)
            if at not in words:
                words[at] = durable(genome_words(c, spec))
            least = h["min_seed_len"] or 16
            got = map_reads(mine, c, words[at], spec, aligner, least, 1 if ix["allow_near_perfect"] else 0, h["repeat_threshold"], word_counts(words[at]), chunk, h["max_mismatches_in_seed"] or 0)
            out = out.unionByName(got)
    return out
