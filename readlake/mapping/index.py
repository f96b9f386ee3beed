"""Word index of genomes and the lookup of reads in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.seq import check_repeat, expand_ambiguity, neighbours, reverse_complement
from readlake.session import durable, spread

#: Positions of one piece while words are cut.
PIECE = 1 << 14


@dataclass(frozen=True)
class IndexSpec:
    """Word size, stride of the words kept, longest self-overlap that is looked for (default half a word), the number of places from which on a word is
    dropped, and how many words one with ambiguity codes may stand for without being dropped (None: any number)."""

    k: int = 12
    stride: int = 4
    repeat: int | None = None
    cutoff: int | None = None
    expansions: int | None = None


def genome_words(contigs: DataFrame, spec: IndexSpec) -> DataFrame:
    """genome_name, pos (of the genome), word: the words of contigs (genome_name, offset, bases) at every stride-th position of the genome,
    ambiguity codes expanded, self-overlapping words dropped. Row-local: contigs are cut into overlapping pieces, pieces into words."""
    c = spread(contigs.select("genome_name", "offset", "bases").where(F.length("bases") >= spec.k))
    c = c.select("genome_name", "offset", "bases", F.explode(F.sequence(F.lit(0), F.length("bases") - spec.k, F.lit(PIECE))).alias("at"))
    c = c.select("genome_name", (F.col("offset") + F.col("at")).alias("start"), F.upper(F.substr("bases", F.col("at") + 1, F.lit(PIECE + spec.k - 1))).alias("piece"))
    first = F.pmod(-F.col("start"), F.lit(spec.stride)).cast("int")
    last = F.length("piece") - spec.k
    at = F.when(first <= last, F.sequence(first, last, F.lit(spec.stride))).otherwise(F.array().cast("array<int>"))
    w = c.select("genome_name", "start", "piece", F.explode(at).alias("i"))
    w = w.select("genome_name", (F.col("start") + F.col("i")).alias("pos"), F.substr("piece", F.col("i") + 1, F.lit(spec.k)).alias("word"))
    plain = F.col("word").rlike("^[ACGT]*$")
    w = w.select("genome_name", "pos", F.explode(F.when(plain, F.array("word")).otherwise(expand_ambiguity(F.col("word"), spec.expansions))).alias("word"))
    return w.where(~check_repeat(F.col("word"), spec.k, spec.repeat))


def build_index(contigs: DataFrame, spec: IndexSpec) -> DataFrame:
    """genome_name, word, pos without words at cutoff or more places. Save it bucketed by word (save_index), and lookups don't shuffle it."""
    w = genome_words(contigs, spec)
    if spec.cutoff is None:
        return w
    n = w.groupBy("genome_name", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < spec.cutoff)
    return w.join(n.drop("n"), ["genome_name", "word"], "left_semi")


def save_index(index: DataFrame, table: str, buckets: int) -> None:
    """The index as a table bucketed and sorted by word."""
    index.write.bucketBy(buckets, "word").sortBy("word").mode("overwrite").saveAsTable(table)


def word_histogram(words: DataFrame) -> DataFrame:
    """genome_name, places, words: how many words lie at so many places."""
    n = words.groupBy("genome_name", "word").agg(F.count(F.lit(1)).alias("places"))
    return n.groupBy("genome_name", "places").agg(F.count(F.lit(1)).alias("words"))


def read_words(reads: DataFrame, k: int, mismatches: int = 0) -> DataFrame:
    """read_id, word, offset: all words of both strands; a forward word has its 1-based start as offset, a reverse one the negative position after its
    end, counted from the read's start. mismatches adds the neighbours at so many substitutions."""
    s = F.upper("sequence")
    at = F.when(F.length(s) >= k, F.sequence(F.lit(0), F.length(s) - k)).otherwise(F.array().cast("array<int>"))
    # the reverse complement is made once per read; its words are those of the forward strand from the end
    r = spread(reads.select("read_id", "sequence")).select("read_id", s.alias("s"), reverse_complement(s).alias("t"), F.explode(at).alias("i"))
    fwd = F.substr("s", F.col("i") + 1, F.lit(k))
    rev = F.substr("t", F.length("t") - k - F.col("i") + 1, F.lit(k))
    r = r.where(fwd.rlike("^[ACGT]*$")).select("read_id", F.explode(F.array(F.struct((F.col("i") + 1).alias("offset"), fwd.alias("word")), F.struct((-F.col("i") - k).alias("offset"), rev.alias("word")))).alias("x"))
    r = r.select("read_id", "x.offset", "x.word")
    return r.select("read_id", "offset", F.explode(neighbours(F.col("word"), k, mismatches)).alias("word")) if mismatches else r


def lookup(reads: DataFrame, index: DataFrame, spec: IndexSpec, mismatches: int = 0, cutoff: int | None = None, stride: int | None = None, wordsize: int | None = None) -> DataFrame:
    """read_id, genome_name, pos, offset, diag (pos - offset): where words of reads lie in the index; an equi-join on the word.

    cutoff drops words of so many places, stride keeps positions that it divides, wordsize looks up shorter words, as prefixes of those of the index. Frequent words are dropped when the index is built, so
    a word's matches are bounded by the cutoff."""
    k = spec.k if wordsize is None else wordsize
    if k > spec.k:
        raise ValueError(f"words of {k} in an index of words of {spec.k}")
    index = index if k == spec.k else index.withColumn("word", F.substring("word", 1, k))
    i = index if stride is None else index.where(F.pmod("pos", F.lit(stride)) == 0)
    if cutoff is not None:
        few = i.groupBy("genome_name", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < cutoff).drop("n")
        i = i.join(few, ["genome_name", "word"], "left_semi")
    m = read_words(reads, k, mismatches).join(i, "word")
    return m.select("read_id", "genome_name", "pos", "offset", (F.col("pos") - F.col("offset")).alias("diag")).distinct()


def combine_seeds(matches: DataFrame, k: int, least: int) -> DataFrame:
    """read_id, genome_name, ref_pos, query_pos, size: matches on one diagonal that touch or overlap become one seed; seeds shorter than least go;
    of seeds of one strand within 8 diagonals of the last one kept, in order of diagonal and offset downwards, the longest stays."""
    diagonal = Window.partitionBy("read_id", "genome_name", "diag").orderBy(F.col("offset").desc())
    m = matches.withColumn("gap", F.lag("offset").over(diagonal) - F.col("offset"))
    m = m.withColumn("island", F.sum(F.when(F.col("gap") <= k, 0).otherwise(1)).over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    s = m.groupBy("read_id", "genome_name", "diag", "island").agg(F.min("offset").alias("o"), (F.max("offset") - F.min("offset") + k).cast("int").alias("size")).where(F.col("size") >= least)
    one = F.struct((-F.col("diag")).alias("d"), (-F.col("o")).alias("o"), F.col("size").alias("size"))
    lists = s.groupBy("read_id", "genome_name", (F.col("o") < 0).alias("back")).agg(F.array_sort(F.collect_list(one)).alias("ss"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(F.abs(last["d"] - x["d"]) <= 8, F.lit(False))
        swap = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))
        return F.when(near & (x["size"] > last["size"]), swap).when(near, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("ss", F.slice("ss", 1, 0), step)
    out = lists.select("read_id", "genome_name", F.explode(kept).alias("x"))
    return out.select("read_id", "genome_name", (-F.col("x.d") - F.col("x.o")).alias("ref_pos"), (-F.col("x.o")).cast("int").alias("query_pos"), "x.size")


def word_counts(words: DataFrame) -> DataFrame:
    """genome_name, word, places: at how many places each word lies."""
    return words.groupBy("genome_name", "word").agg(F.count(F.lit(1)).alias("places"))


def seed_reads(
    reads: DataFrame, index: DataFrame, spec: IndexSpec, least: int = 16, mismatches: int = 0, repeat_threshold: int | None = None, counts: DataFrame | None = None, genomes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(seeds, statistics): seeds of the reads, and for every read and genome num_raw_seeds, num_useless, num_clumps and a reason: too_many_seeds for reads
    with repeat_threshold or more seeds, which then have none; without seeds, repeats_only if words lay at cutoff or more places, else no_seeds.

    num_raw_seeds counts all places of the read's words, num_useless those of words at cutoff or more places. counts (word_counts) are the places before any
    cutoff; without them the index is counted, which then has to be built without one. genomes (genome_name) default to those of the counts."""
    counts = word_counts(index) if counts is None else counts
    genomes = counts.select("genome_name").distinct() if genomes is None else genomes
    useless = F.lit(False) if spec.cutoff is None else F.col("places") >= spec.cutoff
    few = index if spec.cutoff is None else index.join(counts.where(~useless), ["genome_name", "word"], "left_semi")
    places = read_words(reads, spec.k, mismatches).join(counts, "word").groupBy("read_id", "genome_name")
    places = places.agg(F.sum("places").alias("num_raw_seeds"), F.sum(F.when(useless, F.col("places")).otherwise(0)).alias("num_useless"))
    # seeds serve both the statistics and the alignments
    seeds = durable(combine_seeds(lookup(reads, few, spec, mismatches), spec.k, least))
    n = seeds.groupBy("read_id", "genome_name").agg(F.count(F.lit(1)).alias("num_clumps"))
    # every read to every genome: as many rows as the result has; genomes are few
    pairs = reads.select("read_id").crossJoin(F.broadcast(genomes))
    stats = pairs.join(places, ["read_id", "genome_name"], "left").join(n, ["read_id", "genome_name"], "left")
    stats = stats.select("read_id", "genome_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num_raw_seeds", "num_useless", "num_clumps")])
    many = F.lit(False) if repeat_threshold is None else F.col("num_clumps") >= repeat_threshold
    none = F.col("num_clumps") == 0
    stats = stats.withColumn("reason", F.when(many, "too_many_seeds").when(none & (F.col("num_useless") > 0), "repeats_only").when(none, "no_seeds"))
    if repeat_threshold is not None:
        seeds = seeds.join(stats.where("reason = 'too_many_seeds'"), ["read_id", "genome_name"], "left_anti")
    return seeds, stats


def index_sensitivity(seeds: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: sequences, seeds, in_region, found: of reads with a known origin (read_id, start, end as genome positions), how many seeds lie there
    and how many reads have one."""
    j = truth.join(seeds.select("read_id", "ref_pos", "size"), "read_id", "left")
    inside = (F.col("ref_pos") >= F.col("start") - 1) & (F.col("ref_pos") <= F.col("end"))
    return j.agg(
        F.count_distinct("read_id").alias("sequences"),
        F.count("ref_pos").alias("seeds"),
        F.count(F.when(inside, 1)).alias("in_region"),
        F.count_distinct(F.when(inside, F.col("read_id"))).alias("found"),
    )
