"""Contigs from overlapping alignments: pileup, genotype likelihoods, consensus."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions.hits import hit_to
from readlake.functions.seq import effective_sequence, reverse_complement
from readlake.operators.intervals import as_of
from readlake.operators.periods import merge_intervals
from readlake.schema import HIT, READ, complete, result
from readlake.session import durable

#: Genotypes and the letter of each. Fixed values.
GENOTYPES = ("AA", "CC", "GG", "TT", "AC", "AG", "AT", "CG", "CT", "GT")
LETTERS = "ACGTMRWSYK"
#: Columns that one contig record holds at most; longer contigs come as consecutive records.
RECORD = 1_000_000
#: Reference positions (a power of two) whose reads go to one task, and reads of one such block from which on it is hot.
BLOCK_BITS, HOT = 14, 100_000


@dataclass(frozen=True)
class Damage:
    """Deamination of ancient reads: rates within double strands and single strands, and the mean length of single-stranded ends."""

    ds_rate: float
    ss_rate: float
    overhang: float

    @property
    def extension(self) -> float:
        return 1 - 1 / (2 * self.overhang + 1)


def placed(df: DataFrame, genomes: tuple[str, ...] = (), key: str = "read_id") -> DataFrame:
    """One row per record with a placed hit: key, genome_name, sequence, start, end, map_quality, and the read in reference direction: bases,
    quality, cigar."""
    h = hit_to(F.col("hit"), genomes)
    back = h["aln_length"] < 0
    # a cigar that fits the whole read is of the whole read, any other of the trimmed one
    whole = cg.query_length(h["cigar"]) == F.length("read.sequence")
    s = F.upper(F.when(whole, F.col("read.sequence")).otherwise(effective_sequence(F.col("read"))))
    cut = F.slice("read.quality", F.coalesce("read.trim_left", F.lit(0)) + 1, F.greatest(F.lit(0), F.length(s)))
    q = F.when(whole, F.col("read.quality")).otherwise(cut)
    d = df.select(
        F.col(key).alias("key"),
        h["genome_name"].alias("genome_name"),
        h["sequence"].alias("sequence"),
        h["start_pos"].alias("start"),
        F.coalesce(h["map_quality"], F.lit(254)).alias("map_quality"),
        F.when(back, reverse_complement(s)).otherwise(s).alias("bases"),
        F.when(back, F.reverse(q)).otherwise(q).alias("quality"),
        F.when(back, F.reverse(h["cigar"])).otherwise(h["cigar"]).alias("cigar"),
    ).where("genome_name is not null and sequence is not null and start is not null and size(cigar) > 0")
    return d.withColumn("end", F.col("start") + cg.reference_span(F.col("cigar"))).where("end > start")


def assign_contigs(rows: DataFrame) -> DataFrame:
    """rows with contig_start and contig_end of the maximal stretch of touching alignments that they lie in."""
    keys = ["genome_name", "sequence"]
    stretches = merge_intervals(rows.select(*keys, "start", "end")).select(*keys, F.col("start").alias("contig_start"), F.col("end").alias("contig_end"))
    return as_of(rows, stretches, keys, "start", "contig_start", ["contig_end"])


def _spread(cigar: Column, start: Column) -> Column:
    """array<struct<pos, ord, q>>: reference position, ordinal within an insert after it (0: the position itself) and 1-based index of the
    read base (null: deleted) of each step of the cigar."""
    state = F.struct(start.cast("bigint").alias("p"), F.lit(1).alias("q"), F.array().cast("array<struct<pos:bigint,ord:int,q:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        both, dele, ins, clip, skip = op.isin("M", "X", "="), op == "D", op == "I", op == "S", op == "N"
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        cell = lambda pos, o, q: F.struct(pos.cast("bigint").alias("pos"), o.cast("int").alias("ord"), q.cast("int").alias("q"))
        more = (
            F.when(both, F.transform(at, lambda i: cell(s["p"] + i, F.lit(0), s["q"] + i)))
            .when(dele, F.transform(at, lambda i: cell(s["p"] + i, F.lit(0), F.lit(None))))
            .when(ins, F.transform(at, lambda i: cell(s["p"] - 1, i + 1, s["q"] + i)))
            .otherwise(F.array().cast("array<struct<pos:bigint,ord:int,q:int>>"))
        )
        return F.struct(
            (s["p"] + F.when(both | dele | skip, n).otherwise(0)).cast("bigint").alias("p"),
            (s["q"] + F.when(both | ins | clip, n).otherwise(0)).cast("int").alias("q"),
            F.concat(s["out"], more).alias("out"),
        )

    return F.aggregate(cigar, state, step, lambda s: s["out"])


def pileup(rows: DataFrame) -> DataFrame:
    """One row per read and column: contig keys, block, pos, ord, base (null: deleted), quality, error (Phred, the smaller of base and map quality),
    crossing (the read also covers pos + 1), index and length of the read. Rows with a block give only the columns that lie in it."""
    own = F.col("block") if "block" in rows.columns else F.lit(None).cast("bigint")
    keep = rows.select("genome_name", "sequence", "contig_start", own.alias("own"), "map_quality", "bases", "quality", "start", "end", "cigar")
    d = keep.select("genome_name", "sequence", "contig_start", "own", "map_quality", "bases", "quality", "end", F.explode(_spread(F.col("cigar"), F.col("start"))).alias("c"))
    at = F.shiftright("c.pos", BLOCK_BITS)
    d = d.where(F.col("own").isNull() | (F.col("own") == at)).withColumn("block", F.coalesce("own", at)).where(F.col("c.q").isNull() | (F.col("c.q") <= F.length("bases")))
    base = F.when(F.col("c.q").isNotNull(), F.substr("bases", F.col("c.q"), F.lit(1)))
    q = F.coalesce(F.try_element_at("quality", F.col("c.q")), F.lit(30))
    return d.select(
        "genome_name",
        "sequence",
        "contig_start",
        "block",
        F.col("c.pos").alias("pos"),
        F.col("c.ord").alias("ord"),
        base.alias("base"),
        F.least(q, F.col("map_quality")).alias("error"),
        "map_quality",
        (F.col("c.pos") + 1 < F.col("end")).alias("crossing"),
        F.col("c.q").alias("index"),
        F.length("bases").alias("length"),
    )


def _allele_likelihoods(damage: Damage | None) -> dict[str, Column]:
    """Probability of the base read, given each true base."""
    e = F.greatest(F.lit(1e-25), F.pow(F.lit(10.0), F.col("error") / -10))
    seen = lambda b: F.when(F.col("base") == b, 1 - e).otherwise(e / 3)
    if damage is None or not damage.ds_rate:
        return {b: seen(b) for b in "ACGT"}
    x = F.lit(damage.extension)
    single = 1 - (1 - F.pow(x, F.col("index"))) * (1 - F.pow(x, F.col("length") - F.col("index") + 1))
    rate = damage.ds_rate + (damage.ss_rate - damage.ds_rate) * single
    return {"A": seen("A"), "C": (1 - rate) * seen("C") + rate * seen("T"), "G": (1 - rate) * seen("G") + rate * seen("A"), "T": seen("T")}


def _three_ways(pile: DataFrame, known: Column) -> tuple[DataFrame, list[Column], dict[str, Column]]:
    """Without damage a read weighs a genotype in one of three ways, by how many of its alleles the base is: sums for these, and the ten
    genotypes from the sums."""
    e = F.greatest(F.lit(1e-25), F.pow(F.lit(10.0), F.col("error") / -10))
    pile = pile.withColumn("e", F.when(known, e))
    pile = pile.withColumns({"two": F.log10(1 - F.col("e")) * -10, "one": F.log10((1 - F.col("e") + F.col("e") / 3) / 2) * -10, "none": F.log10(F.col("e") / 3) * -10})
    of = lambda c, b: F.coalesce(F.sum(F.when(F.col("base") == b, F.col(c) - F.col("none"))), F.lit(0.0)).alias(f"{c}{b}")
    sums = [F.coalesce(F.sum("none"), F.lit(0.0)).alias("none"), *[of(c, b) for c in ("two", "one") for b in "ACGT"]]
    return pile, sums, {g: F.col("none") + (F.col(f"two{g[0]}") if g[0] == g[1] else F.col(f"one{g[0]}") + F.col(f"one{g[1]}")) for g in GENOTYPES}


def contig_columns(rows: DataFrame, prior: float = 0.001, damage: Damage | None = None) -> DataFrame:
    """columns of all rows (see placed and assign_contigs). The reads of a block of positions go to one task, which then piles up its columns by
    itself, so that reads are shuffled and not their bases. Of hot blocks, of HOT reads and more, the columns are combined in the tasks that hold the
    reads and shuffled then, as few columns stand for many bases there."""
    by = ["genome_name", "sequence", "contig_start", "block"]
    # a read with an insert before its first match also has columns at the position before it
    cut = rows.withColumn("block", F.explode(F.sequence(F.shiftright(F.col("start") - 1, BLOCK_BITS), F.shiftright(F.col("end") - 1, BLOCK_BITS))))
    hot = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("reads__")).where(F.col("reads__") >= HOT).drop("reads__")
    calm = cut.join(hot, by, "left_anti").repartition(*by)
    return columns(pileup(calm), prior, damage).unionByName(columns(pileup(cut.join(hot, by, "left_semi")), prior, damage))


def columns(pile: DataFrame, prior: float = 0.001, damage: Damage | None = None) -> DataFrame:
    """One row per column that a contig keeps: contig keys, pos, ord, call (letter, or '-' for a deletion), quality, likelihoods (ten, Phred above
    the best, at most 255), depth, seen (A, C, G, T), square (sum of squared map qualities), n.

    A column is one aggregate over (contig, pos, ord), combined map-side. A base is called if more reads show one than a gap; inserts that
    at most half the reads crossing them carry are left out. With damage, reads are explained by deamination towards their ends."""
    key = ["genome_name", "sequence", "contig_start", "block", "pos", "ord"]
    known = F.col("base").isin("A", "C", "G", "T")
    if damage is None or not damage.ds_rate:
        pile, weighed, after = _three_ways(pile, known)
    else:
        pile = pile.withColumns({f"l_{b}": c for b, c in _allele_likelihoods(damage).items()})
        p = {b: F.col(f"l_{b}") for b in "ACGT"}
        pair = lambda g: p[g[0]] if g[0] == g[1] else (p[g[0]] + p[g[1]]) / 2
        weighed, after = [F.coalesce(F.sum(F.when(known, F.log10(pair(g)) * -10)), F.lit(0.0)).alias(g) for g in GENOTYPES], {}
    agg = pile.groupBy(*key).agg(
        F.count("base").alias("observed"),
        F.count(F.when(F.col("base").isNull(), 1)).alias("gaps"),
        F.count(F.when(F.col("crossing"), 1)).alias("across"),
        *weighed,
        *[F.count(F.when(F.col("base") == b, 1)).cast("int").alias(f"n{b}") for b in "ACGT"],
        F.sum(F.when(F.col("ord") == 0, F.col("map_quality").cast("double") * F.col("map_quality"))).alias("square"),
        F.count(F.lit(1)).alias("n"),
    )
    agg = agg.withColumns(after)
    # rows of one position: itself and its inserts
    w = Window.partitionBy(*key[:5])
    a = agg.withColumn("crossed", F.max(F.when(F.col("ord") == 0, F.col("across"))).over(w))
    gaps = F.when(F.col("ord") == 0, F.col("gaps")).otherwise(F.greatest(F.lit(0), F.coalesce("crossed", F.lit(0)) - F.col("observed")))
    a = a.withColumn("gapped", gaps).where("ord = 0 or observed > gapped")
    hom, het = -10 * math.log10(1 - prior), -10 * math.log10(prior) if prior > 0 else 1e9
    # step by step, so that each value is computed once a column
    a = a.withColumns({f"p_{g}": F.col(g) + (hom if g[0] == g[1] else het) for g in GENOTYPES})
    post = [F.col(f"p_{g}") for g in GENOTYPES]
    a = a.withColumns({"best": F.least(*post), "low": F.least(*[F.col(g) for g in GENOTYPES])})
    best, low = F.col("best"), F.col("low")
    a = a.withColumn("total", sum((F.pow(F.lit(10.0), (best - c) / 10) for c in post), F.lit(0.0)))
    letter = F.coalesce(*[F.when(c == best, F.lit(x)) for c, x in zip(post, LETTERS, strict=True)])
    rest = (F.col("total") - 1) / F.col("total")
    quality = F.when(rest > 0, F.least(F.lit(255), F.floor(F.log10(rest) * -10 + 0.5))).otherwise(255).cast("int")
    lk = F.array(*[F.least(F.lit(255), F.floor(F.col(g) - low + 0.5)).cast("int") for g in GENOTYPES])
    called = F.col("observed") > F.col("gapped")
    return a.select(
        *[k for k in key if k != "block"],
        F.when(~called, "-").when(F.col("nA") + F.col("nC") + F.col("nG") + F.col("nT") == 0, "N").otherwise(letter).alias("call"),
        F.when(called, quality).otherwise(0).alias("quality"),
        lk.alias("likelihoods"),
        F.col("observed").cast("int").alias("depth"),
        F.array("nA", "nC", "nG", "nT").alias("seen"),
        "square",
        "n",
    )


def duct_tape(df: DataFrame, label: str = "contig", prior: float = 0.001, damage: Damage | None = None, genomes: tuple[str, ...] = (), key: str = "read_id", longest: int = RECORD) -> DataFrame:
    """Contig records: consensus, qualities, likelihoods, seen_bases, depth, and one forward hit whose cigar tells inserts and deletions.

    Names are label, sequence and start, so they don't depend on order. The map quality is the root mean square of the reads'. A contig of more
    than longest positions comes in consecutive records, so that no record, and no task, grows without bound."""
    c = contig_columns(durable(assign_contigs(placed(df, genomes, key))), prior, damage)
    return assemble(c, label, longest)


def assemble(cols: DataFrame, label: str = "contig", longest: int = RECORD) -> DataFrame:
    """Records of columns."""
    part = (F.floor((F.col("pos") - F.col("contig_start")) / longest)).alias("part")
    kept = F.col("call") != "-"
    op = F.when(F.col("ord") > 0, "I").when(kept, "M").otherwise("D")
    one = F.struct("pos", "ord", "call", "quality", "likelihoods", "depth", "seen", op.alias("op"))
    g = cols.groupBy("genome_name", "sequence", "contig_start", part).agg(
        F.array_sort(F.collect_list(one)).alias("cs"), F.min("pos").alias("start"), F.max("pos").alias("last"), (F.sum("square") / F.sum(F.when(F.col("ord") == 0, F.col("n")))).alias("ms")
    )
    bases = F.filter("cs", lambda x: x["call"] != "-")
    g = g.withColumn("bs", bases)
    # runs of equal operations, by where they begin
    n = F.size("cs")
    g = g.withColumn("runs", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.col("cs")[i]["op"] != F.col("cs")[F.greatest(F.lit(0), i - 1)]["op"])))
    cigar = F.transform("runs", lambda i, k: cg.run(F.col("cs")[i]["op"], F.coalesce(F.try_element_at("runs", k + 2), n) - i))
    read = complete(
        READ,
        {
            "seqid": F.concat_ws("_", F.lit(label), "sequence", F.col("start").cast("string")),
            "sequence": F.array_join("bs.call", ""),
            "quality": F.col("bs.quality"),
            "likelihoods": F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.transform("bs", lambda x: x["likelihoods"][i])),
            "seen_bases": F.flatten("bs.seen"),
            "depth": F.filter(F.transform("cs", lambda x: F.when(x["ord"] == 0, x["depth"])), lambda d: d.isNotNull()),
        },
    )
    span = F.col("last") - F.col("start") + 1
    hit = complete(HIT, {"genome_name": F.col("genome_name"), "sequence": F.col("sequence"), "start_pos": F.col("start"), "aln_length": span, "cigar": cigar, "map_quality": F.floor(F.sqrt("ms") + 0.5)})
    return g.select(*result(read, F.array(hit), num_reads=F.lit(None)), F.col("contig_start").alias("read_id"))


def coverage(cols: DataFrame) -> DataFrame:
    """genome_name, sequence, contig_start, pos, depth of each reference position of a contig."""
    return cols.where("ord = 0").select("genome_name", "sequence", "contig_start", "pos", "depth")
