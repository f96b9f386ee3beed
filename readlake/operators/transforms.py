"""Row-local changes of records: masking, trimming, textual alignments, clean-up, upgrades."""

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions.seq import reverse_complement
from readlake.operators.combine import Header
from readlake.schema import CIGAR

Op = Callable[[DataFrame], DataFrame]
#: Length of the pieces in which reference bases are kept.
CHUNK = 1 << 16


def mask_quality(least: int) -> Op:
    """Bases of lower quality become N; records without quality stay."""

    def op(df: DataFrame) -> DataFrame:
        r = F.col("read")
        masked = F.array_join(F.zip_with(F.split(r["sequence"], ""), r["quality"], lambda b, q: F.when(q < least, "N").otherwise(b)), "")
        return df.withColumn("read", F.when(F.size(r["quality"]) == F.length(r["sequence"]), r.withField("sequence", masked)).otherwise(r))

    return op


def drop_statistics(df: DataFrame) -> DataFrame:
    """Records without the statistics of mapping; headers lose command lines in edit_header."""
    return df.withColumn("aln_stats", F.slice("aln_stats", 1, 0))


def edit_header(header: Header, change: Callable[[Header], Header]) -> Header:
    """The header changed by a function."""
    return change(header)


def overlap_trims(bases: np.ndarray, lengths: np.ndarray, adapter: str, least: int) -> np.ndarray:
    """Bases to cut from the end of each sequence, where adapter begins within it and may run past it.

    bases holds the sequences backwards, upper-case letters as bytes, a row each; lengths how many of a row count. Of all overlaps of the
    sequence's end with the adapter's beginning, the one with the fewest differences counts, eight adapter bases that hang over being
    one difference; of equals the longest. Its score is the adapter's length plus the overlapped bases less eight a difference (1 a
    match, -3 a mismatch, doubled); it must reach least, with fewer differences than a quarter of the adapter.

    Dynamic programming over all sequences at once, base by base. A cell holds differences and hanging bases as one number, (differences +
    hanging // 8) * one + hanging, so that the least number is the best cell, and a gap along the adapter is a running minimum."""
    y = np.frombuffer(adapter[::-1].upper().encode("latin-1"), np.uint8)
    m, one = len(y), np.int64(1 << 20)
    hang = np.arange(m + 1, dtype=np.int64)
    ramp = hang * one
    row = np.repeat(((hang // 8) * one + hang)[None], len(bases), axis=0)
    most = m // 4
    best_rank = np.full(len(bases), most, np.int64)
    best_at = np.zeros(len(bases), np.int64)
    for i in range(int(lengths.max(initial=0))):
        x = bases[:, i, None]
        other = (x != y) & (x != 78) & (y != 78)  # N agrees with all
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + one
        new[:, 1:] = np.minimum(row[:, :-1] + other * one, row[:, 1:] + one)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
        rank = row[:, m] // one
        take = (i < lengths) & (rank < most) & (rank <= best_rank)
        best_rank[take], best_at[take] = rank[take], i + 1
    return np.where((best_at > 0) & (m + best_at - 8 * best_rank >= least), best_at, 0)


def overlap_trim(sequence: str, adapter: str, least: int) -> int:
    """The same for one sequence."""
    x = np.frombuffer(sequence[::-1].upper().encode("latin-1", "replace"), np.uint8)
    return int(overlap_trims(x[None], np.array([len(x)]), adapter, least)[0])


def trim(left: Sequence[str] = (), right: Sequence[str] = (), least: int = 4) -> Op:
    """Trailing Ns cut, then each adapter of right at the 3' end and of left at the 5' end; cigars of all hits shortened to match.

    Alignment of an adapter is dynamic programming, so it runs over whole Arrow batches; cigars are trimmed by expressions."""
    lefts, rights = tuple(left), tuple(right)

    cuts = overlap_trims

    @F.pandas_udf("struct<l:int,r:int>")
    def points(sequence: pd.Series, l0: pd.Series, r0: pd.Series) -> pd.DataFrame:
        import numpy as np

        there = sequence.notna().to_numpy()
        text = [s.upper().encode("latin-1", "replace") for s in sequence[there]]
        a, b = l0[there].to_numpy(np.int64), r0[there].to_numpy(np.int64)
        for i, s in enumerate(text):
            b[i] = a[i] + len(s[a[i] : b[i]].rstrip(b"N"))
        order = np.argsort(b - a)  # blocks of sequences of like length
        for back, adapters in ((True, rights), (False, lefts)):
            for ad in adapters:
                for k in range(0, len(order), 1000):
                    at = order[k : k + 1000]
                    parts = [text[i][a[i] : b[i]] for i in at]
                    size = np.array([len(p) for p in parts], np.int64)
                    wide = int(size.max(initial=0))
                    if wide:
                        rows = np.frombuffer(b"".join((p[::-1] if back else p).ljust(wide, b"\0") for p in parts), np.uint8).reshape(-1, wide)
                        cut = cuts(rows, size, ad if back else ad[::-1], least)
                        if back:
                            b[at] -= cut
                        else:
                            a[at] += cut
        out = pd.DataFrame({"l": pd.array([pd.NA] * len(sequence), "Int32"), "r": pd.array([pd.NA] * len(sequence), "Int32")})
        out.loc[there, "l"], out.loc[there, "r"] = a.astype(np.int32), b.astype(np.int32)
        return out

    def op(df: DataFrame) -> DataFrame:
        r = F.col("read")
        l0 = F.coalesce(r["trim_left"], F.lit(0))
        r0 = F.coalesce(r["trim_right"], F.length(r["sequence"]))
        d = df.withColumn("t__", points(r["sequence"], l0, r0))
        d = d.withColumns({"dl__": F.col("t__.l") - l0, "dr__": r0 - F.col("t__.r")})
        dl, dr = F.col("dl__"), F.col("dr__")
        hit = F.transform("hit", lambda h: h.withField("cigar", cg.trim_right(cg.trim_left(h["cigar"], dl), dr)))
        read = r.withField("trim_left", F.when(dl > 0, F.col("t__.l")).otherwise(r["trim_left"])).withField("trim_right", F.when(dr > 0, F.col("t__.r")).otherwise(r["trim_right"]))
        ok = r["sequence"].isNotNull()
        return d.withColumns({"read": F.when(ok, read).otherwise(r), "hit": F.when(ok, hit).otherwise(F.col("hit"))}).drop("t__", "dl__", "dr__")

    return op


def textual_alignment(reference: Column, query: Column, cigar: Column) -> Column:
    """struct(ref, qry): gapped texts of the reference bases and the read along the cigar; skipped and clipped parts are left out."""
    start = F.struct(F.lit(1).alias("r"), F.lit(1).alias("q"), F.lit("").alias("ref"), F.lit("").alias("qry"))

    def step(s: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        both, ins, dele, clip, skip = op.isin("M", "X", "="), op == "I", op == "D", op == "S", op == "N"
        gap = F.repeat(F.lit("-"), n)
        ref = F.when(both | dele, F.substr(reference, s["r"], n)).when(ins, gap).otherwise("")
        qry = F.when(both | ins, F.substr(query, s["q"], n)).when(dele, gap).otherwise("")
        r = s["r"] + F.when(both | dele | skip, n).otherwise(0)
        q = s["q"] + F.when(both | ins | clip, n).otherwise(0)
        return F.struct(r.cast("int").alias("r"), q.cast("int").alias("q"), F.concat(s["ref"], ref).alias("ref"), F.concat(s["qry"], qry).alias("qry"))

    return F.aggregate(cigar, start, step)


def reference_chunks(contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """genome_name, sequence, chunk, chunk_start, bases: contig bases (genome_name, sequence, range_start, bases) cut at multiples of chunk.

    Joins then move pieces of bounded size rather than contigs."""
    first, last = F.floor(F.col("range_start") / chunk), F.floor((F.col("range_start") + F.length("bases") - 1) / chunk)
    c = contigs.where("length(bases) > 0").withColumn("chunk", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("chunk") * chunk, F.col("range_start"))
    hi = F.least((F.col("chunk") + 1) * chunk, F.col("range_start") + F.length("bases"))
    return c.select("genome_name", "sequence", "chunk", lo.alias("chunk_start"), F.substr("bases", (lo - F.col("range_start") + 1).cast("int"), (hi - lo).cast("int")).alias("bases"))


def fetch_bases(places: DataFrame, chunks: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """key, bases of each place (key, genome_name, sequence, start, end, half open); positions without bases are N.

    Equi-join on (genome_name, sequence, chunk); a place touches as many chunks as it is long."""
    p = places.where("end > start").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    j = p.join(chunks.withColumnRenamed("bases", "b__"), ["genome_name", "sequence", "chunk"], "left")
    lo = F.greatest("start", F.col("chunk") * chunk)
    hi = F.least("end", (F.col("chunk") + 1) * chunk)
    a, b = F.greatest(lo, "chunk_start"), F.least(hi, F.col("chunk_start") + F.length("b__"))
    n = lambda x: F.repeat(F.lit("N"), F.greatest(F.lit(0), x).cast("int"))
    piece = F.when(b > a, F.concat(n(a - lo), F.substr("b__", (a - F.col("chunk_start") + 1).cast("int"), (b - a).cast("int")), n(hi - b))).otherwise(n(hi - lo))
    # several contigs may share a chunk: the letters of all are laid over each other
    per = j.groupBy(key, "chunk").agg(F.collect_list(F.coalesce(piece, n(hi - lo))).alias("ps"))
    laid = F.aggregate(
        F.slice("ps", 2, 1 << 30),
        F.try_element_at("ps", F.lit(1)),
        lambda acc, x: F.array_join(F.zip_with(F.split(acc, ""), F.split(x, ""), lambda u, v: F.when(u == "N", v).otherwise(u)), ""),
    )
    return per.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", laid.alias("t")))), lambda x: x["t"]), "").alias("bases"))


def add_alignments(df: DataFrame, chunks: DataFrame, key: str = "read_id", context: int = 0, strict: bool = False) -> DataFrame:
    """Records, unique by key, whose hits have aln_ref and aln_qry: reference and read along the cigar, both in the read's direction.

    context shows so many reference bases beyond either end, against '-'. A hit without position, or on reference that isn't there, keeps null texts, or is
    an error if strict."""
    flat = df.select(F.col(key).alias("rid__"), F.col("read.sequence").alias("q__"), F.posexplode("hit").alias("i__", "h")).select(
        F.struct("rid__", "i__").alias("id__"), "q__", "h", F.col("h.genome_name").alias("genome_name"), F.col("h.sequence").alias("sequence"),
        (F.col("h.start_pos") - context).alias("start"), (F.col("h.start_pos") + F.abs("h.aln_length") + context).alias("end")
    )
    ref = fetch_bases(flat.select("id__", "genome_name", "sequence", "start", "end"), chunks, "id__")
    j = flat.join(ref, "id__", "left")
    fwd = F.when(F.col("h.aln_length") < 0, reverse_complement(F.col("bases"))).otherwise(F.upper("bases"))
    inner = F.substr(fwd, F.lit(context + 1), F.abs("h.aln_length").cast("int"))
    text = textual_alignment(inner, F.upper("q__"), F.col("h.cigar"))
    pad = F.repeat(F.lit("-"), F.lit(context))
    n = F.length("bases")
    lref = F.concat(F.substr(fwd, F.lit(1), F.lit(context)), text["ref"], F.substr(fwd, (n - context + 1).cast("int"), F.lit(context))) if context else text["ref"]
    lqry = F.concat(pad, text["qry"], pad) if context else text["qry"]
    known = F.col("bases").isNotNull() & ~F.col("bases").rlike("^N*$")
    if strict:
        known = known | F.raise_error(F.concat(F.lit("no reference for "), F.coalesce("genome_name", F.lit("?")), F.lit(" "), F.coalesce("sequence", F.lit("?")))).cast("boolean")
    h = F.col("h").withField("aln_ref", F.when(known, lref)).withField("aln_qry", F.when(known, lqry))
    back = j.select("id__.rid__", "id__.i__", h.alias("h")).groupBy("rid__").agg(F.array_sort(F.collect_list(F.struct("i__", "h"))).alias("hs"))
    out = df.join(back, df[key] == F.col("rid__"), "left")
    return out.withColumn("hit", F.coalesce(F.col("hs.h"), F.col("hit"))).drop("rid__", "hs")


def upgrade_old(score: Column, cigar_bytes: Column) -> tuple[Column, Column]:
    """Score and cigar of records of the first format: scores were ten times natural logarithms, cigars bytes (below 128 matches, below 192 inserts less
    128, else deletions less 192)."""
    new = F.floor(score / math.log(10) + 0.5).cast("int")
    runs = F.transform(cigar_bytes, lambda b: F.when(b < 128, cg.run(F.lit("M"), b)).when(b < 192, cg.run(F.lit("I"), b - 128)).otherwise(cg.run(F.lit("D"), b - 192)))
    return new, F.aggregate(runs, F.array().cast(CIGAR), lambda acc, x: cg.push(acc, x["op"], x["len"]))
