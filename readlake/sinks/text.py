"""Text formats of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions.hits import best_hit, hit_to, mapq_for_sam, quality_text
from readlake.functions.seq import effective_length, reverse_complement
from readlake.operators.filters import multiplicity

WRAP = 50


def _wrapped(text: Column, width: int = WRAP) -> Column:
    """Text in lines of width; an empty text is one empty line."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / width).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * width + 1, F.lit(width))), "\n")


def sam_lines(df: DataFrame) -> DataFrame:
    """value: a SAM line for each hit, or an unmapped one for a record without hits. Reverse hits show the reverse complement; hits whose cigar has
    another length than the read, and records without seqid or sequence, have no line. UQ is the score, XD the reads merged into the record."""
    r = F.col("read")
    d = df.where("read.seqid is not null and read.sequence is not null").withColumn("xd", multiplicity(df))
    d = d.select("read", "xd", F.explode_outer("hit").alias("h"))
    h = F.col("h")
    back = h["aln_length"] < 0
    seq, q = r["sequence"], r["quality"]
    mapped = F.concat_ws(
        "\t", r["seqid"], F.when(back, "16").otherwise("0"), h["sequence"], (h["start_pos"] + 1).cast("string"), mapq_for_sam(h).cast("string"),
        cg.to_sam(F.when(back, F.reverse(h["cigar"])).otherwise(h["cigar"])), F.lit("*\t0\t0"), F.when(back, reverse_complement(seq)).otherwise(seq), quality_text(F.when(back, F.reverse(q)).otherwise(q)),
        F.when(h["score"].isNotNull(), F.concat(F.lit("UQ:i:"), h["score"].cast("string"))), F.when(F.col("xd") > 0, F.concat(F.lit("XD:i:"), F.col("xd").cast("string"))),
    )
    unmapped = F.concat_ws("\t", r["seqid"], F.lit("4\t*\t0\t0\t*\t*\t0\t0"), seq, quality_text(q), F.when(F.col("xd") > 0, F.concat(F.lit("XD:i:"), F.col("xd").cast("string"))))
    ok = h.isNull() | (F.coalesce(cg.query_length(h["cigar"]), F.lit(0)) == F.length(seq))
    return d.where(ok).select(F.when(h.isNull(), unmapped).otherwise(mapped).alias("value"))


def sam_header(contigs: Sequence[tuple[str, int]] = (), sorted_by: str = "unknown") -> list[str]:
    return [f"@HD\tVN:1.0\tSO:{sorted_by}", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in contigs)]


def fasta_alignment_lines(df: DataFrame, genomes: Sequence[str] = ()) -> DataFrame:
    """value: the textual alignment of the hit to the genomes, or the best, as a pair of FastA entries."""
    h = hit_to(F.col("hit"), genomes)
    d = df.select("read", h.alias("h")).where("h.aln_ref is not null and h.aln_qry is not null")
    last = F.col("h.start_pos") + F.abs("h.aln_length") - 1
    top = F.concat(F.lit(">"), "h.sequence", F.lit(" "), F.col("h.start_pos").cast("string"), F.when(F.col("h.aln_length") > 0, "+").otherwise("-"), last.cast("string"))
    low = F.concat(F.lit(">"), "read.seqid", F.when(F.col("read.trim_right").isNotNull(), " adapter cut off").otherwise(""))
    return d.select(F.concat_ws("\n", top, "h.aln_ref", low, "h.aln_qry").alias("value"))


def fastq_lines(df: DataFrame, with_quality: bool = True, missing: str = "skip") -> DataFrame:
    """value: FastQ entries, or FastA ones without qualities, in lines of 50. Reads without quality are left out, or FastA entries if missing is 'fasta'."""
    r = F.col("read")
    d = df.where("read.seqid is not null and read.sequence is not null")
    if missing == "skip":
        d = d.where("read.quality is not null")
    q = r["quality"].isNotNull() & F.lit(with_quality)
    head = F.concat(F.when(q, "@").otherwise(">"), F.concat_ws(" ", r["seqid"], r["description"]))
    entry = F.concat_ws("\n", head, _wrapped(r["sequence"]), F.when(q, F.concat_ws("\n", F.lit("+"), _wrapped(quality_text(r["quality"])))))
    return d.select(entry.alias("value"))


def table_lines(df: DataFrame, genomes: Sequence[str] = ()) -> DataFrame:
    """length, score, map_quality (9999 for unique) of each record with a hit to the genomes, or any: score of that hit."""
    h = hit_to(F.col("hit"), genomes)
    return df.select(effective_length(F.col("read")).alias("length"), h.alias("h")).where("h is not null").select("length", F.coalesce("h.score", F.lit(0)).alias("score"), F.coalesce("h.map_quality", F.lit(9999)).alias("map_quality"))


def wiggle_lines(df: DataFrame) -> DataFrame:
    """value: fixedStep sections with the depth of each reference position of contigs with a forward hit. Starts are 1-based."""
    h = best_hit(F.col("hit"))
    d = df.select("read", h.alias("h")).where("size(read.depth) > 0 and h.aln_length > 0")
    n = cg.reference_span(F.col("h.cigar"))
    head = F.concat(F.lit("fixedStep\tchrom="), "h.sequence", F.lit("\tstart="), (F.col("h.start_pos") + 1).cast("string"), F.lit("\tstep=1"))
    return d.select(F.concat(head, F.lit("\n"), F.array_join(F.slice("read.depth", F.lit(1), n).cast("array<string>"), "\n"), F.lit("\n")).alias("value"))


def _quoted(c: Column) -> Column:
    esc = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')
    for raw, shown in (("\r", "\\\\r"), ("\n", "\\\\n"), ("\t", "\\\\t")):
        esc = F.regexp_replace(esc, raw, shown)
    return F.concat(F.lit('"'), esc, F.lit('"'))


def _field(pad: str, name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{pad}{name}: "), value.cast("string")))


def _array(pad: str, name: str, value: Column) -> Column:
    return F.when(F.size(value) > 0, F.concat(F.lit(f"{pad}{name}: "), F.array_join(value.cast("array<string>"), ",")))


def _alignment(h: Column, pad: str) -> Column:
    n = F.length(h["aln_ref"])
    same = F.array_join(F.zip_with(F.split(h["aln_ref"], ""), F.split(h["aln_qry"], ""), lambda a, b: F.when(a == b, "*").otherwise(" ")), "")
    part = lambda name, text, i: F.concat(F.lit(f"{pad}{name}: "), F.substr(text, i * WRAP + 1, F.lit(WRAP)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(n / WRAP) - 1)).cast("int")), lambda i: F.concat_ws("\n", F.lit(""), part("REF", h["aln_ref"], i), part("QRY", h["aln_qry"], i), part("CNS", same, i)))
    return F.when((n > 0) & (n == F.length(h["aln_qry"])), F.array_join(blocks, "\n"))


def text_lines(df: DataFrame) -> DataFrame:
    """value: records for people, with cigars and qualities as text, lists in one line, and alignments in blocks of 50 columns."""
    r = F.col("read")
    seen = [_array("    ", f"seen_bases_{b}", F.filter(r["seen_bases"], _every(i))) for i, b in enumerate("ACGT")]
    scores = F.when(r["quality"].isNotNull(), F.concat(F.lit("    quality:  "), _quoted(quality_text(r["quality"]))))
    read = F.concat_ws(
        "\n", F.lit("  read {"), *[_field("    ", c, _quoted(r[c])) for c in ("seqid", "description", "sequence")], scores, *seen, _array("    ", "depth", r["depth"]), *[_field("    ", c, r[c]) for c in ("trim_left", "trim_right")], F.lit("  }")
    )

    def hit(h: Column) -> Column:
        return F.concat_ws(
            "\n", F.lit("  hit {"), *[_field("    ", c, _quoted(h[c])) for c in ("genome_name", "sequence")], *[_field("    ", c, h[c]) for c in ("start_pos", "aln_length", "score", "evalue")],
            F.when(F.size(h["cigar"]) > 0, F.concat(F.lit("    cigar: "), cg.to_text(h["cigar"]))), *[_field("    ", c, h[c]) for c in ("map_quality", "taxid")], _alignment(h, "    "), F.lit("  }"),
        )

    hits = F.when(F.size("hit") > 0, F.array_join(F.transform("hit", hit), "\n"))
    return df.select(F.concat_ws("\n", F.lit("Result {"), read, hits, _field("  ", "nmembers", F.nullif(F.col("nmembers"), F.lit(0))), F.lit("}\n\n")).alias("value"))


def _every(k: int):
    return lambda x, i: i % 4 == k


def site_lines(observed: DataFrame, label: str) -> tuple[list[str], DataFrame]:
    """Header and value lines of an observed site table."""
    head = [f"#site\t{label}_BaseH\t{label}_QualH\t{label}_BaseC\t{label}_QualC"]
    half = lambda s: [F.coalesce(F.col(f"{s}_{c}").cast("string"), F.lit("")) for c in ("base", "chrom", "strand", "pos")]
    seen = lambda s: [F.coalesce(f"{s}_bases", F.lit("")), F.coalesce(F.array_join(F.col(f"{s}_quals").cast("array<string>"), ","), F.lit(""))]
    return head, observed.select(F.concat_ws("\t", *half("h"), *half("c"), F.coalesce("out_base", F.lit("")), F.coalesce("flags", F.lit("")), *seen("h"), *seen("c")).alias("value"))


def write_lines(lines: DataFrame, path: str, header: Sequence[str] = (), compression: str = "none") -> None:
    """Lines as text files of a folder; header lines come first, in the first file."""
    if header:
        first = lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        lines = first.unionAll(lines.select("value"))
    lines.write.mode("overwrite").option("compression", compression).text(path)


def write_records(df: DataFrame, path: str, level: int = 50) -> None:
    """Records in the engine's own store, Parquet; the level of older stores picks the codec."""
    codec = "none" if level < 10 else "snappy" if level < 50 else "zstd"
    df.write.mode("overwrite").option("compression", codec).parquet(path)
