"""Liftover chains: nested blocks of two genomes, and the agreement of hits with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.hits import hit_to
from readlake.operators.intervals import overlap_pairs


def with_depth(blocks: DataFrame) -> DataFrame:
    """Blocks (block_id, t_chrom, t_start, t_end, ...) with depth: how many other blocks of the same chromosome hold them."""
    b = blocks.select("block_id", "t_chrom", "t_start", F.col("t_end").alias("t_stop"))
    pairs = overlap_pairs(b, b, [("t_chrom", "t_chrom")], ("t_start", "t_stop"), ("t_start", "t_stop"), 1 << 20)
    holds = (F.col("r.t_start") <= F.col("l.t_start")) & (F.col("r.t_stop") >= F.col("l.t_stop")) & (F.col("r.block_id") != F.col("l.block_id"))
    strict = (F.col("r.t_start") < F.col("l.t_start")) | (F.col("r.t_stop") > F.col("l.t_stop")) | (F.col("r.block_id") < F.col("l.block_id"))
    depth = pairs.where(holds & strict).groupBy(F.col("l.block_id").alias("block_id")).agg(F.count(F.lit(1)).alias("depth"))
    return blocks.join(depth, "block_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def agrees_with_chain(left: str, right: str, blocks: DataFrame, key: str = "read_id") -> Callable[[DataFrame], DataFrame]:
    """Records, unique by key, with hits to both genomes that lie in one block: the most specific (deepest, then shortest) block that the left hit
    overlaps must hold the right hit, on its chromosome and with the block's strand between the two.

    blocks: block_id, t_chrom, t_start, t_end, q_chrom, q_start, q_end, strand ('+' or '-'), depth; ranges half open. The left side
    is a binned range join; one block per record is kept by a map-side combined aggregate."""

    def op(df: DataFrame) -> DataFrame:
        a, b = hit_to(F.col("hit"), [left]), hit_to(F.col("hit"), [right])
        h = df.select(
            F.col(key).alias("k__"),
            a["sequence"].alias("ac"), a["start_pos"].alias("as"), (a["start_pos"] + F.abs(a["aln_length"]) - 1).alias("ae"), (a["aln_length"] < 0).alias("ar"),
            b["sequence"].alias("bc"), b["start_pos"].alias("bs"), (b["start_pos"] + F.abs(b["aln_length"])).alias("be"), (b["aln_length"] < 0).alias("br"),
        ).where("ac is not null and bc is not null and ae >= `as`")
        t = blocks.withColumn("t_last", F.col("t_end") - 1)
        pairs = overlap_pairs(h, t, [("ac", "t_chrom")], ("as", "ae"), ("t_start", "t_last"))
        rank = F.struct(F.col("r.depth"), -(F.col("r.t_end") - F.col("r.t_start")), -F.col("r.block_id"), F.col("r").alias("r"), F.col("l").alias("l"))
        best = pairs.groupBy(F.col("l.k__").alias("k__")).agg(F.max(rank).alias("m"))
        same = F.col("m.l.ar") == F.col("m.l.br")
        ok = (
            (F.col("m.l.bc") == F.col("m.r.q_chrom"))
            & (F.col("m.l.bs") < F.col("m.r.q_end"))
            & (F.col("m.l.be") > F.col("m.r.q_start"))
            & (same == (F.col("m.r.strand") == "+"))
        )
        return df.join(best.where(ok).select(F.col("k__").alias(key)), key, "left_semi")

    return op


def invertible(forward: DataFrame, inverse: DataFrame) -> DataFrame:
    """block_id, invertible: whether the inverse blocks hold the same block with both sides exchanged (equal coordinates and strand)."""
    i = inverse.select(
        F.col("t_chrom").alias("q_chrom"), F.col("t_start").alias("q_start"), F.col("t_end").alias("q_end"),
        F.col("q_chrom").alias("t_chrom"), F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"), "strand",
    ).distinct()
    cols = ["t_chrom", "t_start", "t_end", "q_chrom", "q_start", "q_end", "strand"]
    j = forward.join(i.withColumn("there", F.lit(True)), cols, "left")
    return j.select("block_id", F.coalesce("there", F.lit(False)).alias("invertible"))


def blocks_from_lines(lines: DataFrame) -> DataFrame:
    """Blocks of chain files given as rows (file, line_no, value): a header 'chain score tName tSize tStrand tStart tEnd qName qSize qStrand qStart qEnd
    id', then lines 'size [tGap qGap]'.

    Positions are running sums of sizes and gaps within a chain; chains are told apart by the number of headers before. Within a file that is one
    window, as a chain file is read as a whole; several files are independent. Coordinates of a reverse query are turned to its forward strand."""
    f = F.split(F.trim("value"), r"\s+")
    d = lines.withColumn("f", f).where("length(trim(value)) > 0 and not startswith(trim(value), '#')").withColumn("head", F.col("f")[0] == "chain")
    per_file = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("chain", F.sum(F.col("head").cast("int")).over(per_file)).where("chain > 0")
    h = F.last(F.when(F.col("head"), F.col("f")), ignorenulls=True).over(per_file).alias("h")
    num = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    size, tg, qg = num(F.try_element_at("f", F.lit(1))), num(F.try_element_at("f", F.lit(2))), num(F.try_element_at("f", F.lit(3)))
    d = d.select("file", "line_no", "chain", "head", h, size.alias("size"), tg.alias("tg"), qg.alias("qg"))
    before = Window.partitionBy("file", "chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda c: F.coalesce(F.sum(F.when(~F.col("head"), F.col("size") + F.col(c))).over(before), F.lit(0))
    d = d.withColumns({"t": step("tg"), "q": step("qg")}).where("not head and size > 0")
    ts = F.col("h")[5].cast("bigint") + F.col("t")
    qs, qn = F.col("h")[10].cast("bigint") + F.col("q"), F.col("h")[8].cast("bigint")
    back = F.col("h")[9] == "-"
    return d.select(
        F.xxhash64("file", "chain", "line_no").alias("block_id"),
        F.col("h")[2].alias("t_chrom"), ts.alias("t_start"), (ts + F.col("size")).alias("t_end"),
        F.col("h")[7].alias("q_chrom"), F.when(back, qn - qs - F.col("size")).otherwise(qs).alias("q_start"), F.when(back, qn - qs).otherwise(qs + F.col("size")).alias("q_end"),
        F.when(back, "-").otherwise("+").alias("strand"), F.col("h")[1].cast("bigint").alias("score"),
    )
