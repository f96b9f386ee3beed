"""Site tables of two genomes against contigs: what the reads show at each site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.seq import reverse_complement


def observe_sites(sites: DataFrame, cols: DataFrame, buffer: int = 5, least: int = 1, most: int = 127) -> DataFrame:
    """sites (site_id, chrom, pos, strand, end for stretches) with bases, quals, unseen, gap_near, edge_near of one genome.

    cols are contig columns (genome_name, sequence, contig_start, contig_end, pos, ord, call, quality, depth) of that genome. Bases of the site are those at
    pos <= position < end (end: pos + 1 without one), inserts at the right edge included, in order; a site on the reverse strand shows the
    reverse complement. gap_near: an insert or deletion within buffer; edge_near: a contig end within buffer. unseen: no column, or a depth
    outside [least, most]. The band join is an equi-join: each column is sent to the positions within buffer of it (bounded by 2 * buffer + 1),
    a site to its own positions, which a grouped aggregate then combines.
    """
    s = sites.select("site_id", "chrom", "pos", "strand", F.coalesce("end", F.col("pos") + 1).alias("stop"))
    # positions of a site and its surroundings; a site is short
    wide = s.withColumn("at", F.explode(F.sequence(F.col("pos") - buffer, F.col("stop") + buffer - 1)))
    c = cols.select(F.col("sequence").alias("chrom"), F.col("pos").alias("at"), "ord", "call", F.col("quality").alias("q"), "depth", "contig_start", "contig_end")
    j = wide.join(c, ["chrom", "at"], "left")
    inside = F.col("at").between(F.col("pos"), F.col("stop") - 1) | ((F.col("ord") > 0) & (F.col("at") == F.col("pos") - 1) & (F.col("stop") == F.col("pos")))
    shown = F.when(inside & (F.col("call") != "-"), F.struct("at", "ord", "call", "q"))
    gap = (F.col("ord") > 0) | (F.col("call") == "-")
    edge = (F.col("at") == F.col("contig_start")) | (F.col("at") == F.col("contig_end") - 1)
    bad = inside & (F.col("ord") == 0) & ~F.col("depth").between(least, most)
    g = j.groupBy("site_id").agg(
        F.first("strand").alias("strand"),
        F.array_sort(F.collect_list(shown)).alias("cs"),
        F.coalesce(F.bool_or(gap), F.lit(False)).alias("gap_near"),
        F.coalesce(F.bool_or(edge), F.lit(False)).alias("edge_near"),
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"),
        F.count(F.when(inside & F.col("call").isNotNull(), 1)).alias("n"),
    )
    text = F.array_join("cs.call", "")
    back = F.col("strand") == "-"
    return sites.join(
        g.select(
            "site_id",
            F.when(back, reverse_complement(text)).otherwise(text).alias("bases"),
            F.when(back, F.reverse("cs.q")).otherwise(F.col("cs.q")).alias("quals"),
            ((F.col("n") == 0) | F.col("bad")).alias("unseen"),
            "gap_near",
            "edge_near",
        ),
        "site_id",
        "left",
    )


def observe_both(sites: DataFrame, first: DataFrame, second: DataFrame, **how) -> DataFrame:
    """Site tables with coordinates of two genomes (h_chrom, h_pos, h_strand, h_end; c_...) observed in the contigs of each, with flags: US unseen, GN
    gap near, EC edge near, per genome."""
    out = sites
    for side, cols in (("c", second), ("h", first)):
        s = sites.select("site_id", *[F.col(f"{side}_{x}").alias(x) for x in ("chrom", "pos", "strand", "end")])
        o = observe_sites(s, cols, **how).select("site_id", *[F.col(x).alias(f"{side}_{x}") for x in ("bases", "quals", "unseen", "gap_near", "edge_near")])
        out = out.join(o, "site_id", "left")
    flag = lambda name, c: F.when(F.col(c), F.lit(name))
    flags = F.concat_ws(",", *[flag(f"{side.upper()}{n}", f"{side}_{c}") for side in "hc" for n, c in (("US", "unseen"), ("GN", "gap_near"), ("EC", "edge_near"))])
    return out.withColumn("flags", flags)
