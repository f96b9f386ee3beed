"""Divergence by triangulation of three aligned sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions.hits import hit_to

BASES = ("A", "C", "G", "T")
#: (primary, query, secondary) triples that deamination confounds in ancient reads. Fixed values.
CONFOUNDED = ("CTT", "TTC", "GAA", "AAG")


def _columns(aln_ref: Column, aln_qry: Column, chop: int) -> Column:
    """The reference letter at each read base, without chop read bases at either end; read gaps are left out."""
    pairs = F.filter(F.arrays_zip(F.split(F.upper(aln_ref), "").alias("r"), F.split(F.upper(aln_qry), "").alias("q")), lambda x: x["q"] != "-")
    return F.slice(pairs, chop + 1, F.greatest(F.lit(0), F.size(pairs) - 2 * chop))


def divergence_counts(primary: str, secondary: str, chop: int = 0, ancient: bool = False) -> Callable[[DataFrame], DataFrame]:
    """One row b1..b5: columns where primary, secondary and query are all equal; query like primary; both references alike; query like secondary;
    all different. Only columns of three bases count; records need textual alignments to both genomes with as many read bases. Row-local:
    the columns are zipped, classified and counted within the record, then summed."""

    def op(df: DataFrame) -> DataFrame:
        p, s = hit_to(F.col("hit"), [primary]), hit_to(F.col("hit"), [secondary])
        d = df.select(_columns(p["aln_ref"], p["aln_qry"], chop).alias("p"), _columns(s["aln_ref"], s["aln_qry"], chop).alias("s")).where(F.size("p") == F.size("s"))
        z = F.zip_with("p", "s", lambda a, b: F.struct(a["r"].alias("p"), b["r"].alias("s"), a["q"].alias("q")))
        ok = F.filter(z, lambda x: x["p"].isin(*BASES) & x["s"].isin(*BASES) & x["q"].isin(*BASES))
        if ancient:
            ok = F.filter(ok, lambda x: ~F.concat(x["p"], x["q"], x["s"]).isin(*CONFOUNDED))
        d = d.select(ok.alias("c"))
        tests = [
            lambda x: (x["p"] == x["s"]) & (x["p"] == x["q"]),
            lambda x: (x["q"] == x["p"]) & (x["p"] != x["s"]),
            lambda x: (x["p"] == x["s"]) & (x["s"] != x["q"]),
            lambda x: (x["q"] == x["s"]) & (x["s"] != x["p"]),
            lambda x: (x["p"] != x["s"]) & (x["p"] != x["q"]) & (x["s"] != x["q"]),
        ]
        return d.agg(*[F.coalesce(F.sum(F.size(F.filter("c", t))), F.lit(0)).alias(f"b{i + 1}") for i, t in enumerate(tests)])

    return op


def divergence(counts: DataFrame) -> DataFrame:
    """b1..b5 with the error rate, the raw and the corrected divergence; null where a denominator is 0."""
    b = [F.col(f"b{i}").cast("double") for i in range(1, 6)]
    total = 3 * b[0] - b[1] + 3 * b[2] - b[3] - b[4]
    e = 3 * (b[2] - b[3]) / F.nullif(total, F.lit(0.0))
    d = F.nullif(4 * e - 3, F.lit(0.0))
    a1 = ((e - 3) * b[1] + e * b[3] + e * b[4]) / d
    a3 = (e * b[1] + (e - 3) * b[3] + e * b[4]) / d
    ratio = lambda x, y: F.round(2 * x / F.nullif(x + y, F.lit(0.0)), 9)
    return counts.select("*", F.round(e, 9).alias("error_rate"), ratio(b[3], b[1]).alias("raw_divergence"), ratio(a3, a1).alias("corrected_divergence"))
