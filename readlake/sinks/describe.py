"""What a file holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

from readlake.mapping.align import Aligner
from readlake.sources.files import listing
from readlake.sources.reader import sniff


def describe(spark: SparkSession, path: str) -> dict:
    """Kind, files and bytes of a path; columns and rows of stored tables."""
    found = listing(path)
    out: dict = {"path": path, "kind": sniff(path), "files": len(found), "bytes": sum(n for _, n in found)}
    if out["kind"] == "parquet":
        d = spark.read.parquet(path)
        out |= {"columns": d.columns, "rows": d.count()}
    return out


def substitution_table(aligner: Aligner, single_stranded: bool = False) -> list[list[float]]:
    """Phred penalties of read bases A, C, G, T (columns) for reference bases A, C, G, T (rows)."""
    import numpy as np

    m = aligner.matrices()[int(single_stranded)]
    order = [0, 1, 3, 2]
    return (-10 * np.log10(m[[1, 2, 8, 4]][:, order])).round(2).tolist()
