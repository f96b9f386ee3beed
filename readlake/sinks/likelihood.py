"""Binary genotype likelihoods, format GLF 0.9."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.hits import best_hit
from readlake.operators.transforms import fetch_bases


def likelihood_rows(contigs: DataFrame, chunks: DataFrame, key: str = "read_id") -> DataFrame:
    """seqid, blob of each contig record that has ten likelihoods and a hit: name, length and twelve bytes and a word a base (reference bits, map quality,
    likelihoods; quality and depth)."""
    h = best_hit(F.col("hit"))
    d = contigs.where("size(read.likelihoods) = 10").select(F.struct(F.col(key), F.col("read.seqid")).alias("id__"), "read", h.alias("h")).where("h is not null")
    places = d.select("id__", F.col("h.genome_name").alias("genome_name"), F.col("h.sequence").alias("sequence"), F.col("h.start_pos").alias("start"), (F.col("h.start_pos") + F.abs("h.aln_length")).alias("end"))
    j = d.join(fetch_bases(places, chunks, "id__"), "id__", "left").select(
        F.col("read.seqid").alias("seqid"), F.col("read.likelihoods").alias("lk"), F.col("read.depth").alias("depth"), F.col("read.quality").alias("quality"), F.col("h.cigar").alias("cigar"),
        F.coalesce("h.map_quality", F.lit(254)).alias("mapq"), F.coalesce("bases", F.lit("")).alias("bases"),
    )

    def encode(batches: Iterable) -> Iterator:
        import struct

        import pyarrow as pa

        codes = {c: i for i, c in enumerate("-ACMGRSVTWYHKDBN")}  # bits A, C, G, T
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = r["seqid"].encode()
                size = sum(c["len"] for c in r["cigar"] if c["op"] in "MX=")
                parts = [struct.pack("<i", len(name) + 1), name, b"\0", struct.pack("<i", size)]
                ref = i = 0
                for c in r["cigar"]:
                    for _ in range(c["len"]):
                        if c["op"] in "MX=":
                            letter = r["bases"][ref : ref + 1].upper() or "N"
                            parts.append(bytes([codes.get(letter, 15), min(255, r["mapq"]), *(lk[i] for lk in r["lk"])]) + struct.pack("<I", r["depth"][ref] << 8 | min(255, r["quality"][i])))
                        ref += c["op"] in "MX=D"
                        i += c["op"] in "MX=IS"
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("seqid"), pa.array(out, pa.binary())], names=["seqid", "blob"])

    return j.mapInArrow(encode, "seqid string, blob binary")


def write_likelihoods(rows: DataFrame, path: str, name: str = "likelihoods") -> None:
    """One deflated file per partition in a folder that all executors share."""
    import os

    os.makedirs(path, exist_ok=True)

    def write(part: Iterable) -> None:
        import gzip
        import uuid

        first = next(iter_ := iter(part), None)
        if first is None:
            return
        with gzip.open(f"{path}/{name}-{uuid.uuid4().hex}.glz", "wb") as f:
            f.write(b"GLF\1")
            f.write(bytes(first["blob"]))
            for r in iter_:
                f.write(bytes(r["blob"]))

    rows.foreachPartition(write)
