"""Import of older binary stores: length-delimited messages, plain or in compressed chunks. One task per file; Parquet is the engine's own store."""

from __future__ import annotations

import bz2
import math
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readlake.schema import REASONS, RESULT, sanitize
from readlake.sources.files import listing, open_plain

#: Fields of each message: number -> (name, kind); s signed (zigzag), u unsigned, i plain signed, f float, t text, b bytes, p packed, a nested
#: message name in brackets. Fixed values.
READ = {1: ("seqid", "t"), 13: ("description", "t"), 2: ("sequence", "t"), 14: ("quality", "b"), 15: ("likelihoods", "b*"), 16: ("seen_bases", "u*"), 17: ("depth", "u*"), 11: ("trim_left", "u"), 12: ("trim_right", "u")}
HIT = {
    1: ("genome_name", "t"), 2: ("sequence", "t"), 3: ("start_pos", "u"), 4: ("aln_length", "s"), 5: ("score", "s"), 6: ("evalue", "f"), 7: ("cigar", "u*"), 8: ("map_quality", "s"),
    9: ("diff_to_next_chromosome", "s"), 10: ("diff_to_next_chromosome_class", "s"), 15: ("taxid", "i"), 14: ("taxid_species", "i"), 13: ("taxid_order", "i"), 101: ("aln_ref", "t"), 102: ("aln_qry", "t"),
}
STATS = {
    1: ("reason", "u"), 2: ("num_raw_seeds", "u"), 3: ("num_grown_seeds", "u"), 4: ("num_clumps", "u"), 5: ("num_useless", "u"), 6: ("open_nodes_after_alignment", "u"),
    7: ("closed_nodes_after_alignment", "u"), 8: ("tracked_closed_nodes_after_alignment", "u"), 15: ("tag", "t"),
}
SEEDS = {1: ("genome_name", "t"), 2: ("ref_positions", "u*"), 3: ("query_positions", "i*"), 4: ("seed_sizes", "u*"), 5: ("max_mismatches", "u"), 6: ("min_seed_length", "u")}
RECORD = {
    1: ("read", READ), 2: ("members", [READ]), 9: ("nmembers", "u"), 3: ("hit", [HIT]), 4: ("aln_stats", [STATS]), 5: ("diff_to_next_species", "s"), 6: ("diff_to_next_order", "s"),
    7: ("num_reads", "i"), 8: ("seeds", [SEEDS]),
}
OLD_HIT = {2: ("sequence", "t"), 3: ("start_pos", "u"), 4: ("aln_length", "s"), 5: ("score", "s"), 6: ("evalue", "f"), 7: ("cigar", "b"), 8: ("genome_name", "t"), 16: ("taxid", "i"), 17: ("taxid_species", "i"), 18: ("taxid_order", "i")}
OLD_RECORD = {
    1: ("seqid", "t"), 13: ("description", "t"), 14: ("quality", "b"), 2: ("sequence", "t"), 11: ("trim_left", "u"), 12: ("trim_right", "u"), 10: ("reason", "u"), 16: ("num_raw_seeds", "u"), 17: ("num_grown_seeds", "u"),
    18: ("num_clumps", "u"), 22: ("num_useless", "u"), 19: ("open_nodes_after_alignment", "u"), 20: ("closed_nodes_after_alignment", "u"), 21: ("tracked_closed_nodes_after_alignment", "u"), 3: ("best_hit", OLD_HIT),
    4: ("diff_to_next_species", "s"), 5: ("diff_to_next_order", "s"), 6: ("best_to_genome", OLD_HIT), 7: ("diff_to_next", "s"), 8: ("diff_to_next_chromosome", "s"), 9: ("diff_to_next_chromosome_class", "s"), 23: ("members", [READ]),
}
OPS = {0: "M", 1: "I", 2: "D", 3: "N", 4: "S", 5: "H", 6: "P", 15: "X"}


def varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, i
        shift += 7


def _whole(n: int, kind: str) -> int:
    if kind == "s":
        return n >> 1 ^ -(n & 1)
    return n - (1 << 64) if kind == "i" and n >> 63 else n


def message(b: bytes, spec: dict) -> dict:
    """The known fields of a message; unknown ones are skipped."""
    out: dict = {name: [] for name, k in spec.values() if isinstance(k, list) or (isinstance(k, str) and k.endswith("*"))}
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        name, kind = spec.get(key >> 3, (None, ""))
        wire = key & 7
        if wire == 0:
            n, i = varint(b, i)
            if name:
                v = _whole(n, kind[0])
                out[name].append(v) if kind.endswith("*") else out.__setitem__(name, v)
        elif wire == 2:
            n, i = varint(b, i)
            part = b[i : i + n]
            i += n
            if name is None:
                continue
            if isinstance(kind, dict):
                out[name] = message(part, kind)
            elif isinstance(kind, list):
                out[name].append(message(part, kind[0]))
            elif kind == "b*":
                out[name].append(list(part))
            elif kind.endswith("*"):
                j = 0
                while j < len(part):
                    v, j = varint(part, j)
                    out[name].append(_whole(v, kind[0]))
            else:
                out[name] = part.decode("latin-1") if kind == "t" else list(part)
        elif wire == 5:
            if name:
                out[name] = struct.unpack_from("<f", b, i)[0]
            i += 4
        elif wire == 1:
            i += 8
        else:
            raise ValueError("broken message")
    return out


def unpack_lz(b: bytes, size: int) -> bytes:
    """The byte-oriented Lempel-Ziv code of level 1 and 2: literal runs, and matches with 13-bit distances."""
    out = bytearray()
    level, i = (b[0] >> 5) + 1, 0
    first = True
    while i < len(b):
        c = b[i] & 31 if first else b[i]
        first = False
        i += 1
        if c < 32:
            out += b[i : i + c + 1]
            i += c + 1
            continue
        n, dist = (c >> 5) - 1, (c & 31) << 8
        if n == 6:
            while True:
                n += b[i]
                i += 1
                if level == 1 or b[i - 1] != 255:
                    break
        near = b[i]
        i += 1
        dist += near
        if level == 2 and near == 255 and dist == (31 << 8) + 255:
            dist = (b[i] << 8) + b[i + 1] + 8191
            i += 2
        at = len(out) - dist - 1
        for k in range(n + 3):
            out.append(out[at + k])
    if len(out) != size:
        raise ValueError("broken chunk")
    return bytes(out)


def chunks(f: BinaryIO) -> Iterator[bytes]:
    """Contents of the chunks after the magic number: none, byte-oriented, deflated or bzip2 by the top bits of their size."""
    while len(head := f.read(8)) == 8:
        size, packed = struct.unpack("<II", head)
        kind, packed = packed >> 28, packed & 0xFFFFFFF
        b = f.read(packed)
        if len(b) < packed:
            return
        yield (lambda: b, lambda: unpack_lz(b, size), lambda: zlib.decompress(b), lambda: bz2.decompress(b))[kind]()


def layout(head: bytes) -> str | None:
    """How a store is laid out, told by what follows its four letters: 'plain' if that is a header message (number 1) and then a record or footer (2, 3 or 4),
    'chunks' if it is the sizes of a chunk of known compression; None for anything else."""
    if len(head) < 12 or not head[:4].isalnum() or not head[:4].isupper():
        return None
    size, packed = struct.unpack_from("<II", head, 4)
    if packed >> 28 <= 3 and 0 < size < 1 << 28 and 0 < packed & 0xFFFFFFF <= 2 * size + 1024:
        return "chunks"
    if head[4] == 10:
        try:
            n, i = varint(head, 5)
        except IndexError:
            return None
        if head[i + n] in (18, 26, 34) if i + n < len(head) else len(head) >= 4096:
            return "plain"
    return None


def _plain(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(number, message) of messages that follow each other, one at a time."""

    def number() -> int | None:
        x = shift = 0
        while b := f.read(1):
            x |= (b[0] & 127) << shift
            if b[0] < 128:
                return x
            shift += 7
        if shift:
            raise ValueError("store ends within a record")
        return None

    while (key := number()) is not None:
        n = number()
        b = f.read(n or 0)
        if n is None or len(b) != n:
            raise ValueError("store ends within a record")
        yield key >> 3, b
        if key >> 3 == 3:
            return


def messages(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(number, message) of a store of either layout."""
    head = f.read(4096)
    kind = layout(head)
    if kind is None:
        raise ValueError("no store of records")
    f.seek(4)
    if kind == "plain":
        yield from _plain(f)
        return
    for b in chunks(f):
        i = 0
        while i < len(b):
            key, i = varint(b, i)
            n, i = varint(b, i)
            yield key >> 3, b[i : i + n]
            i += n
            if key >> 3 == 3:
                return


def _hit(h: dict) -> dict:
    return h | {"cigar": [{"op": OPS.get(c & 15), "len": c >> 4} for c in h.get("cigar", [])]}


def _stats(s: dict) -> dict:
    return s | {"reason": REASONS[s["reason"]] if s.get("reason", 99) < len(REASONS) else None}


def _seeds(s: dict) -> dict:
    z = zip(s["ref_positions"], s["query_positions"], s["seed_sizes"], strict=True)
    return {k: s.get(k) for k in ("genome_name", "max_mismatches", "min_seed_length")} | {"seeds": [{"ref_pos": a, "query_pos": b, "size": c} for a, b, c in z]}


def _old_hit(h: dict) -> dict:
    runs: list[dict] = []
    for c in h.get("cigar", []):
        op, n = ("M", c) if c < 128 else ("I", c - 128) if c < 192 else ("D", c - 192)
        runs.append({"op": op, "len": n})
    return h | {"cigar": runs, "score": math.floor(h.get("score", 0) / math.log(10) + 0.5), "genome_name": h.get("genome_name", "")}


def record(number: int, b: bytes) -> dict | None:
    """A record of a current (4) or old (2) message, in the engine's shape; None for other messages."""
    if number == 4:
        r = message(b, RECORD)
        return r | {"hit": [_hit(h) for h in r["hit"]], "aln_stats": [_stats(s) for s in r["aln_stats"]], "seeds": [_seeds(s) for s in r["seeds"]], "nmembers": r.get("nmembers", 0)}
    if number == 2:
        o = message(b, OLD_RECORD)
        hits = [_old_hit(o["best_hit"])] if "best_hit" in o else []
        if "best_to_genome" in o:
            extra = {"map_quality": o.get("diff_to_next")} | {k: o.get(k) for k in ("diff_to_next_chromosome", "diff_to_next_chromosome_class")}
            hits.append(_old_hit(o["best_to_genome"]) | extra)
        read = {k: o.get(k) for k in ("seqid", "description", "sequence", "quality", "trim_left", "trim_right")}
        stats = _stats({k: o.get(k) for k, _ in STATS.values() if k in o} | {"reason": o.get("reason", 0)})
        return {"read": read, "members": o["members"], "nmembers": 0, "hit": hits, "aln_stats": [stats], "seeds": [], "diff_to_next_species": o.get("diff_to_next_species"), "diff_to_next_order": o.get("diff_to_next_order")}
    return None


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """Records of older stores, in clean form."""
    names = spark.createDataFrame([(p,) for p, _ in listing(path)], "path string")

    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                rows: list[dict] = []
                with open_plain(p) as f:
                    for number, m in messages(f):
                        if r := record(number, m):
                            rows.append(r)
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sanitize(names.repartition(max(1, min(len(listing(path)), 1000)), F.col("path")).mapInArrow(run, RESULT))
