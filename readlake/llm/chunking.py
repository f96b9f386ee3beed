"""Problem 5: items above a size limit cut into overlapping pieces at natural boundaries.

Agglomerative merging: an item starts as its atomic segments (stretches between natural boundaries), adjacent pairs wait in a heap, and the
pair at the weakest boundary is merged first while the combined size, with the overlap that the piece will be given in front, fits.
Contig ends are equally natural, so ties decide, and the leftmost boundary goes first; merging is then final from left to right,
which lets a long item stream through one task in windows of a few limits.

Shuffles: contigs by (genome, offset) to drop redelivered ones, by block of the genome to look up the next offset, per sequence for its
ends. The distinct ends of a sequence stream sorted through one task; that task holds one window, never the sequence.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators.blocked import with_neighbour
from readlake.session import clean_genome, clean_sequence

#: Genome positions of one block of the next-offset lookup.
OFFSET_BLOCK = 1 << 26


def agglomerate(bounds: list[int], limit: int, overlap: int, first: bool = True, strength: list[float] | None = None) -> list[int]:
    """Ends of the pieces of [bounds[0], bounds[-1]), whose natural boundaries are bounds (ascending, distinct).

    Every piece but the item's first (first tells whether bounds[0] is the item's start) begins overlap before the previous end.
    Atomic segments that don't fit by themselves are cut where the limit is reached. strength gives the strength of each inner bound
    (default: all equal); the weakest, then leftmost, is merged away first. No bounds, or one, give no piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if first and len(bounds) > 2:  # a piece must outgrow the overlap that the next one takes back
        near = [0 < i < len(bounds) - 1 and b <= bounds[0] + overlap for i, b in enumerate(bounds)]
        strength = [x for x, d in zip(strength, near[1:-1], strict=True) if not d] if strength else None
        bounds = [b for b, d in zip(bounds, near, strict=True) if not d]
    cuts, power = [], []
    for i, b in enumerate(bounds):
        if i:
            reach = cuts[-1] + limit - (0 if first and len(cuts) == 1 else overlap)
            while b > reach:  # oversized: hard cuts, which nothing can merge across
                cuts.append(reach)
                power.append(float("inf"))
                reach += limit - overlap
        cuts.append(b)
        power.append(strength[i - 1] if strength and 0 < i < len(bounds) - 1 else 0.0)
    n = len(cuts) - 1
    if n < 1:
        return []
    left, right = list(range(-1, n)), list(range(1, n + 2))  # neighbours of each kept cut
    heap = [(power[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    kept = [True] * (n + 1)
    while heap:
        _, i = heapq.heappop(heap)
        a, b = left[i], right[i]
        if cuts[b] - cuts[a] + (0 if first and a == 0 else overlap) <= limit:
            kept[i] = False
            right[a], left[b] = b, a
    return [c for c, k in zip(cuts[1:], kept[1:], strict=True) if k]


class Cutter:
    """Pieces of one item from its sorted ends, window by window."""

    def __init__(self, start: int, limit: int, overlap: int) -> None:
        self.bounds, self.limit, self.overlap, self.first = [start], limit, overlap, True

    def feed(self, ends: Iterable[int], last: bool) -> Iterator[tuple[int, int]]:
        for e in ends:
            if e > self.bounds[-1]:
                self.bounds.append(e)
                if e - self.bounds[0] > 4 * self.limit:
                    yield from self._flush(False)
        if last:
            yield from self._flush(True)

    def _flush(self, last: bool) -> Iterator[tuple[int, int]]:
        ends = agglomerate(self.bounds, self.limit, self.overlap, self.first)
        keep = ends if last else ends[:-1]  # the last piece may still grow
        for e in keep:
            yield self.bounds[0] - (0 if self.first else self.overlap), e
            self.bounds = [e, *(b for b in self.bounds if b > e)] if e == keep[-1] else [e, *self.bounds[1:]]
            self.first = False


def filled_contigs(contigs: DataFrame, genomes: DataFrame) -> DataFrame:
    """genome_name, name, range_start, range_end of each contig once, names in clean form, a missing range end filled from the offsets.

    A contig's length is the genome's next offset, or its total_size, less the contig's own offset and one. Rows delivered twice (same
    genome and offset) count once. Rows with a null genome, name or offset keep the ends they have; rows without genome or name are
    left out; an end that can't be told stays null.
    """
    c = contigs.select(
        clean_genome("genome_name").alias("genome_name"), clean_sequence("name").alias("name"), F.col("offset"), F.col("range_start"), F.col("range_end")
    ).where("genome_name is not null and name is not null")
    once = c.where("offset is not null").groupBy("genome_name", "offset").agg(*[F.max(x).alias(x) for x in ("name", "range_start", "range_end")])
    nxt = with_neighbour(once, ["genome_name"], F.shiftright("offset", 26), [F.col("offset")], F.struct("offset"), "next", forward=True)
    sizes = genomes.groupBy(clean_genome("name").alias("g")).agg(F.max("total_size").alias("total_size"))
    j = nxt.join(sizes, F.col("genome_name") == F.col("g"), "left")
    length = F.coalesce("next.offset", "total_size") - F.col("offset") - 1
    full = j.select(
        "genome_name",
        "name",
        F.coalesce("range_start", F.col("range_end") - length).alias("range_start"),
        F.coalesce("range_end", F.col("range_start") + length).alias("range_end"),
    )
    return full.unionByName(c.where("offset is null").select("genome_name", "name", "range_start", "range_end"))


def _cut(limit: int, overlap: int):
    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out = pa.schema([("genome_name", pa.string()), ("name", pa.string()), ("piece_start", pa.int64()), ("piece_end", pa.int64())])
        key, cutter = None, None

        def rows(k, pieces):
            p = list(pieces)
            if p:
                yield pa.RecordBatch.from_arrays([pa.array([k[0]] * len(p)), pa.array([k[1]] * len(p)), pa.array([a for a, _ in p], pa.int64()), pa.array([b for _, b in p], pa.int64())], schema=out)

        for b in batches:
            g, n = b.column("genome_name").to_pylist(), b.column("name").to_pylist()
            lo, end = (np.asarray(b.column(x)) for x in ("lo", "end"))
            i = 0
            while i < b.num_rows:
                j = i
                while j < b.num_rows and g[j] == g[i] and n[j] == n[i]:
                    j += 1
                if key != (g[i], n[i]):
                    if cutter:
                        yield from rows(key, cutter.feed((), True))
                    key, cutter = (g[i], n[i]), Cutter(int(lo[i]), limit, overlap)
                yield from rows(key, cutter.feed(end[i:j].tolist(), False))
                i = j
        if cutter:
            yield from rows(key, cutter.feed((), True))

    return run


def sequence_pieces(contigs: DataFrame, genomes: DataFrame, limit: int = 5_000_000, overlap: int = 50_000) -> DataFrame:
    """genome_name, name, piece_start, piece_end: the pieces of every sequence that measures more than limit.

    A sequence runs from its smallest range_start to its largest range_end. Each piece but the last ends at the last contig end within
    the limit, or at the limit where no contig ends; the next piece starts overlap before. Shorter sequences, and sequences without a
    start or an end, have no row; repeated contigs change nothing; empty tables give an empty result.
    """
    c = filled_contigs(contigs, genomes)
    keys = ["genome_name", "name"]
    long_ = c.groupBy(*keys).agg(F.min("range_start").alias("lo"), F.max("range_end").alias("hi")).where(F.col("hi") - F.col("lo") > limit)
    ends = c.where("range_end is not null").select(*keys, F.col("range_end").alias("end")).distinct()
    j = ends.join(long_.select(*keys, "lo"), keys).select(*keys, "lo", "end")
    ordered = j.repartition(*keys).sortWithinPartitions(*keys, "end")
    return ordered.mapInArrow(_cut(limit, overlap), "genome_name string, name string, piece_start bigint, piece_end bigint")
