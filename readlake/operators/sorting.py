"""Sorts by coordinate and by name, and a greedy partition of chromosomes."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.hits import best_hit, hit_to

Op = Callable[[DataFrame], DataFrame]


def coordinate_keys(genomes: Sequence[str] = ()) -> list:
    """Sort columns: sequence, start and length of the hit to each genome in turn, or genome and these of the best hit; missing last."""
    hits = [hit_to(F.col("hit"), [g]) for g in genomes] or [best_hit(F.col("hit"))]
    names = ["sequence", "start_pos", "aln_length"] if genomes else ["genome_name", "sequence", "start_pos", "aln_length"]
    return [h[n].asc_nulls_last() for h in hits for n in names]


def sort_by_position(genomes: Sequence[str] = (), within: bool = False) -> Op:
    """Records by coordinate, equal ones by seqid; within sorts inside partitions only, for keyed consumers."""

    def op(df: DataFrame) -> DataFrame:
        keys = [*coordinate_keys(genomes), F.col("read.seqid").asc_nulls_last()]
        return df.sortWithinPartitions(*keys) if within else df.orderBy(*keys)

    return op


def sort_by_name(within: bool = False) -> Op:
    """Records by seqid, bytewise."""
    return lambda df: (df.sortWithinPartitions if within else df.orderBy)(F.col("read.seqid").asc_nulls_last())


def sort_and_merge(genomes: Sequence[str] | None = None) -> Op:
    """A sort that also merges records of one seqid, as the external sort of streams does. genomes None sorts by name."""
    from readlake.operators.combine import merge_same_reads

    return lambda df: (sort_by_name() if genomes is None else sort_by_position(genomes))(merge_same_reads(df))


def pack_bins(sizes: dict[str, int], n: int) -> list[list[str]]:
    """Names in n bins of about equal size: the largest first, each into the emptiest bin."""
    heap = [(0, i) for i in range(n)]
    out: list[list[str]] = [[] for _ in range(n)]
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        total, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (total + size, i))
    return out
