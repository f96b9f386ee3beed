"""Problem 7: covered periods and gaps of each sequence.

A mergeable aggregate of sorted disjoint intervals. Sequences are cut into blocks of 2^18 positions. Each task first merges its own
rows into one list per (key, block) (the list stays bounded by the block, however many hits pile up), the lists are shuffled to
(key, block, salt), merged linearly, then to (key, block) and merged again: a reduction tree of two levels. What touches a block's
edge is joined across blocks on one or two rows per block; gaps are the complements between neighbours. No task ever holds a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.operators.blocked import with_neighbour
from readlake.session import clean_genome, clean_sequence, durable

BLOCK = 1 << 18
#: Lists of one (key, block) that the first level of the tree spreads over so many tasks.
FAN_IN = 8
#: Intervals that a task holds before it passes its lists on.
HELD = 400_000
_SCHEMA = "genome_name string, sequence string, block bigint, start bigint, end bigint"


def _codes(table) -> tuple:
    """Rows of (genome_name, sequence, block) as one code each, and the distinct keys."""
    import numpy as np

    enc = [table[c].combine_chunks().dictionary_encode() for c in ("genome_name", "sequence")]
    a, b = (np.asarray(e.indices, dtype=np.int64) for e in enc)
    block = np.asarray(table["block"].combine_chunks(), dtype=np.int64)
    return a, b, block, enc


def _merge(table, in_order: bool = False):
    """Disjoint intervals of a table of intervals, per (key, block); touching ones become one. A table that is in_order (its keys
    together, starts ascending) keeps its order of keys; codes of names follow first appearance and don't give that order."""
    import numpy as np
    import pyarrow as pa

    a, b, block, enc = _codes(table)
    start = np.asarray(table["start"].combine_chunks(), dtype=np.int64)
    end = np.asarray(table["end"].combine_chunks(), dtype=np.int64)
    order = np.arange(len(a)) if in_order else np.lexsort((start, block, b, a))
    a, b, block, start, end = a[order], b[order], block[order], start[order], end[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (block[1:] != block[:-1])
    group = np.cumsum(new)
    # positions within the block, lifted by the group, so that one running maximum serves all groups
    lift = group * (2 * BLOCK) - block * BLOCK
    reach = np.maximum.accumulate(end + lift)
    first = new.copy()
    first[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(a)) - 1
    return pa.table(
        {
            "genome_name": enc[0].dictionary.take(pa.array(a[at])),
            "sequence": enc[1].dictionary.take(pa.array(b[at])),
            "block": block[at],
            "start": start[at],
            "end": reach[last] - lift[at],
        }
    )


def _merger() -> Callable[[Iterable], Iterator]:
    held_most = HELD

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        held: list = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                n += b.num_rows
            if n >= held_most:
                t = _merge(pa.concat_tables(held))
                if t.num_rows > held_most // 2:
                    yield from t.to_batches(max_chunksize=100_000)
                    held, n = [], 0
                else:
                    held, n = [t], t.num_rows
        if n:
            yield from _merge(pa.concat_tables(held)).to_batches(max_chunksize=100_000)

    return run


def _sorted_merger() -> Callable[[Iterable], Iterator]:
    def run(batches: Iterable) -> Iterator:
        """Rows come sorted by key, block and start; the last interval waits for what may still join it."""
        import pyarrow as pa

        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = _merge(t if carry is None else pa.concat_tables([carry, t]), in_order=True)
            carry = t.slice(t.num_rows - 1)
            if t.num_rows > 1:
                yield from t.slice(0, t.num_rows - 1).to_batches(max_chunksize=100_000)
        if carry is not None:
            yield from carry.to_batches()

    return run


def covered_blocks(intervals: DataFrame) -> DataFrame:
    """genome_name, sequence, block, start, end: the disjoint intervals within each block. intervals: genome_name, sequence, start, end."""
    cut = intervals.select(
        "genome_name", "sequence", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block")
    ).select(
        "genome_name",
        "sequence",
        F.col("block").cast("bigint").alias("block"),
        F.greatest("start", F.col("block") * BLOCK).cast("bigint").alias("start"),
        F.least("end", (F.col("block") + 1) * BLOCK).cast("bigint").alias("end"),
    )
    key = ["genome_name", "sequence", "block"]
    lists = cut.mapInArrow(_merger(), _SCHEMA)
    salt = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
    level1 = lists.withColumn("salt", salt).repartition(*key, "salt").sortWithinPartitions(*key, "start").drop("salt").mapInArrow(_sorted_merger(), _SCHEMA)
    return level1.repartition(*key).sortWithinPartitions(*key, "start").mapInArrow(_sorted_merger(), _SCHEMA)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """genome_name, sequence, start, end: the maximal covered stretches per genome_name and sequence, touching ones joined.

    intervals has genome_name, sequence, start, end, half open; rows with a null, or with end at or before start, are left out.
    Repeated rows change nothing; an empty table gives none.
    """
    keys = ["genome_name", "sequence"]
    ok = intervals.where("genome_name is not null and sequence is not null and start is not null and end > start")
    lists = durable(covered_blocks(ok))
    touches = F.expr(f"start = block * {BLOCK} or end = (block + 1) * {BLOCK}")
    inner = lists.where(~touches).select(*keys, "start", "end")
    # one or two rows per block of a key
    by = Window.partitionBy(*keys).orderBy("start")
    edges = lists.where(touches).withColumn("new", F.when(F.lag("end").over(by) == F.col("start"), 0).otherwise(1))
    edges = edges.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    return inner.unionByName(joined)


def with_gaps(periods: DataFrame, longest_gap: int) -> DataFrame:
    """genome_name, sequence, kind, range_start, range_end: the periods and the gaps of at most longest_gap between neighbours."""
    keys = ["genome_name", "sequence"]
    p = with_neighbour(periods, keys, F.floor(F.col("start") / (BLOCK * 16)), [F.col("start")], F.struct("start"), "next", forward=True)
    gap = F.when((F.col("next.start") - F.col("end")).between(1, longest_gap), F.struct(F.lit("gap").alias("kind"), F.col("end").alias("range_start"), F.col("next.start").alias("range_end")))
    own = F.struct(F.lit("period").alias("kind"), F.col("start").alias("range_start"), F.col("end").alias("range_end"))
    return p.select(*keys, F.explode(F.array_compact(F.array(own, gap))).alias("x")).select(*keys, "x.kind", "x.range_start", "x.range_end")


def hit_periods(hits: DataFrame, longest_gap: int = 20_000) -> DataFrame:
    """genome_name, sequence, kind (period or gap), range_start, range_end of the hits, genome and sequence in clean form.

    A hit covers [start_pos, start_pos + |aln_length|); hits with a null genome, sequence, start_pos or aln_length, or of length 0, are
    left out. Hits delivered twice change nothing; other columns are ignored.
    """
    h = hits.select(
        clean_genome("genome_name").alias("genome_name"),
        clean_sequence("sequence").alias("sequence"),
        F.col("start_pos").cast("bigint").alias("start"),
        (F.col("start_pos") + F.abs(F.col("aln_length").cast("bigint"))).alias("end"),
    )
    return with_gaps(merge_intervals(h), longest_gap)
