"""Concatenation, merge and join of record sets, and composition of operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.schema import HIT, READ

Op = Callable[[DataFrame], DataFrame]
#: Listed members from which on they are only counted.
COLLAPSE = 8


def concat(*inputs: DataFrame) -> DataFrame:
    """Bag union by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def merge_hits(hits: Column) -> Column:
    """One hit per genome, in order of the names: the lowest score wins (then sequence, position, length), and its map quality becomes the
    smaller of its own and the difference to the second score, a missing own one counting as infinite."""
    order = F.array_sort(
        F.transform(hits, lambda h: F.struct(h["genome_name"].alias("g"), F.coalesce(h["score"], F.lit(0)).alias("s"), h["sequence"].alias("q"), h["start_pos"].alias("p"), h["aln_length"].alias("l"), h.alias("h")))
    )
    genomes = F.array_distinct(F.transform(order, lambda x: x["g"]))

    def one(g: Column) -> Column:
        mine = F.filter(order, lambda x: x["g"].eqNullSafe(g))
        first, second = F.try_element_at(mine, F.lit(1)), F.try_element_at(mine, F.lit(2))
        return first["h"].withField("map_quality", F.least(first["h"]["map_quality"], second["s"] - first["s"]))

    return F.transform(genomes, one).cast(f"array<{HIT}>")


def merge_same_reads(df: DataFrame) -> DataFrame:
    """Records of one seqid combined: hits merged per genome, members listed once or, from eight on, counted, statistics appended.

    The read is that of the record with the smallest sequence, then description. Records without seqid stay as they are.
    One shuffle by seqid; a group holds the records of one read, a handful by nature."""
    named, rest = df.where("read.seqid is not null"), df.where("read.seqid is null")
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.hash(c).alias("k"), F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array())))
    g = named.groupBy(F.col("read.seqid").alias("seqid")).agg(
        F.min(F.struct("read.sequence", "read.description", "read")).alias("r"),
        F.array_distinct(lists("members")).alias("members"),
        F.sum(F.coalesce("nmembers", F.lit(0))).cast("int").alias("nmembers"),
        lists("hit").alias("hits"),
        lists("aln_stats").alias("aln_stats"),
        F.max("diff_to_next_species").alias("diff_to_next_species"),
        F.max("diff_to_next_order").alias("diff_to_next_order"),
        F.max("num_reads").alias("num_reads"),
        lists("seeds").alias("seeds"),
    )
    many = F.size("members") >= COLLAPSE
    out = g.select(
        F.col("r.read").alias("read"),
        F.when(many, F.array().cast(f"array<{READ}>")).otherwise(F.col("members")).alias("members"),
        (F.col("nmembers") + F.when(many, F.size("members")).otherwise(0)).alias("nmembers"),
        merge_hits(F.col("hits")).alias("hit"),
        "aln_stats",
        "diff_to_next_species",
        "diff_to_next_order",
        "num_reads",
        "seeds",
    )
    return out.unionByName(rest.select(*out.columns))


def join_reads(*inputs: DataFrame) -> DataFrame:
    """Full outer join of record sets on seqid, the hits of all combined: a union and one grouped aggregate."""
    return merge_same_reads(concat(*inputs))


@dataclass(frozen=True)
class Header:
    """What travels beside a record set: provenance and the order it is in."""

    sort_order: tuple[str, ...] = ()
    command_lines: tuple[str, ...] = ()
    policies: tuple = ()
    ids: tuple[tuple[str, str], ...] = ()
    exit_code: int = field(default=0)


def nub(xs: Sequence) -> tuple:
    """Distinct elements in order of first appearance."""
    return tuple(dict.fromkeys(xs))


def merge_headers(*headers: Header) -> Header:
    """Ids and sort order stay only where all agree; command lines and policies once each; exit codes or-ed."""
    first = headers[0]
    ids = tuple(x for x in first.ids if all(x in h.ids for h in headers))
    order = first.sort_order if all(h.sort_order == first.sort_order for h in headers) else ()
    return Header(order, nub([c for h in headers for c in h.command_lines]), nub([p for h in headers for p in h.policies]), ids, reduce(lambda a, h: a | h.exit_code, headers, 0))


def merge_sorted(inputs: Sequence[tuple[Header, DataFrame]], genomes: Sequence[str] | None = None) -> tuple[Header, DataFrame]:
    """Merge of record sets in one order; an error where their headers name different orders."""
    from readlake.operators.sorting import sort_by_name, sort_by_position

    orders = {h.sort_order for h, _ in inputs}
    if len(orders) != 1 or not next(iter(orders)):
        raise ValueError(f"inputs must be sorted alike: {sorted(orders)}")
    merged = merge_same_reads(concat(*(d for _, d in inputs)))
    return merge_headers(*(h for h, _ in inputs)), (sort_by_name() if genomes is None else sort_by_position(genomes))(merged)


def mega_merge(sets: Sequence[Sequence[DataFrame]]) -> DataFrame:
    """Each set joined, then all put together."""
    return concat(*(join_reads(*s) for s in sets))


def chain(*ops: Op) -> Op:
    """Operators one after the other."""
    return lambda df: reduce(lambda d, op: d.transform(op), ops, df)


def tee(df: DataFrame, **branches: Callable) -> dict:
    """One input to several consumers; it is computed once."""
    shared = df.cache()
    return {name: f(shared) for name, f in branches.items()}


def fmap(f: Callable, summary: Callable) -> Callable:
    """A consumer whose summary is passed on through f."""
    return lambda df: f(summary(df))
