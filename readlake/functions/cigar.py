"""Cigars as arrays of (op, len), and the packed and textual forms of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations by their packed code. Fixed values.
CODES = {"M": 0, "I": 1, "D": 2, "N": 3, "S": 4, "H": 5, "P": 6, "X": 15}
QUERY, REFERENCE = ("M", "X", "=", "I", "S"), ("M", "X", "=", "D", "N")
TYPE = "array<struct<op:string,len:int>>"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def run(op: Column, n: Column) -> Column:
    return F.struct(op.alias("op"), n.cast("int").alias("len"))


def empty() -> Column:
    return F.array().cast(TYPE)


def pack(cigar: Column) -> Column:
    """array<int> of len * 16 + code; an unknown operation gives a null."""
    return F.transform(cigar, lambda x: F.shiftleft(x["len"], 4) + F.try_element_at(_map(CODES), x["op"]))


def unpack(packed: Column) -> Column:
    return F.transform(packed, lambda x: run(F.try_element_at(_map({v: k for k, v in CODES.items()}), x.bitwiseAND(15)), F.shiftright(x, 4)))


def parse(text: Column) -> Column:
    """A cigar as SAM writes it; '*' and null give an empty list."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("*")), F.lit(r"(\d+[MIDNSHPX=])"), 1)
    return F.transform(parts, lambda x: run(F.right(x, F.lit(1)), F.regexp_replace(x, "[A-Z=]", "").cast("int")))


def push(cigar: Column, op: Column, n: Column) -> Column:
    """The cigar with a run appended, joined to the last run of the same operation; a run of length 0 changes nothing."""
    last = F.try_element_at(cigar, F.lit(-1))
    joined = F.concat(F.slice(cigar, 1, F.size(cigar) - 1), F.array(run(op, last["len"] + n)))
    return F.when(n == 0, cigar).when(last["op"] == op, joined).otherwise(F.concat(cigar, F.array(run(op, n)))).cast(TYPE)


def _span(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0), lambda a, x: a + x["len"])


def query_length(cigar: Column) -> Column:
    """Bases of the read: matches, mismatches, inserts, soft clips."""
    return _span(cigar, QUERY)


def reference_span(cigar: Column) -> Column:
    """Bases of the reference: matches, mismatches, deletions, skips."""
    return _span(cigar, REFERENCE)


def trim_left(cigar: Column, n: Column) -> Column:
    """The cigar without its first n read bases; what consumes no read base before the first base kept goes too."""
    state = F.struct(n.cast("int").alias("rest"), F.lit(False).alias("on"), empty().alias("out"))

    def step(s: Column, x: Column) -> Column:
        uses = x["op"].isin(*QUERY)
        cut = ~s["on"] & uses & (x["len"] > s["rest"])
        kept = F.when(s["on"], F.concat(s["out"], F.array(run(x["op"], x["len"])))).when(cut, F.array(run(x["op"], x["len"] - s["rest"]))).otherwise(s["out"])
        rest = F.when(s["on"] | cut | ~uses, s["rest"]).otherwise(s["rest"] - x["len"])
        return F.struct(rest.cast("int").alias("rest"), (s["on"] | cut).alias("on"), kept.cast(TYPE).alias("out"))

    return F.when(n <= 0, cigar).otherwise(F.aggregate(cigar, state, step, lambda s: s["out"]))


def trim_right(cigar: Column, n: Column) -> Column:
    """The cigar without its last n read bases."""
    return F.reverse(trim_left(F.reverse(cigar), n))


def _merged(cigar: Column) -> Column:
    """Mismatches as matches, no empty runs, equal neighbours joined."""
    return F.aggregate(cigar, empty(), lambda acc, x: push(acc, F.when(x["op"].isin("X", "="), "M").otherwise(x["op"]), x["len"]))


def to_sam(cigar: Column) -> Column:
    """Text for SAM: merged, inserts at either end as soft clips, '*' if nothing is left."""
    m = _merged(cigar)
    n = F.size(m)
    clipped = F.transform(m, lambda x, i: run(F.when(((i == 0) | (i == n - 1)) & (x["op"] == "I"), "S").otherwise(x["op"]), x["len"]))
    text = F.array_join(F.transform(clipped, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(text == "", "*").otherwise(text)


def to_text(cigar: Column) -> Column:
    """Text for people: every run as it is, mismatches as M, the empty match that marks a seed as '/'."""
    return F.array_join(
        F.transform(cigar, lambda x: F.when((x["op"] == "M") & (x["len"] == 0), "/").otherwise(F.concat(x["len"].cast("string"), F.when(x["op"] == "X", "M").otherwise(x["op"])))), ""
    )
