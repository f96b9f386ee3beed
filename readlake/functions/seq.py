"""Nucleotide sequences: codes, complements, trim points, words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity letters by the bits of A=1, C=2, T=4, G=8; index 0 is the gap. Fixed values.
CODES = "-ACMTWYHGRSVKDBN"
#: Letters and their complements. Fixed values.
LETTERS = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn"
COMPLEMENTS = "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def to_ambicode(c: Column) -> Column:
    """Bits of the bases that a letter stands for (T and U are one); 0 for anything else."""
    up = F.translate(F.upper(c), "U", "T")
    return F.greatest(F.lit(0), F.instr(F.lit(CODES), F.substring(up, 1, 1)) - 1) * (F.length(c) > 0).cast("int")


def from_ambicode(n: Column) -> Column:
    """The letter of the bits, '-' outside 0..15."""
    return F.when(n.between(0, 15), F.substr(F.lit(CODES), n + 1, F.lit(1))).otherwise("-")


def encodes_nuc(c: Column) -> Column:
    """Whether every character is a nucleotide code or a gap, and there is one."""
    return c.rlike(f"^[{LETTERS}-]+$")


def complement(c: Column) -> Column:
    """Each letter by its complement; other characters become '-'."""
    return F.translate(F.regexp_replace(c, f"[^{LETTERS}]", "-"), LETTERS, COMPLEMENTS)


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def match(a: Column, b: Column) -> Column:
    """Whether two letters may stand for the same base."""
    return to_ambicode(a).bitwiseAND(to_ambicode(b)) != 0


def effective_length(read: Column) -> Column:
    """Length between the trim points: trim_left bases are cut, trim_right is the index past the last base kept."""
    return F.coalesce(read["trim_right"], F.length(read["sequence"])) - F.coalesce(read["trim_left"], F.lit(0))


def effective_sequence(read: Column) -> Column:
    return F.substr(read["sequence"], F.coalesce(read["trim_left"], F.lit(0)) + 1, effective_length(read))


def gc_percent(sequence: Column) -> Column:
    """Whole percent of upper-case G and C, rounded down; null for an empty sequence."""
    n = F.length(sequence)
    return F.when(n > 0, F.floor((n - F.length(F.translate(sequence, "GC", ""))) * 100 / n)).cast("int")


def check_repeat(word: Column, k: int, most: int | None = None) -> Column:
    """Whether a word of length k overlaps itself when shifted by 1 to most bases (default k / 2)."""
    most = k // 2 if most is None else most
    if most < 1:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.substring(word, 1, k - n) == F.substring(word, n + 1, k - n) for n in range(1, most + 1)])


def expand_ambiguity(word: Column, most: int | None = None) -> Column:
    """All words over ACGT that a word with ambiguity codes stands for; an empty list for a gap, or if there are more than most (None: any number, which
    is 4^k for a word of k Ns)."""
    table = {c: [b for b, bit in (("A", 1), ("C", 2), ("T", 4), ("G", 8)) if i & bit] for i, c in enumerate(CODES) if i}
    options = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(b) for b in x]) for kv in table.items() for x in kv])
    choice = lambda c: F.coalesce(F.try_element_at(options, c), F.array().cast("array<string>"))
    longer = lambda acc, c: F.flatten(F.transform(acc, lambda p: F.transform(choice(c), lambda b: F.concat(p, b))))
    grow = longer if most is None else lambda acc, c: F.when(F.size(acc) * F.size(choice(c)) > most, F.array().cast("array<string>")).otherwise(longer(acc, c))
    return F.aggregate(F.split(F.translate(F.upper(word), "U", "T"), ""), F.array(F.lit("")), grow)


def neighbours(word: Column, k: int, mismatches: int = 1) -> Column:
    """The word and all words of length k at up to mismatches (0, 1 or 2) substitutions, each once."""
    sets = F.array(word)
    for _ in range(mismatches):
        sets = F.array_distinct(
            F.concat(sets, F.flatten(F.transform(sets, lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.split(F.lit("ACGT"), ""), lambda b: F.overlay(w, b, i, F.lit(1))))))))
        )
    return sets
