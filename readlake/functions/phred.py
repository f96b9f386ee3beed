"""Probabilities on the Phred scale, -10 log10 p, kept as doubles: higher is less likely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_QUALITY = 30


def sol_to_phred(q: Column) -> Column:
    """Solexa log-odds score to Phred, as a double."""
    return F.log1p(F.pow(F.lit(10.0), q / 10)) * 10 / F.log(F.lit(10.0))


def all_ascii_qscores(line: Column) -> Column:
    """Whether a line consists of signed integers apart by blanks, and holds one."""
    return line.rlike(r"^\s*[+-]?\d+(\s+[+-]?\d+)*\s*$")


def from_float(p: Column) -> Column:
    """Probability to Phred; null for zero, which has no finite score."""
    return F.log10(p) * -10


def to_float(phred: Column) -> Column:
    return F.pow(F.lit(10.0), phred / -10)


def to_phred(phred: Column) -> Column:
    """The score as an integer, rounded half up."""
    return F.floor(phred + 0.5).cast("int")


def to_phred_byte(phred: Column) -> Column:
    """The same within 0 to 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), to_phred(phred)))


def add(a: Column, b: Column) -> Column:
    """Sum of two probabilities, by the larger one, so that nothing underflows."""
    low = F.least(a, b)
    return low - F.log1p(F.pow(F.lit(10.0), -(F.greatest(a, b) - low) / 10)) * 10 / F.log(F.lit(10.0))


def subtract(a: Column, b: Column) -> Column:
    """Difference of two probabilities; null where it isn't positive."""
    return F.when(a < b, a - F.log1p(-F.pow(F.lit(10.0), -(b - a) / 10)) * 10 / F.log(F.lit(10.0)))


def multiply(a: Column, b: Column) -> Column:
    return a + b


def divide(a: Column, b: Column) -> Column:
    return a - b


def sqrt(a: Column) -> Column:
    return a / 2


def likelier(a: Column, b: Column) -> Column:
    """Whether a is the larger probability."""
    return a < b


def lerp(a: Column, b: Column, share: float) -> Column:
    """share of a and the rest of b."""
    return add(a - 10 * _log10(share), b - 10 * _log10(1 - share))


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def sum_of(scores: Column) -> Column:
    """Sum of a list of probabilities; null for an empty list."""
    low = F.array_min(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), -(x - low) / 10))
    return low - F.log10(total) * 10


def base_probabilities(letter: Column, quality: Column) -> Column:
    """Probabilities of A, C, G, T given a called letter and its score (30 if null): the bases the letter stands for share 1 less the
    error, the others the error; a letter for all four gives each a quarter."""
    from readlake.functions.seq import to_ambicode

    code = to_ambicode(letter)
    err = to_float(F.coalesce(quality, F.lit(DEFAULT_QUALITY)))
    n = F.bit_count(code)
    one = lambda bit: F.when(n.isin(0, 4), F.lit(0.25)).when(code.bitwiseAND(F.lit(bit)) != 0, (1 - err) / n).otherwise(err / (4 - n))
    return F.array(one(1), one(2), one(8), one(4))
