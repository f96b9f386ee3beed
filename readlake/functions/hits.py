"""Choice among the hits of a record, and the fields of a hit that writers print."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_hit(hit: Column) -> Column:
    """The hit of lowest score; a missing score is 0, and the first of equals wins. Null without hits."""
    order = F.transform(hit, lambda h, i: F.struct(F.coalesce(h["score"], F.lit(0)).alias("s"), i.alias("i")))
    return F.try_element_at(hit, F.array_min(order)["i"] + 1)


def hit_to(hit: Column, genomes: Sequence[str] = ()) -> Column:
    """The first hit to the first of the genomes that has one; the best hit without genomes."""
    if not genomes:
        return best_hit(hit)
    return F.coalesce(*[F.try_element_at(F.filter(hit, _to(g)), F.lit(1)) for g in genomes])


def _to(genome: str):
    return lambda h: h["genome_name"] == genome


def mapq_for_sam(hit: Column) -> Column:
    """254 for a unique hit, as 255 means unknown to readers."""
    return F.least(F.lit(254), F.coalesce(hit["map_quality"], F.lit(254)))


def quality_text(quality: Column, most: int = 93) -> Column:
    """Scores as characters from '!', capped; '*' for null."""
    return F.coalesce(F.array_join(F.transform(quality, lambda q: F.chr(F.least(q, F.lit(most)) + 33)), ""), F.lit("*"))


def glf_code(code: Column) -> Column:
    """Ambiguity bits of A, C, T, G order to the order A, C, G, T of likelihood files."""
    return code.bitwiseAND(3) + F.shiftleft(code.bitwiseAND(4), 1) + F.shiftright(code.bitwiseAND(8), 1)
