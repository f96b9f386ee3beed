"""Functions on sequences, scores, cigars and hits against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions import phred as ph
from readlake.functions import seq as sq
from readlake.functions.hits import glf_code, quality_text


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


L = F.lit


def test_ambiguity(spark):
    letters = "ACGTUMRWSYKVHDBN-?"
    got = one(spark, *[sq.to_ambicode(L(c)) for c in letters])
    assert got == [1, 2, 8, 4, 4, 3, 9, 5, 10, 6, 12, 11, 7, 13, 14, 15, 0, 0]
    assert one(spark, *[sq.from_ambicode(L(i)) for i in range(17)]) == list("-ACMTWYHGRSVKDBN") + ["-"]
    assert one(spark, sq.match(L("R"), L("A")), sq.match(L("R"), L("Y")), sq.encodes_nuc(L("acgN-")), sq.encodes_nuc(L("x"))) == [True, False, True, False]
    assert one(spark, sq.reverse_complement(L("ACGTRN?x")), sq.complement(L("acgt")), glf_code(sq.to_ambicode(L("G"))), glf_code(sq.to_ambicode(L("T")))) == ["--NYACGT", "tgca", 4, 8]


def test_words(spark):
    assert one(spark, sq.check_repeat(L("ACGACG"), 6), sq.check_repeat(L("AACGTT"), 6), sq.check_repeat(L("AAAA"), 4)) == [True, False, True]
    assert sorted(one(spark, sq.expand_ambiguity(L("RC")))[0]) == ["AC", "GC"]
    assert one(spark, sq.expand_ambiguity(L("NNNNN"), 256), sq.expand_ambiguity(L("A-")), F.size(sq.expand_ambiguity(L("NNNN"), 256))) == [[], [], 256]
    n = one(spark, sq.neighbours(L("ACGT"), 4, 1), sq.neighbours(L("ACGT"), 4, 2))
    assert len(n[0]) == 13 == len(set(n[0])) and len(n[1]) == 1 + 12 + 6 * 9 == len(set(n[1]))


def test_trimmed(spark):
    r = F.struct(L("ACGGT").alias("sequence"), L(1).alias("trim_left"), L(4).alias("trim_right"))
    assert one(spark, sq.effective_length(r), sq.effective_sequence(r), sq.gc_percent(sq.effective_sequence(r)), sq.gc_percent(L(""))) == [3, "CGG", 100, None]


def test_scores(spark):
    got = one(spark, ph.sol_to_phred(L(0)), ph.sol_to_phred(L(40)), ph.add(L(10.0), L(10.0)), ph.subtract(L(10.0), L(20.0)), ph.lerp(L(10.0), L(20.0), 0.5), ph.to_phred_byte(L(300.2)), ph.to_phred(L(2.5)))
    want = [10 * math.log10(2), 10 * math.log10(1 + 1e4), 10 - 10 * math.log10(2), -10 * math.log10(0.09), -10 * math.log10(0.055), 255, 3]
    assert got == pytest.approx(want)
    assert one(spark, ph.subtract(L(20.0), L(10.0)), ph.likelier(L(3.0), L(4.0)), ph.all_ascii_qscores(L(" 3 -4 ")), ph.all_ascii_qscores(L("IIII"))) == [None, True, True, False]
    assert one(spark, ph.sum_of(F.array(L(10.0), L(10.0), L(1000.0))))[0] == pytest.approx(10 - 10 * math.log10(2))
    p = one(spark, ph.base_probabilities(L("A"), L(10)), ph.base_probabilities(L("R"), L(10)), ph.base_probabilities(L("N"), L(10)))
    assert p[0] == pytest.approx([0.9, 0.1 / 3, 0.1 / 3, 0.1 / 3]) and p[1] == pytest.approx([0.45, 0.05, 0.45, 0.05]) and p[2] == pytest.approx([0.25] * 4)


def c(text):
    return cg.parse(L(text))


def test_cigars(spark):
    assert one(spark, cg.query_length(c("3S5M2I4D6M10N1X")), cg.reference_span(c("3S5M2I4D6M10N1X"))) == [17, 26]
    assert one(spark, cg.pack(c("1M2I3D")), cg.to_text(cg.unpack(cg.pack(c("1M2I3D4X")))), cg.parse(L("*")), cg.parse(L(None))) == [[16, 33, 50], "1M2I3D4M", [], []]
    cut = [cg.to_text(cg.trim_left(c("3M2D4M"), L(n))) for n in (0, 2, 3, 5, 9)] + [cg.to_text(cg.trim_right(c("3M2D4M"), L(n))) for n in (0, 2, 4, 5)]
    assert one(spark, *cut) == ["3M2D4M", "1M2D4M", "4M", "2M", "", "3M2D4M", "3M2D2M", "3M", "2M"]
    assert one(spark, cg.to_sam(c("2I3M0M2X1D4I")), cg.to_sam(cg.empty()), cg.to_text(c("3M0M4X"))) == ["2S5M1D4S", "*", "3M/4M"]
    assert one(spark, cg.to_text(cg.push(cg.push(cg.push(cg.empty(), L("M"), L(2)), L("M"), L(3)), L("I"), L(0))))[0] == "5M"


def test_quality_text(spark):
    assert one(spark, quality_text(F.array(L(0), L(40), L(120))), quality_text(L(None).cast("array<int>"))) == ["!I~", "*"]
