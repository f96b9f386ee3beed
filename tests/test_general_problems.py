"""Edge cases of the general problems, against hand-computed results and brute force."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readlake.functions.units import ERROR, LEVEL, ODDS, parse_unit
from readlake.operators import bad_rows, drift, periods, quality_units, skew
from readlake.operators.blocked import with_neighbour

CLASH = ("unit", "phred", "value", "values", "weight", "start", "end", "block", "k", "note", "r_id", "key", "entries", "v", "reason", "p", "salt", "n")


def clashing(df):
    return df.withColumns({k: F.lit("clash") for k in CLASH if k not in df.columns})


# --- 1: units -----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "vector", "scale", "offset", "origin"),
    [
        ("Phred+33", LEVEL, 1, 0, 33),
        ("older pipeline 1.5, PHRED+64", LEVEL, 1, 0, 64),
        ("Solexa scale, not Phred! offset 64", ODDS, 1, 0, 64),
        ("signed integers on the Solexa scale", ODDS, 1, 0, None),
        ("per-base accuracy (%), not error", ERROR, -0.01, 1, None),
        ("error rate in permille", ERROR, 0.001, 0, None),
        ("log10(P wrong) per base", LEVEL, -10, 0, None),
        ("chance that the call is wrong, between 0 and 1", ERROR, 1, 0, None),
        ("integer Phred scores, spelled out", LEVEL, 1, 0, None),
        ("Phred+33, not Solexa", LEVEL, 1, 0, 33),
        ("Errors in lane 3; qualities Phred+33", LEVEL, 1, 0, 33),
        ("error probability in parts per million", ERROR, 1e-6, 0, None),
        ("probability of error x 1000", ERROR, 1e-3, 0, None),
        ("natural log of error probability", LEVEL, -10 / math.log(10), 0, None),
        ("qualities are 1 - p(error)", ERROR, -1, 1, None),
        ("1 - error probability, in percent", ERROR, -0.01, 1, None),
        ("Phred/10", LEVEL, 10, 0, None),
        ("ascii 64", LEVEL, 1, 0, 64),
        ("qual=log10-error", LEVEL, -10, 0, None),
        ("-log10(P(error))", LEVEL, 10, 0, None),
        ("Qual = -10 log10(p/(1-p)), ASCII 64", ODDS, 1, 0, 64),
        ("log2 odds, decimal numbers", ODDS, 10 * math.log10(2), 0, None),
        ("p(error) / 2, unit 1/100", ERROR, 0.02, 0, None),
        ("accuracy, ppm", ERROR, -1e-6, 1, None),
        ("error (‰)", ERROR, 1e-3, 0, None),
        ("3 % of the reads clipped. Phred + 64", LEVEL, 1, 0, 64),
    ],
)
def test_grammar(text, vector, scale, offset, origin):
    u = parse_unit(text)
    assert (u.vector, u.origin) == (vector, origin)
    assert (u.scale, u.offset) == pytest.approx((scale, offset))


@pytest.mark.parametrize("text", [None, "", "tile 64, quality checked", "extract 33; low quality tail", "barcode 64", "lane 3 weak"])
def test_texts_without_unit(text):
    assert parse_unit(text) is None


def test_unread_notes(spark):
    runs = [(1, "Phred+33"), (2, "see lab book"), (3, None), (4, " "), (5, "Phred or Solexa, offset 64"), (6, "error in percent")]
    got = quality_units.unread_notes(clashing(spark.createDataFrame(runs, "run_id bigint, run_note string")))
    assert {r.run_id for r in got.collect()} == {2, 5} and got.limit(0).count() == 0


READS = "read_id bigint, seqid string, run_id bigint, description string, sequence string, quality string"


def _quality(spark, rows, runs):
    r = clashing(spark.createDataFrame([(i, None, run, d, s, q) for i, run, d, s, q in rows], READS))
    n = spark.createDataFrame(runs, "run_id bigint, run_note string")
    return {x.read_id: (x.phred, x.phred_total, x.standard) for x in quality_units.normalize_quality(r, n).collect()}


def test_quality_units(spark):
    rows = [
        (1, 1, None, "ACGT", "IIII"),
        (2, 2, None, "ACGT", "hhhh"),
        (3, 2, "qual=sanger", "ACGT", "IIII"),
        (4, 1, "[accuracy in %]", "AC", "99.9% 99%"),
        (5, 1, "[errors per 1000]", "AC", "1,10"),
        (6, 1, "[log10 P(error)]", "AC", "-3;-2.04"),
        (7, 1, "[Solexa, signed numbers]", "ACG", "10 0 -5"),
        (8, 1, None, "ACGT", "III"),
        (9, 1, None, "ACGT", None),
        (10, 1, None, "ACGT", "*"),
        (11, 1, None, "ACGT", ""),
        (12, 1, None, None, "IIII"),
        (13, 1, "[P(error) per base]", "AC", "0.001 nonsense"),
        (14, 3, None, "ACG", "hgf"),
        (15, 4, None, "ACG", "5.6"),
        (16, None, None, "A", "I"),
        (17, 1, "[P(error) per base]", "A", "1.5"),
        (18, 1, "[Phred as numbers]", "A", "29.5"),
    ]
    got = _quality(spark, rows, [(1, "Phred+33"), (2, "Phred+64"), (2, None), (3, None), (4, "")])
    assert got[1] == ([40] * 4, 160, True)
    assert got[2] == ([40] * 4, 160, False)
    assert got[3] == ([40] * 4, 160, True)
    assert got[4][0] == [30, 20] and got[5][0] == [30, 20] and got[6][0] == [30, 20]
    assert got[7][0] == [10, 3, 1]
    assert all(got[i][1] is None for i in (8, 9, 10, 11, 12, 13, 17))
    assert got[14][0] == [40, 39, 38]  # high characters of the run show origin 64
    assert got[15][0] == [20, 13, 21]
    assert got[16] == ([40], 40, True)
    assert got[18][0] == [30]


def test_quality_empty(spark):
    assert _quality(spark, [], []) == {}
    assert _quality(spark, [(1, 5, None, "A", "I"), (1, 5, None, "A", "I")], []) == {1: ([40], 40, True)}


# --- 2: failing lines ---------------------------------------------------------------------------------------------------------------------

LINES = {
    1: ('a,b,ACGT,IIII,1,3', None),
    2: ('a,"x, ""y""\nz",ACGT,"I,""I",,', None),
    3: ('a,b,ACGT,IIII,1', "column_count"),
    4: ('a,b,ACGT,IIII,1,2,3', "column_count"),
    5: ("", "column_count"),
    6: (None, "column_count"),
    7: ('a,"b,ACGT,IIII,1,2', "quoting"),
    8: ('a,"b"x,ACGT,IIII,1,2', "quoting"),
    9: ('a,b"c,ACGT,IIII,1,2', "quoting"),
    10: ("a,b,,,,", "bad_sequence"),
    11: ("a,b,ACGX,IIII,1,2", "bad_sequence"),
    12: ("a,b,ACGT,III,1,2", "bad_quality"),
    13: ("a,b,ACGT,III\x1f,1,2", "bad_quality"),
    14: ("a,b,ACGT,,-1,2", "bad_trim"),
    15: ("a,b,ACGT,,1,x", "bad_trim"),
    16: ("a,b,acgt-N,,99999999999999999999,007", None),
    17: ("a,b\nc\r,ACGT,,,", None),
    18: ("a,\x1e0\x1e,ACGT,,,", None),
    19: (",,ACGT,,,", None),
    20: ("a,é ,ACGT,,,", None),
    21: ("a," + "x" * 300_000 + ",ACGT,,,", None),
}


def test_failing_lines(spark):
    d = spark.createDataFrame([(i, "f", i, x) for i, (x, _) in LINES.items()], "raw_id bigint, file_name string, line_no bigint, line string")
    got = {r.raw_id: r for r in bad_rows.load_lines(clashing(d)).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: x for i, (_, x) in LINES.items()}
    assert got[2].description == 'x, "y"\nz' and got[2].quality == 'I,"I' and got[2].trim_left is None
    assert got[16].trim_left is None and got[16].trim_right == 7
    assert got[17].description == "b\nc\r" and got[18].description == "\x1e0\x1e" and len(got[21].description) == 300_000
    assert got[15].failing == "trim_right" and got[11].failing == "sequence"
    assert bad_rows.load_lines(d.limit(0)).count() == 0
    assert bad_rows.rejects(d.unionAll(d)).count() == 2 * sum(x is not None for _, x in LINES.values())
    assert bad_rows.loaded(d).count() == sum(x is None for _, x in LINES.values())


def test_only_failing_lines(spark):
    d = spark.createDataFrame([(1, None, None, '"')], "raw_id bigint, file_name string, line_no bigint, line string")
    assert [r.reason for r in bad_rows.load_lines(d).collect()] == ["quoting"]


# --- 3: hot keys --------------------------------------------------------------------------------------------------------------------------

HITS = "hit_id bigint, read_id bigint, genome_name string, sequence string, start_pos bigint, aln_length int, map_quality int"


def _hits(spark, rows):
    return clashing(spark.createDataFrame(rows, HITS))


def test_profile_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = rng.choices([" Hot.DNA", "hot", "b", None], [4, 4, 1, 1])[0]
        rows.append((i, i, key, rng.choice(["c\t", "c", None]), rng.choice([None, rng.randrange(10), rng.randrange(-5, 10**10)]), 1, rng.choice([None, 3, 3, 7])))
    groups = defaultdict(list)
    for r in rows:
        groups[None if r[2] is None else r[2].strip().lower().removesuffix(".dna"), None if r[3] is None else r[3].strip()].append(r[4])
    for r in skew.pair_profile(_hits(spark, rows)).collect():
        v = sorted(x for x in groups[r.genome_name, r.sequence] if x is not None)
        assert r.n_rows == len(groups[r.genome_name, r.sequence]) and r.n_distinct == len(set(v))
        best = max(Counter(v).values())
        assert r.mode_rows == best and r.mode == min(x for x, n in Counter(v).items() if n == best)
        import math

        assert [r.q25, r.q50, r.q75] == [v[max(1, math.ceil(len(v) * p)) - 1] for p in (0.25, 0.5, 0.75)]


@pytest.mark.parametrize(("low", "high"), [(0, 1 << 45), (-(1 << 60) - 5, (1 << 60) + 9), (-(1 << 63), (1 << 63) - 1)])
def test_quartiles_of_wide_ranges(spark, low, high):
    rng = random.Random(7)
    values = sorted([low, high] + [rng.randint(low, high) for _ in range(38)])
    d = spark.createDataFrame([("a", v, 1) for v in values] + [("b", 5, 2), ("c", None, 1)], "k string, value bigint, weight bigint")
    got = {(r.k, r.p): r.quantile for r in skew.percentiles(d, ["k"], (0.25, 0.5, 0.75, 1.0)).collect()}
    assert got == {("a", 0.25): values[9], ("a", 0.5): values[19], ("a", 0.75): values[29], ("a", 1.0): high} | {("b", p): 5 for p in (0.25, 0.5, 0.75, 1.0)}


def test_heavy_pairs(spark):
    rows = [(i, i, "A" if i < 97 else "b", "x", None, None, None) for i in range(100)] + [(100, 1, None, "x", 1, 1, 1)] * 2
    assert {(r.genome_name, r.sequence) for r in skew.heavy_pairs(_hits(spark, rows)).collect()} == {("a", "x")}
    assert skew.heavy_pairs(_hits(spark, rows[:0])).count() == 0
    assert skew.pair_profile(_hits(spark, rows[:0])).count() == 0
    one = skew.pair_profile(_hits(spark, [(1, 1, "a", "x", None, 1, 1)])).collect()[0]
    assert one.n_rows == 1 and one.n_distinct == 0 and one.mode is None and one.q50 is None


# --- 4: drifting schemas -----------------------------------------------------------------------------------------------------------------

RAW = "record_id bigint, producer string, file_id string, written_at timestamp_ntz, record_no int, body string"


def _raw(spark, rows):
    from datetime import datetime, timedelta

    day = lambda n: None if n is None else datetime(2024, 1, 1) + timedelta(days=n)
    return clashing(spark.createDataFrame([(i, p, f, day(at), n, b if b is None or isinstance(b, str) else json.dumps(b)) for i, p, f, at, n, b in rows], RAW))


def test_changes(spark):
    rows = [
        (1, "a", "f1", 0, 1, {"cigar": "10M", "score": 5, "lane": 1}),
        (2, "a", "f1", 0, 2, {"cigar": None, "score": None}),
        (3, "a", "f2", 3, 1, {"CIGAR": [160], "score": "5", "x": None}),
        (3, "a", "f2", 3, 1, {"CIGAR": [160], "score": "5", "x": None}),
        (4, "a", "f3", 3, 1, {"CIGAR": [{"op": "M", "len": 1}], "score": None, "x": None}),
        (5, "b", "g1", 1, 1, {"anything": 1}),
        (6, "a", None, 4, 1, {"y": 1}),
        (7, None, "h", 4, 1, {"y": 1}),
        (8, "a", "f4", 9, 1, "no json"),
        (9, "a", "f4", 9, 2, None),
    ]
    got = {(r.file_id, r.field, r.change) for r in drift.file_changes(_raw(spark, rows)).collect()}
    assert got == {
        ("f2", "cigar", "renamed"), ("f2", "cigar", "retyped"), ("f2", "score", "retyped"), ("f2", "lane", "removed"), ("f2", "x", "added"),
        ("f3", "cigar", "retyped"),
        ("f4", "cigar", "removed"), ("f4", "score", "removed"), ("f4", "x", "removed"),
    }
    assert drift.file_changes(_raw(spark, rows[:0])).count() == 0


def test_unified_hits(spark):
    rows = [
        (1, "a", "f", 0, 1, {"genome": "g", "chrom": "c", "begin": "12", "alnLength": {"length": 5, "strand": "-"}, "penalty": "7", "CIGAR": [80, 33], "MAPQ": 3, "evalue": 0.5}),
        (2, "a", "f", 0, 1, {"genome": "other"}),
        (3, "a", "f", 0, 2, {"cigar": "3M2I", "score": "x", "aln_len": -4, "pos": 1.5}),
        (4, "a", "f", 0, None, {"cigar": [{"op": "M", "len": 2}], "score": 1}),
        (5, "a", "f", 0, None, {"cigar": "3Q"}),
        (6, "a", "f", 0, 3, "[1]"),
        (7, "a", "f", 0, 4, None),
    ]
    names = {"genome": "genome_name", "chrom": "sequence", "begin": "start_pos", "penalty": "score", "mapq": "map_quality", "alnlen": "aln_length", "pos": "start_pos", "zscore": "score"}
    rows[0][5]["lane"], rows[0][5]["taxid"], rows[2][5]["zscore"] = {"a": [1, "x"]}, None, 9
    got = {r.record_id: r for r in drift.unified_hits(_raw(spark, rows), names).collect()}
    assert set(got) == {1, 3, 4, 5, 6, 7}
    g = got[1]
    assert (g.genome_name, g.sequence, g.start_pos, g.aln_length, g.score, g.map_quality, g.evalue) == ("g", "c", 12, -5, 7, 3, 0.5)
    assert [tuple(x) for x in g.cigar] == [("M", 5), ("I", 2)]
    assert [tuple(x) for x in got[3].cigar] == [("M", 3), ("I", 2)] and got[3].aln_length == -4
    assert {(x.field, x.raw) for x in got[3].failed} == {("score", '"x"'), ("start_pos", "1.5")}
    assert got[5].cigar is None and got[5].failed[0].field == "cigar"
    assert got[6].parsed is False and got[7].parsed is False
    # nothing of a record is lost: other fields, nulls, further spellings
    assert g.rest == {"lane": '{"a":[1,"x"]}', "taxid": "null"} and got[3].rest == {"zscore": "9"} and got[6].rest == {}


def test_spellings_are_inferred_from_values(spark):
    rng = random.Random(3)
    rows, n = [], 0
    names = {"score": ["score", "weight_of_match"], "cigar": ["cigar", "ops_of_match"], "start_pos": ["start_pos", "Where"], "sequence": ["sequence", "Molecule"]}
    for f in range(40):
        key = {k: v[f % 2 if k != "cigar" else f // 2 % 2] for k, v in names.items()}
        for k in range(25):
            n += 1
            body = {
                key["score"]: rng.choice([int, str])(rng.randint(0, 200)), key["start_pos"]: rng.randint(10**6, 10**8), key["sequence"]: f"chr{rng.choice('123XY')}",
                key["cigar"]: rng.choice([f"{rng.randint(5, 50)}M", [{"op": "M", "len": rng.randint(5, 50)}]]), "lane": rng.randint(1, 8), "map_quality": rng.randint(0, 60),
            }
            if f % 3 == 0:
                body |= {"built": f"b{k % 4}", "evalue": 1.5e-5, "depth": rng.random() * 10**7}
            rows.append((n, "p", f"f{f:02}", f, k, body))
    stats = drift.path_stats(_raw(spark, rows))
    assert drift.spellings_of(stats) == {"weightofmatch": "score", "opsofmatch": "cigar", "where": "start_pos", "molecule": "sequence"}
    got = {(r.field, r.change) for r in drift.file_changes(_raw(spark, rows)).where("file_id = 'f01'").collect()}
    assert got >= {("score", "renamed"), ("start_pos", "renamed"), ("sequence", "renamed"), ("built", "removed")} and ("score", "added") not in got


def test_spellings_are_told_by_whole_texts(spark):
    rng = random.Random(4)
    stem = "assembly/of/the/laboratory/" + "part/" * 20
    rows, n = [], 0
    for f in range(40):
        for k in range(25):
            n += 1
            # digit groups count as one sign, so that a long text may have a short shape
            chrom = f"{stem}chr{rng.choice('XYZ')}" if k % 5 else f"chr{'0' * rng.choice([1, 90])}{rng.randint(1, 9)}"
            body = {"sequence": chrom} if f % 2 else {"Molecule": chrom, "remark": stem + rng.choice(["checked", "to be read again", "withdrawn"])}
            rows.append((n, "p", f"f{f:02}", f, k, body))
    stats = drift.path_stats(_raw(spark, rows))
    # paths that differ only behind a long common beginning are different fields; a spelling of such texts is found still
    assert drift.spellings_of(stats) == {"molecule": "sequence"}
    kinds = {r.path: r.kinds for r in stats.groupBy("path").agg(F.count_distinct("shape").alias("kinds")).collect()}
    assert kinds == {"sequence": 4, "Molecule": 4, "remark": 3}
    # a text of any length is a shape of a bounded size
    assert stats.agg(F.max(F.length("shape"))).first()[0] <= 65
    got = {(r.field, r.change) for r in drift.file_changes(_raw(spark, rows)).where("file_id = 'f01'").collect()}
    assert got == {("sequence", "renamed"), ("remark", "removed")}
    hits = drift.unified_hits(_raw(spark, rows)).where("file_id = 'f00'").collect()
    assert all(r.sequence and set(r.rest) == {"remark"} for r in hits)


# --- 7: periods --------------------------------------------------------------------------------------------------------------------------


def _brute(rows, gap):
    by = defaultdict(list)
    for _, _, g, s, p, n, _ in rows:
        if None not in (g, s, p, n) and n:
            by[g.strip().lower().removesuffix(".dna"), s.strip()].append((p, p + abs(n)))
    out = set()
    for (g, s), iv in by.items():
        done = []
        for a, b in sorted(iv):
            if done and a <= done[-1][1]:
                done[-1][1] = max(done[-1][1], b)
            else:
                done.append([a, b])
        out |= {(g, s, "period", a, b) for a, b in done}
        out |= {(g, s, "gap", x[1], y[0]) for x, y in zip(done, done[1:], strict=False) if y[0] - x[1] <= gap}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_periods_against_brute_force(spark, seed):
    rng = random.Random(seed)
    b = periods.BLOCK
    rows = []
    for i in range(3000):
        p = rng.choice([rng.randrange(5 * b), rng.randrange(2000), b - 5 + rng.randrange(10), 3 * b])
        n = rng.choice([rng.randrange(1, 60), -rng.randrange(1, 60), rng.randrange(1, 2 * b) if rng.random() < 0.01 else 1, 0, None])
        rows.append((i, i, rng.choice([" Hot.dna", "hot", None, "b"]), rng.choice(["c", "c\t", None]), rng.choice([p, p, p, None]), n, None))
    got = [tuple(r) for r in periods.hit_periods(_hits(spark, rows + rows[:50]), 3000).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows, 3000)


def test_sorted_merger_carries_over_batches_whatever_order_names_appear_in():
    import pyarrow as pa

    rows = [("g1", "s5", 0, 1, 5), ("g1", "s9", 0, 1, 5), ("g2", "s1", 0, 1, 5), ("g2", "s5", 0, 1, 5), ("g2", "s5", 0, 3, 9), ("g2", "s5", 0, 9, 12)]
    names = ["genome_name", "sequence", "block", "start", "end"]
    batch = lambda rs: pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rs, strict=True)), strict=True)))
    want = [*rows[:3], ("g2", "s5", 0, 1, 12)]
    for cut in range(1, len(rows)):
        got = [tuple(r.values()) for b in periods._sorted_merger()([batch(rows[:cut]), batch(rows[cut:])]) for r in b.to_pylist()]
        assert got == want


def test_periods_touch_across_blocks(spark):
    b = periods.BLOCK
    rows = [(1, 1, "g", "s", b - 10, 10, 1), (2, 1, "g", "s", b, 5, 1), (3, 1, "g", "s", b + 5, 3 * b, 1), (4, 1, "g", "s", 10 * b, 1, 1)]
    got = {tuple(r)[2:] for r in periods.hit_periods(_hits(spark, rows), 10 * b).collect()}
    assert got == {("period", b - 10, 4 * b + 5), ("period", 10 * b, 10 * b + 1), ("gap", 4 * b + 5, 10 * b)}
    assert periods.hit_periods(_hits(spark, rows[:0])).count() == 0
    assert periods.hit_periods(_hits(spark, [(1, 1, None, "s", 1, 1, 1)])).count() == 0


def test_neighbours(spark):
    rows = [("a", x) for x in (1, 5, 100, 101, 350)] + [("b", 7)]
    d = spark.createDataFrame(rows, "k string, x int")
    for forward in (True, False):
        got = {(r.k, r.x): r.n.x if r.n else None for r in with_neighbour(d, ["k"], F.floor(F.col("x") / 50), [F.col("x")], F.struct("x"), "n", forward).collect()}
        xs = [1, 5, 100, 101, 350]
        want = dict(zip([("a", x) for x in xs], xs[1:] + [None] if forward else [None, *xs[:-1]], strict=True)) | {("b", 7): None}
        assert got == want
