"""Index, seeds, alignment and mapping: brute force and a simulated round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.mapping import align as al
from readlake.mapping.index import IndexSpec, build_index, combine_seeds, genome_words, index_sensitivity, lookup, seed_reads, word_histogram
from readlake.mapping.mapper import map_by_policy, map_reads
from readlake.mapping.simulate import match_probability, random_genome, sample_reads


def contigs(spark, rows):
    return spark.createDataFrame(rows, "genome_name string, offset bigint, bases string")


def test_words(spark):
    c = contigs(spark, [("g", 0, "ACGTACCA"), ("g", 9, "NCCAT"), ("g", 20, "ACG"), ("g", 30, None)])
    got = {(r.pos, r.word) for r in genome_words(c, IndexSpec(4, 1, 1)).collect()}
    assert got == {(0, "ACGT"), (1, "CGTA"), (2, "GTAC"), (3, "TACC"), (4, "ACCA"), (10, "CCAT")} | {(9, f"{b}CCA") for b in "ACGT"}
    assert {p for p, _ in got if p % 4 == 0} == {r.pos for r in genome_words(c, IndexSpec(4, 4, 1)).collect()}
    assert {r.word for r in build_index(c, IndexSpec(4, 1, 1, 2)).collect()} == {w for _, w in got} - {"ACCA"}
    assert {(r.places, r.words) for r in word_histogram(genome_words(c, IndexSpec(4, 1, 1))).collect()} == {(1, 8), (2, 1)}


def test_pieces_of_long_contigs(spark, monkeypatch):
    from readlake.mapping import index

    bases = "".join(np.random.default_rng(1).choice(list("ACGT"), 500))
    want = {(i, bases[i : i + 12]) for i in range(0, 489, 4)}
    monkeypatch.setattr(index, "PIECE", 64)
    got = {(r.pos, r.word) for r in genome_words(contigs(spark, [("g", 0, bases)]), IndexSpec(12, 4, 0)).collect()}
    assert got == want


def test_lookup_with_mismatches(spark):
    ix = build_index(contigs(spark, [("g", 100, "ACGTTGCA")]), IndexSpec(8, 4, 0))
    r = spark.createDataFrame([(1, "TACGTTGCAT"), (2, "TGCAACGT"), (3, "ACGTTGCC"), (4, "AC"), (5, None)], "read_id bigint, sequence string")
    exact = {tuple(x) for x in lookup(r, ix, IndexSpec(8, 4)).select("read_id", "pos", "offset", "diag").collect()}
    assert exact == {(1, 100, 2, 98), (2, 100, -8, 108)}
    near = {x.read_id for x in lookup(r, ix, IndexSpec(8, 4), mismatches=1).collect()}
    assert near == {1, 2, 3}


def test_combined_seeds(spark):
    m = [(1, "g", 100 + o, o, 100) for o in (1, 5, 9, 30)] + [(1, "g", 203 + 2, 2, 203), (1, "g", 200 + 2, 2, 200), (1, "g", 200 + 5, 5, 200), (1, "g", 40, -3, 43)]
    d = spark.createDataFrame(m, "read_id bigint, genome_name string, pos bigint, offset int, diag bigint")
    got = {(r.ref_pos, r.query_pos, r.size) for r in combine_seeds(d, 4, 4).collect()}
    assert got == {(101, 1, 12), (130, 30, 4)} - {(130, 30, 4)} | {(202, 2, 7), (40, -3, 4)}


def _full(read, ref, a):
    """Plain three-state alignment of the whole read to any part of ref."""
    x, r = al.base_probabilities(read, None), al.codes(ref)
    ds, _ = a.matrices()
    pen = -10 * np.log10(ds @ x.T)[r].T
    o, e, inf = al.phred(a.gap_open if a.gap_open else a.gap_extension), al.phred(a.gap_extension), 1e30
    n, m = pen.shape
    M, I, D = (np.full((n + 1, m + 1), inf) for _ in range(3))
    M[0] = 0
    for i in range(1, n + 1):
        for j in range(m + 1):
            if j:
                M[i, j] = min(M[i - 1, j - 1], I[i - 1, j - 1], D[i - 1, j - 1]) + pen[i - 1, j - 1]
            I[i, j] = min(M[i - 1, j] + o, I[i - 1, j] + e)
            if j and i < n:
                D[i, j] = min(M[i, j - 1] + o, D[i, j - 1] + e)
    return min(M[n].min(), I[n].min())


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_plain_recursion(seed):
    rng = np.random.default_rng(seed)
    ref = "".join(rng.choice(list("ACGTN"), 40, p=[0.24, 0.24, 0.24, 0.24, 0.04]))
    read = "".join(c for i, c in enumerate(ref[8:30]) if i != 9).replace("N", "A")
    read = read[:15] + rng.choice(list("ACGT")) + read[15:]
    a = al.Aligner(gap_open=0.001, gap_extension=0.05)
    score, i, j, cigar = al.align(read, None, ref, a)
    assert score == pytest.approx(_full(read, ref, a))
    used = sum(n for o, n in cigar if o in "MI")
    assert used == len(read) and sum(n for o, n in cigar if o in "MD") == j - i
    assert al.align(read, None, ref, a, limit=score - 0.1) is None


def test_damage_explains_ends():
    modern, old = al.Aligner(), al.Aligner(ds_deamination=0.01, ss_deamination=0.5, mean_overhang=2.0)
    ref = "CCACGTACGGTACCTTAAGG"
    read = "TTACGTACGGTACCTTAAAA"
    assert al.align(read, None, ref, old)[0] < al.align(read, None, ref, modern)[0] - 40
    assert al.align("", None, ref, old) is None and al.align(read, None, "", old) is None


def test_seed_quality():
    assert al.seed_quality("ACGTACGT", "ACGTACGT", 0, 8) and not al.seed_quality("ACGTACGT", "ACGAACGT", 0, 5)
    assert al.seed_quality("ACGTACGT", "ACGAACGT", 1, 7) and al.seed_quality("ACGTACGT", "ACGAACCT", 2, 7)


def test_round_trip(spark):
    g = random_genome(spark, "sim", 60_000, contig=1 << 14).cache()
    assert g.agg(F.sum(F.length("bases"))).first()[0] == 60_000 and {r.bases for r in g.collect()} == {r.bases for r in random_genome(spark, "sim", 60_000, contig=1 << 14).repartition(3).collect()}
    r = sample_reads(g, 60_000, n=300, gaps=0.004).cache()
    assert {x.strand for x in r.collect()} == {"+", "-"}
    spec = IndexSpec(12, 4, cutoff=100)
    ix = build_index(g, spec).cache()
    m = map_reads(r.select("read_id", "sequence", "quality"), g, ix, spec).cache()
    j = m.where("reason = 'aligned'").join(r.select("read_id", "start", "len", "strand"), "read_id").collect()
    assert len(j) > 0.9 * 300
    assert all(abs(x.start_pos - x.start) <= 3 and (x.aln_length < 0) == (x.strand == "-") and x.sequence == "chr1" for x in j)
    seeds, st = seed_reads(r.select("read_id", "sequence"), ix, spec, 16, repeat_threshold=1)
    assert seeds.count() == 0 and {x.reason for x in st.collect()} <= {"too_many_seeds", "no_seeds"}
    seeds, _ = seed_reads(r.select("read_id", "sequence"), ix, spec, 16)
    offset = F.col("start") + F.floor(F.col("start") / (1 << 14))
    t = r.select("read_id", offset.alias("start"), (offset + F.col("len")).alias("end"))
    s = index_sensitivity(seeds, t).first()
    assert s.sequences == 300 and s.found > 270
    assert map_reads(r.select("read_id", "sequence", "quality").limit(0), g, ix, spec).count() == 0


def _repeats(spark):
    """Two genomes: one of unique bases before 30 copies of a repeat, one of other bases; and reads of both parts, of neither, and empty ones."""
    rng = np.random.default_rng(5)
    one, other, repeat, foreign = ("".join(rng.choice(list("ACGT"), n)) for n in (2000, 500, 100, 60))
    rows = [("g", "chr1", 0, 0, 5000, one + repeat * 30), ("h", "chr1", 0, 0, 500, other)]
    g = spark.createDataFrame(rows, "genome_name string, sequence string, offset bigint, range_start bigint, range_end bigint, bases string")
    reads = [(1, one[300:360]), (2, repeat[20:80]), (3, foreign), (4, ""), (5, None)]
    return g, spark.createDataFrame([(i, x, None) for i, x in reads], "read_id bigint, sequence string, quality array<int>")


def test_every_read_has_a_reason(spark):
    g, r = _repeats(spark)
    spec = IndexSpec(12, 4, cutoff=20)
    want = {(1, "g"): "aligned", (2, "g"): "repeats_only"}
    for ix in (build_index(g, spec), genome_words(g, spec)):
        got = {(x.read_id, x.genome_name): x.reason for x in map_reads(r, g, ix, spec).collect()}
        assert got == {(i, n): want.get((i, n), "no_seeds") for i in range(1, 6) for n in "gh"}
    _, st = seed_reads(r.select("read_id", "sequence"), genome_words(g, spec), spec)
    x = {(x.read_id, x.genome_name): x for x in st.collect()}
    hot = x[2, "g"]
    assert len(x) == 10 and hot.num_useless == hot.num_raw_seeds > 20 * 10 and hot.num_clumps == 0
    assert x[1, "g"].num_useless == 0 and x[1, "g"].num_raw_seeds > 0 and x[3, "g"].num_raw_seeds == 0


@pytest.mark.parametrize("seed", range(4))
def test_exact_alignment_is_the_best(seed):
    rng = np.random.default_rng(seed)
    ref = "".join(rng.choice(list("ACGT"), 60))
    read, a = ref[12:45], al.Aligner()
    for q in (None, [int(x) for x in rng.integers(5, 41, len(read))]):
        got, want = al.align_exact(read, q, ref, a), al.align(read, q, ref, a)
        assert got[0] == pytest.approx(want[0]) and got[1:] == want[1:]
    assert al.align_exact(read, [1] * len(read), ref, a) is None and al.align_exact("A" + read[1:10] + "N", None, ref, a) is None
    assert al.align_exact("ACAC", None, "TTACACACTT", a)[1:3] == al.align("ACAC", None, "TTACACACTT", a)[1:3]


def test_round_trip_of_3000(spark):
    g = random_genome(spark, "sim", 200_000).cache()
    r = sample_reads(g, 200_000, n=3000, gaps=0.002).cache()
    spec = IndexSpec(12, 4, cutoff=200)
    m = map_reads(r.select("read_id", "sequence", "quality"), g, build_index(g, spec), spec).join(r.select("read_id", "start", "strand"), "read_id")
    right = (F.abs(F.col("start_pos") - F.col("start")) <= 3) & ((F.col("aln_length") < 0) == (F.col("strand") == "-"))
    got = m.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(right, 1)).alias("at_origin"))
    assert {tuple(x) for x in got.collect()} == {("aligned", 2892, 2892), ("no_seeds", 108, 0)}


def test_every_row_is_mapped(spark, small):
    from readlake.plans import catalog

    n = spark.read.parquet(f"{small}/seq_read.parquet").count()
    got = {x.reason: x for x in catalog.map_simulated_reads(spark, small).collect()}
    assert sum(x.n for x in got.values()) == n and 0.8 * n < got["aligned"].at_origin <= got["aligned"].n


def _odd(spark):
    """Contigs side by side, with repeats, ambiguity codes and lower case; reads of both strands with changes, at ends, with Ns, empty, null and hot ones."""
    rng = np.random.default_rng(11)
    turned = str.maketrans("ACGT", "TGCA")
    bases = lambda n: "".join(rng.choice(list("ACGT"), n))
    repeat, texts = bases(50), [bases(900), bases(40), bases(9), bases(300).lower()]
    texts += [repeat * 30, texts[0][200:400] + bases(60), texts[0][100:160] + "N" + texts[0][161:230] + "R" + texts[0][231:300], "N" * 5 + bases(70), texts[0][300:420] + texts[0][310:430]]
    rows, offset = [], 0
    for i, x in enumerate(texts):
        rows.append(("g", f"s{i % 5}", offset, 1000 * i, 1000 * i + len(x), x))
        offset += len(x) + 1
    rows += [("other", "s0", 0, 0, 900, texts[0]), ("g", "s9", offset + 5000, 7, 7, None)]
    c = spark.createDataFrame(rows, "genome_name string, sequence string, offset bigint, range_start bigint, range_end bigint, bases string")
    reads = [None, "", "ACGT", "N" * 40, bases(60), repeat[:45], texts[1], texts[1][:30] + bases(30), bases(20) + texts[0][:50], "N" + texts[0][600:640] + "NN" + texts[0][642:680]]
    for _ in range(150):
        x = texts[int(rng.integers(0, len(texts)))].upper()
        n = int(rng.integers(14, 90))
        i = int(rng.integers(0, max(1, len(x) - n)))
        s = list(x[i : i + n].replace("N", "A").replace("R", "G"))
        for _ in range(int(rng.integers(0, 4))):
            at, how = int(rng.integers(0, len(s))), rng.random()
            s[at : at + 1] = [str(rng.choice(list("ACGT")))] if how < 0.5 else [s[at], "G"] if how < 0.75 else s[at : at + 1] if len(s) < 3 else []
        s = "".join(s)
        reads.append(s.translate(turned)[::-1] if rng.random() < 0.5 else s.lower() if rng.random() < 0.1 else s)
    qualities = [None if s is None or rng.random() < 0.2 else rng.integers(2, 41, len(s)).tolist() for s in reads]
    return c, spark.createDataFrame([(i * 7919 - 100, *x) for i, x in enumerate(zip(reads, qualities, strict=True))], "read_id bigint, sequence string, quality array<int>")


@pytest.mark.parametrize(("k", "stride", "cutoff", "least", "threshold"), [(16, 4, 10, 16, None), (11, 1, None, 18, 3), (31, 2, None, 33, None)])
def test_mapping_of_whole_tables(spark, monkeypatch, k, stride, cutoff, least, threshold):
    from readlake.mapping import bulk

    for name, value in (("BASES", 300), ("WORDS", 100), ("MATCHES", 50), ("ROWS", 4000), ("HELD", 1000), ("BATCH", 7)):
        monkeypatch.setattr(bulk, name, value)
    c, r = _odd(spark)
    spec = IndexSpec(k, stride, cutoff=cutoff)
    own = c.where("genome_name = 'g' and bases is not null")
    aligner = None if k == 16 else al.Aligner(gap_open=0.001, gap_extension=0.05, max_penalty_per_nuc=2.0)
    rows = lambda m: {x.read_id: tuple(x) for x in m.collect()}
    want = rows(map_reads(r, own, genome_words(own, spec).cache(), spec, aligner, least, repeat_threshold=threshold))
    got = rows(bulk.map_all(r, c, "g", spec, aligner, least, threshold, chunk=64))
    assert len(want) == r.count() and got == want
    assert {x[-1] for x in want.values()} >= {"aligned", "no_seeds"} | ({"repeats_only"} if k == 16 else set()) | ({"too_many_seeds"} if threshold else set())
    if k == 16:
        assert bulk.map_all(r.limit(0), c, "g", spec).count() == 0 and {x.reason for x in bulk.map_all(r, c, "none", spec).collect()} == {"no_seeds"}
    with pytest.raises(ValueError, match="words of 32"):
        bulk.map_all(r, c, "g", IndexSpec(32))


def test_mapping_writes_no_words(spark, small, monkeypatch):
    from readlake.mapping import bulk
    from readlake.plans import catalog

    monkeypatch.setattr(catalog, "durable", lambda df: pytest.fail("a table was written"))
    monkeypatch.setattr("readlake.mapping.index.durable", lambda df: pytest.fail("a table was written"))
    monkeypatch.setattr("readlake.mapping.index.read_words", lambda *a: pytest.fail("words were made rows"))
    assert sum(x.n for x in catalog.map_simulated_reads(spark, small).collect()) == spark.read.parquet(f"{small}/seq_read.parquet").count()
    # 60 bases have 90 words of both strands
    rng = np.random.default_rng(1)
    r = spark.createDataFrame([(i, "".join(rng.choice(list("ACGT"), 60))) for i in range(2000)], "read_id bigint, sequence string").coalesce(1)
    blocks = r.mapInArrow(bulk.read_stretches(16, 4), bulk.BLOCK)
    assert blocks.agg(F.sum(F.length("block"))).first()[0] < 2000 * 140


def test_many_alignments_at_once():
    from readlake.mapping import bulk

    rng = np.random.default_rng(2)
    refs = ["".join(rng.choice(list("ACGTN"), int(n), p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in rng.integers(30, 80, 100)]
    reads = ["".join(c for j, c in enumerate(x[5:-5]) if j != i % 9).replace("N", "A")[i % 4 :] + "ACG"[: i % 3] for i, x in enumerate(refs)] + [""]
    refs.append("ACGT")
    for a in (al.Aligner(max_penalty_per_nuc=1.0), al.Aligner(gap_open=0.001, gap_extension=0.05, ds_deamination=0.02)):
        limits = np.array([a.max_penalty_per_nuc * len(x) for x in reads])
        got = bulk.align_many([al.codes(x) for x in reads], [al.codes(x) for x in refs], bulk.penalties(a.matrices()[0], np.array([30]))[0], al.phred(a.gap_open or a.gap_extension), al.phred(a.gap_extension), limits)
        for x, ref, limit, y in zip(reads, refs, limits, got, strict=True):
            want = al.align(x, None, ref, a, limit)
            assert (y is None) == (want is None) and (y is None or (y[0] == pytest.approx(want[0]) and y[1:] == want[1:]))


def test_lookup_of_shorter_words(spark):
    ix = build_index(contigs(spark, [("g", 100, "ACGTTGCATC")]), IndexSpec(8, 1, 0))
    r = spark.createDataFrame([(1, "CGTTGA"), (2, "CAACG"), (3, "GGGGGG")], "read_id bigint, sequence string")
    assert lookup(r, ix, IndexSpec(8, 1)).count() == 0
    got = {(x.read_id, x.pos, x.offset) for x in lookup(r, ix, IndexSpec(8, 1), wordsize=5).collect()}
    assert got == {(1, 101, 1), (2, 101, -5)}
    with pytest.raises(ValueError, match="words of 9"):
        lookup(r, ix, IndexSpec(8, 1), wordsize=9)


def test_seeds_are_checked(spark):
    g, _ = _repeats(spark)
    b = g.where("genome_name = 'g'").first().bases[400:432]
    x = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in (10, 22) else c for i, c in enumerate(b))
    back = x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    r = spark.createDataFrame([(1, x, None), (2, back, None)], "read_id bigint, sequence string, quality array<int>")
    spec = IndexSpec(12, 4)
    ix = build_index(g, spec).cache()
    # a perfect stretch of 11 bases at most, of 22 with one mismatch
    for allowed, reason in ((0, "bad_alignment"), (1, "aligned")):
        m = map_reads(r, g, ix, spec, least=16, mismatches=1, seed_mismatches=allowed).where("genome_name = 'g'").collect()
        assert {(y.read_id, y.reason) for y in m} == {(1, reason), (2, reason)}


def test_seeds_of_a_hot_locus(spark, tmp_path):
    from readlake.plans import catalog

    text = "".join(np.random.default_rng(3).choice(list("ACGT"), 40))
    spark.createDataFrame([(i, text) for i in range(60)], "read_id bigint, sequence string").write.parquet(str(tmp_path / "seq_read.parquet"))
    got = {(r.read_id, r.ref_pos // 1000) for r in catalog.combined_seeds(spark, str(tmp_path)).where("query_pos > 0").collect()}
    assert got == {(i, j) for i in range(60) for j in range(60)}


def test_match_probability():
    assert match_probability(1.0, 12, 12) == 1.0 and match_probability(0.5, 2, 2) == 0.25
    assert match_probability(0.5, 2, 3) == pytest.approx(3 / 8) and match_probability(0.5, 2, 2, mismatches=1) == pytest.approx(0.75)
    assert match_probability(0.98, 12, 24) > match_probability(0.98, 12, 24, stride=4)


CONFIG = """
# two policies
policy { minlength: 30  maxlength: 60
  use_compact_index { name: "g" wordsize: 12 stride: 2 cutoff: 500 } min_seed_len: 14 }
policy { minlength: 61 use_compact_index { name: "g" wordsize: 16 stride: 4 allow_near_perfect: 1 } repeat_threshold: 50 max_mismatches_in_seed: 1 }
policy { name_pattern: "skip*" maxlength: 20 }
aligner { rate_of_transversions: 0.003 gap_extension_rate: 0.005 max_mapq: 200 }
trim_right: "GATCGGAAGAGC"
"""


def test_mapping_by_policies_of_a_configuration(spark):
    from readlake.plans.pipeline import aligner_of, parse_config, policies_of, trimmer_of

    bases = "".join(np.random.default_rng(8).choice(list("ACGT"), 4000))
    c = spark.createDataFrame([("g", "s", 0, 0, 4000, bases)], "genome_name string, sequence string, offset bigint, range_start bigint, range_end bigint, bases string")
    long_ = bases[1000:1080]
    near = long_[:40] + ("A" if long_[40] != "A" else "C") + long_[41:]
    rows = [(1, "a", bases[100:140]), (2, "b", long_), (3, "skip1", bases[5:20]), (4, "d", None), (5, "e", near), (6, "f", bases[200:225]), (7, "g", "T" * 40)]
    r = spark.createDataFrame([(*x, None) for x in rows], "read_id bigint, seqid string, sequence string, quality array<int>")
    config = parse_config(CONFIG)
    a = aligner_of(config)
    assert (a.transversions, a.gap_extension, a.max_mapq, aligner_of({}).max_mapq) == (0.003, 0.005, 200, 254) and trimmer_of(config)
    p = policies_of(spark, config)
    got = {x.read_id: (x.reason, x.start_pos, x.aln_length) for x in map_by_policy(r, c, p, a).collect()}
    none = ("no_policy", None, None)
    assert got == {1: ("aligned", 100, 40), 2: ("aligned", 1000, 80), 3: none, 4: none, 5: ("aligned", 1000, 80), 6: none, 7: ("no_seeds", None, None)}
    assert {x.reason for x in map_by_policy(r, c, p.limit(0), a).collect()} == {"no_policy"}
    assert map_by_policy(r.limit(0), c, p, a).count() == 0
