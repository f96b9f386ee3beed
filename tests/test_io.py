"""Sources and sinks: hand-made files, and round trips."""

import bz2
import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from test_records import h, rec

from readlake.functions.hits import best_hit
from readlake.operators import contigs, transforms
from readlake.plans.pipeline import Branch, Pipeline, parse_config
from readlake.sinks import describe, likelihood, text
from readlake.sources import native, parsers, reader


def rows(df):
    return {r.read.seqid: r for r in df.collect()}


FASTQ = "@a first\n;more\nACG\nTN\n+a\nIIII@\n@b\nAC\n+\n30 -4\n>c no quality\nSQ ACGT\n@d\nACGT\n+\n@III\n@e\nA\n+\n!\n"


@pytest.mark.parametrize("pack", [None, gzip.compress, bz2.compress])
def test_fastq(spark, tmp_path, pack):
    p = tmp_path / "x.fq"
    p.write_bytes(FASTQ.encode() if pack is None else pack(FASTQ.encode()))
    assert reader.sniff(str(p)) == "fastq"
    got = rows(reader.read(spark, str(p)))
    assert set(got) == set("abcde")
    assert got["a"].read.description == "first more" and got["a"].read.sequence == "ACGTN" and got["a"].read.quality == [40, 40, 40, 40, 31]
    assert got["b"].read.quality == [30, -4] and got["c"].read.sequence == "ACGT" and got["c"].read.quality is None
    assert got["d"].read.quality == [31, 40, 40, 40] and got["e"].read.quality == [0]
    assert rows(reader.read(spark, str(p), solexa=True))["b"].read.quality == [30, 1]


def test_fastq_in_ranges(spark, tmp_path):
    """Whatever the byte ranges, each record comes once; qualities begin with @ on purpose."""
    p = tmp_path / "x.fq"
    p.write_text("".join(f"@r{i}\n{'ACGT' * (i % 9 + 1)}\n+\n{'@IH+' * (i % 9 + 1)}\n" for i in range(300)))
    for split in (37, 100, 1000):
        reader.register(spark)
        got = [r.seqid for r in spark.read.format("readlake-fastq").options(path=str(p), splitBytes=str(split)).load().collect()]
        assert sorted(got) == sorted(f"r{i}" for i in range(300))


def test_patterns_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.fa").write_text(f">s{i}\nACGT\n")
    (tmp_path / "other").write_text("?")
    assert set(rows(reader.read(spark, str(tmp_path / "*.fa")))) == {"s0", "s1", "s2"}
    with pytest.raises(ValueError, match="unknown kind"):
        reader.read(spark, str(tmp_path / "other"))


SAM = [
    "@SQ\tSN:c\tLN:100", "f\t0\tc\t11\t37\t3M1I\t*\t0\t0\tACG.\tIIII\tAS:i:5\tUQ:i:7", "r\t16\tc\t21\t255\t1S3M\t*\t0\t0\tAACC\t!IIH\tAS:i:5", "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*",
    "bad\t0\tc\t1\t1\t2M\t*\t0\t0\tA?\t*", "short\t0",
]


def test_sam(spark, tmp_path):
    p = tmp_path / "x.sam"
    p.write_text("\n".join(SAM) + "\n")
    assert reader.sniff(str(p)) == "sam"
    got = rows(reader.read(spark, str(p), genome="G.dna"))
    assert set(got) == {"f", "r", "u"}
    f, r = got["f"].hit[0], got["r"].hit[0]
    assert (f.genome_name, f.start_pos, f.aln_length, f.score, f.map_quality) == ("g", 10, 3, 7, 37) and got["f"].read.sequence == "ACGN"
    assert (r.aln_length, r.map_quality, [tuple(x) for x in r.cigar]) == (-3, None, [("M", 3), ("S", 1)]) and got["r"].read.sequence == "GGTT" and got["r"].read.quality == [39, 40, 40, 0]
    assert got["u"].hit == [] and got["u"].read.quality is None
    out = {x.value for x in text.sam_lines(reader.read(spark, str(p), genome="g")).collect()}
    assert out == {SAM[1].replace("\tAS:i:5", "").replace("ACG.", "ACGN").replace("3M1I", "3M1S"), "r\t16\tc\t21\t254\t1S3M\t*\t0\t0\tAACC\t!IIH\tUQ:i:5", SAM[3]}


def _bam(tmp_path):
    def record(name, flag, pos, mapq, cigar, seq, qual, tags=b""):
        packed = bytes("=ACMGRSVTWYHKDBN".index(a) << 4 | "=ACMGRSVTWYHKDBN".index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for o, n in cigar) + packed + bytes(qual) + tags
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 99)
    data += record("f", 0, 10, 37, [("M", 3)], "ACG", [40, 40, 1], b"ASC\5" + b"XXZabc\0" + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"UQC\7")
    data += record("r", 16, 20, 255, [("S", 1), ("M", 3)], "AACC", [255] * 4) + record("u", 4, -1, 0, [], "N", [3])
    p = tmp_path / "x.bam"
    p.write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    return p


def test_bam(spark, tmp_path):
    p = _bam(tmp_path)
    assert reader.sniff(str(p)) == "bam"
    got = rows(reader.read(spark, str(p), genome="g"))
    f, r = got["f"].hit[0], got["r"].hit[0]
    assert (f.sequence, f.start_pos, f.aln_length, f.score, f.map_quality) == ("c", 10, 3, 7, 37) and got["f"].read.quality == [40, 40, 1]
    assert (r.aln_length, r.map_quality, [tuple(x) for x in r.cigar]) == (-3, None, [("M", 3), ("S", 1)]) and got["r"].read.sequence == "GGTT" and got["r"].read.quality is None
    assert got["u"].hit == []


def test_sff(spark, tmp_path):
    head = struct.pack(">4sIQIIHHHB", b".sff", 1, 0, 0, 2, 40, 4, 3, 1) + b"\0" * 9
    body = b""
    for name, clips in ((b"one", (2, 4, 0, 0)), (b"two2", (0, 0, 3, 5))):
        hl = (16 + len(name) + 7) // 8 * 8
        body += struct.pack(">HHIHHHH", hl, len(name), 5, clips[0], clips[1], clips[2], clips[3]) + name + b"\0" * (hl - 16 - len(name))
        data = b"\0" * 6 + b"\1" * 5 + b"ACGTA" + bytes([30, 31, 32, 33, 34])
        body += data + b"\0" * (-len(data) % 8)
    p = tmp_path / "x.sff"
    p.write_bytes(head + body)
    assert reader.sniff(str(p)) == "sff"
    got = rows(reader.read(spark, str(p)))
    assert (got["one"].read.trim_left, got["one"].read.trim_right, got["two2"].read.trim_left, got["two2"].read.trim_right) == (1, 4, 2, 5)
    assert got["one"].read.quality == [30, 31, 32, 33, 34]


def _field(n, v):
    def vi(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    if isinstance(v, int):
        return vi(n << 3) + vi(v)
    return vi(n << 3 | 2) + vi(len(v)) + v


def test_native(spark, tmp_path):
    zig = lambda x: x << 1 if x >= 0 else (-x << 1) - 1
    read = _field(1, b"id") + _field(2, b"ACGT") + _field(14, bytes([1, 2, 3, 4])) + _field(99, b"unknown")
    hit = _field(1, b"G.dna") + _field(2, b"c") + _field(3, 7) + _field(4, zig(-4)) + _field(5, zig(12)) + _field(7, bytes([4 << 4])) + _field(8, zig(33))
    new = _field(4, _field(1, read) + _field(3, hit) + _field(9, 2) + _field(4, _field(15, b"g") + _field(1, 3)))
    old_hit = _field(2, b"c") + _field(3, 7) + _field(4, zig(4)) + _field(5, zig(23)) + _field(7, bytes([3, 129, 193])) + _field(8, b"K")
    old = _field(2, _field(1, b"old") + _field(2, b"ACGT") + _field(6, old_hit) + _field(7, zig(5)))
    head, foot = _field(1, _field(1, b"version")), _field(3, _field(1, 0))
    (tmp_path / "plain").write_bytes(b"OLD0" + head + new + old + foot)
    pack = lambda kind, b, f: struct.pack("<II", len(b), kind << 28 | len(f(b))) + f(b)
    lz = lambda b: bytes([len(b[:20]) - 1]) + b[:20] + b"".join(bytes([len(b[i : i + 20]) - 1]) + b[i : i + 20] for i in range(20, len(b), 20))
    (tmp_path / "chunks").write_bytes(b"OLD1" + pack(0, head, lambda b: b) + pack(2, new, zlib.compress) + pack(3, old, bz2.compress) + pack(1, new, lz) + pack(0, foot, lambda b: b) + b"\0" * 8)
    assert reader.sniff(str(tmp_path / "chunks")) == "native"
    assert reader.read(spark, str(tmp_path / "chunks")).count() == 3
    got = rows(reader.read(spark, str(tmp_path / "plain")))
    x = got["id"]
    assert x.read.quality == [1, 2, 3, 4] and x.nmembers == 2 and x.aln_stats[0].reason == "bad_alignment"
    assert (x.hit[0].genome_name, x.hit[0].aln_length, x.hit[0].score, x.hit[0].map_quality, [tuple(c) for c in x.hit[0].cigar]) == ("g", -4, 12, 33, [("M", 4)])
    y = got["old"].hit[0]
    assert (y.genome_name, y.score, y.map_quality, [tuple(c) for c in y.cigar]) == ("k", 10, 5, [("M", 3), ("I", 1), ("D", 1)])
    assert native.layout(b"ABCD\nmore text, which is no store") is None and native.layout(b"short") is None
    # a match that repeats what it writes: 'ab' then six more from two back
    assert native.unpack_lz(bytes([1]) + b"ab" + bytes([4 << 5, 1]), 8) == b"abababab"


def test_genome(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">c1 first\nNNACGT\nACNNGT\nNNNNAC\n>c2\nACR\n")
    d = reader.read_genome(spark, str(p), "g", maxn=2)
    got = sorted((r.sequence, r.offset, r.range_start, r.range_end, r.bases) for r in d.collect())
    assert got == [("c1", 0, 2, 12, "ACGTACNNGT"), ("c1", 11, 16, 18, "AC"), ("c2", 14, 0, 3, "ACR")]
    import io

    pieces = list(parsers.genome_fasta(io.BytesIO(b">c\n" + b"ACGTA\n" * 10), "g", piece=12))
    assert [(x["offset"], x["range_start"], x["contig"]) for x in pieces] == [(0, 0, 0), (15, 15, 0), (30, 30, 0), (45, 45, 0)]
    assert reader.contig_table(d).where("sequence = 'c1'").count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "regions").write_text("#bin\tchrom\tstart\tend\trest\n1\tc\t5\t9\tx\n2\td\t1\t2\ty\n")
    assert [tuple(r) for r in reader.read_regions(spark, str(tmp_path / "regions")).collect()] == [("c", 5, 9, "x"), ("d", 1, 2, "y")]
    (tmp_path / "chain").write_text("chain 100 tc 1000 + 100 200 qc 500 + 50 140 7\n40 10 5\n50\n")
    assert {(r.t_start, r.t_end, r.q_start, r.q_end) for r in reader.read_chains(spark, str(tmp_path / "chain")).collect()} == {(100, 140, 50, 90), (150, 200, 95, 145)}
    (tmp_path / "snps.txt").write_text("#h\nA\tchr1\t+\t5\tC\tchr2\t-\t9\t\tF1\tmore\tstill\n")
    r = reader.read_sites(spark, str(tmp_path / "snps.txt")).first()
    assert (r.h_base, r.h_pos, r.c_strand, r.c_pos, r.out_base, r.flags, r.rest) == ("A", 5, "-", 9, None, "F1", "more\tstill")
    (tmp_path / "indels.txt").write_text("insert\tchr1\t+\t5\t7\tchr2\t-\t9\t9\tAC\tF1\tmore\n")
    r = reader.read_sites(spark, str(tmp_path / "indels.txt")).first()
    assert (r.kind, r.h_end, r.c_end, r.sequence, r.flags, r.rest) == ("insert", 7, 9, "AC", "F1", "more")
    (tmp_path / "truth").write_text("chr1\t+\t5\t3\tACG\n")
    assert tuple(reader.read_truth(spark, str(tmp_path / "truth")).first()) == ("chr1", "+", 5, 3, "ACG")


@pytest.fixture(scope="module")
def written(spark):
    return rec(
        spark,
        [
            (1, "a", "ACGT" * 20, [40] * 80, None, None, [h(p=10, n=80, cigar="80M", mq=3, aln_ref="ACGA" * 20, aln_qry="ACGT" * 20)]), (2, "b", "AC", None, None, 1, []),
            (3, "c", "ACG", [0, 1, 99], None, None, [h(p=3, n=-3, cigar="2M1I", score=None)]), (4, None, "A", None, None, None, []), (5, "e", "ACG", None, None, None, [h(cigar="9M")]),
        ],
    )


def test_writers(spark, written):
    sam = [x.value for x in text.sam_lines(written).collect()]
    assert len(sam) == 3 and any(x.startswith("c\t16\tg".replace("g", "c")) and "\t1S2M\t" in x and x.endswith("CGT\t~\"!") for x in sam)
    fq = {x.value for x in text.fastq_lines(written).collect()}
    assert any(x == "@c\nACG\n+\n!\"~" for x in fq) and len(fq) == 2
    assert any(x.split("\n")[1:3] == [("ACGT" * 20)[:50], ("ACGT" * 20)[50:]] for x in fq)
    assert {x.value for x in text.fastq_lines(written, missing="fasta").collect()} >= {">b\nAC"}
    fa = text.fasta_alignment_lines(written).first().value
    assert fa.startswith(">c 10+89\nACGA") and "\n>a\n" in fa
    assert {tuple(r) for r in text.table_lines(written).collect()} == {(80, 1, 3), (3, 0, 9999), (3, 1, 9999)}
    t = next(x.value for x in text.text_lines(written).collect() if 'seqid: "a"' in x.value)
    assert "    cigar: 80M" in t and "CNS: *** ***" in t and t.count("REF: ") == 2 and 'quality:  "IIII' in t
    assert text.sam_header([("c", 9)], "coordinate") == ["@HD\tVN:1.0\tSO:coordinate", "@SQ\tSN:c\tLN:9"]


def test_files_of_writers(spark, tmp_path, written):
    text.write_lines(text.sam_lines(written), str(tmp_path / "sam"), text.sam_header([("c", 100)]))
    back = rows(reader.read(spark, str(tmp_path / "sam"), genome="g"))
    assert back["a"].read.sequence == "ACGT" * 20 and back["c"].read.sequence == "ACG" and back["c"].read.quality == [0, 1, 93]
    text.write_lines(text.fastq_lines(written), str(tmp_path / "fq"))
    assert rows(reader.read(spark, str(tmp_path / "fq")))["a"].read.quality == [40] * 80
    text.write_records(written, str(tmp_path / "store"), 75)
    assert reader.sniff(str(tmp_path / "store")) == "parquet" and reader.read(spark, str(tmp_path / "store")).count() == 5
    assert describe.describe(spark, str(tmp_path / "store"))["rows"] == 5
    m = describe.substitution_table(describe.Aligner())
    assert len(m) == 4 and all(m[i][i] < 1 < m[i][j] for i in range(4) for j in range(4) if i != j)


def test_wiggle_and_likelihoods(spark, tmp_path):
    d = rec(spark, [(1, "a", "ACGT", [40] * 4, None, None, [h(p=10, cigar="4M", n=4, mq=30)]), (2, "b", "GTA", [40] * 3, None, None, [h(p=12, cigar="3M", n=3, mq=30)])])
    c = contigs.duct_tape(d, "t")
    w = text.wiggle_lines(c).first().value
    assert w == "fixedStep\tchrom=c\tstart=11\tstep=1\n1\n1\n2\n2\n1\n"
    ref = transforms.reference_chunks(spark.createDataFrame([("g", "c", 0, "A" * 10 + "ACGTA")], "genome_name string, sequence string, range_start bigint, bases string"))
    g = likelihood.likelihood_rows(c, ref)
    b = bytes(g.first().blob)
    n = struct.unpack_from("<i", b)[0]
    assert b[4 : 3 + n].decode() == "t_c_10" and struct.unpack_from("<i", b, 4 + n)[0] == 5
    first = b[8 + n : 24 + n]
    assert first[0] == 1 and first[1] == 30 and struct.unpack_from("<I", first, 12)[0] >> 8 == 1 and len(b) == 8 + n + 5 * 16
    likelihood.write_likelihoods(g, str(tmp_path / "glz"))
    (f,) = (tmp_path / "glz").iterdir()
    assert gzip.open(f).read()[4:] == b


def test_pipeline(spark, tmp_path, written):
    text.write_records(written, str(tmp_path / "in"))
    p = Pipeline([(str(tmp_path / "in"), [("filter-mapq", {"least": 5}), ("require-hit", {})])], [Branch([("sort-name", {})], "sam", str(tmp_path / "out")), Branch([], "stats", str(tmp_path / "stats"))])
    assert p.explain().splitlines() == [f"read {tmp_path}/in | filter-mapq(least=5) | require-hit", "concat", f"  sort-name -> sam {tmp_path}/out", f"  as is -> stats {tmp_path}/stats"]
    p.run(spark)
    assert spark.read.json(str(tmp_path / "stats")).first().total == 2
    with pytest.raises(ValueError, match="unknown operator"):
        Pipeline([("x", [("nothing", {})])], [])
    assert parse_config('a: 1 # c\nb { c: "x y" c: 2.5 } b { d: true }') == {"a": 1, "b": [{"c": ["x y", 2.5]}, {"d": True}]}


def test_best_hit_of_empty(spark, written):
    assert written.where(best_hit(F.col("hit")).isNull()).count() == 2


def test_ranges_against_whole_files():
    """Wrapped records whose qualities begin with header marks or are digits only: any byte ranges give the records of the file."""
    import io
    import random

    rng = random.Random(1)
    wrap = lambda x: "\n".join(x[k : k + 50] for k in range(0, len(x), 50))
    for _ in range(60):
        b = ""
        for i in range(rng.randint(1, 60)):
            n = rng.randint(1, 130)
            kind = rng.choice(["@>+;ABC!5", "5-", "56", "@5"])
            b += f"@r{i} d\n{wrap(''.join(rng.choice('ACGTN') for _ in range(n)))}\n+\n{wrap(''.join(rng.choice(kind) for _ in range(n)))}\n"
        data, step = b.encode(), rng.randint(5, 400)
        got = [r for a in range(0, len(data), step) for r in parsers.fastq_range(io.BytesIO(data), a, min(len(data), a + step), 33, False)]
        assert got == list(parsers.fastq_lines(data.split(b"\n")[:-1]))


def test_fastq_streams_over_its_buffer():
    entries = [[b"@r%d" % i, b"ACGT", b"+", b"@III"] if i % 3 else [b">c%d" % i, *[b"ACGTACGT"] * (i % 7)] for i in range(3000)]
    lines = [x for e in [*entries[:40], [b">long", *[b"A" * 50] * 9000], *entries[40:]] for x in e]
    want, i = [], 0
    while i < len(lines):
        r, i = parsers._record(lines, i, 33, False)
        if r:
            want.append(r)
    assert list(parsers.fastq_lines(iter(lines))) == want and len(want) == 3001
