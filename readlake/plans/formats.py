"""Queries of the file formats, of textual alignments and of word expansions: what is written comes back, what is computed equals its SQL.

Files go to the shared folder of spark.checkpoint.dir, written by all tasks, a part each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions import phred as ph
from readlake.functions import seq as sq
from readlake.functions.hits import glf_code
from readlake.mapping.index import index_sensitivity
from readlake.operators import chains, combine, filters, sorting, stats, transforms
from readlake.plans.catalog import _CONTIGS, _RC, BASE, SQL as RECORD_SQL, _contigs, flat, hits, kept, reads, recs
from readlake.plans.pipeline import Branch, Pipeline
from readlake.plans.problems import table
from readlake.schema import records
from readlake.session import checkpoint_dir
from readlake.sinks import describe
from readlake.sinks import text as sinks
from readlake.sources import reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _out(s: SparkSession, kind: str) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


# --- records and alignments in files -------------------------------------------------------------------------------------------------------

_ENDS = "list_aggregate(list_transform(range(1, len(cigar) + 1), lambda i: cigar[i].len::varchar || case when cigar[i].op = 'I' and (i = 1 or i = len(cigar)) then 'S' else cigar[i].op end), 'string_agg', '')"


@query(
    f"""{BASE} select seqid, translate(upper(r.sequence), '.', 'N') as sequence, s as chrom, p as start_pos, case when h.l < 0 then -span else span end::int as aln_length, score, least(254, coalesce(mq, 254))::int as map_quality,
 {_ENDS} as cigar, list_sum(list_transform(q, lambda x: least(x, 93)))::bigint as quality
from r join h on h.read_id = r.read_id where seqid is not null and ql = length(r.sequence) and s is not null and p is not null and h.l is not null and regexp_full_match(upper(r.sequence), '[ACGTN.]+')"""
)
def sam_round_trip(s, d):
    """Hits written as gzipped SAM with a header and read back."""
    ok = F.filter("hit", lambda h: h["sequence"].isNotNull() & h["start_pos"].isNotNull() & h["aln_length"].isNotNull())
    out = _out(s, "sam")
    sinks.write_lines(sinks.sam_lines(recs(s, d).withColumn("hit", ok).where("size(hit) > 0")), out, sinks.sam_header([("chr1", 1000)]), compression="gzip")
    r = reader.read(s, out, genome="vor4").where("size(hit) = 1").select("read", F.col("hit")[0].alias("h"))
    return r.select(
        "read.seqid", "read.sequence", F.col("h.sequence").alias("chrom"), "h.start_pos", "h.aln_length", "h.score", "h.map_quality", cg.to_text(F.col("h.cigar")).alias("cigar"),
        F.aggregate("read.quality", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("quality"),
    )


@query("select read_id, case when read_id % 4 = 0 then 'columns' when read_id % 4 = 1 then 'numbers' when read_id % 4 = 2 then 'cigar' else 'sequence' end as reason from seq_read")
def sam_rejects(s, d):
    """Lines that are broken in one of four ways, with their reason."""
    c = lambda n, good, bad: F.when(F.col("read_id") % 4 == n, bad).otherwise(good)
    line = F.concat_ws("\t", F.col("read_id").cast("string"), c(1, "0", "x"), F.lit("chr1"), F.lit("5"), F.lit("9"), c(2, "4M", "4Q"), F.lit("*\t0\t0"), c(3, "ACGT", "AC!T"), F.lit("IIII"))
    line = F.when(F.col("read_id") % 4 == 0, F.regexp_extract(line, r"^(.*)\t", 1)).otherwise(line)
    got = reader.sam_rejects(table(s, d, "seq_read").select(line.alias("value")))
    return got.select(F.split("value", "\t")[0].cast("bigint").alias("read_id"), "reason")


@query(kept())
def store_round_trip(s, d):
    """Records in the engine's own store, told by its first bytes when read."""
    out = _out(s, "store")
    sinks.write_records(recs(s, d), out, level=9)
    return flat(reader.read(s, out))


@query(
    """with x as (select read_id, list_filter(string_split_regex(trim(upper(sequence), 'N-'), '[N-]{3,}'), lambda p: length(p) > 0) as parts from seq_read where regexp_full_match(sequence, '[A-Za-z-]+'))
select read_id::varchar as sequence, len(parts)::bigint as n_contigs, list_sum(list_transform(parts, lambda p: length(p)))::bigint as n_bases from x where len(parts) > 0"""
)
def genome_round_trip(s, d):
    """Reads as sequences of a genome in FastA: contigs are what lies between runs of more than two Ns."""
    out = _out(s, "genome")
    r = table(s, d, "seq_read").where(F.col("sequence").rlike("^[A-Za-z-]+$"))
    sinks.write_lines(r.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" a read\n"), "sequence").alias("value")), out)
    c = reader.contig_table(reader.read_genome(s, out, "reads"))
    return c.groupBy("sequence").agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.col("range_end") - F.col("range_start")).cast("bigint").alias("n_bases"))


@query(f"with {_CONTIGS} select s as chrom, a as start, b as \"end\", g as rest from cc")
def regions_round_trip(s, d):
    out = _out(s, "regions")
    c = _contigs(s, d).select(F.lit("0").alias("bin"), F.col("sequence").alias("chrom"), F.col("range_start").alias("start"), F.col("range_end").alias("end"), F.col("genome_name").alias("rest"))
    c.write.option("sep", "\t").option("header", True).csv(out)
    return reader.read_regions(s, out)


_CHAINS = f"""with {_CONTIGS}, b0 as (select s, o, a, b, (b - a) // 2 as k, case when a % 2 = 0 then '+' else '-' end as st from cc where g = 'vor4' and b - a >= 20),
b1 as (select s, st, a as t, k as n, a + 7 as q, o from b0 union all select s, st, a + k + 3, b - a - k - 3, a + 7 + k + 5, o from b0)"""


@query(
    f"{_CHAINS} select s as t_chrom, t as t_start, t + n as t_end, case when st = '+' then q else 1000000000 - q - n end as q_start, case when st = '+' then q + n else 1000000000 - q end as q_end, st as strand, o as score from b1"
)
def chains_round_trip(s, d):
    """Chain files of two blocks a contig, with gaps on both sides and reverse queries."""
    c = _contigs(s, d).where("genome_name = 'vor4' and range_end - range_start >= 20")
    a, b = F.col("range_start"), F.col("range_end")
    k = F.floor((b - a) / 2).cast("bigint")
    strand = F.when(a % 2 == 0, "+").otherwise("-")
    text = lambda *x: F.concat_ws(" ", *[v.cast("string") for v in x])
    head = F.concat_ws(" ", F.lit("chain"), F.col("offset").cast("string"), "sequence", F.lit("1000000000 +"), text(a, b), "sequence", F.lit("1000000000"), strand, text(a + 7, b + 9), F.lit("1"))
    out = _out(s, "chains")
    sinks.write_lines(c.select(F.concat_ws("\n", head, text(k, F.lit(3), F.lit(5)), text(b - a - k - 3), F.lit("")).alias("value")), out)
    return chains.blocks_from_lines(reader.read_lines(s, out)).select("t_chrom", "t_start", "t_end", "q_start", "q_end", "strand", "score")


@query(f"{BASE} select s as h_chrom, case when l < 0 then '-' else '+' end as h_strand, p as h_pos, p + 7 as c_pos, 'G' as out_base, 'CpG' as flags, 'AC' || chr(9) || '30,20' || chr(9) || 'T' || chr(9) || '5' as rest from h where s is not null and p is not null and l is not null")
def sites_round_trip(s, d):
    """Starts of hits as an observed site table, written and read back."""
    h = hits(s, d).where("sequence is not null and start_pos is not null and aln_length is not null")
    side = lambda x, base, pos, bases, quals: [F.lit(base).alias(f"{x}_base"), F.col("sequence").alias(f"{x}_chrom"), F.when(F.col("aln_length") < 0, "-").otherwise("+").alias(f"{x}_strand"), pos.alias(f"{x}_pos"), F.lit(bases).alias(f"{x}_bases"), F.array(*map(F.lit, quals)).alias(f"{x}_quals")]
    o = h.select(*side("h", "A", F.col("start_pos"), "AC", [30, 20]), *side("c", "T", F.col("start_pos") + 7, "T", [5]), F.lit("G").alias("out_base"), F.lit("CpG").alias("flags"))
    head, lines = sinks.site_lines(o, "sample")
    out = _out(s, "sites")
    sinks.write_lines(lines, out, head)
    return reader.read_sites(s, out, indels=False).select("h_chrom", "h_strand", "h_pos", "c_pos", "out_base", "flags", "rest")


@query(f"{BASE} select s as chrom, case when h.l < 0 then '-' else '+' end as strand, p as start, abs(h.l)::int as len, r.sequence as seq from h join r on r.read_id = h.read_id where s is not null and p is not null and h.l is not null and r.sequence <> ''")
def truth_round_trip(s, d):
    """Where simulated reads come from, as tab-separated text."""
    h = hits(s, d).where("sequence is not null and start_pos is not null and aln_length is not null").withColumnRenamed("sequence", "chrom")
    j = h.join(table(s, d, "seq_read").where("sequence <> ''").select("read_id", F.col("sequence").alias("seq")), "read_id")
    out = _out(s, "truth")
    value = F.concat_ws("\t", "chrom", F.when(F.col("aln_length") < 0, "-").otherwise("+"), F.col("start_pos").cast("string"), F.abs("aln_length").cast("string"), "seq")
    sinks.write_lines(j.select(value.alias("value")), out)
    return reader.read_truth(s, out)


# --- reference bases and textual alignments ------------------------------------------------------------------------------------------------


@query("select read_id, sequence || 'NNN' as bases from seq_read where regexp_full_match(sequence, '[ACGT]+')")
def fetched_bases(s, d):
    """Bases of a place that is longer than its contig by three, in chunks of 16."""
    r = table(s, d, "seq_read").where(F.col("sequence").rlike("^[ACGT]+$")).select("read_id", "sequence")
    c = r.select(F.lit("reads").alias("genome_name"), F.col("read_id").cast("string").alias("sequence"), F.lit(0).cast("bigint").alias("range_start"), F.col("sequence").alias("bases"))
    p = r.select("read_id", F.lit("reads").alias("genome_name"), F.lit(0).cast("bigint").alias("start"), (F.length("sequence") + 3).cast("bigint").alias("end"), F.col("read_id").cast("string").alias("sequence"))
    return transforms.fetch_bases(p, transforms.reference_chunks(c, 16), "read_id", 16)


_REFERENCE = "ACGTTGCAAC"
_PAIRS = f"""{BASE}, f as (select h.*, r.sequence as sq, r.seqid, r.tr, row_number() over (partition by h.read_id order by hit_id) as k from h join r on r.read_id = h.read_id
  where ql = length(r.sequence) and abs(h.l) = span and span > 0),
g as (select *, case when l < 0 then {_RC.format(f"substr(repeat('{_REFERENCE}', 100), 1, span::int)")} else substr(repeat('{_REFERENCE}', 100), 1, span::int) end as ref from f where k = 1 and span <= 1000),
c as (select read_id, sq, ref, unnest(cigar) as x, unnest(range(1, len(cigar) + 1)) as i from g),
e as (select *, x.op as op, x.len as n, coalesce(sum(case when x.op in ('M', 'X', '=', 'I', 'S') then x.len else 0 end) over w, 0)::int as qat, coalesce(sum(case when x.op in ('M', 'X', '=', 'D', 'N') then x.len else 0 end) over w, 0)::int as rat
  from c window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding)),
t as (select read_id, string_agg(case when op in ('M', 'X', '=', 'D') then substr(ref, rat + 1, n) when op = 'I' then repeat('-', n) else '' end, '' order by i) as ref,
  string_agg(case when op in ('M', 'X', '=', 'I') then substr(upper(sq), qat + 1, n) when op = 'D' then repeat('-', n) else '' end, '' order by i) as qry from e group by 1)"""


def _along(s: SparkSession, d: str) -> DataFrame:
    """Records of one hit, with its alignment to a reference of known bases: the first hit whose cigar fits the read."""
    r = reads(s, d)
    h = hits(s, d).join(r.select("read_id", F.length("sequence").alias("n")), "read_id")
    span = cg.reference_span(F.col("cigar"))
    h = h.where((cg.query_length(F.col("cigar")) == F.col("n")) & (F.abs("aln_length") == span) & (span > 0))
    first = h.groupBy("read_id").agg(F.min_by(F.struct("hit_id", "aln_length", "cigar", "score"), "hit_id").alias("h")).where("abs(h.aln_length) <= 1000")
    own = F.col("read_id").cast("string")
    placed = first.select("h.hit_id", "read_id", F.lit("ref").alias("genome_name"), own.alias("sequence"), F.lit(0).cast("bigint").alias("start_pos"), "h.aln_length", "h.score", F.lit(None).cast("float").alias("evalue"), "h.cigar", F.lit(None).cast("int").alias("map_quality"), F.lit(None).cast("int").alias("taxid"))
    c = first.select(F.lit("ref").alias("genome_name"), own.alias("sequence"), F.lit(0).cast("bigint").alias("range_start"), F.substr(F.lit(_REFERENCE * 100), F.lit(1), F.abs("h.aln_length")).alias("bases"))
    return transforms.add_alignments(records(r, placed).where("size(hit) > 0"), transforms.reference_chunks(c))


@query(f"{_PAIRS} select read_id, ref as aln_ref, qry as aln_qry from t")
def textual_alignments(s, d):
    return _along(s, d).select("read_id", F.col("hit")[0]["aln_ref"].alias("aln_ref"), F.col("hit")[0]["aln_qry"].alias("aln_qry"))


@query(
    f"""{_PAIRS} select '>' || g.read_id::varchar || ' 0' || case when l > 0 then '+' else '-' end || (abs(l) - 1)::varchar || chr(10) || t.ref || chr(10) || '>' || seqid || case when tr is not null then ' adapter cut off' else '' end || chr(10) || qry as value
from t join g on g.read_id = t.read_id where seqid is not null"""
)
def fasta_pairs(s, d):
    """Textual alignments as pairs of FastA entries."""
    return sinks.fasta_alignment_lines(_along(s, d).where("read.seqid is not null"), ["ref"])


@query(
    f"""{_PAIRS}, z as (select unnest(string_split(ref, '')) as ref, unnest(string_split(qry, '')) as qry from t)
select ref, qry, count(*) as n from z where ref in ('A','C','G','T') and qry in ('A','C','G','T') group by 1, 2"""
)
def mismatches_along_cigars(s, d):
    """Base pairs of alignments that follow cigars, gaps and clips."""
    return stats.mismatches(_along(s, d))


@query(
    f"""{BASE}, b as (select read_id, s, p, l, span, row_number() over (partition by read_id order by coalesce(score, 0), hit_id) as k from h where s is not null and p is not null and l is not null and span is not null)
select 'fixedStep' || chr(9) || 'chrom=' || s || chr(9) || 'start=' || (p + 1)::varchar || chr(9) || 'step=1' || chr(10) || rtrim(repeat('2' || chr(10), least(span, length(r.sequence))::int), chr(10)) || chr(10) as value
from b join r on r.read_id = b.read_id where k = 1 and b.l > 0 and length(r.sequence) > 0"""
)
def wiggle_lines(s, d):
    """Depth along each read's best hit, two everywhere."""
    ok = F.filter("hit", lambda h: h["sequence"].isNotNull() & h["start_pos"].isNotNull() & h["aln_length"].isNotNull() & h["cigar"].isNotNull())
    r = recs(s, d).withColumn("hit", ok).where("size(hit) > 0").withColumn("read", F.col("read").withField("depth", F.array_repeat(F.lit(2), F.length("read.sequence"))))
    return sinks.wiggle_lines(r)


@query(
    """with x as (select hit_id, abs(aln_length) % 100 + 1 as m, score % 20 + 1 as i, score from aln_hit where aln_length is not null and score is not null)
select hit_id, floor(score / ln(10) + 0.5)::int as score, (m + 5)::varchar || 'M' || i::varchar || 'I' || (2 * i)::varchar || 'D' as cigar from x"""
)
def upgraded_hits(s, d):
    """Scores and byte cigars of the first format: runs of one kind that meet become one."""
    h = table(s, d, "aln_hit").where("aln_length is not null and score is not null")
    m, i = F.abs("aln_length") % 100 + 1, F.col("score") % 20 + 1
    score, cigar = transforms.upgrade_old(F.col("score"), F.array(m, F.lit(5), i + 128, i + 192, i + 192))
    return h.select("hit_id", score.alias("score"), cg.to_text(cigar).alias("cigar"))


# --- words, order, combination --------------------------------------------------------------------------------------------------------------

_CODES = "case {} when 'U' then 'T' when 'N' then 'ACGT' when 'R' then 'AG' when 'Y' then 'CT' when 'S' then 'CG' when 'W' then 'AT' when 'K' then 'GT' when 'M' then 'AC' when 'B' then 'CGT' when 'D' then 'AGT' when 'H' then 'ACT' when 'V' then 'ACG' else {} end"


def _expand_sql(k: int) -> str:
    out = "select read_id, word, '' as w from p"
    for i in range(1, k + 1):
        c = f"substr(word, {i}, 1)"
        out = f"select read_id, word, w || unnest(string_split({_CODES.format(c, c)}, '')) as w from ({out})"
    return out


@query(f"with p as (select read_id, upper(substr(sequence, 1, 4)) as word from seq_read where regexp_matches(upper(sequence), '^[ACGTURYSWKMBDHVN]{{4}}')) select read_id, w as word from ({_expand_sql(4)})")
def expanded_words(s, d):
    """All words that the first four letters of a read stand for."""
    w = F.upper(F.left("sequence", F.lit(4)))
    return table(s, d, "seq_read").where(w.rlike("^[ACGTURYSWKMBDHVN]{4}$")).select("read_id", F.explode(sq.expand_ambiguity(w)).alias("word"))


@query(
    """with p as (select read_id, substr(sequence, 1, 5) as w from seq_read where regexp_matches(sequence, '^[ACGT]{5}')), i as (select *, unnest(range(1, 6)) as i from p)
select read_id, w as word from p union select read_id, substr(w, 1, (i - 1)::int) || b || substr(w, (i + 1)::int) from i, (values ('A'), ('C'), ('G'), ('T')) v(b)"""
)
def neighbour_words(s, d):
    """The first five letters of a read and all words at one substitution from them."""
    w = F.left("sequence", F.lit(5))
    return table(s, d, "seq_read").where(w.rlike("^[ACGT]{5}$")).select("read_id", F.explode(sq.neighbours(w, 5)).alias("word"))


@query(f"{BASE}, o as (select r.read_id, n, b.read_id is not null as mapped from rr join r on r.read_id = rr.read_id left join h b on b.read_id = rr.read_id and b.best = 1) select mapped, count(*) as n_records, sum(n)::bigint as bases from o group by 1")
def teed_records(s, d):
    """One stream of records to two operators whose results are put together again."""
    n = sq.effective_length(F.col("read"))
    part = lambda mapped: lambda x: x.where((F.size("hit") > 0) == F.lit(mapped)).select(F.lit(mapped).alias("mapped"), n.cast("bigint").alias("n"))
    both = combine.tee(recs(s, d), there=part(True), not_there=part(False))
    return both["there"].unionByName(both["not_there"]).groupBy("mapped").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n").alias("bases"))


_CODE = "case when coalesce({0}, '') = '' then 0 else greatest(0, strpos('-ACMTWYHGRSVKDBN', replace(upper({0}), 'U', 'T')) - 1) end"
_C1, _C2 = _CODE.format("a"), _CODE.format("b")


@query(
    f"""with l as (select read_id, sequence, substr(sequence, 1, 1) as a, substr(sequence, 2, 1) as b from seq_read where length(sequence) > 1), c as (select *, {_C1} as m, {_C2} as n from l)
select read_id, m::int as code, substr('-ACMTWYHGRSVKDBN', m::int + 1, 1) as letter, (m & n) <> 0 as alike, regexp_full_match(sequence, '[ACGTUMRWSYKVHDBNacgtumrwsykvhdbn-]+') as is_nuc,
 ((m & 3) + ((m & 4) << 1) + ((m & 8) >> 1))::int as glf from c"""
)
def letter_codes(s, d):
    """First letter of each read as bits and back, whether it may stand for the second, and its bits in the order of likelihood files."""
    a, b = F.substring("sequence", 1, 1), F.substring("sequence", 2, 1)
    code = sq.to_ambicode(a)
    r = table(s, d, "seq_read").where("length(sequence) > 1")
    return r.select("read_id", code.cast("int").alias("code"), sq.from_ambicode(code).alias("letter"), sq.match(a, b).alias("alike"), sq.encodes_nuc(F.col("sequence")).alias("is_nuc"), glf_code(code).cast("int").alias("glf"))


@query("select read_id, regexp_full_match(quality, '\\s*[+-]?\\d+(\\s+[+-]?\\d+)*\\s*') as is_numeric from seq_read where quality is not null")
def numeric_qualities(s, d):
    return table(s, d, "seq_read").where("quality is not null").select("read_id", ph.all_ascii_qscores(F.col("quality")).alias("is_numeric"))


_PROB = "round(case when bit_count(m) in (0, 4) then 0.25 when (m & {0}) <> 0 then (1 - e) / bit_count(m) else e / (4 - bit_count(m)) end, 9)"


@query(
    f"""with l as (select read_id, upper(substr(sequence, 1, 1)) as a, pow(10, -(read_id % 41) / 10.0) as e from seq_read where length(sequence) > 0), c as (select *, ({_C1})::int as m from l)
select read_id, {_PROB.format(1)} as a, {_PROB.format(2)} as c, {_PROB.format(8)} as g, {_PROB.format(4)} as t from c"""
)
def base_probability(s, d):
    """Probabilities of the four bases given the first letter and a score."""
    p = ph.base_probabilities(F.substring("sequence", 1, 1), F.col("read_id") % 41)
    r = table(s, d, "seq_read").where("length(sequence) > 0")
    return r.select("read_id", *[F.round(p[i], 9).alias(x) for i, x in enumerate("acgt")])


@query(f"{BASE} select read_id, seqid from r")
def sort_name(s, d):
    return sorting.sort_by_name()(recs(s, d)).select("read_id", "read.seqid")


@query(f"{BASE}, x as (select distinct seqid from r where seqid is not null), y as (select seqid from r where seqid is null) select seqid from x union all select seqid from y")
def sort_and_merge(s, d):
    """Redelivered reads become one record in a sort by name."""
    return sorting.sort_and_merge()(recs(s, d)).select("read.seqid")


@query(f"{BASE}, x as (select distinct seqid, read_id % 3 = 0 as k from r where seqid is not null), y as (select seqid from r where seqid is null) select seqid from x union all select seqid from y")
def mega_merged(s, d):
    """Two sets joined, a third beside them."""
    part = lambda n: recs(s, d).where(F.col("read_id") % 3 == n)
    return combine.mega_merge([[part(1), part(2)], [part(0)]]).select("read.seqid")


@query(f"{BASE}, x as (select rr.read_id, count(h.hit_id) as n from rr left join h on h.read_id = rr.read_id group by 1) select count(*) as rows_in, count(*) filter (n > 0) as rows_out, count(*) filter (n = 0) as dropped from x")
def drop_counts(s, d):
    """Records before and after an operator, observed while it runs."""
    op, seen = stats.counted("require hit", filters.require_hit())
    op(recs(s, d)).write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(seen.get["rows_in"], seen.get["rows_out"], seen.get["dropped"])], "rows_in bigint, rows_out bigint, dropped bigint")


@query(
    """with x as (select case when read_id % 5 = 0 then 'no_seeds' else 'aligned' end as reason, 't' || (read_id % 3)::varchar as tag, (read_id % 7)::int as n from seq_read)
select tag, reason, count(*) as records, sum(n)::bigint as num_raw_seeds, 0::bigint as num_useless, count(*)::bigint as num_clumps from x group by 1, 2"""
)
def mapping_statistics(s, d):
    """Statistics that mapping left in records, summed by tag and reason."""
    k = F.col("read_id")
    one = F.struct(F.concat(F.lit("t"), (k % 3).cast("string")).alias("tag"), F.when(k % 5 == 0, "no_seeds").otherwise("aligned").alias("reason"), (k % 7).cast("int").alias("num_raw_seeds"), F.lit(None).cast("int").alias("num_useless"), F.lit(1).alias("num_clumps"))
    return stats.seed_statistics(table(s, d, "seq_read").select(F.array(one).alias("aln_stats")))


@query(
    """with t as (select read_id, start_pos as a, start_pos + abs(aln_length) as b, row_number() over (partition by read_id order by hit_id) as k from aln_hit where read_id is not null and start_pos is not null and aln_length is not null),
j as (select t.read_id, h.start_pos as p, h.start_pos between t.a - 1 and t.b as inside from t left join aln_hit h on h.read_id = t.read_id and h.start_pos is not null where t.k = 1)
select count(distinct read_id) as sequences, count(p) as seeds, count(*) filter (inside) as in_region, count(distinct case when inside then read_id end) as found from j"""
)
def seed_sensitivity(s, d):
    """Hits as seeds of their read, the first of each as its origin."""
    h = table(s, d, "aln_hit").where("read_id is not null and start_pos is not null")
    first = h.where("aln_length is not null").groupBy("read_id").agg(F.min_by(F.struct("start_pos", "aln_length"), "hit_id").alias("h"))
    truth = first.select("read_id", F.col("h.start_pos").alias("start"), (F.col("h.start_pos") + F.abs("h.aln_length")).alias("end"))
    return index_sensitivity(h.select("read_id", F.col("start_pos").alias("ref_pos"), F.lit(1).alias("size")), truth)


@query(RECORD_SQL["stats_pipeline"])
def pipeline_branches(s, d):
    """A pipeline given as data: records of a store through shared steps to two outputs, of which the statistics are shown."""
    out = _out(s, "pipeline")
    sinks.write_records(recs(s, d), f"{out}/in")
    steps = [("filter-score", {"slope": 7.5, "intercept": 20}), ("only-genomes", {"genomes": ["vor4", "kest2"]}), ("require-hit", {})]
    p = Pipeline([(f"{out}/in", steps)], [Branch([], "stats", f"{out}/stats"), Branch([("sort-name", {})], "table", f"{out}/table")])
    p.run(s)
    like = stats.stats(recs(s, d))
    return s.read.schema(like.schema).json(f"{out}/stats")


@query("select 'parquet' as kind, count(*)::bigint as n_rows from seq_read")
def file_description(s, d):
    got = describe.describe(s, f"{d}/seq_read.parquet")
    return s.createDataFrame([(got["kind"], got["rows"])], "kind string, n_rows bigint")
