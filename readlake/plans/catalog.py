"""Queries of the operators on records over the given tables, each with an independent relational formulation as SQL.

Reads take their quality as characters of origin 33 where it has the length of the sequence; hits have genome names in clean form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import cigar as cg
from readlake.functions import phred as ph
from readlake.functions import seq as sq
from readlake.functions.hits import best_hit, hit_to
from readlake.mapping import bulk
from readlake.mapping.index import IndexSpec, build_index, combine_seeds, genome_words, lookup, word_histogram
from readlake.operators import chains, combine, contigs, divergence, filters, intervals, rmdup, sorting, stats, transforms, variants
from readlake.plans.problems import table
from readlake.schema import records, sanitize_reads
from readlake.session import checkpoint_dir, clean_genome, clean_sequence, durable
from readlake.sinks import text as sinks
from readlake.sources import register
from readlake.streaming.records import through, write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the tables as reads, hits and records ---------------------------------------------------------------------------------------------


def reads(s: SparkSession, d: str) -> DataFrame:
    q = F.transform(F.split("quality", ""), lambda c: F.ascii(c) - 33)
    r = table(s, d, "seq_read").select("read_id", "run_id", "seqid", "description", "sequence", F.when(F.length("quality") == F.length("sequence"), q).alias("quality"), "trim_left", "trim_right")
    return sanitize_reads(r)


def hits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "aln_hit").withColumns({"genome_name": clean_genome("genome_name"), "sequence": clean_sequence("sequence")})


def recs(s: SparkSession, d: str) -> DataFrame:
    return records(reads(s, d), hits(s, d))


def flat(df: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate("hit", F.lit(0).cast("bigint"), lambda a, h: a + F.coalesce(h[c], F.lit(0)))
    return df.select("read_id", F.size("hit").alias("n_hits"), total("start_pos").alias("pos_sum"), total("score").alias("score_sum"))


_TRIMMED = "coalesce(tr, length(sequence)) - coalesce(tl, 0)"
_READS = f"""r0 as (select read_id, run_id, seqid, nullif(description, '') as description, sequence,
  case when length(quality) = length(sequence) then list_transform(string_split(quality, ''), lambda c: ascii(c) - 33) end as q,
  case when trim_right < 0 or trim_right > length(sequence) then null else trim_right end as tr, trim_left as l from seq_read),
r as (select *, case when l < 0 or l > coalesce(tr, length(sequence)) then null else l end as tl from r0),
rr as (select *, {_TRIMMED} as n, substr(sequence, coalesce(tl, 0) + 1, {_TRIMMED}) as eff from r)"""
_HITS = """h as (select hit_id, read_id, regexp_replace(lower(trim(genome_name)), '\\.dna$', '') as g, trim(sequence, ' ' || chr(9)) as s, start_pos as p, aln_length as l, score, map_quality as mq, cigar, taxid,
  case when cigar is null then null else coalesce(list_sum(list_transform(list_filter(cigar, lambda x: x.op in ('M', 'X', '=', 'I', 'S')), lambda x: x.len)), 0) end as ql,
  case when cigar is null then null else coalesce(list_sum(list_transform(list_filter(cigar, lambda x: x.op in ('M', 'X', '=', 'D', 'N')), lambda x: x.len)), 0) end as span,
  row_number() over (partition by read_id order by coalesce(score, 0), hit_id) as best from aln_hit)"""
BASE = f"with {_READS},\n{_HITS}"
_FLAT = "count(h.hit_id)::int as n_hits, coalesce(sum(h.p), 0)::bigint as pos_sum, coalesce(sum(h.score), 0)::bigint as score_sum"


def kept(hit: str = "true", rec: str = "true") -> str:
    return f"{BASE} select rr.read_id, {_FLAT} from rr left join h on h.read_id = rr.read_id and ({hit}) where {rec} group by rr.read_id"


# --- summaries and pipelines -----------------------------------------------------------------------------------------------------------

_STATS = """count(*) as total, count(*) filter (mapped) as mapped, count(*) filter (mapped and coalesce(mq >= 30, true)) as mapped_unique, count(*) filter (mapped) as "distinct",
  coalesce(sum(n), 0)::bigint as bases, coalesce(sum(gc), 0)::bigint as gc_bases, coalesce(sum(n * n), 0)::bigint as square_length,
  coalesce(sum(n) filter (mapped), 0)::bigint as bases_mapped, coalesce(sum(gc) filter (mapped), 0)::bigint as gc_mapped, coalesce(sum(n * n) filter (mapped), 0)::bigint as square_length_mapped,
  round(100.0 * sum(gc) / nullif(sum(n), 0), 6)::double as gc_percent, round(100.0 * sum(gc) filter (mapped) / nullif(sum(n) filter (mapped), 0), 6)::double as gc_percent_mapped"""
_GC = "length(eff) - length(translate(eff, 'GC', ''))"


@query(f"{BASE}, x as (select n, {_GC} as gc, b.read_id is not null as mapped, b.mq from rr left join h b on b.read_id = rr.read_id and b.best = 1) select {_STATS} from x")
def stream_stats(s, d):
    return stats.stats(recs(s, d))


@query(
    f"""{BASE}, k as (select *, row_number() over (partition by read_id order by coalesce(score, 0), hit_id) as b2 from h where coalesce(score, 0) <= 7.5 * (ql - 20) and g in ('vor4', 'kest2')),
x as (select n, {_GC} as gc, true as mapped, k.mq from rr join k on k.read_id = rr.read_id and k.b2 = 1) select {_STATS} from x"""
)
def stats_pipeline(s, d):
    """Score filter, two genomes, hit required, statistics."""
    op = combine.chain(filters.filter_score(7.5, 20), filters.only_genomes(["vor4", "kest2"]), filters.require_hit())
    return stats.stats(op(recs(s, d)))


_ALN = "replace(upper({}), 'ACG', '{}')"


def _aligned(df: DataFrame, genomes: dict[str, str]) -> DataFrame:
    """Textual alignments for whole reads, the reference made from the read by a fixed replacement per genome."""
    seq = F.upper("read.sequence")

    def one(h: Column) -> Column:
        ref = F.coalesce(*[F.when(h["genome_name"] == g, F.replace(seq, F.lit("ACG"), F.lit(x))) for g, x in genomes.items()])
        return h.withField("aln_ref", ref).withField("aln_qry", F.when(ref.isNotNull(), seq))

    return df.withColumn("hit", F.transform("hit", one))


@query(
    f"""{BASE}, x as (select h.hit_id, unnest(string_split({_ALN.format('sequence', 'ATG')}, '')) as ref, unnest(string_split(upper(sequence), '')) as qry from h join r on h.read_id = r.read_id where h.g = 'vor4')
select ref, qry, count(*) as n from x where ref in ('A','C','G','T') and qry in ('A','C','G','T') group by 1, 2"""
)
def mismatch_counts(s, d):
    return stats.mismatches(_aligned(recs(s, d), {"vor4": "ATG"}))


_TRIO = f"""{BASE}, a as (select read_id from h where g = 'vor4' group by 1), b as (select read_id from h where g = 'kest2' group by 1),
x as (select upper(sequence) as q, {_ALN.format('sequence', 'ATG')} as p, {_ALN.format('sequence', 'ATT')} as s from r join a on a.read_id = r.read_id join b on b.read_id = r.read_id),
y as (select unnest(string_split(substr(p, 6, greatest(0, length(p) - 10)), '')) as p, unnest(string_split(substr(s, 6, greatest(0, length(p) - 10)), '')) as s, unnest(string_split(substr(q, 6, greatest(0, length(p) - 10)), '')) as q from x),
z as (select * from y where p in ('A','C','G','T') and s in ('A','C','G','T') and q in ('A','C','G','T') {{}}),
c as (select count(*) filter (p = s and p = q) as b1, count(*) filter (q = p and p <> s) as b2, count(*) filter (p = s and s <> q) as b3, count(*) filter (q = s and s <> p) as b4, count(*) filter (p <> s and p <> q and s <> q) as b5 from z)"""


@query(_TRIO.format("and not ((p || q || s) in ('CTT', 'TTC', 'GAA', 'AAG'))") + " select * from c")
def divergence_ancient(s, d):
    return divergence.divergence_counts("vor4", "kest2", 5, ancient=True)(_aligned(recs(s, d), {"vor4": "ATG", "kest2": "ATT"}))


@query(
    _TRIO.format("")
    + """, e as (select *, 3 * (b3 - b4)::double / nullif(3 * b1 - b2 + 3 * b3 - b4 - b5, 0) as e from c), f as (select *, nullif(4 * e - 3, 0) as d from e),
g as (select *, ((e - 3) * b2 + e * b4 + e * b5) / d as a1, (e * b2 + (e - 3) * b4 + e * b5) / d as a3 from f)
select b1, b2, b3, b4, b5, round(e, 9) as error_rate, round(2.0 * b4 / nullif(b4 + b2, 0), 9)::double as raw_divergence, round(2 * a3 / nullif(a3 + a1, 0), 9) as corrected_divergence from g"""
)
def divergence_rates(s, d):
    return divergence.divergence(divergence.divergence_counts("vor4", "kest2", 5)(_aligned(recs(s, d), {"vor4": "ATG", "kest2": "ATT"})))


# --- filters ---------------------------------------------------------------------------------------------------------------------------


@query(kept())
def read_records(s, d):
    return flat(recs(s, d))


@query(kept("g <> 'vor4' or coalesce(score, 0) <= 5 * (ql - 20)"))
def filter_score_genome(s, d):
    return flat(filters.filter_score(5, 20, ["vor4"])(recs(s, d)))


@query(kept("coalesce(score, 0) <= 7.5 * (ql - 20)"))
def filter_score(s, d):
    return flat(filters.filter_score()(recs(s, d)))


@query(
    f"""{BASE}, f as (select *, row_number() over (partition by read_id, g order by hit_id) as k from h where g in ('vor4', 'kest2')),
t as (select read_id, sum(coalesce(score, 0)) as t from f where k = 1 group by 1)
select rr.read_id, {_FLAT} from rr left join t on t.read_id = rr.read_id left join h on h.read_id = rr.read_id where coalesce(t.t, 0) <= 2.5 * (rr.n - 20) group by rr.read_id"""
)
def filter_total_score(s, d):
    return flat(filters.filter_total_score(2.5, 20, ["vor4", "kest2"])(recs(s, d)))


@query(kept("mq is null or mq >= 30"))
def filter_mapq(s, d):
    return flat(filters.filter_mapq(30)(recs(s, d)))


@query(kept("not (g = 'vor4' and s in ('chr1', 'chr7'))"))
def ignore_hits(s, d):
    return flat(filters.ignore_hits(["chr1", "chr7"], ["vor4"])(recs(s, d)))


@query(kept("g in ('vor4', 'myrl1')"))
def only_genomes(s, d):
    return flat(filters.only_genomes(["vor4", "myrl1"])(recs(s, d)))


@query(kept("true", "len(q) > 0 and list_sum(q) >= len(q) * 30"))
def filter_quality(s, d):
    return flat(filters.filter_quality(30)(recs(s, d)))


@query(kept("rr.n between 45 and 80"))
def filter_length(s, d):
    return flat(filters.filter_length(45, 80)(recs(s, d)))


@query(kept("true", f"n > 0 and floor(({_GC}) * 100.0 / length(eff)) between 40 and 60"))
def filter_gc(s, d):
    return flat(filters.filter_gc(40, 60)(recs(s, d)))


@query(kept("true", "rr.read_id in (select read_id from h where g = 'kest2' and s in ('chr1', 'chrX'))"))
def require_hit(s, d):
    return flat(filters.require_hit(["kest2"], ["chr1", "chrX"])(recs(s, d)))


@query(kept("true", "rr.read_id in (select read_id from h where best = 1 and g = 'kest2')"))
def require_best_hit(s, d):
    return flat(filters.require_best_hit(["kest2"])(recs(s, d)))


@query()
def subsample_records(s, d):
    """A tenth of the records by hash."""
    return flat(filters.subsample(0.1, 7)(recs(s, d)))


_REGIONS = "reg as (select trim(name, ' ' || chr(9)) as chrom, range_start as a, range_start + 100000 as b from ref_contig where range_start is not null)"


def _regions(s, d):
    c = table(s, d, "ref_contig").where("range_start is not null")
    return c.select(clean_sequence("name").alias("chrom"), F.col("range_start").alias("start"), (F.col("range_start") + 100000).alias("end"))


def _region_sql(word: str) -> str:
    return f"""{BASE}, {_REGIONS}, k as (select hit_id, exists (select 1 from reg where reg.chrom = h.s and reg.a <= h.p + abs(h.l) and reg.b >= h.p) as x from h)
select rr.read_id, {_FLAT} from rr left join (select h.* from h join k on k.hit_id = h.hit_id where {word} k.x) h on h.read_id = rr.read_id group by rr.read_id"""


@query(_region_sql(""))
def inside_regions(s, d):
    return flat(intervals.in_regions(recs(s, d), _regions(s, d), True))


@query(_region_sql("not"))
def outside_regions(s, d):
    return flat(intervals.in_regions(recs(s, d), _regions(s, d), False))


_POLICIES = [
    (1, 0, 60, None, 12, 0, None, "short"),
    (2, 50, None, None, 16, None, 500, "long"),
    (3, None, None, "r0000[12]:*", None, 1, 1000, "run"),
]


@query(
    BASE
    + """, p(position, lo, hi, pat, seed, mm, rep, idx) as (values (1, 0, 60, null, 12, 0, null, 'short'), (2, 50, null, null, 16, null, 500, 'long'), (3, null, null, '^r0000[12]:.*$', null, 1, 1000, 'run')),
j as (select r.read_id, p.* from r join p on length(r.sequence) >= coalesce(lo, 0) and (hi is null or length(r.sequence) <= hi) and (pat is null or regexp_matches(r.seqid, pat)))
select read_id, max_by(seed, case when seed is not null then position end)::int as min_seed_len, max_by(mm, case when mm is not null then position end)::int as max_mismatches_in_seed,
 max_by(rep, case when rep is not null then position end)::int as repeat_threshold, string_agg(idx, ',' order by position) as indices from j group by 1"""
)
def policies(s, d):
    schema = "position int, minlength int, maxlength int, name_pattern string, min_seed_len int, max_mismatches_in_seed int, repeat_threshold int, i string"
    p = s.createDataFrame(_POLICIES, schema).withColumn("indices", F.array(F.struct(F.col("i").alias("name")))).drop("i")
    return filters.select_policies(reads(s, d), p).withColumn("indices", F.array_join("indices.name", ","))


# --- transforms and functions ------------------------------------------------------------------------------------------------------------


@query(f"{BASE} select read_id, case when q is null then sequence else list_aggregate(list_transform(list_zip(string_split(sequence, ''), q), lambda x: case when x[2] < 25 then 'N' else x[1] end), 'string_agg', '') end as sequence from r")
def mask_quality(s, d):
    return transforms.mask_quality(25)(recs(s, d)).select("read_id", "read.sequence")


@query(f"{BASE} select read_id, tl as trim_left, tr as trim_right, q is not null as has_quality, description, n::int as effective_length from rr")
def sanitized_reads(s, d):
    r = recs(s, d)
    return r.select("read_id", "read.trim_left", "read.trim_right", F.col("read.quality").isNotNull().alias("has_quality"), "read.description", sq.effective_length(F.col("read")).alias("effective_length"))


@query(f"{BASE} select read_id, reverse(translate(sequence, 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn')) as rc, floor(({_GC}) * 100.0 / nullif(length(eff), 0))::int as gc from rr")
def sequence_functions(s, d):
    return recs(s, d).select("read_id", sq.reverse_complement(F.col("read.sequence")).alias("rc"), sq.gc_percent(sq.effective_sequence(F.col("read"))).alias("gc"))


_CG = "list_transform({}, lambda x: x.len::varchar || x.op)"


@query(
    f"""{BASE} select hit_id, ql::int as query_length, span::int as reference_span, list_transform(cigar, lambda x: x.len * 16 + case x.op when 'M' then 0 when 'I' then 1 when 'D' then 2 when 'N' then 3 when 'S' then 4 end) as packed,
 case when cigar is null then null else list_aggregate({_CG.format('cigar')}, 'string_agg', '') end as text from h"""
)
def cigar_functions(s, d):
    c = F.col("cigar")
    packed = cg.pack(c)
    same = cg.unpack(packed) == c
    text = F.when(c.isNotNull() & same, cg.to_text(c))
    return hits(s, d).select("hit_id", cg.query_length(c).alias("query_length"), cg.reference_span(c).alias("reference_span"), packed.alias("packed"), text.alias("text"))


@query(
    """with x as (select hit_id, unnest(list_transform(range(1, len(cigar) + 1), lambda i: {'i': i, 'op': cigar[i].op, 'len': cigar[i].len})) as c from aln_hit where cigar is not null),
e as (select hit_id, c.i as i, c.op as op, unnest(range(c.len)) as k from x), b as (select *, row_number() over (partition by hit_id order by i, k) as o, case when op in ('M', 'I', 'S') then 1 else 0 end as u from e),
u as (select *, sum(u) over (partition by hit_id order by o) as seen from b), f as (select * from u where seen > 5),
g as (select hit_id, i, op, count(*) as n from f where not (u = 0 and seen <= 5) group by 1, 2, 3)
select hit_id, string_agg(n::varchar || op, '' order by i) as trimmed from g group by 1"""
)
def cigar_trim(s, d):
    """Cigars without their first five read bases."""
    t = cg.trim_left(F.col("cigar"), F.lit(5))
    return hits(s, d).where(cg.query_length(F.col("cigar")) > 5).select("hit_id", cg.to_text(t).alias("trimmed"))


@query(
    """with x as (select read_id, unnest(string_split(quality, '')) as c from seq_read where length(quality) = length(sequence)), y as (select read_id, ascii(c) - 33 as q from x)
select read_id, round(sum(10 * log10(1 + pow(10, q / 10.0))), 4)::double as phred_of_solexa, round(sum(pow(10, -q / 10.0)), 6)::double as expected_errors, round(-10 * log10(sum(pow(10, -q / 10.0))), 4)::double as any_error from y group by 1"""
)
def phred_functions(s, d):
    q = F.col("read.quality")
    total = lambda f: F.aggregate(F.transform(q, f), F.lit(0.0), lambda a, x: a + x)
    return recs(s, d).where(q.isNotNull()).select(
        "read_id", F.round(total(lambda x: ph.sol_to_phred(x)), 4).alias("phred_of_solexa"), F.round(total(lambda x: ph.to_float(x)), 6).alias("expected_errors"),
        F.round(ph.sum_of(F.transform(q, lambda x: x.cast("double"))), 4).alias("any_error"),
    )


# --- sorts, choice, combination ------------------------------------------------------------------------------------------------------------


@query(f"{BASE} select r.read_id, b.g as genome_name, b.s as sequence, b.p as start_pos, b.score, (select v.p from h v where v.read_id = r.read_id and v.g = 'vor4' order by v.hit_id limit 1) as vor4_pos from r left join h b on b.read_id = r.read_id and b.best = 1")
def best_hits(s, d):
    b, v = best_hit(F.col("hit")), hit_to(F.col("hit"), ["vor4"])
    return recs(s, d).select("read_id", b["genome_name"].alias("genome_name"), b["sequence"].alias("sequence"), b["start_pos"].alias("start_pos"), b["score"].alias("score"), v["start_pos"].alias("vor4_pos"))


@query(f"{BASE} select r.read_id, b.g as genome_name, b.s as sequence, b.p as start_pos from r left join h b on b.read_id = r.read_id and b.best = 1")
def sort_position(s, d):
    d_ = sorting.sort_by_position()(recs(s, d))
    b = best_hit(F.col("hit"))
    return d_.select("read_id", b["genome_name"].alias("genome_name"), b["sequence"].alias("sequence"), b["start_pos"].alias("start_pos"))


_JOINED = """, x as (select r.seqid, h.*, row_number() over (partition by r.seqid, h.g order by coalesce(h.score, 0), h.s nulls first, h.p nulls first, h.l nulls first) as k,
 lead(coalesce(h.score, 0)) over (partition by r.seqid, h.g order by coalesce(h.score, 0), h.s nulls first, h.p nulls first, h.l nulls first) as second from h join r on r.read_id = h.read_id where r.seqid is not null)
select seqid, g as genome_name, coalesce(score, 0) as score, least(coalesce(mq, 2147483647), coalesce(second - coalesce(score, 0), 2147483647)) as mapq from x where k = 1"""


def _merged(df: DataFrame) -> DataFrame:
    h = df.select("read.seqid", F.explode("hit").alias("h"))
    return h.select("seqid", "h.genome_name", F.coalesce("h.score", F.lit(0)).alias("score"), F.coalesce("h.map_quality", F.lit(2147483647)).alias("mapq"))


@query(BASE + _JOINED)
def join_reads(s, d):
    """Records in three parts by genome, joined on seqid; hits merged per genome."""
    r = recs(s, d).drop("read_id")
    parts = [filters.only_genomes(["vor4"])(r), filters.only_genomes(["kest2", "myrl1"])(r), filters.ignore_hits((), ["vor4", "kest2", "myrl1"])(r)]
    return _merged(combine.join_reads(*parts))


@query(BASE + _JOINED)
def merge_sorted(s, d):
    r = recs(s, d).drop("read_id")
    head = combine.Header(("name",))
    a, b = filters.only_genomes(["vor4"])(r), filters.ignore_hits((), ["vor4"])(r)
    return _merged(combine.merge_sorted([(head, a), (head, b)])[1])


@query(f"{BASE} select read_id, 2::bigint as copies from r")
def concat_records(s, d):
    r = recs(s, d)
    return combine.concat(r, r).groupBy("read_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    f"""{BASE}, c as (select seqid, count(*) as n from r where seqid is not null group by 1) select seqid, (n - 1)::int as others from c where n >= 2"""
)
def filter_multi(s, d):
    """Redelivered reads: how many further records a seqid has, kept from one on."""
    r = recs(s, d).where("read.seqid is not null").groupBy("read.seqid").agg(F.first("read").alias("read"), (F.count(F.lit(1)) - 1).cast("int").alias("nmembers"))
    r = r.withColumn("members", F.array())
    return filters.filter_multi(1)(r).select("seqid", F.col("nmembers").alias("others"))


# --- duplicates and contigs ----------------------------------------------------------------------------------------------------------------

_GOOD = """, k as (select r.read_id, r.seqid, rr.eff, rr.n, r.q, coalesce(r.tl, 0) as t, b.g, b.s, b.p, b.l, b.mq from r join rr on rr.read_id = r.read_id join h b on b.read_id = r.read_id and b.best = 1
 where b.score is null or b.score = 0 or b.score <= floor(7.5 * (rr.n - 20) + 0.5)),
d as (select g, s, p, l, n, count(*) as m, min(struct_pack(a := seqid, b := read_id)) as first from k group by 1, 2, 3, 4, 5 having count(*) > 1)"""


@query(f"{BASE}{_GOOD} select 'C_' || first.a as seqid, s as sequence_name, p as start_pos, m as n_reads from d")
def remove_duplicates(s, d):
    out = rmdup.remove_duplicates()(recs(s, d)).where("startswith(read.seqid, 'C_')")
    b = best_hit(F.col("hit"))
    return out.select("read.seqid", b["sequence"].alias("sequence_name"), b["start_pos"].alias("start_pos"), (F.size("members") + F.col("nmembers")).cast("bigint").alias("n_reads"))


@query(
    f"""{BASE}{_GOOD}, j as (select d.first.a as sid, k.* from d join k on d.g is not distinct from k.g and d.s is not distinct from k.s and d.p is not distinct from k.p and d.l is not distinct from k.l and d.n = k.n),
b as (select sid, i, upper(substr(eff, i, 1)) as b, pow(10, -least(coalesce(mq, 254), coalesce(q[t + i], 30)) / 10.0) as e from (select *, unnest(range(1, n + 1)) as i from j)),
v as (select sid, i, sum(ln(greatest(1e-300, case when b = 'A' then 1 - e else e / 3 end))) as a, sum(ln(greatest(1e-300, case when b = 'C' then 1 - e else e / 3 end))) as c,
 sum(ln(greatest(1e-300, case when b = 'T' then 1 - e else e / 3 end))) as t, sum(ln(greatest(1e-300, case when b = 'G' then 1 - e else e / 3 end))) as g from b group by 1, 2)
select sid as seqid, string_agg(case greatest(a, c, t, g) when a then 'A' when c then 'C' when t then 'T' else 'G' end, '' order by i) as sequence from v group by 1"""
)
def duplicate_consensus(s, d):
    out = rmdup.remove_duplicates()(recs(s, d)).where("startswith(read.seqid, 'C_')")
    return out.select(F.substring("read.seqid", 3, 1000).alias("seqid"), "read.sequence")


_PLACED = """, b as (select h.read_id, g, s, p, p + span as e from h where best = 1 and g is not null and s is not null and p is not null and cigar is not null and span > 0),
m as (select *, max(e) over (partition by g, s order by p, e, read_id rows between unbounded preceding and 1 preceding) as reach from b),
i as (select *, sum(case when p <= reach then 0 else 1 end) over (partition by g, s order by p, e, read_id rows unbounded preceding) as k from m)"""


@query(f"{BASE}{_PLACED} select g as genome_name, s as sequence, min(p) as contig_start, max(e)::bigint as contig_end, count(*) as n_reads from i group by g, s, k")
def contig_islands(s, d):
    c = contigs.assign_contigs(contigs.placed(recs(s, d)))
    return c.groupBy("genome_name", "sequence", "contig_start", "contig_end").agg(F.count(F.lit(1)).alias("n_reads"))


_COLUMNS = """, x as (select h.read_id, h.g, h.s, h.p, h.l, h.span, unnest(list_transform(range(1, len(cg) + 1), lambda i: {'i': i, 'op': cg[i].op, 'len': cg[i].len,
  'r': coalesce(list_sum(list_transform(list_filter(cg[1:i-1], lambda y: y.op in ('M', 'D', 'N')), lambda y: y.len)), 0), 'u': coalesce(list_sum(list_transform(list_filter(cg[1:i-1], lambda y: y.op in ('M', 'I', 'S')), lambda y: y.len)), 0)})) as c
 from (select *, case when l < 0 then list_reverse(cigar) else cigar end as cg from h) h where best = 1 and g is not null and s is not null and p is not null and span > 0),
e as (select read_id, g, s, p, span, l, c.op as op, unnest(range(c.len::bigint)) as k, c.r as r, c.u as u from x where c.op in ('M', 'D', 'I')),
w as (select e.read_id, e.g, e.s, case when op = 'I' then e.p + e.r - 1 else e.p + e.r + e.k end as pos, case when op = 'I' then e.k + 1 else 0 end as ord, op,
  case when op <> 'D' then substr(case when e.l < 0 then reverse(translate(upper(rr.sequence), 'ACGT', 'TGCA')) else upper(rr.sequence) end, (u + k + 1)::int, 1) end as b, e.p + e.span as stop from e join rr on rr.read_id = e.read_id),
z as (select g, s, pos, ord, count(nullif(b, '')) as observed, count(*) filter (b is null) as gaps, count(*) filter (ord = 0 and pos + 1 < stop) as across from w group by 1, 2, 3, 4),
y as (select *, coalesce(max(case when ord = 0 then across end) over (partition by g, s, pos), 0) as crossed from z)"""


@query(
    f"{BASE}{_COLUMNS} select g as genome_name, s as sequence, count(*) as n_columns, sum(observed)::bigint as bases, count(*) filter (ord > 0) as inserts, count(*) filter (ord = 0 and observed <= gaps) as deletions from y where ord = 0 or observed > greatest(0, crossed - observed) group by 1, 2"
)
def contig_columns(s, d):
    """Pileup of every best hit into contig columns, summed by sequence."""
    c = contigs.contig_columns(durable(contigs.assign_contigs(contigs.placed(recs(s, d)))))
    return c.groupBy("genome_name", "sequence").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum(F.col("depth").cast("bigint")).alias("bases"), F.count(F.when(F.col("ord") > 0, 1)).alias("inserts"), F.count(F.when((F.col("ord") == 0) & (F.col("call") == "-"), 1)).alias("deletions")
    )


@query()
def duct_tape(s, d):
    """Contig records: name, length, mean quality, map quality."""
    c = contigs.duct_tape(recs(s, d), "tape")
    return c.select("read.seqid", F.length("read.sequence").alias("length"), F.col("hit")[0]["map_quality"].alias("map_quality"), F.round(F.aggregate("read.quality", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size("read.quality")), 3).alias("quality"))


@query()
def duct_tape_ancient(s, d):
    c = contigs.duct_tape(recs(s, d), "tape", damage=contigs.Damage(0.01, 0.4, 2.0))
    return c.select("read.seqid", F.length("read.sequence").alias("length"), F.crc32("read.sequence").alias("checksum"))


@query(f"{BASE}{_COLUMNS} select g as genome_name, s as sequence, pos::bigint as pos, observed::int as depth from y where ord = 0")
def coverage(s, d):
    c = contigs.contig_columns(durable(contigs.assign_contigs(contigs.placed(recs(s, d)))))
    return contigs.coverage(c).select("genome_name", "sequence", "pos", "depth")


# --- interval joins --------------------------------------------------------------------------------------------------------------------

_CONTIGS = """c as (select distinct regexp_replace(lower(trim(genome_name)), '\\.dna$', '') as g, trim(name, ' ' || chr(9)) as s, "offset" as o, max(range_start) as a, max(range_end) as b from ref_contig group by 1, 2, 3),
cc as (select * from c where a is not null and b is not null)"""


def _contigs(s, d):
    c = table(s, d, "ref_contig").groupBy(clean_genome("genome_name").alias("genome_name"), clean_sequence("name").alias("sequence"), "offset").agg(F.max("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
    return c.where("range_start is not null and range_end is not null")


@query(
    f"""{BASE}, {_CONTIGS} select h.hit_id, case when h.p < cc.b then cc.a end as range_start, case when h.p < cc.b then cc.o end as "offset" from h asof left join cc on h.g = cc.g and h.s = cc.s and h.p >= cc.a"""
)
def find_contig(s, d):
    h = hits(s, d).select("hit_id", "genome_name", "sequence", "start_pos")
    return intervals.find_contig(h, _contigs(s, d)).select("hit_id", "range_start", "offset")


@query(
    f"""with {_CONTIGS}, t as (select g, o, unnest([o + 10, o + (b - a) // 2, o + b - a]) as pos from cc)
select t.g as genome_name, t.pos as position, case when t.pos - cc.o < cc.b - cc.a then cc.s end as sequence, case when t.pos - cc.o < cc.b - cc.a then t.pos - cc.o + cc.a end as sequence_pos from t asof left join cc on t.g = cc.g and t.pos >= cc.o"""
)
def translate_back(s, d):
    c = _contigs(s, d)
    n = F.col("range_end") - F.col("range_start")
    t = c.select("genome_name", F.explode(F.array(F.col("offset") + 10, F.col("offset") + F.expr("(range_end - range_start) div 2"), F.col("offset") + n)).alias("position"))
    return intervals.translate_back(t, c).select("genome_name", "position", "sequence", "sequence_pos")


@query(
    f"""{BASE}, {_CONTIGS}, f as (select *, row_number() over (partition by read_id, g order by hit_id) as k from h where g in ('vor4', 'kest2')),
a as (select * from f where g = 'vor4' and k = 1), b as (select * from f where g = 'kest2' and k = 1), t as (select s, a, b from cc where g = 'vor4'),
m as (select a.read_id, b.s as bs, b.p as bp, b.p + abs(b.l) as be, (a.l < 0) = (b.l < 0) as same, t.s, t.a, t.b, row_number() over (partition by a.read_id order by t.b - t.a, t.a) as k
 from a join b on a.read_id = b.read_id join t on t.s = a.s and t.a <= a.p + abs(a.l) - 1 and a.p <= t.b - 1 where abs(a.l) > 0)
select read_id from m where k = 1 and bs = s and bp < b and be > a and same"""
)
def agrees_with_chain(s, d):
    """Hits to two genomes in blocks that hold equal coordinates of both."""
    c = _contigs(s, d).where("genome_name = 'vor4'")
    b = c.select(F.col("range_start").alias("block_id"), F.col("sequence").alias("t_chrom"), F.col("range_start").alias("t_start"), F.col("range_end").alias("t_end"), F.col("sequence").alias("q_chrom"), F.col("range_start").alias("q_start"), F.col("range_end").alias("q_end"), F.lit("+").alias("strand"), F.lit(0).alias("depth"))
    return chains.agrees_with_chain("vor4", "kest2", b)(recs(s, d)).select("read_id")


# --- word index --------------------------------------------------------------------------------------------------------------------------


def _as_contigs(s, d):
    r = table(s, d, "seq_read").where(F.col("sequence").rlike("^[ACGTacgt]+$"))
    return r.select(F.lit("reads").alias("genome_name"), (F.col("read_id") * 1000).alias("offset"), "sequence", F.col("sequence").alias("bases"))


_WORDS = """w0 as (select read_id * 1000 as o, upper(sequence) as x from seq_read where regexp_matches(sequence, '^[ACGTacgt]+$')),
w1 as (select o + i as pos, substr(x, (i + 1)::int, {k}) as word from (select o, x, unnest(range(0, length(x) - {k} + 1)) as i from w0 where length(x) >= {k}) where (o + i) % {st} = 0),
w as (select * from w1 where {rep})"""


def _words_sql(k: int, stride: int) -> str:
    rep = " and ".join(f"substr(word, 1, {k - n}) <> substr(word, {n + 1}, {k - n})" for n in range(1, k // 2 + 1))
    return _WORDS.format(k=k, st=stride, rep=rep)


@query(f"with {_words_sql(12, 4)} select word, pos from w")
def word_index(s, d):
    return genome_words(_as_contigs(s, d), IndexSpec(12, 4)).select("word", "pos")


@query(f"with {_words_sql(12, 4)}, n as (select word, count(*) as places from w group by 1) select places, count(*) as words from n group by 1")
def word_frequencies(s, d):
    return word_histogram(genome_words(_as_contigs(s, d), IndexSpec(12, 4))).select("places", "words")


_LOOKUP = f"""with {_words_sql(16, 4)}, c as (select word from w group by 1 having count(*) < 50), ix as (select w.* from w join c on c.word = w.word),
q as (select read_id, upper(sequence) as x from seq_read where length(sequence) >= 16), q1 as (select read_id, unnest(range(0, length(x) - 15)) as i, x from q),
q2 as (select read_id, i, substr(x, (i + 1)::int, 16) as f from q1), q3 as (select read_id, i + 1 as offs, f as word from q2 where regexp_matches(f, '^[ACGT]*$')
 union all select read_id, -i - 16, reverse(translate(f, 'ACGT', 'TGCA')) from q2 where regexp_matches(f, '^[ACGT]*$')),
m as (select distinct q3.read_id, ix.pos, q3.offs, ix.pos - q3.offs as diag from q3 join ix on ix.word = q3.word)"""


@query(_LOOKUP + ' select read_id, pos, offs::int as "offset", diag from m')
def word_lookup(s, d):
    spec = IndexSpec(16, 4, cutoff=50)
    return lookup(table(s, d, "seq_read").select("read_id", "sequence"), build_index(_as_contigs(s, d), spec), spec).select("read_id", "pos", "offset", "diag")


@query()
def combined_seeds(s, d):
    """Seeds of all reads in all reads, also of the commonest words."""
    spec = IndexSpec(16, 4)
    m = lookup(table(s, d, "seq_read").select("read_id", "sequence"), build_index(_as_contigs(s, d), spec), spec)
    return combine_seeds(m, 16, 20).select("read_id", "ref_pos", "query_pos", "size")


# --- writers ---------------------------------------------------------------------------------------------------------------------------

_RC = "reverse(translate({}, 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn'))"
_QT = "coalesce(list_aggregate(list_transform({}, lambda x: chr((least(x, 93) + 33)::int)), 'string_agg', ''), '*')"


@query(
    f"""{BASE}, o as (select h.*, case when h.l < 0 then list_reverse(cigar) else cigar end as cg, r.seqid, r.sequence as sq, r.q from r join h on h.read_id = r.read_id where r.seqid is not null and ql = length(r.sequence)),
c as (select *, list_aggregate(list_transform(range(1, len(cg) + 1), lambda i: cg[i].len::varchar || case when cg[i].op = 'I' and (i = 1 or i = len(cg)) then 'S' else cg[i].op end), 'string_agg', '') as ct from o)
select concat_ws(chr(9), seqid, case when l < 0 then '16' else '0' end, s, (p + 1)::varchar, least(254, coalesce(mq, 254))::varchar, ct, '*', '0', '0', case when l < 0 then {_RC.format('sq')} else sq end,
 case when l < 0 then {_QT.format('list_reverse(q)')} else {_QT.format('q')} end, case when score is not null then 'UQ:i:' || score::varchar end) as value from c
union all select concat_ws(chr(9), seqid, '4', '*', '0', '0', '*', '*', '0', '0', sequence, {_QT.format('q')}) from r where seqid is not null and not exists (select 1 from h where h.read_id = r.read_id)"""
)
def sam_lines(s, d):
    return sinks.sam_lines(recs(s, d))


@query(f"{BASE} select n::int as length, coalesce(b.score, 0) as score, coalesce(b.mq, 9999) as map_quality from rr join h b on b.read_id = rr.read_id and b.best = 1")
def table_lines(s, d):
    return sinks.table_lines(recs(s, d))


@query(
    f"""{BASE}, x as (select concat_ws(' ', '@' || seqid, description) as head, sequence, {_QT.format('q')} as qt from r where q is not null and seqid is not null and sequence is not null)
select head || chr(10) || rtrim(regexp_replace(sequence, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)) || chr(10) || '+' || chr(10) || rtrim(regexp_replace(qt, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)) as value from x"""
)
def fastq_lines(s, d):
    return sinks.fastq_lines(recs(s, d))


@query()
def record_text(s, d):
    return sinks.text_lines(recs(s, d))


# --- trimming, chains, sites, mapping, streams, files -------------------------------------------------------------------------------------------


@query()
def trim_reads(s, d):
    """Trim points after cutting trailing Ns and an adapter."""
    t = transforms.trim(right=["GATCGGAAGAGC"])(recs(s, d))
    return t.select("read_id", "read.trim_left", "read.trim_right", F.size("hit").alias("n_hits"))


@query(f"with {_CONTIGS} select cc.o as block_id, cc.a % 2 = 0 as invertible from cc where g = 'vor4'")
def invertible_chains(s, d):
    """Blocks that map contigs onto a shifted copy; the inverse knows those that start at even positions."""
    c = _contigs(s, d).where("genome_name = 'vor4'")
    f = c.select(F.col("offset").alias("block_id"), F.col("sequence").alias("t_chrom"), F.col("range_start").alias("t_start"), F.col("range_end").alias("t_end"), F.col("sequence").alias("q_chrom"), (F.col("range_start") + 7).alias("q_start"), (F.col("range_end") + 7).alias("q_end"), F.lit("+").alias("strand"))
    i = f.where("t_start % 2 = 0").select("block_id", F.col("q_chrom").alias("t_chrom"), F.col("q_start").alias("t_start"), F.col("q_end").alias("t_end"), F.col("t_chrom").alias("q_chrom"), F.col("t_start").alias("q_start"), F.col("t_end").alias("q_end"), "strand")
    return chains.invertible(f, i)


@query(
    f"""{BASE}{_COLUMNS}, kk as (select * from y where (ord = 0 or observed > greatest(0, crossed - observed)) and g = 'vor4'),
st as (select distinct s, p as pos from h where g = 'vor4' and s is not null and p is not null)
select st.s as chrom, st.pos, count(*) filter (kk.pos = st.pos and kk.ord = 0 and observed > gaps)::int as n_bases,
 coalesce(bool_or(kk.ord > 0 or (kk.ord = 0 and observed <= gaps)), false) as gap_near from st left join kk on kk.s = st.s and kk.pos between st.pos - 5 and st.pos + 5 group by 1, 2"""
)
def observed_sites(s, d):
    """Start of each hit as a site: bases seen there and whether a gap is near."""
    rows = contigs.assign_contigs(contigs.placed(recs(s, d))).where("genome_name = 'vor4'")
    ends = rows.select("sequence", "contig_start", "contig_end").distinct()
    cols = contigs.contig_columns(durable(rows)).join(ends, ["sequence", "contig_start"])
    h = hits(s, d).where("genome_name = 'vor4' and sequence is not null and start_pos is not null").select(F.col("sequence").alias("chrom"), F.col("start_pos").alias("pos")).distinct()
    sites = h.select(F.struct("chrom", "pos").alias("site_id"), "chrom", "pos", F.lit("+").alias("strand"), F.lit(None).cast("bigint").alias("end"))
    o = variants.observe_sites(sites, cols)
    # inserts after the site's base are no base of the site itself
    return o.select("chrom", "pos", F.least(F.lit(1), F.length("bases")).alias("n_bases"), "gap_near")


@query()
def map_simulated_reads(s, d):
    """The effective sequence of every read mapped to the reads as contigs: by reason, and how many lie at their origin, their own contig; of equal places
    the first wins, so a copy of an earlier read lies there instead."""
    left, n = F.coalesce("trim_left", F.lit(0)), sq.effective_length(F.struct("sequence", "trim_left", "trim_right"))
    r = reads(s, d).select("read_id", F.substr("sequence", left + 1, n).alias("sequence"), F.slice("quality", left + 1, F.greatest(F.lit(0), n)).alias("quality"), left.alias("left"))
    # contigs lie 1000 positions apart
    c = _as_contigs(s, d).select("genome_name", F.floor(F.col("offset") / 1000).cast("string").alias("sequence"), "offset", F.lit(0).cast("bigint").alias("range_start"), F.length("bases").cast("bigint").alias("range_end"), "bases")
    m = bulk.map_all(r.select("read_id", "sequence", "quality"), c, "reads", IndexSpec(16, 4, cutoff=200), chunk=4000).join(r.select("read_id", "left"), "read_id")
    right = (F.col("sequence") == F.col("read_id").cast("string")) & (F.abs(F.col("start_pos") - F.col("left")) <= 3) & (F.col("aln_length") > 0)
    return m.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(right, 1)).alias("at_origin"))


@query(f"{BASE} select read_id, sequence from r where length(sequence) >= 60 and list_sum(q) >= len(q) * 25 and len(q) > 0")
def stream_filters(s, d):
    """Reads from a stream through row-local filters into a store, exactly once, then read back."""
    src = table(s, d, "seq_read")
    out = f"{checkpoint_dir(s).rstrip('/')}/stream-{uuid.uuid4().hex}"
    st = s.readStream.schema(src.schema).parquet(f"{d}/seq_rea[d].parquet")  # a pattern, as a stream takes no single file
    q = F.transform(F.split("quality", ""), lambda c: F.ascii(c) - 33)
    st = sanitize_reads(st.select("read_id", "seqid", "description", "sequence", F.when(F.length("quality") == F.length("sequence"), q).alias("quality"), "trim_left", "trim_right"))
    rec = st.select(F.struct("sequence", "quality").alias("read"), "read_id")
    ops = [filters.filter_quality(25), lambda x: x.where(F.length("read.sequence") >= 60)]
    write_stream(through(rec, *ops).select("read_id", "read.sequence"), out + "/data", out + "/checkpoint")
    return s.read.parquet(out + "/data")


@query(f"{BASE} select seqid, sequence, list_sum(q)::bigint as quality from r where q is not null and seqid is not null and len(q) > 0")
def fastq_round_trip(s, d):
    """All reads with quality written as FastQ and read back by the data source in byte ranges."""
    out = f"{checkpoint_dir(s).rstrip('/')}/fastq-{uuid.uuid4().hex}"
    sinks.write_lines(sinks.fastq_lines(recs(s, d)), out)
    register(s)
    r = s.read.format("readlake-fastq").options(path=out, splitBytes=str(1 << 20)).load()
    return r.select("seqid", "sequence", F.aggregate("quality", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("quality"))
