"""Queries of the general problems over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators import bad_rows, drift, periods, quality_units, skew


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return quality_units.recorded_otherwise(table(s, d, "seq_read"), table(s, d, "seq_run"))


def p1_units(s: SparkSession, d: str) -> DataFrame:
    """Reads by the unit of their quality, with how many are valid and the sum of their Phred scores."""
    q = quality_units.normalize_quality(table(s, d, "seq_read"), table(s, d, "seq_run"))
    return q.groupBy(
        F.col("unit.dim").alias("dim"), F.col("unit.scale").alias("scale"), F.coalesce("unit.origin", F.lit(0)).cast("int").alias("origin")
    ).agg(F.count(F.lit(1)).alias("n_reads"), F.count("phred_total").alias("n_valid"), F.coalesce(F.sum("phred_total"), F.lit(0)).alias("phred_total"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return bad_rows.rejects(table(s, d, "raw_read_line"))


def p2_loaded(s: SparkSession, d: str) -> DataFrame:
    return bad_rows.loaded(table(s, d, "raw_read_line"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return skew.heavy_pairs(table(s, d, "aln_hit")).select("genome_name", "sequence")


def p3_profile(s: SparkSession, d: str) -> DataFrame:
    return skew.pair_profile(table(s, d, "aln_hit"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return drift.file_changes(table(s, d, "raw_hit_record"))


def p4_hits(s: SparkSession, d: str) -> DataFrame:
    h = drift.unified_hits(table(s, d, "raw_hit_record"))
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return h.select(
        "record_id", "file_id", "record_no", "genome_name", "sequence", "start_pos", "aln_length", "score", F.round("evalue", 8).alias("evalue"), cigar.alias("cigar"), "map_quality", "taxid", F.size("failed").alias("n_failed"),
        F.try_element_at("rest", F.lit("lane")).try_cast("int").alias("lane"), F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("rest", F.lit("aligner_build")), F.lit("}")), "$.v").alias("aligner_build"),
    )


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return periods.hit_periods(table(s, d, "aln_hit"))


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_loaded, p3_found, p3_profile, p4_found, p4_hits, p7_found)}

#: Spellings of the fields of a hit in the given tables, in lower case and without underscores, for the SQL only: the operator infers
#: them. Fixed values.
SPELLINGS = {
    "genome_name": ("genomename", "genome", "refgenome"),
    "sequence": ("sequence", "chrom", "target"),
    "start_pos": ("startpos", "begin", "pos"),
    "aln_length": ("alnlength", "alnlen", "refspan", "signedspan"),
    "score": ("score", "penalty"),
    "evalue": ("evalue",),
    "cigar": ("cigar", "cigarstring", "alnops", "editpath"),
    "map_quality": ("mapquality", "mapq"),
    "taxid": ("taxid",),
}
_FIELD_SQL = "case lower(replace(path, '_', '')) " + " ".join(f"when '{x}' then '{f}'" for f, xs in SPELLINGS.items() for x in xs) + " else path end"

_TEXTS = {
    "odds": r"solexa|log-odds|\(1-p\)",
    "accuracy": r"accuracy|correct",
    "log": r"log10|logarithm",
    "permille": r"permille|per thousand|1/1000|per 1000",
    "error": r"p\(error\)|p\(wrong|error|chance",
    "level": r"phred|sanger|fastq|quality origin|q from",
    "number": r"numbers?|integer|decimal",
    "char64": r"64|'@'|';'",
    "char33": r"33|'!'|sanger|fastq",
}


def _unit_sql(c: str) -> str:
    has = lambda k: f"regexp_matches(lower({c}), '{_TEXTS[k]}')".replace("'@'", "''@''").replace("';'", "''\\x3b''").replace("'!'", "''!''")
    char = f"case when {has('number')} and not {has('char64')} then 'n' when {has('char64')} then '64' when {has('char33')} then '33' end"
    return (
        f"case when {c} is null then null when {has('odds')} then 'odds' || (case when {has('number')} and not regexp_matches(lower({c}), '64') then 'n' else '64' end)"
        f" when {has('accuracy')} then 'accuracy' when {has('log')} then 'log' when {has('permille')} then 'permille' when {has('error')} and not {has('level')} then 'error'"
        f" when {has('level')} and ({char}) is not null then 'level' || ({char}) end"
    )


UNITS_SQL = f"""
with q as (
  select r.read_id, r.run_id, r.sequence, r.quality, coalesce({_unit_sql('r.description')}, {_unit_sql('n.run_note')}) as u
  from seq_read r left join seq_run n on r.run_id = n.run_id),
votes as (
  select run_id, sum(case when regexp_matches(quality, '[!-?]') then 1 else 0 end) as low, sum(case when regexp_matches(quality, '[K-~]') then 1 else 0 end) as high
  from q where u is null and quality <> '*' and length(quality) = length(sequence) group by run_id),
k as (
  select q.read_id, q.sequence, q.quality, coalesce(q.u, case when v.high > v.low then 'level64' else 'level33' end) as u
  from q left join votes v on q.run_id is not distinct from v.run_id),
vals as (
  select read_id, sequence, u, case when quality is null or quality in ('', '*') or sequence is null then null
    when u in ('level33', 'level64', 'odds64') then list_transform(string_split(quality, ''), lambda c: (ascii(c) - case when u = 'level33' then 33 else 64 end)::double)
    else list_transform(string_split_regex(regexp_replace(quality, '[\\s,;%]+$', ''), '[\\s,;%]+'), lambda c: try_cast(c as double)) end as v
  from k),
phred as (
  select read_id, u, case when len(v) = length(sequence) then list_transform(v, lambda x: floor(0.5 + case
    when u in ('level33', 'level64', 'leveln') then x when u = 'log' then -10 * x
    when u in ('odds64', 'oddsn') then 10 * log10(1 + pow(10, x / 10))
    else least(93, -10 * log10(greatest(1e-12, case u when 'accuracy' then 1 - x / 100 when 'permille' then x / 1000 else x end))) end)::bigint) end as p
  from vals)
"""
SQL = {
    "p1_found": UNITS_SQL + "select read_id, list_sum(p)::bigint as phred_total from phred where u <> 'level33' and list_sum(p) is not null",
    "p1_units": UNITS_SQL
    + """select case when u in ('odds64', 'oddsn') then 'odds' when u in ('level33', 'level64', 'leveln', 'log') then 'level' else 'error' end as dim,
  (case u when 'log' then -10 when 'accuracy' then -0.01 when 'permille' then 0.001 else 1 end)::double as scale,
  (case when u = 'level33' then 33 when u in ('level64', 'odds64') then 64 else 0 end)::int as origin,
  count(*) as n_reads, count(list_sum(p)) as n_valid, coalesce(sum(list_sum(p)), 0)::bigint as phred_total from phred group by 1, 2, 3""",
    "p2_found": r"""
with q as (select raw_id, line, regexp_full_match(line, '(?s)("([^"]|"")*"|[^",][^",]*|)(,("([^"]|"")*"|[^",][^",]*|))*') as fine from raw_read_line),
f as (select raw_id, fine, list_transform(case when fine then regexp_extract_all(line, '(?s)(?:^|,)("(?:[^"]|"")*"|[^,]*)', 1) end,
  lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as c from q),
r as (select raw_id, case when not fine then 'quoting' when len(c) <> 6 then 'column_count'
  when not regexp_full_match(c[3], '[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]+') then 'bad_sequence'
  when c[4] <> '' and (length(c[4]) <> length(c[3]) or not regexp_full_match(c[4], '[!-~]*')) then 'bad_quality'
  when not regexp_full_match(c[5], '[0-9]*') or not regexp_full_match(c[6], '[0-9]*') then 'bad_trim' end as reason from f)
select raw_id, reason from r where reason is not null""",
    "p2_loaded": r"""
with q as (select *, regexp_full_match(line, '(?s)("([^"]|"")*"|[^",][^",]*|)(,("([^"]|"")*"|[^",][^",]*|))*') as fine from raw_read_line),
f as (select raw_id, file_name, line_no, list_transform(case when fine then regexp_extract_all(line, '(?s)(?:^|,)("(?:[^"]|"")*"|[^,]*)', 1) end,
  lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as c from q)
select raw_id, file_name, line_no, c[1] as seqid, c[2] as description, c[3] as sequence, c[4] as quality, try_cast(c[5] as int) as trim_left, try_cast(c[6] as int) as trim_right
from f where len(c) = 6 and regexp_full_match(c[3], '[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]+') and (c[4] = '' or length(c[4]) = length(c[3]) and regexp_full_match(c[4], '[!-~]*'))
and regexp_full_match(c[5], '[0-9]*') and regexp_full_match(c[6], '[0-9]*')""",
    "p3_found": """
with h as (select regexp_replace(lower(trim(genome_name)), '\\.dna$', '') as genome_name, trim(sequence, ' ' || chr(9)) as sequence from aln_hit)
select genome_name, sequence from h where genome_name is not null and sequence is not null group by 1, 2 having count(*) >= 0.03 * (select count(*) from h)""",
    "p3_profile": """
with h as (select regexp_replace(lower(trim(genome_name)), '\\.dna$', '') as genome_name, trim(sequence, ' ' || chr(9)) as sequence, start_pos from aln_hit),
m as (select genome_name, sequence, start_pos, count(*) as n, row_number() over (partition by genome_name, sequence order by count(*) desc, start_pos) as k
  from h where start_pos is not null group by 1, 2, 3)
select h.genome_name, h.sequence, count(*) as n_rows, count(distinct h.start_pos) as n_distinct, any_value(m.start_pos) as mode, any_value(m.n) as mode_rows,
  quantile_disc(h.start_pos, 0.25) as q25, quantile_disc(h.start_pos, 0.5) as q50, quantile_disc(h.start_pos, 0.75) as q75
from h left join m on h.genome_name is not distinct from m.genome_name and h.sequence is not distinct from m.sequence and m.k = 1 group by 1, 2""",
    "p4_found": """
with e as (select producer, file_id, written_at, unnest(json_keys(body)) as path, body from raw_hit_record),
t as (select producer, file_id, written_at, path, %s as field,
  json_type(body, '$."' || path || '"') as jt, json_type(body, '$."' || path || '"[0]') as et from e),
k as (select *, case when jt = 'NULL' then null when jt = 'VARCHAR' then 'string' when jt = 'OBJECT' then 'object' when jt = 'ARRAY' then 'array of ' || et else 'number' end as kind from t),
s as (select producer, file_id, written_at, field, list_sort(list(distinct path)) as paths, list_sort(list(distinct kind) filter (kind is not null)) as kinds from k group by 1, 2, 3, 4),
f as (select producer, file_id, lag(file_id) over (partition by producer order by written_at, file_id) as before from (select distinct producer, file_id, written_at from raw_hit_record)),
o as (select f.file_id, s.field, s.paths as p1, s.kinds as k1, null::varchar[] as p0, null::varchar[] as k0 from f join s on s.file_id = f.file_id where f.before is not null
  union all select f.file_id, s.field, null, null, s.paths, s.kinds from f join s on s.file_id = f.before),
b as (select file_id, field, max(p1) as p1, max(k1) as k1, max(p0) as p0, max(k0) as k0 from o group by 1, 2)
select file_id, field, 'added' as change from b where p0 is null union all select file_id, field, 'removed' from b where p1 is null
union all select file_id, field, 'renamed' from b where p0 <> p1 union all select file_id, field, 'retyped' from b where k0 <> k1 and len(k0) > 0 and len(k1) > 0"""
    % _FIELD_SQL,
    "p4_hits": """
with d as (select *, row_number() over (partition by file_id, record_no order by record_id) as k from raw_hit_record),
b as (select record_id, file_id, record_no, case when json_valid(body) and json_type(body) = 'OBJECT' then body end as body from d where k = 1 or file_id is null or record_no is null),
e as (select record_id, unnest(json_keys(body)) as path, body from b),
t as (select record_id, %s as field, path, json_extract(body, '$."' || path || '"') as v from e),
p as (select record_id, field, arg_min(v, path) as v from t where json_type(v) <> 'NULL' and v::varchar <> '[]' group by 1, 2),
w as (select record_id, %s, max(case when field = 'lane' then v end) as lane, max(case when field = 'aligner_build' then v end) as build from p group by 1),
n as (select b.record_id, b.file_id, b.record_no, w.* exclude record_id, case when json_type(genome_name) = 'VARCHAR' then genome_name ->> '$' end as g, case when json_type(sequence) = 'VARCHAR' then sequence ->> '$' end as s,
  %s,
  case when json_type(aln_length) = 'OBJECT' then case aln_length ->> '$.strand' when '-' then -abs(try_cast(aln_length ->> '$.length' as int)) when '+' then abs(try_cast(aln_length ->> '$.length' as int)) end
    else try_cast(aln_length ->> '$' as double) end as l,
  case when json_type(cigar) = 'VARCHAR' then case when regexp_full_match(cigar ->> '$', '([0-9]+[MIDNSHPX=])+') then cigar ->> '$' end
    when json_type(cigar) = 'ARRAY' and json_type(cigar, '$[0]') = 'OBJECT' then list_aggregate(list_transform(cast(cigar -> '$[*]' as json[]), lambda x: (x ->> '$.len') || (x ->> '$.op')), 'string_agg', '')
    when json_type(cigar) = 'ARRAY' then list_aggregate(list_transform(cast(cigar as bigint[]), lambda x: (x >> 4) || case x & 15 when 0 then 'M' when 1 then 'I' when 2 then 'D' when 3 then 'N' when 4 then 'S' when 5 then 'H' when 6 then 'P' when 15 then 'X' end), 'string_agg', '') end as c
  from b left join w on b.record_id = w.record_id)
select record_id, file_id, record_no, g as genome_name, s as sequence, n_start_pos::bigint as start_pos, l::int as aln_length, n_score::int as score, round(n_evalue, 8) as evalue, c as cigar, n_map_quality::int as map_quality, n_taxid::int as taxid,
  (genome_name is not null and g is null)::int + (sequence is not null and s is null)::int + (start_pos is not null and n_start_pos is null)::int + (aln_length is not null and l is null)::int + (score is not null and n_score is null)::int
  + (evalue is not null and n_evalue is null)::int + (cigar is not null and c is null)::int + (map_quality is not null and n_map_quality is null)::int + (taxid is not null and n_taxid is null)::int as n_failed,
  try_cast(lane ->> '$' as int) as lane, build ->> '$' as aligner_build
from n"""
    % (
        _FIELD_SQL,
        ", ".join(f"max(case when field = '{f}' then v end) as {f}" for f in SPELLINGS),
        ", ".join(f"try_cast({f} ->> '$' as double) as n_{f}" for f in ("start_pos", "score", "evalue", "map_quality", "taxid")),
    ),
    "p7_found": """
with h as (select distinct regexp_replace(lower(trim(genome_name)), '\\.dna$', '') as genome_name, trim(sequence, ' ' || chr(9)) as sequence, start_pos as s, start_pos + abs(aln_length) as e
  from aln_hit where start_pos is not null and aln_length is not null and aln_length <> 0 and genome_name is not null and sequence is not null),
m as (select *, max(e) over (partition by genome_name, sequence order by s, e rows between unbounded preceding and 1 preceding) as reach from h),
i as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by genome_name, sequence order by s, e rows unbounded preceding) as k from m),
p as (select genome_name, sequence, min(s) as s, max(e) as e from i group by genome_name, sequence, k),
g as (select genome_name, sequence, e as s, lead(s) over (partition by genome_name, sequence order by s) as e from p)
select genome_name, sequence, 'period' as kind, s as range_start, e as range_end from p union all
select genome_name, sequence, 'gap', s, e from g where e - s between 1 and 20000""",
}
