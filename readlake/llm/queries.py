"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm import chunking, leakage, subjects, survivor, tokenization
from readlake.plans.problems import UNITS_SQL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return chunking.sequence_pieces(table(s, d, "ref_contig"), table(s, d, "ref_genome"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    best = survivor.best_representatives(table(s, d, "seq_read"), table(s, d, "aln_hit"), table(s, d, "seq_run"))
    return best.select("group_read_id", "best_read_id")


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return tokenization.encode_texts(table(s, d, "documents"))


def p8_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids."""
    return tokenization.decode_ids(p8_ids(s, d))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(s, d, "documents"), table(s, d, "eval_item"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return subjects.treated_subjects(table(s, d, "documents"), table(s, d, "subject_label"), table(s, d, "subject_area"))


QUERIES = {f.__name__: f for f in (p5_found, p6_found, p8_ids, p8_round_trip, p9_found, p10_found)}
_CLEAN = "regexp_replace(lower(trim({})), '\\.dna$', '')"
SQL = {
    "p5_found": f"""
with recursive c as (select {_CLEAN.format('genome_name')} as g, trim(name, ' ' || chr(9)) as n, "offset" as o, max(range_start) as s, max(range_end) as e from ref_contig group by 1, 2, 3),
z as (select {_CLEAN.format('name')} as g, max(total_size) as t from ref_genome group by 1),
l as (select c.*, coalesce(lead(o) over (partition by c.g order by o), t) - o - 1 as len from c left join z on c.g = z.g),
f as (select g, n, coalesce(s, e - len) as s, coalesce(e, s + len) as e from l),
q as (select g, n, min(s) as lo, max(e) as hi from f group by 1, 2 having max(e) - min(s) > 5000000),
w as (select f.g, f.n, list(e) as es from f join q on f.g = q.g and f.n = q.n group by 1, 2),
p(g, n, hi, a, b) as (
  select q.g, q.n, hi, lo, coalesce(list_max(list_filter(es, lambda x: x > lo + 50000 and x <= lo + 5000000)), lo + 5000000) from q join w on q.g = w.g and q.n = w.n
  union all
  select p.g, p.n, hi, b - 50000, case when hi - (b - 50000) <= 5000000 then hi
    else coalesce(list_max(list_filter(es, lambda x: x > b and x <= b - 50000 + 5000000)), b - 50000 + 5000000) end
  from p join w on p.g = w.g and p.n = w.n where b < hi)
select g as genome_name, n as name, a as piece_start, b as piece_end from p""",
    "p6_found": UNITS_SQL
    + f""", m as (select {_CLEAN.format('genome_name')} as g, trim(sequence, ' ' || chr(9)) as s, start_pos as p, aln_length as l, read_id, max(map_quality) as mq from aln_hit
 where genome_name is not null and sequence is not null and start_pos is not null and aln_length is not null and read_id is not null group by 1, 2, 3, 4, 5),
z as (select g, s, p, l, list_sort(list(read_id)) as ids from m group by 1, 2, 3, 4 having count(*) > 1),
e as (select z.ids, m.read_id, max(m.mq) as mq from z join m on m.g = z.g and m.s = z.s and m.p = z.p and m.l = z.l group by 1, 2),
w as (select ids, e.read_id, row_number() over (partition by ids order by length(r.sequence) - length(translate(r.sequence, 'Nn', '')), coalesce(list_sum(phred.p), -1) desc, coalesce(mq, -1) desc, e.read_id) as k
 from e join seq_read r on r.read_id = e.read_id join phred on phred.read_id = e.read_id)
select ids[1] as group_read_id, read_id as best_read_id from w where k = 1""",
    "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
