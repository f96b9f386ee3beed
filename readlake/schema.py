"""The nested record of a read with its hits, and how flat tables become such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.session import clean_genome

CIGAR = "array<struct<op:string,len:int>>"
READ = (
    "struct<seqid:string,description:string,sequence:string,quality:array<int>,likelihoods:array<array<int>>,"
    "seen_bases:array<int>,depth:array<int>,trim_left:int,trim_right:int>"
)
HIT = (
    f"struct<genome_name:string,sequence:string,start_pos:bigint,aln_length:int,score:int,evalue:float,cigar:{CIGAR},map_quality:int,"
    "diff_to_next_chromosome:int,diff_to_next_chromosome_class:int,taxid:int,taxid_species:int,taxid_order:int,aln_ref:string,aln_qry:string>"
)
STATS = (
    "struct<tag:string,reason:string,num_raw_seeds:int,num_grown_seeds:int,num_clumps:int,num_useless:int,"
    "open_nodes_after_alignment:int,closed_nodes_after_alignment:int,tracked_closed_nodes_after_alignment:int>"
)
SEEDS = "struct<genome_name:string,max_mismatches:int,min_seed_length:int,seeds:array<struct<ref_pos:bigint,query_pos:int,size:int>>>"
RESULT = (
    f"read {READ}, members array<{READ}>, nmembers int, hit array<{HIT}>, aln_stats array<{STATS}>,"
    f" diff_to_next_species int, diff_to_next_order int, num_reads int, seeds array<{SEEDS}>"
)
#: Outcomes of mapping by their stored number. Fixed values.
REASONS = ("aligned", "no_seeds", "too_many_seeds", "bad_alignment", "no_policy", "repeats_only")



def complete(struct: str, given: dict[str, Column]) -> Column:
    """A struct of the type with the given fields, nulls elsewhere."""
    t = T.StructType.fromDDL(f"x {struct}")["x"].dataType
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.fields])


def result(read: Column, hit: Column, **rest: Column) -> list[Column]:
    """The columns of a record, defaults where nothing is given."""
    t = T.StructType.fromDDL(RESULT)
    given = {"read": read, "hit": hit, "members": F.array(), "nmembers": F.lit(0), "aln_stats": F.array(), "seeds": F.array()} | rest
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in t.fields]


def records(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Records of flat reads (read_id, seqid, description, sequence, quality array<int>, trim_left, trim_right) and hits (hit_id,
    read_id, ...), hits in order of hit_id. Reads without hits have an empty list; hits without a read are left out.

    Hits are grouped by read before the join, so that both sides are shuffled by read once."""
    one = complete(HIT, {c: F.col(c) for c in ("genome_name", "sequence", "start_pos", "aln_length", "score", "evalue", "cigar", "map_quality", "taxid")})
    lists = hits.where("read_id is not null").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("hit_id", one.alias("h")))).alias("hs"))
    j = reads.join(lists, "read_id", "left")
    read = complete(READ, {c: F.col(c) for c in ("seqid", "description", "sequence", "quality", "trim_left", "trim_right")})
    return j.select(*result(read, F.coalesce(F.col("hs.h"), F.array().cast(f"array<{HIT}>"))), "read_id")


def sanitize(df: DataFrame) -> DataFrame:
    """Records as every source hands them on: genome names in clean form, a quality of other length than the sequence, trim points
    outside it and an empty description dropped."""
    r = F.col("read")
    n = F.length(r["sequence"])
    left, right = r["trim_left"], r["trim_right"]
    bad_right = (right < 0) | (right > n)
    bad_left = (left < 0) | (left > F.when(bad_right | right.isNull(), n).otherwise(right))
    read = (
        r.withField("quality", F.when(F.size(r["quality"]) == n, r["quality"]))
        .withField("description", F.nullif(r["description"], F.lit("")))
        .withField("trim_left", F.when(~bad_left, left))
        .withField("trim_right", F.when(~bad_right, right))
    )
    return df.withColumns({"read": read, "hit": F.transform("hit", lambda h: h.withField("genome_name", clean_genome(h["genome_name"])))})


def sanitize_reads(reads: DataFrame, quality: str = "quality") -> DataFrame:
    """The same on flat reads."""
    n, left, right = F.length("sequence"), F.col("trim_left"), F.col("trim_right")
    bad_right = (right < 0) | (right > n)
    bad_left = (left < 0) | (left > F.when(bad_right | right.isNull(), n).otherwise(right))
    return reads.withColumns(
        {
            quality: F.when(F.size(quality) == n, F.col(quality)),
            "description": F.nullif(F.col("description"), F.lit("")),
            "trim_left": F.when(~bad_left, left),
            "trim_right": F.when(~bad_right, right),
        }
    )
