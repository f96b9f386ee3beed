"""Data sources for read files on Spark's Python data source interface, and the reader that picks one.

Uncompressed FastA and FastQ files are read in byte ranges; compressed and binary ones by one task per file.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readlake.functions import cigar as cg
from readlake.functions.seq import reverse_complement
from readlake.schema import HIT, READ, complete, result, sanitize
from readlake.sources.files import compressed, listing, open_plain, open_raw
from readlake.sources.native import layout, read_native
from readlake.sources.parsers import bam, fastq_lines, fastq_range, genome_fasta, sff

SCHEMA = (
    "seqid string, description string, sequence string, quality array<int>, trim_left int, trim_right int,"
    " hit array<struct<sequence:string,start_pos:bigint,aln_length:int,score:int,map_quality:int,cigar:array<struct<op:string,len:int>>>>"
)
GENOME = "genome_name string, sequence string, description string, contig int, offset bigint, range_start bigint, range_end bigint, bases string"
BATCH = 2000


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, schema, options: dict, kind: str) -> None:
        self.schema, self.options, self.kind = schema, options, kind

    def partitions(self) -> list[Range]:
        split = int(self.options.get("splitbytes", 64 << 20))
        out = []
        for path, size in listing(self.options["path"]):
            if self.kind != "fastq" or size <= split or compressed(path):
                out.append(Range(path, 0, -1))
            else:
                out += [Range(path, i, min(size, i + split)) for i in range(0, size, split)]
        return out or [Range("", 0, 0)]

    def _rows(self, p: Range):
        if not p.path:
            return
        o = self.options
        origin, solexa = int(o.get("origin", 33)), str(o.get("solexa", "false")).lower() == "true"
        if self.kind == "fastq" and p.end >= 0:
            with open_raw(p.path) as f:
                import io

                yield from fastq_range(io.BufferedReader(f, 1 << 20), p.start, p.end, origin, solexa)
            return
        with open_plain(p.path) as f:
            if self.kind == "fastq":
                yield from fastq_lines((x.rstrip(b"\r\n") for x in f), origin, solexa)
            elif self.kind == "bam":
                yield from bam(f)
            elif self.kind == "sff":
                yield from sff(f)
            else:
                yield from genome_fasta(f, o["genome"], int(o.get("maxn", 2)))

    def read(self, partition: Range):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows = []
        for r in self._rows(partition):
            rows.append(r)
            if len(rows) >= (4 if self.kind == "genome" else BATCH):
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _source(kind: str, schema_: str):
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"readlake-{kind}"

        def schema(self) -> str:
            return schema_

        def reader(self, schema):
            return _Reader(schema, dict(self.options), kind)

    return Source


def register(spark: SparkSession) -> None:
    """Make the formats readlake-fastq, readlake-bam, readlake-sff and readlake-genome known to the session."""
    for kind in ("fastq", "bam", "sff", "genome"):
        spark.dataSource.register(_source(kind, GENOME if kind == "genome" else SCHEMA))


def sniff(path: str) -> str:
    """Kind of the first file, not empty, that a path names: native, bam, sff, sam, fastq, parquet or unknown; through gzip and bzip2."""
    found = [p for p, size in listing(path) if size]
    if not found:
        return "unknown"
    with open_plain(found[0]) as f:
        head = f.read(1 << 12)
    if head[:4] == b"BAM\1":
        return "bam"
    if head[:4] == b".sff":
        return "sff"
    if head[:4] == b"PAR1":
        return "parquet"
    line = head.split(b"\n", 1)[0]
    if len(line) > 3 and line[:1] == b"@" and line[1:3].isalpha() and line[1:3].isupper() and line[3:4] == b"\t":
        return "sam"
    if line[:1] in (b">", b"@", b";"):
        return "fastq"
    if line.count(b"\t") >= 10:
        return "sam"
    return "native" if layout(head) else "unknown"


def as_records(flat: DataFrame, genome: str | None = None) -> DataFrame:
    """Records of flat rows as the file formats give them, in clean form."""
    read = complete(READ, {c: F.col(c) for c in ("seqid", "description", "sequence", "quality", "trim_left", "trim_right")})
    hit = F.transform("hit", lambda h: complete(HIT, {"genome_name": F.lit(genome)} | {c: h[c] for c in ("sequence", "start_pos", "aln_length", "score", "map_quality", "cigar")}))
    return sanitize(flat.select(*result(read, hit)))


def _sam_fault(c: Column) -> Column:
    """Why the columns of a SAM line are no alignment, or null."""
    number = lambda i, kind="int": c[i].try_cast(kind).isNull()
    seq = F.translate(F.upper(c[9]), ".", "N")
    return (
        F.when(F.size(c) < 11, "columns")
        .when(number(1) | number(3, "bigint") | number(4), "numbers")
        .when(~c[5].rlike(r"^(\*|(\d+[MIDNSHP=X])+)$"), "cigar")
        .when(~seq.rlike(r"^([ACGTN]+|\*)$"), "sequence")
    )


def sam_rejects(lines: DataFrame) -> DataFrame:
    """value, reason (columns, numbers, cigar, sequence: the first that holds) of the SAM lines that sam_rows leaves out but header lines."""
    return lines.where("value is not null").where(~F.startswith("value", F.lit("@"))).select("value", _sam_fault(F.split("value", "\t")).alias("reason")).where("reason is not null")


def sam_rows(lines: DataFrame) -> DataFrame:
    """Flat rows of SAM lines (value): header lines are dropped, reverse reads turned back, unmapped ones lose their hit, UQ goes before AS as score.
    Column expressions only. Lines that are no alignment are left out; sam_rejects has them with their reason."""
    c = F.split("value", "\t")
    d = lines.where(~F.startswith("value", F.lit("@"))).select("value", c.alias("c")).where(_sam_fault(F.col("c")).isNull())
    col = lambda i: F.col("c")[i]
    flag, mapq, pos = col(1).cast("int"), col(4).cast("int"), col(3).cast("bigint")
    seq = F.translate(F.upper(col(9)), ".", "N")
    back = flag.bitwiseAND(16) != 0
    cigar = cg.parse(col(5))
    scores = F.when(col(10) != "*", F.transform(F.split(col(10), ""), lambda x: F.ascii(x) - 33))
    tag = lambda t: F.nullif(F.regexp_extract("value", rf"\t{t}:i:(-?\d+)", 1), F.lit("")).cast("int")
    span = cg.reference_span(cigar)
    hit = F.struct(
        F.nullif(col(2), F.lit("*")).alias("sequence"), (pos - 1).alias("start_pos"), F.when(back, -span).otherwise(span).cast("int").alias("aln_length"),
        F.coalesce(tag("UQ"), tag("AS")).alias("score"), F.when(mapq < 255, mapq).alias("map_quality"), F.when(back, F.reverse(cigar)).otherwise(cigar).alias("cigar"),
    )
    return d.select(
        col(0).alias("seqid"), F.lit(None).cast("string").alias("description"), F.when(back, reverse_complement(seq)).otherwise(seq).alias("sequence"),
        F.when(back, F.reverse(scores)).otherwise(scores).cast("array<int>").alias("quality"), F.lit(None).cast("int").alias("trim_left"), F.lit(None).cast("int").alias("trim_right"),
        F.when(flag.bitwiseAND(4) != 0, F.slice(F.array(hit), 1, 0)).otherwise(F.array(hit)).alias("hit"),
    )


def read(spark: SparkSession, path: str, genome: str | None = None, solexa: bool = False, origin: int = 33) -> DataFrame:
    """Records of any file format that the engine knows, told by the first bytes; patterns and folders of files of one kind too."""
    kind = sniff(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "sam":
        return as_records(sam_rows(spark.read.text(path)), genome)
    if kind in ("fastq", "bam", "sff"):
        register(spark)
        return as_records(spark.read.format(f"readlake-{kind}").options(path=path, solexa=str(solexa), origin=str(origin)).load(), genome)
    if kind == "native":
        return read_native(spark, path)
    raise ValueError(f"{path}: unknown kind of file")


def read_genome(spark: SparkSession, path: str, genome: str, maxn: int = 2) -> DataFrame:
    """Pieces of contigs of a genome in FastA."""
    register(spark)
    return spark.read.format("readlake-genome").options(path=path, genome=genome, maxn=str(maxn)).load()


def contig_table(pieces: DataFrame) -> DataFrame:
    """genome_name, sequence, contig, offset, range_start, range_end of the contigs that pieces make."""
    return pieces.groupBy("genome_name", "sequence", "contig").agg(F.min("offset").alias("offset"), F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, rest of tab-separated region files with one header line: bin, chrom, start, end, rest."""
    d = spark.read.schema("bin string, chrom string, start bigint, end bigint, rest string").option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    return d.drop("bin")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value: lines with an order within their file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("line_no"), "value")


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    from readlake.operators.chains import blocks_from_lines, with_depth

    return with_depth(blocks_from_lines(read_lines(spark, path)))


def read_sites(spark: SparkSession, path: str, indels: bool | None = None) -> DataFrame:
    """Site tables: site_id, kind, h_base, h_chrom, h_strand, h_pos, h_end, c_..., out_base, sequence, flags, rest. Kind is guessed from the file name without indels."""
    d = read_lines(spark, path).where(~F.startswith("value", F.lit("#")))
    kind = F.lit(indels) if indels is not None else F.lower("file").contains("indel")
    c = F.split("value", "\t")
    at = lambda i: F.nullif(F.try_element_at(c, F.lit(i + 1)), F.lit(""))
    pick = lambda snp, indel: F.when(kind, at(indel) if indel is not None else F.lit(None)).otherwise(at(snp) if snp is not None else F.lit(None))
    num = lambda x: x.try_cast("bigint")
    return d.select(
        F.xxhash64("file", "line_no").alias("site_id"),
        F.when(kind, at(0)).otherwise("snp").alias("kind"),
        pick(0, None).alias("h_base"), pick(1, 1).alias("h_chrom"), pick(2, 2).alias("h_strand"), num(pick(3, 3)).alias("h_pos"), num(pick(None, 4)).alias("h_end"),
        pick(4, None).alias("c_base"), pick(5, 5).alias("c_chrom"), pick(6, 6).alias("c_strand"), num(pick(7, 7)).alias("c_pos"), num(pick(None, 8)).alias("c_end"),
        pick(8, None).alias("out_base"), pick(None, 9).alias("sequence"), pick(9, 10).alias("flags"),
        F.array_join(F.slice(c, F.when(kind, 12).otherwise(11), F.greatest(F.lit(0), F.size(c) - F.when(kind, 11).otherwise(10))), "\t").alias("rest"),
    )


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, start, len, seq of simulated reads."""
    return spark.read.schema("chrom string, strand string, start bigint, len int, seq string").option("sep", "\t").csv(path)
