"""Problem 2: records that break the line format, apart from those that load.

One pass, no shuffle: each Arrow batch is checked for quoting by one RE2 pattern, parsed by pyarrow's CSV reader (whose invalid-row
callback gives the records with a wrong number of columns), read as strings, and cast column by column; the first failing check of a
record is its reason.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.session import spread

FIELDS = ("seqid", "description", "sequence", "quality", "trim_left", "trim_right")
SCHEMA = (
    "raw_id bigint, file_name string, line_no bigint, seqid string, description string, sequence string, quality string,"
    " trim_left int, trim_right int, reason string, failing string"
)
_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^",]*|)'
#: Every field is quoted as a whole or holds no quote.
WELL_QUOTED = rf"(?s)\A{_FIELD}(?:,{_FIELD})*\z"
BASES = r"\A[ACGTURYSWKMBDHVNacgturyswkmbdhvn-]+\z"
QUALITY = r"\A[!-~]*\z"
DIGITS = r"\A[0-9]*\z"
MAX_TRIM = 2**31 - 1


def _batches(batches: Iterable) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyarrow import csv

    names = ["n", *FIELDS]
    out_schema = pa.schema(
        [("raw_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int64())]
        + [(f, pa.string()) for f in FIELDS[:4]]
        + [("trim_left", pa.int32()), ("trim_right", pa.int32()), ("reason", pa.string()), ("failing", pa.string())]
    )

    def hide(x):  # line ends may stand in fields; a record is one row here, so they are written as escapes while pyarrow splits rows
        for a, b in (("\x1e", "\x1e0"), ("\n", "\x1e1"), ("\r", "\x1e2"), ("\x00", "\x1e3")):
            x = pc.replace_substring(x, a, b)
        return x

    def show(x):
        for a, b in (("\x00", "\x1e3"), ("\r", "\x1e2"), ("\n", "\x1e1"), ("\x1e", "\x1e0")):
            x = pc.replace_substring(x, b, a)
        return x

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        line = b.column("line").cast(pa.string())
        text = pc.fill_null(line, "")
        quoted = pc.match_substring_regex(text, WELL_QUOTED)
        at = pc.filter(pa.array(range(n), pa.int64()), quoted)
        body = hide(pc.filter(text, quoted))
        numbered = pc.binary_join_element_wise(pc.cast(at, pa.string()), body, ",")
        data = "\n".join(numbered.to_pylist()).encode() + b"\n"
        wrong: list[int] = []

        def bad(row, wrong=wrong):
            wrong.append(int(row.text.split(",", 1)[0]))
            return "skip"

        reason: list = ["quoting"] * n
        if len(at):
            t = csv.read_csv(
                pa.BufferReader(data),
                read_options=csv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
                parse_options=csv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=bad),
                convert_options=csv.ConvertOptions(
                    column_types={"n": pa.int64()} | dict.fromkeys(FIELDS, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False
                ),
            ).combine_chunks()
        else:
            t = pa.table({k: pa.array([], pa.int64() if k == "n" else pa.string()) for k in names})
        flat = lambda c: pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        number_of = flat(t["n"]).to_pylist()
        cols = {k: show(flat(t[k])) for k in FIELDS}
        seq_ok = pc.match_substring_regex(cols["sequence"], BASES)
        q = cols["quality"]
        q_ok = pc.or_(
            pc.equal(q, ""),
            pc.and_(pc.equal(pc.utf8_length(q), pc.utf8_length(cols["sequence"])), pc.match_substring_regex(q, QUALITY)),
        )
        left_ok, right_ok = (pc.match_substring_regex(cols[k], DIGITS) for k in FIELDS[4:])
        first = pc.case_when(
            pc.make_struct(pc.invert(seq_ok), pc.invert(q_ok), pc.invert(pc.and_(left_ok, right_ok))), "bad_sequence", "bad_quality", "bad_trim"
        )
        marks = [pc.if_else(ok, "", name + ",") for ok, name in zip((seq_ok, q_ok, left_ok, right_ok), FIELDS[2:], strict=True)]
        cells = pc.utf8_rtrim(pc.binary_join_element_wise(*marks, ""), ",")
        for i, r in zip(number_of, first.to_pylist(), strict=True):
            reason[i] = r
        for i in wrong:
            reason[i] = "column_count"
        reason = [("column_count" if v is None else r) for v, r in zip(line.to_pylist(), reason, strict=True)] if line.null_count else reason
        order: list = [None] * n
        for k, i in enumerate(number_of):
            order[i] = k
        take = pa.array(order, pa.int64())
        good = pa.array([r is None for r in reason])

        def number(c):  # digits beyond an int are a trim point out of range: null, as for an empty cell
            digits = pc.if_else(pc.match_substring_regex(c, r"\A0*[0-9]{1,10}\z"), pc.replace_substring_regex(c, r"\A0+([0-9])", r"\1"), None)
            v = pc.cast(digits, pa.int64())
            return pc.cast(pc.if_else(pc.less_equal(v, MAX_TRIM), v, None), pa.int32())

        fields = [pc.if_else(good, pc.take(cols[k], take), None) for k in FIELDS[:4]]
        trims = [pc.if_else(good, pc.take(number(cols[k]), take), None) for k in FIELDS[4:]]
        failing = pc.take(cells, take)
        failing = pc.if_else(pc.equal(failing, ""), None, failing)
        yield pa.RecordBatch.from_arrays(
            [b.column("raw_id"), b.column("file_name"), b.column("line_no"), *map(flat, (*fields, *trims)), pa.array(reason, pa.string()), flat(failing)], schema=out_schema
        )


def load_lines(lines: DataFrame) -> DataFrame:
    """One row per row of lines (raw_id, file_name, line_no, line): the six fields of those that load, or reason and failing cells.

    reason is null for a record that loads, else the first that holds of quoting, column_count, bad_sequence, bad_quality and bad_trim;
    failing names the cells whose values failed. A null or empty line has the reason column_count. A line end outside quotes is an
    ordinary character, as a record is a row. An empty description or quality is the empty string; an empty trim point, or one beyond
    an int, is null. Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty table.
    """
    src = lines.select(
        F.col("raw_id").cast("bigint").alias("raw_id"), F.col("file_name").cast("string").alias("file_name"), F.col("line_no").cast("bigint").alias("line_no"), "line"
    )
    return spread(src).mapInArrow(_batches, SCHEMA)


def rejects(lines: DataFrame) -> DataFrame:
    """raw_id, reason of the lines that fail."""
    return load_lines(lines).where("reason is not null").select("raw_id", "reason")


def loaded(lines: DataFrame) -> DataFrame:
    """The reads of the lines that load."""
    return load_lines(lines).where("reason is null").drop("reason", "failing")
