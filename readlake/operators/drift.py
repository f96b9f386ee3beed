"""Problem 4: records of drifting schemas to one table, with the changes of each file.

Each body becomes a map from paths to values as a Spark variant, row-locally. Path statistics (types, and shapes of values) are one
map-side combined aggregate per file and path. From them alone other spellings of a field are told: a path whose values are shaped as the
field's are, and that stands in files where the field doesn't. Files are compared with their producer's previous file by a grouped
union, not a join per field; the typed columns are projections of the entries with the failed casts beside them, and what is no field
of a hit stays in a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.operators.blocked import with_neighbour
from readlake.session import collect_bounded, durable

#: Fields of a hit.
FIELDS = ("genome_name", "sequence", "start_pos", "aln_length", "score", "evalue", "cigar", "map_quality", "taxid")
#: A path stands for a field if its values diverge from the field's by so many nats at most, and the two share so many of its files at most.
DIVERGENCE, TOGETHER = 1.0, 0.1
#: Divergence of a value of a form (number, text, array of objects ...) that the field's values don't have: fields may change their type.
OTHER_FORM = 4.0
#: Longest shape of a text that is kept in full, in characters; a digest of the whole stands for a longer one, and is longer than that.
LONG_SHAPE = 64
#: Spellings that the driver and the plan hold at most.
MAX_SPELLINGS = 100_000
#: Operation letters of a packed cigar, length * 16 + code. Fixed values.
CIGAR_CODES = {0: "M", 1: "I", 2: "D", 3: "N", 4: "S", 5: "H", 6: "P", 15: "X"}
CIGAR_TYPE = "array<struct<op:string,len:int>>"


def _pairs(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _key(path: Column) -> Column:
    """A path without letter case and underscores."""
    return F.lower(F.regexp_replace(path, "_", ""))


def canonical(path: Column, spellings: dict[str, str]) -> Column:
    """The field that a top-level key stands for, or the key itself. spellings: field by key, in lower case and without underscores."""
    known = _pairs({f.replace("_", ""): f for f in FIELDS} | spellings)
    return F.coalesce(F.try_element_at(known, _key(path)), path)


def json_type(value: Column) -> Column:
    """JSON type of a variant; null for JSON null and an empty array, which tell no type."""
    t = F.schema_of_variant(value)
    return (
        F.when(t.isin("VOID", "ARRAY<VOID>") | t.isNull(), F.lit(None).cast("string"))
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("OBJECT"), "object")
        .when(t.startswith("ARRAY<OBJECT"), "array of objects")
        .when(t == "ARRAY<STRING>", "array of strings")
        .when(t.rlike(r"^ARRAY<(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)>$"), "array of numbers")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def _object(body: str = "body") -> tuple[Column, Column]:
    """The body as a variant, and whether it is an object."""
    v = F.try_parse_json(body)
    return v, F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def entries(records: DataFrame, spellings: dict[str, str]) -> DataFrame:
    """record_id, file_id, record_no, parsed (boolean), entries array<struct<field, path, type, value>>.

    A body that is null, no JSON or no object is not parsed and has no entries."""
    v, is_object = _object()
    r = records.select("record_id", "file_id", "record_no", v.alias("v"), is_object.alias("parsed"))
    pairs = F.map_entries(F.when(F.col("parsed"), F.col("v")).cast("map<string,variant>"))
    made = F.transform(
        pairs,
        lambda e: F.struct(canonical(e["key"], spellings).alias("field"), e["key"].alias("path"), json_type(e["value"]).alias("type"), e["value"].alias("value")),
    )
    return r.select("record_id", "file_id", "record_no", "parsed", F.coalesce(made, F.array().cast("array<struct<field:string,path:string,type:string,value:variant>>")).alias("entries"))


def path_stats(records: DataFrame) -> DataFrame:
    """producer, file_id, written_at, path, type, form, shape, n: rows of each file that hold the path with a value of that type and shape.

    form: number (a JSON number, or a text that spells one), text, or the type. shape: sign, wholeness and binary magnitude of a number, a
    whole text with its digit groups as 9 (# and the SHA-256 of that where it is longer than LONG_SHAPE, as shapes are only compared), the
    schema of anything else. Nulls and empty arrays have neither type nor shape. A file without any path has one row of a null path.
    Rows without file_id, producer or written_at are left out."""
    v, is_object = _object()
    r = records.where("file_id is not null and producer is not null and written_at is not null").select("producer", "file_id", "written_at", v.alias("v"), is_object.alias("o"))
    e = r.select("producer", "file_id", "written_at", F.explode_outer(F.when(F.col("o"), F.col("v")).cast("map<string,variant>")).alias("path", "value"))
    e = e.select("producer", "file_id", "written_at", "path", json_type(F.col("value")).alias("type"), F.schema_of_variant("value").alias("s"), F.try_variant_get("value", "$", "string").alias("t"))
    # columns of their own, so that each is computed once for a value
    e = e.withColumn("number", F.when(F.col("type").isin("number", "string"), F.col("t").try_cast("double")))
    number = F.col("number")
    counted = number.isNotNull() & ~F.isnan(number)
    e = e.withColumn("text", F.when((F.col("type") == "string") & ~counted, F.regexp_replace("t", "[0-9]+", "9")))
    magnitude = F.floor(F.log2(F.greatest(F.abs(number), F.lit(1e-300)))).cast("string")
    shape = (
        F.when(counted, F.concat(F.when(number < 0, "-").otherwise("+"), F.when(number == F.floor(number), "i").otherwise("d"), magnitude))
        .when(F.col("type") == "string", F.when(F.length("text") > LONG_SHAPE, F.concat(F.lit("#"), F.sha2("text", 256))).otherwise(F.col("text")))
        .when(F.col("type").isNotNull(), F.col("s"))
    )
    form = F.when(number.isNotNull(), "number").when(F.col("type") == "string", "text").otherwise(F.col("type"))
    return e.select("producer", "file_id", "written_at", "path", "type", form.alias("form"), shape.alias("shape")).groupBy("producer", "file_id", "written_at", "path", "type", "form", "shape").agg(F.count(F.lit(1)).alias("n"))


def inferred_spellings(stats: DataFrame) -> DataFrame:
    """key, field, divergence: paths (without letter case and underscores) that stand for a field of another name.

    The values of such a path are shaped as the field's (the divergence of the two distributions of shapes, form by form, is at most
    DIVERGENCE, and a little more for a path of few values), and no more than TOGETHER of its files hold the field under its own name. Of
    several such fields the least divergent counts, then the first by name. A field that no file holds under its own name has no
    other spelling. stats: see path_stats; everything after one more aggregate of it is a row per path and shape."""
    named = F.try_element_at(_pairs({f.replace("_", ""): f for f in FIELDS}), _key(F.col("path")))
    s = stats.where("path is not null").withColumns({"key": _key(F.col("path")), "field": named})
    shapes = s.where("shape is not null").groupBy("key", "field", "form", "shape").agg(F.sum("n").alias("n"))
    known = shapes.where("field is not null").select("field", "form", "shape", "n")
    q, forms = known.withColumnRenamed("n", "qn"), known.groupBy("field", "form").agg(F.sum("n").alias("qall"), F.count(F.lit(1)).alias("kinds"))
    other = shapes.where("field is null").select("key", "form", "shape", "n")
    sums, keys = other.groupBy("key", "form").agg(F.sum("n").alias("pall")), other.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    tried = other.join(sums, ["key", "form"]).join(keys, "key").withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    tried = tried.join(forms, ["field", "form"], "left").join(q, ["field", "form", "shape"], "left")
    expected = (F.coalesce("qn", F.lit(0)) + 0.5) / (F.col("qall") + 0.5 * (F.col("kinds") + 1))
    cost = F.col("n") / F.col("all") * F.coalesce(F.log(F.col("n") / F.col("pall") / expected), F.lit(OTHER_FORM))
    near = tried.groupBy("key", "field").agg(F.sum(cost).alias("divergence"), F.first("all").alias("all"), F.first("k").alias("k"))
    near = near.where(F.col("divergence") <= DIVERGENCE + F.col("k") / F.col("all"))
    # at most as many fields as a hit has stand in the row of a file
    held = s.where("field is not null").groupBy("file_id").agg(F.collect_set("field").alias("fields"))
    files = s.where("field is null").select("key", "file_id").distinct()
    size = files.groupBy("key").agg(F.count(F.lit(1)).alias("files"))
    both = files.join(held, "file_id").select("key", F.explode("fields").alias("field")).groupBy("key", "field").agg(F.count(F.lit(1)).alias("together"))
    ok = near.join(size, "key").join(both, ["key", "field"], "left").where(F.coalesce("together", F.lit(0)) <= TOGETHER * F.col("files"))
    best = ok.groupBy("key").agg(F.min(F.struct("divergence", "field")).alias("b"))
    return best.select("key", "b.field", "b.divergence")


def spellings_of(stats: DataFrame) -> dict[str, str]:
    """The inferred spellings as a dictionary for canonical."""
    return {r["key"]: r["field"] for r in collect_bounded(inferred_spellings(stats).select("key", "field"), MAX_SPELLINGS, "table of spellings")}


def file_changes(records: DataFrame, spellings: dict[str, str] | None = None) -> DataFrame:
    """file_id, field, change: added, removed, renamed or retyped against the producer's previous file.

    Files of a producer follow each other by written_at, then file_id; its first file has no row. A file has a field if any of its
    records has the key, with a null too. A field is renamed if the sets of its spellings differ, retyped if the sets of its JSON types
    differ and neither is empty (nulls and empty arrays tell no type). Rows delivered twice change nothing; rows without file_id,
    producer or written_at, or without a JSON object, tell nothing, but a file of such bodies only is a file without fields. spellings
    (field by key in lower case without underscores) is inferred from the records where it isn't given.
    """
    paths = durable(path_stats(records))
    names = spellings_of(paths) if spellings is None else spellings
    keyed = paths.select("producer", "file_id", "written_at", canonical(F.col("path"), names).alias("field"), "path", "type")
    # types of one field and file: a handful; sets stay small by the number of spellings and JSON types
    stats = keyed.groupBy("producer", "file_id", "written_at", "field").agg(F.collect_set("path").alias("paths"), F.collect_set("type").alias("types"))
    files = stats.groupBy("producer", "file_id").agg(F.min("written_at").alias("at"))
    order = [F.col("at"), F.col("file_id")]
    linked = with_neighbour(files, ["producer"], F.date_trunc("day", F.col("at")), order, F.struct("file_id"), "before")
    linked = linked.where("before is not null").select(F.col("file_id").alias("this"), F.col("before.file_id").alias("before"))
    s = stats.where("field is not null").select("file_id", "field", F.array_sort("paths").alias("paths"), F.array_sort("types").alias("types"))
    # each file's fields are seen once as its own and once as what went before in the next file
    own = s.join(linked, F.col("file_id") == F.col("this")).select("this", "field", F.lit(True).alias("own"), "paths", "types")
    old = s.join(linked, F.col("file_id") == F.col("before")).select("this", "field", F.lit(False).alias("own"), "paths", "types")
    pick = lambda c, own: F.max(F.when(F.col("own") == own, F.col(c)))
    both = (
        own.unionByName(old)
        .groupBy("this", "field")
        .agg(pick("paths", True).alias("p1"), pick("types", True).alias("t1"), pick("paths", False).alias("p0"), pick("types", False).alias("t0"))
    )
    kinds = F.array_compact(
        F.array(
            F.when(F.col("p0").isNull(), "added"),
            F.when(F.col("p1").isNull(), "removed"),
            F.when(F.col("p0") != F.col("p1"), "renamed"),
            F.when((F.col("t0") != F.col("t1")) & (F.size("t0") > 0) & (F.size("t1") > 0), "retyped"),
        )
    )
    return both.select(F.col("this").alias("file_id"), "field", F.explode(kinds).alias("change"))


def _number(value: Column, kind: Column) -> Column:
    """A number or a string that spells one, as double; null otherwise."""
    return F.when(kind.isin("number", "string"), F.try_variant_get(value, "$", "string").try_cast("double"))


def _whole(value: Column, kind: Column, to: str) -> Column:
    n = _number(value, kind)
    return F.when(n == F.floor(n), n.try_cast(to))


def _length(value: Column, kind: Column) -> Column:
    """Alignment length: a number, its text, or an object of length and strand; the reverse strand is negative."""
    n = F.abs(F.try_variant_get(value, "$.length", "int"))
    side = F.try_variant_get(value, "$.strand", "string")
    return F.when(kind == "object", F.when(side == "-", -n).when(side == "+", n)).otherwise(_whole(value, kind, "int"))


def _cigar(value: Column, kind: Column) -> Column:
    """Cigar as text (26M1I27M), packed numbers (length * 16 + code) or objects of op and len."""
    text = F.try_variant_get(value, "$", "string")
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+[A-Z=])"), 1), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_replace(x, "[A-Z=]", "").try_cast("int").alias("len")))
    packed = F.transform(
        F.try_variant_get(value, "$", "array<int>"),
        lambda x: F.struct(F.try_element_at(_pairs(CIGAR_CODES), x.bitwiseAND(15)).alias("op"), F.shiftright(x, 4).alias("len")),
    )
    objects = F.try_variant_get(value, "$", CIGAR_TYPE)
    got = (
        F.when((kind == "string") & text.rlike(r"^(\d+[MIDNSHPX=])+$"), runs)
        .when(kind == "array of numbers", packed)
        .when(kind == "array of objects", objects)
        .cast(CIGAR_TYPE)
    )
    return F.when(~F.exists(got, lambda x: x["op"].isNull() | x["len"].isNull()), got)


def _first(field: str) -> Column:
    """The first entry of a field that has a value."""
    return F.try_element_at(F.filter("entries", lambda x: (x["field"] == field) & x["type"].isNotNull()), F.lit(1))


def unified_hits(records: DataFrame, spellings: dict[str, str] | None = None) -> DataFrame:
    """One row per delivered record: record_id, file_id, record_no, the hit's fields typed, failed array<struct<field, path, type, raw>>, rest map<string,string>, parsed.

    Of records delivered twice (same file_id and record_no) the one with the smallest record_id stays; records without file_id or
    record_no stand for themselves. A field of several spellings takes the first non-null in order of the key. A value that is no
    value of its column gives null there and an entry in failed. rest holds every other path of the record with its value as JSON, also
    nulls and further spellings of a field. A body that is no JSON object gives a row of nulls with parsed false. spellings is
    inferred from the records where it isn't given.
    """
    if spellings is None:
        spellings = spellings_of(durable(path_stats(records)))
    e = entries(records, spellings).withColumn("alone", F.when(F.col("file_id").isNull() | F.col("record_no").isNull(), F.col("record_id")))
    e = e.select("record_id", "file_id", "record_no", "alone", "parsed", "entries")
    casts = {
        "genome_name": lambda v, k: F.when(k == "string", F.try_variant_get(v, "$", "string")),
        "sequence": lambda v, k: F.when(k == "string", F.try_variant_get(v, "$", "string")),
        "start_pos": lambda v, k: _whole(v, k, "bigint"),
        "aln_length": _length,
        "score": lambda v, k: _whole(v, k, "int"),
        "evalue": _number,
        "cigar": _cigar,
        "map_quality": lambda v, k: _whole(v, k, "int"),
        "taxid": lambda v, k: _whole(v, k, "int"),
    }
    typed, failed = [], []
    for f, cast in casts.items():
        first = _first(f)
        value = cast(first["value"], first["type"])
        typed.append(value.alias(f))
        raw = F.struct(F.lit(f).alias("field"), first["path"].alias("path"), first["type"].alias("type"), F.to_json(first["value"]).alias("raw"))
        failed.append(F.when(first["type"].isNotNull() & value.isNull(), raw))
    used = F.array(*[_first(f)["path"] for f in casts])
    other = F.filter("entries", lambda x: ~F.array_contains(F.array_compact(used), x["path"]))
    kept = F.map_from_entries(F.transform(other, lambda x: F.struct(x["path"].alias("key"), F.to_json(x["value"]).alias("value"))))
    rows = e.select("record_id", "file_id", "record_no", "alone", "parsed", *typed, F.array_compact(F.array(*failed)).alias("failed"), kept.alias("rest"))
    own = [c for c in rows.columns if c not in ("file_id", "record_no", "alone")]
    one = rows.groupBy("file_id", "record_no", "alone").agg(F.min_by(F.struct(*own), F.col("record_id")).alias("r"))
    return one.select("r.record_id", "file_id", "record_no", *[f"r.{c}" for c in own if c != "record_id"])
