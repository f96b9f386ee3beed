"""Problem 1: base qualities in many units to Phred scores per base.

The unit texts are parsed by the grammar of ``functions.units`` (Arrow batches, cached per text); the values themselves are decoded
by built-in expressions. The only shuffles are the vote of runs that have no note (combined map-side to one row per run) and
whatever join with the run table Spark picks; the run table holds a row per run, not per read.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.functions.units import ERROR, ODDS, parse_unit
from readlake.session import spread

UNIT = T.StructType(
    [
        T.StructField("dim", T.StringType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("offset", T.DoubleType()),
        T.StructField("origin", T.IntegerType()),
    ]
)
SEPARATORS = r"[\s,;%]+"
#: Highest Phred score of an error probability of zero or less than 10^-9.3, the highest that a character of origin 33 can hold.
MAX_PHRED = 93


def _units():
    """A pandas UDF from texts to units; made per session as it pickles the grammar."""
    seen: dict = {}

    def unit(text):
        if text not in seen:
            if len(seen) > 50_000:
                seen.clear()
            seen[text] = parse_unit(text)
        return seen[text]

    @F.pandas_udf(UNIT)
    def unit_of(texts: pd.Series) -> pd.DataFrame:
        got = [unit(t) for t in texts]
        kind = {ERROR: "error", ODDS: "odds"}
        return pd.DataFrame(
            {
                "dim": [None if u is None else kind.get(u.vector, "level") for u in got],
                "scale": pd.Series([None if u is None else u.scale for u in got], dtype="float64"),
                "offset": pd.Series([None if u is None else u.offset for u in got], dtype="float64"),
                "origin": pd.Series([None if u is None else u.origin for u in got], dtype="Int32"),
            }
        )

    return unit_of


def _scores(quality: Column, unit: Column) -> Column:
    """Values of one quality text as doubles in the canonical unit of their dimension."""
    chars = F.transform(F.split(quality, ""), lambda c: (F.ascii(c) - unit["origin"]).cast("double") * unit["scale"] + unit["offset"])
    cut = F.regexp_replace(quality, f"^{SEPARATORS}|{SEPARATORS}$", "")
    numbers = F.transform(F.split(cut, SEPARATORS), lambda v: v.try_cast("double") * unit["scale"] + unit["offset"])
    return F.when(unit["origin"].isNotNull(), chars).otherwise(numbers)


def _phred(value: Column, dim: Column) -> Column:
    """Canonical value of a dimension to a Phred score, rounded half up."""
    level = (
        F.when(dim == "level", value)
        .when(dim == "odds", F.log10(1 + F.pow(F.lit(10.0), value / 10)) * 10)
        .when((value >= 0) & (value <= 1), F.least(F.lit(float(MAX_PHRED)), F.coalesce(F.log10(value) * -10, F.lit(float(MAX_PHRED)))))
    )
    return F.floor(level + 0.5).cast("int")


def unread_notes(runs: DataFrame) -> DataFrame:
    """run_id, run_note of the runs whose note isn't blank and names no unit, or several that differ: their reads' characters decide."""
    u = runs.where("trim(run_note) <> ''").select("run_id", "run_note", _units()("run_note").alias("u"))
    return u.where("u.dim is null").select("run_id", "run_note")


def normalize_quality(reads: DataFrame, runs: DataFrame, evidence: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """read_id, run_id, sequence, unit (dim, scale, offset, origin), standard (one character per base, Phred, origin 33), phred array<int>, phred_total.

    A read's description overrules its run's note; where neither names a unit, the characters of the run decide between origin 33 and
    64 by majority of its reads (those with a character below '@' against those with one above 'J'; a tie is 33). phred is null,
    and so is phred_total, where the quality is null, empty, '*', has another number of scores than the sequence has bases, or holds
    something that isn't a value of its unit. Repeated rows give repeated rows; a run listed twice counts once (its greatest note);
    other columns are ignored. Null run_ids are one run without note. Where reads are a part of all reads, evidence holds all, for the
    vote. Columns in keep are passed on.
    """
    unit_of = _units()
    notes = runs.groupBy("run_id").agg(F.max("run_note").alias("note")).select(F.col("run_id").alias("r_id"), unit_of("note").alias("r_unit"))

    def own_unit(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        r = spread(rows.select(*keep, "read_id", "run_id", "sequence", "quality", "description")).select(*keep, "read_id", "run_id", "sequence", "quality", unit_of("description").alias("d_unit")).join(notes, F.col("run_id") == F.col("r_id"), "left")
        # a null struct comes back as a struct of nulls
        own = F.when(F.col("d_unit.dim").isNotNull(), F.col("d_unit")).when(F.col("r_unit.dim").isNotNull(), F.col("r_unit"))
        return r.select(*keep, "read_id", "run_id", "sequence", "quality", own.alias("unit"))

    r = own_unit(reads, keep)
    voters = own_unit(reads) if evidence is None else own_unit(evidence)
    given = (F.length("quality") > 0) & (F.col("quality") != "*") & F.col("sequence").isNotNull()
    votes = (
        voters.where(F.col("unit").isNull() & given & (F.length("quality") == F.length("sequence")))
        .groupBy("run_id")
        .agg(F.sum(F.col("quality").rlike("[!-?]").cast("int")).alias("low"), F.sum(F.col("quality").rlike("[K-~]").cast("int")).alias("high"))
        .select(F.col("run_id").alias("v_id"), F.when(F.col("high") > F.col("low"), 64).otherwise(33).alias("seen"))
    )
    r = r.join(votes, F.col("run_id").eqNullSafe(F.col("v_id")), "left")
    guess = F.struct(
        F.lit("level").alias("dim"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.coalesce("seen", F.lit(33)).alias("origin")
    )
    r = r.select(*keep, "read_id", "run_id", "sequence", "quality", F.coalesce("unit", guess).alias("unit"))
    unit = F.col("unit")
    standard = (unit["dim"] == "level") & (F.coalesce(unit["origin"], F.lit(0)) == 33)
    r = r.withColumns({"standard": standard, "values": F.when(given, _scores(F.col("quality"), unit))})
    fits = F.size("values") == F.length("sequence")
    phred = F.when(fits, F.transform("values", lambda v: _phred(v, unit["dim"])))
    r = r.select(*keep, "read_id", "run_id", "sequence", "unit", "standard", phred.alias("p"))
    # a score that isn't a number of its unit, or is below the least of its scale, spoils the read
    least = F.when(unit["origin"].isNotNull() & (unit["dim"] == "level"), 0).otherwise(-5)
    ok = ~F.exists("p", lambda x: x.isNull() | (x < least))
    r = r.withColumn("phred", F.when(ok, F.col("p"))).drop("p")
    return r.withColumn("phred_total", F.aggregate("phred", F.lit(0).cast("bigint"), lambda a, x: a + x))


def recorded_otherwise(reads: DataFrame, runs: DataFrame) -> DataFrame:
    """read_id, phred_total of the reads with a valid quality that isn't recorded as one character per base, Phred, origin 33."""
    return normalize_quality(reads, runs).where(~F.col("standard") & F.col("phred_total").isNotNull()).select("read_id", "phred_total")
