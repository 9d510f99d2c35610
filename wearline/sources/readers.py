"""Input formats of the workflows.

Explicit schemas everywhere (never ``inferSchema``).  Readers return lazy
DataFrames; files are split and parsed in parallel.  Contract violations
become rows of a quarantine DataFrame with a reason instead of exceptions,
so one bad file does not stop a fleet-wide load.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as C
from ..operators.ordered import prefix_sums, reused
from ..operators.windows import trailing_columns

# S1 ------------------------------------------------------------------------

MACHINE_CSV_COLUMNS = [
    ("UDI", T.IntegerType()), ("Product ID", T.StringType()), ("Type", T.StringType()),
    ("Air temperature [K]", T.DoubleType()), ("Process temperature [K]", T.DoubleType()),
    ("Rotational speed [rpm]", T.IntegerType()), ("Torque [Nm]", T.DoubleType()),
    ("Tool wear [min]", T.IntegerType()), ("Machine failure", T.IntegerType()),
    ("TWF", T.IntegerType()), ("HDF", T.IntegerType()), ("PWF", T.IntegerType()),
    ("OSF", T.IntegerType()), ("RNF", T.IntegerType()),
]
MACHINE_RENAMES = {
    "UDI": "udi", "Product ID": "product_id", "Type": "type", "Air temperature [K]": "air_temperature",
    "Process temperature [K]": "process_temperature", "Rotational speed [rpm]": "rotational_speed",
    "Torque [Nm]": "torque", "Tool wear [min]": "tool_wear", "Machine failure": "failure",
    "TWF": "twf", "HDF": "hdf", "PWF": "pwf", "OSF": "osf", "RNF": "rnf",
}


def read_machine_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 14-column machine-observation CSV (header with units in the
    names) with a fixed schema, renamed to snake-case columns."""
    schema = T.StructType([T.StructField(n, t, True) for n, t in MACHINE_CSV_COLUMNS])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.withColumnsRenamed(MACHINE_RENAMES)


# S2 ------------------------------------------------------------------------

TRAJECTORY_COLUMNS = ["unit_id", "cycle", *C.OPERATIONAL_SETTINGS, *C.SENSORS]


def read_trajectory_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-delimited, headerless trajectories (26 positional
    columns; lines may carry trailing blanks).  ``csv(sep=' ')`` would invent
    empty columns, so lines are split on runs of whitespace."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = [parts.getItem(0).cast("int").alias("unit_id"), parts.getItem(1).cast("int").alias("cycle")]
    cols += [parts.getItem(i + 2).cast("double").alias(c) for i, c in enumerate(TRAJECTORY_COLUMNS[2:])]
    return lines.select(*cols, F.size(parts).alias("_fields"))


# S3 ------------------------------------------------------------------------

def read_positional_labels(spark: SparkSession, path: str, name: str = "provided_rul") -> DataFrame:
    """S3: one integer per line; line i belongs to the i-th smallest unit.

    Line order comes from the reader's row ids (partition index and offset
    inside the file split, stable for a given file) ranked with distributed
    prefix sums; no whole-file string in one task.  The order of several files
    is not defined, so more than one is an error.
    """
    text = spark.read.text(path)
    files = text.inputFiles()
    if len(files) > 1:
        raise ValueError(f"a positional label list is one file, found {len(files)}")
    lines = text.where(F.trim("value") != "").select(
        F.monotonically_increasing_id().alias("_id"), F.trim("value").cast("int").alias(name))
    ranked = prefix_sums(lines.withColumn("_one", F.lit(1)), "_id", ["_one"])
    return ranked.select(F.col("cum__one").alias("position"), name)


# S7 ------------------------------------------------------------------------

def _cells(line: F.Column) -> F.Column:
    """Trimmed cells of one line; a quoted cell may hold commas and doubled quotes."""
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    quoted = F.transform(F.split(line, outside_quotes), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), '""', '"'))
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ","), lambda c: F.trim(c)))


def _file_splits(raw: DataFrame) -> DataFrame:
    """(file, _split, _from, _before, _header), one row per split of a file: its
    first row id, the lines of the file's earlier splits, the file's first line.

    A row id holds its split and its place there.
    """
    sizes = raw.groupBy("file", "_split").agg(
        F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_rows"), F.min_by("value", "_id").alias("_first"))
    order = Window.partitionBy("file").orderBy("_split")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sizes.select("file", "_split", "_from", before.alias("_before"), first.alias("_header"))


def _header_problems(header: F.Column, required: Sequence[str], allowed_extra: bool) -> F.Column:
    """File-level header rules on the trimmed, BOM-stripped header cells."""
    cells = _cells(F.regexp_replace(header, "^﻿", ""))
    lowered = F.transform(cells, lambda c: F.lower(c))
    forbidden = sorted(C.TARGET_COLUMNS | C.FAILURE_LABEL_COLUMNS)
    req = F.array(*[F.lit(c) for c in required])
    checks = [
        (F.exists(cells, lambda c: c == ""), "blank header"),
        (F.size(F.array_distinct(cells)) != F.size(cells), "duplicate header"),
        (F.exists(lowered, lambda c: c.isin(*forbidden)), "forbidden header"),
        (F.size(F.array_except(req, cells)) > 0, "missing header"),
    ]
    if not allowed_extra:
        checks.append((F.size(F.array_except(cells, req)) > 0, "unknown header"))
    return F.coalesce(*[F.when(cond, F.lit(msg)) for cond, msg in checks])


def read_trajectory_csv(spark: SparkSession, path: str, required: Sequence[str] = tuple(C.RAW_INPUT_COLUMNS),
                        allow_extra: bool = True, allow_booleans: bool = True, whole_files: bool = False
                        ) -> tuple[DataFrame, DataFrame]:
    """Bulk CSV trajectories -> (good rows, quarantine).

    A file is one trajectory.  Every file is checked on its own header (first
    line) and every row on width, blanks, numeric cells (``try_cast``), boolean
    words (rejected when ``allow_booleans`` is false), integer positive cycles,
    and the step from the row before: a repeated, falling or skipping cycle is
    rejected at the row that breaks the order.  Cells may be quoted.  Quarantine
    rows carry the file, the line (the header is line 0) and the first failing
    reason.  With ``whole_files`` a file with any rejected line gives no good
    rows: what is left of its trajectory would have a gap.
    """
    raw = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id"), "value").withColumn(
        "_split", F.shiftright("_id", 33))
    # the header is read once per file: its fault, its width and the places of the required columns
    names = _cells(F.regexp_replace("_header", "^﻿", ""))
    splits = _file_splits(raw).withColumn("_names", names).select(
        "file", "_split", "_from", "_before", F.size("_names").alias("_width"),
        _header_problems(F.col("_header"), required, allow_extra).alias("_hdr_problem"),
        *[F.array_position("_names", F.lit(c)).cast("int").alias(f"_at_{i}") for i, c in enumerate(required)])
    body = raw.join(splits, ["file", "_split"]).withColumn("line", F.col("_before") + F.col("_id") - F.col("_from")).where("line > 0")
    body = body.withColumn("_cells", _cells(F.col("value")))
    width_bad = F.size("_cells") != F.col("_width")
    blank_row = F.trim("value") == ""
    nums = {c: F.when(F.col(f"_at_{i}") > 0, F.try_element_at("_cells", F.col(f"_at_{i}"))) for i, c in enumerate(required)}
    body = body.select("file", "line", "_id", "value", "_hdr_problem", blank_row.alias("_blank"), width_bad.alias("_width_bad"),
                       *[v.alias(f"_text_{c}") for c, v in nums.items()])
    texts = [F.col(f"_text_{c}") for c in required]
    non_numeric = reduce(or_, [v.try_cast("double").isNull() | (v == "") for v in texts])
    booleans = reduce(or_, [F.lower(v).isin("true", "false") for v in texts])
    cyc = F.col("_text_cycle").try_cast("double")
    checks = [
        (F.col("_hdr_problem").isNotNull(), F.col("_hdr_problem")),
        (F.col("_blank"), F.lit("blank row")),
        (F.col("_width_bad"), F.lit("wrong number of fields")),
        (booleans if not allow_booleans else F.lit(False), F.lit("boolean value")),
        (non_numeric, F.lit("non-numeric value")),
        (cyc != F.floor(cyc), F.lit("non-integer cycle")),
        (cyc <= 0, F.lit("non-positive cycle")),
    ]
    own = F.coalesce(*[F.when(c, r) for c, r in checks])
    body = body.select("file", "line", "_id", "value", cyc.alias("_cycle"), own.alias("_own"),
                       *[v.try_cast("double").alias(f"_value_{c}") for c, v in zip(required, texts, strict=True)])
    body = trailing_columns(body, {"_before": lambda w: F.lag("_cycle", 1).over(w)}, unit="file", order="line", lookback=1)
    step = F.col("_cycle") - F.col("_before")
    reason = F.coalesce("_own", F.when(step == 0, "duplicate cycle").when(step < 0, "cycle not increasing").when(
        step > 1, "cycle not consecutive"))
    # good rows, quarantine and the verdict on whole files read the checked lines
    checked = reused(body.withColumn("reason", reason).drop("_cycle", "_own", "_before"))
    good = checked.where(F.col("reason").isNull()).select("file", "_id", *[F.col(f"_value_{c}").alias(c) for c in required])
    bad = checked.where(F.col("reason").isNotNull()).select("file", "line", "reason", "value")
    if whole_files:
        good = good.join(bad.select("file").distinct(), "file", "left_anti")
    return good.withColumn("cycle", F.col("cycle").cast("long")), bad


# S8 ------------------------------------------------------------------------

OBSERVATION_FIELDS = ["cycle"] + C.OPERATIONAL_SETTINGS[:3] + C.RETAINED_SENSORS


def request_schema(fields: Sequence[str] = tuple(OBSERVATION_FIELDS)) -> T.StructType:
    obs = T.StructType([T.StructField(f, T.LongType() if f == "cycle" else T.DoubleType()) for f in fields])
    return T.StructType([T.StructField("unit_id", T.StringType()),
                         T.StructField("observations", T.ArrayType(obs))])


def parse_requests(df: DataFrame, json_col: str = "body", key: str = "request_id",
                   fields: Sequence[str] = tuple(OBSERVATION_FIELDS)) -> tuple[DataFrame, DataFrame]:
    """JSON requests ``{unit_id, observations: [...]}`` -> one row per
    observation with ``arrival`` = array position; unparsable or empty
    requests go to quarantine."""
    parsed = df.withColumn("_r", F.from_json(F.col(json_col), request_schema(fields)))
    # malformed text parses to a struct of nulls (or null): no observations array
    malformed = F.col("_r").isNull() | F.col("_r.observations").isNull()
    empty = ~malformed & (F.size("_r.observations") == 0)
    reason = F.when(malformed, "malformed JSON").when(empty, "no observations")
    checked = parsed.withColumn("reason", reason)
    rows = checked.where(F.col("reason").isNull()).select(
        key, F.col("_r.unit_id").alias("unit_id"), F.posexplode("_r.observations").alias("arrival", "o")).select(
        key, "unit_id", "arrival", "o.*")
    bad = checked.where(F.col("reason").isNotNull()).select(key, "reason")
    return rows, bad


PROPS_SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def parse_props(df: DataFrame, col: str = "props") -> DataFrame:
    """S8 for the event stream: ``props`` JSON with a fixed schema; rows whose
    text does not parse or lacks ``k`` are marked for quarantine."""
    p = F.from_json(F.col(col), PROPS_SCHEMA)
    return df.withColumn("_p", p).withColumn("k", F.col("_p.k")).withColumn(
        "quarantine", F.col("_p").isNull() | F.col("_p.k").isNull()).drop("_p")
