"""Sources and sinks (O-A1..O-A3, O-A5..O-A8, O-B8, O-H6).

Readers return ``targets``-shaped DataFrames: (input_pos, raw [, other
columns]); ``input_pos`` is (file, block, row, item), which sorts by file name
and place in the file, so exports can restore input order with one sort. It
comes from the scan itself: Spark's partitions follow file sizes, not names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webreach.functions import extract as X
from webreach.functions import patterns as P
from webreach.functions import urls as U
from webreach.sources.csvsplit import file_lines, read_csv

# line breaks that str.splitlines() honours besides \n, \r\n and \r
_EXTRA_LINE_BREAKS = r"[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _position(item) -> Column:
    """Place of an item: its file, the block and row of its line or document, then its own in there."""
    return U.nstruct(file=F.col("file"), block=F.col("block"), row=F.col("row"), item=F.col(item))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """O-A1: one URL per line; undecodable bytes dropped; each line
    normalized and kept only if valid; duplicates kept. A missing path
    gives an empty list."""
    try:
        raw = file_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "input_pos struct<file:string,block:bigint,row:bigint,item:int>, raw string, url string")
    lines = raw.withColumn("value", F.regexp_replace("value", "�", ""))
    parts = lines.select("file", "block", "row", F.posexplode(F.split("value", _EXTRA_LINE_BREAKS)).alias("sub", "raw"))
    out = parts.select(_position("sub").alias("input_pos"), "raw",
                       U.normalize_url("raw").alias("url"))
    return out.filter((F.col("url") != "") & U.is_valid_url("url"))


def detect_url_column(columns: list[str]) -> str:
    """O-B8: first header whose stripped lower-case name is a known URL
    column name, else the first column. Plan-time (schema only)."""
    for c in columns:
        if (c or "").strip().lower() in P.URL_COLUMN_NAMES:
            return c
    return columns[0]


def read_url_csv(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """O-A2: header CSV, every column a string; returns (rows with
    input_pos, url column name). Short rows are padded with nulls; fields may
    hold line breaks, and a large file is read in blocks all the same."""
    df = read_csv(spark, path)
    return df, detect_url_column(df.columns[:-1])


def read_url_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """O-A3: request bodies {"urls": [..]} or {"urls": "a\\nb"}, one per line
    (JSON lines) or one per file (``whole_file``); normalized, valid, first
    occurrence kept (O-G4)."""
    docs = file_lines(spark, path, wholetext=whole_file).withColumn("v", F.try_parse_json("value"))
    docs = docs.filter(F.col("v").isNotNull())
    arr = F.try_variant_get("v", "$.urls", "array<string>")
    text = F.try_variant_get("v", "$.urls", "string")
    lines = F.when(arr.isNotNull(), arr).otherwise(
        F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]|" + _EXTRA_LINE_BREAKS),
                             U.py_strip), lambda s: s != ""))
    items = docs.select("file", "block", "row", F.posexplode(lines).alias("i", "raw"))
    out = items.select(_position("i").alias("input_pos"), "raw",
                       U.normalize_url("raw").alias("url"))
    out = out.filter((F.col("url") != "") & U.is_valid_url("url"))
    return out.groupBy("url").agg(F.min_by("raw", "input_pos").alias("raw"), F.min("input_pos").alias("input_pos"))


def numbered(df: DataFrame, name: str = "line_no") -> DataFrame:
    """``df``, as read from files, with consecutive row numbers in the order of
    file names and places: each block counts its own rows, and only those counts
    are added up. Rows of a block follow each other in one partition."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_id"))
    counts = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = counts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_id") - F.col("_first")).drop("_file", "_block", "_id", "_first", "_start")


def write_json(contacts: DataFrame, path: str, order_col: str | None = "input_pos") -> None:
    """O-A5: contact records as JSON lines in input order; arrays stay arrays, UTF-8 as is."""
    df = contacts.orderBy(order_col).drop(order_col) if order_col else contacts
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_table(contacts: DataFrame) -> DataFrame:
    """O-A6 / O-J3: Website, Email, Phone, AI Summary with lists joined by
    ', ' and an empty list written as the literal 'None'."""
    return contacts.select(
        F.col("website").alias("Website"),
        X.join_list("emails", P.EMPTY_EXPORT).alias("Email"),
        X.join_list("phones", P.EMPTY_EXPORT).alias("Phone"),
        F.coalesce(F.col("summary"), F.lit("")).alias("AI Summary"),
        *([F.col("input_pos")] if "input_pos" in contacts.columns else []))


def write_csv(df: DataFrame, path: str, order_col: str | None = "input_pos", quote_all: bool = False) -> None:
    """O-A7 / O-A8 / O-H6: header CSV in input order; ``quote_all`` quotes
    every field and doubles embedded quotes; null -> empty."""
    out = df.orderBy(order_col).drop(order_col) if order_col and order_col in df.columns else df
    w = (out.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if quote_all:
        w = w.option("quoteAll", True)
    w.csv(path)


def display_rows(flat: DataFrame) -> DataFrame:
    """O-B7 / O-J4: UI rendering of flat results (website shown without
    scheme and trailing '/', empty cells as an em dash)."""
    return flat.select(U.display_url("website").alias("website"),
                       X.empty_cell("email").alias("email"), X.empty_cell("phone").alias("phone"),
                       X.empty_cell("summary").alias("summary"))
