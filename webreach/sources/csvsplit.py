"""Quoted CSV in splits (O-A2): one file is read by as many tasks as it has blocks.

A line says, for each of the two states it can begin in (a new record, or
inside quotes), the state that it ends in: it keeps the state, turns it over,
or fixes it. Such steps compose, so the state before a line is that of the last
fixing line, turned over by the turning ones since. That runs as a window over
the lines of a block, then, one row a block, over the blocks of a file; only
lines of records with line breaks are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webreach.functions.urls import nstruct
from webreach.session import materialize

_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,"][^,]*+|)'
_REST = r"(?:," + _FIELD + r")*+\z"
#: A line that ends with its record, begun with a new one or inside quotes.
ENDS_NEW = r"\A" + _FIELD + _REST
ENDS_QUOTED = r'\A(?:[^"]++|"")*+"[^,]*+' + _REST


def file_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, block, row, value): the lines of all files; (file, block, row) sorts them by file name and place."""
    raw = spark.read.options(**options).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("row"), "value")


def _before(order, fixed: Column, turns: Column, start: int) -> Column:
    """State before a row, if the first one begins in ``start``: ``fixed`` is the
    state that a row ends in whatever came before (else null), ``turns`` whether it turns the state over."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    n_turns = F.sum(turns.cast("int")).over(upto)
    last = F.last(F.when(fixed.isNotNull(), nstruct(state=fixed, n=F.col("_turns"))), ignorenulls=True).over(past)
    so_far = F.coalesce(F.lag("_turns").over(order), F.lit(0))
    since = so_far - F.coalesce(last["n"], F.lit(0))
    return n_turns, (F.coalesce(last["state"], F.lit(start)) + since) % 2


def _states(df: DataFrame, order, end_new: Column, end_quoted: Column) -> DataFrame:
    """``df`` with the state before each row, for both states the first may begin in (s0, s1)."""
    fixed = F.when(end_new == end_quoted, end_new)
    turns = (end_new == 1) & (end_quoted == 0)
    n_turns, s0 = _before(order, fixed, turns, 0)
    _, s1 = _before(order, fixed, turns, 1)
    return df.withColumn("_turns", n_turns).withColumns({"s0": s0, "s1": s1}).drop("_turns")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, record, first): the records of all CSV files, at the
    place of their first line; ``first`` marks the first of a file. A quote that
    is never closed takes the rest of its file into one record."""
    lines = file_lines(spark, path, lineSep="\n")
    plain = F.instr("value", '"') == 0
    end = lambda pattern: F.when(F.col("value").rlike(pattern), 0).otherwise(1)
    lines = lines.withColumns({"end_new": F.when(plain, 0).otherwise(end(ENDS_NEW)), "end_quoted": F.when(plain, 1).otherwise(end(ENDS_QUOTED))})
    in_block = Window.partitionBy("file", "block")
    order = in_block.orderBy("row")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = _states(lines, order, F.col("end_new"), F.col("end_quoted"))
    begun = lambda s: F.last(F.when(F.col(s) == 0, F.col("row")), ignorenulls=True).over(upto)
    marked = materialize(marked.withColumns({"begun0": begun("s0"), "begun1": begun("s1"), "first_row": F.min("row").over(in_block)}))

    # one row a block: the state it ends in and where its last record begins, for both states it may begin in
    after = lambda s: F.when(F.col(s) == 0, F.col("end_new")).otherwise(F.col("end_quoted"))
    blocks = marked.groupBy("file", "block").agg(
        F.max_by(after("s0"), "row").alias("e0"), F.max_by(after("s1"), "row").alias("e1"), F.max("begun0").alias("b0"), F.max("begun1").alias("b1"))
    by_file = Window.partitionBy("file").orderBy("block")
    blocks = _states(blocks, by_file, F.col("e0"), F.col("e1")).select(
        "file", "block", F.col("s0").alias("state"), F.when(F.col("s0") == 0, F.col("b0")).otherwise(F.col("b1")).alias("begun"))
    carried = F.last(F.when(F.col("begun").isNotNull(), nstruct(block=F.col("block"), row=F.col("begun"))), ignorenulls=True)
    blocks = blocks.select("file", "block", "state", carried.over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))

    pick = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    known = marked.join(blocks, ["file", "block"]).withColumns({"s": pick("s"), "begun": pick("begun")})
    known = known.withColumn("at", F.when(F.col("begun").isNotNull(), nstruct(block=F.col("block"), row=F.col("begun"))).otherwise(F.col("carried")))
    known = known.withColumn("whole", (F.col("s") == 0) & (F.col("end_new") == 0))
    alone = known.filter("whole").select("file", "block", "row", F.col("value").alias("record"), ((F.col("block") == 0) & (F.col("row") == F.col("first_row"))).alias("first"))
    head = F.max((F.col("s") == 0) & (F.col("block") == 0) & (F.col("row") == F.col("first_row")))
    broken = known.filter("not whole").groupBy("file", "at").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "\n").alias("record"), head.alias("first"))
    both = alone.unionByName(broken.select("file", "at.block", "at.row", "record", "first"))
    return both.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names: the first record of the file that is first by name, as Spark's reader names them."""
    files = sorted(spark.read.text(path).inputFiles())
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files[0]).columns if files else []


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings and ``input_pos``. Every file begins with a header;
    blank lines are skipped, short rows padded with nulls, surplus cells dropped,
    as by Spark's own reader in its multiLine mode. Lines end with \\n or \\r\\n."""
    names = header(spark, path)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(spark, path).filter(~F.col("first") & (F.col("record") != ""))
    parsed = F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true"})
    place = nstruct(file=F.col("file"), block=F.col("block"), row=F.col("row"), item=F.lit(0))
    return rows.select(parsed.alias("cells"), place.alias("input_pos")).select("cells.*", "input_pos")
