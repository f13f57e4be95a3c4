"""Secret scans with an incremental blob ledger (native).

Every version of every path is addressed by the SHA-256 of its text. The
ledger remembers which rule versions have seen which blob; a scan reads only
the unseen pairs, appends what it finds, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webreach.llm.common import scratch, table, written
from webreach.llm.registry import register


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str          # Java's syntax; matches are leftmost and don't overlap
    version: int = 1
    group: int = 0        # this group of a match ...
    least: int = 0        # ... has so many characters, else the match is dropped

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in their order. A run of fewer than 24 (20) characters cannot hold a
#: longer match, so the length stands in the pattern itself.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=1, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Shapes of public token formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
SEEN = "blob string, rules array<string>"
FOUND = "blob string, kind string, at int, start long, end long, rule string"  # one folder a rule
MATCH = "rule:string,kind:string,at:int,n:int,gap:int,size:int,holds:boolean"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<rule, kind, at, n, gap, size, holds>>: every match of the rule's
    pattern with the characters between it and the match before, in code points.
    Where it stands is a running sum over ``n``, left to a window: an array that
    grows hit by hit would be copied at each."""
    none = F.array().cast(f"array<struct<{MATCH}>>")
    hit = lambda x, n: F.struct(
        F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(order).alias("at"), n.alias("n"), F.length(x["gap"]).alias("gap"),
        F.length(x["hit"]).alias("size"),
        (F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)).alias("holds"))
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    found = F.filter(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(rule.pattern), F.transform(found, hit)).otherwise(none)


def spans(run: DataFrame) -> DataFrame:
    """(blob, hits) -> (blob, kind, at, start, end, rule) of the matches that hold."""
    so_far = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = run.select("blob", F.inline("hits")).withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(so_far))
    return placed.filter("holds").select("blob", "kind", "at", (F.col("end") - F.col("size")).alias("start"), "end", "rule")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(history: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """history(path columns, blob, text) -> findings(blob, found) for every blob
    of it that holds a secret: ``found`` is an array of (start, at, kind, end),
    sorted. Reads and extends the ledger, a folder that all executors share, in
    which findings have a folder a rule: those of other rules aren't read.

    Null text counts as empty. A rule whose version has changed scans all
    blobs anew, the other rules only blobs that they have not seen. Findings
    are written before the pairs count as seen, so a run that was cut short is
    made good by the next; repeated findings are read once.
    """
    spark = history.sparkSession
    keys = [r.key for r in rules]
    todo = F.array_except(F.array(*map(F.lit, keys)), F.coalesce("known", F.array().cast("array<string>")))
    blobs = history.select("blob", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    given = blobs.join(_seen(spark, ledger), "blob", "left").select("blob", "text", todo.alias("todo"))
    hits = F.flatten(F.array(*[F.when(F.array_contains("todo", r.key), matches(F.col("text"), r, i)).otherwise(
        F.array().cast(f"array<struct<{MATCH}>>")) for i, r in enumerate(rules)]))
    run = written(given.select("blob", "todo", hits.alias("hits")), "scan")
    spans(run).write.mode("append").partitionBy("rule").parquet(f"{ledger}/found")
    run.filter(F.size("todo") > 0).select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/seen")
    found = _read(spark, f"{ledger}/found", FOUND).filter(F.col("rule").isin(keys)).join(run.select("blob"), "blob", "left_semi")
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    return found.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", order[F.col("rule")].alias("at"), "kind", "end"))).alias("found"))


def _seen(spark: SparkSession, ledger: str) -> DataFrame:
    rows = _read(spark, f"{ledger}/seen", SEEN)
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))


def compact(spark: SparkSession, ledger: str, into: str) -> None:
    """The ledger's small files as a new ledger in the empty folder ``into``: a row
    a blob in ``seen``, each finding once. The old one is left as it is."""
    _read(spark, f"{ledger}/found", FOUND).distinct().write.partitionBy("rule").parquet(f"{into}/found")
    _seen(spark, ledger).select("blob", F.col("known").alias("rules")).write.parquet(f"{into}/seen")


def address(documents: DataFrame) -> DataFrame:
    """documents -> (doc_id, blob, text): a document is the one version of its path."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.sha2(text, 256).alias("blob"), text.alias("text"))


def line(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_path(documents: DataFrame, ledger: str) -> DataFrame:
    """documents(doc_id, text) -> one row per row: counts of the base kinds, a
    digest of the base spans and all spans. Repeated rows give repeated rows."""
    history = address(documents)
    found = written(scan(history, ledger), "found")
    rows = history.select("doc_id", "blob").join(found, "blob", "left")
    all_ = F.coalesce("found", F.array().cast("array<struct<start:bigint,at:int,kind:string,end:bigint>>"))
    base = F.filter(all_, lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter(all_, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(line(base), 256).alias("base_sha256"), line(all_).alias("spans"))


def _oracle() -> str:
    """The same for DuckDB. Its patterns have no look-behind, and need none: a
    greedy match of 24 and more begins where the run does."""
    parts = []
    for i, r in enumerate(BASE + MORE):
        pattern = "'" + r.pattern.replace("(?<![0-9a-f])", "").replace("'", "''") + "'"
        hits, gaps = f"regexp_extract_all(text, {pattern}, 0)", f"string_split_regex(text, {pattern})"
        start = "list_sum(list_transform(x.g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(x.h[1:i - 1], lambda v: length(v))), 0)"
        spans_ = f"list_transform(range(1, len(x.h) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'at': {i}, 'kind': '{r.kind}', 'e': CAST({start} + length(x.h[i]) AS BIGINT), 'hit': x.h[i]}})"
        if r.least:
            spans_ = f"list_filter({spans_}, lambda v: length(regexp_extract(v.hit, {pattern}, {r.group})) >= {r.least})"
        parts.append(f"(list_transform([{{'h': {hits}, 'g': {gaps}}}], lambda x: {spans_}))[1]")
    both = parts[0]
    for part in parts[1:]:
        both = f"list_concat({both}, {part})"
    shown = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda v: v.kind || ':' || v.s || ':' || v.e), ','), '')"
    base = f"list_filter(found, lambda v: v.at < {len(BASE)})"
    counts = ", ".join(f"len(list_filter(found, lambda v: v.at = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))
    return (f"SELECT doc_id, {counts}, sha256({shown(base)}) AS base_sha256, {shown('found')} AS spans FROM ("
            f"SELECT doc_id, list_sort({both}) AS found FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")


@register("op9_secret_scan", _oracle())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base digest and spans of the secrets of every document. A new ledger
    each time, as the query's tables are all the history there is."""
    return by_path(table(spark, sf_dir, "documents"), scratch(spark, "ledger"))
