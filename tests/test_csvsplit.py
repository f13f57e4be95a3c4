"""CSV records of split files against Spark's multiLine reader and Python's csv; positions by file name."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from webreach.sources import csvsplit, io as IO

BYTES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in BYTES}
    for k, v in zip(BYTES, ("700", "0", "1"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cells(rng):
    kinds = ["plain", "", 'say ""hi""', "two\nlines", "a, b", '"', "\n\n", 'x""', "é ü", " pad ", "'", 'line\r\nend', ',",', "long " * 40]
    return [rng.choice(kinds) for _ in range(3)]


def write(path, rows, newline="\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline, quoting=quoting)
        w.writerow(["name", "website", "notes"])
        w.writerows(rows)


def read(path):
    with open(path, newline="") as f:
        return [[x or None for x in r] for r in csv.reader(f)][1:]


@pytest.mark.parametrize("newline,quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_MINIMAL), ("\n", csv.QUOTE_ALL)])
def test_records_over_blocks(spark, tmp_path, small_splits, newline, quoting):
    rng = random.Random(len(newline) + quoting)
    rows = [[str(i), *cells(rng)[:2]] for i in range(300)]
    path = str(tmp_path / "in.csv")
    write(path, rows, newline, quoting)
    df = csvsplit.read_csv(spark, path)
    assert csvsplit.file_lines(spark, path).rdd.getNumPartitions() > 5
    got = [list(r) for r in df.orderBy("input_pos").drop("input_pos").collect()]
    assert got == read(path)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    one_break = lambda r: [x and x.replace("\r\n", "\n") for x in r]  # noqa: E731  (Spark's reader makes all breaks alike in such a file)
    assert sorted(map(str, map(one_break, got))) == sorted(str(one_break(r)) for r in whole.collect())


def test_record_over_many_blocks_and_an_open_quote(spark, tmp_path, small_splits):
    path = tmp_path / "in.csv"
    path.write_text('name,website\n"' + "x\n" * 2000 + '",a.com\nb,"b\n.com"\nc,"never closed\n' + "d,e\n" * 3, newline="")
    got = [list(r) for r in csvsplit.read_csv(spark, str(path)).orderBy("input_pos").drop("input_pos").collect()]
    assert got[0] == ["x\n" * 2000, "a.com"] and got[1] == ["b", "b\n.com"] and len(got) == 3


def test_quotes_inside_a_plain_field_are_text(spark, tmp_path, small_splits):
    path = tmp_path / "in.csv"
    path.write_text("name,website\n" + "".join(f'5" disk {i},a{i}.com\n' for i in range(100)), newline="")
    got = csvsplit.records(spark, str(path)).filter("not first").count()
    assert got == 100


def test_folder_header_short_rows_blank_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.csv").write_text(f'name,"web\nsite"\n{k}a,x\n\n{k}b\n{k}c,y,surplus\n', newline="")
    df = csvsplit.read_csv(spark, str(tmp_path / "in"))
    assert df.columns == ["name", "web\nsite", "input_pos"]
    assert [tuple(r)[:2] for r in df.orderBy("input_pos").collect()] == [(f"{k}{c}", v) for k in range(3) for c, v in (("a", "x"), ("b", None), ("c", "y"))]


def unequal(spark, path, n=4000):
    """Four files in name order whose sizes are in another order."""
    edge = F.when(F.col("id") < n // 20, 0).when(F.col("id") < n // 2, 1).when(F.col("id") < n // 2 + n // 10, 2).otherwise(3)
    ids = spark.range(n).select("id", edge.alias("f"))
    parts = [ids.filter(F.col("f") == k).coalesce(1).orderBy("id") for k in range(4)]
    for k, p in enumerate(parts):
        p.select(F.concat(F.lit("https://s"), "id", F.lit(".test")).alias("website")).write.option("header", True).csv(f"{path}/f{k}")
    return f"{path}/f*"


def test_positions_follow_file_names(spark, tmp_path):
    path = unequal(spark, str(tmp_path))
    want = [f"https://s{i}.test" for i in range(4000)]
    df = spark.read.option("header", True).csv(path)
    assert [r.website for r in IO.numbered(df).orderBy("line_no").collect()] == want
    assert sorted(r.line_no for r in IO.numbered(df).select("line_no").collect()) == list(range(4000))
    assert [r.website for r in IO.read_url_csv(spark, path)[0].orderBy("input_pos").collect()] == want
    assert [r.url for r in IO.read_url_list(spark, path).orderBy("input_pos").collect() if r.url != "https://website"] == want


def test_first_seen_over_files_of_unequal_size(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"urls": ["one.test", "two.test"]}\n')
    (tmp_path / "b.json").write_text('{"urls": ["three.test", "ONE.test", "one.test"' + ', "x.test"' * 5000 + "]}\n")
    got = IO.read_url_json(spark, str(tmp_path)).orderBy("input_pos").collect()
    assert [r.raw for r in got] == ["one.test", "two.test", "three.test", "ONE.test", "x.test"]
