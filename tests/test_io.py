"""Readers and sinks: URL list, CSV with URL-column detection, JSON request,
JSON and CSV sinks, UI cells."""

import csv
import glob
import json
import os
import tempfile

from pyspark.sql import functions as F

from webreach.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="webreach-io-", dir="/tmp")


def test_url_list_source(spark):
    d = _tmp()
    p = os.path.join(d, "urls.txt")
    with open(p, "wb") as f:
        f.write(b" example.com \nftp://x.com\n\nhttps://a.com\nhttps://a.com\nhttps://b\xff.com\n")
    rows = IO.read_url_list(spark, p).orderBy("input_pos").collect()
    assert [r.url for r in rows] == ["https://example.com", "https://a.com", "https://a.com", "https://b.com"]


def test_url_list_missing_file(spark):
    assert IO.read_url_list(spark, "/tmp/does-not-exist-webreach.txt").count() == 0


def test_detect_url_column():
    assert IO.detect_url_column(["name", " Website ", "url"]) == " Website "
    assert IO.detect_url_column(["a", "b"]) == "a"


def test_csv_source(spark):
    d = _tmp()
    p = os.path.join(d, "in.csv")
    with open(p, "w", newline="") as f:
        f.write('name,website,notes\nA,https://a.com,"x, y"\nB\nC,c.com,z\n')
    df, col = IO.read_url_csv(spark, p)
    assert col == "website"
    assert df.count() == 3
    assert df.filter(F.col("website").isNull()).count() == 1


def test_json_source(spark):
    d = _tmp()
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"urls": ["a.com", "https://a.com", "bad url", "b.com"]}, f)
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump({"urls": "c.com\n\n  d.com  \n"}, f)
    urls = {r.url for r in IO.read_url_json(spark, d).collect()}
    assert urls == {"https://a.com", "https://b.com", "https://c.com", "https://d.com", "https://bad url"}


def _contacts(spark):
    return spark.createDataFrame(
        [(2, "https://b.com/", ["x@b.com"], [], "Sum"), (1, "https://a.com/", [], ["011 2574475"], "")],
        "input_pos long, website string, emails array<string>, phones array<string>, summary string")


def test_json_sink_keeps_arrays(spark):
    d = os.path.join(_tmp(), "out")
    IO.write_json(_contacts(spark), d)
    lines = [json.loads(l) for p in sorted(glob.glob(os.path.join(d, "part-*"))) for l in open(p)]
    assert lines[0]["website"] == "https://a.com/" and lines[0]["phones"] == ["011 2574475"]
    assert lines[1]["emails"] == ["x@b.com"]


def test_export_table_and_quoted_csv(spark):
    ex = IO.export_table(_contacts(spark))
    rows = {r.Website: r for r in ex.collect()}
    assert rows["https://a.com/"].Email == "None" and rows["https://a.com/"].Phone == "011 2574475"
    d = os.path.join(_tmp(), "csv")
    IO.write_csv(ex, d, quote_all=True)
    text = "".join(open(p).read() for p in sorted(glob.glob(os.path.join(d, "part-*"))))
    recs = list(csv.reader(text.splitlines()))
    assert recs[0] == ["Website", "Email", "Phone", "AI Summary"]
    assert recs[1][0] == "https://a.com/" and recs[2][0] == "https://b.com/"
    assert text.splitlines()[1].startswith('"https://a.com/"')


def test_display_rows(spark):
    flat = spark.createDataFrame([("https://www.a.com/", "", None, "s")], "website string, email string, phone string, summary string")
    r = IO.display_rows(flat).first()
    assert (r.website, r.email, r.phone, r.summary) == ("www.a.com", "—", "—", "s")


def test_fetchable_status_and_redirects(spark):
    from webreach.operators.pages import page_facts
    df = spark.createDataFrame(
        [(1, "https://a.com", "https://www.a.com/home", "<p>x</p>", 200), (2, "https://b.com", None, "", 404),
         (3, "https://c.com", None, "", None)],
        "page_id long, url string, final_url string, html string, status int")
    rows = {r.page_id: (r.page_key, r.canonical_url) for r in page_facts(df).collect()}
    assert rows == {1: ("https://a.com", "https://www.a.com/home"), 3: ("https://c.com", "https://c.com")}


def test_source_partitions_are_a_setting(spark):
    from webreach.sources.tables import PARTITIONS, table
    sf = "/root/testdata/sf0.001"
    plain = table(spark, sf, "customer")
    assert "Repartition" not in plain._jdf.queryExecution().logical().toString()
    spark.conf.set(PARTITIONS, "3")
    try:
        assert table(spark, sf, "customer").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(PARTITIONS)


def test_requests_over_many_partitions(spark, tmp_path):
    import json
    spark.createDataFrame([(json.dumps({"urls": [f"s{i}.test", "https://same.test"]}),) for i in range(1100)], "value string") \
        .repartition(1100).write.text(str(tmp_path / "in"))
    got = IO.read_url_json(spark, str(tmp_path / "in"))
    assert got.count() == 1101 and got.select("input_pos").distinct().count() == 1101


def test_missing_list_is_empty_and_other_errors_show(spark, tmp_path):
    import pytest
    assert IO.read_url_list(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        IO.read_url_list(spark, "nosuchscheme://x/y").count()


def test_numbered_follows_file_order(spark, tmp_path):
    spark.range(1000).repartition(9).sortWithinPartitions("id").write.parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))
    assert sorted(r.line_no for r in IO.numbered(df).collect()) == list(range(1000))
