"""Streaming feeds equal their batch counterparts."""

import os
import tempfile


from webreach.streaming import feeds

SF = "/root/testdata/sf0.001"


def test_url_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="webreach-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "1.txt"), "w") as f:
        f.write("a.com\nhttps://a.com\nftp://x\n")
    with open(os.path.join(src, "2.txt"), "w") as f:
        f.write("b.com\na.com\n")
    out = {r.url for r in feeds.run_url_stream(spark, src, os.path.join(base, "run")).collect()}
    assert out == {"https://a.com", "https://b.com"}


def test_page_stream_equals_batch(spark):
    from webreach.plans.registry import QUERIES
    import webreach.plans  # noqa: F401
    streamed = QUERIES["stream_page_candidates"](spark, SF)
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet"))
    batch = feeds.candidates_of(pages)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_page_stream_of_a_table_of_several_files(spark, tmp_path):
    from webreach.plans.registry import QUERIES
    import webreach.plans  # noqa: F401
    pages = spark.createDataFrame([(i, f"https://a{i}.test/", f"<p>me{i}@a.test</p>") for i in range(6)], feeds.PAGES_SCHEMA)
    pages.repartition(3, "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "customer.parquet"))
    streamed = QUERIES["stream_page_candidates"](spark, str(tmp_path))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, feeds.candidates_of(pages).collect()))
    assert {r.value for r in streamed.collect()} >= {f"me{i}@a.test" for i in range(6)}


def test_pages_with_one_key_keep_their_own_candidates(spark, tmp_path):
    rows = [(i, "https://a.test/" + "#" * (i % 2), f"<p>me{i}@a.test</p>") for i in range(3)]
    df = spark.createDataFrame(rows, feeds.PAGES_SCHEMA)
    got = {(r.page_id, r.value) for r in feeds.candidates_of(df).filter("channel = 'text_email'").collect()}
    assert got == {(i, f"me{i}@a.test") for i in range(3)}
    for _ in range(2):  # a replayed epoch replaces itself
        feeds.write_epoch(df, 0, str(tmp_path / "out"))
    feeds.write_epoch(df.limit(0), 1, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("channel = 'text_email'").count() == 3


def test_urls_of_later_epochs_and_replays(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "run")
    src.mkdir()
    for n, text in enumerate(("a.com\nb.com\n", "b.com\nc.com\n\n", "a.com\n")):
        (src / f"{n}.txt").write_text(text)
        got = feeds.run_url_stream(spark, str(src), base)
    assert sorted((r.epoch, r.url) for r in got.collect()) == [(0, "https://a.com"), (0, "https://b.com"), (1, "https://c.com")]
    batch = spark.createDataFrame([("https://b.com",), ("https://c.com",), ("https://c.com",)], "url string")
    for _ in range(2):  # a replayed epoch replaces itself
        feeds.write_new_urls(spark, batch, 1, os.path.join(base, "out"))
    assert spark.read.parquet(os.path.join(base, "out")).count() == 3
    feeds.write_new_urls(spark, batch.limit(0), 0, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
