"""Session settings and intermediate tables."""

import os

from webreach import session


def test_given_settings_stay(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.files.maxPartitionBytes", "1234567")
    session.configure(other)
    assert other.conf.get("spark.sql.files.maxPartitionBytes") == "1234567"
    assert other.conf.get("spark.sql.variant.allowDuplicateKeys") == "true"
    assert other.sql("SELECT webreach_clean_url('http://a.test/?ref=1')").first()[0] == "http://a.test/"


def test_tables_can_be_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    df = session.materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file:")
    assert df.count() == 5 and os.path.exists(path)
    assert session.drop_tables(spark) == 1 and not os.path.exists(path)
