"""Inputs that every text operator must survive, as (doc_id, text, extra columns)."""

import random
import re

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, start string, line int, key long, row long, features string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "an", "er", "on", "ré", "he", "ßü", "ed")) for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], COLUMNS)


def edge_rows():
    long = "\n".join(words(i, 40) for i in range(400))
    return [(1, None), (2, ""), (3, " \n\t\n "), (4, "a"), (5, long), (6, long), (None, words(3, 30)), (7, words(4, 30)), (7, words(4, 30)),
            (8, "é\x00ü \U0001f600 #\n" * 30), (9, "x" * 60_000), (10, "\n".join(["same line of words here"] * 50)), (11, "ab " * 5000)]


def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
