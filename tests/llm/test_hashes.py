"""Texts that collide under a polynomial modulo 2 ** 64 stay apart."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
import public_tokenizers

from tests.llm.cases import frame
from webreach.llm import common, crf, forest, packing, quality

THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def hashes(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in texts])
    return common.span_hashes(common.prefix_hashes(raw), np.append(0, end[:-1]), end).tolist()


def test_equal_strings_only():
    texts = [THUE, OTHER, "x", THUE, "", "\x00", "\x00\x00", OTHER[:64], THUE[:64], "y" * 100_000, "y" * 99_999, "x", "y" * 100_000]
    h = hashes(texts)
    assert [[a == b for a in texts] for b in texts] == [[a == b for a in h] for b in h]


def test_products_modulo_the_prime():
    r = np.random.default_rng(1)
    p = (1 << 61) - 1
    a, b = (np.append(r.integers(0, p, 2000, dtype=np.uint64), [0, 1, p - 1, p - 2]).astype(np.uint64) for _ in range(2))
    assert common.times(a, b).tolist() == [x * y % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_quality_counts_them_as_different(spark):
    rows = [(1, f"{THUE}\n{OTHER}\n{THUE}"), (2, " ".join([THUE, OTHER] + list("abcd") + [OTHER, THUE] + list("abcd")))]
    got = {r.doc_id: r for r in quality.score(frame(spark, rows), crf.zero(quality.N_FEATURES, 2)).collect()}
    assert got[1].n_dup_lines == 1 and got[2].n_repeat_words == 0


def test_packing_gives_each_its_own_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    run = packing._tokenize(path, 1 << 20, True)
    texts = [THUE + " " + OTHER, OTHER + " " + THUE, THUE, OTHER]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(range(4)), pa.array(texts)], ["doc_id", "row_no", "text"])
    got = [np.frombuffer(b, np.uint16).tolist()[:-1] for out in run([batch]) for b in out.column(5).to_pylist()]
    tok = Tokenizer.from_file(str(path))
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_join_keeps_both(spark):
    words = " ".join(f"w{i}" for i in range(6))
    rows = [(1, f"{words} {THUE}"), (2, f"{words} {OTHER}"), (3, f"{THUE} {OTHER} {THUE} {THUE} {OTHER}"), (4, f"{OTHER} {THUE} {OTHER} {OTHER} {THUE}")]
    kept = forest.stage(spark, frame(spark, rows), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4]
