"""The toxicity network: its scoring in blocks against its training form, its inputs against plain Python, its memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import toxicity
from corpuscope.llm.common import ALNUM, Words
from corpuscope.llm.toxicity import CHAR_BUCKETS, LONG_BUCKETS, WINDOW, Network, _columns, score_toxicity, train, windows, word_inputs


def texts(n: int, words: int, seed: int = 3) -> pa.Array:
    r = np.random.default_rng(seed)
    return pa.array([" ".join(f"w{x:x}" for x in r.integers(0, 1 << 40, words)) for _ in range(n)])


@pytest.mark.parametrize("step", [1, 7, 1024])
def test_blocks_of_windows_score_as_the_training_form(step):
    column = pa.array(["", None, "one", "Two words", *(" ".join(f"t{i}k{j}" for j in range(i)) for i in range(3, 80)), "same same " * 40, "ünï çøde 漢字 " * 9, "x" * 300])
    w, net = Words(column, ALNUM), Network(1)
    for name in ("words", "chars", "out"):
        net.p[name] *= 10
    bucket, chars, counts, inverse = word_inputs(w)
    start, length, doc = windows(w.offsets)
    x = net.embed(bucket, chars, counts)
    at = inverse[np.minimum(start[:, None] + np.arange(WINDOW), len(inverse) - 1)]
    expected = net.forward(x, at, length)
    assert len(set(length.tolist())) == WINDOW and np.ptp(expected) > 0.1
    assert net.logits(x[:0], inverse[:0], start[:0], length[:0]).shape == (0,)
    assert np.abs(net.logits(x, inverse, start, length, step) - expected).max() < 1e-5
    logits = net.document_logits(column)
    assert np.abs(logits[2:] - np.array([expected[doc == d].max() for d in range(2, len(column))])).max() < 1e-5
    assert (logits[:2] == net.p["bias"][0] - 20).all()


def test_word_inputs_are_those_of_plain_python():
    column = pa.array(["a bc bc defgh", None, "", "ZZ zz é漢字" + "q" * 50, "a"])
    w = Words(column, ALNUM)
    for step in (1, 2, 4096):
        bucket, chars, counts, inverse = word_inputs(w, step)
        at = np.cumsum(counts) - counts
        for word, k in zip([w.raw[a:b].tobytes() for a, b in zip(w.starts, w.ends)], inverse):
            expected, padded = [], b" " + word + b"   "
            for i in range(len(word)):
                n = list(padded[i : i + 5])
                three = (n[0] * 961 + n[1] * 31 + n[2]) * 40503 % 1048573 % CHAR_BUCKETS
                five = 0
                for b in n:
                    five = (five * 257 + b) % 2147483647
                expected += [three, CHAR_BUCKETS + five * 40503 % 1048573 % LONG_BUCKETS]
            assert chars[at[k] : at[k] + counts[k]].tolist() == expected
        assert len(bucket) == len(set(bucket.tolist())) == 5


def peak(f) -> int:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_scoring_holds_few_windows_at_once():
    column = pa.array(["some words that stand again and again in a text " * 20_000])
    assert peak(lambda: Network().document_logits(column)) < 40 * column.nbytes


def test_training_holds_little_beside_the_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    column = texts(1000, 200)
    assert peak(lambda: train(column, np.arange(1000) % 2)) < 30 * column.nbytes + (16 << 20)


def test_texts_reach_the_driver_without_python_strings(spark, monkeypatch):
    def refuse(self, *_):
        raise AssertionError("the driver makes a Python string of each text")

    docs = spark.createDataFrame([(i, None if i == 3 else "vile words" if i % 2 else "kind words") for i in range(40)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(type(docs), "toPandas", refuse)
    scored = score_toxicity(docs, labels, F.lit(True))
    assert scored.count() == 40 and scored.where("score is null").count() == 0
    texts, y = _columns(docs.select(F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") % 2).alias("y")))
    assert isinstance(texts, pa.StringArray) and all((t == "vile words") == (k == 1) or t == "" for t, k in zip(texts.to_pylist(), y)) and len(y) == 40
    assert score_toxicity(docs, labels.limit(0), F.lit(True)).where("score = 0.5").count() == 40
