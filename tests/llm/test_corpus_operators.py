"""Language identification, the manifest and phrases against brute force, SQL and held-out labels, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from oracle import difference, expected
from pyspark.sql import functions as F
from test_operators import odd_docs

from corpuscope.llm import langid, manifest, phrases, queries
from corpuscope.llm.common import NOT_SPACE, Words, byte_hashes, table
from corpuscope.llm.decontaminate import decontaminate
from corpuscope.llm.neardup import near_duplicates
from corpuscope.llm.tokens import default_tokenizer, encoder


# ---------------------------------------------------------------- hashes of words
def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate({97: 98, 98: 97})
    return text, text.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_cancel_out(spark, n):
    """Sums of powers modulo 2^64 can't tell these words apart."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    assert len(set(Words(pa.array([f"{a} {b}"]), NOT_SPACE).hashes.tolist())) == 2
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted(r.component_id for r in near_duplicates(docs, words=2).collect()) == [1, 2]
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate(docs, items).collect()} == {1: 1, 2: 0}
    ids, counts = encoder(default_tokenizer()).encode(pa.array([f"x {a} y", f"x {b} y"]))
    t = Tokenizer.from_file(default_tokenizer())
    assert ids.tolist() == sum((t.encode(f"x {w} y", add_special_tokens=False).ids for w in (a, b)), [])


def test_byte_hashes_tell_all_short_spans(spark):
    raw = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint8)
    spans = [(i, j) for i in range(300) for j in range(i, min(i + 100, 400), 7)]
    starts, ends = np.array(spans).T
    hashes = byte_hashes(raw, starts, ends)
    by = {}
    for (i, j), h in zip(spans, hashes.tolist()):
        assert by.setdefault(h, raw[i:j].tobytes()) == raw[i:j].tobytes()
    assert len(by) == len({raw[i:j].tobytes() for i, j in spans})
    assert not (hashes == byte_hashes(raw, starts, ends, 1)).any()


def test_encoder_with_colliding_pieces(monkeypatch):
    """Hashes of one bit: pieces are still told apart, by the other hash."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from corpuscope.llm import tokens

    real = byte_hashes
    monkeypatch.setattr(tokens, "byte_hashes", lambda *x: real(*x) if len(x) > 3 else real(*x) & np.uint64(7))
    e, t = tokens.Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for texts in (["one"], ["two"], ["one two three", None, "four"], ["five one"]):
        ids, counts = e.encode(pa.array(texts, pa.string()))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


# ---------------------------------------------------------------- 11
def test_language_identification(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES["op11_language_identification"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table(spark, sf, "documents").count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    right = np.array([r.lang_pred == r.lang for r in held])
    assert right.mean() >= 0.97
    accepted = np.array([r.accepted for r in held])
    assert accepted.mean() > 0.5 and right[accepted].mean() >= 0.97


def test_language_rejection_is_calibrated():
    draw = np.random.default_rng(3)
    y = draw.integers(0, 3, 4000)
    logits = np.eye(3)[y] * 2 + draw.normal(0, 1, (4000, 3))
    t = langid.calibrated(logits * 5, y)
    p = langid.softmax(logits * 5 / t)
    assert 3 < t / langid.calibrated(logits, y) < 7
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == y).mean()) < 0.05  # as sure as it is right
    least = langid.accepted_from(p, y, 0.95)
    sure = p.max(axis=1) >= least
    assert (p.argmax(axis=1) == y)[sure].mean() >= 0.95 and 0 < sure.sum() < len(y)
    assert langid.accepted_from(p, (p.argmax(axis=1) + 1) % 3) > 1  # never right: nothing is accepted


def test_language_identification_odd(spark):
    docs = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") == 5, "bb")).withColumn("_letter", F.lit(1))
    got = langid.identify(docs, F.lit(True), reject=False).collect()
    assert len(got) == 16 and set(langid.identify(docs, F.lit(True)).columns) == {*docs.columns, "lang_pred", "accepted"}
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred in ("aa", "bb")) if letters else (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0
    digits = spark.createDataFrame([(1, "123 456", "aa"), (2, "...", "bb"), (3, "été 1", "fr"), (4, "x y", "en")], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(digits, F.lit(True), reject=False).collect()}
    assert found[1] == found[2] == "und" and found[3] in ("en", "fr")


def test_language_sample_is_bounded(spark):
    docs = table(spark, SF, "documents").where("lang IS NOT NULL")
    each = Counter(r.lang for r in langid.chosen_rows(docs, "doc_id", "text", "lang", 40).collect())
    assert 10 < sum(each.values()) < 80 and len(each) == docs.select("lang").distinct().count()


# ---------------------------------------------------------------- 12
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is None:
            out += "-"
            continue
        v = str(v)
        v = re.sub("[A-Z]", lambda m: m.group().lower(), v) if lower and c == "text" else v
        out += f"{len(v.encode())}:{v}"
    return H(out)


def brute_manifest(rows):
    """Each row's result, by walking up level by level."""
    groups = {}
    for r in rows:
        groups.setdefault((r["lang"] is not None, (r["lang"] or "").encode()), []).append(r)

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, at):
        out = []
        for low in levels[:-1]:
            run = range(at // 8 * 8, min(at // 8 * 8 + 8, len(low)))
            out.append(([low[i] for i in run if i < at], [low[i] for i in run if i > at]))
            at //= 8
        return out

    trees = {}
    for g, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = up([leaf(r) for r in own])
    order = sorted(groups)
    top = up([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            steps = way(trees[g], at) + way(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf(r, hit)
            for a, b in steps:
                node = H(*a, node, *b)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], H(*(x for a, b in steps for x in (*a, *b))), node, node == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


def manifest_of(docs):
    columns = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest.manifest(docs, manifest.leaf_hash(columns(F.col("text"))), F.col("lang"), changed=F.when(hit, manifest.leaf_hash(columns(manifest.tampered(F.col("text"))))))


@pytest.mark.parametrize("depth, top", [(4, 1 << 18), (1, 1 << 18), (2, 1 << 18), (1, 3)])
def test_manifest(spark, monkeypatch, depth, top):
    """The same tree whatever the size of blocks, one block for a language or many; few nodes for the top make blocks larger."""
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "TOP", top)
    docs = table(spark, SF, "documents")
    want = brute_manifest([r.asDict() for r in docs.collect()])
    assert result(manifest_of(docs)) == want and {True, False} == {r[-1] for r in want}


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_phrase_collocations"])
def test_sql(spark, name):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got) > 100 and difference(got, expected(queries.SQL[name], sf)) is None


@pytest.mark.parametrize("depth", [1, 4])
def test_manifest_odd(spark, monkeypatch, depth):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    docs = odd_docs(spark).withColumn("lang", F.expr("CASE WHEN doc_id < 3 THEN '' WHEN doc_id < 12 THEN NULL WHEN doc_id = 12 THEN 'É' ELSE 'Z' END"))
    docs = docs.withColumns({c: F.lit("clash") for c in ("_row", "_group", "leaf", "root", "group", "verified")})
    docs = docs.union(docs.where("doc_id = 4")).repartition(5)
    want = brute_manifest([r.asDict() for r in docs.collect()])
    assert len(want) == 17 and result(manifest_of(docs)) == want
    assert manifest_of(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 7")
    assert result(manifest_of(one)) == brute_manifest([r.asDict() for r in one.collect()])


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 72, 513])
def test_manifest_shapes(spark, monkeypatch, n):
    """Last runs of one node, whole levels, and rows of one id."""
    monkeypatch.setattr(manifest, "DEPTH", 1)
    docs = spark.range(n).selectExpr("id div 2 AS doc_id", "concat('Text ', id) AS text", "IF(id % 13 = 0, 'b', 'a') AS lang", "'s' AS source", "id AS n_chars")
    assert result(manifest_of(docs)) == brute_manifest([r.asDict() for r in docs.collect()])


# ---------------------------------------------------------------- 13
def brute_phrases(rows, least, listed=2000, within=80):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = {}
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= least:
            found[lang, w] = min(((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))))
    out = []
    for (lang, w), (score, k) in found.items():
        a = counts[lang, w]
        longer = [counts[x] for x in found if x[0] == lang and len(x[1]) > len(w) and any(x[1][i : i + len(w)] == w for i in range(len(x[1]) - len(w) + 1))]
        if not any(100 * f >= within * a for f in longer):
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:listed]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def phrase_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least, buckets", [(30, 1 << 16), (5, 1 << 16), (5, 64)])
def test_phrases(spark, monkeypatch, least, buckets):
    """Buckets that many phrases share rule out less and change nothing."""
    monkeypatch.setattr(phrases, "FEWEST", buckets)
    monkeypatch.setattr(phrases, "MOST", buckets)
    docs = table(spark, SF, "documents")
    got = phrase_rows(phrases.collocations(docs, least=least, listed=150))
    assert got and got == brute_phrases([(r.lang, r.text) for r in docs.collect()], least, 150)


def test_buckets_rule_out(spark):
    """Of all pairs of words, few are counted by their own text."""
    docs = table(spark, SF.replace("0.001", "0.1"), "documents").select("text", "lang")
    maps = phrases.Maps(1 << 22)
    first = phrases._pass(docs, 1, maps, 30, 4)
    maps = phrases.Maps(1 << 22, phrases._bits(first.where("phrase IS NULL AND bucket IS NOT NULL"), 1 << 22), phrases._bits(first.where("phrase IS NOT NULL"), 1 << 22))
    rows = docs.limit(2000).toPandas()
    import pyarrow as pa

    p = phrases.Pieces(pa.array(rows["text"]), pa.array(rows["lang"]))
    counted = phrases._counts(p, 2, maps, 2)
    assert counted[-1].num_rows < 0.2 * len(np.unique(p.buckets(2, 1 << 40)))


def test_phrases_odd(spark):
    text = "New  York\tcity, new york City; NEW YORK\nnew york? été à la! été à la\x0bétÉ à la new"
    rows = [(i, text, "en" if i % 3 else None) for i in range(12)] + [(20, None, "en"), (21, "", None), (22, " \t ", "fr"), (23, "a b a b a b a b", "und"), (24, "x" * 100 + " " + "long " * 9000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "phrase", "rank", "bucket")})
    got = phrase_rows(phrases.collocations(docs, least=3))
    assert got == brute_phrases([r[:0:-1] for r in rows], 3) and {"en", "und", "de"} == {r[0] for r in got}
    assert phrases.collocations(docs.limit(0)).count() == 0 and phrases.collocations(docs.where("doc_id > 19 AND doc_id < 23")).count() == 0


def test_phrase_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 3_000_000_000_000_000_001
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    found = spark.createDataFrame([("en", "a", 1, big * 2), ("en", "b", 1, big + 2), ("en", "a b", 2, big)], "lang string, phrase string, words int, f long")
    import unittest.mock

    with unittest.mock.patch.object(phrases, "frequent_phrases", lambda *x: (found, spark.createDataFrame([("en", big * 2)], "lang string, n long"))):
        (row,) = phrases.collocations(docs).collect()
    assert (row.a, row.l, row.r, row.score) == (big, big * 2, big + 2, 2_000_000 * big // (3 * big + 2))


# ---------------------------------------------------------------- licenses
def test_phrases_count_whole(spark):
    from corpuscope.llm.licenses import scan_licenses

    texts = ["All rights are reserved here.", "all rights are reserved never", "x all rights are reserved", "all rights are reserved HERE all rights are reserved here", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(p.label, p.start, p.end) for p in r.places] for r in scan_licenses(docs, phrases={"all rights are reserved here": "r", "one": "o"}, templates={}).collect()}
    assert got == {0: [("r", 0, 5)], 1: [], 2: [], 3: [("r", 0, 5), ("r", 5, 10)], 4: [("o", 0, 1)]}


def test_whole_unlicense(spark):
    from corpuscope.llm.licenses import TEMPLATES, scan_licenses

    body = TEMPLATES["text:unlicense"][0].split("[[")[0]
    cut = body.index("in jurisdictions")
    texts = [body, body + "For more information, please refer to <https://unlicense.org/>", body[:cut] + "but only if you pay the author a fee", body[:cut], body.replace("relinquishment", "withdrawal")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {p.label: p.end for p in r.places} for r in scan_licenses(docs).collect()}
    n = len(body.split())
    assert got[0]["text:unlicense"] == n and got[1]["text:unlicense"] == n + 9
    assert all("text:unlicense" not in got[i] for i in (2, 3, 4))


# ---------------------------------------------------------------- what classifiers learn from
def test_sample_of_bounded_bytes(spark):
    from corpuscope.llm.labelled import bounded

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(50, "y" * 100_000), (3, "z" * 100)], "doc_id long, text string")
    chosen = docs.select("doc_id").distinct().withColumn("y", F.lit(1))
    assert bounded(docs, chosen, "doc_id", "text", 1 << 20).count() == 51
    kept = bounded(docs, chosen, "doc_id", "text", 2000)
    own = [r.doc_id for r in kept.collect()]
    total = docs.where(F.col("doc_id").isin(*own)).agg(F.sum(F.length("text"))).first()[0] if own else 0
    assert total <= 2000 and bounded(docs, chosen.limit(0), "doc_id", "text", 10).count() == 0
