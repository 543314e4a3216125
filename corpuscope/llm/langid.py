"""Language identification by averaged subword embeddings.

A text is the mean of the embeddings of its hashed letter sequences and words, and a linear softmax tells its language.
Both are trained together by stochastic gradient descent on a bounded sample. A part of the sample is kept back: on it
the scores are calibrated by a temperature, and the least score is chosen from which on predictions are accepted.
Applying the model needs one table of hashed sequences by languages, since the mean and the linear layer commute.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_hashes, map_texts, ranges, table, text_bytes
from .labelled import fold

#: Labelled documents that the model is trained on at most, dealt out evenly over languages, and the share of them that
#: only calibrates.
SAMPLE, KEPT_BACK = 2_000, 0.25
#: Hash buckets of sequences, numbers of an embedding, lengths of sequences in bytes.
BUCKETS, DIMENSIONS, LENGTHS = 1 << 14, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 30, 16, 0.5
#: Share of accepted predictions that shall be right, by the rows kept back.
PRECISION = 0.98
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)  # ASCII letters, and all bytes of other characters
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every sequence in the words of each text, a blank before and after each word included, and of
    every word; then how many each text has. Words are runs of letters, lower-cased A-Z."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    raw = np.insert(_LOWER[raw], offsets[1:], np.uint8(0x0A))
    offsets = offsets + np.arange(n + 1)
    inside = _LETTER[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offsets)))
    size = ends - starts
    padded = np.full(int((size + 2).sum()) + 8, 0x20, np.uint8)  # each word between two blanks
    first = np.cumsum(size + 2) - size - 2
    padded[ranges(first + 1, size)[0]] = raw[ranges(starts, size)[0]]
    four = np.ndarray(len(padded) - 4, "<u4", padded, strides=(1,))
    texts, buckets = [owner], [(byte_hashes(raw, starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS]
    for k in LENGTHS:
        many = np.maximum(size + 3 - k, 0)  # places of k bytes within a word and its blanks
        at, word = ranges(first, many)
        code = four[at] & np.uint32((1 << 8 * k) - 1 if k < 4 else 0xFFFFFFFF)
        code = (code + np.uint32(k)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA77)
        texts.append(owner[word])
        buckets.append((code >> np.uint32(32 - 14)).astype(np.int64) % BUCKETS)
    texts, buckets = np.concatenate(texts), np.concatenate(buckets)
    return texts, buckets, np.bincount(texts, minlength=n)


@dataclass
class Model:
    """langs in order; weights: what each bucket says for each language; temperature, bias and threshold."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        texts, buckets, counts = features(column)
        sums = np.stack([np.bincount(texts, self.weights[buckets, j], len(counts)) for j in range(len(self.langs))], axis=1)
        return sums / np.maximum(counts, 1)[:, None] + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], kept_back: np.ndarray, seed: int = 5) -> Model:
    """x: a row of bucket shares for each text; y: places in langs. Rows kept back calibrate, the others train."""
    draw = np.random.default_rng(seed)
    own = np.flatnonzero(~kept_back)
    embed = draw.normal(0, 0.1, (x.shape[1], DIMENSIONS)).astype(np.float32)
    out, bias = draw.normal(0, 0.1, (DIMENSIONS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    gain = np.float32(np.sqrt(x.shape[1]))  # means of many embeddings are small: rates of both layers are set for this scale
    target = np.eye(len(langs), dtype=np.float32)
    steps, done = max(1, EPOCHS * -(-len(own) // BATCH)), 0
    for _ in range(EPOCHS):
        order = draw.permutation(own)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = x[rows] @ embed * gain
            error = (softmax(mean @ out + bias) - target[y[rows]]) / len(rows)
            back = error @ out.T
            out -= rate * mean.T @ error
            bias -= rate * error.sum(axis=0)
            embed -= rate * (x[rows].T @ back) * gain
    model = Model(langs, (embed @ out * gain).astype(np.float64), bias.astype(np.float64))
    check = np.flatnonzero(kept_back)
    if len(check):
        logits = x[check] @ model.weights + model.bias
        model.temperature = calibrated(logits, y[check])
        model.threshold = accepted_from(softmax(logits / model.temperature), y[check])
    return model


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the right languages are likeliest."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    return min(np.exp(np.linspace(np.log(0.1), np.log(10), 61)).tolist(), key=loss)


def accepted_from(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least score so that of the predictions from it on the share that is right is at least precision."""
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score)
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= precision) & (np.append(score[order][1:], -1) < score[order]))  # ties stay together
    return float(score[order][last[-1]]) if len(last) else 1.1


def chosen_rows(docs: DataFrame, doc_id: str, text: str, lang: str, limit: int) -> DataFrame:
    """(id, lang, text) of about limit rows at most: of each language an even share, by a hash of id and text, and all rows
    of languages that have fewer."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()}
    each = limit / max(1, len(counts))
    one = 1 << 30
    share = spark_map({k: int(one * min(1.0, each / n)) for k, n in counts.items()})
    return known.where(F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(one)) < F.coalesce(share[F.col("lang")], F.lit(0)))


def spark_map(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair)) if values else F.create_map().cast("map<string,int>")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = SAMPLE) -> Model | None:
    """A model learnt from at most about limit of the rows; None without any row to learn from. The rows' sequences are
    counted by the executors; the driver gets 6 bytes for each of at most BUCKETS of a row, and no text."""
    fields = [T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]

    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, buckets, counts = features(batch.column("text"))
            code, n = np.unique(texts * BUCKETS + buckets, return_counts=True)
            cut = np.searchsorted(code, np.arange(len(counts) + 1) * BUCKETS)
            at = (code % BUCKETS).astype(np.uint16)
            share = (n / counts[code // BUCKETS]).astype(np.float32) if len(code) else np.zeros(0, np.float32)
            return [pa.array([z[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for z in (at, share)]

        return step

    rows = map_texts(chosen_rows(docs, doc_id, text, lang, limit).withColumn("order", F.xxhash64("id", "text")), fields, start, ["order", "lang"]).collect()
    rows = sorted((r for r in rows if len(r.at)), key=lambda r: (r.order, r.lang, bytes(r.at)))
    if not rows:
        return None
    langs = sorted({r.lang for r in rows}, key=str.encode)
    place = {k: i for i, k in enumerate(langs)}
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.float32)
    y = np.array([place[r.lang] for r in rows])
    kept_back = np.zeros(len(rows), bool)
    for j in range(len(langs)):  # of each language the same share, none where a language has a row or two
        own = np.flatnonzero(y == j)
        kept_back[own[: int(len(own) * KEPT_BACK)]] = True
    return fit(x, y, langs, kept_back)


def identify(docs: DataFrame, learn_from: Column, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = SAMPLE, reject: bool = True) -> DataFrame:
    """docs with lang_pred, score (calibrated probability, 0 to 1) and accepted (score at or over the threshold).

    learn_from: condition of rows that may be learnt from, of which at most about limit are. reject: predictions that are
    not accepted become `und`; else they stand, beside accepted. Texts that are null or without any letter are `und` with
    score 0, and so is every text if there is nothing to learn from. Whole texts count, however long; a prediction rests
    on the text alone, so repeated rows are predicted alike. Rows without language teach nothing; of ties the first
    language by bytes is taken. An empty table gives no rows. An input column named like a result gives way to it.
    """
    model = train(docs.where(learn_from), doc_id, text, lang, limit)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "accepted")]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own: Model = shared.value

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            p = softmax(own.logits(batch.column(text)) / own.temperature)
            best = p.argmax(axis=1)
            score = p[np.arange(len(p)), best]
            return [pa.array([own.langs[i] for i in best], pa.string()), pa.array(score), pa.array(score >= own.threshold)]

        return step

    # letters are told by Spark, since bytes don't show them; the sign goes along under a name that no column has
    sign = "_letter"
    while sign in docs.columns:
        sign += "_"
    out = map_texts(docs.withColumn(sign, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))), fields, start, [*keep, sign], text)
    accepted = F.col(sign) & F.col("accepted")
    said = F.when(accepted if reject else F.col(sign), F.col("lang_pred")).otherwise(UNKNOWN)
    return out.select(*keep, said.alias("lang_pred"), F.when(F.col(sign), F.col("score")).otherwise(0.0).alias("score"), accepted.alias("accepted"))


def op11_language_identification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = fold("doc_id", 4)
    found = identify(table(spark, sf_dir, "documents"), F.coalesce(rest != 2, F.lit(False)), keep=["doc_id"], reject=False)
    return found.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score", "accepted")
