"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of a word vector, if it is in enough training texts, and the mean of the vectors of its
character sequences of three and of five (all by hash). Every text is
read in overlapping windows; two gated recurrent passes give each word a state, attention pools them, and the worst
window is the text's score. Labels are of whole documents, so training takes each document's worst window by the
network so far (at first, by how the labels share out its words), and of harmless documents another one as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, give_back, map_texts, ranges, table
from .labelled import bounded, fold, sample, with_text

#: Labelled documents that the network is fitted on at most.
SAMPLE = 6000
#: Bytes of their texts that the driver holds at most.
LEARN_BYTES = 64 << 20
WINDOW, STRIDE, HIDDEN, INPUT = 24, 12, 8, 8
WORD_BUCKETS, CHAR_BUCKETS, LONG_BUCKETS = 1 << 15, 1 << 12, 1 << 15
#: Training texts that a word needs for a vector of its own, and how often training leaves that out, so that characters tell.
KNOWN_FROM, DROPPED = 10, 0.4
ROUNDS, BATCH, PART = 7, 256, 500
#: Windows that are run at once to rank them between rounds.
LEVELS = 1024


def _mod(x: np.ndarray, m: int) -> np.ndarray:
    """x % m of unsigned integers; numpy divides by one number much faster than it takes remainders."""
    return x - x // np.uint64(m) * np.uint64(m)


def word_inputs(w: Words, step: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch: word bucket, buckets of character sequences (word by word) and how many of them each word
    has; and each word's place among them. A word's ends count as characters. step: words that are worked on at once."""
    order = np.argsort(w.hashes)
    ordered = w.hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    first, inverse = order[new], np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    starts, ends = w.starts[first], w.ends[first]
    raw, blank = np.append(w.raw, np.full(4, 32, np.uint8)), np.uint8(32)
    chars = np.empty((int((ends - starts).sum()), 2), np.uint16)
    done = 0
    for i in range(0, len(first), step):
        place, owner = ranges(starts[i : i + step], (ends - starts)[i : i + step])
        left, rest = place > starts[i : i + step][owner], ends[i : i + step][owner] - place
        near = [np.where(left, raw[place - 1], blank), raw[place], *(np.where(rest > j, raw[place + j], blank) for j in (1, 2, 3))]
        near = [x.astype(np.uint64) for x in near]
        five = near[0]
        for x in near[1:]:
            five = five * 257 + x
        own = chars[done : done + len(place)]
        own[:, 0] = _mod((near[0] * 961 + near[1] * 31 + near[2]) * 40503, 1048573) % CHAR_BUCKETS
        own[:, 1] = CHAR_BUCKETS + _mod(_mod(five, 2147483647) * 40503, 1048573) % LONG_BUCKETS
        done += len(place)
    return (w.hashes[first] >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS, chars.ravel(), 2 * (ends - starts), inverse


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of all overlapping windows; a text without words has none."""
    counts = np.diff(offsets)
    each = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    step, doc = ranges(np.zeros(len(counts), np.int64), each)
    start = offsets[:-1][doc] + step * STRIDE
    return start, np.minimum(WINDOW, offsets[1:][doc] - start), doc


def _sigmoid(x):
    out = np.exp(-x)
    out += 1
    return np.divide(1, out, out=out)


class Network:
    """Parameters by name; forward() gives logits of windows, and backward() the gradients."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        self.p = {"words": f(WORD_BUCKETS, INPUT) * 0.1, "chars": f(CHAR_BUCKETS + LONG_BUCKETS, INPUT) * 0.1, "attend": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": f(INPUT, 3 * HIDDEN), f"u{way}": f(HIDDEN, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        self.slope, self.shift, self.known = 1.0, 0.0, np.ones(WORD_BUCKETS, bool)

    def embed(self, bucket: np.ndarray, chars: np.ndarray, counts: np.ndarray, own: np.ndarray | None = None, step: int = 2048) -> np.ndarray:
        """chars, counts: buckets of character sequences, word by word, and how many each word has. own: which words' vectors
        count, by default those of known words. step: words that are worked on at once."""
        out, ends = np.empty((len(bucket), INPUT), np.float32), np.cumsum(counts)
        starts = ends - counts
        for i in range(0, len(bucket), step):
            a, b = starts[i], ends[i : i + step][-1]
            out[i : i + step] = np.add.reduceat(self.p["chars"][chars[a:b]], starts[i : i + step] - a)
        own = self.known[bucket] if own is None else own
        return self.p["words"][bucket] * own[:, None] + out / np.maximum(counts, 1).astype(np.float32)[:, None]

    def _run(self, way: str, inputs: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool):
        """States (steps, windows, HIDDEN). inputs: projected words; at: their places (windows, steps)."""
        u, n, H = self.p[f"u{way}"], len(at), HIDDEN
        h, states, saved = np.zeros((n, H), np.float32), np.zeros((WINDOW, n, H), np.float32), {}
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x = np.take(inputs, at[:, t], axis=0)
            on = (t < length)[:, None]
            gates = _sigmoid(x[:, : 2 * H] + h @ u[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            c = np.tanh(x[:, 2 * H :] + (r * h) @ u[:, 2 * H :])
            if keep:
                saved[t] = (h, z, r, c, on)
            h = np.where(on, h + z * (c - h), h)
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """x: one row for each distinct word."""
        runs = {way: self._run(way, x @ self.p[f"w{way}"] + self.p[f"c{way}"], at, length, keep) for way in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        a = states @ self.p["attend"]
        a = np.where(np.arange(WINDOW)[:, None] < length[None, :], a, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (x, at, length, runs, states, a, pooled)) if keep else logit

    def backward(self, d: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients, and that of x, from the logits' d."""
        x, at, length, runs, states, a, pooled = kept
        g = {"bias": np.array([d.sum()], np.float32), "out": pooled.T @ d}
        dpool = np.outer(d, self.p["out"])
        da = (states * dpool[None]).sum(2)
        de = a * (da - (a * da).sum(0))
        g["attend"] = np.tensordot(de, states, ((0, 1), (0, 1)))
        dstates = a[:, :, None] * dpool[None] + de[:, :, None] * self.p["attend"]
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, H = self.p[f"u{way}"], HIDDEN
            gu, dproj, dh = np.zeros_like(u), np.zeros((len(x), 3 * H), np.float32), np.zeros((len(at), H), np.float32)
            for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                h, z, r, c, on = runs[way][1][t]
                dh = dh + dstates[t][:, k * H : (k + 1) * H]
                live = dh * on
                dc = live * z * (1 - c * c)
                dz = live * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                step = np.concatenate([dz, dr, dc], axis=1)
                gu[:, : 2 * H] += h.T @ step[:, : 2 * H]
                gu[:, 2 * H :] += (r * h).T @ dc
                np.add.at(dproj, at[:, t], step * on)
                dh = np.where(on, live * (1 - z) + drh * r + step[:, : 2 * H] @ u[:, : 2 * H].T, dh)
            g[f"u{way}"], g[f"w{way}"], g[f"c{way}"] = gu, x.T @ dproj, dproj.sum(0)
            dx += dproj @ self.p[f"w{way}"].T
        return g, dx

    def logits(self, x: np.ndarray, inverse: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 1024) -> np.ndarray:
        """forward()'s logits of windows over the words inverse, rows of x, up to rounding. Some windows of like length at a
        time go both ways at once, in arrays that stay in a core's own cache: cores that share memory don't wait for it."""
        p, H, out = self.p, HIDDEN, np.empty(len(start), np.float32)
        gates = [[p[f"{kind}{way}"][..., k * H : (k + 1) * H].copy() for way in "fb"] for kind in "wuc" for k in range(3)]
        for k in (0, 1, 3, 4, 6, 7):  # a sigmoid takes the exponential of what is below zero
            gates[k] = [-g for g in gates[k]]
        tables = [np.concatenate([x @ w + c for w, c in zip(gates[k], gates[6 + k])]) for k in range(3)]
        order = np.argsort(length, kind="stable")
        for i in range(0, len(start), step):
            rows = order[i : i + step]
            n, own, steps = len(rows), length[rows], int(length[rows[-1]])
            at = inverse[np.minimum(start[rows] + np.arange(steps)[:, None], len(inverse) - 1)]
            at = np.concatenate([at, at[::-1] + len(x)], axis=1)  # forward from the first word, backward from the last
            h, c, before = (np.zeros((2 * n, H), np.float32) for _ in range(3))
            zr, add = np.empty((2, 2, 2 * n, H), np.float32)
            states = np.empty((2, steps, n, H), np.float32)
            for t in range(steps):
                for k, g in enumerate(zr):
                    np.take(tables[k], at[t], axis=0, out=g, mode="clip")
                    np.matmul(h[:n], gates[3 + k][0], out=add[k, :n])
                    np.matmul(h[n:], gates[3 + k][1], out=add[k, n:])
                zr += add
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                np.multiply(zr[1], h, out=before)
                np.take(tables[2], at[t], axis=0, out=c, mode="clip")
                np.matmul(before[:n], gates[5][0], out=add[0, :n])
                np.matmul(before[n:], gates[5][1], out=add[0, n:])
                c += add[0]
                np.tanh(c, out=c)
                c -= h
                c *= zr[0]
                c += h
                if own[0] < steps:
                    np.copyto(h, c, where=np.concatenate([t < own, steps - 1 - t < own])[:, None])
                else:
                    h, c = c, h
                states[0, t], states[1, steps - 1 - t] = h[:n], h[n:]
            a = states[0] @ p["attend"][:H] + states[1] @ p["attend"][H:]
            a[np.arange(steps)[:, None] >= own] = -1e9
            a = np.exp(a - a.max(0))
            a /= a.sum(0)
            out[rows] = sum(np.einsum("tn,tnh->nh", a, one) @ o for one, o in zip(states, (p["out"][:H], p["out"][H:]))) + p["bias"][0]
        return out

    # ------------------------------------------------------------ texts
    def document_logits(self, column: pa.Array) -> np.ndarray:
        """The largest window logit of each text; of a text without words, that of an empty state."""
        w = Words(column, ALNUM)
        out = np.full(len(w.counts), -np.inf, np.float32)
        bucket, chars, counts, inverse = word_inputs(w)
        start, length, doc = windows(w.offsets)
        np.maximum.at(out, doc, self.logits(self.embed(bucket, chars, counts), inverse, start, length))
        return np.where(np.isfinite(out), out, self.p["bias"][0] - 20)

    def scores(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * self.document_logits(column).astype(float) + self.shift, -30, 30))


def train(column: pa.Array, y: np.ndarray, seed: int = 5) -> Network:
    """Fit to whole texts with labels 0 and 1. With one kind of label only, scores stay near that share."""
    net, r = Network(seed), np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        net.slope, net.shift = 0.0, 0.0 if len(y) == 0 else (3.0 if y[0] else -3.0)
        return net
    parts, base = [], y.mean()  # some texts at a time, so that memory follows the part and not the sample
    toxic, total = np.zeros(WORD_BUCKETS), np.zeros(WORD_BUCKETS)
    for i in range(0, len(y), PART):
        w = Words(column.slice(i, PART), ALNUM)
        bucket, chars, counts, inverse = word_inputs(w)
        start, length, doc = windows(w.offsets)
        pair = np.unique(w.doc * WORD_BUCKETS + bucket[inverse])
        toxic += np.bincount(pair % WORD_BUCKETS, y[i + pair // WORD_BUCKETS].astype(float), WORD_BUCKETS)
        total += np.bincount(pair % WORD_BUCKETS, minlength=WORD_BUCKETS)
        parts.append([bucket.astype(np.int32), chars, counts.astype(np.int32), inverse.astype(np.int32), start, length, doc + i, None])
    del column, w, pair
    give_back()
    # how the labels share out the words, by document
    odds = np.log((toxic + 4 * base) / (total - toxic + 4 * (1 - base))) - np.log(base / (1 - base))
    net.known = total >= min(KNOWN_FROM, max(1.0, len(y) / 50))
    odds *= net.known
    net.p["words"][:, 0] += np.clip(odds, -3, 3).astype(np.float32) * 0.5
    for part in parts:
        sums = np.concatenate([[0], np.cumsum(np.maximum(odds, 0)[part[0][part[3]]] ** 2)])
        part[7] = sums[part[4] + part[5]] - sums[part[4]]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick, weight = 0, np.where(y == 1, min(10.0, (1 - base) / base), 1.0)
    for k in range(ROUNDS):
        for bucket, chars, counts, inverse, start, length, doc, level in (parts[j] for j in r.permutation(len(parts)) if len(parts[j][6])):
            order = np.lexsort((r.random(len(doc)), level, doc))
            worst = order[np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))]
            other = r.integers(0, len(doc), len(worst))
            ends = np.cumsum(counts)
            chosen = r.permutation(np.concatenate([worst, other[y[doc[other]] == 0]]))
            for i in range(0, len(chosen), BATCH):
                own = chosen[i : i + BATCH]
                words, at = np.unique(inverse[np.minimum(start[own, None] + np.arange(WINDOW), len(inverse) - 1)], return_inverse=True)
                of, renamed = ranges(ends[words] - counts[words], counts[words])
                grams = chars[of]
                use = net.known[bucket[words]] & (r.random(len(words)) >= DROPPED)
                x = net.embed(bucket[words], grams, counts[words], use)
                logit, kept = net.forward(x, at.reshape(len(own), WINDOW), length[own], keep=True)
                d = ((_sigmoid(logit) - y[doc[own]]) * weight[doc[own]] / len(own)).astype(np.float32)
                g, dx = net.backward(d, kept)
                g["words"] = np.zeros_like(net.p["words"])
                np.add.at(g["words"], bucket[words], dx * use[:, None])
                g["chars"] = np.zeros_like(net.p["chars"])
                np.add.at(g["chars"], grams, (dx / counts[words].astype(np.int64)[:, None])[renamed])
                tick += 1
                rate = 0.01 * (1 - 0.8 * k / ROUNDS)
                for name, grad in g.items():
                    m, v = state[name]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    net.p[name] -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-6)
        if k >= 1:
            for part in parts:
                bucket, chars, counts, inverse, start, length = part[:6]
                x = net.embed(bucket, chars, counts)
                at = lambda i: inverse[np.minimum(start[i : i + LEVELS, None] + np.arange(WINDOW), len(inverse) - 1)]
                part[7] = np.concatenate([np.zeros(0, np.float32), *(net.forward(x, at(i), length[i : i + LEVELS]) for i in range(0, len(start), LEVELS))])
        give_back()
    # one slope and shift from the documents' worst windows to probabilities
    z = np.full(len(y), float(net.p["bias"][0]) - 20)
    for part in parts:
        np.maximum.at(z, part[6], part[7].astype(float))
    a, b = 1.0, 0.0
    zs = np.clip(z, -15, 15)
    for _ in range(500):
        e = _sigmoid(a * zs + b) - y
        a, b = a - 0.05 * ((e * zs).mean() + 1e-3 * (a - 1)), b - 0.2 * e.mean()
    net.slope, net.shift = max(a, 0.1), b
    return net


def _columns(rows: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Texts as Arrow holds them, without a Python string of each, and labels."""
    both = rows.toArrow()
    return both["t"].combine_chunks(), both["y"].to_numpy().astype(np.int64)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_fold, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, limit: int = SAMPLE) -> DataFrame:
    """docs with score (0 to 1) and predicted (score at or over threshold).

    train_fold: condition on doc_id of rows that may be learnt from; at most limit of them are, and so many that their
    texts take LEARN_BYTES, chosen by a hash of the id. Every row is scored by all windows of its whole text, and by nothing else. Null and empty texts get the lowest
    score. Null labels, labels without document and repeated labels do no harm (of contradicting ones, 1 counts);
    without labels every score is 0.5. An empty table gives no rows; repeated rows are scored alike, and a score at the
    threshold is predicted 1. A text of up to 2 GiB is held whole in a task. An input column named like a result gives way to it.
    """
    chosen = sample(labels.where(train_fold).where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y")), doc_id, limit)
    chosen = bounded(docs, chosen, doc_id, text, LEARN_BYTES)
    net = train(*_columns(with_text(docs, chosen, doc_id, text).select(F.coalesce(text, F.lit("")).alias("t"), "y")))
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            s = shared.value.scores(batch.column(text))
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

        return step

    return map_texts(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start, docs.columns if keep is None else keep, text)


def op6_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
