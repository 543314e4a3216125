"""Tables in restaurants against exact weights, and the language model's probabilities against their sum and a sampler that
moves one customer at a time."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import language, seating
from corpuscope.llm.common import mix
from corpuscope.llm.language import DISCOUNT, STRENGTH, score_texts

LEVELS = [(DISCOUNT[0], STRENGTH[0]), (DISCOUNT[1], STRENGTH[1])]


def exact(c, count, mass, total, d, theta):
    """Mean and deviation of the number of tables, by all weights."""
    t = np.arange(1, c + 1)
    parent = np.log(count) * t if np.isinf(mass) else np.cumsum(np.log((count + t - 1) / (mass + t - 1)))
    w = seating.stirling_table(d, 2000)[c, 1 : c + 1] + np.cumsum(np.log(theta + d * (total + t - 1))) + parent
    w = np.exp(w - w.max())
    w /= w.sum()
    mean = (w * t).sum()
    return mean, np.sqrt(max(0, (w * t * t).sum() - mean**2))


@pytest.mark.parametrize("d, theta", LEVELS)
@pytest.mark.parametrize("c", [2, 7, 40, 41, 80, 400, 1025, 2000])
def test_draws(d, theta, c):
    n = 3000
    for count, mass, total in ((0.001, np.inf, 100), (0.01, np.inf, 500), (0.3, np.inf, 5000), (50.0, 3000.0, 500), (2.5, 40.0, 3), (1e-5, np.inf, 10)):
        mean, spread = exact(c, count, mass, total, d, theta)
        x = seating.draw_tables(np.full(n, c), seating.Parent(np.full(n, count), mass), np.full(n, total), d, theta, mix(np.arange(n).astype(np.uint64)))
        assert x.min() >= 1 and x.max() <= c
        assert abs(x.mean() - mean) < 0.02 * mean + 4 * spread / np.sqrt(n) and abs(x.std() - spread) < 0.1 * spread + 0.05


def test_weights_of_tabled_customers_take_no_gamma_functions(monkeypatch):
    def refused(x):
        raise AssertionError("a gamma function is worked out")

    monkeypatch.setattr(seating, "log_gamma", refused)
    c = np.repeat([2, 40, 41, 300, 1024], 20)
    for parent in (seating.Parent(np.full(100, 0.3)), seating.Parent(np.full(100, 50.0), 3000.0)):
        x = seating.draw_tables(c, parent, np.full(100, 500), 0.75, 1.0, mix(np.arange(100).astype(np.uint64)))
        assert (x >= 1).all() and (x <= c).all()


def test_interpolated_weights():
    c, parent, total, t = np.full(2, 50_000.0), seating.Parent(np.array([900.0, 5000.0]), 1e6), np.full(2, 9000.0), np.arange(500.0, 1500.0, 9)
    f = lambda rows, t: seating.log_weight(c[rows], t, parent.of(rows), total[rows], 0.75, 1.0)
    at = np.repeat(t[None], 2, axis=0)
    made = seating._interpolated(f, at[:, 0], at[:, -1], at)
    assert np.abs(made - f(np.repeat([0, 1], len(t)), at.ravel()).reshape(at.shape)).max() < 1e-4


def test_draws_of_many_customers_take_few_stirling_numbers(monkeypatch):
    """The peak is found without halving all numbers of tables, and what each draw works out does not grow with its customers."""
    asked, whole = [], seating.log_stirling
    monkeypatch.setattr(seating, "log_stirling", lambda c, t, d: (asked.append(len(c)), whole(c, t, d))[1])
    for size in (10**5, 10**7):
        n = 200
        asked.clear()
        seating.draw_tables(np.full(n, size), seating.Parent(np.full(n, 0.3)), np.full(n, 5000), 0.75, 1.0, mix(np.arange(n).astype(np.uint64)))
        assert sum(asked) <= 35 * n


@pytest.mark.parametrize("d, theta", LEVELS)
def test_peaks(d, theta):
    """The most likely number of tables, by all weights."""
    r, n = np.random.default_rng(5), 60
    c, total, mass = r.integers(1025, 2001, n), r.integers(1, 10**5, n), 3e5
    for parent in (seating.Parent(10 ** r.uniform(-2, 4, n), mass), seating.Parent(10 ** r.uniform(-7, 0, n))):
        got = seating._peak(c.astype(float), parent, total, d, theta)
        for i in range(n):
            t = np.arange(1, c[i] + 1)
            gives = parent.of(np.array([i])).after(t - 1.0)
            weight = seating.stirling_table(d, 2000)[c[i], t] + np.cumsum(np.log(theta + d * (total[i] + t - 1)) + np.log(gives))
            # near c^d tables one formula for Stirling numbers gives way to the other
            assert weight[int(got[i]) - 1] > weight.max() - 0.01


@pytest.mark.parametrize("d", [0.6, 0.75])
def test_stirling_numbers_of_many_customers(d):
    """Beyond the table: steps from one number of tables to the next, which are what draws rest on."""
    whole = seating.stirling_table(d, 2000)
    for c in (1025, 1500, 2000):
        t = np.arange(1, c + 1)
        got = seating.log_stirling(np.full(c, c), t, d)
        step = np.abs(np.diff(got) - np.diff(whole[c, 1 : c + 1]))
        assert np.sort(step)[:-2].max() < 0.003 and step.max() < 0.15  # one step is from one formula to the other
    big = seating.log_stirling(np.full(3, 10**7), np.array([1, 10**4, 10**7]), d)
    assert np.isfinite(big).all() and big[2] == 0


def test_rising_products():
    for x in (0.5, 3.0, 9.9e4, 1.1e5, 1e9, 1e13):
        k = np.array([1.0, 2, 10, 500, 900])
        got = seating.log_rise(np.full(5, x), k)
        want = np.array([np.log(x + np.arange(n)).sum() for n in k.astype(int)])
        assert np.abs(np.diff(got) - np.diff(want)).max() < 1e-6 * max(1, np.abs(want).max() / 1e3)


def test_large_counts():
    """Millions of customers: draws are finite, between their bounds, and grow with what the parent gives."""
    n = 50
    means = []
    for count in (1e-6, 1e-4, 1e-2):
        x = seating.draw_tables(np.full(n, 5_000_000), seating.Parent(np.full(n, count)), np.full(n, 300_000), 0.75, 1.0, mix(np.arange(n).astype(np.uint64)))
        assert x.min() >= 1 and x.max() < 5_000_000
        means.append(x.mean())
    assert means[0] < means[1] < means[2]


# ---------------------------------------------------------------- the model
def small_corpus(seed=4, n=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(9)]
    texts = []
    for _ in range(n):
        w = draw.choice(words)
        text = [w]
        for _ in range(draw.randrange(3, 12)):
            w = words[(words.index(w) * 2 + draw.choice([0, 0, 0, 1, 4])) % 9]
            text.append(w)
        texts.append(text)
    return words, texts


def scores(spark, train, test):
    rows = [(i, " ".join(t)) for i, t in enumerate(train)] + [(10**6 + i, " ".join(t)) for i, t in enumerate(test)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("doc_id") < 10**6, keep=["doc_id"]).collect()}
    return np.array([got[10**6 + i] for i in range(len(test))])


def test_probabilities_sum_to_one(spark):
    """With s the probability of a text: s(u w v) / s(u w) = M[w, v], and if each context's probabilities sum to 1, the ends'
    inverse probabilities r solve r = M r + 1. What starts a text then sums to 1 by them."""
    words, train = small_corpus()
    every = [*words, "unknown"]
    test = [[], *([v] for v in every), *([words[0], w] for w in every), *([words[0], w, v] for w in every for v in every)]
    p = 10 ** scores(spark, train, test)
    k = len(every)
    alone, two, three = p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[1 + 2 * k :].reshape(k, k)
    r = np.linalg.solve(np.eye(k) - three / two[:, None], np.ones(k))
    assert (r > 1).all() and abs(p[0] + (alone * r).sum() - 1) < 1e-5


class OneByOne:
    """Two levels of restaurants, customers moved one at a time."""

    def __init__(self, texts, seed=1):
        self.draw = random.Random(seed)
        self.pairs = [(u, w) for t in texts for u, w in zip([None, *t], [*t, None])]
        self.known = {w for _, w in self.pairs}
        self.tables = defaultdict(lambda: defaultdict(list))  # context -> word -> sizes
        self.top = defaultdict(list)
        for pair in self.pairs:
            self.add(*pair)

    def p0(self, w):
        d, s = LEVELS[0]
        n, t = sum(map(sum, self.top.values())), sum(map(len, self.top.values()))
        return (sum(self.top[w]) - d * len(self.top[w]) + (s + d * t) / (len(self.known) + 1)) / (s + n)

    def p(self, u, w):
        d, s = LEVELS[1]
        here = self.tables[u]
        n, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        return (sum(here[w]) - d * len(here[w]) + (s + d * t) * self.p0(w)) / (s + n)

    def seat(self, sizes, d, new):
        weights = [x - d for x in sizes] + [new]
        return self.draw.choices(range(len(weights)), weights)[0]

    def add(self, u, w):
        d, s = LEVELS[1]
        here = self.tables[u]
        at = self.seat(here[w], d, (s + d * sum(map(len, here.values()))) * self.p0(w))
        if at < len(here[w]):
            here[w][at] += 1
            return
        here[w].append(1)
        d, s = LEVELS[0]
        at = self.seat(self.top[w], d, (s + d * sum(map(len, self.top.values()))) / (len(self.known) + 1))
        self.top[w].append(1) if at == len(self.top[w]) else self.top[w].__setitem__(at, self.top[w][at] + 1)

    def leave(self, sizes):
        at = self.draw.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        if not sizes[at]:
            del sizes[at]
            return True

    def sweep(self):
        for u, w in self.pairs:
            if self.leave(self.tables[u][w]):
                self.leave(self.top[w])
            self.add(u, w)


def test_against_one_customer_at_a_time(spark, monkeypatch):
    """On a small corpus the mean predictions of both samplers agree."""
    monkeypatch.setattr(language, "BURN_IN", 6)
    monkeypatch.setattr(language, "SAMPLES", 6)
    _, train = small_corpus()
    _, test = small_corpus(9, 30)
    test = [*test, ["w1", "unknown"], ["w3"], []]
    model, means = OneByOne(train), Counter()
    for i in range(120):
        model.sweep()
        if i >= 20:
            for pair in {(u, w) for t in test for u, w in zip([None, *t], [*t, None])}:
                means[pair] += model.p(*pair) / 100
    want = np.array([sum(np.log10(means[pair]) for pair in zip([None, *t], [*t, None])) for t in test])
    got = scores(spark, train, test)
    assert abs(got.sum() / want.sum() - 1) < 0.01
    assert (np.abs(got - want) < 0.03 * np.abs(want) + 0.05).all()


def test_blocks_ask_for_their_pairs_once(spark, monkeypatch):
    """Pairs are dealt out to their buckets once, for counts and for answers; of what is saved only the scores stay."""
    import os

    from corpuscope.llm.common import scratch_dir

    asked, whole = [], language._pair_requests
    monkeypatch.setattr(language, "_pair_requests", lambda *a: (asked.append(1), whole(*a))[1])
    folder = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    _, train = small_corpus()
    scores(spark, train, train[:3])
    assert len(asked) == 1
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"scores"}
