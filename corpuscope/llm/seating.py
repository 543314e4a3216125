"""How many tables the customers of one dish sit at in a restaurant of a Pitman-Yor process, drawn from the posterior.

Of c customers at t tables of one dish, beside `total` tables of other dishes, the weight is the generalised Stirling
number S_d(c, t), the ways to seat them, times the rising product of strength + discount * tables for the t tables, times
what the parent gives for t more customers of the dish. Stirling numbers are exact up to LIMIT customers. Beyond, their
alternating sum is taken where few tables are likely, and the saddle point of their generating function elsewhere.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import mix

#: Customers up to which all weights are gone through at once, and up to which Stirling numbers are tabled.
SMALL, LIMIT = 40, 1024
#: Places at which the weights of many customers are worked out, and how many standard deviations these reach.
PLACES, REACH = 128, 7.5
#: Chebyshev points from which logs of weights at the places are interpolated, far enough from t = 0 with errors below 1e-6.
NODES = 17
#: Terms of the alternating sum.
TERMS = 32
#: Weights of tabled customers that are worked out at a time.
WEIGHTS = 50_000
#: How far from where the saddle point has the peak it is looked for first.
NEXT = 2
#: Numbers of more customers than are tabled that are drawn at a time.
MANY = 1000
#: Stirling numbers that are worked out at a time, in some 3 KB each.
PART = 8192


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    while (low := x < 8).any():
        shift[low] -= np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x


def log_rise(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + k - 1), up to what does not depend on k: for large x, of which gamma functions would leave
    no digits, by the middle factor."""
    out, large = np.empty(len(x)), x > 1e5
    out[~large] = log_gamma((x + k)[~large])
    near = large & (k < 0.01 * x)
    if near.any():
        n, middle = k[near], x[near] + (k[near] - 1) / 2
        out[near] = n * np.log(middle) - n * (n * n - 1) / (24 * middle * middle)
    far = large & ~near
    out[far] = log_gamma((x + k)[far]) - log_gamma(x[far])
    return out


@lru_cache(maxsize=4)
def stirling_table(d: float, limit: int = LIMIT) -> np.ndarray:
    """log S_d(c, t) for c, t up to limit."""
    s = np.full((limit + 1, limit + 1), -np.inf)
    s[0, 0] = 0
    for c in range(limit):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 0)))
    return s


def _by_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) of large c where t is below c^d: sum over j of (-1)^j binomial(t, j) gamma(c - d j) / gamma(-d j) /
    (t! d^t), whose terms fall off fast there. Gamma functions depend on c alone, so each c has them once."""
    j = np.arange(1, TERMS + 1, dtype=np.float64)
    # 1 / gamma(-d j) = -gamma(1 + d j) sin(pi d j) / pi
    sign = np.where(j % 2 == 1, 1.0, -1.0) * np.sin(np.pi * d * j) / np.pi
    own, at = np.unique(c, return_inverse=True)
    lead, scale = log_gamma(own - d), d * np.log(own)
    size = sign[:, None] * np.exp(log_gamma(own[None] - d * j[:, None]) - lead[None] + (j[:, None] - 1) * scale[None] + log_gamma(1 + d * j)[:, None])
    each = np.exp(-scale)[at]  # binomials rise by some c^d a step, and what they are multiplied by falls by that
    binomial, total = t.copy(), size[0][at] * t
    for k in range(1, min(TERMS, int(np.ceil(t.max(initial=1))))):
        binomial *= np.maximum(t - k, 0) / (k + 1) * each
        total += size[k][at] * binomial
    return np.log(np.maximum(total, 1e-300)) + lead[at] - log_gamma(t + 1) - t * np.log(d)


def _by_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) by the saddle point of ((1 - (1 - x)^d) / d)^t / x^c."""
    m = c / t
    goal, low, high = np.log(m / d), np.full(len(c), -300.0), np.full(len(c), -1e-10)
    u = np.clip(np.log(d / m) / (1 - d), -290.0, -1e-3)  # u: log of 1 - x
    for _ in range(40):
        x, y = -np.expm1(u), -np.expm1(d * u)
        h = np.log(x / y) + (d - 1) * u - goal
        low, high = np.where(h > 0, u, low), np.where(h > 0, high, u)
        slope = d - 1 + d * (1 - y) / y - (1 - x) / x
        step = u - h / slope
        step = np.where((step > low) & (step < high), step, (low + high) / 2)
        near = np.abs(step - u) <= 1e-13 * np.abs(u)
        u = step
        if near.all():
            break
    x = -np.expm1(u)
    spread = np.maximum(m * (1 + x * (1 - d) / np.exp(u) - m), 1e-12)
    point = log_gamma(c + 1) - log_gamma(t + 1) + t * (np.log(-np.expm1(d * u)) - np.log(d)) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * spread)
    k = c - t  # where nearly all sit alone, the point errs as Stirling's formula for k! does
    return point - (log_gamma(k + 1) - k * np.log(k) + k - 0.5 * np.log(2 * np.pi * k))


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) of whole numbers 1 <= t <= c."""
    c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
    out = np.zeros(len(c))
    tabled, all_alone = c <= LIMIT, t >= c
    out[tabled] = stirling_table(d)[c[tabled].astype(np.int64), t[tabled].astype(np.int64)]
    few = ~tabled & ~all_alone & (t < c**d)
    many = ~tabled & ~all_alone & ~few
    for where, by in ((np.flatnonzero(few), _by_sum), (np.flatnonzero(many), _by_saddle)):
        for a in range(0, len(where), PART):
            own = where[a : a + PART]
            out[own] = by(c[own], t[own], d)
    return out


# ---------------------------------------------------------------- weights and draws
def uniforms(seed: np.ndarray, first: int, n: int) -> np.ndarray:
    """The numbers first, first + 1, ... of each seed's own sequence, in (0, 1)."""
    at = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mix(seed[:, None] + at[None]) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Parent:
    """What the parent gives for customers of a dish: (count + k) / (mass + k) for the k-th more; mass may be infinite,
    then the same each time, and count is that."""

    def __init__(self, count: np.ndarray, mass: float | np.ndarray = np.inf):
        self.count, self.mass = count, np.broadcast_to(np.asarray(mass, np.float64), count.shape)
        rising = np.isfinite(self.mass)
        self.rising, self.fixed = bool(rising.all()), not rising.any()  # all of them

    def of(self, rows) -> Parent:
        return Parent(self.count[rows], self.mass[rows])

    def next(self, i: np.ndarray) -> np.ndarray:
        """What it gives for one customer more, i having come, for each dish and each of some i."""
        if self.rising:
            return (self.count[:, None] + i[None]) / (self.mass[:, None] + i[None])
        if self.fixed:
            return np.repeat(self.count[:, None], len(i), axis=1)
        rising = np.isfinite(self.mass)
        mass = np.where(rising, self.mass, 1.0)
        return np.where(rising[:, None], (self.count[:, None] + i[None]) / (mass[:, None] + i[None]), self.count[:, None])

    def after(self, t: np.ndarray) -> np.ndarray:
        """What it gives for one customer more, t of the dish having come."""
        if self.rising:
            return (self.count + t) / (self.mass + t)
        if self.fixed:
            return np.broadcast_to(self.count, np.broadcast(self.count, t).shape)
        rising = np.isfinite(self.mass)
        return np.where(rising, (self.count + t) / np.where(rising, self.mass + t, 1.0), self.count)

    def log(self, t: np.ndarray) -> np.ndarray:
        """log of what it gives for t customers in a row, up to what does not depend on t."""
        out = t * np.log(self.count)
        rising = np.isfinite(self.mass)
        if rising.any():
            a, b, k = self.count[rising], self.mass[rising], t[rising]
            out[rising] = log_rise(a, k) - log_rise(b, k)
        return out


def log_weight(c: np.ndarray, t: np.ndarray, parent: Parent, total: np.ndarray, d: float, theta: float) -> np.ndarray:
    """log of the weight of t tables, up to what does not depend on t."""
    t = np.asarray(t, np.float64)
    return log_stirling(c, t, d) + t * np.log(d) + log_rise(theta / d + total, t) + parent.log(t)


def _sums(ratio: np.ndarray, parent: Parent, total: np.ndarray, d: float, theta: float) -> np.ndarray:
    """Of some dishes of as many customers each, the weights of 1, of 1 and 2, of 1 to 3 tables and so on, up to one factor a
    dish. ratio: how many times as many ways there are to seat them at one table more."""
    i = np.arange(1, len(ratio) + 1, dtype=np.float64)[:, None]
    weight = np.ones((len(ratio) + 1, len(total)))
    step = weight[1:]
    np.add(theta + d * total, d * i, out=step)
    step *= ratio[:, None]
    step *= parent.after(i)
    if np.log(np.maximum(step.max(axis=1), 1)).sum() > 600:  # the products may leave the range of numbers
        step[:] = np.log(step).cumsum(axis=0)
        weight[0] = 0
        weight = np.exp(weight - weight.max(axis=0))
    else:
        for k in range(1, len(step)):
            step[k] *= step[k - 1]
    for k in range(1, len(weight)):
        weight[k] += weight[k - 1]
    return weight


def draw_tables(c: np.ndarray, parent: Parent, total: np.ndarray, d: float, theta: float, seed: np.ndarray) -> np.ndarray:
    """Tables of c customers of one dish, drawn by their weights; none for no customer, one for one."""
    t, total = np.minimum(c, 1), np.maximum(total, 0).astype(np.float64)
    table = stirling_table(d)
    small = np.where((c > 1) & (c <= SMALL), c, 0)
    by_count = np.argsort(small, kind="stable")
    ends = np.searchsorted(small[by_count], np.arange(2, SMALL + 2))
    for k in range(2, SMALL + 1):
        own = by_count[ends[k - 2] : ends[k - 1]]
        if len(own):
            sums = _sums(np.exp(np.diff(table[k, 1 : k + 1])), parent.of(own), total[own], d, theta)
            t[own] = 1 + (sums[:-1] < uniforms(seed[own], 0, 1)[:, 0] * sums[-1]).sum(axis=0)
    own = np.flatnonzero((c > SMALL) & (c <= LIMIT))
    own, a = own[np.argsort(c[own], kind="stable")], 0
    while a < len(own):
        x = own[a : a + max(1, WEIGHTS // int(c[own[a]]))]
        x = x[c[x] <= 2 * c[x[0]]]  # sorted: no row is much longer than its own customers
        a += len(x)
        i = np.arange(1, c[x[-1]], dtype=np.float64)
        logs = table[c[x], 1 : c[x[-1]] + 1]  # none beyond a row's own customers
        logs[:, 1:] += np.log((theta + d * (total[x][:, None] + i[None])) * parent.of(x).next(i)).cumsum(axis=1)
        weight = np.exp(logs - logs.max(axis=1, keepdims=True)).cumsum(axis=1)
        t[x] = 1 + (weight[:, :-1] < uniforms(seed[x], 0, 1) * weight[:, -1:]).sum(axis=1)
    own = np.flatnonzero(c > LIMIT)
    for a in range(0, len(own), MANY):
        x = own[a : a + MANY]
        t[x] = _draw_many(c[x].astype(np.float64), parent.of(x), total[x], d, theta, seed[x])
    return t


def _interpolated(f, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """f(rows, t) at places of each row, by the polynomial through its values at NODES points between first and last."""
    j = np.arange(NODES)
    points = (first[:, None] + last[:, None]) / 2 - np.cos(np.pi * j / (NODES - 1))[None] * (last - first)[:, None] / 2
    values = f(np.repeat(np.arange(len(first)), NODES), points.ravel()).reshape(points.shape)
    share = np.where(j % 2 == 0, 1.0, -1.0) * np.where((j == 0) | (j == NODES - 1), 0.5, 1.0)
    above, below = np.zeros(at.shape), np.zeros(at.shape)
    for k in j:
        away = at - points[:, k : k + 1]
        part = share[k] / np.where(np.abs(away) < 1e-9, 1e-9, away)
        above += part * values[:, k : k + 1]
        below += part
    return above / below


def _peak(c: np.ndarray, parent: Parent, total: np.ndarray, d: float, theta: float) -> np.ndarray:
    """The first number of tables whose successor weighs less. Of the saddle point's u, the number of tables that it is of
    and the slope of the weights' logs there are plain functions, so halving finds where this is 0, which is next to it;
    the weights themselves are compared there, and further off only where it is not found."""
    low, high = np.full(len(c), np.log(1e-10)), np.full(len(c), np.log(300.0))  # of log(-u): many tables, few tables
    for _ in range(40):
        middle = (low + high) / 2
        u = -np.exp(middle)
        x, y = -np.expm1(u), -np.expm1(d * u)
        t = np.clip(c * y / (d * x) * np.exp((1 - d) * u), 1e-3, c)
        falls = y / (t + 0.5) / d * (theta + d * (total + t)) * parent.after(t) < 1
        low, high = np.where(falls, middle, low), np.where(falls, high, middle)
    about = np.clip(np.round(t), 1, c)

    def rises(rows, first, n):
        """Whether first, first + 1, ... tables of each row weigh less than one more."""
        t = np.minimum(first[:, None] + np.arange(n + 1), c[rows, None])
        ways = log_stirling(np.repeat(c[rows], n + 1), t.ravel(), d).reshape(t.shape)
        more = (theta + d * (total[rows, None] + t[:, :-1])) * parent.of(rows).after(t[:, :-1].T).T
        return (np.diff(ways) + np.log(more) > 0) & (t[:, :-1] < c[rows, None])

    low = np.maximum(about - NEXT, 1)
    up = rises(np.arange(len(c)), low, 2 * NEXT + 1).sum(axis=1)
    high = low + up
    later, sooner = up == 2 * NEXT + 1, (up == 0) & (low > 1)
    low, high = np.where(sooner, 1, high), np.where(later, c, high)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = np.floor((low[open_] + high[open_]) / 2)
        up = rises(open_, middle, 1)[:, 0]
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]
    return low


def _draw_many(c: np.ndarray, parent: Parent, total: np.ndarray, d: float, theta: float, seed: np.ndarray) -> np.ndarray:
    """Tables of more than LIMIT customers. The weights have one peak. They are worked out at PLACES cells around it: cells
    of one number of tables where the peak is narrow, of several, taken by their middle, where it is broad."""
    weigh = lambda rows, t: log_weight(c[rows], t, parent.of(rows), total[rows], d, theta)
    every = np.arange(len(c))
    peak = _peak(c, parent, total, d, theta)
    # twice the curvature at the peak gives its width
    h = np.maximum(1, np.floor(np.sqrt(peak)))
    left, right = np.maximum(1, peak - h), np.minimum(c, peak + h)
    top = weigh(every, peak)
    drop = np.maximum(np.maximum(top - weigh(every, left), top - weigh(every, right)), 1e-9)
    reach = np.maximum(12, np.ceil(REACH * np.maximum(peak - left, right - peak) / np.sqrt(2 * drop)))
    first, last = np.maximum(1, peak - reach), np.minimum(c, peak + reach)
    step = np.ceil((last - first + 1) / PLACES)
    at = first[:, None] + step[:, None] * np.arange(PLACES)[None]
    size = np.clip(last[:, None] - at + 1, 0, step[:, None])  # numbers of tables in each cell
    weight, middle = np.full(at.shape, -np.inf), at + np.floor((size - 1) / 2)
    smooth = (last - first >= 4 * NODES) & (first >= (last - first) / 4)
    some = (size > 0) & ~smooth[:, None]
    weight[some] = weigh(np.nonzero(some)[0], middle[some])
    own = np.flatnonzero(smooth)
    if len(own):
        weight[own] = _interpolated(lambda rows, t: weigh(own[rows], t), first[own], last[own], np.minimum(middle[own], last[own, None]))
    mass = np.where(size > 0, size * np.exp(weight - weight.max(axis=1, keepdims=True)), 0).cumsum(axis=1)
    draws = uniforms(seed, 0, 2)
    cell = np.minimum((mass < draws[:, :1] * mass[:, -1:]).sum(axis=1), PLACES - 1)
    return (at[every, cell] + np.floor(draws[:, 1] * size[every, cell])).astype(np.int64)
