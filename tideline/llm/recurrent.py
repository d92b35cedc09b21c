"""A gated recurrent language model in numpy: forward and backward over many lanes of text at once.

Symbols are frequent words, classes of the other words, and the end of a text. The output is factored: first the
class, then, in a class of frequent words, the word. In a class of other words the share of each word is fixed
(its smoothed count), so it costs no parameters. Lanes hold whole texts one after the other; the state starts anew with each text and is
carried from window to window within it.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
#: Bound of what goes into an exponential: sums of such stay within single precision.
LARGE = 60.0
WINDOW = 16
#: Steps whose outputs are computed together when texts are only scored.
SCORED = 64
#: Rows of outputs worked on at a time, and numbers of a model moved at a time: both stay in the processor's cache.
TILE, MOVED = 1024, 1 << 13


class Layout:
    """Frequent words in classes of about equal mass, then one class for each kind of other words."""

    def __init__(self, counts: np.ndarray, classes: int, others: np.ndarray):
        """``counts`` of the frequent words, falling; ``others``: tokens of each kind of other words."""
        self.words, self.kinds = len(counts), len(others)
        mass = np.cumsum(counts) / max(1, counts.sum())
        cls = np.minimum((mass - mass[:1] * 0.999) * classes, classes - 1).astype(int) if len(counts) else np.empty(0, int)
        _, cls = np.unique(cls, return_inverse=True)
        self.first = int(cls.max()) + 1 if len(cls) else 0  # class of the first kind
        self.classes = self.first + self.kinds
        self.of = np.r_[cls, self.first + np.arange(self.kinds)].astype(np.int32)  # class of a symbol
        self.bounds = np.searchsorted(cls, np.arange(self.first + 1))  # words of class i
        total = np.bincount(self.of, np.r_[counts, others] + 1.0, self.classes)
        self.class_bias = np.log(total / total.sum())
        self.word_bias = np.log((counts + 1.0) / total[cls]) if len(counts) else np.empty(0)

    def start(self, seed: int = 1) -> dict[str, np.ndarray]:
        random = np.random.Generator(np.random.PCG64(seed))
        symbols, h = self.words + self.kinds, HIDDEN
        new = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
        return {
            "E": new(symbols + 1, 3 * h), "U": new(h, 3 * h), "b": np.zeros(h, np.float32),
            "C": new(h, self.classes) * 0, "c": self.class_bias.astype(np.float32),
            "W": new(self.words, h) * 0, "w": self.word_bias.astype(np.float32),
        }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, np.float32(LARGE), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(m: dict, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next state from the inputs' rows of E; also what the way back needs."""
    k = HIDDEN
    u = h @ m["U"]
    gates = _sigmoid(e[:, : 2 * k] + u[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    un = u[:, 2 * k :] + m["b"]
    n = r * un
    n += e[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n, un


def _may_pass(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether a state, whose numbers lie in -1 to 1, can be given more than ``LARGE``; ``weights`` has a row for each output."""
    return bool(len(bias)) and not (np.abs(weights).sum(1) + bias).max() < LARGE - 1


def output(m: dict, layout: Layout, states: np.ndarray, symbols: np.ndarray, grads: dict | None = None):
    """Log-probabilities of symbols after states; with ``grads`` also the gradient by the states."""
    size = len(symbols)
    cls = layout.of[symbols]
    picked, total = np.empty((2, size), states.dtype)
    ones = np.ones(max(layout.classes, layout.words), np.float32)
    cut, all_rows = _may_pass(m["C"].T, m["c"]), np.arange(min(size, TILE))
    back = None if grads is None else np.empty_like(states)
    a = np.empty((size if back is not None else min(size, TILE), layout.classes), states.dtype)
    for lo in range(0, size, TILE):
        s, c = states[lo : lo + TILE], cls[lo : lo + TILE]
        rows = all_rows[: len(s)]
        tile = a[: len(s)] if back is None else a[lo : lo + TILE]
        np.matmul(s, m["C"], out=tile)
        tile += m["c"]
        if cut:
            np.minimum(tile, np.float32(LARGE), out=tile)
        picked[lo : lo + TILE] = tile[rows, c]
        np.exp(tile, out=tile)
        total[lo : lo + TILE] = sums = tile @ ones[: layout.classes]
        if back is not None:
            tile /= sums[:, None]
            tile[rows, c] -= 1
            np.matmul(tile, m["C"].T, out=back[lo : lo + TILE])
    logp = picked - np.log(total)
    if back is not None:
        grads["C"] += states.T @ a
        grads["c"] += a.sum(0)
    # within the classes of frequent words, in the order of the classes
    order = np.argsort(cls.astype(np.uint16) if layout.classes < 1 << 16 else cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(layout.first + 1)).tolist()
    order = order[: cuts[-1]]
    s, target = states.take(order, 0), symbols[order]
    picked, total = np.zeros(len(order), states.dtype), np.ones(len(order), states.dtype)
    more = None if back is None else np.zeros_like(s)
    cut = _may_pass(m["W"], m["w"])
    bounds, places = layout.bounds.tolist(), np.arange(max(np.diff(cuts), default=0))
    for i in range(layout.first):
        lo, hi, first, last = bounds[i], bounds[i + 1], cuts[i], cuts[i + 1]
        if hi - lo < 2 or first == last:
            continue
        part, weights = s[first:last], m["W"][lo:hi]
        a = part @ weights.T
        a += m["w"][lo:hi]
        if cut:
            np.minimum(a, np.float32(LARGE), out=a)
        at = places[: last - first], target[first:last] - lo
        picked[first:last] = a[at]
        np.exp(a, out=a)
        total[first:last] = sums = a @ ones[: hi - lo]
        if back is not None:
            a /= sums[:, None]
            a[at] -= 1
            grads["W"][lo:hi] += a.T @ part
            grads["w"][lo:hi] += a.sum(0)
            np.matmul(a, weights, out=more[first:last])
    logp[order] += picked - np.log(total)
    if back is not None:
        back[order] += more
    return logp, back


def lanes_of(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal texts out to lanes of about equal length: lane of each text and its place in it."""
    lanes = [(0, i) for i in range(max(1, min(most, len(sizes))))]
    lane, place = np.empty((2, len(sizes)), np.int64)
    for t in np.argsort(-sizes, kind="stable").tolist():
        filled, i = heapq.heappop(lanes)
        lane[t], place[t] = i, filled
        heapq.heappush(lanes, (filled + int(sizes[t]), i))
    return lane, place


def arrange(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the order of time, at each time those of the longest lane first, and where each time begins (and the last one ends)."""
    lane, place = lanes_of(sizes, most)
    filled = np.bincount(lane, sizes, minlength=int(lane.max()) + 1).astype(np.int64)
    rank = np.empty(len(filled), np.int64)
    rank[np.argsort(-filled, kind="stable")] = np.arange(len(filled))
    ended = np.bincount(filled, minlength=int(filled.max()) + 1).cumsum()[:-1]  # lanes that are shorter or as long
    begins = np.r_[0, np.cumsum(len(filled) - ended)]
    time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - place, sizes)
    order = np.empty(len(time), np.int64)
    order[begins[time] + np.repeat(rank[lane], sizes)] = np.arange(len(time))
    return order, begins


def score(m: dict, layout: Layout, symbols: np.ndarray, sizes: np.ndarray, lanes: int = 512) -> np.ndarray:
    """Log-probability of every token, each text read from its first word to its end."""
    out = np.zeros(len(symbols))
    if not len(symbols):
        return out
    start = layout.words + layout.kinds
    order, begins = arrange(sizes, lanes)
    before = np.r_[start, symbols[:-1]]
    before[np.cumsum(sizes) - sizes] = start  # what the first token of a text follows
    inputs, targets, begins = before[order], symbols[order], begins.tolist()
    h = np.zeros((begins[1], HIDDEN), np.float32)
    for t0 in range(0, len(begins) - 1, SCORED):
        states = []
        ends = begins[t0 : t0 + SCORED + 1]
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            x = inputs[lo:hi]
            h = h[: hi - lo] * (x != start)[:, None]
            h = step(m, m["E"].take(x, 0), h)[0]
            states.append(h)
        window = slice(ends[0], ends[-1])
        out[order[window]] = output(m, layout, np.concatenate(states), targets[window])[0]
    return out


class Trainer:
    """Truncated backpropagation with Adam, from given weights on."""

    def __init__(self, m: dict, layout: Layout, rate: float = 0.01):
        self.m, self.layout, self.rate, self.t = {k: v.copy() for k, v in m.items()}, layout, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in m.items()}
        self.second = {k: np.zeros_like(v) for k, v in m.items()}

    def learn(self, symbols: np.ndarray, sizes: np.ndarray, lanes: int) -> None:
        """Read the tokens once, cut into lanes of equal length, with a falling rate."""
        start = self.layout.words + self.layout.kinds
        before = np.r_[start, symbols[:-1]]
        before[np.cumsum(sizes) - sizes] = start
        n = -(-len(symbols) // lanes)
        pad = np.full(-len(symbols) % n, -1)
        inputs, targets = (np.r_[v, pad].reshape(-1, n).T for v in (before, symbols))
        alive = (targets >= 0).sum(1)
        h, rate = np.zeros((targets.shape[1], HIDDEN), np.float32), self.rate
        for t0 in range(0, n, WINDOW):
            self.rate = rate * (1 - 0.9 * t0 / n)
            h = self._window(inputs, targets, alive, h, t0, min(t0 + WINDOW, n), start)
        self.rate = rate

    def _window(self, inputs, targets, alive, h, t0, t1, start):
        m, k = self.m, HIDDEN
        kept, states, wanted, sizes = [], [], [], []
        for t in range(t0, t1):
            n = alive[t]
            x = inputs[t, :n]
            fresh = (x != start)[:, None].astype(np.float32)
            before = h[:n] * fresh
            h, z, r, new, un = step(m, m["E"].take(x, 0), before)
            kept.append((x, fresh, before, z, r, new, un))
            states.append(h)
            wanted.append(targets[t, :n])
            sizes.append(n)
        grads = {name: np.zeros_like(v) for name, v in m.items()}
        _, back = output(m, self.layout, np.concatenate(states), np.concatenate(wanted), grads)
        cuts = np.cumsum([0, *sizes])
        carried = np.zeros((0, k), np.float32)
        d_all, x_all, at = np.empty((cuts[-1], 3 * k), back.dtype), np.empty(cuts[-1], np.int64), 0
        for i in range(len(kept) - 1, -1, -1):
            x, fresh, before, z, r, new, un = kept[i]
            g = back[cuts[i] : cuts[i + 1]]
            g[: len(carried)] += carried
            d = d_all[at : at + len(x)]
            x_all[at : at + len(x)] = x
            at += len(x)
            not_z = 1 - z
            d_new = g * not_z
            d_new *= 1 - new * new
            d_z = before - new
            d_z *= g
            d_z *= z
            np.multiply(d_z, not_z, out=d[:, :k])
            d_r = d_new * un
            d_r *= r
            np.multiply(d_r, 1 - r, out=d[:, k : 2 * k])
            np.multiply(d_new, r, out=d[:, 2 * k :])
            grads["U"] += before.T @ d
            grads["b"] += d[:, 2 * k :].sum(0)
            carried = d @ m["U"].T
            carried += g * z
            carried *= fresh
            d[:, 2 * k :] = d_new
        order = np.argsort(x_all.astype(np.uint16) if len(m["E"]) <= 1 << 16 else x_all, kind="stable")
        x_all = x_all[order]
        begins = np.flatnonzero(np.r_[True, x_all[1:] != x_all[:-1]])
        grads["E"][x_all[begins]] = np.add.reduceat(d_all.take(order, 0), begins, axis=0)
        self._move(grads, cuts[-1])
        return h

    def _move(self, grads: dict, n: int) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for name, g in grads.items():
            parts = [v.reshape(-1) for v in (g, self.first[name], self.second[name], self.m[name])]
            for lo in range(0, g.size, MOVED):
                g, first, second, weights = (v[lo : lo + MOVED] for v in parts)
                g /= float(n)  # a numpy integer would make it double precision
                move = g - first
                move *= 0.1
                first += move
                np.multiply(g, g, out=move)
                move -= second
                move *= 0.01
                second += move
                np.sqrt(second, out=move)
                move += 1e-7
                weights -= rate * first / move
