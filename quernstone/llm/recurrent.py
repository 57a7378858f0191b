"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation through time, carried state.

Outputs are numbered by falling frequency; ``SIZE`` of them in a row are a class, so an output's
probability is its class' times its own within the class. The input weights of a gate are one row for
each output (the previous token). Weights start so that the model is the unigram model.
"""

from __future__ import annotations

import heapq

import numpy as np

SIZE, HIDDEN = 32, 16
F32 = np.float32


def start(frequencies: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights for outputs of these frequencies, in falling order; their number is filled up to whole classes."""
    n = -(-len(frequencies) // SIZE) * SIZE
    mass = np.full(n, 0.1)
    mass[: len(frequencies)] += frequencies
    by_class = mass.reshape(-1, SIZE)
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
    return {
        "x": small(n, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, F32),
        "c": np.zeros((HIDDEN, n // SIZE), F32), "cb": np.log(by_class.sum(1) / mass.sum()).astype(F32),
        "o": np.zeros((n // SIZE, HIDDEN, SIZE), F32), "ob": np.log(by_class / by_class.sum(1, keepdims=True)).astype(F32),
    }


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out


class Lanes:
    """Documents side by side: each lane has some documents one after the other, lanes are in falling order of length."""

    def __init__(self, docs: list[np.ndarray], first: int, most: int):
        total, longest = sum(map(len, docs)), max(map(len, docs))
        n = max(1, min(most, len(docs), 16_000_000 // longest, -(-2 * total // 64)))
        loads, parts = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
            load, i = heapq.heappop(loads)
            parts[i].append(k)
            heapq.heappush(loads, (load + len(docs[k]), i))
        parts.sort(key=lambda p: -sum(len(docs[k]) for k in p))
        self.sizes = np.array([sum(len(docs[k]) for k in p) for p in parts])
        shape = (int(self.sizes[0]), n)
        self.token, self.before, self.doc, self.fresh = np.zeros(shape, np.int32), np.full(shape, first, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool)
        for i, p in enumerate(parts):
            at = 0
            for k in p:
                d = docs[k]
                self.token[at : at + len(d), i] = d
                self.before[at + 1 : at + len(d), i] = d[:-1]
                self.doc[at : at + len(d), i] = k
                self.fresh[at, i] = True
                at += len(d)

    def windows(self, steps: int):
        """(slice of steps, lanes that are still being read, their mask of real tokens)."""
        for at in range(0, len(self.token), steps):
            stop = min(at + steps, len(self.token))
            n = int(np.searchsorted(-self.sizes, -at, "left"))
            yield slice(at, stop), n, np.arange(at, stop)[:, None] < self.sizes[None, :n]


def forward(w, before, fresh, h, keep: bool = False):
    """Hidden states after each step's previous token (steps, HIDDEN, lanes), the last state, and what backward needs.

    Lanes are the last axis, so that what is done to a gate is done to a stretch of memory.
    """
    both, (steps, lanes) = 2 * HIDDEN, before.shape
    out = np.empty((steps, HIDDEN, lanes), F32)
    u_zr, u_n = np.ascontiguousarray(w["u"][:, :both].T), np.ascontiguousarray(w["u"][:, both:].T)
    # In place: the update and reset gates, then the candidate state.
    gates = np.ascontiguousarray((w["x"] + w["b"])[before].transpose(0, 2, 1))
    start, inner = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
    renewed = fresh.any(axis=1).tolist()
    for t in range(steps):
        if renewed[t]:
            h = np.where(fresh[t], F32(0), h)
        zr, n = gates[t, :both], gates[t, both:]
        zr += u_zr @ h
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += F32(1)
        np.reciprocal(zr, out=zr)
        a = u_n @ h
        if keep:
            start[t], inner[t] = h, a
        a *= zr[HIDDEN:]
        n += a
        np.tanh(n, out=n)
        h = h - n
        h *= zr[:HIDDEN]
        h += n
        out[t] = h
    return out, h, (start, gates, inner)


def softmax(x):
    """Softmax down the columns, in place; returns it with the logs of the sums that were divided by."""
    most = x.max(axis=0)
    x -= most
    np.exp(x, out=x)
    total = x.sum(axis=0)
    x /= total
    return x, np.log(total) + most


def by_class(tokens: np.ndarray):
    """The order of tokens by class, and (class, first, end) of each class that occurs in that order."""
    classes = tokens // SIZE
    order = np.argsort(classes, kind="stable")
    sizes = np.bincount(classes)
    ends = np.cumsum(sizes)
    return order, [(int(c), int(ends[c] - sizes[c]), int(ends[c])) for c in np.flatnonzero(sizes)]


def log_probabilities(w, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural logs of the tokens' probabilities; states (HIDDEN, n), tokens (n)."""

    def chosen(z, which):
        most = z.max(axis=0)
        return z[which, np.arange(len(which))] - most - np.log(np.exp(z - most).sum(axis=0))

    out = chosen(w["c"].T @ states + w["cb"][:, None], tokens // SIZE)
    order, runs = by_class(tokens)
    states, within = states[:, order], tokens[order] % SIZE
    for c, a, b in runs:
        out[order[a:b]] += chosen(w["o"][c].T @ states[:, a:b] + w["ob"][c][:, None], within[a:b])
    return out


def score(w, docs: list[np.ndarray], first: int, lanes: int = 256, steps: int = 64) -> np.ndarray:
    """The natural log-likelihood of each whole document, its state carried from window to window."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    side = Lanes(docs, first, lanes)
    h = np.zeros((HIDDEN, len(side.sizes)), F32)
    for at, n, real in side.windows(steps):
        states, h, _ = forward(w, side.before[at, :n], side.fresh[at, :n], h[:, :n])
        logs = log_probabilities(w, states.transpose(1, 0, 2)[:, real], side.token[at, :n][real])
        total += np.bincount(side.doc[at, :n][real], logs, len(docs))
    return total


class Trainer:
    """Adam over windows of ``steps`` steps; gradients stop at a window's start, states do not.

    Windows in which few lanes are still being read are gathered until they make half a full one.
    """

    def __init__(self, w, rate: float = 0.01):
        self.w, self.rate, self.t, self.tokens = {k: v.copy() for k, v in w.items()}, rate, 0, 0
        self.gathered, self.waiting = None, 0
        self.m, self.v = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}

    def learn(self, docs: list[np.ndarray], first: int, lanes: int = 384, steps: int = 24) -> None:
        """One pass over whole documents, side by side; a document's state is carried from window to window."""
        if not docs:
            return
        side = Lanes(docs, first, min(lanes, max(4, sum(map(len, docs)) // 256)))  # little text: fewer lanes, more steps
        h = np.zeros((HIDDEN, len(side.sizes)), F32)
        enough = len(side.sizes) * steps // 2
        for at, n, real in side.windows(steps):
            h = self._window(side.token[at, :n], side.before[at, :n], side.fresh[at, :n], real, h[:, :n])
            if self.waiting >= enough:
                self._step(self._mean())
        if self.waiting:
            self._step(self._mean())

    def _window(self, token, before, fresh, real, h):
        w = self.w
        states, h, saved = forward(w, before, fresh, h, keep=True)
        y = token[real]
        order, runs = by_class(y)
        s, y = states.transpose(1, 0, 2)[:, real][:, order], y[order]
        g = {k: np.zeros_like(v) for k, v in w.items() if k in ("o", "ob")}
        dc, _ = softmax(w["c"].T @ s + w["cb"][:, None])
        dc[y // SIZE, np.arange(len(y))] -= 1
        g["c"], g["cb"], ds = s @ dc.T, dc.sum(1), w["c"] @ dc
        for c, a, b in runs:
            do, _ = softmax(w["o"][c].T @ s[:, a:b] + w["ob"][c][:, None])
            do[y[a:b] % SIZE, np.arange(b - a)] -= 1
            g["o"][c], g["ob"][c] = s[:, a:b] @ do.T, do.sum(1)
            ds[:, a:b] += w["o"][c] @ do
        unsorted = np.empty_like(ds)
        unsorted[:, order] = ds
        at_state = np.zeros((HIDDEN, *real.shape), F32)
        at_state[:, real] = unsorted
        h0, gates, inner = saved
        z, r, c = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        # What a change of the state is multiplied by on its way to the candidate state and both gates.
        to_n, to_z, to_r = (1 - z) * (1 - c * c), (h0 - c) * z * (1 - z), inner * r * (1 - r)
        dgates, da, dh, u = np.empty_like(gates), np.empty_like(gates), np.zeros_like(h), np.ascontiguousarray(w["u"])
        renewed = fresh.any(axis=1).tolist()
        for t in reversed(range(len(before))):
            dh += at_state[:, t]
            d, e = dgates[t], da[t]
            dn = np.multiply(dh, to_n[t], out=d[2 * HIDDEN :])
            np.multiply(dh, to_z[t], out=d[:HIDDEN])
            np.multiply(dn, to_r[t], out=d[HIDDEN : 2 * HIDDEN])
            e[: 2 * HIDDEN] = d[: 2 * HIDDEN]
            np.multiply(dn, r[t], out=e[2 * HIDDEN :])
            dh *= z[t]
            dh += u @ e
            if renewed[t]:
                dh[:, fresh[t]] = 0
        g["u"] = np.tensordot(h0, da, ((0, 2), (0, 2)))
        dgates = np.ascontiguousarray(dgates.transpose(0, 2, 1))
        g["b"] = dgates.reshape(-1, 3 * HIDDEN).sum(0)
        ids = before.ravel()
        order = np.argsort(ids, kind="stable")
        rows = ids[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        g["x"] = np.zeros_like(w["x"])
        g["x"][rows[starts]] = np.add.reduceat(dgates.reshape(-1, 3 * HIDDEN)[order], starts)
        if self.gathered:
            for k, x in g.items():
                self.gathered[k] += x
        else:
            self.gathered = g
        self.waiting += len(y)
        self.tokens += len(y)
        return h

    def _mean(self) -> dict[str, np.ndarray]:
        g = {k: x * F32(1 / self.waiting) for k, x in self.gathered.items()}
        self.gathered, self.waiting = None, 0
        return g

    def _step(self, g) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip, rate = min(1.0, 1.0 / (norm + 1e-6)), self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            m *= F32(0.9)
            m += F32(0.1 * clip) * x
            v *= F32(0.999)
            v += F32(0.001 * clip * clip) * x * x
            self.w[k] -= F32(rate) * m / (np.sqrt(v) + F32(1e-6))
