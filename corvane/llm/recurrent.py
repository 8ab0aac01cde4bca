"""A gated recurrent language model in numpy, with a class-factored softmax.

Documents run in lanes side by side, longest lanes first, so that the lanes in use
at a step are a prefix. Each document ends with the end token, which also starts the
next one: the state is zero after it and is carried across windows otherwise, so a
document's log-probability is that of its whole text. Training goes back through one
window (truncated backpropagation) and steps by Adagrad, with one accumulator a row.

A word's probability is its class's probability times its own within the class;
classes hold words of equal total square-root frequency, so frequent words have small
ones. ``END`` is word 0 and ``UNKNOWN`` word 1.
"""

from __future__ import annotations

import heapq

import numpy as np

END, UNKNOWN = 0, 1


def classes_of(counts: np.ndarray, n_classes: int) -> np.ndarray:
    """First word of each class and the number of words; words are in order of falling count after the two special ones."""
    n = len(counts)
    mass = np.cumsum(np.sqrt(np.maximum(counts, 1.0)))
    cls = np.minimum((mass / mass[-1] * n_classes).astype(np.int64), n_classes - 1)
    cls = np.maximum.accumulate(cls)
    return np.r_[0, np.flatnonzero(np.diff(cls)) + 1, n].astype(np.int64)


def lanes_of(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents dealt to lanes, the longest to the shortest lane: (document order, lane of each), lanes by falling length."""
    order = np.argsort(-sizes, kind="stable")
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    where = np.zeros(len(sizes), np.int64)
    for d in order.tolist():
        have, lane = heapq.heappop(heap)
        where[d] = lane
        heapq.heappush(heap, (have + int(sizes[d]), lane))
    total = np.bincount(where, weights=sizes, minlength=len(heap))
    rank = np.empty(len(heap), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(heap))
    return order, rank[where]


class Layout:
    """Tokens of documents in steps: flat[begin[t] : begin[t + 1]] are the tokens of the lanes in use at step t."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        order, lane = lanes_of(sizes, lanes)
        n_lanes = int(lane.max()) + 1 if len(docs) else 0
        total = np.bincount(lane, weights=sizes, minlength=n_lanes).astype(np.int64)
        steps = int(total.max()) if n_lanes else 0
        used = n_lanes - np.searchsorted(total[::-1], np.arange(steps), "right")
        self.begin = np.concatenate([[0], np.cumsum(used)]).astype(np.int64)
        self.target = np.zeros(int(total.sum()), np.int64)
        self.at: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
        filled = np.zeros(n_lanes, np.int64)
        for d in order.tolist():
            k = lane[d]
            at = self.begin[filled[k] + np.arange(sizes[d])] + k
            filled[k] += sizes[d]
            self.target[at] = docs[d]
            self.at[d] = at
        before = np.full(len(self.target), END, np.int64)
        for t in range(1, steps):
            a = used[t]
            before[self.begin[t] : self.begin[t] + a] = self.target[self.begin[t - 1] : self.begin[t - 1] + a]
        self.input = before

    def windows(self, steps: int, tokens: int):
        """(first step, last step) of stretches of about ``tokens`` tokens, ``steps`` steps at least."""
        t, n = 0, len(self.begin) - 1
        while t < n:
            u = max(min(t + steps, n), int(np.searchsorted(self.begin, self.begin[t] + tokens, "right")) - 1)
            yield t, min(u, n)
            t = min(u, n)


class GatedModel:
    """Parameters: X (a word's input to the three gates), U (state to gates), C, c (classes), O, o (words)."""

    NAMES = ("X", "U", "C", "c", "O", "o")

    def __init__(self, params: dict[str, np.ndarray], first: np.ndarray):
        self.p, self.first = params, first
        self.cls = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.h = params["U"].shape[0]
        self.acc = {k: np.full(v.shape[0] if k in "XO" else v.shape, 1e-4, np.float32) for k, v in params.items()}

    @classmethod
    def start(cls, counts: np.ndarray, hidden: int, n_classes: int, seed: int) -> GatedModel:
        """A model that begins with the frequencies of ``counts``."""
        rng, first = np.random.default_rng(seed), classes_of(counts, n_classes)
        v = len(counts)
        whole = np.add.reduceat(counts + 0.5, first[:-1])
        draw = lambda *shape: rng.normal(0, 0.08, shape).astype(np.float32)
        params = {
            "X": draw(v, 3 * hidden), "U": draw(hidden, 3 * hidden), "C": draw(hidden, len(first) - 1), "c": np.log(whole / whole.sum()).astype(np.float32),
            "O": draw(v, hidden), "o": np.log((counts + 0.5) / np.repeat(whole, np.diff(first))).astype(np.float32),
        }
        return cls(params, first)

    def states(self, lay: Layout, t0: int, t1: int, state: np.ndarray, keep: bool):
        """States after the inputs of steps [t0, t1) and, for training, what the way back needs."""
        h, p, begin = self.h, self.p, lay.begin
        a, b = begin[t0], begin[t1]
        x = p["X"][lay.input[a:b]]
        going = (lay.input[a:b] != END).astype(np.float32)[:, None]
        out = np.empty((b - a, h), np.float32)
        kept = tuple(np.empty((b - a, w), np.float32) for w in (2 * h, h, h, h)) if keep else ()
        for t in range(t0, t1):
            i, j = begin[t] - a, begin[t + 1] - a
            state = state[: j - i] * going[i:j]
            hu = state @ p["U"]
            zr = x[i:j, : 2 * h] + hu[:, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = np.tanh(x[i:j, 2 * h :] + zr[:, h:] * hu[:, 2 * h :])
            if keep:
                kept[0][i:j], kept[1][i:j], kept[2][i:j], kept[3][i:j] = zr, n, hu[:, 2 * h :], state
            state = n + zr[:, :h] * (state - n)
            out[i:j] = state
        return out, state, going, kept

    def reach(self) -> tuple[float, np.ndarray]:
        """How far logits can lie from their biases, of classes and of each class's words: a state's elements are below 1."""
        words = np.abs(self.p["O"]).sum(axis=1)
        return float(np.abs(self.p["C"]).sum(axis=0).max()), np.maximum.reduceat(words, self.first[:-1])

    @staticmethod
    def exponents(z: np.ndarray, bias: np.ndarray, reach: float) -> None:
        """``z`` with ``bias``, less a constant, in place, so that its exponentials stay in range.

        Within a small reach the highest bias serves all rows; else each row has its own maximum.
        """
        if reach < 70:
            z += bias - bias.max()
        else:
            z += bias
            z -= z.max(axis=1, keepdims=True)

    def softmax(self, states: np.ndarray, target: np.ndarray, learn: bool, reach: tuple[float, np.ndarray] | None = None):
        """Natural log-probability of each target; with ``learn`` also the gradients of its mean negative."""
        p, n = self.p, len(target)
        far, far_words = reach or self.reach()
        cls, rows = self.cls[target], np.arange(n)
        z = states @ p["C"]
        self.exponents(z, p["c"], far)
        own = z[rows, cls]
        np.exp(z, out=z)
        total = z @ np.ones(z.shape[1], np.float32)
        logp = own - np.log(total)
        grads: dict = {}
        if learn:
            z *= (1 / (n * total))[:, None]
            z[rows, cls] -= 1 / n
            grads = {"C": states.T @ z, "c": z.sum(axis=0), "O": {}, "h": z @ p["C"].T}
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(len(self.first)))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            a, b = self.first[k], self.first[k + 1]
            if b - a == 1:
                continue
            idx = order[ends[k] : ends[k + 1]]
            s, at = states[idx], target[idx] - a
            z = s @ p["O"][a:b].T
            self.exponents(z, p["o"][a:b], far_words[k])
            r = np.arange(len(idx))
            own = z[r, at]
            np.exp(z, out=z)
            total = z @ np.ones(b - a, np.float32)
            logp[idx] += own - np.log(total)
            if learn:
                z *= (1 / (n * total))[:, None]
                z[r, at] -= 1 / n
                grads["h"][idx] += z @ p["O"][a:b]
                grads["O"][k] = (z.T @ s, z.sum(axis=0))
        return logp, grads

    def step(self, name: str, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        acc = self.acc[name]
        if name in "XO":
            acc[rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            self.p[name][rows] -= grad * (rate / np.sqrt(acc[rows]))[:, None]
        else:
            acc[rows] += grad * grad
            self.p[name][rows] -= grad * (rate / np.sqrt(acc[rows]))

    def learn(self, docs: list[np.ndarray], rate: float, lanes: int = 256, window: int = 16) -> float:
        """One pass over ``docs``; the mean log-probability on the way."""
        lay, h, p = Layout(docs, lanes), self.h, self.p
        state, gained = np.zeros((lanes, h), np.float32), 0.0
        for turn, (t0, t1) in enumerate(lay.windows(window, lanes * window // 2)):
            if turn % 16 == 0:  # a step changes a parameter by the rate at most
                far, far_words = self.reach()
                reach = far + 16 * rate * h, far_words + 16 * rate * h
            out, state, going, (zr, n, hun, prev) = self.states(lay, t0, t1, state, True)
            a, b = lay.begin[t0], lay.begin[t1]
            logp, g = self.softmax(out, lay.target[a:b], True, reach)
            gained += float(logp.sum())
            da = np.empty((b - a, 3 * h), np.float32)
            dn_hu = np.empty((b - a, h), np.float32)
            carry = np.zeros((0, h), np.float32)
            z, r = zr[:, :h], zr[:, h:]
            to_n, to_z, to_r = (1 - z) * (1 - n * n), (prev - n) * z * (1 - z), hun * r * (1 - r)
            back = p["U"].T.copy()
            for t in range(t1 - 1, t0 - 1, -1):
                i, j = lay.begin[t] - a, lay.begin[t + 1] - a
                d = g["h"][i:j]
                d[: len(carry)] += carry
                d_n = d * to_n[i:j]
                da[i:j, :h] = d * to_z[i:j]
                da[i:j, h : 2 * h] = d_n * to_r[i:j]
                dn_hu[i:j] = d_n * r[i:j]
                da[i:j, 2 * h :] = d_n
                carry = (d * z[i:j] + da[i:j, : 2 * h] @ back[: 2 * h] + dn_hu[i:j] @ back[2 * h :]) * going[i:j]
            grad_u = np.concatenate([prev.T @ da[:, : 2 * h], prev.T @ dn_hu], axis=1)
            words = lay.input[a:b]
            order = np.argsort(words, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(words[order]) != 0])
            self.step("X", np.add.reduceat(da[order], cut, axis=0), rate, words[order][cut])
            self.step("U", grad_u, rate)
            self.step("C", g["C"], rate)
            self.step("c", g["c"], rate)
            for k, (grad_o, grad_b) in g["O"].items():
                rows = slice(self.first[k], self.first[k + 1])
                self.step("O", grad_o, rate, rows)
                self.step("o", grad_b, rate, rows)
        return gained / max(len(lay.target), 1)

    def score(self, docs: list[np.ndarray], lanes: int = 1024, tokens: int = 1 << 14) -> np.ndarray:
        """Natural log-probability of each document."""
        lay = Layout(docs, lanes)
        state = np.zeros((lanes, self.h), np.float32)
        logp = np.empty(len(lay.target), np.float32)
        reach = self.reach()
        for t0, t1 in lay.windows(1, tokens):
            out, state, _, _ = self.states(lay, t0, t1, state, False)
            a, b = lay.begin[t0], lay.begin[t1]
            logp[a:b] = self.softmax(out, lay.target[a:b], False, reach)[0]
        return np.array([logp[at].sum(dtype=np.float64) for at in lay.at])

    def pack(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in self.NAMES)

    def unpacked(self, raw: bytes) -> GatedModel:
        """A model of this one's shape with other parameters."""
        at, params = 0, {}
        for k in self.NAMES:
            v = self.p[k]
            params[k] = np.frombuffer(raw, "<f4", v.size, at).reshape(v.shape).copy()
            at += 4 * v.size
        return GatedModel(params, self.first)
