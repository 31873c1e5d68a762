"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried across windows.

The output is factored: first the class of the next token, then the token within its class. Classes of frequent words have a
softmax over their words that depends on the state; the other classes (rare words by spelling and count, and the end of a text)
leave the choice within the class to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

F32 = np.float32
#: So many tokens' scores are held at once, which a core's own memory holds.
TOKENS = 2048
#: Scores within this of zero are raised to powers as they are: no sum of such powers leaves what a float holds.
SAFE = 60.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_of(s: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The logarithm of one column's probability for each token; s: scores, columns x tokens, so that sums run over whole rows of memory."""
    own = s[column, np.arange(s.shape[1])]
    top = s.max(axis=0)
    s -= top
    np.exp(s, out=s)
    return own - top - np.log(s.sum(axis=0))


def _joined(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights and bias as one matrix, columns x (features + 1), for states with a last feature of 1; the bias counts from its largest. And whether no state, whose features are between -1 and 1, has a score beyond SAFE."""
    w = np.vstack([weights, bias - bias.max()]).T
    return np.ascontiguousarray(w), float(np.abs(w).sum(axis=1).max()) < SAFE


def _powers(s: np.ndarray, safe: bool) -> np.ndarray:
    """The scores' powers, in place, each token's by a factor of its own; s: columns x tokens."""
    return np.exp(s, out=s) if safe else _softmax(s)


def _log_chosen(s: np.ndarray, column: np.ndarray, safe: bool) -> np.ndarray:
    """As _log_of, where safe scores go without their largest."""
    if not safe:
        return _log_of(s, column)
    own = s[column, np.arange(s.shape[1])]
    return own - np.log(np.exp(s, out=s).sum(axis=0))


def _softmax(s: np.ndarray) -> np.ndarray:
    """In place, for each token; s: columns x tokens."""
    s -= s.max(axis=0)
    np.exp(s, out=s)
    s /= s.sum(axis=0)
    return s


@dataclass
class Model:
    """inputs: tokens that can be read; the last one stands before a text. members[c]: columns of the word softmax of class c."""

    p: dict[str, np.ndarray]
    members: list[tuple[int, int]]

    @property
    def hidden(self) -> int:
        return self.p["U"].shape[0]

    @classmethod
    def new(cls, inputs: int, class_counts: np.ndarray, word_counts: np.ndarray, members: list[tuple[int, int]], hidden: int, seed: int) -> Model:
        """Output biases start at the logarithms of the counts: an untrained model is the unigram model."""
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, 0.1, s).astype(F32)
        p = {"X": init(inputs + 1, 3 * hidden), "U": init(hidden, 3 * hidden), "bg": np.zeros(3 * hidden, F32)}
        p |= {"A": init(hidden, len(class_counts)) * F32(0.1), "a": np.log(class_counts + 0.5).astype(F32), "B": init(hidden, max(1, len(word_counts))) * F32(0.1), "b": np.log(np.append(word_counts, [1] * (not len(word_counts))) + 0.5).astype(F32)}
        return cls(p, members)

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple:
        n = self.hidden
        gx = self.p["X"][x] + self.p["bg"]
        gh = h @ self.p["U"]
        zr = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
        return h + z * (c - h), z, r, c, gh[:, 2 * n :]

    def log_probs(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of the class, and of the word within it where word >= 0."""
        return self.log_probs_of(np.hstack([h, np.ones((len(h), 1), h.dtype)]), cls, word, self.joined())

    def joined(self) -> tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]]:
        return _joined(self.p["A"], self.p["a"]), _joined(self.p["B"], self.p["b"])

    def log_probs_of(self, h: np.ndarray, cls: np.ndarray, word: np.ndarray, joined: tuple) -> np.ndarray:
        """As log_probs, of states with a last feature of 1."""
        (wa, safe_a), (wb, safe_b) = joined
        out = np.empty(len(h))
        for i in range(0, len(h), TOKENS):
            out[i : i + TOKENS] = _log_chosen(wa @ h[i : i + TOKENS].T, cls[i : i + TOKENS], safe_a)
        by, parts = self.framed(cls, word)
        own, at, inside = h[by], word[by], np.empty(len(by))
        for a, z, lo, hi in parts:
            for i in range(a, z, TOKENS):
                j = min(z, i + TOKENS)
                inside[i:j] = _log_chosen(wb[lo:hi] @ own[i:j].T, at[i:j] - lo, safe_b)
        out[by] += inside
        return out

    def framed(self, cls: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The tokens that have a word, by class, and for each class: where it begins and ends among them, and its columns of the word softmax."""
        by = np.flatnonzero(word >= 0)
        by = by[np.argsort(cls[by].astype(np.uint16), kind="stable")]  # numbers of two bytes are sorted in linear time
        c = cls[by]
        cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True]) if len(by) else np.zeros(1, np.int64)
        return by, [(a, z, *self.members[int(c[a])]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Adam:
    """Moments of the gradients, and steps with a bounded norm."""

    def __init__(self, model: Model):
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
        self.t = 0

    def apply(self, model: Model, grad: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grad.values()))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        first, second = 1 - 0.9**self.t, 1 - 0.99**self.t
        for k, g in grad.items():  # in the gradient's own memory
            m, v = self.moments[k]
            g *= F32(scale * 0.1)
            m *= F32(0.9)
            m += g
            g *= g
            v *= F32(0.99)
            v += g  # a hundredth of the square
            np.sqrt(v, out=g)
            g *= F32(1 / second**0.5)
            g += F32(1e-6)
            np.divide(m, g, out=g)
            g *= F32(rate / first)
            model.p[k] -= g


def train(model: Model, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 6, streams: int = 48, window: int = 20, rate: float = 0.01, seed: int = 3) -> None:
    """docs: (input, class, word) of the tokens of each text, the end included. Texts are dealt to streams, which are read side by side; the state is carried from window to window and cleared where a text begins."""
    r = np.random.default_rng(seed)
    start = len(model.p["X"]) - 1
    adam = Adam(model)
    length = sum(len(d[0]) for d in docs)
    streams = max(1, min(streams, length // (2 * window) or 1))
    total = epochs * max(1, -(-(length // streams) // window))
    for _ in range(epochs):
        order = r.permutation(len(docs))
        seq = [np.concatenate([np.concatenate([[start], docs[i][0][:-1]]) for i in order]), *(np.concatenate([docs[i][k] for i in order]) for k in (1, 2))]
        fresh = np.concatenate([np.arange(len(docs[i][0])) == 0 for i in order])
        n = len(fresh) // streams
        x, cls, word, new = (s[: n * streams].reshape(streams, n) for s in (*seq, fresh))
        h = np.zeros((streams, model.hidden), F32)
        for a in range(0, n, window):
            h, grad = _window(model, h, x[:, a : a + window], cls[:, a : a + window], word[:, a : a + window], new[:, a : a + window])
            adam.apply(model, grad, rate * (1 - 0.9 * (adam.t + 1) / total))


def read_once(model: Model, adam: Adam, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, first: np.ndarray, rate: float, streams: int = 256, window: int = 20) -> None:
    """One pass over every token of the texts in their order; first: where each begins (one more than texts). The streams are filled up from the beginning, so that none is left out."""
    total = len(inputs)
    if not total:
        return
    fresh = np.zeros(total, bool)
    fresh[first[:-1]] = True
    before = np.where(fresh, len(model.p["X"]) - 1, np.r_[0, inputs[:-1]])
    streams = max(1, min(streams, total // (2 * window)))
    n = -(-total // streams)
    x, c, w, new = (np.asfortranarray(np.resize(s, n * streams).reshape(streams, n)) for s in (before, cls, word, fresh))  # a window is one block of memory
    h = np.zeros((streams, model.hidden), F32)
    for a in range(0, n, window):
        h, grad = _window(model, h, x[:, a : a + window], c[:, a : a + window], w[:, a : a + window], new[:, a : a + window])
        adam.apply(model, grad, rate)


def _by_input(x: np.ndarray, values: np.ndarray, inputs: int) -> np.ndarray:
    """The sums of values by input, inputs x features; x: of each token; values: steps x features x streams."""
    out = np.empty((values.shape[1], inputs), values.dtype)
    for k in range(len(out)):
        out[k] = np.bincount(x, values[:, k].ravel(), inputs)
    return np.ascontiguousarray(out.T)


def _forward(model: Model, h: np.ndarray, x: np.ndarray, ends: list[np.ndarray] | None = None, read: tuple[np.ndarray, np.ndarray] | None = None, keep: bool = True) -> tuple[np.ndarray, ...]:
    """States of a window: before, after, gates and the inner part of the candidate, each steps x features x streams, so that a gate of all streams is one block of memory; after has a last feature of 1. x: steps x streams; ends: streams that begin anew at each step; read: of _read, where it is at hand; keep: whether all steps of the others than the state after are wanted, or the last alone."""
    n = model.hidden
    steps, streams = x.shape
    read, u = _read(model) if read is None else read
    held = steps if keep else 1
    gates, gh = np.empty((held, 3 * n, streams), h.dtype), np.empty((3 * n, streams), h.dtype)
    (before, inner), after = (np.empty((held, n, streams), h.dtype) for _ in range(2)), np.empty((steps, n + 1, streams), h.dtype)
    after[:, n] = 1
    h = h.T
    with np.errstate(over="ignore"):  # a gate whose power is infinite is shut
        for t in range(steps):
            b, g = before[t % held], gates[t % held]
            np.take(read, x[t], axis=1, out=g, mode="clip")  # no input is beyond it; without a mode the result is copied
            b[:] = h
            if ends is not None and len(ends[t]):
                b[:, ends[t]] = 0
            np.matmul(u, b, out=gh)
            zr, c = g[: 2 * n], g[2 * n :]
            zr += gh[: 2 * n]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            if keep:
                inner[t] = gh[2 * n :]
            h = after[t, :n]
            np.multiply(zr[n:], gh[2 * n :], out=h)
            c += h
            c *= -2  # the tangent by a power, which costs less
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            np.subtract(c, b, out=h)
            h *= zr[:n]
            h += b
    return before, after, gates, inner


def _read(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What each input adds to the gates, features x inputs, and what the state does; negative for the two gates that are sigmoids."""
    x, n = model.p["X"], 2 * model.hidden
    read, u = np.add(x.T, model.p["bg"][:, None], out=np.empty(x.shape[::-1], x.dtype)), np.array(model.p["U"].T, order="C")
    for a in (read, u):
        np.negative(a[:n], out=a[:n])
    return read, u


def _rows(a: np.ndarray) -> np.ndarray:
    """steps x features x streams -> (steps * streams) x features."""
    return np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(-1, a.shape[1])


def _window(model: Model, h: np.ndarray, x: np.ndarray, cls: np.ndarray, word: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """One window forwards and backwards; the mean loss's gradient, which stops at the window's edge."""
    p, n, (streams, steps) = model.p, model.hidden, x.shape
    ends = [np.flatnonzero(new[:, t]) for t in range(steps)]
    before, after, gates, inner = _forward(model, h, x.T, ends)
    c_flat, w_flat = cls.T.ravel(), word.T.ravel()
    count = h.dtype.type(len(c_flat))
    (wa, safe_a), (wb, safe_b) = model.joined()
    # The powers d are not made probabilities: a token's share of the sums is in its states instead, which have fewer rows.
    total, out, d = np.zeros_like(wa), np.empty((steps, n, streams), h.dtype), np.empty((len(wa), streams), h.dtype)
    chosen = cls.T * streams + np.arange(streams)
    for t in range(steps):
        _powers(np.matmul(wa, after[t], out=d), safe_a)
        part = d.sum(axis=0)
        d.ravel()[chosen[t]] -= part
        part *= count
        np.reciprocal(part, out=part)
        total += d @ (after[t] * part).T
        np.matmul(p["A"], d, out=out[t])
        out[t] *= part
    grad = {"A": total[:, :n].T, "a": total[:, n]}
    by, parts = model.framed(c_flat, w_flat)
    own, back, total, share = _rows(after)[by], np.empty((len(by), n), h.dtype), np.zeros_like(wb), np.empty(len(by), h.dtype)
    # The classes' scores stand end to end, each columns x tokens.
    begin, long, low, wide = (np.array(k, np.int64) for k in ([a for a, *_ in parts], [z - a for a, z, _, _ in parts], [lo for *_, lo, _ in parts], [hi - lo for *_, lo, hi in parts]))
    first = np.r_[0, np.cumsum(wide * long)]
    of = np.repeat(np.arange(len(parts)), long)
    e = np.empty(first[-1], h.dtype)
    blocks = [e[i:j].reshape(hi - lo, z - a) for (a, z, lo, hi), i, j in zip(parts, first[:-1].tolist(), first[1:].tolist())]
    for (a, z, lo, hi), block in zip(parts, blocks):
        np.matmul(wb[lo:hi], own[a:z].T, out=block)
    for block in [e] if safe_b else blocks:
        _powers(block, safe_b)
    for (a, z, lo, hi), block in zip(parts, blocks):
        np.add.reduce(block, axis=0, out=share[a:z])
    e[(first[:-1] - begin - low * long)[of] + w_flat[by] * long[of] + np.arange(len(by))] -= share
    share *= count
    np.reciprocal(share, out=share)
    own *= share[:, None]
    for (a, z, lo, hi), block in zip(parts, blocks):
        np.matmul(block.T, wb[lo:hi, :n], out=back[a:z])
        np.matmul(block, own[a:z], out=total[lo:hi])
    grad |= {"B": total[:, :n].T, "b": total[:, n]}
    back *= share[:, None]
    dh = np.zeros((steps * streams, n), h.dtype)
    dh[by] = back
    out += dh.reshape(steps, streams, n).transpose(0, 2, 1)
    # A step at a time, in a core's own memory: the gates give way to their gradients.
    grad["U"] = np.zeros_like(p["U"])
    carry, keep, of_c, of_state = (np.zeros((n, streams), h.dtype) for _ in range(4))
    for t in range(steps - 1, -1, -1):
        dt, g, b = out[t], gates[t], before[t]
        z, r, c = g[:n], g[n : 2 * n], g[2 * n :]
        dt += carry
        np.multiply(c, c, out=of_c)
        np.subtract(1, of_c, out=of_c)
        of_c *= z
        of_c *= dt
        np.multiply(of_c, r, out=of_state)
        np.subtract(1, z, out=keep)
        keep *= dt
        c -= b
        z *= c
        z *= keep
        np.subtract(1, r, out=r)
        r *= inner[t]
        r *= of_state
        c[:] = of_state
        np.matmul(p["U"], g, out=carry)
        carry += keep
        if len(ends[t]):
            carry[:, ends[t]] = 0
        grad["U"] += b @ g.T
        c[:] = of_c  # the state's part of the candidate comes through the reset gate, the input's does not
    grad["X"] = _by_input(x.T.ravel(), gates, len(p["X"]))
    grad["bg"] = grad["X"].sum(axis=0)  # every token has an input
    return after[-1, :n].T, {k: np.ascontiguousarray(grad[k]) for k in p}


def score(model: Model, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, first: np.ndarray, window: int = 32, abreast: int = 1024) -> np.ndarray:
    """The summed natural log-probability of each text; first: where each begins (one more than texts). Whole texts, read side by side from the longest; a text drops out after the window in which it ends."""
    lengths = np.diff(first)
    out = np.zeros(len(lengths))
    order = np.argsort(-lengths, kind="stable")
    start, read, joined = len(model.p["X"]) - 1, _read(model), model.joined()
    for g in range(0, len(order), abreast):
        own = order[g : g + abreast]
        size = lengths[own]
        h = np.zeros((len(own), model.hidden), F32)
        for t0 in range(0, int(size[0]), window):
            n = int(np.searchsorted(-size, -t0, side="left"))
            steps = min(window, int(size[0]) - t0)
            at = first[own[:n]] + t0 + np.arange(steps)[:, None]
            valid = t0 + np.arange(steps)[:, None] < size[:n]
            at = np.where(valid, at, first[own[:n]])
            x = inputs[np.maximum(at - 1, 0)]
            if not t0:
                x[0] = start
            _, after, _, _ = _forward(model, h[:n], x, read=read, keep=False)
            h = after[-1, :-1].T
            where = at[valid]
            each = np.zeros(at.shape)
            each[valid] = model.log_probs_of(_rows(after)[valid.ravel()], cls[where], word[where], joined)
            out[own[:n]] += each.sum(axis=0)
    return out
