"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Words are of two kinds. *Frequent* words (the commonest of the training documents,
and the end mark) have input rows of their own and lie in classes of about equal mass;
in such a class a softmax over the state chooses the word. All other words fall
into classes by their last byte and length; in such a class words have the
probabilities of the whole corpus's counts, (c + 0.5) / (N + 0.5 (V + 1)) over the
class, so that every word, also one never met, has its share and all sum to one.
The state chooses the class: P(word) = P(class | state) P(word | class, state).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import textops as tx

UNITS = 16
FREQUENT = 1000
CLASSES = 32
#: Classes of other words: groups of last bytes by groups of lengths.
ENDS, SIZES = 8, 4
RARE = ENDS * SIZES
WINDOW = 32
STREAMS = 128
EPOCHS = 4
LN10 = np.log(10.0)

_END_OF = np.full(256, 2, np.uint8)
_END_OF[ord(".")], _END_OF[ord(",")] = 0, 1
_END_OF[128:] = 3
_END_OF[97:123] = 4 + np.arange(26) % 4


def rare_class(last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Class of a word by its last byte (lower-cased) and its bytes."""
    return (_END_OF[last] * SIZES + np.searchsorted([5, 8, 11], size, "right")).astype(np.uint8)


class Vocabulary(NamedTuple):
    """Frequent words by hash (ascending), and the class of each; the end mark is id ``len(hashes)``."""

    hashes: np.ndarray
    classes: np.ndarray  # of ids, the end mark's last

    @property
    def end(self) -> int:
        return len(self.hashes)

    def ids(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Ids of words: frequent ones' places, others' classes after the end mark."""
        at = np.searchsorted(self.hashes, h)
        out = self.end + 1 + rare.astype(np.int32)
        if len(self.hashes):
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
            out[hit] = at[hit]
        return out


def vocabulary(h: np.ndarray, documents: int, most: int = FREQUENT, classes: int = CLASSES) -> Vocabulary:
    """From the hashes of all words of the documents."""
    return vocabulary_of(*np.unique(h, return_counts=True), documents, most, classes)


def vocabulary_of(value: np.ndarray, count: np.ndarray, documents: int, most: int = FREQUENT, classes: int = CLASSES) -> Vocabulary:
    """From distinct words (hashes, ascending) and their counts, the ``most`` commonest at least."""
    top = np.sort(np.lexsort((value, -count))[:most])
    value, count = value[top], np.append(count[top], max(documents, 1))
    order = np.argsort(-count, kind="stable")
    mass = np.cumsum(count[order]) - count[order] / 2
    of = np.empty(len(count), np.int64)
    of[order] = np.minimum((mass / count.sum() * classes).astype(np.int64), classes - 1)
    return Vocabulary(value, of)


def _high(w: np.ndarray, b: np.ndarray, most: float) -> bool:
    """Whether w h + b may be too large or small for exp in single precision, where no component of h is over ``most``."""
    return float((np.abs(w).sum(1) * most + np.abs(b)).max(initial=0.0)) > 60


class Model:
    """Parameters by name; ids are the vocabulary's, the start mark last."""

    def __init__(self, v: Vocabulary, units: int = UNITS, seed: int = 3):
        self.v, self.units = v, units
        rng, n = np.random.default_rng(seed), v.end + 1
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "x": f(n + RARE + 1, 3 * units),
            "u": f(units, 3 * units),
            "cw": f(units, CLASSES + RARE),
            "cb": np.zeros(CLASSES + RARE, np.float32),
            "ww": f(n, units),
            "wb": np.zeros(n, np.float32),
        }
        self.start = n + RARE
        self.by_class()

    def by_class(self) -> None:
        self.members = [np.flatnonzero(self.v.classes == c) for c in range(CLASSES)]
        self.place = np.zeros(self.v.end + 1, np.int64)
        self.rank = np.argsort(self.v.classes, kind="stable")  # words by class
        # classes without words take no probability
        self.closed = np.array([0 if len(m) else -1e9 for m in self.members] + [0] * RARE, np.float32)
        for m in self.members:
            self.place[m] = np.arange(len(m))

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        out = ids - (self.v.end + 1) + CLASSES
        own = ids <= self.v.end
        out[own] = self.v.classes[ids[own]]
        return out

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states from rows of inputs and states, and what gradients need: gates z and r, candidates, and their part from the state."""
        return tuple(a.T for a in self._step(x.T, h.T))

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        # units in rows: all that is taken apart or passed over is contiguous
        k = self.units
        a = self.p["u"].T @ h
        zr = x[: 2 * k] + a[: 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, c = zr[:k], zr[k:], a[2 * k :]
        n = r * c
        n += x[2 * k :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, c

    def output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of ``ids`` (of others' classes: of the class alone) from rows of states; with ``grads``, gradients of their sum too."""
        out, dh = self._output(h.T, ids, grads)
        return out, None if dh is None else dh.T

    def _output(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        # columns by class; softmaxes lie in columns, which numpy reduces faster
        p, n = self.p, len(ids)
        c = self.class_of(ids)
        order = np.argsort(c.astype(np.int8), kind="stable")
        c, ids, h = c[order], ids[order], np.take(h, order, 1)
        row = np.arange(n)
        # no logit is over this, so most often none needs to be taken off before exp
        most = float(np.abs(h).max(initial=0.0))
        e = p["cw"].T @ h
        e += (p["cb"] + self.closed)[:, None]
        if _high(p["cw"].T, p["cb"], most):
            e -= e.max(0)
        got = e[c, row]
        np.exp(e, out=e)
        s = e.sum(0)
        got -= np.log(s)
        dh = None
        if grads is not None:
            e /= -s
            e[c, row] += 1
            grads["cw"] += h @ e.T
            grads["cb"] += e.sum(1)
            dh = p["cw"] @ e
            gw, gb = np.zeros_like(p["ww"]), np.zeros_like(p["wb"])
        ww, wb, place = p["ww"][self.rank], p["wb"][self.rank], self.place[np.minimum(ids, self.v.end)]
        at, end, high = np.searchsorted(c, np.arange(CLASSES + 1)).tolist(), 0, _high(ww, wb, most)
        for k in range(CLASSES):
            lo, hi, size = at[k], at[k + 1], len(self.members[k])
            first, end = end, end + size
            if lo == hi or size < 2:
                continue
            hk, wk, col = h[:, lo:hi], ww[first:end], place[lo:hi]
            e = wk @ hk
            e += wb[first:end, None]
            if high:
                e -= e.max(0)
            row = np.arange(hi - lo)
            got[lo:hi] += e[col, row]
            np.exp(e, out=e)
            s = e.sum(0)
            got[lo:hi] -= np.log(s)
            if grads is not None:
                e /= -s
                e[col, row] += 1
                gw[first:end] = e @ hk.T
                gb[first:end] = e.sum(1)
                dh[:, lo:hi] += wk.T @ e
        out = np.empty_like(got)
        out[order] = got
        if grads is not None:
            grads["ww"][self.rank] += gw
            grads["wb"][self.rank] += gb
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            dh = np.take(dh, place, 1)
        return out, dh

    def fit(self, docs: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, streams: int = STREAMS, window: int = WINDOW, moments: list | None = None) -> list[float]:
        """Truncated backpropagation over windows of streams of documents; the state passes from window to window and is cleared where a document begins. Mean log10 by epoch.

        The rate falls to the end, unless ``moments`` (empty at first, kept from call to call) are given: then it stays.
        """
        k, p, said = self.units, self.p, []
        m1, m2, count = moments or (*({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2)), 0)
        total_steps = None
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(docs))
            if not len(order):
                break
            ids = np.concatenate([docs[i] for i in order])
            first = np.zeros(len(ids), bool)
            first[np.cumsum([0] + [len(docs[i]) for i in order])[:-1]] = True
            before = np.concatenate([[self.start], ids[:-1]])
            before[first] = self.start
            width = min(streams, len(ids))
            steps = len(ids) // width
            ids, before, first = (a[: width * steps].reshape(width, steps).T for a in (ids, before, first))
            h = np.zeros((k, width), np.float32)
            total_steps = total_steps or epochs * -(-steps // window)
            sums = 0.0
            for a in range(0, steps, window):
                size = min(window, steps - a)
                x = np.ascontiguousarray(p["x"][before[a : a + size]].transpose(0, 2, 1))
                fresh = (~first[a : a + size]).astype(np.float32)
                h0, z, r, n, c, hs = (np.empty((size, k, width), np.float32) for _ in range(6))
                for t in range(size):
                    np.multiply(h, fresh[t], out=h0[t])
                    h, z[t], r[t], n[t], c[t] = self._step(x[t], h0[t])
                    hs[t] = h
                g = {n: np.zeros_like(v) for n, v in p.items()}
                flat = lambda s: s.transpose(1, 0, 2).reshape(s.shape[1], -1)
                out, dhs = self._output(flat(hs), ids[a : a + size].reshape(-1), g)
                sums += float(out.sum())
                dhs = np.ascontiguousarray(dhs.reshape(k, size, width).transpose(1, 0, 2))
                # what a state's gradient is multiplied with, for all steps at once
                to_n, to_z, to_r = (1 - z) * (1 - n * n), (h0 - n) * z * (1 - z), c * r * (1 - r)
                back, da, dn = np.zeros((k, width), np.float32), np.empty_like(x), np.empty_like(n)
                for t in range(size - 1, -1, -1):
                    d, to = dhs[t], da[t]
                    d += back
                    np.multiply(d, to_n[t], out=dn[t])
                    np.multiply(d, to_z[t], out=to[:k])
                    np.multiply(dn[t], to_r[t], out=to[k : 2 * k])
                    np.multiply(dn[t], r[t], out=to[2 * k :])
                    back = p["u"] @ to
                    d *= z[t]
                    back += d
                    back *= fresh[t]
                g["u"] += flat(h0) @ flat(da).T
                da[:, 2 * k :] = dn
                dx = da.transpose(0, 2, 1).reshape(-1, 3 * k)
                where = before[a : a + size].reshape(-1)
                order = np.argsort(where, kind="stable")
                where = where[order]
                lead = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                g["x"][where[lead]] = np.add.reduceat(dx[order], lead)
                count += 1
                speed = rate if moments is not None else rate * max(0.05, 1 - count / total_steps)
                scale = 1.0 / (size * width)
                up, down = speed / (1 - 0.9**count), 1 / np.sqrt(1 - 0.999**count)
                for name, v in g.items():
                    a1, a2 = m1[name], m2[name]
                    v *= scale
                    a1 *= 0.9
                    a1 += 0.1 * v
                    v *= v
                    v *= 0.001
                    a2 *= 0.999
                    a2 += v
                    np.sqrt(a2, out=v)
                    v *= down
                    v += 1e-8
                    np.divide(a1, v, out=v)
                    v *= up
                    p[name] += v
            said.append(sums / (width * steps) / LN10)
        if moments is not None:
            moments[:] = m1, m2, count
        return said

    def score(self, ids: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Log10 probability of every document, ``ids[first[i]:first[i+1]]``, in windows; the state passes on to a document's end."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        begin, size = first[:-1][order], size[order]
        total = np.zeros(len(size))
        h = np.zeros((self.units, len(size)), np.float32)
        longest = int(size[0]) if len(size) else 0
        table = self.p["x"]
        last = np.full(len(size), self.start, np.int64)
        for a in range(0, longest, window):
            b = min(a + window, longest)
            run = np.searchsorted(-size, -np.arange(a, b), "left")
            hs, wanted, who = [], [], []
            for t, m in zip(range(a, b), run.tolist()):
                now = ids[begin[:m] + t]
                new = self._step(np.ascontiguousarray(table[last[:m]].T), h[:, :m])[0]
                h[:, :m] = new
                last[:m] = now
                hs.append(new)
                wanted.append(now)
                who.append(m)
            hs, wanted = np.concatenate(hs, 1), np.concatenate(wanted)
            out = np.empty(len(wanted))
            for c in range(0, len(wanted), 1 << 13):
                out[c : c + (1 << 13)] = self._output(hs[:, c : c + (1 << 13)], wanted[c : c + (1 << 13)])[0]
            at = 0
            for m in who:
                total[:m] += out[at : at + m]
                at += m
        back = np.empty(len(size))
        back[order] = total
        return back / LN10


def words_of(t: tx.Texts) -> tuple[tx.Words, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, their hashes, and the classes they have as rare ones."""
    w = tx.words(t, tx.SOLID)
    low = tx.LOWER[t.data]
    rare = rare_class(low[w.end - 1], w.end - w.start) if len(w.start) else np.zeros(0, np.uint8)
    return w, tx.hashes(low, w.start, w.end), rare


def with_ends(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end mark after each document."""
    return np.insert(ids, first[1:], end), first + np.arange(len(first))
