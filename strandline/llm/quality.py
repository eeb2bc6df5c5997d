"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features are numbers read off its bytes (shares of symbols, digits,
capitals and bars, word lengths, repeats in the line, repeats of its neighbours
and of other lines of the document, its length), together with those of the line
before and the line after. The score of a document is the mean of its lines' marginal
probabilities of being good (forward-backward), weighted by line length, passed
through a logistic curve that is fitted on the same documents.

Only documents have labels, so those of lines are latent: a document's label says
which kind of lines prevails, by ``PREVAIL`` of its length at least. Fitting goes in
turns (posterior regularisation, Ganchev et al., 2010). First each chain's labels get
the distribution nearest to the field's under which the document's label holds: the
field with its good scores tilted by as much of a line's share of the length as that
takes, so forward-backward gives it too. Then weights climb towards its expectations.
The first turn starts from each line's own features, without neighbours and
transitions, so good lines in bad documents (and the other way) come out as what they are.

The field is fitted in one task on a sample of at most ``SAMPLE`` labelled documents,
none of them held out, with whole chains. Scores cover every row and its whole text, of
any length; lines of all documents of a batch step together.

Defined results: a null text is empty, and an empty text one empty line; without
labelled rows of both kinds every score is 0.5 and no line is labelled; repeated rows
have equal scores; a null id isn't held out as its crc32 is that of empty text; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import held_out, table
from .labelled import training_rows

SAMPLE = 6000
ROUNDS = 200
#: Turns after the first, and the rounds of each.
TURNS = 6
TURN_ROUNDS = 30
#: The least share of a document's length that has its label.
PREVAIL = 0.6
CUT = 0.7

_UPPER, _DIGIT, _SPACE, _MARK, _BAR, _BANG, _STOP, _WIDE = (np.zeros(256, np.uint8) for _ in range(8))
_UPPER[65:91] = _DIGIT[48:58] = _WIDE[128:] = 1
_SPACE[[32, 9, 11, 12, 13]] = 1
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?|"]] = 1
_BAR[ord("|")] = _BANG[ord("!")] = _BANG[ord("?")] = 1
_STOP[[ord(c) for c in ".,;:"]] = 1
_KINDS = (_UPPER, _DIGIT, _SPACE, _MARK, _BAR, _BANG, _STOP, _WIDE)

_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[10] = False


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner, its number of distinct hashes and the count of its commonest."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    # owners ascend: a sort of (owner, top bits) keeps each one's hashes together
    bits = max(1, int(n).bit_length())
    key = np.sort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    who = (key[lead] >> np.uint64(64 - bits)).astype(np.int64)
    runs = np.diff(np.append(lead, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, who, runs)
    return np.bincount(who, minlength=n).astype(float), most


def lines(t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its bytes, and the first line of each text (n+1)."""
    # every text ends a line, so one line end is put after each
    n_text = len(t.offsets) - 1
    size = np.diff(t.offsets) + 1
    data = np.full(int(size.sum()), 10, np.uint8)
    data[np.arange(len(t.data)) + np.repeat(np.arange(n_text), np.diff(t.offsets))] = t.data
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate([[0], stop[:-1] + 1])
    text_begin = np.concatenate([[0], np.cumsum(size)])
    first = np.searchsorted(begin, text_begin)
    n = len(stop)
    length = (stop - begin).astype(float)
    counts = []
    for kind in _KINDS:
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=c[1:])
        counts.append((c[stop] - c[begin]).astype(float))
    per = 1 / np.maximum(length, 1)
    joined = tx.Texts(data, text_begin)
    w = tx.words(joined, tx.SOLID)
    at = np.searchsorted(stop, w.start)
    n_words = np.bincount(at, minlength=n).astype(float)
    h = tx.hashes(tx.LOWER[data], w.start, w.end)
    kinds_, most = _distinct(at, h, n)
    caps = np.bincount(at, minlength=n, weights=tx.LOWER[data[w.start]] != data[w.start]) if len(at) else np.zeros(n)
    line_h = tx.hashes(data, begin, stop)
    owner = np.repeat(np.arange(n_text), np.diff(first))
    bits = max(1, int(n_text).bit_length())
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (line_h >> np.uint64(bits))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[back] > 1
    same = np.zeros(n, bool)
    if n > 1:
        same[1:] = (line_h[1:] == line_h[:-1]) & (owner[1:] == owner[:-1])
    words_ = np.maximum(n_words, 1)
    letters = np.maximum(length - counts[2], 1)
    f = np.column_stack(
        [
            np.minimum(counts[3] * per * 10, 3),
            np.minimum(counts[4] * per * 20, 3),
            np.minimum(counts[5] * per * 20, 3),
            np.minimum(counts[1] * per * 5, 3),
            np.minimum(counts[0] / letters * 3, 3),
            np.minimum(counts[6] / words_ * 2, 3),
            counts[7] * per * 2,
            np.minimum(caps / words_ * 2, 2),
            np.minimum(letters / words_ / 5, 4),
            1 - kinds_ / words_,
            np.where(n_words > 3, most / words_, 0),
            again,
            same,
            np.log1p(n_words) / 3,
            n_words <= 3,
            length == 0,
        ]
    )
    return f, length, first


def with_neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after in its text (zeros at its ends), marks of ends, and 1."""
    n, k = f.shape
    before, after = np.zeros_like(f), np.zeros_like(f)
    starts, ends = np.zeros(n, bool), np.zeros(n, bool)
    starts[first[:-1]] = ends[first[1:] - 1] = True
    before[1:] = f[:-1]
    after[:-1] = f[1:]
    before[starts] = after[ends] = 0
    return np.column_stack([f, before, after, starts, ends, np.ones(n)])


class Chains:
    """Chains of lines laid end to end, stepped together: the longest first, so those still running are a prefix."""

    def __init__(self, first: np.ndarray):
        size = np.diff(first)
        self.order = np.argsort(-size, kind="stable")
        self.begin, self.size = first[:-1][self.order], size[self.order]
        self.longest = int(self.size[0]) if len(size) else 0
        self.running = np.searchsorted(-self.size, -np.arange(self.longest), "left")  # chains with more than t lines

    def at(self, t: int) -> np.ndarray:
        return self.begin[: self.running[t]] + t


def marginals(e: np.ndarray, trans: np.ndarray, c: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """P(line good), expected transitions (2 x 2), and the log partition summed over chains. ``e``: score of good over bad."""
    n = len(e)
    em = np.column_stack([np.zeros(n), e])
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(c.longest):
        at = c.at(t)
        if t == 0:
            alpha[at] = em[at]
        else:
            p = alpha[at - 1]
            alpha[at] = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + em[at]
    for t in range(c.longest - 2, -1, -1):
        at = c.at(t + 1)
        q = beta[at] + em[at]
        beta[at - 1] = np.logaddexp(q[:, :1] + trans[:, 0], q[:, 1:] + trans[:, 1])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - z)
    inner = np.ones(n, bool)
    inner[c.begin] = False
    to = np.flatnonzero(inner)
    pair = np.exp(alpha[to - 1][:, :, None] + trans[None] + (em[to] + beta[to])[:, None, :] - z[to][:, None, None])
    return good, pair.sum(0), float(z[c.begin].sum())


class Climb:
    """Gradient ascent (Adam) on the expected log-likelihood of labels given their expectations. ``free``: parameters that may leave zero."""

    def __init__(self, x: np.ndarray, first: np.ndarray, l2: float = 1.0):
        self.x, self.c, self.l2 = x, Chains(first), l2
        size = x.shape[1] + 4
        self.theta, self.m, self.v, self.i = np.zeros(size), np.zeros(size), np.zeros(size), 0

    @property
    def field(self) -> tuple[np.ndarray, np.ndarray]:
        return self.theta[:-4], self.theta[-4:].reshape(2, 2)

    def run(self, good: np.ndarray, pairs: np.ndarray, rounds: int, free: np.ndarray | None = None) -> None:
        n, target = len(self.x), self.x.T @ good
        for _ in range(rounds):
            w, trans = self.field
            now, now_pairs, _ = marginals(self.x @ w, trans, self.c)
            g = np.concatenate([target - self.x.T @ now, (pairs - now_pairs).ravel()]) / n - self.l2 * self.theta / n
            if free is not None:
                g = g * free
            self.i += 1
            self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
            self.theta = self.theta + 0.1 * (self.m / (1 - 0.9**self.i)) / (np.sqrt(self.v / (1 - 0.999**self.i)) + 1e-8)


def fit_field(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions where the label ``y`` of each line is known."""
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    climb = Climb(x, first, l2)
    climb.run(y, seen, rounds)
    return climb.field


def constrained(e: np.ndarray, trans: np.ndarray, first: np.ndarray, length: np.ndarray, y: np.ndarray, prevail: float = PREVAIL) -> np.ndarray:
    """Scores of good over bad, tilted so that in each document lines with its label ``y`` hold ``prevail`` of the length."""
    size = np.diff(first)
    share = (length + 1) / np.repeat(np.add.reduceat(length + 1, first[:-1]), size)
    sign = np.where(y == 1, 1.0, -1.0)
    wrong = lambda good, f, sg: sg * (np.add.reduceat(good * share_, f[:-1]) - 0.5) < prevail - 0.5
    share_ = share
    good, _, _ = marginals(e, trans, Chains(first))
    off = np.flatnonzero(wrong(good, first, sign))
    out = e.copy()
    if not len(off):
        return out
    # bisection, for those documents together
    at = np.concatenate([np.arange(first[i], first[i + 1]) for i in off])
    sub = np.concatenate([[0], np.cumsum(size[off])])
    c, share_, sg, mine = Chains(sub), share[at], sign[off], e[at]
    low, high = np.zeros(len(off)), np.full(len(off), np.nan)
    step = np.ones(len(off))
    for _ in range(40):
        tilt = np.where(np.isnan(high), step, (low + high) / 2)
        good, _, _ = marginals(mine + np.repeat(sg * tilt, size[off]) * share_, trans, c)
        under = wrong(good, sub, sg)
        low, high = np.where(under, tilt, low), np.where(under, high, tilt)
        step = np.where(np.isnan(high), step * 2, step)
    out[at] += np.repeat(sg * np.where(np.isnan(high), low, high), size[off]) * share_
    return out


def fit_latent(f: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions from documents' labels ``y``."""
    x = with_neighbours(f, first)
    climb = Climb(x, first)
    own = np.zeros(x.shape[1] + 4)
    own[: f.shape[1]] = own[-5] = 1.0  # a line's features and the constant
    climb.run(np.repeat(y, np.diff(first)).astype(float), np.zeros((2, 2)), ROUNDS // 2, own)
    for _ in range(turns):
        w, trans = climb.field
        good, pairs, _ = marginals(constrained(x @ w, trans, first, length, y), trans, climb.c)
        climb.run(good, pairs, TURN_ROUNDS)
    return climb.field


def aggregate(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means over each text, weighted by line length (and one, for empty lines)."""
    weight = length + 1
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_curve(s: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """A logistic curve from mean to probability (Newton steps, slightly ridged)."""
    x = np.column_stack([_logit(s), np.ones(len(s))])
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.1 * (b - [1.0, 0.0])), -1, 1)
    return float(b[0]), float(b[1])


@F.arrow_udf(T.StructType([T.StructField("f", T.BinaryType()), T.StructField("length", T.BinaryType())]))
def _line_table(text: pa.Array) -> pa.Array:
    f_out, l_out = [], []
    for _, _, t in tx.chunks(text):
        f, length, first = lines(t)
        for a, b in zip(first[:-1], first[1:]):
            f_out.append(f[a:b].astype(np.float32).tobytes())
            l_out.append(length[a:b].astype(np.float32).tobytes())
    return pa.StructArray.from_arrays([pa.array(f_out, pa.binary()), pa.array(l_out, pa.binary())], ["f", "length"])


Model = tuple[np.ndarray, np.ndarray, tuple[float, float]]


def fit_documents(f: np.ndarray, length: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    w, trans = fit_latent(f, length, first, y)
    good, _, _ = marginals(with_neighbours(f, first) @ w, trans, Chains(first))
    return w, trans, fit_curve(aggregate(good, length, first), y)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Feature weights, transitions and curve; None if the labelled rows aren't of both kinds.

    Lines are read where the documents are; one task fits, and the driver gets the model alone.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "f", "length")))]
        rows.sort(key=lambda r: r[0])
        y = np.array([r[1] for r in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        length = [np.frombuffer(r[3], np.float32) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(x) for x in length])])
        f = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(int(first[-1]), -1).astype(float)
        model = fit_documents(f, np.concatenate(length).astype(float), first, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = training_rows(docs, labels, "quality", sample).select("doc_id", "y", _line_table("text").alias("t")).select("doc_id", "y", "t.f", "t.length")
    got = rows.repartition(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(got[0][0]) if got else None


def read(model: Model, t: tx.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of texts; and of all their lines the marginals, the bytes, and each text's first line."""
    w, trans, (a, b) = model
    f, length, first = lines(t)
    good, _, _ = marginals(with_neighbours(f, first) @ w, trans, Chains(first))
    return 1 / (1 + np.exp(-np.clip(a * _logit(aggregate(good, length, first)) + b, -35, 35))), good, length, first


def scorer(model: Model | None):
    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        out = [np.full(j - i, 0.5) if model is None else read(model, t)[0] for i, j, t in tx.chunks(text)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


_READ = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("good", T.ArrayType(T.FloatType()))])


def line_reader(model: Model | None):
    """An Arrow function from texts to (score, good): good has each line's probability of being good; null without a model."""

    @F.arrow_udf(_READ)
    def lines_of(text: pa.Array) -> pa.Array:
        score, good = [], []
        for i, j, t in tx.chunks(text):
            if model is None:
                score.append(np.full(j - i, 0.5))
                good += [None] * (j - i)
                continue
            s, g, _, first = read(model, t)
            score.append(s)
            good += [g[a:b].astype(np.float32) for a, b in zip(first, first[1:])]
        score = np.concatenate(score) if score else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(good, pa.list_(pa.float32()))], ["score", "good"])

    return lines_of


def labelled_lines(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, line (from 0), good (probability), label (1 if that is over a half) of every line."""
    read_ = docs.select("doc_id", line_reader(fit(docs, labels))("text").alias("r"))
    return read_.select("doc_id", F.posexplode("r.good").alias("line", "good")).withColumn("label", (F.col("good") > 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> Column:
    """A column of scores for ``docs``, from a field fitted on its labelled rows."""
    return scorer(fit(docs, labels))(F.col(text))


def without_bad(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of score ``cut`` or more, with all their columns; without a model (scores 0.5) all rows."""
    model = fit(docs, labels)
    return docs if model is None else docs.where(scorer(model)(F.col("text")) >= cut)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    read_ = line_reader(fit(docs, labels))
    scored = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), read_("text").alias("r"))
    return scored.select(
        "doc_id",
        "held_out",
        "r.score",
        (F.col("r.score") >= CUT).cast("int").alias("predicted"),
        F.size("r.good").alias("n_lines"),
        F.array_join(F.transform("r.good", lambda p: F.when(p > 0.5, "1").otherwise("0")), "").alias("line_labels"),
    )
