"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own (make-up of its characters, word repetition, length, ending,
whether the line came before) and those of its two neighbours. A two-state chain labels lines good
or bad. Forward-backward marginals, weighted by line length, give the share of a document that is
bad; a logistic curve fitted on the training documents turns the share into a probability.

Lines carry no labels, documents do. In training the labels of lines are therefore hidden, and the
document's label only says how they add up: of a bad document at least ``BAD_SHARE`` of the text is
expected to be in bad lines, of a good one ``GOOD_SHARE`` at most. Each step takes, for every
document, the distribution over labellings that is closest to the model's own and keeps that bound
(the model with one more weight on the share, found by bisection), and moves the model towards it.
So the chain sees junk and prose follow each other inside bad documents and learns when to switch.

The model is fitted on at most ``MAX_TRAIN_ROWS`` documents of each label, dealt to as many buckets
by a hash of their id, of which each gives one. They are read whole. Their line features stay in a
table, and every step is one Spark job over it that returns sums of the size of the model.

A text of many lines is read in blocks, and of each line some fifty bytes are kept.

Defined results for odd input
* A null or empty text is one empty line and is scored as such; it never fails.
* Without any usable label the score is 0.5 everywhere; with labels of one class only, the curve
  still gives scores between 0 and 1.
* A document with several labels counts with the lowest. An id on several texts gives the text of
  the least hash. Null ids and null labels are not learned from. Repeated rows give repeated
  results; columns other than the named ones are carried along, but for ``quality_score``, which is
  replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import materialize, release, text_batches

#: Labelled documents of each label that are learned from, at most.
MAX_TRAIN_ROWS = 2000
TRAIN_PARTS = 8
STEPS = 40
RATE = 0.25
L2 = 1e-3
BAD_SHARE, GOOD_SHARE = 0.5, 0.02
#: Characters of a text whose lines are looked at together; chains of more lines than LONG_CHAIN are walked one by one.
BLOCK_CHARS = 1 << 18
LONG_CHAIN = 2000

#: Classes of bytes: lower, upper, digit, space, sentence mark, other mark, non-ASCII.
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[:128] = 5
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
N_OWN = 16
REPEATED = 14


def _blocks(text: str) -> Iterator[list[str]]:
    """Lines of a text, some at a time."""
    at = 0
    while True:
        end = text.find("\n", at + BLOCK_CHARS)
        yield (text[at:] if end < 0 else text[at:end]).split("\n")
        if end < 0:
            return
        at = end + 1


def _block_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x N_OWN features but for REPEATED, bytes of each line, hash of each line)."""
    raw = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    classes = _CLASS[raw]
    count = np.empty((len(lines), 7))
    for c in range(7):
        count[:, c] = np.add.reduceat((classes == c), starts, dtype=np.int64)
    count[:, 3] -= 1  # the line break
    full = np.maximum(size, 1)
    out = np.zeros((len(lines), N_OWN))
    out[:, 0] = np.log1p(size)
    out[:, 1:8] = count / full[:, None]
    out[:, 8] = count[:, 1] / np.maximum(count[:, 0] + count[:, 1] + count[:, 6], 1)
    hashes = np.empty(len(lines), dtype=np.uint64)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        out[i, 9] = size[i] / (n + 1) / 10
        if n:
            distinct = len(set(words))
            out[i, 10] = distinct / n
            out[i, 11] = (n - distinct) / n if n > 8 else 0.0
            again = sum(map(str.__eq__, words, words[1:])) if distinct < 0.9 * n else 0
            out[i, 12] = again / n
            out[i, 13] = words[-1][-1] in ".?\"'"
        hashes[i] = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        out[i, 15] = n <= 1
    return out, size, hashes


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """1 where a line came before."""
    out = np.ones(len(hashes))
    out[np.unique(hashes, return_index=True)[1]] = 0
    return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_OWN features, bytes of each line)."""
    found = [_block_features(lines) for lines in _blocks(text or "")]
    own = np.vstack([f[0] for f in found])
    own[:, REPEATED] = _repeated(np.concatenate([f[2] for f in found]))
    return own, np.concatenate([f[1] for f in found])


def _long_chain(bad: np.ndarray, trans: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> None:
    """Fill the log messages of one chain (n x 2 each), line by line in plain numbers.

    Messages are kept up to a factor per line as log odds and as their norms."""
    t00, t01, t10, t11 = trans.ravel().tolist()
    scores = bad.tolist()

    def add(x: float, y: float) -> float:
        return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))

    g, b = 0.0, scores[0]
    a0, a1 = [g], [b]
    for e in scores[1:]:
        g, b = add(g + t00, b + t10), add(g + t01, b + t11) + e
        a0.append(g)
        a1.append(b)
    alpha[:, 0], alpha[:, 1] = a0, a1
    g, b = 0.0, 0.0
    b0, b1 = [g], [b]
    for e in reversed(scores[1:]):
        g, b = add(t00 + g, t01 + e + b), add(t10 + g, t11 + e + b)
        b0.append(g)
        b1.append(b)
    beta[:, 0], beta[:, 1] = b0[::-1], b1[::-1]


def forward_backward(bad: np.ndarray, trans: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Marginals of the bad state, pair expectations (2 x 2) and log-partition, over many chains.

    ``bad``: score of the bad state at each line (the good state scores 0); chains of usual length
    are stepped through together, longest first, so that a step handles the chains that still go on.
    """
    emit = np.stack([np.zeros(len(bad)), bad], axis=1)
    a, b = np.zeros((len(bad), 2)), np.zeros((len(bad), 2))
    for s, n in zip(starts[sizes > LONG_CHAIN].tolist(), sizes[sizes > LONG_CHAIN].tolist()):
        _long_chain(bad[s : s + n], trans, a[s : s + n], b[s : s + n])
    usual = np.flatnonzero(sizes <= LONG_CHAIN)
    order = usual[np.argsort(-sizes[usual], kind="stable")]
    at, long = starts[order], sizes[order]
    steps = int(long[0]) if len(long) else 0
    active = [int(np.searchsorted(-long, -t, side="left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        i = at[: active[t]] + t
        if t == 0:
            a[i] = emit[i]
        else:
            p = a[i - 1]
            a[i] = np.logaddexp(p[:, :1] + trans[0], p[:, 1:] + trans[1]) + emit[i]
    for t in range(steps - 2, -1, -1):
        i = at[: active[t + 1]] + t
        q = b[i + 1] + emit[i + 1]
        b[i] = np.logaddexp(q[:, 0:1] + trans[:, 0], q[:, 1:2] + trans[:, 1])
    ends = starts + sizes - 1
    log_z = np.logaddexp(a[ends, 0], a[ends, 1])
    z = np.repeat(log_z, sizes)
    marginal = np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0))
    inner = np.ones(len(bad), dtype=bool)
    inner[ends] = False
    i = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for u in range(2):
        for v in range(2):
            pairs[u, v] = np.exp(a[i, u] + trans[u, v] + emit[i + 1, v] + b[i + 1, v] - z[i]).sum()
    return marginal, pairs, log_z


class _Chains:
    """Documents as chains of lines: standardised features, starts, sizes, and each line's share of its document."""

    def __init__(self, own: list[np.ndarray], line_bytes: list[np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.sizes = np.array([len(o) for o in own])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.x = (np.vstack(own) - mean) / scale
        weight = np.concatenate(line_bytes) + 1.0
        self.share = weight / np.repeat(np.add.reduceat(weight, self.starts), self.sizes)
        self.first = np.zeros(len(self.x))
        self.first[self.starts] = 1
        self.last = np.zeros(len(self.x))
        self.last[self.starts + self.sizes - 1] = 1

    def emitted(self, w: np.ndarray) -> np.ndarray:
        return _emission(self.x @ w[: 3 * N_OWN].reshape(3, N_OWN).T, self.first, self.last, w)

    def gradient(self, r: np.ndarray) -> np.ndarray:
        """Sum over lines of r times the features."""
        after, before = np.roll(r, -1) * (1 - self.last), np.roll(r, 1) * (1 - self.first)
        return np.concatenate([self.x.T @ r, self.x.T @ after, self.x.T @ before, [r @ self.first, r @ self.last, r.sum()]])


def _emission(parts: np.ndarray, first: np.ndarray, last: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores of the bad state from each line's products with the weights of own, previous and next features."""
    before, after = np.roll(parts[:, 1], 1) * (1 - first), np.roll(parts[:, 2], -1) * (1 - last)
    return parts[:, 0] + before + after + first * w[-3] + last * w[-2] + w[-1]


#: Weights of a line's own features, of them as its previous and next line's, of a missing neighbour on either side, and a constant.
N_WEIGHTS = 3 * N_OWN + 3


def _step_sums(chains: _Chains, doc_bad: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Gradient of the model towards the closest labellings that keep the documents' bounds."""
    w, trans = theta[:-4], theta[-4:].reshape(2, 2)
    bad = chains.emitted(w)
    p, pairs, _ = forward_backward(bad, trans, chains.starts, chains.sizes)
    share = np.add.reduceat(p * chains.share, chains.starts)
    off = np.flatnonzero(np.where(doc_bad > 0, share < BAD_SHARE, share > GOOD_SHARE))
    if not len(off):
        return np.zeros(len(theta))
    sizes = chains.sizes[off]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lines = np.repeat(chains.starts[off] - starts, sizes) + np.arange(sizes.sum())
    # the weight on the share is put on lines by their length against the mean line of their document
    push = chains.share[lines] * np.repeat(sizes, sizes)
    want = np.where(doc_bad[off] > 0, BAD_SHARE, GOOD_SHARE)
    low, high = np.where(doc_bad[off] > 0, 0.0, -30.0), np.where(doc_bad[off] > 0, 30.0, 0.0)
    for _ in range(9):
        mid = (low + high) / 2
        q, q_pairs, _ = forward_backward(bad[lines] + push * np.repeat(mid, sizes), trans, starts, sizes)
        under = np.add.reduceat(q * chains.share[lines], starts) < want
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    _, p_pairs, _ = forward_backward(bad[lines], trans, starts, sizes)
    r = np.zeros(len(p))
    r[lines] = q - p[lines]
    return np.concatenate([chains.gradient(r), (q_pairs - p_pairs).ravel()])


class QualityModel:
    def __init__(self, mean, scale, theta, slope=0.0, offset=0.0):
        self.mean, self.scale, self.theta, self.slope, self.offset = mean, scale, theta, slope, offset
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)

    def _scores(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(score of the bad state, bytes) of each line; features of a block of lines are held at a time."""
        weights = self.w[: 3 * N_OWN].reshape(3, N_OWN).T / self.scale[:, None]
        parts, size, hashes = [], [], []
        for lines in _blocks(text or ""):
            own, n_bytes, h = _block_features(lines)
            parts.append((own - self.mean) @ weights)
            size.append(n_bytes)
            hashes.append(h)
        parts = np.vstack(parts) + _repeated(np.concatenate(hashes))[:, None] * weights[REPEATED]
        first, last = np.zeros(len(parts)), np.zeros(len(parts))
        first[0] = last[-1] = 1
        return _emission(parts, first, last, self.w), np.concatenate(size)

    def label_lines(self, text: str | None) -> np.ndarray:
        """Probability of each line to be bad."""
        bad, _ = self._scores(text)
        return forward_backward(bad, self.trans, np.array([0]), np.array([len(bad)]))[0]

    def bad_shares(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted expected share of bad lines of each text."""
        out, held, lines = [], [], 0
        for text in [*texts, ...]:
            if held and (text is ... or lines > 20_000):
                sizes = np.array([len(bad) for bad, _ in held])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                p, _, _ = forward_backward(np.concatenate([bad for bad, _ in held]), self.trans, starts, sizes)
                weight = np.concatenate([size for _, size in held]) + 1.0
                out.append(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts))
                held, lines = [], 0
            if text is not ...:
                held.append(self._scores(text))
                lines += len(held[-1][0])
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of quality 1 for each text."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.bad_shares(texts) + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (kept at or below 0) and offset of P(y = 1 | x), by Newton steps with a small ridge."""
    slope, offset = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        r, w = weight * (y - p), weight * p * (1 - p) + 1e-9
        g = np.array([(r * x).sum() - 0.01 * slope, r.sum() - 0.01 * offset])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + step[0], offset + step[1]
    return min(float(slope), 0.0), float(offset)


_LINES = T.StructType([T.StructField("own", T.ArrayType(T.FloatType())), T.StructField("size", T.ArrayType(T.FloatType()))])


@F.pandas_udf(_LINES)
def _features(texts: pd.Series) -> pd.DataFrame:
    found = [line_features(t) for t in texts]
    return pd.DataFrame({"own": [f[0].ravel().astype("float32") for f in found], "size": [f[1].astype("float32") for f in found]})


def _documents(batch: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    own = [np.asarray(o, dtype=np.float64).reshape(-1, N_OWN) for o in batch["own"]]
    return own, [np.asarray(s, dtype=np.float64) for s in batch["size"]]


def _summed(table: DataFrame, sums, width: int) -> np.ndarray:
    """Sum of ``sums`` (batch -> numbers) over a table, one row from each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += sums(batch)
        yield pd.DataFrame({"x": [total.tolist()]})

    return np.sum([r["x"] for r in table.mapInPandas(run, "x array<double>").collect()], axis=0)


def _moments(batch: pd.DataFrame) -> np.ndarray:
    own = np.vstack(_documents(batch)[0])
    return np.concatenate([[len(own)], own.sum(axis=0), (own * own).sum(axis=0)])


def _train(table: DataFrame) -> QualityModel:
    """Weights from a table of (bad, own, size) by steps of Adam; each is one job."""
    sums = _summed(table, _moments, 1 + 2 * N_OWN)
    n = sums[0]
    mean = sums[1 : 1 + N_OWN] / n
    scale = np.sqrt(np.maximum(sums[1 + N_OWN :] / n - mean * mean, 0))
    scale[scale < 1e-6] = 1.0
    theta = np.zeros(N_WEIGHTS + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):

        def sums_at(batch: pd.DataFrame, at=theta) -> np.ndarray:
            return _step_sums(_Chains(*_documents(batch), mean, scale), batch["bad"].to_numpy(dtype=np.float64), at)

        grad = _summed(table, sums_at, len(theta)) / n - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = RATE * (1 - 0.8 * step / STEPS)
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return QualityModel(mean, scale, theta)


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> QualityModel | None:
    """Model from at most ``max_rows`` documents of each label, of the labels that ``trained_on`` (over ``id_col``) picks."""
    usable = labels.filter(trained_on & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    each = usable.groupBy(F.col(id_col).alias("__id")).agg((F.min(label_col) <= 0).cast("int").alias("bad"))
    rank = F.xxhash64(F.lit(1), "__id")
    chosen = each.groupBy("bad", F.pmod(rank, F.lit(max_rows)).alias("bucket")).agg(
        F.min(F.struct(F.xxhash64("__id").alias("h"), "__id")).alias("x"), F.count("*").alias("n"))
    chosen = materialize(chosen.select("bad", "x.__id", "n"), "quality-rows")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen.select("__id", "bad")), "__id")  # at most 2 * max_rows ids, each once
    texts = texts.groupBy("__id", "bad").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    table = texts.repartition(TRAIN_PARTS).select("__id", "bad", _features("text").alias("f")).select("__id", "bad", "f.*")
    with text_batches(docs.sparkSession):
        table = materialize(table, "quality-lines")
    if table.isEmpty():
        return None
    model = _train(table)

    @F.pandas_udf(T.DoubleType())
    def share(own: pd.Series, size: pd.Series) -> pd.Series:
        chains = _Chains(*_documents(pd.DataFrame({"own": own, "size": size})), model.mean, model.scale)
        p, _, _ = forward_backward(chains.emitted(model.w), model.trans, chains.starts, chains.sizes)
        return pd.Series(np.add.reduceat(p * chains.share, chains.starts))

    shares = sorted(tuple(r) for r in table.select("bad", share("own", "size").alias("share")).collect())  # at most 2 * max_rows
    y, x = 1 - np.array([s[0] for s in shares], dtype=np.float64), np.array([s[1] for s in shares])
    every = {r["bad"]: r["n"] for r in chosen.groupBy("bad").agg(F.sum("n").alias("n")).collect()}
    weight = np.where(y > 0, every.get(0, 0) / max((y > 0).sum(), 1), every.get(1, 0) / max((y == 0).sum(), 1))
    model.slope, model.offset = _logistic(x, y, weight * len(y) / weight.sum())
    release(table, chosen)
    return model


def scorer(model: QualityModel | None):
    """Pandas UDF: text -> score."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(list(texts)) if model else np.full(len(texts), 0.5), dtype="float64")

    return score


def held_out(id_col: str = "doc_id") -> Column:
    """Documents whose labels are never learned from: crc32(id) mod 5 is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with the column ``quality_score``."""
    model = fit(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    return docs.withColumn("quality_score", scorer(model)(F.col(text_col)))
