"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; everything else is unlabelled web text. A logistic model on
features of the text alone minimises the non-negative unbiased risk

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

(logistic loss). The unlabelled part is all text outside the held-out fold: its features are worked out once into a
table, and in each of ``ROUNDS`` every task descends from the shared weights over its own rows, some at a time, after
which the weights are averaged by rows. The class prior is estimated likewise: a classifier of positives against
unlabelled text ranks both, and the smallest ratio of unlabelled to positive mass over the tails of that ranking (of
all unlabelled rows, from a histogram of fixed bins), with a margin for sampling error, bounds the share of positives
among the unlabelled.

Only the labelled positives are a bounded sample (``sample`` rows, chosen by a hash of the id, so at random and the
same in every run); scoring reads every whole text.

Defined cases: null and empty texts get the score of a text without any bytes; texts of any length are read whole; a
score of exactly 0.5 counts as 1; null ids fall into fold 0; repeated rows give repeated rows; without any positives,
or without unlabelled text, every score is 0.5; an empty table gives no rows; columns that are not asked for are not
read, and those that are must not be named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio

#: Most labelled rows that the fit sees.
SAMPLE = 6000
#: Rounds of averaged descent, rows of a step, least steps of a task in a round, bins of the histogram of ranks.
ROUNDS, ROWS, LEAST_STEPS, BINS = 6, 2048, 400, 4096


def _classes() -> np.ndarray:
    """Byte to feature class: each printable ASCII mark its own, letters by case, digits, white space."""
    out = np.zeros(256, np.uint8)
    out[ord("A") : ord("Z") + 1], out[ord("a") : ord("z") + 1], out[ord("0") : ord("9") + 1] = 1, 2, 3
    out[list(textio.WHITE)], out[ord("\n")], out[0x80:] = 4, 5, 6
    marks = [b for b in range(0x21, 0x7F) if not out[b]]
    out[marks] = np.arange(7, 7 + len(marks))
    return out


CLASS = _classes()
N_CLASSES = int(CLASS.max()) + 1
N_FEATURES = N_CLASSES + 10


def features(texts: list[bytes]) -> np.ndarray:
    """One row for each text: log shares of classes of bytes, word and line statistics."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for first, end, words, at in textio.word_lists(texts, 4 << 20):
        part = texts[first:end]
        size = np.fromiter(map(len, part), np.int64, len(part))
        doc = np.repeat(np.arange(len(part), dtype=np.int32) * N_CLASSES, size)
        counts = np.bincount(doc + CLASS[np.frombuffer(b"".join(part), np.uint8)], minlength=len(part) * N_CLASSES).reshape(-1, N_CLASSES)
        n = np.diff(at)
        safe = np.maximum(n, 1)
        length = np.fromiter(map(len, words), np.int64, len(words))
        last = np.fromiter((w[-1] for w in words), np.uint8, len(words))
        marked = (CLASS[last] >= 7) & ~np.isin(last, list(b".,"))
        stats = [
            np.log1p(n),
            textio.sums(length, at) / safe,
            textio.sums(length * length, at) / safe / 100,
            textio.sums(length <= 3, at) / safe,
            textio.sums(length >= 12, at) / safe,
            textio.sums(marked, at) / safe,
            textio.sums(length == 1, at) / safe,
            n / (counts[:, 5] + 1) / 50,
            counts[:, 1] / (counts[:, 1] + counts[:, 2] + 1.0),
            np.fromiter((len(set(words[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)), float, len(part)) / safe,
        ]
        out[first:end, :N_CLASSES] = np.log1p(200.0 * counts / np.maximum(size, 1)[:, None])
        out[first:end, N_CLASSES:] = np.stack(stats, 1)
    return out


def _descend(risk_gradient, d: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a linear model with intercept."""
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):
        g = risk_gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def tail_bound(sp: np.ndarray, below, n: int) -> float:
    """min over tails of mass(unlabelled) / mass(positive), with a margin. sp: sorted ranks of the positives;
    below(t): share of the n unlabelled ones under t."""
    best = 1.0
    for q in np.linspace(0, 0.9, 46):
        t = sp[int(q * len(sp))]
        fp, fu = 1 - np.searchsorted(sp, t) / len(sp), 1 - below(t)
        margin = np.sqrt(fp * (1 - fp) / len(sp)) + np.sqrt(max(0.0, fu * (1 - fu)) / n) + 1 / n
        best = min(best, (fu + margin) / max(fp - margin, 1e-6) if fp > margin else 1.0)
    return float(np.clip(best, 0.01, 0.99))


def rank_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of the logistic loss of positives against unlabelled rows."""
    return (u.T @ sigmoid(u @ w)) / len(u) - (p.T @ sigmoid(-(p @ w))) / len(p) + 1e-3 * w


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk: its unlabelled part is descended where it is not negative, ascended where it is."""
    fp, fu = p @ w, u @ w
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    g = (u.T @ sigmoid(fu)) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
    return -prior * (p.T @ sigmoid(-fp)) / len(p) + (g if negative >= 0 else -g) + 1e-4 * w


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 300) -> float:
    """Share of positives among the rows of u, all at once."""
    w = _descend(lambda w: rank_gradient(w, p, u), p.shape[1], steps, 0.05)
    sp, su = np.sort(p @ w), np.sort(u @ w)
    return tail_bound(sp, lambda t: np.searchsorted(su, t) / len(su), len(su))


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 15) -> Iterator[np.ndarray]:
    """Feature rows of a task, some at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held += [np.frombuffer(x, np.float32) for x in batch.column(0).to_pylist()]
        if len(held) >= most:
            yield np.stack(held)
            held = []
    if held:
        yield np.stack(held)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))], 1)


def _averaged(table: DataFrame, model: dict, positives: np.ndarray, gradient, rounds: int) -> np.ndarray:
    """Weights after rounds of descent over all rows of the table, averaged by rows after each."""
    w = np.zeros(positives.shape[1])
    for r in range(rounds):
        now = table.sparkSession.sparkContext.broadcast((w, model["mean"], model["scale"], positives))

        def make(batches: Iterator[pa.RecordBatch], now=now, r: int = r) -> np.ndarray | None:
            w, mean, scale, p = now.value
            w, rng, rows, done = w.copy(), np.random.default_rng([r, TaskContext.get().partitionId()]), 0, 0
            m, v = np.zeros(len(w)), np.zeros(len(w))

            def step(u: np.ndarray) -> None:
                nonlocal w, m, v, done
                done += 1
                g = gradient(w, p[rng.integers(0, len(p), min(len(p), ROWS))], u)
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - 0.05 * 0.6**r * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.999**done)) + 1e-8)

            for x in _chunks(batches):
                x = standard(x, mean, scale)
                rows += len(x)
                order = rng.permutation(len(x))
                for s in range(0, len(x), ROWS):
                    step(x[order[s : s + ROWS]])
            while rows and done < LEAST_STEPS:
                step(x[rng.integers(0, len(x), min(len(x), ROWS))])
            return np.concatenate([rows * w, [rows]]) if rows else None

        got = textio.add_up(table, make)
        w = got[:-1] / got[-1]
    return w


def fit_pu(table: DataFrame, positives: np.ndarray) -> dict[str, np.ndarray | float]:
    """Weights for standardised features, minimising the non-negative risk. table: one column of features (bytes) of
    all unlabelled rows; positives: features of the trusted rows."""
    d = N_FEATURES

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = np.zeros(2 * d + 1)
        for x in _chunks(batches):
            x = x.astype(np.float64)
            out += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        return out

    got = textio.add_up(table, moments)
    n = 0 if got is None else int(got[-1])
    if not len(positives) or not n:
        return {"mean": np.zeros(d), "scale": np.ones(d), "w": np.zeros(d + 1), "prior": 0.5}
    x = positives.astype(np.float64)
    mean = (got[:d] + x.sum(0)) / (n + len(x))
    scale = np.sqrt(np.maximum((got[d:-1] + (x * x).sum(0)) / (n + len(x)) - mean * mean, 0))
    scale[scale < 1e-3] = 1.0
    model = {"mean": mean, "scale": scale}
    p = standard(x, mean, scale)
    ranks = _averaged(table, model, p, rank_gradient, 2)
    edges = np.linspace(-40, 40, BINS + 1)
    shipped = table.sparkSession.sparkContext.broadcast((ranks, mean, scale))

    def histogram(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out, (w, mean, scale) = np.zeros(BINS), shipped.value
        for x in _chunks(batches):
            out += np.histogram(np.clip(standard(x, mean, scale) @ w, -39.9, 39.9), edges)[0]
        return out

    under = np.concatenate([[0], np.cumsum(textio.add_up(table, histogram))]) / n
    place = lambda z: np.searchsorted(edges, np.clip(z, -39.9, 39.9), "right") - 1
    prior = tail_bound(np.sort(place(p @ ranks)), lambda t: under[t], n)
    return model | {"w": _averaged(table, model, p, lambda w, p, u: risk_gradient(w, p, u, prior), ROUNDS), "prior": prior}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return sigmoid(z @ model["w"][:-1] + model["w"][-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> dict:
    """Model from positives labelled outside the held-out fold and from unlabelled documents outside it."""
    mark = F.xxhash64("doc_id")
    outside = textio.fold("doc_id", folds) != held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textio.slices(batches, 0):
            x = features(textio.as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "x"])

    table = textio.cut(textio.map_batches(docs.where(outside).select("text", F.col("doc_id").cast("long").alias("doc_id")), run, "doc_id long, x binary"))
    # At most ``sample`` ids.
    trusted = labels.where((F.col("quality") == 1) & outside).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(mark).limit(sample)
    found = table.join(F.broadcast(trusted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").select("x").toArrow()
    positives = np.stack([np.frombuffer(x, np.float32) for x in found["x"].to_pylist()]) if len(found) else np.zeros((0, N_FEATURES), np.float32)
    return fit_pu(table.select("x"), positives)


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the score of every row's whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)
    # A text that is kept is not sent twice.
    body = keep.index("text") if "text" in keep else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textio.slices(batches, body):
            s = apply(shipped.value, features(textio.as_bytes(batch.column(body))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(s, pa.float64())], [*keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return textio.map_batches(docs.select(*keep, *([F.col("text").alias("_text")] if body == n else [])), run, f"{kinds}, score double")


def op6_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = textio.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, textio.table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (textio.fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
