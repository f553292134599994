"""Quality scores of whole texts, learnt from positive and unlabelled documents.

A small network on counts of bytes and words minimises the non-negative unbiased risk: prior * risk(positives, 1) +
max(0, risk(unlabelled, 0) - prior * risk(positives, 0)), with the logistic loss, so its output is the log-odds of class 1.
Positives are documents marked good, the unlabelled are drawn from all. No negative label is used, and labels of held-out
documents (crc32 of the id as text, modulo 4, is 2) are never read.

The class prior is estimated from positives and unlabelled: networks fitted to one half of each score the other half, and
the prior is the least share of the unlabelled that score over some threshold, as a part of the positives' share, where a
confidence bound of that ratio is lowest. The fit needs a prior itself, so this is done ROUNDS times, from 0.5 on.

Fitting uses about POSITIVES + UNLABELLED rows, however often an id or a text occurs; every row is scored. Null texts are
scored as empty ones, texts of any length by one pass over the whole; a null id isn't held out. Of several labels of one id
the lowest counts. Without a positive label, or with an empty table, there is no model and every score is 0.5. A column with
the score's name is replaced; others are kept as they are and never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common

POSITIVES, UNLABELLED = 12_000, 24_000
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.02, 1e-4
#: Estimates of the prior, steps of each fit for them, and the chance of error that their bound allows.
ROUNDS, PRIOR_STEPS, ERROR = 3, 300, 0.1
ACCEPT = 0.7
MARKS = b"!\"#$%&'()*+,-./0:;<=>?@[\\]^_`{|}~\n"
N_FEATURES = len(MARKS) + 12


def features(text: str) -> np.ndarray:
    """Shares of bytes and words over the whole text; logarithms keep rare ones apart from none."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    codes = np.fromiter(map(hash, words), np.int64, len(words))
    order = np.sort(codes)
    distinct = 1 + int((order[1:] != order[:-1]).sum()) if len(words) else 0
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    lines = text.split("\n")
    shares = np.concatenate([count[list(MARKS)], [count[48:58].sum(), upper, lower, count[128:].sum(), count[0:32].sum()]]) / n
    more = [np.log1p(len(words)), n / m / 8, distinct / m, distinct / m ** 0.8, float((codes[1:] == codes[:-1]).sum()) / m, len(set(lines)) / len(lines), m / len(lines) / 50]
    return np.concatenate([np.log1p(shares * 1000), more]).astype(np.float32)


def stacked(text: pa.Array) -> np.ndarray:
    return np.stack([features(x or "") for x in text.to_pylist()]) if len(text) else np.zeros((0, N_FEATURES), np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Net:
    """One hidden layer; forward() keeps what grad() needs."""

    def __init__(self, n: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def forward(self, x):
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3], h

    def grad(self, x, h, g):
        """Gradient of the parameters from that of the outputs."""
        d = np.outer(g, self.w[2]) * (1 - h * h)
        return [x.T @ d, d.sum(0), h.T @ g, np.array([g.sum()])]


def risk(op: np.ndarray, ou: np.ndarray, prior: float, beta: float = 0.0) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of outputs for positives and unlabelled, and the descent's slope by each; where the bracket is
    below -beta, the slope is that of the bracket turned round."""
    loss = np.logaddexp
    bracket = loss(0, ou).mean() - prior * loss(0, op).mean()
    sp, su = sigmoid(op), sigmoid(ou)
    # the logistic loss's slope is s - 1 for class 1 and s for class 0
    if bracket >= -beta:
        gp, gu = (prior * (sp - 1) - prior * sp) / len(op), su / len(ou)
    else:
        gp, gu = prior * sp / len(op), -su / len(ou)
    return prior * loss(0, -op).mean() + max(0.0, bracket), gp, gu


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, beta: float = 0.0) -> Net:
    """Adam on the non-negative risk."""
    net = Net(positive.shape[1])
    m, v = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    for t in range(1, steps + 1):
        op, hp = net.forward(positive)
        ou, hu = net.forward(unlabelled)
        _, gp, gu = risk(op, ou, prior, beta)
        grads = [a + b + DECAY * w for a, b, w in zip(net.grad(positive, hp, gp), net.grad(unlabelled, hu, gu), net.w, strict=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            net.w[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def share_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by scores that no fit has seen: the unlabelled's share over a threshold by the positives', at the threshold
    where the ratio's upper bound is lowest."""
    at, unlabelled = np.sort(positive)[::-1], np.sort(unlabelled)
    n, m = len(at), len(unlabelled)
    of_positive = np.arange(1, n + 1) / n
    of_unlabelled = (m - np.searchsorted(unlabelled, at)) / m
    slack = np.sqrt(np.log(4 / ERROR) / 2) * (n**-0.5 + m**-0.5)
    k = ((of_unlabelled + slack) / of_positive).argmin()
    return float(of_unlabelled[k] / of_positive[k])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of class 1 among the unlabelled. Every second row makes a half."""
    prior = 0.5
    if min(len(positive), len(unlabelled)) < 4:
        return prior
    for _ in range(ROUNDS):
        found = []
        for k in (0, 1):
            net = fit_nnpu(positive[k::2], unlabelled[k::2], prior, PRIOR_STEPS)
            found.append(share_ratio(*(net.forward(x[1 - k :: 2])[0] for x in (positive, unlabelled))))
        prior = min(0.99, max(0.01, sum(found) / 2))
    return prior


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def drawn(doc_id: Column, share: float, salt: int) -> Column:
    return (F.xxhash64(doc_id, F.lit(salt)).bitwiseAND((1 << 52) - 1) / F.lit(float(1 << 52))) < F.lit(share)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model as plain arrays, a few thousand numbers; None where there is nothing to learn from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(remainder(F.col("doc_id")) != 2)
    good = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    n_good, n = good.count(), docs.count()
    if not n_good or not n:
        return None
    # about POSITIVES ids; rows are thinned too, as one id may have any number of them
    sample = F.broadcast(good.where(drawn(F.col("doc_id"), POSITIVES / n_good, 1)).withColumn("good", F.lit(True)))
    n_rows = docs.select("doc_id").join(sample, "doc_id").count()
    rows = docs.select("doc_id", "text", F.rand(3).alias("u"), F.rand(5).alias("p")).join(sample, "doc_id", "left")
    free, good = F.col("u") < UNLABELLED / n, F.col("good").isNotNull() & (F.col("p") < 2 * POSITIVES / max(n_rows, 1))
    rows = rows.select("doc_id", "text", free.alias("free"), good.alias("good")).where("free OR good")

    def run(batches):
        for batch in common.text_slices(batches):
            flat = stacked(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(map(bytes, flat)), pa.binary()), "id": batch.column("doc_id"), "good": batch.column("good"), "free": batch.column("free")})

    got = common.map_arrow(rows, run, f"x binary, id {docs.schema['doc_id'].dataType.simpleString()}, good boolean, free boolean").toArrow()
    got = got.take(pc.sort_indices(got, sort_keys=[("id", "ascending"), ("x", "ascending")]))  # order of rows decides sums' last bits
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    good, free = got["good"].to_numpy(), got["free"].to_numpy()
    if not good.any() or not free.any():
        return None
    mean, scale = x[free].mean(0), x[free].std(0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    prior = estimated_prior(x[good], x[free])
    return {"w": fit_nnpu(x[good], x[free], prior).w, "mean": mean, "scale": scale, "prior": prior}


def score_texts(model: dict | None, text: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(text), 0.5)
    x = np.clip((stacked(text) - model["mean"]) / model["scale"], -6, 6)
    net = Net(N_FEATURES)
    net.w = model["w"]
    return sigmoid(net.forward(x)[0])


def with_scores(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    rows = docs.drop(column)
    names = rows.columns

    def run(batches):
        for batch in common.text_slices(batches):
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {column: pa.array(score_texts(model, batch.column("text")), pa.float64())})

    return common.map_arrow(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{column}` double")


def op9_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
