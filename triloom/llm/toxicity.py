"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its words and of their prefixes (lower-cased, without punctuation at the ends, hashed into
2**20 features), so inflected forms share evidence. A logistic regression with an L1 penalty is fitted by
accelerated proximal gradients. Counterfactual regularisation swaps identity terms in the labelled sentences for
all others of their group and penalises the squared change of the score; as the model is linear, a swap changes only the terms'
own features, so the penalty is a sum over all pairs of terms of a group, weighted by how many labelled texts hold them. A term
that is put into a text that lacks it must not change the score either. Mentioning a group is thus no evidence.

The fit reads at most about ``per_class`` labelled texts of each class (chosen by a hash of the id). Features are counted by
tasks; the driver gets at most 2**20 counts, keeps at most ``MOST_FEATURES`` features with significant log odds, and gets the
texts' sets of these alone, so what it holds is bounded whatever the texts' lengths. Every text is scored whole.

Defined results: null, empty and wordless texts get the score of the bias. Labels with a null class are not used; a
document with several labels counts with each. With no labels of one class the score is that share, smoothed. Empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .decontaminate import _EDGE
from .runtime import Scratch

BITS = 20
PREFIXES = (4, 5, 6)
MOST_FEATURES = 12_000

# Groups of identity terms that may stand in for each other.
IDENTITY_GROUPS = [
    "women men girls boys female male frauen männer femmes hommes mujeres hombres".split(),
    "gay lesbian straight bisexual queer homosexual heterosexual transgender".split(),
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh".split(),
    "black white asian african european latino hispanic arab indian".split(),
    "american mexican chinese german french spanish turkish polish russian".split(),
    "blind deaf disabled elderly old young teenage".split(),
    "immigrants refugees citizens foreigners natives".split(),
]


def features(texts: pa.Array):
    """Feature of each word and of its prefixes (-1 where a word is too short), one row a kind, and the first word of each text."""
    raw, at = scan.buffers(texts)
    starts, ends, first = scan.ranges(raw, at)
    raw = scan.LOWER[raw]
    if len(starts):
        while (more := (starts < ends) & _EDGE[raw[np.minimum(starts, len(raw) - 1)]]).any():
            starts = starts + more
        while (more := (starts < ends) & _EDGE[raw[np.maximum(ends - 1, 0)]]).any():
            ends = ends - more
    sums = scan.prefix(raw)
    mask = np.uint64((1 << BITS) - 1)
    out = [np.where(ends > starts, (scan.range_hash(sums, starts, ends) & mask).astype(np.int64), -1)]
    for k in PREFIXES:
        stop = np.minimum(ends, starts + k)
        salted = scan.mix(scan.range_hash(sums, starts, stop) + np.uint64(k))
        out.append(np.where(ends - starts > k, (salted & mask).astype(np.int64), -1))
    return np.stack(out) if len(starts) else np.zeros((1 + len(PREFIXES), 0), np.int64), first


def term_features(term: str) -> np.ndarray:
    found = features(pa.array([term]))[0].ravel()
    return np.unique(found[found >= 0])


def _sets(batches):
    for batch in batches:
        for lo, hi in scan.slices(batch.column(1)):
            found, first = features(batch.column(1).slice(lo, hi - lo))
            sets = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = np.unique(found[:, a:b])
                sets.append(own[own >= 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["toxic", "features"])


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # of each feature

    def scores(self, texts: pa.Array) -> np.ndarray:
        found, first = features(texts)
        hit = (found >= 0) & (self.weights[found] != 0)
        kind, word = np.nonzero(hit)
        text = np.searchsorted(first, word, side="right") - 1
        pairs = np.unique(text.astype(np.int64) << BITS | found[kind, word])
        total = np.bincount(pairs >> BITS, weights=self.weights[pairs & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def _tallied(batches):
    """For each batch: how many texts of each class hold each feature."""
    for batch in batches:
        toxic, sets = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for label in (0, 1):
            own = [np.frombuffer(x, np.int32) for x, t in zip(sets, toxic, strict=True) if t == label]
            feature, count = np.unique(np.concatenate([*own, np.zeros(0, np.int32)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.where(label == 0, count, 0), pa.int64()), pa.array(np.where(label == 1, count, 0), pa.int64())], names=["feature", "n0", "n1"])


def identity_features() -> list[list[np.ndarray]]:
    return [[term_features(t) for t in g] for g in IDENTITY_GROUPS]


def significant(n0: np.ndarray, n1: np.ndarray, total0: int, total1: int) -> np.ndarray:
    """The features to learn from: those with significant log odds, and all of the identity terms."""
    odds = np.log((n1 + 0.5) / (total1 - n1 + 0.5)) - np.log((n0 + 0.5) / (total0 - n0 + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
    z[n1 + n0 < 3] = 0
    kept = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    return np.unique(np.concatenate([kept[z[kept] > 2.5], *[f for g in identity_features() for f in g]]))


def swap_penalty(place: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, changes and strengths: each row is the change of the features by a swap of two terms of a group, or by one term put in."""
    groups = identity_features()
    columns = np.unique(np.concatenate([place[f] for g in groups for f in g]))
    changes, strength = [], []

    def term(f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns))
        out[np.searchsorted(columns, place[f])] = 1
        return out

    for g in groups:
        for k, f in enumerate(g):
            changes.append(term(f))  # put into a text that lacks it
            strength.append(0.1)
            for other in g[k + 1 :]:
                changes.append(term(f) - term(other))
                strength.append(1 + held[f].min() + held[other].min())
    return columns, np.array(changes), np.array(strength)


def train(y: np.ndarray, sets: list[np.ndarray], kept: np.ndarray, held: np.ndarray, l1: float = 3e-4, counterfactual: float = 0.05, rounds: int = 250) -> Model:
    """Fit on the texts' sets of ``kept`` features; ``counterfactual`` weighs the penalty on identity swaps, ``held`` counts the texts with a feature."""
    weights = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), weights)
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    col, row = place[np.concatenate(sets)], np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    columns, changes, strength = swap_penalty(place, held)
    strength = strength * counterfactual / len(sets)

    target = y.astype(np.float64)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b, v, vb, t = np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 0.0, 1.0
    step = 4.0 / (1 + np.bincount(row, minlength=len(y)).dot(balance) + 4 * np.linalg.norm(np.sqrt(strength)[:, None] * changes, 2) ** 2)
    best = np.inf
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=v[col], minlength=len(y)) + vb, -40, 40)))
        r = (p - target) * balance
        grad = np.bincount(col, weights=r[row], minlength=len(kept))
        grad[columns] += changes.T @ (strength * (changes @ v[columns]))
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = vb - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
        loss = -(balance * (target * np.log(p + 1e-12) + (1 - target) * np.log(1 - p + 1e-12))).sum() + l1 * np.abs(w).sum()
        if loss > best * 1.001:
            t = 1.0  # restart the momentum
        best = min(best, loss)
    weights[kept] = w
    return Model(float(b), weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 5000, **options) -> Model:
    """Fit on labelled rows; ``per_class`` bounds the sample of each class."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    scale = 1 << 30
    limit = F.when(F.col("toxic") == 1, int(scale * min(1.0, per_class / max(1, totals.get(1, 0))))).otherwise(int(scale * min(1.0, per_class / max(1, totals.get(0, 0)))))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < limit)
    # at most about 2 * per_class rows, whatever the tables' sizes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")
    scratch = Scratch()
    sets = scratch.keep(texts.select("toxic", "text").mapInArrow(_sets, "toxic int, features binary"), "labelled")
    counts = sets.mapInArrow(_tallied, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2**BITS rows
    n0, n1 = np.zeros((2, 1 << BITS))
    n0[counts["feature"].to_numpy()], n1[counts["feature"].to_numpy()] = counts["n0"].to_numpy(), counts["n1"].to_numpy()
    drawn = {r["toxic"]: r["count"] for r in sets.groupBy("toxic").count().collect()}
    kept = significant(n0, n1, drawn.get(0, 0), drawn.get(1, 0))
    wanted = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(1 << BITS), kept))

    def of_kept(batches):
        for batch in batches:
            own = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[wanted.value[x]].tobytes() for x in own], pa.binary())], names=["toxic", "features"])

    rows = sets.mapInArrow(of_kept, "toxic int, features binary").toArrow()  # at most about 2 * per_class sets of MOST_FEATURES
    scratch.clear()
    found = sorted(zip(rows["toxic"].to_pylist(), rows["features"].to_pylist(), strict=True))
    return train(np.array([t for t, _ in found], np.int32), [np.frombuffer(x, np.int32) for _, x in found], kept, n0 + n1, **options)


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"))
    fields = given.columns[:-1]

    def run(batches):
        for batch in batches:
            for lo, hi in scan.slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.scores(part.column(part.num_columns - 1)), pa.float64())], names=[*fields, "score"])

    out = given.mapInArrow(run, T.StructType([*[given.schema[f] for f in fields], T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col(f).alias(c) for f, c in zip(fields, keep, strict=True)], "score")
