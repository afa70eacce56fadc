"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all
pairwise interactions in time linear in the features.  Inputs come from the text alone: hashed
words with log counts of unit length per text, structure statistics and the text's lengths in
fixed bins.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import crc_mod
from quillspark.llm.training import labelled_sample

WORD_BUCKETS = 1 << 12
#: At most so many labelled documents are fitted on.
TRAIN_ROWS = 6000
RANK = 8
EPOCHS = 12
THRESHOLD = 0.3

_SHARES = np.array([0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_SIZES = np.array([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384, 65536])
_MEANS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48])


def _class(*codes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for c in codes:
        out[c] = 1
    return out


_CLASSES = [
    _class(slice(65, 91)), _class(slice(97, 123)), _class(slice(48, 58)), _class(slice(128, 256)), _class(9, 13, 32), _class(10), _class(124), _class(33), _class(35, 36, 37, 38, 42),
    _class(60, 62, 123, 125, 91, 93, 92, 61, 95), _class(44, 46, 59, 58, 63, 39, 34, 45), _class(47, 64),
]
#: Bins: character shares, word statistics in shares, mean word length, lengths in words and bytes.
_GROUPS = [_SHARES] * (len(_CLASSES) + 5) + [_MEANS] + [_SIZES] * 2
STRUCTURE = sum(len(g) + 1 for g in _GROUPS)
FEATURES = WORD_BUCKETS + STRUCTURE


def _structure(w: tv.Words, raw: np.ndarray, bag: tv.Bags) -> np.ndarray:
    """(rows, groups) feature numbers of the bins."""
    size = np.diff(w.offsets)
    n = np.diff(w.ptr)
    some, words = np.maximum(size, 1), np.maximum(n, 1)

    def per_row(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[ptr[1:]] - total[ptr[:-1]]

    stats = [per_row(c[raw], w.offsets) / some for c in _CLASSES]
    distinct = np.diff(bag.ptr)
    top = np.zeros(w.rows)
    np.maximum.at(top, bag.row, bag.count)
    rows = w.row_of()
    again = np.zeros(len(w.hash), np.int64)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (rows[1:] == rows[:-1])
    pairs = tv.shingles(w, 3)
    repeated = per_row(np.where(pairs.count > 1, pairs.count, 0), pairs.ptr) / np.maximum(per_row(pairs.count, pairs.ptr), 1)
    after = np.minimum(w.start + w.length, max(len(raw) - 1, 0))
    glued = per_row(~tv._IS_WORD[raw[after]] & ~np.isin(raw[after], [32, 10, 44, 46]), w.ptr) / words if len(w.hash) else np.zeros(w.rows)
    stats += [distinct / words, top / words, per_row(again, w.ptr) / words, repeated, glued, per_row(w.length, w.ptr) / words, n, size]
    out, base = [], WORD_BUCKETS
    for values, edges in zip(stats, _GROUPS):
        out.append(base + np.searchsorted(edges, values, "right"))
        base += len(edges) + 1
    return np.stack(out, axis=1)


def features(w: tv.Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each nonzero feature; a row's features are together."""
    bag = tv.bags(w.row_of(), w.hash, w.rows)
    buckets = tv.bags(bag.row, bag.hash & np.uint64(WORD_BUCKETS - 1), w.rows)
    tf = np.bincount(np.searchsorted(buckets.row * WORD_BUCKETS + buckets.hash.astype(np.int64), bag.row * WORD_BUCKETS + (bag.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)), bag.count, len(buckets.row))
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(buckets.row, value**2, w.rows))
    value = value / norm[buckets.row] if len(value) else value
    structure = _structure(w, raw, bag)
    row = np.concatenate([buckets.row, np.repeat(np.arange(w.rows), structure.shape[1])])
    index = np.concatenate([buckets.hash.astype(np.int64), structure.ravel()])
    value = np.concatenate([value, np.full(structure.size, 0.35)])
    order = np.argsort(row, kind="stable")
    return row[order], index[order], value[order]


def _featurised(col: pa.Array):
    data, offsets = tv.buffers(col)
    for lo, hi in tv.cuts(offsets):
        w = tv.split(data, offsets[lo : hi + 1], lo)
        yield w, *features(w, data[offsets[lo] : offsets[hi]])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """``row`` must be ascending, and every row have a feature."""
        if not rows:
            return np.zeros(0)
        cut = np.searchsorted(row, np.arange(rows))
        v = self.factors[index] * value[:, None]
        sums = np.add.reduceat(v, cut)
        squares = np.add.reduceat((v**2).sum(axis=1), cut)
        z = self.bias + np.add.reduceat(self.linear[index] * value, cut) + 0.5 * ((sums**2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, *, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.02, shrink: float = 2e-4, seed: int = 7) -> Machine:
    """Adam on the log loss.  Labels of one class only, or none, give their smoothed share as constant score."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    machine = Machine(bias, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, rank)))
    if len(np.unique(y)) < 2:
        machine.factors[:] = 0
        return machine
    cut = np.searchsorted(row, np.arange(len(y) + 1))
    theta = np.concatenate([machine.linear[:, None], machine.factors], axis=1)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    step, batch = 0, 128
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            take = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in chosen])
            local = np.repeat(np.arange(len(chosen)), cut[chosen + 1] - cut[chosen])
            machine.bias, machine.linear, machine.factors = bias, theta[:, 0], theta[:, 1:]
            i, x = index[take], value[take]
            p = machine.scores(local, i, x, len(chosen))
            g = (p - y[chosen]) / len(chosen)
            first = np.searchsorted(local, np.arange(len(chosen)))
            v = theta[i, 1:]
            sums = np.add.reduceat(v * x[:, None], first)
            gx = g[local] * x
            each = np.concatenate([gx[:, None], gx[:, None] * (sums[local] - v * x[:, None])], axis=1)
            used, back = np.unique(i, return_inverse=True)
            grad = np.stack([np.bincount(back, each[:, k], len(used)) for k in range(rank + 1)], axis=1) + shrink * theta[used]
            step += 1
            bias -= rate * 10 * float(g.sum())
            m[used] = 0.9 * m[used] + 0.1 * grad
            s[used] = 0.99 * s[used] + 0.01 * grad**2
            theta[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.99**step)) + 1e-8)
    return Machine(bias, theta[:, 0].copy(), theta[:, 1:].copy())


def _collect(batches):
    for batch in batches:
        for w, row, index, value in _featurised(batch.column(1)):
            cut = np.searchsorted(row, np.arange(w.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows),
                    pa.array([index[a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                ["doc_id", "label", "features", "values"],
            )


def train(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_ROWS, mod: int = 5, held_out: int = 0) -> Machine:
    """Fit on at most ``limit`` labelled documents outside the held-out fifth; only their sparse
    features come to the driver, some kilobytes each."""
    sample = labelled_sample(docs, labels, "quality", limit, mod, held_out)
    rows = sorted(sample.mapInArrow(_collect, "doc_id bigint, label int, features binary, values binary").collect(), key=lambda r: (r.doc_id, bytes(r.features)))
    if not rows:
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    index = [np.frombuffer(r.features, np.uint16).astype(np.int64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    return fit(row, np.concatenate(index), np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]).astype(float), np.array([r.label for r in rows], float))


def score(docs: DataFrame, machine: Machine, *, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores (replaced if it is there); nulls score as empty texts."""
    names = [c for c in docs.columns if c != name]
    out = docs.select(*names).withColumn(name, F.lit(0.0))
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            found = [spread.value.scores(row, index, value, w.rows) for w, row, index, value in _featurised(batch.column(names.index(text)))]
            got = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), got], [*names, name])

    return out.mapInArrow(run, out.schema)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  Without usable labels every
    document scores one half."""
    machine = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), machine, name="score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
