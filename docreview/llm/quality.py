"""Document quality from a linear-chain conditional random field over its lines.

Every line is good or bad; features describe the line and its two neighbours. The chain is trained with the document's
label on all of its lines. Forward-backward gives each line the probability of being good; weighted by the lengths of the
lines and calibrated on the training documents, these make the score of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.llm.common import slices, table, whole
from docreview.llm.langid import remainder
from docreview.llm.minhash import words_of

MAX_TRAINING_DOCS = 4000
"""Bound on the labelled documents the chain is fitted on, chosen by hash."""
ACCEPT = 0.7
STEPS = 120

_KIND = np.full(256, 4, np.uint8)  # letters 0, capitals 1, digits 2, blanks 3, other signs 4, stops and commas 5
for _kind, _bytes in ((0, bytes(range(97, 123)) + bytes(range(128, 256))), (1, bytes(range(65, 91))), (2, b"0123456789"),
                      (3, b" \t\n\x0b\x0c\r"), (5, b".,")):
    _KIND[list(_bytes)] = _kind
KINDS = 6
FEATURES = KINDS + 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features per line (own, previous, next, constant), line lengths, and the line at which each text starts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - begins
    kinds = _KIND[data]
    own = np.zeros((len(ends), FEATURES))
    for k in range(KINDS):
        own[:, k] = np.add.reduceat((kinds == k).astype(np.int32), begins)
    own[:, 3] -= 1  # the line end
    own[:, :KINDS] /= np.maximum(sizes, 1)[:, None]
    starts, stops, hashes = words_of(data)
    line = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(line, minlength=len(ends))
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    signs = kinds[stops - 1] == 4 if len(stops) else np.zeros(0)
    lone = (stops - starts) == 1
    each = np.maximum(words, 1)
    at = KINDS
    for values in (same, signs, lone & (kinds[starts] == 4) if len(starts) else np.zeros(0), (stops - starts) / 10.0):
        own[:, at] = np.bincount(line, weights=np.asarray(values, float), minlength=len(ends)) / each
        at += 1
    own[:, at] = np.log1p(sizes) / 6
    own[:, at + 1] = np.log1p(words) / 4
    own[:, at + 2] = sizes == 0
    first = np.searchsorted(begins, np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[np.append(first[1:], len(ends)) - 1] = 0, 0
    return np.hstack((own, before, after, np.ones((len(ends), 1)))), sizes, first


def features_by_parts(texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`line_features` of texts of any number, about `limit` bytes at a time: only the features of all are held."""
    parts, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit or i == len(texts) - 1:
            parts.append(line_features(texts[start:i + 1]))
            start, held = i + 1, 0
    lines = np.cumsum([0, *[len(p[1]) for p in parts]])[:-1]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
            np.concatenate([p[2] + at for p, at in zip(parts, lines)]))


@dataclass
class Chain:
    """Weights of "good" per feature, and of transitions between bad (0) and good (1); then scale and shift of the score."""

    weights: np.ndarray
    moves: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per line P(good), and per transition into a line the joint of both states (zero at the first line)."""
        n = len(features)
        emit = np.stack((np.zeros(n), features @ self.weights), axis=1)
        sizes = np.diff(np.append(first, n))
        order = np.argsort(-sizes, kind="stable")
        start, length = first[order], sizes[order]
        active = [int(k) for k in np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")]
        forward, backward = emit.copy(), np.zeros((n, 2))
        for t in range(1, len(active)):
            now = start[:active[t]] + t
            forward[now] += np.logaddexp(forward[now - 1, 0:1] + self.moves[0], forward[now - 1, 1:2] + self.moves[1])
        for t in range(len(active) - 1, 0, -1):
            now = start[:active[t]] + t
            ahead = emit[now] + backward[now]
            backward[now - 1] = np.logaddexp(self.moves[:, 0] + ahead[:, 0:1], self.moves[:, 1] + ahead[:, 1:2])
        both = forward + backward
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        joint = np.zeros((n, 2, 2))
        inner = np.ones(n, bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        if len(at):
            raw = forward[at - 1, :, None] + self.moves + (emit[at] + backward[at])[:, None, :]
            raw = np.exp(raw - raw.max(axis=(1, 2), keepdims=True))
            joint[at] = raw / raw.sum(axis=(1, 2), keepdims=True)
        return good, joint

    def raw_scores(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of P(good) as log odds; an empty line weighs as one character."""
        features, sizes, first = features_by_parts(texts)
        good, _ = self.marginals(features, first)
        weight = np.maximum(sizes, 1).astype(float)
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw_scores(texts) + self.shift, -500, 500)))


def train_chain(texts: list[bytes], labels: np.ndarray, steps: int = STEPS) -> Chain:
    """Maximum likelihood with a little shrinkage, by Adam over all documents; deterministic."""
    features, _, first = features_by_parts(texts)
    sizes = np.diff(np.append(first, len(features)))
    target = np.repeat(labels, sizes)
    inner = np.ones(len(features), bool)
    inner[first] = False
    empirical = np.zeros((2, 2))
    for label in (0, 1):
        empirical[label, label] = (inner & (target == label)).sum()
    share = 1.0 / len(first)
    # Both classes weigh the same, and so does every document whatever its number of lines.
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    per_line = np.repeat(balance / np.sqrt(sizes), sizes) * share
    empirical = np.array([[(per_line * (inner & (target == a))).sum() if a == b else 0.0 for b in (0, 1)] for a in (0, 1)])
    values = np.zeros(features.shape[1] + 4)
    mean, spread = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        chain = Chain(values[:-4], values[-4:].reshape(2, 2))
        good, joint = chain.marginals(features, first)
        slope = np.concatenate((features.T @ (per_line * (target - good)), (empirical - (joint * per_line[:, None, None]).sum(axis=0)).ravel()))
        slope -= 1e-4 * values
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope ** 2
        values = values + 0.3 * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    chain = Chain(values[:-4], values[-4:].reshape(2, 2))
    # Calibration: logistic regression of the label on the raw score, shrunk towards scale 1.
    raw = chain.raw_scores(texts)
    beta = np.array([1.0, 0.0])
    design = np.stack((raw, np.ones_like(raw)), axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.eye(2)
        beta = beta + np.linalg.solve(hessian, design.T @ (labels - p) - (beta - np.array([1.0, 0.0])))
    chain.scale, chain.shift = float(beta[0]), float(beta[1])
    return chain


def thinned(rows: DataFrame) -> DataFrame:
    """The rows with the MAX_TRAINING_DOCS smallest hashes of doc_id, all if there are fewer, and rows of the same hash as
    the last. Rows thinned already stay as they are."""
    order = F.xxhash64("doc_id")
    last = rows.select(order.alias("h")).orderBy("h").limit(MAX_TRAINING_DOCS).agg(F.max("h")).first()[0]
    return rows.filter(order <= F.lit(last).cast("long"))


def fit(labelled: DataFrame) -> Chain | None:
    """Chain fitted on `labelled(doc_id, text, quality)`, at most about MAX_TRAINING_DOCS of its rows, chosen by hash."""
    sample = thinned(labelled.filter("quality IS NOT NULL")).select(whole("text").cast("binary").alias("text"), "quality")
    held = sample.limit(2 * MAX_TRAINING_DOCS).toArrow()
    if not held.num_rows:
        return None
    order = sorted(range(held.num_rows), key=lambda i: (held["text"][i].as_py(), held["quality"][i].as_py()))
    return train_chain([held["text"][i].as_py() for i in order], np.array([float(held["quality"][i].as_py() > 0) for i in order]))


def score(docs: DataFrame, chain: Chain | None, keep_text: bool = False) -> DataFrame:
    """(row, score[, text]) of `docs(row, text)`; null and empty texts are one empty line, and empty in the result.

    Without labels every score is 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 1)):
            texts = batch.column(1).to_pylist()
            scores = np.full(len(texts), 0.5) if held.value is None else held.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[1:1 + keep_text]],
                                             ["row", "score", *["text"] * keep_text])

    work = docs.select("row", whole("text").cast("binary").alias("text"))
    scored = work.mapInArrow(run, f"row {work.schema['row'].dataType.simpleString()}, score double{', text binary' * keep_text}")
    return scored.withColumn("text", F.col("text").cast("string")) if keep_text else scored


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: documents with a label whose remainder is not 2. Labels that name a document twice count twice."""
    wanted = labels.select("doc_id", "quality").filter((remainder(F.col("doc_id"), 4) != 2) & F.col("quality").isNotNull())
    # About MAX_TRAINING_DOCS rows, so a bounded broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(thinned(wanted)), "doc_id")


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chain = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    found = score(docs.select(F.struct("doc_id").alias("row"), "text"), chain)
    return found.select("row.doc_id", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
