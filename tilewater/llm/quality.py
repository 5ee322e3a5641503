"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Every word gives its own hash, its pair with the word before, and the n-grams of word shapes (runs of letters, capitals, digits and
each kind of sign) and of repetitions, which carry over to words never seen. A document is the mean over its words, so a
score is a sparse dot product: the mean of the weights of its n-grams. Training takes at most TRAIN_ROWS labelled rows, those
with the smallest hash of the id, in one task; scoring runs over all rows where they lie.

Defined results: null and empty texts get the score of the bias alone; several labels of one id count as the smallest; rows without
a label or with null are not learnt; without any label the score is 0.5; rows are kept one to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.llm import tokens

BITS = 18
TRAIN_ROWS, EPOCHS = 6000, 2
#: FTRL: learning rate, its offset, L1 and L2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.01
SCALE = 8.0

#: fixed values: class of each byte for word shapes; a sign is its own class
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, a row for each word and a column for each n-gram ending there, and the first row of each text."""
    words, first, data, starts, ends = tokens.word_hashes(texts, tokens.BLANKS)
    n = len(words)
    if not n:
        return np.zeros((0, 6), np.int64), first
    shape = _SHAPE[data]
    turn = np.ones(len(data), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turn[starts] = True
    kept = np.flatnonzero(turn)
    forms = tokens.range_hashes(tokens._letters(False)[shape[kept]], np.searchsorted(kept, starts), np.searchsorted(kept, ends))
    long_word = (ends - starts) > 40
    forms = forms + long_word.astype(np.uint64)

    def back(values: np.ndarray, k: int) -> np.ndarray:
        """The value k words earlier in the same text, 0 before its start."""
        out = np.zeros(n, np.uint64)
        out[k:] = values[:-k] if k < n else []
        for j in range(k):
            at = first[:-1] + j
            out[at[(at < first[1:])]] = 0
        return out

    w1, f1, f2 = back(words, 1), back(forms, 1), back(forms, 2)
    again = (words == w1).astype(np.uint64) + np.uint64(2) * (words == back(words, 2)).astype(np.uint64)
    again += np.uint64(4) * (words == back(words, 3)).astype(np.uint64)
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    columns = [
        words, words * k[0] + w1 * k[1], forms + k[2], forms * k[0] + f1 * k[2],
        forms * k[1] + f1 * k[2] + f2 * k[0], again * k[0] + k[1],
    ]
    shift = np.uint64(64 - BITS)
    return np.stack([(tokens.mix(c + np.uint64(i)) >> shift).astype(np.int64) for i, c in enumerate(columns)], axis=1), first


def train(texts: list[str | None], labels: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) after EPOCHS passes over the rows as they come."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = []
    for _, run in tokens.chunks(texts):
        found, first = features(run)
        for a, b in zip(first[:-1], first[1:], strict=True):
            ids, counts = np.unique(found[a:b], return_counts=True)
            rows.append((np.append(ids, size - 1), np.append(counts * (SCALE / max(1, b - a)), 1.0).astype(np.float32)))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for (ids, x), y in zip(rows, labels, strict=True):
            w = weights(ids)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA * w
            n[ids] += g * g
    return weights(slice(None)).astype(np.float32)


def score_texts(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.full(len(texts), float(w[-1]))
    for at, run in tokens.chunks(texts):
        found, first = features(run)
        total = np.zeros(len(found) + 1)
        np.cumsum(w[found].sum(axis=1), out=total[1:])
        size = np.maximum(1, np.diff(first))
        out[at : at + len(run)] += SCALE * (total[first[1:]] - total[first[:-1]]) / size
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from labels (doc_id, quality) of rows of docs (doc_id, text)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most train_rows rows

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.slice(0, 2 * train_rows)
        order = np.argsort(np.array(tokens.mix(np.array(batch["doc_id"].to_pylist(), np.int64).view(np.uint64))), kind="stable")
        texts, y = batch["text"].to_pylist(), np.array(batch["quality"].to_pylist(), float)
        w = train([texts[i] for i in order], (y[order] > 0).astype(float))
        return pa.table({"w": pa.array([w.tobytes()], pa.binary())})

    learnt = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, "w binary").collect()
    return np.frombuffer(learnt[0].w, np.float32) if learnt else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, w: np.ndarray, *keep: str) -> DataFrame:
    """The `keep` columns of every row with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found, pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"{c} {docs.select(c).schema[0].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: learnt from rows that are not held out, scored for all."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    w = fit(docs, labels.where(~held))
    return score(docs.withColumn("held_out", held).select("doc_id", "held_out", "text"), w, "doc_id", "held_out").withColumn(
        "predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
