"""Quality by the votes of labelled neighbours in a latent-semantic space.

A text is a bag of hashed features: its words, and its character shapes (grams of four characters in which letters, capitals and digits
are classes and other marks stand for themselves, and words that repeat the word before). Logarithmic counts by inverse
document frequencies are projected on the leading singular vectors of a bounded, labelled sample. The sample's vectors are
broadcast; a task multiplies blocks of its documents with all of them, and the nearest ones vote with the weight of their cosine."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words as W
from evidara.llm.session import few, plain, prepare, table

#: The labelled sample: at most so many documents, the first in hash order, each read whole. It bounds the driver's matrix (LABELLED x FEATURES floats) and what is broadcast (LABELLED x AXES floats).
LABELLED = 4096
#: Buckets of word and of shape features, and the axes kept.
WORDS, SHAPES, AXES = 2048, 2048, 48
#: Neighbours that vote; all at the cosine of the last one do.
NEIGHBOURS = 24
#: A cosine's weight is its power: near neighbours count most.
SHARPNESS = 4
#: Documents whose products are worked out at once, and the bytes of one text whose shapes are.
BLOCK, PIECE = 256, 1 << 22
THRESHOLD = 0.3
FEATURES = WORDS + SHAPES


@functools.cache
def _classes() -> np.ndarray:
    """A class for every byte: lower-case and other letters a, capitals A, digits 0, white space a space; marks are themselves."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[0x80:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[9, 10, 11, 12, 13]] = 32
    return out


def _bucket(codes: np.ndarray, n: int) -> np.ndarray:
    return (W.mix(codes.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % n


def counts(texts: pa.Array) -> np.ndarray:
    """Feature counts of each text, a row each; null texts have none. A text is read whole."""
    w = W.layout(texts)
    n = len(w.offsets) - 1
    out = np.zeros((n, FEATURES), dtype=np.float32)
    doc = np.repeat(np.arange(n), np.diff(w.first))
    h = w.hashes()
    bucket = _bucket(h, WORDS)
    out[:, :WORDS] = np.bincount(doc * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    repeats = np.bincount(doc[again], minlength=n)
    out[:, WORDS] = repeats  # the first two buckets of shapes are those of repeats: how many, and their share in thousandths
    out[:, WORDS + 1] = 1000 * repeats / np.maximum(np.diff(w.first), 1)
    for lo in range(0, len(w.data), PIECE):
        c = _classes()[w.data[lo : lo + PIECE + 3]]
        if len(c) < 4:
            continue
        gram = (c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:]
        at = np.arange(lo, lo + len(gram))
        mine = np.searchsorted(w.offsets, at, side="right") - 1
        inside = at + 4 <= w.offsets[mine + 1]
        first, last = int(mine[0]), int(mine[-1])
        key = (mine[inside] - first) * SHAPES + 2 + _bucket(gram[inside], SHAPES - 2)
        out[first : last + 1, WORDS:] += np.bincount(key, minlength=(last - first + 1) * SHAPES).reshape(-1, SHAPES)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


class Space:
    """Weights and axes fitted on the counts of a sample, and the sample's vectors with their labels (0 to 1)."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray):
        seen = (sample > 0).sum(axis=0)
        self.weight = np.log((1 + len(sample)) / (1 + seen)).astype(np.float32)
        x = self._weighted(sample)
        rng = np.random.default_rng(7)
        k = min(AXES, len(sample))
        q = np.linalg.qr(x.T @ rng.standard_normal((len(x), k + 8)).astype(np.float32))[0]
        for _ in range(4):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, v = np.linalg.svd(x @ q, full_matrices=False)
        self.axes = (q @ v.T)[:, :k].astype(np.float32)
        self.labels = labels.astype(np.float64)
        self.vectors = unit(x @ self.axes)
        self.mean = float(labels.mean())

    def _weighted(self, c: np.ndarray) -> np.ndarray:
        return unit(np.log1p(c) * self.weight)

    def project(self, c: np.ndarray) -> np.ndarray:
        return unit(self._weighted(c) @ self.axes)

    def score(self, c: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each row's nearest labelled vectors; the sample's share for rows without features."""
        out = np.full(len(c), self.mean)
        k = min(NEIGHBOURS, len(self.labels))
        for lo in range(0, len(c), BLOCK):
            cosine = self.project(c[lo : lo + BLOCK]) @ self.vectors.T
            last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
            w = np.where(cosine >= last, np.maximum(cosine, 0).astype(np.float64) ** SHARPNESS, 0)
            total = w.sum(axis=1)
            out[lo : lo + BLOCK] = np.where(total > 0, (w @ self.labels) / np.where(total > 0, total, 1), self.mean)
        return np.clip(out, 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, label) of the labelled sample: non-null quality, crc32(doc_id) mod 5 other than 0; a doc_id with several labels has their mean."""
    n = plain(labels, "doc_id", "quality").where("doc_id is not null and quality is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    n = n.groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return plain(docs, "doc_id", "text").join(few(n, most), "doc_id").select("doc_id", "text", "label")


def _sampled(batches):
    for b in batches:
        for part in W.chunks([b], "text"):
            c = counts(part.column("text"))
            rows = [(np.flatnonzero(x), x[x > 0]) for x in c]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r[0].astype(np.int16) for r in rows], pa.list_(pa.int16())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "n"])


def fitted(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Space | None:
    rows = training_rows(docs, labels, most).withColumn("doc_id", F.col("doc_id").cast("string"))
    got = rows.mapInArrow(_sampled, "doc_id string, label double, at array<short>, n array<float>")
    got = got.dropDuplicates(["doc_id", "at", "n"]).orderBy(F.xxhash64("doc_id"), "doc_id", "at", "n").limit(most).toPandas()  # a repeated id may have other texts
    if got.empty:
        return None
    x = np.zeros((len(got), FEATURES), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.asarray(at, dtype=np.int64)] = n
    return Space(x, got["label"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null, empty and blank texts score the share of good labels in the sample, and 1 where nothing can be learned.
    Equal texts score alike; all labelled vectors that tie with the last neighbour vote; held_out is false for a
    null doc_id; very long texts are read whole; an empty table gives an empty table; other columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fitted(docs, labels, most))

    def run(batches):
        space = shared.value
        for part in W.chunks(batches, "text"):
            s = space.score(counts(part.column("text"))) if space else np.ones(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain(docs, "doc_id", "text").select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op13_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
