"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Random indexing gives each word a fixed sparse random index vector; a word's
meaning vector is the sum of the index vectors of its neighbours over *all*
documents.  Words are runs of letters and digits as they are written, and runs of
other signs; a word that repeats the one before it is read as a ditto, a word of
its own.  All others share ``ROWS`` hashed rows, so the table has one size whatever
the corpus, and each task sums its part before the shuffle.  A document is the
mean of its words' vectors and nothing else; a two-layer numpy network scores
it, and a temperature fitted on rows that the network has not seen calibrates
the probability.

``max_labelled`` bounds the labelled texts that the network is fitted on (those
with the smallest seeded hashes); everything else covers all documents.

Defined cases: null and empty texts have the zero vector and its score; labels
that are null, or neither 0 nor 1, or without a document are left out; a
document with several labels counts once for each, and of rows that repeat an
id each different text counts once; without labels of both kinds the score is
the smoothed share of label 1; repeated documents get one row each; a null id is
not held out and has no label; ties in the sample's hash go to the smaller id,
label and text hash; very long texts are pooled whole, chunk by chunk of
documents; an empty table gives an empty result; further columns, whatever
their names, are ignored, or carried if ``keep`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import summed_table, table_rows

ROWS, DIM, BLOCKS, REACH = 1 << 14, 32, 16, 2
_rng = np.random.default_rng(7)
_AT = _rng.integers(0, DIM, (1 << 20, 2))
_SIGN = _rng.choice([-1, 1], (1 << 20, 2)).astype(np.float64)

#: Kinds of bytes: 0 white space, 1 letters, digits and bytes of non-ASCII characters, 2 other signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[~t.NONSPACE] = 0
_KIND[t.ALNUM] = _KIND[65:91] = 1


def units(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words, which are runs of one kind of bytes, and each document's first word.

    A word that repeats the one before it (signs aside) is read as the ditto, the last row.
    """
    if not len(part):
        return np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[part]
    new = np.ones(len(part) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offs] = True
    at = np.flatnonzero(new)
    starts, ends = at[:-1], at[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    first = np.searchsorted(starts, offs)
    h = t.word_hashes(part, starts, ends)
    word = (h % t.U(ROWS)).astype(np.int64)
    plain = np.flatnonzero(kind[starts] == 1)
    again = np.flatnonzero(h[plain[1:]] == h[plain[:-1]]) + 1
    doc = np.searchsorted(first, plain, "right")
    word[plain[again[doc[again] == doc[again - 1]]]] = ROWS
    return word, first


def _neighbours(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the table and what to add there, for every pair of neighbours."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    to, by = [], []
    for gap in range(1, REACH + 1):
        ok = doc[gap:] == doc[:-gap]
        a, b = word[:-gap][ok], word[gap:][ok]
        to += [a, b]
        by += [b, a]
    to, by = np.concatenate(to), np.concatenate(by)
    return np.concatenate([to * DIM + _AT[by, 0], to * DIM + _AT[by, 1]]), np.concatenate([_SIGN[by, 0], _SIGN[by, 1]])


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """The meaning vectors of all rows, from every document; a table of fixed size (2 MB)."""
    cells = (ROWS + 1) * DIM

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(cells), False
        for batch in batches:
            buf, offs = t.ragged(batch.column(0))
            for a, b in t.chunks(offs, t.CHUNK // 2):
                word, first = units(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if len(word):
                    at, add = _neighbours(word, first)
                    table += np.bincount(at, add, minlength=cells)
                    some = True
            t.release()
        if some:
            yield table_rows(table, BLOCKS)

    return normalised(summed_table(docs.select(text).mapInArrow(gather, "block int, sums binary"), BLOCKS))


def normalised(table: np.ndarray) -> np.ndarray:
    """Unit vectors less their mean, weighed by how often the words are."""
    table = table.reshape(-1, DIM) if len(table) else np.zeros((ROWS + 1, DIM))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    mean = table.sum(0) / max(1.0, norm.sum())
    return (table / np.maximum(norm, 1e-9) - mean * (norm > 0)).astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row per document: the mean of its words' vectors."""
    out = np.zeros((len(offs) - 1, DIM), np.float32)
    for a, b in t.chunks(offs, t.CHUNK // 2):
        word, first = units(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        n = np.diff(first)
        some = np.flatnonzero(n)
        if len(some):
            out[a + some] = np.add.reduceat(vectors[word], first[:-1][some], axis=0) / n[some, None]
    return out


class Network:
    """Two layers (tanh, sigmoid) over standardised inputs, fitted by Adam, calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 3) -> None:
        self.prior = (y.sum() + 1.0) / (len(y) + 2.0)
        self.fitted = len(np.unique(y)) == 2 and len(y) >= 10
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        cut = max(1, len(y) // 5)
        self.mean, self.std = x[cut:].mean(0), x[cut:].std(0) + 1e-6
        z, v = self._scale(x[cut:]), y[cut:]
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        weight = np.where(v > 0, 0.5 / max(v.mean(), 1e-9), 0.5 / max(1 - v.mean(), 1e-9))
        weight = np.minimum(weight, 10.0)
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(v)), max(1, len(v) // 128)):
                a = np.tanh(z[idx] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - v[idx]) * weight[idx] / len(idx)
                back = np.outer(err, p[2]) * (1 - a**2)
                step += 1
                for i, g in enumerate((z[idx].T @ back + 1e-4 * p[0], back.sum(0), a.T @ err + 1e-4 * p[2], np.array([err.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    p[i] = p[i] - 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logit, v = self._logit(x[:cut]), y[:cut]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, np.where(v > 0, -logit, logit) / k)) for k in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._scale(x.astype(np.float64)) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learn: Callable[[Column], Column], limit: int) -> DataFrame:
    """``_key, _y, _text``: at most ``limit`` different learnable texts with their labels, those with the smallest seeded hashes.

    The bound holds for the labels before the join, so that they are a bounded
    broadcast, and again for the texts after it, as an id may have many rows.
    """
    key = F.col(doc_id)
    rows = labels.filter(key.isNotNull() & F.col(label).isin(0, 1) & learn(key)).select(key.alias("_key"), F.col(label).cast("int").alias("_y")).distinct()
    chosen = rows.orderBy(F.xxhash64(F.lit("sample"), "_key"), "_key", "_y").limit(limit)
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_key"))
    texts = found.select("_key", "_y", "_text", F.xxhash64("_text").alias("_h")).dropDuplicates(["_key", "_y", "_h"])
    return texts.orderBy(F.xxhash64(F.lit("sample"), "_key"), "_key", "_y", "_h").limit(limit).select("_key", "_y", "_text")


def held_out_of(key: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``which``; a null id does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == which, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Callable[[Column], Column] | None = None, max_labelled: int = 6000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``score`` (probability of label 1) and ``predicted``, with ``doc_id`` and the columns of ``keep``."""
    sc = docs.sparkSession.sparkContext
    vectors = word_vectors(docs.select(text), text)
    table = sc.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(table.value, *t.ragged(batch.column(0)))
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary()), "y": batch.column(1), "k": batch.column(2)})

    sample = labelled_sample(docs, labels, doc_id, text, label, learn or (lambda _: F.lit(True)), max_labelled)
    rows = sorted(sample.select("_text", "_y", F.xxhash64("_key").alias("_k")).mapInArrow(features, "x binary, y int, k long").collect(), key=lambda r: (r.k, r.y, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, DIM)
    net = sc.broadcast(Network(x, np.array([r.y for r in rows], np.float64)))
    plain = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    names = [c for c in plain.columns if c != "_text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in names) + ", score double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c) for c in names}
            t.release()
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(net.value.score(pooled(table.value, *t.ragged(batch.column("_text")))))})

    out = plain.mapInArrow(scored, schema)
    return out.select(F.col("_id").alias(doc_id), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c != doc_id), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify_quality(docs, labels, learn=lambda key: ~held_out_of(key, 3, 1))
    return out.select("doc_id", held_out_of(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
