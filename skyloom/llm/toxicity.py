"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples; a text's vector is
``(1 + ln tf) idf (1 + chi)`` over them, with document frequencies counted over
all documents and ``chi`` the root of the word's chi-square with the label over the
examples, so that words that go with the label weigh more and none is dropped.
The examples are ordered so that alike ones share blocks, and for each term and
block the index keeps the largest weight (for the commonest terms, all weights).
A query's bound for a block is its dot product with these; blocks are opened
from the highest bound down until no bound can reach the k-th best cosine, so the
k nearest are exact.  They vote with the weight of their nearness, and a logistic
curve fitted on leave-one-out votes of the examples calibrates the score.  The nearest examples and the terms are the evidence.

``max_labelled`` bounds the labelled texts used as examples (those with the
smallest seeded hashes), from which one task chooses the terms and one fits the
index and the votes; everything else covers all documents.

Defined cases: null and empty texts and texts without any word of an example
have no neighbours and the smoothed rate of examples without words; ties in
cosine go to the smaller example; labels that are null, or neither 0 nor 1, or
without a document are left out; of examples that repeat an id each different
text counts once; without labels of both kinds every score is the smoothed share;
repeated documents, and rows with equal or null ids, get one row each; ids of
examples are numbers (others raise); very long texts are read whole; an empty
table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import materialize, summed_table, table_rows
from .quality import held_out_of, labelled_sample

BLOCK = 64
COUNT_BLOCKS = 16
#: At most so many lists are rows of the table.
TABLE_ROWS = 512


def _words(buf: np.ndarray, offs: np.ndarray):
    for a, b in t.chunks(offs):
        part = t.LOWER[buf[offs[a] : offs[b]]]
        starts, ends, first = t.words(part, offs[a : b + 1] - offs[a], t.ALNUM)
        yield a, b, part, starts, ends, first, t.word_hashes(part, starts, ends)


class Terms:
    """All words of the examples by hash, with how much each one weighs."""

    def __init__(self, hashes: np.ndarray, words: pa.Array, weight: np.ndarray) -> None:
        self.hash, self.words, self.weight = hashes, words, weight
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hash >> t.U(44)).astype(np.int64)] = True

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and how often, ascending."""
        out: list[tuple[np.ndarray, ...]] = []
        if len(self.hash):
            for a, _, _, _, _, first, h in _words(buf, offs):
                may = np.flatnonzero(self.seen[(h >> t.U(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
                ok = self.hash[at] == h[may]
                doc = np.searchsorted(first, may[ok], "right") - 1 + a
                key, n = np.unique(doc * len(self.hash) + at[ok], return_counts=True)
                out.append((key // len(self.hash), key % len(self.hash), n))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def vectors(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Unit vectors: the terms of each document and their weights."""
        return self.unit(*self.counts(buf, offs), len(offs) - 1)

    def unit(self, doc: np.ndarray, term: np.ndarray, n: np.ndarray, docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
        weight = (1 + np.log(np.maximum(n, 1))) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, weight * weight, minlength=docs))
        cut = np.searchsorted(doc, np.arange(docs + 1))
        weight = weight / norm[doc]
        return [(term[a:b], weight[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def chi_square(n: np.ndarray, n1: np.ndarray, total: int, total1: float) -> np.ndarray:
    """How far words go with the label: ``n`` of ``total`` examples have a word, ``n1`` of them among the ``total1`` of label 1."""
    expect = n * total1 / total
    spread = expect * (1 - total1 / total) * (total - n) / max(1, total - 1)
    return np.where(spread > 0, np.maximum(np.abs(n1 - expect) - 0.5, 0) ** 2 / np.maximum(spread, 1e-12), 0.0)


def all_terms(hashes: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the examples, and 1 and the root of its chi-square."""
    if not len(y):
        return np.empty(0, np.uint64), np.empty(0)
    every, back = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.bincount(back, minlength=len(every)).astype(np.float64)
    n1 = np.bincount(back, np.repeat(y, [len(h) for h in hashes]), minlength=len(every))
    return every, 1 + np.sqrt(chi_square(n, n1, len(y), y.sum()))


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the ranges, and which range each is of."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) + (start - np.cumsum(n) + n)[which], which


class BlockMax:
    """Inverted lists of the examples in blocks.

    The lists of the commonest terms, in a twelfth of the examples or more, are
    rows of a table over all examples, so that a product gives their part of every
    cosine.  Each other term has a cell, with its largest weight, for each block
    that it is in.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, labels: np.ndarray, n_terms: int) -> None:
        keep = [i for i, (term, _) in enumerate(vectors) if len(term)]
        if keep:  # alike: the same commonest word, so mostly one language, and sizes
            often = np.bincount(np.concatenate([vectors[i][0] for i in keep]), minlength=n_terms)
            lead = [int(vectors[i][0][np.argmax(often[vectors[i][0]])]) for i in keep]
            keep = [keep[i] for i in np.lexsort((names[keep], [len(vectors[i][0]) for i in keep], lead))]
        self.names, self.labels = names[keep], labels[keep].astype(np.float64)
        self.blocks = -(-len(keep) // BLOCK)
        self.vectors, self.n_terms = [vectors[i] for i in keep], n_terms
        if not keep:
            return
        common = np.argsort(-often, kind="stable")[:TABLE_ROWS]
        common = common[often[common] * 12 >= len(keep)]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        term, weight = (np.concatenate([v[i] for v in self.vectors]) for i in (0, 1))
        member = np.repeat(np.arange(len(keep)), [len(x) for x, _ in self.vectors])
        row = self.row[term]
        self.table = np.zeros((len(common), self.blocks * BLOCK))
        self.table[row[row >= 0], member[row >= 0]] = weight[row >= 0]
        term, weight, member = term[row < 0], weight[row < 0], member[row < 0]
        order = np.lexsort((member, term))
        term, self.member, self.weight = term[order], member[order], weight[order]
        cell = term * self.blocks + self.member // BLOCK
        lead = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block, self.top = self.member[lead] // BLOCK, np.maximum.reduceat(self.weight, lead) if len(lead) else weight
        self.post = np.append(lead, len(cell))
        self.cells = np.searchsorted(term[lead], np.arange(n_terms + 1))

    def __reduce__(self):
        """Only the vectors are sent; who gets them builds the lists anew."""
        sizes = np.array([len(x) for x, _ in self.vectors], np.int64)
        term, weight = (np.concatenate([v[i] for v in self.vectors]) if len(sizes) else np.empty(0) for i in (0, 1))
        return _sent, (term.astype(np.int32), weight, sizes, self.names, self.labels, self.n_terms)

    def common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the commonest terms add to each query's cosine with every example."""
        if not self.blocks:
            return np.zeros((len(vectors), 0))
        query = np.zeros((len(vectors), len(self.table)))
        for q, (term, weight) in zip(query, vectors, strict=True):
            row = self.row[term]
            q[row[row >= 0]] = weight[row >= 0]
        return query @ self.table

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine over 0 (ties: the smaller name) and their cosines."""
        best, score = np.empty(0, np.int64), np.empty(0)
        if not self.blocks:
            return best, score
        common = self.common([(term, weight)])[0] if common is None else common
        at, which = _ranges(self.cells[term], self.cells[term + 1])
        block, weight = self.block[at], weight[which]
        bound = common.reshape(-1, BLOCK).max(1) + np.bincount(block, weight * self.top[at], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        done, step, end = 0, 4, int((bound > 0).sum())
        while done < end and (len(best) < k or bound[order[done]] >= score[-1] - 2e-12):
            now = order[done : min(done + step, end)]
            done, step = done + step, 2 * step
            opened = np.zeros(self.blocks, bool)
            opened[now] = True
            some = np.flatnonzero(opened[block])
            post, cell = _ranges(self.post[at[some]], self.post[at[some] + 1])
            cos = common + np.bincount(self.member[post], weight[some][cell] * self.weight[post], minlength=len(common))
            found = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = found[(cos[found] > 0) & (found != skip)]
            best, score = np.concatenate([best, found]), np.concatenate([score, np.round(cos[found], 12)])
            if len(best) > k:
                some = score >= np.partition(score, len(score) - k)[len(score) - k]
                best, score = best[some], score[some]
            first = np.lexsort((self.names[best], -score))[:k]
            best, score = best[first], score[first]
        return best, score


def _sent(term: np.ndarray, weight: np.ndarray, sizes: np.ndarray, names: np.ndarray, labels: np.ndarray, n_terms: int) -> BlockMax:
    cut = np.cumsum(sizes)[:-1]
    vectors = list(zip(np.split(term.astype(np.int64), cut), np.split(weight, cut), strict=True)) if len(sizes) else []
    return BlockMax(vectors, names, labels, n_terms)


class Votes:
    """Distance-weighted votes and their calibration."""

    def __init__(self, index: BlockMax, no_terms: np.ndarray, labels: np.ndarray, k: int) -> None:
        self.index, self.k = index, k
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
        self.bare = (no_terms.sum() + 0.5 * self.prior) / (len(no_terms) + 0.5)
        self.both = len(np.unique(labels)) == 2
        self.a, self.b = 4.0, -2.0
        if self.both and len(index.names) >= 20:
            left_out = []
            for a in range(0, len(index.vectors), BLOCK):
                own = index.vectors[a : a + BLOCK]
                left_out += [self._vote(*index.nearest(*x, k, skip=a + i, common=c)) for i, (x, c) in enumerate(zip(own, index.common(own), strict=True))]
            self._fit(np.array(left_out), index.labels)

    def _vote(self, who: np.ndarray, cos: np.ndarray) -> float:
        cos = np.minimum(cos, 1.0)
        w = cos**3 / (1.05 - cos)  # far neighbours hardly move the vote from the prior
        return float((w @ self.index.labels[who] + 0.5 * self.prior) / (w.sum() + 0.5))

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the vote, with smoothed targets and a little ridge, by Newton's method."""
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        p = np.array([self.a, self.b])
        z = np.stack([x, np.ones(len(x))], 1)
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (s * (1 - s))[:, None]) + 1e-2 * np.eye(2), z.T @ (s - target) + 1e-2 * (p - [4.0, -2.0]))
            p = p - step
            if np.abs(step).max() < 1e-9:
                break
        if p[0] > 0:
            self.a, self.b = p

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        for a in range(0, len(vectors), BLOCK):
            own = vectors[a : a + BLOCK]
            for x, c in zip(own, self.index.common(own), strict=True):
                who, cos = self.index.nearest(*x, self.k, common=c) if self.both and len(x[0]) else ((), ())
                if len(who):
                    yield float(1 / (1 + np.exp(-np.clip(self.a * self._vote(who, cos) + self.b, -30, 30)))), self.index.names[who].tolist()
                else:
                    yield float(self.bare if self.both else self.prior), []


class Packed:
    """A pickled object that is unpacked where it is first used."""

    def __init__(self, data: bytes) -> None:
        self.data, self.made = data, None

    def __reduce__(self):
        return Packed, (self.data,)

    def get(self):
        if self.made is None:
            self.made = pickle.loads(self.data)
        return self.made


class Examples:
    """The bounded sample in one task: ids, labels, word hashes and counts, in one order whatever the order of the rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        keys, y, hashes, times, self.word = [], [], [], [], {}
        for batch in batches:
            keys += batch.column("_key").to_pylist()
            y += batch.column("_y").to_pylist()
            for _, _, part, starts, ends, first, h in _words(*t.ragged(batch.column("_text"))):
                raw = part.tobytes()
                u, at = np.unique(h, return_index=True)
                for x, i in zip(u.tolist(), at.tolist(), strict=True):
                    if x not in self.word:
                        self.word[x] = raw[starts[i] : ends[i]].decode("utf-8", "replace")
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    u, n = np.unique(h[i:j], return_counts=True)
                    hashes.append(u)
                    times.append(n.astype(np.int32))
        order = sorted(range(len(keys)), key=lambda i: (keys[i], y[i], hashes[i].tobytes(), times[i].tobytes()))
        self.keys, self.y = np.array([keys[i] for i in order], np.int64), np.array([y[i] for i in order], np.float64)
        self.hashes, self.times = [hashes[i] for i in order], [times[i] for i in order]


def _in_one_task(sample: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> dict:
    """The one row that ``run`` makes of all rows of the sample, which its bound lets one task hold."""
    rows = sample.repartition(1).mapInArrow(run, schema).toArrow().to_pylist()
    return rows[0] if rows else next(run(iter(()))).to_pylist()[0]  # a plan without rows may have no task


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = Examples(batches)
    every, weight = all_terms(e.hashes, e.y)
    yield pa.RecordBatch.from_pydict({"hashes": [every.tobytes()], "weight": [weight.tobytes()], "words": pa.array([[e.word[x] for x in every.tolist()]], pa.list_(pa.string()))})


def _fit(weighed, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, terms = Examples(batches), weighed.value
        sizes = np.array([len(h) for h in e.hashes], np.int64)
        place = np.searchsorted(terms.hash, np.concatenate(e.hashes)) if len(sizes) else np.empty(0, np.int64)
        own = terms.unit(np.repeat(np.arange(len(sizes)), sizes), place, np.concatenate(e.times) if len(sizes) else place, len(sizes))
        votes = Votes(BlockMax(own, e.keys, e.y, len(terms.hash)), e.y[sizes == 0], e.y, k)
        data = pickle.dumps(votes)
        del e, own, votes
        t.release()
        yield pa.RecordBatch.from_pydict({"votes": pa.array([data], pa.binary())})

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Callable[[Column], Column] | None = None, max_labelled: int = 6000, k: int = 15) -> DataFrame:
    """Per document: ``doc_id, score, predicted``, its nearest examples (``neighbours``) and its ``terms``."""
    sc = docs.sparkSession.sparkContext
    sample = materialize(labelled_sample(docs, labels, doc_id, text, label, learn or (lambda _: F.lit(True)), max_labelled))
    chosen = _in_one_task(sample, _choose, "hashes binary, weight binary, words array<string>")
    terms = Terms(np.frombuffer(chosen["hashes"], np.uint64), pa.array(chosen["words"], pa.string()), np.frombuffer(chosen["weight"]).copy())
    del chosen
    known = sc.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(known.value.hash) + 1)
        for batch in batches:
            _, term, _ = known.value.counts(*t.ragged(batch.column(0)))
            n[:-1] += np.bincount(term, minlength=len(n) - 1)
            n[-1] += batch.num_rows
        if n[-1]:
            yield table_rows(n, COUNT_BLOCKS)

    found = summed_table(docs.select(text).mapInArrow(frequencies, "block int, sums binary"), COUNT_BLOCKS)
    found = found if len(found) else np.zeros(len(terms.hash) + 1)
    known.unpersist()
    terms.weight *= np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    weighed = sc.broadcast(terms)
    del terms
    votes = sc.broadcast(Packed(_in_one_task(sample, _fit(weighed, k), "votes binary")["votes"]))
    t.release()
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = weighed.value.vectors(*t.ragged(batch.column("_text")))
            got = list(votes.value.get().scores(own))
            cut = np.concatenate(([0], np.cumsum([len(x) for x, _ in own]))).astype(np.int32)
            flat = weighed.value.words.take(pa.array(np.concatenate([x for x, _ in own]) if own else cut[:0], pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id"), "score": pa.array([s for s, _ in got], pa.float64()), "neighbours": pa.array([n for _, n in got], pa.list_(pa.int64())),
                "terms": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), flat),
            })

    kind = plain.schema["_id"].dataType.simpleString()
    out = plain.mapInArrow(scored, f"_id {kind}, score double, neighbours array<long>, terms array<string>")
    return out.select(F.col("_id").alias(doc_id), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "terms")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, labels, learn=lambda key: ~held_out_of(key, 5, 0))
    return out.select("doc_id", held_out_of(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "neighbours")
