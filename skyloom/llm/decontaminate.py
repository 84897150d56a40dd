"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``window`` consecutive words, or the whole of a shorter
item) is the set of its positioned shingles.  A window is contained in a
document only if *all* its shingles are, so by the prefix-filter principle one
shingle per window must be joined, and the best one is the rarest.  Shingles are
therefore ordered by their frequency over all documents, the rarest shingle of
each window is looked up in the documents, length and positional bounds drop
starts that cannot hold the window, and what is left is verified word by word
and byte by byte over the item-sized window.

The benchmark is used in blocks of about ``BLOCK_BYTES`` of text, whatever its
size: a block is a broadcast of proven bound, and each block scans the documents
once for the frequencies and once for the search.  What a block but the last
finds is written as a narrow table of the documents with hits before its
broadcasts are destroyed, so driver and workers hold one block at a time.

Defined cases: null or empty texts have no words, no hits and no items; items
without words have no windows; repeated item rows count as one item id each
and items with equal texts all report; rows with a null item id take part in
hits but not in ``n_items``; repeated documents, and rows with equal or null ids,
get one row each, by their own texts; ties between rarest shingles go to the
smaller code and offset and change no result; very long texts are one numpy
buffer each, a longer item than a block is a block of its own; empty tables give
an empty result, or no hits; further columns, whatever their names, are ignored,
or carried if ``keep`` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import materialize

BLOCK_BYTES = 8 << 20
SHINGLE = 3


class Windows:
    """The distinct windows of a block of items, as ranges of one sequence of word ids, and their shingles."""

    def __init__(self, items: list[tuple[object, str]], window: int, shingle: int = SHINGLE) -> None:
        data = [(x or "").encode() for _, x in items]
        buf = t.LOWER[np.frombuffer(b"".join(data), np.uint8)]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
        del data
        starts, ends, first = t.words(buf, offs, t.ALNUM)
        raw = buf.tobytes()
        vocab: dict[bytes, int] = {}
        self.seq = np.fromiter((vocab.setdefault(raw[s:e], len(vocab)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int32, len(starts))
        self.text = np.frombuffer(b"".join(vocab), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in vocab]))).astype(np.int64)
        del vocab, raw
        hashes = t.word_hashes(self.text, self.at[:-1], self.at[1:])
        order = np.argsort(hashes)
        self.hash, self.hash_id = hashes[order], order.astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> t.U(44)).astype(np.int64)] = True
        # every place of a window: where it starts, its length, its item
        n = np.diff(first)
        count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
        length = np.minimum(n, window)[item]
        # the distinct ones, each as one of its places, and the items of each
        self.names = [None if x is None else str(x) for x, _ in items]
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = [np.empty((0, 2), np.int64)]
        for L in np.unique(length).tolist():
            own = np.flatnonzero(length == L)
            rows = np.ascontiguousarray(self.seq[start[own, None] + np.arange(L)]).view(np.dtype((np.void, 4 * L))).ravel()
            _, lead, which = np.unique(rows, return_index=True, return_inverse=True)
            pairs.append(np.unique(np.stack([which.ravel() + len(self.start), item[own]], 1), axis=0))
            self.start = np.concatenate([self.start, start[own][lead]])
            self.length = np.concatenate([self.length, np.full(len(lead), L)])
        pairs = np.concatenate(pairs)
        self.item, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.base = len(self.at)
        while self.base**shingle >= 1 << 63:  # codes of shingles stay exact in 64 bits
            shingle -= 1
        #: by width the code of the shingle at every place of the sequence (-1: it would leave its item)
        self.grams: dict[int, np.ndarray] = {}
        self.width = np.minimum(self.length, shingle)
        for k in np.unique(self.width).tolist():
            places, code = self.codes_at(self.seq.astype(np.int64), first, k)
            self.grams[k] = np.full(len(self.seq), -1, np.int64)
            self.grams[k][places] = code
        self.codes = {k: np.unique(c[c >= 0]) for k, c in self.grams.items()}

    def items(self, window: int) -> list[str]:
        own = (self.names[i] for i in self.item[self.items_at[window] : self.items_at[window + 1]].tolist())
        return [x for x in own if x is not None]

    def same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether words have the bytes that their ids have."""
        size = ends - starts
        good = size == self.at[ids + 1] - self.at[ids]
        some = np.flatnonzero(good)
        n = size[some]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = raw[np.repeat(starts[some], n) + step] == self.text[np.repeat(self.at[ids[some]], n) + step]
        good[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n) if len(some) else True
        return good

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The item vocabulary's id of each word hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        if len(self.hash):
            may = np.flatnonzero(self.seen[(h >> t.U(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
            ok = self.hash[at] == h[may]
            out[may[ok]] = self.hash_id[at[ok]]
        return out

    def codes_at(self, ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions, within one document each, whose ``k`` words are all known, and their codes."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ok = ids[:n] >= 0
        for j in range(1, k):
            ok &= ids[j : j + n] >= 0
            cut = first[1:-1] - j  # a gram from here would cross into the next document
            ok[cut[(cut >= 0) & (cut < n)]] = False
        at = np.flatnonzero(ok)
        code = np.zeros(len(at), np.int64)
        for j in range(k):
            code = code * self.base + ids[at + j] + 1
        return at, code


def _lookup(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted keys, and where."""
    if not len(keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == values)
    return hit, at[hit]


def _tokenized(batch: pa.RecordBatch, text: str):
    buf, offs = t.ragged(batch.column(text))
    for a, b in t.chunks(offs):
        part, o = t.LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
        starts, ends, first = t.words(part, o, t.ALNUM)
        yield a, b, part, starts, ends, first


def _frequencies(docs: DataFrame, text: str, shared) -> dict[int, np.ndarray]:
    """How often each shingle of the block's windows occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = shared.value
        total = {k: np.zeros(len(c), np.int64) for k, c in win.codes.items()}
        for batch in batches:
            for _, _, part, starts, ends, first in _tokenized(batch, text):
                ids = win.ids(t.word_hashes(part, starts, ends))
                for k, codes in win.codes.items():
                    _, code = win.codes_at(ids, first, k)
                    _, at = _lookup(codes, code)
                    total[k] += np.bincount(at, minlength=len(codes))
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k, np.int32)), "at": pa.array(at), "n": pa.array(n[at])})

    win = shared.value
    rows = docs.select(text).mapInArrow(count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()  # at most the block's shingles
    out = {k: np.zeros(len(c), np.int64) for k, c in win.codes.items()}
    for k, at, n in rows:
        out[k][at] = n
    return out


def _prefixes(win: Windows, freq: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each window its rarest shingle (ties: the smaller code, the smaller offset); postings sorted by code.

    A window with a shingle that no document has cannot occur and is left out.
    """
    out = {}
    for k, codes in win.grams.items():
        n = np.zeros(len(codes), np.int64)
        n[codes >= 0] = freq[k][np.searchsorted(win.codes[k], codes[codes >= 0])]
        own = np.flatnonzero(win.width == k)
        start, last = win.start[own], win.length[own] - k
        offset = np.zeros(len(own), np.int64)
        for j in range(1, int(last.max(initial=0)) + 1):
            here, best = start + np.minimum(j, last), start + offset
            better = (j <= last) & ((n[here] < n[best]) | ((n[here] == n[best]) & (codes[here] < codes[best])))
            offset[better] = j
        at = start + offset
        some = np.flatnonzero(n[at] > 0)
        some = some[np.argsort(codes[at[some]], kind="stable")]
        out[k] = (codes[at[some]], own[some], offset[some])
    return out


def _search(part, starts, ends, first, win: Windows, prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences: the position of a window's first word, and the window."""
    ids = win.ids(t.word_hashes(part, starts, ends))
    doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, (codes, window, offset) in prefixes.items():
        at, code = win.codes_at(ids, first, k)
        lo, hi = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        # every posting of the prefix shingle found at a position
        reps = n[hit]
        post = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(lo[hit], reps)
        pos, w, off = np.repeat(at[hit], reps), window[post], offset[post]
        # length and positional bounds: the window must lie inside the document
        doc = doc_of[pos]
        begin = pos - off
        ok = (begin >= first[doc]) & (begin + win.length[w] <= first[doc + 1])
        begin, w = begin[ok], w[ok]
        for L in np.unique(win.length[w]).tolist():
            own = win.length[w] == L
            b, x = begin[own], w[own]
            for j in range(L):
                good = ids[b + j] == win.seq[win.start[x] + j]
                b, x = b[good], x[good]
            places.append(b)
            which.append(x)
    places, which = np.concatenate(places), np.concatenate(which)
    if len(places):  # byte by byte, each word once
        size = win.length[which]
        inside = np.unique(np.repeat(places, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        wrong = inside[~win.same(part, starts[inside], ends[inside], ids[inside])]
        good = np.searchsorted(wrong, places) == np.searchsorted(wrong, places + size)
        places, which = places[good], which[good]
    return places, which


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list]:
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string"), text).filter(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def _merged(flat: list[int]) -> list[int]:
    """Ranges (start, end, start, end, ...) in order and joined where they touch."""
    out: list[int] = []
    for p, q in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and p <= out[-1]:
            out[-1] = max(out[-1], q)
        else:
            out += [p, q]
    return out


def _step(shared, prefixes, names: list[str], hits_only: bool):
    """Search one block in every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win, pre = shared.value, prefixes.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for a, b, part, starts, ends, first in _tokenized(batch, "_text"):
                places, which = _search(part, starts, ends, first, win, pre)
                order = np.argsort(places, kind="stable")
                places, which = places[order], which[order]
                bounds = np.searchsorted(places, first)
                for d in range(b - a):
                    lo, hi = bounds[d], bounds[d + 1]
                    at = places[lo:hi] - first[d]
                    n_words.append(int(first[d + 1] - first[d]))
                    spans.append(_merged(np.stack([at, at + win.length[which[lo:hi]]], 1).ravel().tolist()) if lo < hi else [])
                    items.append(sorted({x for w in set(which[lo:hi].tolist()) for x in win.items(w)}))
            out = {c: batch.column(c) for c in names} | {"_words": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))}
            out = pa.RecordBatch.from_pydict(out)
            yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and items of the last block and of those before it (a list for each) as one."""
    for batch in batches:
        spans, items, more_spans, more_items = (batch.column(c).to_pylist() for c in ("_spans", "_items", "_more_spans", "_more_items"))
        spans = [_merged(x + [v for one in y or [] for v in one]) for x, y in zip(spans, more_spans, strict=True)]
        items = [sorted(set(x).union(*(y or []))) for x, y in zip(items, more_items, strict=True)]
        cols = {c: batch.column(c) for c in batch.schema.names if not c.startswith("_more")}
        yield pa.RecordBatch.from_pydict(cols | {"_spans": pa.array(spans, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))})


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its words, the words inside any occurrence of a window, and the items with such windows.

    Returns ``doc_id``, the columns of ``keep`` (which may name the text),
    ``n_words``, ``n_hit``, ``hit_spans`` (start, end, start, end, ... in words)
    and ``item_ids`` (array<string>, sorted).
    """
    sc = docs.sparkSession.sparkContext
    # clear of any clashing names among the extra columns; a row is known by its id and text
    plain = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    carried = ["_id", "_h", *(f"_k{i}" for i in range(len(keep)))]
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    found = "_words long, _spans array<long>, _items array<string>"
    before: DataFrame | None = None
    blocks = _blocks(items, item_id, item_text)
    block = next(blocks)
    while True:
        win = Windows(block, window)
        shared = sc.broadcast(win)
        prefixes = sc.broadcast(_prefixes(win, _frequencies(plain, "_text", shared) if len(win.start) else {}))
        del win
        block = next(blocks, None)
        names = carried if block is None else carried[:2]
        out = plain.mapInArrow(_step(shared, prefixes, names, block is not None), ", ".join(f"{c} {kinds[c]}" for c in names) + ", " + found)
        if block is None:
            break
        part = materialize(out.dropDuplicates(["_id", "_h"]))
        before = part if before is None else before.unionByName(part)
        shared.destroy()
        prefixes.destroy()
    if before is not None:
        more = before.groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_list("_spans").alias("_more_spans"), F.collect_list("_items").alias("_more_items"))  # a row a block
        out = out.join(more, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left").drop("_i", "_g").mapInArrow(_joined, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", " + found)
    hit = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["n"] + x * s["sign"]).alias("n"), (-s["sign"]).alias("sign")))["n"]
    return out.select(F.col("_id").alias(doc_id), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c != doc_id), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("hit_spans"), F.col("_items").alias("item_ids"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`decontaminate` over whole ``documents`` and ``benchmark``."""
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items, window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, bw.item_id, dw.i, dw.k FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
