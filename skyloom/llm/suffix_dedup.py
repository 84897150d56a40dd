"""Removal of byte strings that an earlier document has, by a hash-compared suffix sort.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Sorting every suffix of a corpus would shuffle many
times its size, so suffixes meet where they can matter only: of the
``length - GRAM + 1`` grams of ``GRAM`` bytes in a string, those with the least
hash are its anchors (at least one per string, the same in equal strings, about
one per 13 bytes).

1. ``batches``: documents are dealt by id into batches of about ``BATCH_BYTES``;
   the three steps that need texts read this one shuffle.
2. Each batch sends 32 bits of each distinct anchor to the anchor's bucket and
   gets back a bit for each that another batch has too, and for a hot anchor
   (about ``HOT_ROWS`` places or more) over how many parts it is split.
3. Repeated anchors go to their buckets with the bytes around them that any
   string with this anchor can cover.  Surroundings that equal those of a smaller
   id in the same batch are decided there, before the shuffle.  A hot anchor's
   places are dealt by the hashes of their strings, so that equal strings still
   meet and no task gets all places of one anchor.
4. A bucket sorts its suffixes: runs of one anchor and offset are merged by
   mergesort, two suffixes being compared by the longest common extension, which
   a binary search over prefix polynomial hashes finds in logarithmic steps.
   Equal neighbours are verified byte by byte, so a collision of hashes can
   never remove anything.  Each class of equal strings knows its smallest id.
5. Batches get the starts that are to go and cut the texts.

Groups of copies are runs in a sort, never pairs, and each batch sends one copy
of equal surroundings.  Batches and buckets exchange packed rows, at most one for
each pair that has something to say: a bucket is as large as two batches, and
there are never more rows than anchors.

Defined cases: null and empty texts are empty; a document without id neither
loses bytes nor takes any from others; ids are numbers (others raise); rows with
equal ids don't act on each other, each gets its row; strings of equal bytes tie
in the sort and keep the order of ids; very long texts are hashed in overlapping
pieces; an empty table gives an empty result; texts are judged on the input, not
on what is left; further columns, whatever their names, are ignored, or carried
if ``keep`` names them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t
from ._spark import partitions

BATCH_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
PIECE = 1 << 19
#: Places of an anchor beyond which it is split, and in a batch beyond which they are told.
HOT_ROWS, TOLD = 1 << 15, 8
#: Anchors that a bucket sorts at once; those of one hash stay together.
SORT_ROWS = 1 << 14


class Shape:
    """The sizes that follow from the length of strings."""

    def __init__(self, length: int) -> None:
        if not 8 <= length <= 120:
            raise ValueError("strings must have 8 to 120 bytes: their starts around an anchor are kept in 64 bits")
        self.length = length
        self.gram = (length + 2) // 2
        self.width = length - self.gram + 1  # grams of a string
        self.around = self.width - 1 + length  # bytes of all strings with one anchor
        self.piece, self.hot, self.told = PIECE, HOT_ROWS, TOLD


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(buf: np.ndarray, offs: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of all strings that lie inside a document: positions, hashes, and what they are anchors of.

    Those are the strings that start ``low`` to ``high`` bytes before the anchor.
    """
    starts, ends = [], []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        while b - a > shape.piece:
            starts.append(a)
            ends.append(a + shape.piece)
            a += shape.piece - shape.length + 1
        if b - a >= shape.length:
            starts.append(a)
            ends.append(b)
    at, hashes, lows, highs, i = [], [], [], [], 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= shape.piece and starts[j] >= ends[j - 1]:
            j += 1
        lo, hi = starts[i], ends[j - 1]
        p = t.prefix_hash(buf[lo:hi])
        _, q = t.powers(hi - lo)
        n = hi - lo - shape.gram + 1
        full = (p[shape.gram :] - p[:-shape.gram]) * q[:n]
        h = (full >> t.U(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(h, shape.width, np.minimum)
        inside = np.zeros(len(least), bool)
        for a, b in zip(starts[i:j], ends[i:j], strict=True):
            inside[a - lo : b - lo - shape.length + 1] = True
        least[~inside] = 0
        padded = np.zeros(n + shape.width - 1, np.uint32)
        padded[shape.width - 1 : shape.width - 1 + len(least)] = least
        own = np.flatnonzero(h == _sliding(padded, shape.width, np.maximum))
        # an anchor's strings are a stretch of starts with one least hash: one of the few stretches that begin or go on in its window
        edge = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        until, value = np.append(edge[1:], len(least)), least[edge]
        low, high, mine = np.full(len(own), shape.width), np.zeros(len(own), np.int64), h[own]
        k = np.searchsorted(edge, np.maximum(own - shape.width + 1, 0), "right") - 1
        todo = np.arange(len(own))
        while len(todo):
            here = value[k] == mine[todo]
            found, of = todo[here], k[here]
            high[found] = np.minimum(own[found] - edge[of], shape.width - 1)
            low[found] = np.maximum(own[found] - until[of] + 1, 0)
            todo, k = todo[~here], k[~here] + 1
            go_on = k < len(edge)
            go_on[go_on] = edge[k[go_on]] <= own[todo[go_on]]
            todo, k = todo[go_on], k[go_on]
        at.append(own + lo)
        hashes.append(t.mix(full[own]))
        lows.append(low)
        highs.append(high)
        i = j
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, hashes, low, high = (np.concatenate(x) for x in (at, hashes, lows, highs))
    # where pieces overlap an anchor can have been found twice, with neighbouring ranges
    order = np.argsort(at, kind="stable")
    at, hashes, low, high = at[order], hashes[order], low[order], high[order]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[head], hashes[head], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)


class Batch:
    """The documents of a batch in the order of ids, as one buffer, with their anchors."""

    def __init__(self, table: pa.Table, shape: Shape, find: bool = True) -> None:
        table = table.take(pc.sort_indices(table, [("_id", "ascending"), ("_text", "ascending")]))
        self.table = table
        buf, self.offs = t.ragged(table.column("_text"))
        self.buf = buf
        ids = table.column("_id")
        self.known = ~np.asarray(ids.is_null()) if len(table) else np.empty(0, bool)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        if find:
            at, h, low, high = anchors(buf, self.offs, shape)
            doc = np.searchsorted(self.offs, at, "right") - 1
            ok = self.known[doc]
            self.at, self.hash, self.doc, self.low, self.high = at[ok], h[ok], doc[ok], low[ok], high[ok]
            self.distinct, self.which = np.unique(self.hash, return_inverse=True)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the hash."""
    return (((h >> t.U(32)) * t.U(buckets)) >> t.U(32)).astype(np.int64)


HOT = np.dtype([("i", "<u4"), ("n", "<u4")])


def _announce(shape: Shape, buckets: int):
    """Of each bucket's anchors 32 bits, and how many places those have that have ``TOLD`` or more."""

    def run(table: pa.Table) -> pa.Table:
        batch = Batch(table, shape)
        b = _bucket(batch.distinct, buckets)
        low = (batch.distinct & t.U(0xFFFFFFFF)).astype(np.uint32)
        times = np.bincount(batch.which.ravel(), minlength=len(low))
        cut = np.searchsorted(b, np.arange(buckets + 1))
        own = np.flatnonzero(np.diff(cut)).tolist()
        number = table.column("batch")[0].as_py()
        many = []
        for k in own:
            at = np.flatnonzero(times[cut[k] : cut[k + 1]] >= shape.told)
            hot = np.empty(len(at), HOT)
            hot["i"], hot["n"] = at, times[cut[k] + at]
            many.append(hot.tobytes())
        t.release()
        return pa.table({"bucket": pa.array(own, pa.int32()), "batch": pa.array([number] * len(own), pa.int32()), "low": pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in own], pa.binary()), "many": pa.array(many, pa.binary())})

    return run


def _repeated(shape: Shape):
    """For each batch of a bucket a bit per anchor, that another batch has it too, and the parts of the hot ones."""

    def run(table: pa.Table) -> pa.Table:
        bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        parts = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        hot = [np.frombuffer(x, HOT) for x in table.column("many").to_pylist()]
        every = np.concatenate(parts)
        value, back, n = np.unique(every, return_inverse=True, return_counts=True)
        many = (n > 1)[back]
        places = n.copy()
        for at, x in zip(np.cumsum([0, *map(len, parts)]).tolist(), hot, strict=False):
            np.add.at(places, back[at + x["i"].astype(np.int64)], x["n"].astype(np.int64) - 1)
        split = (-(-places // shape.hot))[back]
        out = {"batch": [], "bucket": [], "bits": [], "split": []}
        at = 0
        for b, x in zip(batches, parts, strict=True):
            own, of = many[at : at + len(x)], split[at : at + len(x)]
            at += len(x)
            if own.any():
                big = np.flatnonzero(own & (of > 1))
                cut = np.empty(len(big), HOT)
                cut["i"], cut["n"] = big, of[big]
                out["batch"].append(b)
                out["bucket"].append(bucket)
                out["bits"].append(np.packbits(own).tobytes())
                out["split"].append(cut.tobytes())
        return pa.table({"batch": pa.array(out["batch"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "bits": pa.array(out["bits"], pa.binary()), "split": pa.array(out["split"], pa.binary())})

    return run


def _starts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bits ``low`` to ``high``: bit r is the string that starts r bytes before the anchor."""
    return (t.U(2) << high.astype(np.uint64)) - (t.U(1) << low.astype(np.uint64))


#: A place of an anchor; ``part`` of ``split`` parts, if its anchor is hot.
ROW = np.dtype([("id", "<i8"), ("doc", "<u4"), ("at", "<u4"), ("low", "u1"), ("high", "u1"), ("part", "<u4"), ("split", "<u4")])
GONE = np.dtype([("doc", "<u4"), ("at", "<u4"), ("starts", "<u8")])
_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("decided", pa.bool_()), ("rows", pa.binary()), ("bytes", pa.binary())])


def _send(shape: Shape, buckets: int):
    """Repeated anchors and their surroundings, for their buckets; what the batch decides itself."""

    def run(table: pa.Table, flags: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(table):
            batch = Batch(table, shape)
            number = table.column("batch")[0].as_py()
            repeated, split = np.zeros(len(batch.distinct), bool), np.ones(len(batch.distinct), np.int64)
            cut = np.searchsorted(_bucket(batch.distinct, buckets), np.arange(buckets + 1))
            for k, bits, hot in zip(*(flags.column(c).to_pylist() for c in ("bucket", "bits", "split")), strict=True):
                repeated[cut[k] : cut[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: cut[k + 1] - cut[k]].astype(bool)
                hot = np.frombuffer(hot, HOT)
                split[cut[k] + hot["i"].astype(np.int64)] = hot["n"]
            # those of several documents of this batch
            if len(batch.distinct):
                least, most = np.full(len(batch.distinct), 1 << 62), np.full(len(batch.distinct), -1)
                np.minimum.at(least, batch.which, batch.doc)
                np.maximum.at(most, batch.which, batch.doc)
                repeated |= least < most
            sel = np.flatnonzero(repeated[batch.which]) if len(batch.which) else np.empty(0, np.int64)
            if len(sel):
                out = self_decided(batch, sel, split[batch.which[sel]], shape, buckets, number)
            del batch
            t.release()
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_SENT)], schema=_SENT)

    return run


def _part_key(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The key of one part of a hot anchor."""
    return t.mix(h ^ t.mix(part.astype(np.uint64) + t.U(1)))


def _span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of a buffer, by prefix hashes of a piece of it at a time."""
    out = np.empty(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    piece = start[order] // PIECE
    for own in np.split(order, np.flatnonzero(piece[1:] != piece[:-1]) + 1) if len(order) else []:
        at = start[own[0]]
        prefix = t.prefix_hash(buf[at : int(end[own].max())])
        out[own] = t.span_hash(prefix, start[own] - at, end[own] - at)
    return out


def _part_of(buf: np.ndarray, start: np.ndarray, shape: Shape, split: np.ndarray) -> np.ndarray:
    """The part that the string at ``start`` belongs to."""
    return (t.mix(_span_hashes(buf, start, start + shape.length)) % split.astype(np.uint64)).astype(np.int64)


def _each_string(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every string of every place: the place's number, and how far before the anchor it starts."""
    count = high - low + 1
    item = np.repeat(np.arange(len(count)), count)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(count) - count - low, count)


def self_decided(batch: Batch, sel: np.ndarray, split: np.ndarray, shape: Shape, buckets: int, number: int) -> list[tuple]:
    at, doc, h, low, high = batch.at[sel], batch.doc[sel], batch.hash[sel], batch.low[sel], batch.high[sel]
    whole = t.mix(_span_hashes(batch.buf, at - high, at - low + shape.length)) ^ (high * 1009 + low).astype(np.uint64)
    order = np.lexsort((at, whole))  # `at` ascends with the id
    at, doc, h, low, high, whole, split = at[order], doc[order], h[order], low[order], high[order], whole[order], split[order]
    span = high - low + shape.length
    begin = at - high
    new = np.ones(len(at), bool)
    new[1:] = whole[1:] != whole[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    later = np.flatnonzero(batch.ids[doc] > batch.ids[doc[head]])
    near = np.zeros(len(at), bool)
    w, last = np.arange(shape.around), len(batch.buf) - 1
    for part in np.array_split(later, max(1, len(later) // SORT_ROWS)):
        mine, theirs = np.minimum(begin[part, None] + w, last), np.minimum(begin[head[part], None] + w, last)
        same = (batch.buf[mine] == batch.buf[theirs]) | (w >= span[part, None])
        near[part] = same.all(1) & (low[part] == low[head[part]]) & (high[part] == high[head[part]])
    gone = np.empty(int(near.sum()), GONE)
    gone["doc"], gone["at"] = doc[near], at[near] - batch.offs[doc[near]]
    gone["starts"] = _starts(low[near], high[near])
    out = []
    if len(gone):
        out.append((number % buckets, number, True, gone.tobytes(), b""))
    keep = np.flatnonzero(~near)
    key, part = h[keep], np.zeros(len(keep), np.int64)
    hot = np.flatnonzero(split[keep] > 1)
    if len(hot):  # a hot anchor's place goes to the part of each of its strings
        own = keep[hot]
        item, r = _each_string(low[own], high[own])
        parts = _part_of(batch.buf, at[own][item] - r, shape, split[own][item])
        item, parts = np.divmod(np.unique(item * (int(split[own].max()) + 1) + parts), int(split[own].max()) + 1)
        plain = np.flatnonzero(split[keep] == 1)
        keep, part = np.concatenate([keep[plain], own[item]]), np.concatenate([part[plain], parts])
        key = np.concatenate([h[keep[: len(plain)]], _part_key(h[own[item]], parts)])
    order = np.argsort(key, kind="stable")
    keep, key, part = keep[order], key[order], part[order]
    rows = np.empty(len(keep), ROW)
    rows["id"], rows["doc"], rows["at"] = batch.ids[doc[keep]], doc[keep], at[keep] - batch.offs[doc[keep]]
    rows["low"], rows["high"], rows["part"], rows["split"] = low[keep], high[keep], part, split[keep]
    cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
    pack = zstandard.ZstdCompressor(level=3)  # surroundings shrink by a third more than in the shuffle's own code
    for k in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[k], cut[k + 1]
        own = keep[a:b]
        total = np.concatenate(([0], np.cumsum(span[own])))
        where = np.arange(total[-1]) + np.repeat(begin[own] - total[:-1], span[own])
        out.append((k, number, False, b"".join(rows[a:b][c].tobytes() for c in ROW.names), pack.compress(batch.buf[where].tobytes())))
    return out


def _rows(data: bytes) -> np.ndarray:
    """The rows of a blob, which has them column by column."""
    n, at = len(data) // ROW.itemsize, 0
    out = np.empty(n, ROW)
    for c in ROW.names:
        out[c] = np.frombuffer(data, ROW[c], n, at)
        at += n * ROW[c].itemsize
    return out


class Suffixes:
    """Suffixes of a buffer, compared up to ``limit`` bytes by prefix polynomial hashes."""

    def __init__(self, buf: np.ndarray, limit: int) -> None:
        self.buf, self.limit, self.prefix = buf, limit, t.prefix_hash(buf)
        self.inverse = t.powers(len(buf) + 1)[1]

    def _same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        p, q = self.prefix, self.inverse
        return (p[x + n] - p[x]) * q[x] == (p[y + n] - p[y]) * q[y]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension, at most ``limit``, by binary search."""
        out = np.full(len(x), self.limit)
        part = np.flatnonzero(~self._same(x, y, self.limit))
        lo, hi = np.zeros(len(part), np.int64), np.full(len(part), self.limit)
        x, y = x[part], y[part]
        while len(part) and (hi - lo).max() > 1:  # lo: known equal, hi: known to differ
            mid = (lo + hi) >> 1
            same = self._same(x, y, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid)
        out[part] = lo
        return out

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.common(x, y)
        end = n >= self.limit
        z = np.where(end, 0, n)
        return np.where(end, or_equal, self.buf[x + z] < self.buf[y + z])

    def sort(self, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The order of suffixes within runs (``run`` ascends): by their first bytes, then bottom-up mergesort of all runs at once.

        Each round merges neighbouring sorted pieces of every run: an item's
        place is its own rank plus its rank in the other piece, which a binary
        search with suffix comparisons finds.  Runs that are of one hash, such as
        copies, are in order already.
        """
        n = len(at)
        if not n:
            return np.arange(0)
        first = np.ascontiguousarray(self.buf[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        by_first = np.lexsort((first, run))
        at, run, first = at[by_first], run[by_first], first[by_first]
        new = np.ones(n, bool)
        new[1:] = (run[1:] != run[:-1]) | (first[1:] != first[:-1])
        heads = np.flatnonzero(new)
        whole = (self.prefix[at + self.limit] - self.prefix[at]) * self.inverse[at]
        one = np.minimum.reduceat(whole, heads) == np.maximum.reduceat(whole, heads)
        run = np.cumsum(new | np.repeat(one, np.diff(np.append(heads, n))))
        return by_first[self._merged(at, run)]

    def _merged(self, at: np.ndarray, run: np.ndarray) -> np.ndarray:
        n = len(at)
        order = np.arange(n)
        start = np.searchsorted(run, run, "left")
        end = np.searchsorted(run, run, "right")
        width = 1
        longest = int((end - start).max()) if n else 0
        while width < longest:
            act = np.flatnonzero(end - start > width)
            rank = act - start[act]
            piece = rank // width
            lo = start[act] + (piece ^ 1) * width  # the piece to merge with
            hi = np.minimum(lo + width, end[act])
            has = lo < end[act]
            act, rank, piece, lo, hi = act[has], rank[has], piece[has], lo[has], hi[has]
            first = lo.copy()
            mine, second = at[order[act]], (piece & 1) == 1
            a, b = lo.copy(), hi.copy()
            todo = np.flatnonzero(a < b)
            while len(todo):
                mid = (a[todo] + b[todo]) >> 1
                other = at[order[mid]]
                # of equal suffixes, those of the first piece come first
                less = np.where(second[todo], self.before(other, mine[todo], True), self.before(other, mine[todo], False))
                a[todo] = np.where(less, mid + 1, a[todo])
                b[todo] = np.where(less, b[todo], mid)
                todo = todo[a[todo] < b[todo]]
            place = start[act] + (piece & ~1) * width + rank - piece * width + (a - first)
            fresh = order.copy()
            fresh[place] = order[act]
            order = fresh
            width *= 2
        return order

    def classes(self, at: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order and, in it, where a class of equal suffixes begins; equality is verified on the bytes."""
        order = self.sort(at, run)
        x, r = at[order], run[order]
        new = np.ones(len(x), bool)
        cand = np.flatnonzero(r[1:] == r[:-1]) + 1
        cand = cand[self._same(x[cand], x[cand - 1], self.limit)]
        w = np.arange(self.limit)
        for part in np.array_split(cand, max(1, len(cand) // SORT_ROWS)):
            new[part] = ~(self.buf[x[part, None] + w] == self.buf[x[part - 1, None] + w]).all(1)
        return order, new


def judge(rows: np.ndarray, h: np.ndarray, frame: np.ndarray, shape: Shape) -> np.ndarray:
    """For each anchor the strings (bit r) that a smaller id has too.

    ``h``, the anchors' hashes, ascends; ``frame`` has each one's surroundings in
    ``shape.around`` bytes, filled with zeros.
    """
    n, size = len(rows), shape.around
    out = np.zeros(n, np.uint64)
    buf = np.concatenate([frame.ravel(), np.zeros(size, np.uint8)])
    low, high = rows["low"].astype(np.int64), rows["high"].astype(np.int64)
    # whole surroundings: runs of one anchor and one range of strings
    key = low * (shape.width + 1) + high
    base = np.lexsort((rows["id"], key, h))
    run = np.concatenate(([0], np.cumsum((h[base][1:] != h[base][:-1]) | (key[base][1:] != key[base][:-1]))))
    order, new = Suffixes(buf, size).classes(base * size, run)
    sorted_ = base[order]  # within a class ids ascend: the sort is stable
    at = np.flatnonzero(new)
    head_ = sorted_[np.repeat(at, np.diff(np.append(at, n)))]
    later_ = rows["id"][sorted_] > rows["id"][head_]
    out[sorted_[later_]] = _starts(low, high)[sorted_[later_]]
    # one of each class for the strings inside, where its anchor has more than one class
    rep = sorted_[at]
    rep = rep[np.argsort(h[rep], kind="stable")]
    many = np.zeros(len(rep), bool)
    same = h[rep][1:] == h[rep][:-1]
    many[1:] |= same
    many[:-1] |= same
    rep = rep[many]
    if len(rep):
        item, r = _each_string(low[rep], high[rep])
        item = rep[item]
        hot = np.flatnonzero(rows["split"][item] > 1)
        if len(hot):  # of a hot anchor only the strings of its part
            i = item[hot]
            other = hot[_part_of(buf, i * size + high[i] - r[hot], shape, rows["split"][i]) != rows["part"][i]]
            item, r = np.delete(item, other), np.delete(r, other)
        srt = np.lexsort((rows["id"][item], r, h[item]))
        item, r = item[srt], r[srt]
        run = np.concatenate(([0], np.cumsum((h[item][1:] != h[item][:-1]) | (r[1:] != r[:-1]))))
        order, new = Suffixes(buf, shape.length).classes(item * size + high[item] - r, run)
        item, r = item[order], r[order]
        at = np.flatnonzero(new)
        head = item[np.repeat(at, np.diff(np.append(at, len(item))))]
        later = rows["id"][item] > rows["id"][head]
        np.bitwise_or.at(out, item[later], t.U(1) << r[later].astype(np.uint64))
    # members of a class with the same id as its first share its fate
    twin = ~later_
    out[sorted_[twin]] = out[head_[twin]]
    return out


def _judged(shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        out = {"batch": [], "gone": []}
        decided = table.column("decided").to_pylist()
        batches, rows, data = (table.column(c).to_pylist() for c in ("batch", "rows", "bytes"))
        own = [i for i, d in enumerate(decided) if not d]
        for i, d in enumerate(decided):
            if d:
                out["batch"].append(batches[i])
                out["gone"].append(rows[i])
        if own:
            every = np.concatenate([_rows(rows[i]) for i in own])
            source = np.repeat(np.array([batches[i] for i in own]), [len(rows[i]) // ROW.itemsize for i in own])
            unpack = zstandard.ZstdDecompressor()
            flat = np.frombuffer(b"".join(unpack.decompress(data[i]) for i in own), np.uint8)
            span = every["high"].astype(np.int64) - every["low"] + shape.length
            begin = np.concatenate(([0], np.cumsum(span)[:-1]))
            h = np.empty(len(every), np.uint64)  # of the anchors' grams, from the bytes
            for part in np.array_split(np.arange(len(every)), max(1, len(every) // SORT_ROWS)):
                gram = t.prefix_hash(flat[begin[part[0]] : begin[part[-1]] + span[part[-1]]])
                at = begin[part] - begin[part[0]] + every["high"][part]
                h[part] = t.mix(t.span_hash(gram, at, at + shape.gram))
            h = np.where(every["split"] > 1, _part_key(h, every["part"]), h)
            order = np.argsort(h, kind="stable")
            hashes, h = h, h[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            masks = np.zeros(len(every), np.uint64)
            i = 0
            while i < len(edge) - 1:  # whole groups of one anchor, about SORT_ROWS at once
                j = max(i + 1, int(np.searchsorted(edge, edge[i] + SORT_ROWS, "right")) - 1)
                part = order[edge[i] : edge[j]]
                w = np.arange(shape.around)
                frame = np.where(w < span[part, None], flat[np.minimum(begin[part, None] + w, len(flat) - 1)], 0).astype(np.uint8)
                masks[part] = judge(every[part], hashes[part], frame, shape)
                i = j
            hit = np.flatnonzero(masks)
            gone = np.empty(len(hit), GONE)
            gone["doc"], gone["at"], gone["starts"] = every["doc"][hit], every["at"][hit], masks[hit]
            for b in np.unique(source[hit]).tolist():
                out["batch"].append(b)
                out["gone"].append(gone[source[hit] == b].tobytes())
        t.release()
        return pa.table({"batch": pa.array(out["batch"], pa.int32()), "gone": pa.array(out["gone"], pa.binary())})

    return run


def _cut(shape: Shape, names: list[str], with_text: bool):
    """Per document what goes and what is left."""

    def run(table: pa.Table, gone: pa.Table) -> pa.Table:
        batch = Batch(table, shape, find=False)
        buf, offs = batch.buf, batch.offs
        change = np.zeros(len(buf) + 1, np.int32)
        for x in gone.column("gone").to_pylist():
            x = np.frombuffer(x, GONE)
            at = offs[x["doc"]] + x["at"]
            for r in range(shape.width):
                begin = at[((x["starts"] >> t.U(r)) & t.U(1)) == 1] - r
                np.add.at(change, begin, 1)
                np.add.at(change, begin + shape.length, -1)
        np.cumsum(change, out=change)
        away = change[: len(buf)] > 0
        del change
        n_removed, n_spans, digest, texts = [], [], [], []
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            out, part = away[a:b], buf[a:b]
            n_removed.append(int(out.sum()))
            n_spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
            digest.append(hashlib.sha256(part[~out].tobytes()).hexdigest())
            if with_text:
                texts.append(_whole_characters(part, out) if n_removed[-1] else part.tobytes().decode("utf-8", "replace"))
        t.release()
        cols = {c: batch.table.column(c) for c in names}
        cols |= {"n_bytes": pa.array(np.diff(offs)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(texts, pa.string())
        return pa.table(cols)

    return run


def _whole_characters(part: np.ndarray, out: np.ndarray) -> str:
    """The text without the removed bytes; a character goes only if all its bytes do."""
    lead = np.flatnonzero((part & 0xC0) != 0x80)
    if not len(lead):
        return ""
    size = np.diff(np.append(lead, len(part)))
    all_gone = np.logical_and.reduceat(out, lead)
    return part[~np.repeat(all_gone, size) if lead[0] == 0 else ~out].tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 50, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the columns of ``keep``, ``n_bytes, n_removed, n_spans, kept_sha256``.

    ``with_text`` adds ``kept_text``, in which characters that lose only some of
    their bytes are kept whole (the digest is of the exact remaining bytes).
    """
    shape = Shape(length)
    plain = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n, buckets = (max(partitions(docs.sparkSession), -(-size // part)) for part in (BATCH_BYTES, BUCKET_BYTES))
    dealt = plain.withColumn("batch", F.pmod(F.xxhash64("_id", F.octet_length("_text")), F.lit(n)).cast("int")).repartitionById(n, "batch")  # one batch a task
    names = ["_id", *(f"_k{i}" for i in range(len(keep)))]
    said = dealt.groupBy("batch").applyInArrow(_announce(shape, buckets), "bucket int, batch int, low binary, many binary")
    flags = said.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_repeated(shape), "batch int, bucket int, bits binary, split binary")
    sent = dealt.groupBy("batch").cogroup(flags.repartitionById(n, "batch").groupBy("batch")).applyInArrow(_send(shape, buckets), "bucket int, batch int, decided boolean, rows binary, bytes binary")
    gone = sent.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_judged(shape), "batch int, gone binary")
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if with_text else "")
    out = dealt.groupBy("batch").cogroup(gone.repartitionById(n, "batch").groupBy("batch")).applyInArrow(_cut(shape, names, with_text), schema)
    return out.select(F.col("_id").alias(doc_id), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep) if c != doc_id), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=50)


OP3_SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS f FROM g GROUP BY s),
c AS (SELECT g.doc_id, g.i FROM g JOIN f USING (s) WHERE f.f < g.doc_id),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM r UNION ALL SELECT doc_id, max(b), NULL FROM r GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(CASE WHEN e IS NULL THEN substr(x, 2 * s + 1) ELSE substr(x, 2 * s + 1, 2 * (e - s)) END, '' ORDER BY s) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
z AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN t USING (doc_id)
"""
