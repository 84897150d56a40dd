"""N-gram Jaccard join by a T-occurrence search (DivideSkip) over inverted lists.

Documents are sets of hashed word shingles.  Two sets of sizes ``n`` and ``m``
have Jaccard ``>= p/q`` exactly if they share ``T = ceil(p (n + m) / (p + q))``
shingles, so the join is a T-occurrence problem: merge the inverted lists of a
document's shingles and keep the documents that occur at least T times.

1. Equal sets are one class (grouped by a 128-bit fingerprint with partial
   aggregation); its smallest id stands for it from here on.  Hot groups of
   copies are one row.
2. All shingles are counted over all documents into a table of fixed size; the
   counts give one global order, rare first.
3. Two linked sets share a shingle among their first ``n - ceil(p n / q) + 1``.
   These prefixes are dealt by shingle; sets of compatible sizes that share one
   meet in the block of the smallest fingerprint among them.  A set whose shared
   prefix shingles are too few for a link with any set that it met is left out.
4. Each block gets the whole sets of its members.  In a block, each set queries
   the inverted lists with DivideSkip: the ``L`` longest lists are set aside, the
   short ones are merged, those that occur ``T - L`` times are probed in the long
   lists by binary search, and those that reach ``T`` are links.  A block gives a
   spanning forest of its links and never all pairs.  A block of more than
   ``FIRST`` members is first searched slice by slice, then among one
   representative of each component that this left it with.  Only where it still
   has several components are slices held against each other, and none against
   one of the same component: a large group of near copies costs what its size
   is, and pairs of slices are what is left to its unlike members.
5. The components of all forests are found by alternating stars.

Defined cases: null and empty texts have empty sets and link with nothing; a
text of fewer than ``k`` words is one shingle; rows that repeat an id are judged
by their own texts (equal ones are one class, unlike ones may get different
components); ids are numbers (others raise); a row without id takes the component
of its set's class, null if no member of it has an id, and links nothing by itself; ties do not arise, as a
component is named by its smallest id; very long texts are whole; an empty table
gives an empty result; further columns, whatever their names, are ignored by
:func:`jaccard_components` and carried by :func:`one_of_each`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _text as t
from ._spark import connected_components, materialize, partitions, summed_table, table_rows

COUNTERS, COUNTER_BLOCKS = 1 << 20, 32
#: Members of a block that are searched at once: of a large one's slices at first, and when slices meet.
FIRST, SLICE = 128, 512
#: Shingles of all sets per task.
TASK_SHINGLES = 6_000_000
#: Bits of the filter that texts pass before they are dealt to blocks.
FILTER_BITS = 24
#: So many postings at most are merged by a heap, more by a merge sort.
HEAP_STEPS = 256
#: DivideSkip's weight of a probe against a merge step when choosing how many lists are long.
MU = 0.0085


def _sets(batch: pa.RecordBatch, column: str, k: int):
    """For each chunk of a batch: its first row, the shingle sets and their offsets."""
    buf, offs = t.ragged(batch.column(column))
    for a, b in t.chunks(offs):
        part, o = t.LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
        starts, ends, first = t.words(part, o, t.NONSPACE)
        val, at = t.document_sets(t.word_hashes(part, starts, ends), first, k)
        yield a, b, val, at


def _cell(val: np.ndarray) -> np.ndarray:
    return (val >> t.U(44)).astype(np.int64)


def needed(n, m, p: int, q: int):
    """Shared shingles that sets of sizes n and m need: ceil(p (n + m) / (p + q))."""
    return -((-p * (n + m)) // (p + q))


def _frequencies(docs: DataFrame, k: int) -> np.ndarray:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, val, _ in _sets(batch, "_text", k):
                table += np.bincount(_cell(val), minlength=COUNTERS)
        if table.any():
            yield table_rows(table, COUNTER_BLOCKS)

    table = summed_table(docs.select("_text").mapInArrow(gather, "block int, sums binary"), COUNTER_BLOCKS)
    return np.minimum(table, 2**31 - 1).astype(np.int32) if len(table) else np.zeros(COUNTERS, np.int32)


def _fingerprints(val: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    run, other = np.zeros(len(val) + 1, np.uint64), np.zeros(len(val) + 1, np.uint64)
    np.cumsum(val, out=run[1:])
    np.cumsum(t.mix(val + t.U(0x9E3779B97F4A7C15)), out=other[1:])
    return (run[at[1:]] - run[at[:-1]]).view(np.int64), (other[at[1:]] - other[at[:-1]]).view(np.int64)


def _named(k: int, keep: tuple[str, ...] = ()):
    """``_id, n, k1, k2`` and the columns of ``keep``: the size and fingerprint of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2 = [], [], []
            for _, _, val, at in _sets(batch, "_text", k):
                x, y = _fingerprints(val, at)
                n.append(np.diff(at))
                k1.append(x)
                k2.append(y)
            if n:
                out = {"_id": batch.column("_id"), "n": pa.array(np.concatenate(n), pa.int64()), "k1": pa.array(np.concatenate(k1)), "k2": pa.array(np.concatenate(k2))}
                yield pa.RecordBatch.from_pydict(out | {c: batch.column(c) for c in keep})

    return run


def _prefixes(rank, k: int, p: int, q: int, buckets: int):
    """Prefix shingles, rare first, dealt by hash: rows of one bucket with the fingerprints, sizes and shingles of many sets.

    Equal sets of a batch are sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: set[tuple[int, int]] = set()
            names, sizes, counts, tokens = [], [], [], []
            for _, _, val, at in _sets(batch, "_text", k):
                freq = rank.value[_cell(val)]
                k1, k2 = _fingerprints(val, at)
                for x, y, i, j in zip(k1.tolist(), k2.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if i == j or (x, y) in sent:
                        continue
                    sent.add((x, y))
                    keep = j - i - needed_self(j - i, p, q) + 1
                    order = np.argsort(freq[i:j], kind="stable")[:keep]  # ties by the hash, as sets are sorted
                    names.append(x)
                    sizes.append(j - i)
                    counts.append(keep)
                    tokens.append(val[i:j][order])
            if not names:
                continue
            tok, name, size = np.concatenate(tokens), np.array(names, np.int64), np.array(sizes, np.int32)
            del tokens
            t.release()
            doc = np.repeat(np.arange(len(name)), counts)
            bucket = (tok % t.U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {"bucket": [], "sets": [], "sizes": [], "counts": [], "tokens": []}
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[b] : cut[b + 1]]
                d, c = np.unique(doc[own], return_counts=True)
                out["bucket"].append(b)
                out["sets"].append(name[d].tobytes())
                out["sizes"].append(size[d].tobytes())
                out["counts"].append(c.astype(np.int32).tobytes())
                out["tokens"].append(tok[own].tobytes())
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int32() if c == "bucket" else pa.binary()) for c, x in out.items()})

    return run


def needed_self(n: int, p: int, q: int) -> int:
    """The least overlap of a set of size n with any linked set: ceil(p n / q)."""
    return -((-p * n) // q)


def _shared_at_least(n: np.ndarray, m: np.ndarray, p: int, q: int) -> np.ndarray:
    """Prefix shingles that linked sets of sizes n and m share.

    A shared shingle outside the prefix of the set whose prefix ends first in
    the global order is one of that set's ``ceil(p n / q) - 1`` others, so at
    least ``T - ceil(p max(n, m) / q) + 1`` are in both prefixes.
    """
    return np.maximum(1, needed(n, m, p, q) - needed_self(np.maximum(n, m), p, q) + 1)


def _least_shared(group: np.ndarray, n: np.ndarray, p: int, q: int) -> np.ndarray:
    """For each row the least of :func:`_shared_at_least` over the compatible sizes of its group; rows ascend by group and size.

    Up to n it grows with the other size, so the smallest has the least.  Beyond,
    it falls by ``p / q - p / (p + q)`` a step, but for the ceilings: it is at most
    one less than at the largest size, and that only at sizes within the inverse
    of the slope, which are looked up if they are few.
    """
    wide = int(n.max()) + 1
    base = group * (wide + 1)
    code = base + n
    low = n[np.searchsorted(code, base + needed_self(n, p, q))]
    high = n[np.searchsorted(code, base + np.minimum(n * q // p, wide), "right") - 1]
    least = np.minimum(_shared_at_least(n, low, p, q), _shared_at_least(n, high, p, q))
    near = q * (p + q) // (p * p)
    if near > 64:
        return np.maximum(1, least - 1)
    for d in range(1, near + 1):
        m = np.maximum(high - d, n)
        there = code[np.searchsorted(code, base + m)] == base + m
        least = np.where(there, np.minimum(least, _shared_at_least(n, m, p, q)), least)
    return least


def _meetings(p: int, q: int):
    """Sets of compatible sizes that share a prefix shingle, with the smallest among them.

    ``least`` counts, by the number of shared shingles that a link with a set of
    the group needs at least, the set's groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, tok = [], [], []
        for batch in batches:
            for i, s, c, k in zip(*(batch.column(x).to_pylist() for x in ("sets", "sizes", "counts", "tokens")), strict=True):
                c = np.frombuffer(c, np.int32)
                name.append(np.repeat(np.frombuffer(i, np.int64), c))
                n.append(np.repeat(np.frombuffer(s, np.int32), c))
                tok.append(np.frombuffer(k, np.uint64))
        if not tok:
            return
        name, n, tok = np.concatenate(name), np.concatenate(n).astype(np.int64), np.concatenate(tok)
        order = np.lexsort((name, n, tok))
        name, n, tok = name[order], n[order], tok[order]
        fresh = np.ones(len(tok), bool)  # equal sets of several batches are one
        fresh[1:] = (tok[1:] != tok[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
        name, n, tok = name[fresh], n[fresh], tok[fresh]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (p * n[1:] > q * n[:-1])  # no set of the group is near enough in size
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(tok)))
        pivot = np.repeat(np.minimum.reduceat(name, at), size)
        group = np.repeat(np.arange(len(at)), size)
        many = size[group] > 1
        name, n, pivot, group = name[many], n[many], pivot[many], group[many]
        if not len(name):
            return
        least = _least_shared(group, n, p, q)
        order = np.lexsort((least, pivot, name))
        name, n, pivot, least = name[order], n[order], pivot[order], least[order]
        lead = np.ones(len(name), bool)
        lead[1:] = (name[1:] != name[:-1]) | (pivot[1:] != pivot[:-1]) | (least[1:] != least[:-1])
        at = np.flatnonzero(lead)
        out = pa.RecordBatch.from_pydict({"k1": pa.array(name[at]), "pivot": pa.array(pivot[at]), "least": pa.array(least[at]), "groups": pa.array(np.diff(np.append(at, len(name))))})
        del name, n, tok, order, fresh, new, at, size, pivot, group, many, least, lead
        t.release()
        yield out

    return run


def _enough(meet: DataFrame) -> DataFrame:
    """``k1, pivot`` of the sets that share enough.

    A link that needs c shared shingles has c groups, each of which needs at
    most c; so some c has at least c groups that need at most c.
    """
    w = Window.partitionBy("k1").orderBy("least").rangeBetween(Window.unboundedPreceding, 0)
    counts = meet.groupBy("k1", "least").agg(F.sum("groups").alias("groups"))
    fit = counts.withColumn("have", F.sum("groups").over(w)).filter(F.col("have") >= F.col("least")).select("k1").distinct()
    return meet.select("k1", "pivot").distinct().join(fit, "k1", "left_semi")


class Forest:
    """Union-find over the members of a block."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self, xs: np.ndarray) -> np.ndarray:
        r = self.up[xs]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s


def merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of sorted lists, ascending, and in how many lists each is.

    Short lists are merged by a heap; where that would take many steps, their
    sorted runs are merged at once by a merge sort, with the same result.
    """
    if sum(map(len, lists)) <= HEAP_STEPS:
        member, count = [], []
        for x, same in groupby(heapq.merge(*(a.tolist() for a in lists))):
            member.append(x)
            count.append(sum(1 for _ in same))
        return np.array(member, np.int64), np.array(count, np.int64)
    merged = np.concatenate(lists)
    merged.sort(kind="stable")
    at = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
    return merged[at], np.diff(np.append(at, len(merged)))


def divide_skip(lists: list[np.ndarray], want: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that occur in at least ``want`` of the sorted lists, and how often.

    The longest lists are only probed for members that are frequent enough in
    the merge of the others.
    """
    if len(lists) < want:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lists = sorted(lists, key=len)
    longest = len(lists[-1])
    n_long = min(want - 1, int(want / (MU * np.log2(max(2, longest)) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    member, count = merge_counts(short)
    keep = count >= want - n_long
    member, count = member[keep], count[keep]
    for i, probe in enumerate(long):
        if not len(member):
            break
        where = np.minimum(np.searchsorted(probe, member), len(probe) - 1)
        count = count + (probe[where] == member)
        keep = count >= want - (n_long - 1 - i)
        member, count = member[keep], count[keep]
    return member, count


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a block; ``side`` 0 and 1 are slices to be held against each other, 2 means all."""
    n = np.array([len(x) for x in sets], np.int64)
    order = np.lexsort((ids, n))
    ids, n, side, sets = ids[order], n[order], side[order], [sets[i] for i in order]
    tok = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(tok, kind="stable")  # postings of a shingle in the order of sizes
    tok, doc = tok[by], doc[by]
    new = np.ones(len(tok), bool)
    new[1:] = tok[1:] != tok[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(tok))
    # the lists of each member: those with another member
    lot = np.repeat(np.arange(len(start)), end - start)
    many = (end - start > 1)[lot]
    back = np.argsort(doc[many], kind="stable")
    mine, owner = lot[many][back], doc[many][back]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    forest, out = Forest(len(sets)), []
    for x in range(1, len(sets)):
        own = mine[cut[x] : cut[x + 1]]
        low = int(np.searchsorted(n, needed_self(int(n[x]), p, q)))  # the smallest compatible set
        if low >= x:
            continue
        want = int(needed(n[x], n[low], p, q))
        if len(own) < want:
            continue
        lists = []
        for s, e in zip(start[own].tolist(), end[own].tolist(), strict=True):
            members = doc[s:e]
            members = members[np.searchsorted(members, low) : np.searchsorted(members, x)]
            if len(members):
                lists.append(members)
        if len(lists) < want:
            continue
        got, count = divide_skip(lists, want)
        got = got[count >= needed(n[x], n[got], p, q)]
        if side[x] < 2:
            got = got[side[got] != side[x]]
        if len(got):
            fresh = got[forest.roots(got) != forest.root(x)]
            for y in fresh.tolist():
                a, b = forest.root(x), forest.root(y)
                if a != b:
                    forest.up[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
    return out


def _block_search(p: int, q: int):
    """Stream the members of blocks, sorted by block, and give each block's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, side = None, [], [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if len(ids) > 1:
                found.extend(block_links(np.array(ids, np.int64), sets, np.array(side, np.int64), p, q))

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
            found.clear()
            return batch

        for batch in batches:
            for k, i, j, d, s, x in zip(*(batch.column(c).to_pylist() for c in ("pivot", "i", "j", "node", "side", "shingles")), strict=True):
                if (k, i, j) != key:
                    close()
                    key, ids, sets, side = (k, i, j), [], [], []
                ids.append(d)
                sets.append(np.frombuffer(x, np.uint64))
                side.append(s)
            t.release()
            if len(found) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


_BLOCK = "array<struct<pivot:bigint,i:int,j:int,side:int>>"


def _one_block(pivot: Column, i: Column) -> Column:
    """A block of its own: all its members are held against each other."""
    return F.array(F.struct(pivot.alias("pivot"), i.cast("int").alias("i"), i.cast("int").alias("j"), F.lit(2).alias("side"))).cast(_BLOCK)


def _sliced(members: DataFrame) -> DataFrame:
    """Members ``node, k1, _doc, pivot`` with the number ``m`` of their pivot's members and the blocks of the first round."""
    sized = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1)
    slices = F.ceil(F.col("m") / FIRST).cast("long")
    return members.join(sized, "pivot").withColumn("blocks", _one_block(F.col("pivot"), F.pmod(F.xxhash64("node"), slices)))


def _pairs(rows: DataFrame, own: Column, slices: Column) -> DataFrame:
    """Rows ``node, k1, _doc, pivot`` dealt to pairs of their pivot's slices: one of slice ``own`` meets those of ``slices`` (an array)."""
    block = lambda o: F.struct(F.col("pivot"), F.least(own, o).cast("int").alias("i"), F.greatest(own, o).cast("int").alias("j"), F.when(o == own, 2).when(own < o, 0).otherwise(1).alias("side"))
    return rows.withColumn("blocks", F.transform(slices, block).cast(_BLOCK))


def _of_components(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the pivots that have several components, with their ``comp``."""
    rows = large.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("comp", F.coalesce("component", "node")).drop("_n", "component")
    mixed = rows.groupBy("pivot").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter(F.col("_a") < F.col("_b"))
    return rows.join(mixed, "pivot", "left_semi")


def _representatives(mixed: DataFrame) -> DataFrame:
    """One member of each component of a pivot, all of a pivot against each other."""
    reps = mixed.groupBy("pivot", "comp").agg(F.min(F.struct("node", "k1", "_doc")).alias("x")).select("pivot", "x.*")
    sized = reps.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("long").alias("s"))
    rows = reps.join(sized, "pivot").withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")))
    return _pairs(rows, F.col("own"), F.sequence(F.lit(0).cast("long"), F.col("s") - 1))


def _apart(mixed: DataFrame) -> DataFrame:
    """Members of different components against each other.

    A component of ``SLICE`` members or more has slices of its own, which never
    meet each other; the smaller ones share slices.
    """
    count = mixed.groupBy("pivot", "comp").agg(F.count(F.lit(1)).alias("c"))
    pool = count.groupBy("pivot").agg(F.ceil(F.sum(F.when(F.col("c") < SLICE, F.col("c")).otherwise(0)) / SLICE).cast("long").alias("pool"))
    w = Window.partitionBy("pivot").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)  # at most m / SLICE rows of a pivot
    own = F.ceil(F.col("c") / SLICE).cast("long")
    big = count.filter(F.col("c") >= SLICE).withColumn("of", own).withColumn("before", F.coalesce(F.sum("of").over(w), F.lit(0).cast("long")))
    total = pool.join(big.groupBy("pivot").agg(F.sum("of").alias("own")), "pivot", "left").select("pivot", "pool", (F.col("pool") + F.coalesce("own", F.lit(0).cast("long"))).alias("all"))
    rows = mixed.join(big.select("pivot", "comp", "of", "before"), ["pivot", "comp"], "left").join(total, "pivot")
    h = F.xxhash64("node")
    rows = rows.withColumn("lo", F.col("pool") + F.col("before")).withColumn("own", F.when(F.col("of").isNull(), F.pmod(h, F.greatest(F.col("pool"), F.lit(1)))).otherwise(F.col("lo") + F.pmod(h, F.col("of"))))
    mine = lambda o: F.col("of").isNotNull() & (o >= F.col("lo")) & (o < F.col("lo") + F.col("of"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("all") - 1), lambda o: ~mine(o))
    return _pairs(rows, F.col("own"), others)


def _search_blocks(plain: DataFrame, rows: DataFrame, k: int, p: int, q: int, n_parts: int) -> DataFrame:
    """The links ``a, b`` (nodes) of the blocks that ``rows`` names: ``node, k1, _doc, blocks``."""
    blocks = materialize(rows.groupBy("_doc", "node", "k1").agg(F.flatten(F.collect_list("blocks")).alias("blocks")))
    some = plain.withColumn("_h", F.xxhash64("_id")).mapInArrow(_pass(_wanted(blocks)), "_id long, _text string")
    texts = some.join(blocks, F.col("_id") == F.col("_doc")).select("node", "k1", "blocks", "_text")
    members = texts.mapInArrow(_members(k), "pivot long, i int, j int, node long, side int, shingles binary")
    return members.repartition(n_parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(_block_search(p, q), "a long, b long")


def _wanted(blocks: DataFrame):
    """A filter of fixed size (2 MB) that every id of ``blocks`` passes, and few others while they are few."""
    h = F.xxhash64("_doc")
    word = F.shiftrightunsigned(h, 64 - FILTER_BITS + 6)
    bits = blocks.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(_doc), %d) & 63 as int))" % (64 - FILTER_BITS))).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w, b in bits.collect():  # at most 2**18 words
        table[w] = b
    return blocks.sparkSession.sparkContext.broadcast(table)


def _pass(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("_h").to_numpy().view(np.uint64) >> t.U(64 - FILTER_BITS)
            ok = (table.value[(h >> t.U(6)).astype(np.int64)].view(np.uint64) >> (h & t.U(63))) & t.U(1)
            yield batch.select(["_id", "_text"]).filter(pa.array(ok.astype(bool)))

    return run


def _members(k: int):
    """The whole sets of documents, one row for each block they go to; other texts of the same id are left out."""
    kinds = (("pivot", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("side", pa.int32()), ("shingles", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, nodes, names = (batch.column(c).to_pylist() for c in ("blocks", "node", "k1"))
            for a, b, val, at in _sets(batch, "_text", k):
                k1, _ = _fingerprints(val, at)
                own = [r for r in range(a, b) if k1[r - a] == names[r]]
                rows = [(x["pivot"], x["i"], x["j"], nodes[r], x["side"], val[at[r - a] : at[r - a + 1]].tobytes()) for r in own for x in blocks[r]]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[z] for r in rows], kind) for z, (c, kind) in enumerate(kinds)})

    return run


def _found(plain: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """Per row of ``plain`` (``_id, _text``): ``_id, n, k1, k2, group, component``.

    ``group`` names the component (null for empty sets), ``component`` is its smallest id.
    """
    spark = plain.sparkSession
    sketch = materialize(plain.mapInArrow(_named(k), "_id long, n long, k1 long, k2 long"))
    n_parts = max(partitions(spark), -(-(sketch.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))
    named = sketch.filter(F.col("n") > 0)
    classes = named.groupBy("k1", "k2", "n").agg(F.min("_id").alias("rep"))
    rank = spark.sparkContext.broadcast(_frequencies(plain, k))
    dealt = plain.filter(F.col("_id").isNotNull()).mapInArrow(_prefixes(rank, k, p, q, 4 * n_parts), "bucket int, sets binary, sizes binary, counts binary, tokens binary")
    meet = materialize(dealt.repartition(n_parts, "bucket").mapInArrow(_meetings(p, q), "k1 long, pivot long, least long, groups long"))
    # a class's node is its smallest id, or a number of its own if unlike texts share that id
    shared = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("_c"), F.min("k1").alias("_first")).filter(F.col("_c") > 1)
    nodes = (
        classes.filter(F.col("rep").isNotNull()).join(shared.withColumnRenamed("rep", "_r"), F.col("rep") == F.col("_r"), "left")
        .select("k1", "k2", "n", "rep", F.when(F.col("_first") < F.col("k1"), F.xxhash64("k1", "k2", "n")).otherwise(F.col("rep")).alias("node"))
    )
    ids = nodes.select("k1", "node", F.col("rep").alias("_doc"))
    members = materialize(_sliced(_enough(meet).join(ids, "k1").select("pivot", "k1", "node", "_doc").distinct()))
    links = materialize(_search_blocks(plain, members, k, p, q, n_parts))
    parts = connected_components(links)
    large = members.filter(F.col("m") > FIRST).drop("blocks", "m")
    for deal in (_representatives, _apart):
        mixed = materialize(_of_components(large, parts)) if not large.isEmpty() else large
        if mixed.isEmpty():
            break
        links = links.unionByName(materialize(_search_blocks(plain, deal(mixed), k, p, q, n_parts)))
        parts = connected_components(links)
    group = nodes.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("k1", "k2", "n", "rep", F.coalesce("component", "node").alias("group"))
    least = group.groupBy("group").agg(F.min("rep").alias("component")).withColumnRenamed("group", "_g")
    group = group.join(least, F.col("group") == F.col("_g")).select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("n").alias("_n"), "group", "component")
    full = named.join(group, (F.col("_1") == F.col("k1")) & (F.col("_2") == F.col("k2")) & (F.col("n") == F.col("_n")), "left").select("_id", "n", "k1", "k2", "group", "component")
    return full.unionByName(sketch.filter(F.col("n") == 0).select("_id", "n", "k1", "k2", F.lit(None).cast("long").alias("group"), F.col("_id").alias("component")))


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``; two documents link at Jaccard ``>= p / q``.

    ``component_id`` is the smallest id that links reach, the document's own included.
    """
    found = _found(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), k, p, q)
    return found.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """One row of each group of near duplicates, and the rows of no group, with all columns of ``docs``.

    A group's row is the one of its smallest id; of several rows with that id,
    the first by text and then by the other columns.  Rows of one id with unlike
    texts are in different groups, so each of them stays; rows without words stay
    but for repeats of id and text; rows without id stay.
    """
    names = docs.columns
    found = materialize(_found(docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")), k, p, q))
    named = found.filter(F.col("_id").isNotNull())
    many = named.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select(F.col("_id").alias("_many"))
    stay = named.filter(F.col("_id") == F.col("component")).select(F.col("_id").alias("_stay")).distinct()
    kept = docs.join(stay, F.col(doc_id) == F.col("_stay"), "left_semi").join(many, F.col(doc_id) == F.col("_many"), "left_anti").unionByName(docs.filter(F.col(doc_id).isNull()))
    if many.isEmpty():
        return kept
    # rows that repeat an id: each one's group by its own text
    rows = docs.join(many, F.col(doc_id) == F.col("_many"), "left_semi").select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"), F.struct(*names).alias("_row"))
    own = found.join(many, F.col("_id") == F.col("_many"), "left_semi").select(F.col("_id").alias("_i"), F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.col("n").alias("_n"), "group", "component").distinct()
    kinds = StructType([StructField(c, LongType()) for c in ("_id", "n", "k1", "k2")] + [rows.schema[c] for c in ("_text", "_row")])
    sets = rows.mapInArrow(_named(k, ("_text", "_row")), kinds)
    judged = sets.join(own, (F.col("_id") == F.col("_i")) & (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("n") == F.col("_n"))).filter(F.col("component") == F.col("_id"))
    order = F.struct("_text", *(F.col(f"_row.{c}") for c in names if docs.schema[c].dataType.typeName() not in ("map", "variant")))
    first = judged.groupBy("_id", "group", F.when(F.col("n") == 0, F.col("_text")).alias("_t")).agg(F.min_by("_row", order).alias("_row"))
    return kept.unionByName(first.select("_row.*"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, p=85, q=100)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(x.n) + max(y.n) - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT e.b AS d, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(x.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) x ON x.d = w.doc_id
"""
