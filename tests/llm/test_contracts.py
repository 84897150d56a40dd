"""Every query of the list: against its SQL, a brute-force version, or held-out rows; and the defined cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import registry
from skyloom.llm import suffix_dedup as sd
from skyloom.llm.decontaminate import decontaminate
from skyloom.llm.jaccard import jaccard_components, one_of_each
from skyloom.llm.language_id import identify
from skyloom.llm.licenses import Scanner, BASE, NOTICES, TAGS, evaluate, scan_licenses, to_postfix, tokens
from skyloom.llm.mixing import mix
from skyloom.llm.quality import classify_quality
from skyloom.llm.topk_search import top_k
from skyloom.llm.toxicity import BlockMax, score_toxicity
from skyloom.llm.url_reputation import filter_urls
from tests.conftest import SF, rows, sql_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long, batch string, score string, _id string"
ALNUM = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{i % 977}" for i in range(150_000))


def lower(x):
    return bytes(c + 32 if 65 <= c < 91 else c for c in (x or "").encode())


def awkward(spark):
    """Nulls, empties, long texts, ties, repeated rows and clashing extra columns."""
    a = "The quick brown fox jumps over the lazy dog and then runs far away from all the other foxes of the wood."
    texts = [a, a, None, "", "   \n", a.upper(), a[:-20] + " or so it seems to me now.", LONG, "é " * 40, "one", "one", a + " " + LONG[:3000], "MIT license. SPDX-License-Identifier: MIT OR Apache-2.0\n"]
    out = [(i, x, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None, "clash", "clash", "clash") for i, x in enumerate(texts)]
    out += [out[0], (None, a, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "three again " * 9, None, "s9", 5, None, None, None)]
    return spark.createDataFrame(out, DOC).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert rows(df, columns) == sql_rows(duck, registry.ORACLE[name], columns)


# 1 ---------------------------------------------------------------------------------------------


def brute_hits(text, items, window):
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, x in items:
        own = ALNUM.findall(lower(x))
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontaminate_brute(spark):
    docs = awkward(spark)
    bench = [(1, "Quick, BROWN fox!"), (2, "jumps over the lazy dog and then runs far away from all"), (3, None), (4, ""), (5, "one"), (5, "one"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "lazy dog")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate(docs, items, window=4, keep=("text", "batch")).collect()
    assert len(got) == docs.count()
    for r in got:
        n, hit, found = brute_hits(r.text[:4000] if r.text and len(r.text) > 50_000 else r.text, bench, 4)
        if r.text and len(r.text) > 50_000:
            assert r.n_words == 150_000 and r.item_ids == ["6"] and r.n_hit > 1000
            continue
        assert (r.n_words, r.n_hit, [x for x in r.item_ids]) == (n, hit, [x for x in found if x != "None"])
    assert decontaminate(nothing(spark), items).count() == 0
    assert decontaminate(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_decontaminate_in_blocks(spark, monkeypatch):
    from skyloom.llm import decontaminate as mod

    items = spark.createDataFrame([(i, t) for i, t in enumerate(["the quick brown fox", "lazy dog and then runs", "other foxes of the wood", "brown fox jumps"])], "item_id long, text string")
    whole = sorted((str(r.doc_id), r.n_hit, r.hit_spans, r.item_ids) for r in mod.decontaminate(awkward(spark), items, window=3).collect())
    monkeypatch.setattr(mod, "BLOCK_BYTES", 10)
    assert whole == sorted((str(r.doc_id), r.n_hit, r.hit_spans, r.item_ids) for r in mod.decontaminate(awkward(spark), items, window=3).collect())


# 2 ---------------------------------------------------------------------------------------------


def test_mix(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 37), ["a", "b", "c", None][min(3, i % 7)]) for i in range(4000)], "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] += r.size
        assert r.taken <= 2 * r.size and r.taken == r.size * r.repeats
    for (size, target), (taken, total) in by.items():
        assert total == size and abs(taken - target) <= 40 and target <= 2 * size
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(7)).collect()))
    from skyloom.llm import mixing

    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)  # sources are ordered in ranges and joined by a shuffle
    assert sorted(map(str, got)) == sorted(map(str, mix(docs).collect()))
    monkeypatch.undo()
    odd = mix(awkward(spark), keep=("text",)).collect()
    assert len(odd) == 17 and all(r.size == 0 for r in odd if not (r.text or "").strip())
    assert mix(nothing(spark)).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def brute_repeats(data, n):
    first = {}
    for d, b in data:
        if d is not None:
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                first[g] = min(first.get(g, d), d)
    out = []
    for d, b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1 if d is not None else 0):
            if first[b[i : i + n]] < d:
                cover[i : i + n] = b"\x01" * n
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        out.append((str(d), len(b), sum(cover), spans, hashlib.sha256(bytes(c for c, x in zip(b, cover, strict=True) if not x)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("n", "hot"), [(16, 1 << 15), (50, 1 << 15), (16, 3), (50, 4)])
def test_repeats_brute(spark, n, hot, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 256)
    monkeypatch.setattr(sd, "HOT_ROWS", hot)  # anchors of more places are dealt by their strings
    monkeypatch.setattr(sd, "TOLD", 2)
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abcde é"), int(k))) for k in rng.integers(5, 120, 12)]
    data = [(int(i), "".join(parts[j] for j in rng.integers(0, 12, int(rng.integers(0, 9))))) for i in rng.permutation(90)]
    data += [(3, data[0][1]), (None, data[1][1]), (200, None), (201, "a" * 400), (202, "a" * 500), (203, ""), (204, "rested " * 90), (205, "rested " * 40)]
    docs = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, batch string, bucket int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, length=n, keep=("batch",)).collect())
    assert got == brute_repeats([(d, (x or "").encode()) for d, x in data], n)
    text = sd.remove_repeats(docs, length=n, with_text=True).filter("n_removed > 0").collect()
    assert text and all("�" not in r.kept_text for r in text)


def test_repeats_defined_cases(spark):
    got = sd.remove_repeats(awkward(spark), length=50).collect()
    assert len(got) == 17 and sum(r.n_removed for r in got if r.doc_id is None) == 0
    assert sd.remove_repeats(nothing(spark)).count() == 0


def test_hot_anchors_are_split(spark, monkeypatch):
    """One passage in every document, between words of its own: no part of its anchors keeps all places."""
    import pyarrow as pa

    monkeypatch.setattr(sd, "HOT_ROWS", 40)
    monkeypatch.setattr(sd, "BATCH_BYTES", 4000)
    docs = [(i, f"{i * 7919 % 1000:03d} own " * 3 + "the passage that stands in each and every document of this table" + f" tail {i * 31 % 977}") for i in range(400)]
    got = sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats([(d, x.encode()) for d, x in docs], 50)
    # the same by hand: all places in one batch, dealt to buckets
    shape = sd.Shape(50)
    table = pa.table({"_id": [d for d, _ in docs], "_text": pa.array([x.encode() for _, x in docs], pa.binary()), "batch": pa.array([0] * 400, pa.int32())})
    batch = sd.Batch(table, shape)
    split = np.full(len(batch.at), 8)
    out = sd.self_decided(batch, np.arange(len(batch.at)), split, shape, 4, 0)
    rows = [sd._rows(x[3]) for x in out if not x[2]]
    parts = np.concatenate([r["part"] for r in rows])
    assert set(np.concatenate([r["split"] for r in rows]).tolist()) == {8} and len(set(parts.tolist())) == 8 and np.bincount(parts).max() < 0.5 * len(parts)


def test_suffix_sort():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    at = rng.permutation(3000)[:900]
    run = np.sort(rng.integers(0, 4, 900))
    order, new = sd.Suffixes(buf, 40).classes(at, run)
    want = sorted(range(900), key=lambda i: (run[i], bytes(buf[at[i] : at[i] + 40]), i))
    assert order.tolist() == want
    keys = [(run[i], bytes(buf[at[i] : at[i] + 40])) for i in want]
    assert new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(900)]


def test_suffix_sort_compares_little(monkeypatch):
    """Copies and suffixes that differ in their first bytes are not compared one by one."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 60).astype(np.uint8)
    buf = np.concatenate([np.tile(text, 300), rng.integers(97, 123, 18000).astype(np.uint8), np.zeros(60, np.uint8)])
    at, run = np.arange(600) * 60, np.zeros(600, np.int64)
    compared, real = [], sd.Suffixes._same
    monkeypatch.setattr(sd.Suffixes, "_same", lambda self, x, y, n: compared.append(len(x)) or real(self, x, y, n))
    order, new = sd.Suffixes(buf, 60).classes(at, run)
    assert order.tolist() == sorted(range(600), key=lambda i: (bytes(buf[i * 60 : i * 60 + 60]), i)) and new.sum() == 301
    assert sum(compared) < 2 * 600


# 4 ---------------------------------------------------------------------------------------------


def test_topk_brute(spark, monkeypatch):
    from skyloom.llm import topk_search as mod

    monkeypatch.setattr(mod, "LEAF", 8)
    monkeypatch.setattr(mod, "BLOCK", 150)
    monkeypatch.setattr(mod, "GROUP", 10)
    monkeypatch.setattr(mod, "TILE", 2)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 6)).round(1)
    v[100:250] = v[100]  # ties
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    data += [(600, None), (601, []), (602, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (605, [1.0, 2.0]), (None, [1.0] * 6), (606, [1e6] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    df = df.unionByName(df.filter("vec_id < 20")).withColumn("_id", F.lit("x")).withColumn("cell", F.lit("y")).withColumn("score", F.lit(None))
    q = np.zeros((607, 6), np.int64)
    ok = []
    for i, x in data:
        if i is not None and x and all(y is not None and np.isfinite(y) for y in x):
            q[i, : len(x)] = np.floor(1024 * np.array(x, float)).astype(np.int64)
            ok.append(i)
    want = []
    for i in ok:
        if i % 50 == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in ok if j != i))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 50 = 0")).collect())
    assert got == sorted(want)
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0
    few = df.filter("vec_id < 3 OR vec_id = 600")
    assert top_k(few.dropDuplicates(["vec_id"]), few.filter("vec_id = 0")).count() == 2


def test_topk_prunes(spark, monkeypatch):
    """On clustered vectors, pairs of blocks and groups are never made, and in a block most leaves are never opened."""
    from skyloom.llm import topk_search as mod

    monkeypatch.setattr(mod, "BLOCK", 200)
    monkeypatch.setattr(mod, "GROUP", 20)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[np.arange(2400) % 8] + rng.normal(scale=0.02, size=(2400, 16))
    q = np.floor(1024 * v).astype(np.int64)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    blocks, groups, seeds, pairs = mod.plan(df, df.filter("vec_id % 30 = 0"))
    made, possible = pairs.count() + seeds.count(), blocks.count() * groups.count()
    assert blocks.count() >= 8 and made < 0.6 * possible
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 30 = 0")).collect())
    want = []
    for i in range(0, 2400, 30):
        s = q @ q[i]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(sorted((j for j in range(2400) if j != i), key=lambda j: (-s[j], j))[:10])]
    assert got == sorted(want)
    count = {}
    ids = np.arange(2400)
    some = mod.Index(ids[::97], q[::97], 1, 8)
    best = mod.dual_search(some, mod.Index(ids, q, 11, 32), 10, np.full(len(some.ids), -np.inf), count)
    assert count["made"] < 0.5 * count["possible"] and all(len(h) == 10 for h in best)


# 5 ---------------------------------------------------------------------------------------------


def brute_components(data, k, p, q):
    """Rows by their own texts; a component is named by its smallest id."""
    sets = []
    for _, x in data:
        w = re.findall(rb"[^\x20\x09-\x0d]+", lower(x))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(data)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), len(s), str(least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))


def test_jaccard_brute(spark, monkeypatch):
    from skyloom.llm import jaccard as mod

    monkeypatch.setattr(mod, "FIRST", 8)
    monkeypatch.setattr(mod, "SLICE", 16)  # so that groups are dealt as slices
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(400)]
    data = []
    for g in range(12):
        base = list(rng.choice(vocab, int(rng.integers(3, 90))))
        for _ in range(int(rng.integers(1, 40))):
            x = list(base)
            for _ in range(int(rng.integers(0, 3))):
                x[int(rng.integers(0, len(x)))] = str(rng.choice(vocab))
            data.append((len(data), " ".join(x)))
    data = [(d, x) for d, x in rng.permutation(np.array(data, object)).tolist()]
    data += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a b c d e f g h"), (None, data[0][1]), (None, None), (None, "nothing else is like this one")]
    docs = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, n int, k1 string").repartition(5)
    for k, p in ((4, 85), (5, 80)):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, k=k, p=p).collect())
        assert got == brute_components(data, k, p, 100)
    stay = {r.doc_id for r in one_of_each(docs, k=5, p=80).collect()}
    assert {c for d, _, c in brute_components(data, 5, 80, 100) if d != "None"} == {str(d) for d in stay if d is not None}


def test_jaccard_third_set_of_a_group(spark):
    s, z = [f"s{i}" for i in range(17)], [f"z{i}" for i in range(19)]
    data = [(1, [*s, "x1", "x2"]), (2, [*s, "y1"]), (3, [s[0], *z])]  # sizes 19, 18 and 20; s0 is rare
    data += [(10 + i, [*s[1:], *z, *(f"l{i}-{j}" for j in range(40))]) for i in range(3)]
    data = [(d, " ".join(x)) for d, x in data]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, k=1, p=85).collect())
    assert got == brute_components(data, 1, 85, 100) and ("2", 18, "1") in got


@pytest.mark.parametrize(("p", "q"), [(85, 100), (80, 100), (50, 100), (95, 100), (2, 3)])
def test_least_shared(p, q):
    from skyloom.llm.jaccard import _least_shared, _shared_at_least

    rng = np.random.default_rng(p)
    groups = [np.sort(rng.integers(1, 60, int(rng.integers(1, 9)))) + int(rng.integers(0, 90)) for _ in range(400)] + [np.array([18, 19, 20]), np.array([13, 14, 15])]
    got = _least_shared(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), np.concatenate(groups), p, q)
    want = [_shared_at_least(np.full(1, n), g[(q * g >= p * n) & (p * g <= q * n)], p, q).min() for g in groups for n in g]
    assert got.tolist() == want


@pytest.mark.parametrize("size", [4, 16])
def test_jaccard_large_group(spark, monkeypatch, size):
    """One pivot with a large component, a middle one, bridges between slices and sets that are unlike all others."""
    from skyloom.llm import jaccard as mod

    monkeypatch.setattr(mod, "FIRST", size)
    monkeypatch.setattr(mod, "SLICE", size)
    rng = np.random.default_rng(2)
    base, data = [f"b{i}" for i in range(60)], []
    for i in range(70):  # a chain of small steps: neighbours link, the ends do not
        base = [f"c{i}" if j == i % 60 else x for j, x in enumerate(base)]
        data.append(list(base))
    data += [[f"b{i}" for i in range(20)] + [f"u{j}-{i}" for i in range(40)] for j in range(30)]
    data += [[f"b{i}" for i in range(20)] + [f"m-{i}" for i in range(40)] + [f"z{j}"] for j in range(25)]
    data = [(int(i), " ".join(x)) for i, x in zip(rng.permutation(len(data)), data, strict=True)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(mod, "_enough", lambda meet: meet.select("k1", mod.F.lit(7).cast("long").alias("pivot")).distinct())
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs, k=1, p=85).collect())
    assert got == brute_components(data, 1, 85, 100)


def test_one_of_each_keeps_unlike_texts_of_an_id(spark):
    a, b = "one text that is quite long and has its own words", "another text with nothing in common at all with it"
    data = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (1, a + " ", "y"), (2, a, "x"), (5, b + " too", "x"), (5, "and a third one that nobody else has in here", "x"), (7, None, "x"), (7, "", "x"), (7, "", "x"), (None, a, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    want = [(1, a, "x"), (1, b, "w"), (5, data[6][1], "x"), (7, None, "x"), (7, "", "x"), (None, a, "x")]
    for n in (1, 3):
        assert sorted(map(str, map(tuple, one_of_each(docs.repartition(n), k=2, p=80).collect()))) == sorted(map(str, want))


def test_jaccard_defined_cases(spark):
    assert jaccard_components(nothing(spark)).count() == 0
    got = jaccard_components(awkward(spark)).collect()
    assert len(got) == 17 and {r.component_id for r in got if r.doc_id in (0, 1, 5)} == {0}


# 6 ---------------------------------------------------------------------------------------------


def test_licenses(spark):
    got = {r.doc_id: r for r in scan_licenses(awkward(spark)).collect() if r.doc_id is not None}
    assert (got[12].base_labels, got[12].labels, got[12].n_base, got[12].first_word, got[12].score) == ("mit", "apache,mit", 1, 0, 1.0)
    assert got[2].n_words == 0 and got[2].score == 0 and got[2].first_word is None
    s = Scanner(BASE, NOTICES, TAGS)
    text = "GNU General  Public-License; general public license (mit license mit license) Apache\tLicense general public licenses"
    words = ALNUM.findall(lower(text))
    want = [(i, lab) for ph, lab in BASE.items() for i in range(len(words)) if b" ".join(words[i : i + len(ph.split())]).decode() == ph]
    r = s.scan(text.encode())
    assert (r["n_base"], r["first_word"], r["last_word"]) == (len(want), min(want)[0], max(want)[0])
    assert evaluate(to_postfix(tokens("MIT OR Apache-2.0 AND (BSD-3-Clause OR MIT)"))) == (frozenset(), {"mit", "apache", "bsd"})
    assert evaluate(to_postfix(tokens("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT")))[0] == {"gpl", "mit"}
    assert to_postfix(tokens("(a OR b) AND c")) == ["a", "b", "or", "c", "and"]
    assert evaluate(to_postfix(["(", "MIT"]))[1] == {"mit"} and evaluate([]) == (frozenset(), frozenset())
    assert scan_licenses(nothing(spark)).count() == 0


def test_license_expressions_are_whole():
    scan = lambda x: Scanner(BASE, NOTICES, TAGS).scan(x.encode())["labels"].split(",")
    tag = "SPDX-License-Identifier: "
    assert set(scan(tag + "MIT OR " * 700 + "Apache-2.0")) == {"mit", "apache"}
    assert scan(tag + " " * 4094 + "Apache-2.0") == ["apache"]
    assert set(scan(tag + "(MIT OR\n  Apache-2.0\n  OR ISC) AND\nMPL-2.0\nand BSD")) == {"mit", "apache", "isc", "mpl"}
    assert set(scan("é " + tag + "(" + "MIT OR\n" * 150_000 + "Apache-2.0)")) == {"mit", "apache"}  # over 1 MB
    assert set(scan(f"SPDX -- license_Identifier MITNFA\nx {tag}GPLv2+\n{tag}BSD-3-Clause {tag} cc-by-nc-4.0")) == {"mitnfa", "gpl", "bsd", "cc-by-nc"}
    assert scan("spdx license identifiers: MIT") == [""]


def test_license_places_in_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    some = 0
    for d in docs.collect():
        words = [w.decode() for w in ALNUM.findall(lower(d.text))]
        want = sorted((i, lab) for ph, lab in BASE.items() for i in range(len(words)) if words[i : i + len(ph.split())] == ph.split())
        r, some = got[d.doc_id], some + bool(want)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(want), ",".join(sorted({x for _, x in want})))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert not want or set(r.base_labels.split(",")) <= set(r.labels.split(","))
    assert some > 5


# 7, 9 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "parts", "which"), [("op7_quality", "quality", 3, 1), ("op9_toxicity", "toxic", 5, 0)])
def test_held_out(spark, name, label, parts, which):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in list(got.values())[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == which) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [(got[x.doc_id].predicted, x[label]) for x in labels if x.doc_id in got and got[x.doc_id].held_out]
    assert len(out) > 300 and np.mean([a == b for a, b in out]) >= 0.97


def test_quality_is_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in registry.QUERIES["op7_quality"](spark, sf).filter("held_out").collect()}
    y = [(got[x.doc_id].score, x.quality) for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if x.doc_id in got and x.quality in (0, 1)]
    score, label = np.array(y).T
    bins = np.minimum((score * 10).astype(int), 9)
    gap = sum(abs(score[bins == b].mean() - label[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))
    assert gap < 0.03 and np.mean((score - label) ** 2) < 0.02


def test_sample_is_bounded_in_texts(spark):
    from skyloom.llm.quality import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i % 40}") for i in range(400)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, y int")
    rows = lambda n: sorted(tuple(r) for r in labelled_sample(docs.repartition(3), labels, "doc_id", "text", "y", lambda _: F.lit(True), n).collect())
    assert len(rows(1000)) == 41 and len(rows(7)) == 7 == len(set(rows(7))) and rows(7) == rows(7)


def test_classifiers_defined_cases(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, None), (8, 0), (None, 1), (999, 0), (5, 7)], "doc_id long, y int")
    for f in (classify_quality, score_toxicity):
        for lab in (labels, labels.limit(0)):
            got = f(awkward(spark), lab, label="y").collect()
            assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
        assert f(nothing(spark), labels, label="y").count() == 0
    assert {"text", "batch"} <= set(classify_quality(awkward(spark), labels, label="y", keep=("text", "batch")).columns)


def test_block_max_is_exact(monkeypatch):
    from skyloom.llm import toxicity as mod

    monkeypatch.setattr(mod, "BLOCK", 4)
    rng = np.random.default_rng(8)
    dense = rng.random((60, 12)) * (rng.random((60, 12)) < 0.3)
    dense[10:14] = dense[10]
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = BlockMax([(np.flatnonzero(r), r[r > 0]) for r in unit], np.arange(60) + 100, np.zeros(60), 12)
    for q in unit[:25]:
        if not q.any():
            continue
        who, cos = index.nearest(np.flatnonzero(q), q[q > 0], 5)
        sims = (unit @ q).round(12)
        want = sorted((-s, i + 100) for i, s in enumerate(sims) if s > 0)[:5]
        assert [(round(-c, 9), n) for c, n in zip(cos.tolist(), index.names[who].tolist(), strict=True)] == [(round(s, 9), n) for s, n in want]


def test_toxicity_takes_all_words(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(30)]  # no word is in two examples
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(100 + i, x) for i, x in enumerate(texts)] + [(999, "unlike all")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    for i, x in enumerate(texts):
        r = got[100 + i]
        assert r.neighbours == [i] and r.predicted == int(i % 3 == 0) and set(r.terms) == set(x.split())
    assert got[999].neighbours == [] and got[999].terms == []


def test_neighbours_of_documents_brute(spark):
    """The nearest examples of every document, by cosines over all their words counted here anew."""
    from collections import Counter
    from math import log, sqrt

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic in (0, 1)}
    texts = {r.doc_id: Counter(ALNUM.findall(lower(r.text))) for r in docs.collect()}
    train = [d for d in sorted(labels) if d in texts]
    y = {d: labels[d] for d in train}
    n, bad = len(train), sum(y.values())
    weight = {}
    df = Counter(w for c in texts.values() for w in c)
    for w in {w for d in train for w in texts[d]}:
        have, hit = sum(w in texts[d] for d in train), sum(y[d] for d in train if w in texts[d])
        spread = have * bad / n * (1 - bad / n) * (n - have) / max(1, n - 1)
        chi = max(abs(hit - have * bad / n) - 0.5, 0) ** 2 / max(spread, 1e-12) if spread > 0 else 0.0
        weight[w] = (1 + sqrt(chi)) * (log((1 + len(texts)) / (1 + df[w])) + 1)

    def unit(c):
        v = {w: (1 + log(k)) * weight[w] for w, k in c.items() if w in weight}
        norm = sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {d: unit(texts[d]) for d in train}
    none = 0
    for r in score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect():
        v = unit(texts[r.doc_id])
        cos = {d: round(sum(x * e[w] for w, x in v.items() if w in e), 9) for d, e in examples.items()}
        want = sorted((d for d in train if cos[d] > 0), key=lambda d: (-cos[d], d))[:15]
        none += not want
        assert len(r.neighbours) == len(want) and [cos[d] for d in r.neighbours] == pytest.approx([cos[d] for d in want], abs=2e-9)
        assert set(r.terms) == {w.decode() for w in v}
    assert none < 0.1 * len(texts)


@pytest.mark.parametrize("table_rows", [0, 3, 512])
def test_block_max_lists_and_table(monkeypatch, table_rows):
    from skyloom.llm import toxicity as mod

    monkeypatch.setattr(mod, "BLOCK", 4)
    monkeypatch.setattr(mod, "TABLE_ROWS", table_rows)
    rng = np.random.default_rng(9)
    dense = rng.random((70, 40)) * (rng.random((70, 40)) < rng.random(40) * 0.4)
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    index = BlockMax([(np.flatnonzero(r), r[r > 0]) for r in unit], np.arange(70), np.zeros(70), 40)
    own = [(np.flatnonzero(q), q[q > 0]) for q in unit]
    for q, x, c in zip(unit, own, index.common(own), strict=True):
        sims = (unit @ q).round(9)
        want = [i for _, i in sorted((-s, i) for i, s in enumerate(sims) if s > 0)[:6]]
        assert index.names[index.nearest(*x, 6, common=c)[0]].tolist() == want


# 8, 10 -----------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.com/de/1", "x.example.net/en/", None, "ftp://net", "http://notexample.com/de/", "http://m.b.org/fr/?x", "http://host/p#://z", "http://" + "a." * 300 + "net/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(urls)] + [(None, None, None, None), (1, urls[1], "h", "c")], "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    want = [("a.example.net", "/en/x", "example.net/en/"), ("example.com", "/de/1", "example.com/de/"), ("", "", None), ("", "", None), ("net", "", None), ("notexample.com", "/de/", None), ("m.b.org", "/fr/", "org/fr/"), ("host", "/p", None)]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == want
    assert got[8].rule == "net/" and got[0].verdict == "allow" and got[1].verdict == "block" and filter_urls(pages).count() == 11
    assert filter_urls(pages.limit(0)).count() == 0


def test_urls_judged_by_reputation(spark, duck):
    """Pages without a rule go by the posterior of their host, its registered domain and suffix."""
    urls = [f"http://a.example.com/de/{i}" for i in range(30)] + [f"http://x.org/fr/{i}" for i in range(30)] + ["http://a.example.com/en/", "http://b.example.com/", "http://x.org/en/", "http://new.io/", "http://y.co.uk/", "http://z.co.uk/"]
    rules = spark.createDataFrame([("example.com/de/", "block"), ("org/fr/", "allow"), ("y.co.uk/bad", "block")], "rule string, verdict string")
    urls += [f"http://y.co.uk/bad{i}" for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages, rules).collect()}
    assert [got[i].rule for i in range(60, 66)] == [None] * 6
    assert got[60].verdict == "block" and got[62].verdict == got[63].verdict == got[65].verdict == "allow" and got[64].verdict == "block"
    assert got[61].bound > got[63].bound  # the domain's rate reaches a host without pages of its own
    assert got[65].rate < 0.9 and got[65].bound < got[64].bound  # a suffix's tenants share its prior only


def test_urls_run_no_python(spark):
    plan = registry.QUERIES["op8_url_reputation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark):
    """Pages planted from documents of known language, in markup that says nothing, something right or something wrong."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 80 AND lang IN ('en', 'de', 'fr', 'es')").orderBy("doc_id").limit(600).collect()
    codes, pages, truth = ("de", "en", "es", "fr"), [], {}
    for i, d in enumerate(docs):
        says = {0: None, 1: None, 2: codes[i % 4]}.get(i % 7, d.lang)
        where = f"http://h{i % 9}.example.com/" + (f"{codes[i % 4]}/" if i % 11 == 0 else f"{d.lang}/" if i % 3 else "")
        pages.append((i, where, (f'<!-- <p> --><html class=x lang="{says}-XX">' if says else "<html>") + f"<script>the and of</script><p>{d.text}</p></html>"))
        truth[i] = d.lang
    got = identify(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and np.mean([r.language == truth[r.page_id] for r in got]) > 0.97
    assert np.mean([r.language == truth[r.page_id] for r in got if r.page_id % 7 < 2]) > 0.95
    assert np.mean([r.confidence for r in got if r.language == truth[r.page_id]]) > 0.9
    whole = registry.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(whole) == 250 and {r.language for r in whole} == set(codes)


def test_language_defined_cases(spark):
    odd = spark.createDataFrame([(1, None, None, "c"), (None, "http://x.de/", "", "c"), (2, "http://a.fr/de/", "<html lang=en-GB><p>", "c"), (2, "http://a.fr/de/", "<html lang=en-GB><p>", "c"), (3, "", '<?xml version="1"?> <!doctype html><HTML xml:lang="it">', "c")], "page_id long, url string, html string, declared string")
    got = identify(odd, languages=("en", "de", "fr", "es")).collect()
    assert len(got) == 5 and {r.named for r in got if r.page_id is None} == {"de"} and {(r.declared, r.named) for r in got if r.page_id == 2} == {("en", "de")}
    assert {r.declared for r in identify(odd).collect()} == {None, "en", "it"}
    assert identify(odd.limit(0)).count() == 0 and [r.language for r in identify(odd.limit(1)).collect()] == [None]
    tied = spark.createDataFrame([(i, None, f"<html lang={c}>") for i, c in enumerate(["fr", "de"])] + [(9, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.language for r in identify(tied).collect()} == {0: "fr", 1: "de", 9: "de"}


def test_hostile_pages_are_read_in_one_pass(spark):
    import time

    from skyloom.llm.language_id import visible

    n = 1 << 20
    began = time.perf_counter()
    for unit in (b"<!-- x", b"<script>", b"<", b"<style ", b"&a", b"<!--a-->", b"</script", b"<p", b" ", b"<!-- <script>"):
        visible(unit * (n // len(unit)))
    assert time.perf_counter() - began < 8
    assert visible(b"a<!-- x <b>--> b <Script>no</sCRIPT > c<style>no</style>d <p title=x>e&amp;f <open").split() == [b"a", b"b", b"c", b"d", b"e", b"f", b"<open"]
    rows = [(i, "http://a.de/", unit * (n // len(unit))) for i, unit in enumerate(("<!-- x", " ", "<html lang ", "<html", "\n<", "lang=", "<!doctype html"))]
    pages = spark.createDataFrame(rows + [(99, "http://a.de/", "<html lang=de>der die das")], "page_id long, url string, html string")
    began = time.perf_counter()
    assert len(identify(pages).collect()) == 8 and time.perf_counter() - began < 60


def test_codes_fit_64_bits():
    from skyloom.llm.decontaminate import Windows

    # with this width the codes of these words would not fit
    many = Windows([(1, " ".join(f"w{i}" for i in range(40)))], 30, shingle=20)
    assert max(many.grams) == 11 and many.base**11 < 1 << 63 <= many.base**12


def test_divide_skip(monkeypatch):
    from skyloom.llm import jaccard as mod

    rng = np.random.default_rng(11)
    lists = [np.sort(rng.choice(60, int(rng.integers(1, 40)), replace=False)) for _ in range(25)]
    n = np.bincount(np.concatenate(lists), minlength=60)
    for steps in (0, 10_000):  # by merge sort, by heap
        monkeypatch.setattr(mod, "HEAP_STEPS", steps)
        for want in (1, 5, 9, 14, 25):
            member, count = mod.divide_skip(list(lists), want)
            assert member.tolist() == np.flatnonzero(n >= want).tolist() and count.tolist() == n[n >= want].tolist()
