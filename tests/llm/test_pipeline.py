"""The pipeline's stages, each held against a brute-force version on its own input."""

import corpus_pipeline as cp
from skyloom.llm._spark import scratch_path
from tests.conftest import SF
from tests.llm.test_contracts import awkward, brute_components, brute_hits, brute_repeats


def written(spark, df):
    path = scratch_path(spark, "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    start = docs.collect()
    quality = written(spark, cp.quality_stage(spark, docs, SF))
    kept = {r.doc_id for r in quality.collect()}
    assert quality.columns == docs.columns
    assert sum((r.doc_id in kept) == bool(labels[r.doc_id]) for r in start if r.doc_id in labels) >= 0.95 * len(labels)

    near = written(spark, cp.jaccard_stage(spark, quality, SF))
    data = [(r.doc_id, r.text) for r in quality.collect()]
    assert {str(r.doc_id) for r in near.collect()} == {c for _, _, c in brute_components(data, 5, 80, 100)}

    cut = written(spark, cp.suffix_stage(spark, near, SF))
    before = {r.doc_id: r.text for r in near.collect()}
    removed = {d: n for d, _, n, _, _ in brute_repeats([(d, (x or "").encode()) for d, x in before.items()], 50)}
    for r in cut.collect():
        gone = len((before[r.doc_id] or "").encode()) - len((r.text or "").encode())
        assert 0 <= gone <= removed[str(r.doc_id)] and (gone > 0 or removed[str(r.doc_id)] < 4)
    assert cut.count() + sum(1 for d, x in before.items() if x and removed[str(d)] == len(x.encode())) == near.count()

    clean = written(spark, cp.benchmark_stage(spark, cut, SF))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut.collect() if brute_hits(r.text, items, 10)[1] == 0}

    mixed = cp.mixing_stage(spark, clean, SF)
    assert mixed.columns[:5] == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert mixed.filter("repeats < 1 OR taken > 2 * size").count() == 0


def test_run(spark):
    got = cp.run(spark, SF)
    assert got.count() > 50 and len(cp.STAGES) == 5


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark).select(*cp.COLUMNS)
    for _, stage in cp.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.columns[:5] == list(cp.COLUMNS) and out.count() <= docs.count()
