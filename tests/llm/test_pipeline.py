"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as cp

from .test_operators import plain_components, plain_line_dedup


def test_stages(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for name, stage in cp.STAGES:
        before = rows(docs)
        out = stage(spark, docs, odd_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            after = rows(docs)
        if name == "language_id":
            assert {i for i, _ in after} <= {i for i, t in before if t and any(c.isalpha() for c in t)}
            assert len(after) >= 0.9 * sum(bool(t) and any(c.isalpha() for c in t) for _, t in before)
        elif name == "line_dedup":
            assert len(after) == len(before)
            want = {(r[0], r[1] - r[2]) for r in plain_line_dedup(before)}
            assert {(i, max(1, len(t.split("\n")))) for i, t in after} == {(i, max(1, n)) for i, n in want}
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        elif name == "near_duplicates":
            assert sorted(i for i, _ in after if i is not None) == sorted(r[0] for r in plain_components(before) if r[0] == r[2] and r[0] is not None)
        elif name == "decontamination":
            assert {i for i, _ in before} - {i for i, _ in after} == {60, 61}
        else:
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in before}


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 100
    assert 4 <= len(cp.STAGES) <= 5


def test_run_on_empty_tables(spark, empty_dir):
    assert cp.run(spark, empty_dir).count() == 0
