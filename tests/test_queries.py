"""Every query against its SQL, and operators' own cases."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from retort.functions import columns
from retort.operators import cluster, descriptors, graph, metrics, mmp, reactions, similarity, split
from retort.plans.molecules import QUERIES, flagship, pool_fps
from retort.plans.oracles import ORACLES
from retort.sources import readers, writers
from retort.streaming import usage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "part documents embeddings events lineitem labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    c = sorted(df.columns)
    return sorted([[repr(float(v)) if isinstance(v, float) else str(v) for v in r] for r in df[c].astype(object).values.tolist()])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_flagship(spark):
    got = flagship(spark, SF).collect()
    assert got[0]["sim"] == 1.0
    q = pool_fps(spark).where("mol_id in (0, 30)").select(F.col("mol_id").alias("query_id"), "fp")
    sims = {(r["query_id"], r["mol_id"]): r["sim"] for r in similarity.pairs(q, pool_fps(spark)).collect()}
    assert sims[30, 30] == 1.0 and sims[30, 0] < 0.5 and sims[0, 30] == sims[30, 0]


def test_both_pair_ways_agree(spark, monkeypatch):
    fps = pool_fps(spark).select("mol_id", "fp")
    q = fps.withColumnRenamed("mol_id", "query_id")
    one = sorted(map(tuple, similarity.pairs(q, fps, threshold=0.2).collect()))
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "PAIR_STEP", 7)
    assert sorted(map(tuple, similarity.pairs(q, fps, threshold=0.2).collect())) == one
    every = similarity.pairs(q, fps)
    assert sorted(map(tuple, every.where("sim >= 0.2").collect())) == one and every.count() == 1600
    best = lambda found: sorted(map(tuple, similarity.top_k(found, 4).collect()))
    assert best(similarity.pairs(q, fps, k=4)) == best(every)


def test_circular_batches_equal_single_molecules():
    from retort.fixtures import VALID_POOL
    from retort.functions import fingerprints, molecule

    mols = [None, *map(molecule.parse_compat, VALID_POOL), *map(molecule.parse_full, VALID_POOL), molecule.parse_full("[NH4+]"), None]
    got = fingerprints.circular_batch(mols, 3, 512)
    assert all((got[i] == (fingerprints.circular(m, 3, 512) if m else 0)).all() for i, m in enumerate(mols))
    assert not fingerprints.circular_batch([None]).any() and fingerprints.circular_batch([]).shape == (0, 32)


def test_widths_must_agree(spark):
    a = spark.createDataFrame([("CCO",)], "smiles string")
    with pytest.raises(ValueError, match="bits"):
        similarity.check_widths(a.select(columns.fingerprint("smiles").alias("fp")), a.select(columns.fingerprint("smiles", nbits=1024).alias("fp")))


def test_invalid_molecules(spark):
    df = readers.from_list(spark, ["CCO", "NOT_VALID", "c1ccccc1"])
    got = df.select(columns.fingerprint("smiles").alias("fp"), columns.canonical("smiles").alias("c"), columns.descriptors("smiles", ["MolWt"])["MolWt"].alias("w"), columns.matches("smiles", "O").alias("m")).collect()
    assert not any(got[1]["fp"]) and got[1]["c"] is None and math.isnan(got[1]["w"]) and got[1]["m"] is None
    assert descriptors.filter_by_smarts(df, "O").count() == 1 and descriptors.filter_by_smarts(df, "O", True).count() == 1
    with pytest.raises(Exception, match="invalid SMILES"):
        df.select(columns.fingerprint("smiles", backend="rdkit")).collect()
    profile = {r["smiles"]: r for r in descriptors.admet(df).collect()}
    assert profile["NOT_VALID"]["parse_error"] and not profile["NOT_VALID"]["druglike"] and profile["CCO"]["druglike"]
    ids = {r["mol_id"]: r["cluster_id"] for r in cluster.butina(df.select("mol_id", columns.fingerprint("smiles").alias("fp"), columns.parse("smiles")["ok"].alias("valid"))).collect()}
    assert ids[1] == -1 and min(ids[0], ids[2]) == 0
    for bad in (lambda: columns.fingerprint("smiles", "nothing"), lambda: columns.chosen_descriptors(["nothing"]), lambda: columns.cuts("smiles", 3)):
        with pytest.raises(ValueError):
            bad()


def test_scaffold_split(spark):
    smiles = ["Cc1ccccc1", "Clc1ccccc1", "Fc1ccccc1", "c1ccncc1", "Cc1ccncc1", "CCCO", "CCCCO", "CCCCCO"]
    own = split.scaffold_split(split.with_scaffold(readers.from_list(spark, smiles)), 0.6, 0.2)
    assert {r["split"]: r["count"] for r in own.groupBy("split").count().collect()} == {"train": 6, "val": 2}
    again = split.scaffold_split(split.with_scaffold(readers.from_list(spark, ["CCO"] * 3 + ["c1ccccc1", "CCN", "c1ccncc1"])), 0.6, 0.2)
    assert again.count() == 6


def test_kfold(spark):
    own = split.kfold(readers.from_list(spark, ["C"] * 8), 4, 42)
    assert {k: sorted(r["pos"] for r in own.collect() if r["fold"] == k) for k in range(4)} == {0: [2, 3], 1: [4, 5], 2: [0, 6], 3: [1, 7]}
    with pytest.raises(ValueError):
        split.kfold(readers.from_list(spark, ["C"]), 2)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, float("nan")), (3.0, 2.5), (None, 1.0)], "label double, prediction double")
    r = metrics.regression(df).first()
    assert (r["r2"], r["mae"], r["rmse"], r["n"]) == (0.75, 0.5, 0.5, 2)
    r = metrics.regression(df.limit(0)).first()
    assert r["n"] == 0 and math.isnan(r["rmse"])


def test_matched_pairs(spark):
    df = readers.from_list(spark, ["Cc1ccccc1", "Oc1ccccc1", "Oc1ccccc1", "NOT", "Clc1ccccc1"])
    got = mmp.mmpa(df).collect()
    assert len({(r["mol_a"], r["mol_b"]) for r in got}) == 3 and all(r["mol_a"] < r["mol_b"] and r["smiles_a"] != r["smiles_b"] for r in got)
    assert mmp.mmpa(df.limit(1)).count() == 0
    with pytest.raises(Exception, match="two valid"):
        reactions.find_mcs(df.where("smiles = 'NOT'").withColumn("g", F.lit(1)), "g").collect()


def test_graph_arrays(spark):
    df = readers.from_list(spark, ["C", "CCO", "BAD"])
    got = {r["smiles"]: r for r in graph.graph_arrays(df).collect()}
    assert len(got) == 2 and got["C"]["edge_index"] == [[], []] and got["C"]["edge_attr"] == []
    assert len(got["CCO"]["x"]) == 3 and len(got["CCO"]["edge_index"][0]) == 4 and abs(got["C"]["x"][0][8] - 0.12011) < 1e-6
    seq = graph.residue_graph(spark.createDataFrame([("ACDEF",), ("A",)], "sequence string")).collect()
    assert [len(r["x"]) for r in seq] == [5, 1] and [len(r["edge_index"][0]) for r in seq] == [8, 0]
    one = graph.padded_onehot(spark.createDataFrame([("AC",), ("D",)], "sequence string")).collect()
    assert len(one[0]["onehot"]) == 20 and all(len(x) == 2 for x in one[1]["onehot"])


def test_files(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO first\n\n  c1ccccc1\n")
    assert [r["smiles"] for r in readers.smiles_file(spark, str(tmp_path / "a.smi"), True).collect()] == ["CCO", "c1ccccc1"]
    (tmp_path / "a.fasta").write_text(">one\nACD\nEF\n>two\n; note\nmnp\n>bad\nXXX\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "a.fasta")).collect()] == [("one", "ACDEF"), ("two", "MNP")]
    mols = spark.createDataFrame([("CCO", "a", 1.5), ("c1ccccc1", "b", None), ("NOT", "c", 2.0)], "smiles string, name string, label double")
    writers.sdf(mols, str(tmp_path / "sdf"))
    back = readers.with_props(readers.sdf(spark, str(tmp_path / "sdf"))).orderBy("name").collect()
    assert [(r["name"], r["label"]) for r in back] == [("a", "1.5"), ("b", "")]
    writers.parquet(writers.dataset_columns(mols.withColumn("fp", columns.fingerprint("smiles", nbits=64))), str(tmp_path / "d"))
    again = readers.dataset_parquet(spark, str(tmp_path / "d"))
    assert readers.labels_of(again) == ["label"] and again.count() == 3
    with pytest.raises(ValueError):
        readers.checked_path("x.exe", (".parquet",))
    zinc = readers.zinc_records(spark.createDataFrame([('{"zinc_id": "Z1", "smiles": "CCO", "mwt": "46.1"}',), ("{}",)], "json string"))
    assert sorted(map(tuple, zinc.collect())) == [("", "", 0.0, 0.0), ("Z1", "CCO", 46.1, 0.0)]
    bind = spark.createDataFrame([("CCO", "SEQ", "Kinase A", 10.0), ("CC", "SEQ", "other", 1.0)], "Drug string, Target string, Target_ID string, Y double")
    assert [r["label"] for r in readers.dataset(readers.bindingdb(bind, "kinase"), "affinity", True).collect()] == [8.0]


def test_shapes(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 0.0], [1.0, 0.0, 0.0]], [1.0, 1.0]), (None, None)], "xyz array<array<double>>, w array<double>")
    got = df.select(columns.shape_descriptors("xyz", "w").alias("s")).collect()
    assert abs(got[0]["s"]["RadiusOfGyration"] - 0.5) < 1e-9 and got[0]["s"]["PMI1"] < 1e-9 and math.isnan(got[1]["s"]["PMI1"])


def test_stream_equals_batch(spark, tmp_path):
    stream = usage.windowed(usage.event_stream(spark, SF, "events.parquet"), "1 hour", "3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    c = ["window_start", "skill", "calls", "successes", "items"]
    batch = usage.windowed(spark.read.parquet(f"{SF}/events.parquet"))
    assert sorted(map(tuple, spark.table("usage").select(c).collect())) == sorted(map(tuple, batch.select(c).collect()))


def test_sql_functions(spark):
    columns.register(spark)
    own = spark.sql("select f.* from (select explode(array('Cc1ccccc1', 'NOT')) as s) t, lateral mmp_fragments(t.s, 1) f").collect()
    assert len(own) == 1 and own[0]["core"].count("c") == 6 and "C" in own[0]["variable"]
    assert spark.sql("select canonical_smiles('OCC') c, murcko('Cc1ccccc1') m, has_substruct('CCO', 'O') h").first() == ("C(C)O", "c1ccccc1", True)


def test_endpoint_model(spark, tmp_path):
    from retort.operators.endpoints import EndpointModel

    df = readers.from_list(spark, ["CCO", "CCCO", "CCCCO", "c1ccccc1", "Cc1ccccc1", "CCc1ccccc1", "BAD"], [1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0])
    model = EndpointModel.fit(df, trees=10, nbits=256)
    got = {r["smiles"]: r["prediction"] for r in model.predict(df).collect()}
    assert got["CCO"] > 0.5 > got["Cc1ccccc1"] and math.isnan(got["BAD"])
    model.save(str(tmp_path / "m"))
    flags = {r["smiles"]: r["positive"] for r in EndpointModel.load(str(tmp_path / "m"), nbits=256).predict_with_threshold(df).collect()}
    assert flags["CCO"] is True and flags["BAD"] is None


def test_bytes_of_bits(spark):
    """Against bytes made one by one: nulls, no words, widths that differ, the sign bit, tails of less than a word."""
    rows = [[1, -1, 1 << 62], [-(1 << 63)], [], None, [0, 5]]
    plain = [None if r is None else bytes(w >> b & 1 for w in r for b in range(64)) for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, fp array<bigint>").coalesce(1)
    there = writers.dataset_columns(df).orderBy("i").select("fingerprints", readers.bytes_to_words("fingerprints").alias("back")).collect()
    assert [None if r["fingerprints"] is None else bytes(r["fingerprints"]) for r in there] == plain and [r["back"] for r in there] == rows
    odd = [plain[0] + b"\1" * 63, b"\1\2\x11" + b"\0" * 61, b"\1" * 3, b"", None, plain[1] + b"\1"]
    got = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(odd)], "i int, b binary").coalesce(1).orderBy("i").select(readers.bytes_to_words("b")).collect()
    assert [r[0] for r in got] == [rows[0], [5], [], [], None, rows[1]]


def test_roundtrip_rows_are_not_broadcast(spark):
    own = QUERIES["parquet_roundtrip"](spark, SF)
    assert own.count() == 200 and "SortMergeJoin" in own._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_large_cores_equal_plain_ones(spark, monkeypatch):
    """Blocks of a core, a molecule with two variables, and as many tasks as the pairs ask for, not the few rows."""
    monkeypatch.setattr(mmp, "CORE_BLOCK", 7)
    monkeypatch.setattr(mmp, "TASK_PAIRS", 100)
    rows = [(f"m{i % 90}", "a" if i % 3 else "b", f"v{i % 4}", f"e{i % 90}") for i in range(100)]
    first = {c: min(r for r in rows if r[1] == c)[3] for c in "ab"}
    want = sorted((p[0], q[0], p[2], q[2], p[1], f"{p[2]}>>{q[2]}", first[p[1]]) for p in rows for q in rows if p[1] == q[1] and p[0] < q[0] and p[2] != q[2])
    got = mmp.pairs(spark.createDataFrame(rows, "mol string, core string, variable string, environment string").coalesce(1))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    met = sum(sum(r[1] == c for r in rows) ** 2 for c in "ab") // 2
    assert got.rdd.getNumPartitions() == met // 100


def test_kfold_equals_pythons_shuffle(spark, monkeypatch):
    """At a size for which the SQL has no shuffle, dealt at once and in pieces."""
    n = 20_000
    places = list(range(n))
    random.Random(42).shuffle(places)
    want = sorted((p, p, i % 5) for i, p in enumerate(places))
    for piece in (1_000_000, 7_000):
        monkeypatch.setattr(split, "PIECE", piece)
        assert sorted(map(tuple, QUERIES["kfold"](spark, "/root/testdata/sf0.1").collect())) == want
