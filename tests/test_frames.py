"""Whole tables: places, columns, benchmark splits, tranches, and what must be there."""

import pytest
from pyspark.sql import functions as F

from retort.functions import columns
from retort.operators import descriptors, frames, mmp, reactions, split
from retort.sources import readers


@pytest.mark.parametrize("kind,ids", [("string", [f"CHEMBL{i}" for i in range(40)]), ("long", [(1 << 60) + i for i in range(40)]), ("string", ["a"] * 5 + [None, "b"]), ("date", [None])])
def test_places_by_any_column(spark, kind, ids):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"id string, n long").select(F.col("id").cast(kind).alias("id"), "n").repartition(3) if kind != "long" else spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id long, n long").repartition(3)
    got = split.numbered(df, "id").collect()
    assert sorted(r["pos"] for r in got) == list(range(len(ids)))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == sorted((r["id"] for r in got), key=lambda x: (x is not None, x))
    if len(ids) == 40:
        assert sorted(r["fold"] for r in split.kfold(df, 5, order="id").collect()) == sorted(i % 5 for i in range(40))


def test_places(spark):
    df = readers.from_list(spark, ["C", "CC", "CCC"], [1.0, 2.0, 3.0])
    assert [frames.take(df, i).first()["smiles"] for i in (0, 2, -1, -3)] == ["C", "CCC", "CCC", "C"]
    for i in (3, -4):
        with pytest.raises(IndexError):
            frames.take(df, i)
    assert [r["smiles"] for r in frames.subset(df, [2, 0, 2]).orderBy("at").collect()] == ["CCC", "C", "CCC"]


def test_columns(spark):
    df = readers.from_list(spark, ["CCO", "NOT"], [1.0, 2.0])
    assert frames.to_dataframe(df.withColumn("fp", F.array(F.lit(1))).withColumn("mw", F.lit(1.0))).columns == ["smiles", "mw", "label", "mol_id"]
    assert frames.require(df, "labels") == ["label"]
    for what in ("fingerprints", "descriptors"):
        with pytest.raises(ValueError, match=what):
            frames.require(df, what)
    wide = frames.add_fingerprints(df, "maccs", prefix="k", expand_cols=True)
    assert wide.columns[-1] == "k_166" and sum(wide.orderBy("mol_id").collect()[1][3:]) == 0
    assert frames.add_fingerprints(df, nbits=128).select(F.size("fp")).first()[0] == 2
    # a preset wins over names
    assert "MolLogP" in descriptors.named(df, ["RingCount"]).columns and descriptors.named(df, ["RingCount"], None).columns[-1] == "RingCount"


def test_benchmark_splits(spark):
    rows = [(f"{'C' * (i % 7 + 1)}c1ccc{'n' if i % 3 else 'c'}cc1", float(i), "SEQ", f"T{i % 2}") for i in range(30)]
    df = spark.createDataFrame(rows, "Drug string, Y double, Target string, Target_ID string")
    for method in ("scaffold", "random"):
        parts = readers.tdc_splits(df, method)
        assert sum(p.count() for p in parts.values()) == 30 and list(parts) == ["train", "valid", "test"]
    scaffolds = [{r[0] for r in p.select(columns.scaffold("Drug")).collect()} for p in readers.tdc_splits(df).values()]
    assert not (scaffolds[0] & scaffolds[1] or scaffolds[0] & scaffolds[2] or scaffolds[1] & scaffolds[2])
    given = readers.tdc_splits(df.withColumn("split", F.when(F.col("Y") < 5, "valid").otherwise("train")))
    assert [given[k].count() for k in given] == [25, 5, 0]
    own = readers.tdc_molecules(df, "Kd", "train").where("smiles like 'C%'").orderBy("label").collect()
    assert own[0]["tdc_dataset"] == "Kd" and own[0]["target_id"][0] == "T" and own[-1]["label"] == 15.0
    assert readers.tdc_molecules(df.where("Y < 2"), "hERG", "test").agg(F.max("label")).first()[0] == 1.0
    with pytest.raises(ValueError):
        readers.tdc_splits(df, "nothing")


def test_tranche(spark, tmp_path):
    (tmp_path / "t.txt").write_text("CCO Z1\n\n  \nCCC Z2\nCCCC Z3\n")
    assert [r["smiles"] for r in readers.zinc_tranche(spark, str(tmp_path / "t.txt"), 2).collect()] == ["CCO", "CCC"]


def test_bimolecular_blocks(spark, monkeypatch):
    acids, amines = readers.from_list(spark, ["CC(=O)O", "OC(=O)c1ccccc1", "CCO"]), readers.from_list(spark, ["NC", "NCC", "NCCC", "C"])
    smarts = "[C:1](=[O:2])[OH].[NH2:3][C:4]>>[C:1](=[O:2])[NH:3][C:4]"
    one = [r["product"] for r in reactions.enumerate_pairs(acids, amines, smarts).collect()]
    monkeypatch.setattr(reactions, "PARTNERS", 1)
    assert [r["product"] for r in reactions.enumerate_pairs(acids, amines, smarts).collect()] == one and len(one) == 6


def test_large_cores_are_dealt_in_parts(spark, monkeypatch):
    rows = [(f"m{i:02}", "c1" if i < 15 else "c2", f"v{i % 6}", f"e{i}") for i in range(20)]
    frags = spark.createDataFrame(rows, "mol string, core string, variable string, environment string")
    one = sorted(map(tuple, mmp.pairs(frags).collect()))
    monkeypatch.setattr(mmp, "CORE_BLOCK", 4)
    assert sorted(map(tuple, mmp.pairs(frags).collect())) == one and len(one) > 90
