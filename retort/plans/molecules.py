"""Queries over the molecule library and the driver's tables, one for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import POOL, distinct_library, forms, library, pool, table
from ..functions import columns
from ..operators import cluster, descriptors, frames, graph, graphnet, metrics, mmp, pooling, reactions, retrieval, similarity, similarity_index, split
from ..sources import readers, writers
from ..streaming import totals, usage
from ..tables import shared_folder, stored

QUERY_IDS = [1, 10, 30]  # benzene, aspirin, benzoic acid
ACID = 30
# Literal scaffolds of the pool, for splits that do not depend on a scaffold definition.
SCAFFOLDS = [f"s{(i * i + 3 * i) % 11}" for i in range(len(POOL))]
QUESTIONS = ["What is the logP of aspirin?", "molecular weight of Caffeine", "Tell me about ethanol structure and tpsa", "anything else"]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.with_parsed(library(spark, sf_dir))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library(spark, sf_dir).withColumn("fp", columns.fingerprint("smiles"))


def query_fps(spark: SparkSession, ids=QUERY_IDS) -> DataFrame:
    return pool(spark).where(F.col("pool_id").isin(ids)).select(F.col("pool_id").alias("query_id"), columns.fingerprint("smiles").alias("fp"))


def pool_fps(spark: SparkSession) -> DataFrame:
    return pool(spark).select(F.col("pool_id").alias("mol_id"), "smiles", columns.fingerprint("smiles").alias("fp"), columns.parse("smiles")["ok"].alias("valid"))


def literal_scaffolds(spark, sf_dir) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(SCAFFOLDS)), "pool_id long, scaffold string")
    return library(spark, sf_dir).join(F.broadcast(names), "pool_id").select("mol_id", "smiles", "label", "scaffold")


def mol_scan(spark, sf_dir):
    return library(spark, sf_dir).where(readers.valid_smiles("smiles")).select("mol_id", "smiles", F.length("smiles").cast("long").alias("n_chars"))


def builtin_descriptors(spark, sf_dir):
    return descriptors.builtin(parsed(spark, sf_dir)).select("mol_id", "mw", "logp", "heavy_atoms")


def atom_table(spark, sf_dir):
    return graph.atoms(parsed(spark, sf_dir)).select("mol_id", "idx", "atomic_num", F.col("is_aromatic").cast("int").alias("is_aromatic"), "chirality")


def bond_table(spark, sf_dir):
    return graph.bonds(parsed(spark, sf_dir))


def atom_passes(spark, sf_dir):
    return graph.atoms(parsed(spark, sf_dir)).select("mol_id", "idx", "num_hs", "degree", F.col("in_ring").cast("int").alias("in_ring"), "hybridization")


def node_features(spark, sf_dir):
    own = graph.graph_arrays(library(spark, sf_dir)).select("mol_id", F.posexplode("x").alias("idx", "f"))
    return own.select("mol_id", "idx", *[F.col("f")[k].cast("double").cast("long").alias(f"f{k}") for k in range(8)], F.round(F.col("f")[8].cast("double"), 5).alias("f8"))


def edge_index(spark, sf_dir):
    own = graph.graph_arrays(library(spark, sf_dir)).select("mol_id", F.posexplode(F.arrays_zip(F.col("edge_index")[0].alias("a"), F.col("edge_index")[1].alias("b"), F.col("edge_attr").alias("e"))).alias("edge", "v"))
    return own.select("mol_id", "edge", F.col("v.a").alias("src"), F.col("v.b").alias("dst"), *[F.col("v.e")[k].cast("int").alias(f"b{k + 1}") for k in range(4)])


def hetero_nodes(spark, sf_dir):
    return graph.hetero_nodes(parsed(spark, sf_dir)).select("mol_id", "idx", "node_type", F.col("local_idx").cast("long").alias("local_idx"))


def hetero_edges(spark, sf_dir):
    own = graph.hetero_edges(parsed(spark, sf_dir))
    return own.groupBy("mol_id", "src_type", "dst_type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("src_local").cast("long").alias("src_sum"), F.sum("dst_local").cast("long").alias("dst_sum"))


def ecfp_bits(spark, sf_dir):
    fp = fingerprints(spark, sf_dir)
    return fp.select("mol_id", F.explode(similarity.on_bits(F.col("fp"), 2048)).alias("bit")).withColumn("bit", F.col("bit").cast("long"))


def ecfp_popcount(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("mol_id", similarity.popcount("fp").cast("long").alias("n_bits"))


def tanimoto_pairs(spark, sf_dir):
    return similarity.pairs(query_fps(spark), fingerprints(spark, sf_dir)).select("query_id", "mol_id", F.col("inter").cast("long").alias("inter"), F.col("union_n").cast("long").alias("union_n"), "sim")


def similarity_topk(spark, sf_dir):
    return similarity.top_k(similarity.pairs(query_fps(spark), fingerprints(spark, sf_dir), k=10), 10).select("query_id", "mol_id", "sim", F.col("rank").cast("long").alias("rank"))


def screen_threshold(spark, sf_dir):
    return similarity.screen(similarity.pairs(query_fps(spark), fingerprints(spark, sf_dir), threshold=0.3), 0.3, 50).select("query_id", "mol_id", "sim")


def screen_counts(spark, sf_dir):
    return similarity.screen_counts(similarity.pairs(query_fps(spark), fingerprints(spark, sf_dir)), 0.3)


def screen_best(spark, sf_dir):
    return similarity.screen_best(similarity.pairs(query_fps(spark), fingerprints(spark, sf_dir)), 100).select(F.col("rank").cast("long").alias("rank"), "mol_id", "similarity")


def tanimoto_embeddings(spark, sf_dir):
    """Embeddings made binary by sign; every row whose id is divisible by 20 is a query. The bits are one word, so all sides are small integers."""
    own = table(spark, sf_dir, "embeddings")
    word = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.when(i == 63, F.lit(-(1 << 63))).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    own = own.select(F.col("vec_id").alias("mol_id"), F.array(word).alias("fp"))
    q = own.where(F.col("mol_id") % 20 == 0).select(F.col("mol_id").alias("query_id"), "fp")
    found = similarity.pairs(q, own, 64, k=6).where("query_id <> mol_id")
    return similarity.top_k(found, 5).select("query_id", "mol_id", F.col("rank").cast("long").alias("rank"), F.col("inter").cast("long").alias("inter"))


def tanimoto_join(spark, sf_dir):
    """Molecules of the library of distinct ones that are like one of its twentieth, by the index where that has fewer rows than comparing is worth."""
    own = stored(distinct_library(spark, sf_dir).select("mol_id", columns.fingerprint("smiles").alias("fp")), "fingerprints")
    q = own.where(F.col("mol_id") % 20 == 0).select(F.col("mol_id").alias("query_id"), "fp")
    return similarity_index.near_pairs(q, own, 2048, 0.6).select("query_id", "mol_id", F.col("inter").cast("long").alias("inter"), F.col("union_n").cast("long").alias("union_n"))


def ro5_filter(spark, sf_dir):
    return descriptors.builtin(parsed(spark, sf_dir)).where(F.col("parsed.ok") & descriptors.rule_of_five()).select("mol_id", "smiles")


def rule_flags(spark, sf_dir):
    """The rules on stand-in descriptors made from part, so that SQL can state them."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("mol_id"), (F.col("p_partkey") % 700).cast("double").alias("mw"), ((F.col("p_partkey") % 83) / 10.0).alias("logp"), (F.col("p_partkey") % 9).alias("hbd"), (F.col("p_partkey") % 15).alias("hba"), (F.col("p_partkey") % 13).alias("rot_bonds"), (F.col("p_partkey") % 180).cast("double").alias("tpsa"))
    return descriptors.rule_flags(own).select("mol_id", *[F.col(c).cast("int").alias(c) for c in ("lipinski_pass", "veber_pass", "egan_pass")])


def pic50(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("mol_id"), F.round(descriptors.pic50("p_retailprice"), 6).alias("pic50"))


def scaffold_groups(spark, sf_dir):
    return split.scaffold_groups(literal_scaffolds(spark, sf_dir)).select("scaffold", "size", "first")


def scaffold_split(spark, sf_dir):
    return split.scaffold_split(literal_scaffolds(spark, sf_dir)).select("mol_id", "scaffold", "split")


def kfold_sizes(spark, sf_dir):
    own = split.kfold(library(spark, sf_dir), 5, 42)
    return own.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def kfold(spark, sf_dir):
    return split.kfold(library(spark, sf_dir), 5, 42).select("mol_id", "pos", "fold")


def scaffold_kfold(spark, sf_dir):
    own = split.scaffold_kfold(literal_scaffolds(spark, sf_dir), 4, 42)
    return own.groupBy("scaffold").agg(F.count_distinct("fold").alias("folds"), F.max("fold").alias("fold"), F.count(F.lit(1)).alias("n"))


def duplicate_occurrence(spark, sf_dir):
    return split.occurrence(library(spark, sf_dir)).select("mol_id", F.col("occurrence").cast("long").alias("occurrence"))


def substructure_acids(spark, sf_dir):
    return descriptors.filter_by_smarts(library(spark, sf_dir), "[CX3](=O)[OH]").select("mol_id", "smiles")


def substructure_inverted(spark, sf_dir):
    return descriptors.filter_by_smarts(library(spark, sf_dir), "[CX3](=O)[OH]", True).select("mol_id", "smiles")


def checked(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("mol_id", "fp", columns.parse("smiles")["ok"].alias("valid"))


def butina_neighbours(spark, sf_dir):
    """Pairs of classes of molecules with equal fingerprints, by their last members, and the classes' sizes."""
    own = stored(cluster.classes(checked(spark, sf_dir).where("valid")), "classes")
    near = cluster.neighbours(own, 0.4).select("a", "b")
    size = lambda c: own.select(F.col("mol_id").alias(c), F.col("size").alias(f"{c}_size"))
    return near.join(size("a"), "a").join(size("b"), "b")


def butina_clusters(spark, sf_dir):
    return cluster.butina(checked(spark, sf_dir), 0.4).select("mol_id", F.col("cluster_id").cast("long").alias("cluster_id"))


def maxmin_pick(spark, sf_dir):
    return cluster.diversity_pick(checked(spark, sf_dir).where("valid").select("mol_id", "fp"), 6, 42).select(F.col("pick").cast("long").alias("pick"), "mol_id")


def mmp_pairs(spark, sf_dir):
    """Parts as fragments: brand and size stand for the core, the type for what is exchanged."""
    frags = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("mol"), F.concat_ws("|", "p_brand", "p_size").alias("core"), F.col("p_type").alias("variable"), F.lit(None).cast("string").alias("environment"))
    return mmp.pairs(frags).drop("environment")


def regression_metrics(spark, sf_dir):
    """Two integer columns of part as label and prediction, with some predictions missing."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("label"), F.when(F.col("p_partkey") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("p_partkey") % 50).cast("double")).alias("prediction"))
    out = metrics.regression(own, by=["brand"])
    return out.select("brand", F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")


def uncertainty_stats(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mol_id"), F.col("l_quantity").alias("prediction"))
    return metrics.uncertainty(own).select("mol_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def skill_stats(spark, sf_dir):
    own = metrics.from_events(table(spark, sf_dir, "events")).withColumn("duration_ms", F.round(F.col("duration_ms") * 1000).cast("long"))
    out = metrics.skill_stats(own, ["skill"])
    return out.select("skill", "calls", "successes", "failures", "total_ms", "items", F.round("success_rate", 6).alias("success_rate"), F.round("avg_ms", 4).alias("avg_ms"), F.round("throughput", 6).alias("throughput"))


def running_totals(spark, sf_dir):
    """The table events as a stream through keyed state: totals by skill."""
    own = totals.session(spark)
    folder = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    stream = totals.running_totals(totals.from_events(usage.event_stream(own, sf_dir, "events.parquet")), shards=2)
    totals.drained(totals.start(stream, f"{folder}/totals", f"{folder}/checkpoint"))
    return totals.merged(spark, f"{folder}/totals").drop("idle")


def rag_relevance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(QUESTIONS)], "question long, query string")
    return docs.join(F.broadcast(q)).select("doc_id", "question", retrieval.relevance(F.col("query"), F.col("text")).alias("score"))


def asked(spark, sf_dir, questions=QUESTIONS):
    """(conv_id, turn, question, query): one of the questions for each turn of the conversations."""
    q = spark.createDataFrame(list(enumerate(questions)), "question long, asked string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").withColumn("question", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(questions))))
    return turns.join(F.broadcast(q), "question").select("conv_id", "turn", "question", F.concat("conv_id", F.lit("/"), "turn", F.lit(": "), "asked").alias("query"))  # a few questions


def rag_rewrite(spark, sf_dir):
    q = asked(spark, sf_dir)
    return q.select("conv_id", "turn", retrieval.rewrite(F.col("query")).alias("rewritten"), F.array_join(retrieval.extracted(F.col("query")), "|").alias("extracted"))


def rag_answer(spark, sf_dir):
    q = asked(spark, sf_dir)
    chunks = spark.createDataFrame([(0, "pubchem", "XLogP=3.5 LogP logp", 0), (0, "local", "SMILES: CCO, MW=46.07", 1), (2, "local", "no numbers", 0)], "question long, source string, content string, pos int")
    out = retrieval.answer(q.select("query"), q.join(F.broadcast(chunks), "question").select("query", "source", "content", "pos"))
    return out.select("query", "answer", F.array_join("sources", ",").alias("sources"), F.col("relevant").cast("int").alias("relevant"), "score", F.col("iterations").cast("int").alias("iterations"))


def proteins(spark, sf_dir):
    """A FASTA file of the parts: their names' letters as sequences in two lines with a comment between; every other part's without the letters that stand for no residue."""
    name = F.upper(F.regexp_replace("p_name", "[^A-Za-z]", ""))
    sequence = F.when(F.col("p_partkey") % 2 == 0, F.translate(name, "BJOUXZ", "ADEFGH")).otherwise(name)
    half = (F.length("s") / 2).cast("int")
    own = table(spark, sf_dir, "part").select("p_partkey", "p_brand", sequence.alias("s"))
    text = F.concat(F.lit(">part|"), "p_partkey", F.lit("|"), "p_brand", F.lit("\n"), F.substr("s", F.lit(1), half), F.lit("\n; half\n"), F.lower(F.substr("s", half + 1)))
    path = f"{shared_folder(spark)}/proteins-{uuid.uuid4().hex}"
    own.select(text.alias("value")).write.text(path)
    return readers.fasta(spark, path)


def fasta_parse(spark, sf_dir):
    return proteins(spark, sf_dir)


def residue_composition(spark, sf_dir):
    """Of each sequence's graph: residues by kind, from the one-hot rows, and edges."""
    own = graph.residue_graph(proteins(spark, sf_dir))
    kinds = F.transform("x", lambda row: F.element_at(F.array(*[F.lit(r) for r in graph.RESIDUES]), F.array_position(row, F.lit(1.0).cast("float")).cast("int")))
    return own.select("name", F.explode(kinds).alias("residue"), F.size(F.col("edge_index")[0]).alias("e")).groupBy("name", "residue").agg(F.count(F.lit(1)).alias("n"), F.first("e").cast("long").alias("n_edges"))


def chembl_parse(spark, sf_dir):
    """A record's JSON for each part, with parts of it missing."""
    key, own = F.col("mol_id"), library(spark, sf_dir)
    present = lambda k, c: F.when(key % k != 0, c)
    properties = F.struct(((key % 700) + 0.25).cast("string").alias("full_mwt"), present(4, (key % 9 - 0.5).cast("string")).alias("alogp"), (key % 11).cast("string").alias("hba"), (key % 6).cast("string").alias("hbd"), (key % 130 + 0.5).cast("string").alias("psa"), (key % 3).cast("string").alias("num_ro5_violations"))
    record = F.struct(F.concat(F.lit("CHEMBL"), key).alias("molecule_chembl_id"), present(3, F.concat(F.lit("NAME "), key)).alias("pref_name"), present(5, F.struct(F.col("smiles").alias("canonical_smiles"))).alias("molecule_structures"), present(7, properties).alias("molecule_properties"))
    return readers.chembl_records(own.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("json")))


def parquet_roundtrip(spark, sf_dir):
    """The dataset layout written and read again: a byte for each bit, back to words."""
    own = library(spark, sf_dir).withColumn("fp", columns.fingerprint("smiles"))
    again = stored(writers.dataset_columns(own.select("mol_id", "smiles", "label", "fp")), "roundtrip")
    back = again.withColumn("fp", readers.bytes_to_words("fingerprints"))
    old = own.select("mol_id", F.col("fp").alias("old"))
    # fingerprints that repeat are small files and large rows: neither side may be broadcast
    return back.join(old.hint("merge"), "mol_id").select("mol_id", "smiles", "label", (F.col("fp") == F.col("old")).cast("int").alias("same"), similarity.popcount("fp").cast("long").alias("n_bits"), F.col("fp_nbits").cast("long").alias("fp_nbits"))


def record_layout(spark, sf_dir):
    own = descriptors.builtin(parsed(spark, sf_dir)).withColumn("fp", columns.fingerprint("smiles"))
    out = writers.record_columns(own)
    bits = F.aggregate(F.transform(F.split(F.translate(F.hex("fingerprint"), "0123456789ABCDEF", "0112122312232334"), "(?<=.)"), lambda d: d.try_cast("int")), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return out.groupBy("smiles").agg(F.count(F.lit(1)).alias("n"), F.first("n_atoms").cast("long").alias("n_atoms"), F.first("n_bonds").cast("long").alias("n_bonds"), F.first(F.length("fingerprint")).cast("long").alias("n_bytes"), F.first(bits).cast("long").alias("n_bits"))


def events_tumbling(spark, sf_dir):
    out = usage.windowed(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "skill", "calls", "successes", "items")


def label_rates(spark, sf_dir):
    own = table(spark, sf_dir, "labels")
    return own.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("positives"))


# Queries whose rows SQL cannot state.


def canonical_smiles(spark, sf_dir):
    return library(spark, sf_dir).select("mol_id", columns.canonical("smiles").alias("canonical"), columns.standardize("smiles").alias("standard"), columns.strip_salts("smiles").alias("stripped"), columns.neutralize("smiles").alias("neutral"))


def murcko_scaffolds(spark, sf_dir):
    return split.with_scaffold(library(spark, sf_dir)).select("mol_id", "scaffold")


def named_descriptors(spark, sf_dir):
    return descriptors.named(library(spark, sf_dir), preset="druglike").drop("pool_id", "label")


def admet_screen(spark, sf_dir):
    return descriptors.admet(library(spark, sf_dir)).drop("pool_id", "label")


def other_fingerprints(spark, sf_dir):
    kinds = ("maccs", "atompairs", "torsions", "rdkit_path")
    return library(spark, sf_dir).select("mol_id", *[similarity.popcount(columns.fingerprint("smiles", k)).alias(k) for k in kinds])


def mmpa(spark, sf_dir):
    return mmp.mmpa(library(spark, sf_dir), 1, 3)


def mmpa_double(spark, sf_dir):
    return mmp.mmpa(library(spark, sf_dir), 2)


def reaction_products(spark, sf_dir):
    return reactions.enumerate_products(library(spark, sf_dir), "[C:1](=[O:2])[OH:3]>>[C:1](=[O:2])[O:3]C")


def rgroup_table(spark, sf_dir):
    own = reactions.rgroup_decompose(library(spark, sf_dir), "c1ccccc1")
    return own.select("mol_id", F.map_entries("rgroups").alias("rgroups"))


def common_substructure(spark, sf_dir):
    """The common part of each series of molecules with one scaffold, of two different ones at least."""
    own = split.with_scaffold(library(spark, sf_dir).where(columns.parse("smiles", "full")["ok"])).where("scaffold <> ''").select("scaffold", "smiles").distinct()
    series = own.groupBy("scaffold").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scaffold")
    found = reactions.find_mcs(own.join(series, "scaffold", "left_semi"), "scaffold")
    return found.select("scaffold", "n", F.size(F.regexp_extract_all("mcs", F.lit("#[0-9]+|\\[[A-Za-z]|[A-Z][a-z]?|[bcnops]"), F.lit(0))).cast("long").alias("n_atoms"))


def sdf_roundtrip(spark, sf_dir):
    text = writers.sdf_text(library(spark, sf_dir).select("smiles", "mol_id"), ["mol_id"])
    back = readers.sdf_records(text.select(F.col("value").alias("record"))).select(F.col("smiles").alias("back"), F.col("props")["mol_id"].cast("long").alias("mol_id"))
    own = library(spark, sf_dir).select("mol_id", columns.canonical("smiles").alias("canonical"))
    read = columns.parse("back", "full")
    both = back.join(own, "mol_id").select("mol_id", (F.col("back") == F.col("canonical")).cast("int").alias("same"), read.alias("p"))
    hydrogens = F.aggregate("p.num_hs", F.lit(0), lambda a, h: a + h)
    return both.select("mol_id", "same", F.size("p.z").cast("long").alias("n_atoms"), F.size("p.src").cast("long").alias("n_bonds"), hydrogens.cast("long").alias("n_hydrogens"))


def canonical_classes(spark, sf_dir):
    """Which molecules of the pool are written alike: each one's first pool number with the same text, in three forms."""
    own = pool(spark).select("pool_id", columns.canonical("smiles").alias("canonical"), columns.standardize("smiles").alias("standard"), columns.scaffold("smiles", True).alias("frame")).where("canonical is not null")
    first = lambda c: F.min("pool_id").over(Window.partitionBy(c)).alias(c)
    named = own.select("pool_id", *[first(c) for c in ("canonical", "standard", "frame")])
    return library(spark, sf_dir).select("mol_id", "pool_id").join(F.broadcast(named), "pool_id").select("mol_id", "canonical", "standard", "frame")


def drawn_forms(spark, sf_dir):
    """Of drawings of stereoisomers and tautomers: how many molecules have the same canonical and the same standard text, and the first of them."""
    own = forms(spark, sf_dir).select("mol_id", "form_id", columns.canonical("smiles").alias("canonical"), columns.standardize("smiles").alias("standard"))
    own = stored(own, "drawn-forms")
    for c in ("canonical", "standard"):
        own = own.join(own.groupBy(c).agg(F.min("mol_id").alias(f"{c}_first"), F.count("*").alias(f"{c}_n")), c)
    return own.select("mol_id", "form_id", "canonical_first", "canonical_n", "standard_first", "standard_n")


def conformer_bonds(spark, sf_dir):
    """Of one conformer of each molecule: atoms, bonds of about the length that their elements have, and pairs of atoms that come too close."""
    own = library(spark, sf_dir).select("mol_id", columns.parse("smiles", "full").alias("p"), F.get(columns.conformers("smiles"), F.lit(0)).alias("xyz")).where("xyz is not null")
    apart = "sqrt(aggregate(zip_with(xyz[{0}], xyz[{1}], (x, y) -> (x - y) * (x - y)), 0d, (s, d) -> s + d))"
    bonds = f"transform(arrays_zip(p.src, p.dst, p.bond), b -> struct(b.bond as o, {apart.format('b.src', 'b.dst')} as d, p.z[b.src] as y, p.z[b.dst] as z))"
    # single bonds of second-row atoms 1.25 to 1.65, double and aromatic 1.15 to 1.5, triple 1.1 to 1.3; with a heavier atom up to 2.2
    fits = "if(x.y > 9 or x.z > 9, x.d between 1.3 and 2.2, case x.o when 1 then x.d between 1.25 and 1.65 when 3 then x.d between 1.1 and 1.3 else x.d between 1.15 and 1.5 end)"
    close = f"aggregate(transform(sequence(0, size(xyz) - 1), i -> size(filter(sequence(0, size(xyz) - 1), j -> j < i and {apart.format('i', 'j')} < 1.05))), 0, (s, n) -> s + n)"
    return own.select("mol_id", F.size("xyz").cast("long").alias("n_atoms"), F.size(F.expr(f"filter({bonds}, x -> {fits})")).cast("long").alias("n_bonds"), F.expr(close).cast("long").alias("n_close"))


# Letters that words are counted by.
LETTERS = "etaoinshrdlu"


def token_pooling(spark, sf_dir):
    """Words of conversations as vectors of letter counts, pooled for each conversation; words before a full stop are masked."""
    words = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    tokens = words.select("conv_id", F.array(*[(F.length("w") - F.length(F.translate("w", c, ""))).cast("double") for c in LETTERS]).alias("vector"), (~F.col("w").endswith(".")).cast("int").alias("mask"))
    out = pooling.masked_mean(tokens, len(LETTERS), "conv_id")
    return out.select("conv_id", F.col("n").alias("n_tokens"), *[F.round(F.get("mean", F.lit(i)), 9).alias(f"mean_{c}") for i, c in enumerate(LETTERS)])


def graph_regression(spark, sf_dir):
    """A small network trained on the distinct molecules' labels: predictions with their spread over dropout draws, and the atom that counts most."""
    own = distinct_library(spark, sf_dir).select("mol_id", "smiles", (F.col("label") / 1000).alias("y"))
    model = graphnet.PropertyModel.fit(own, ["y"], shape=graphnet.Shape(16, 2, 0.1, 1), epochs=5, lr=0.02)
    out = own.select("mol_id", model.predict()[0].alias("prediction"), model.predict_with_uncertainty(samples=5)[0][1].alias("std"), model.attribution(steps=32).alias("a"))
    top = F.array_position("a", F.array_max("a")) - 1
    return out.where("a is not null").select("mol_id", F.round("prediction", 6).alias("prediction"), F.round("std", 6).alias("std"), F.size("a").cast("long").alias("n_atoms"), top.alias("top_atom"))


def formula_descriptors(spark, sf_dir):
    names = ["MolWt", "HeavyAtomMolWt", "HeavyAtomCount", "NumHeteroatoms", "NOCount", "NHOHCount", "RingCount", "NumFragments"]
    own = descriptors.named(library(spark, sf_dir), names, None).where(~F.isnan("MolWt"))
    return own.select("mol_id", *[F.round(n, 3).alias(n) for n in names])


def graph_descriptors(spark, sf_dir):
    names = ["ExactMolWt", "NumValenceElectrons", "Chi0", "Chi1", "Chi2", "fr_COOH", "fr_halogen", "fr_methoxy", "fr_alkyne", "NumAromaticHeterocycles", "NumSaturatedCarbocycles"]
    own = descriptors.named(library(spark, sf_dir), names, None).where(~F.isnan("ExactMolWt"))
    return own.select("mol_id", *[F.round(n, 4).alias(n) for n in names])


def substructure_atoms(spark, sf_dir):
    """Atom numbers of carboxylic acids."""
    own = library(spark, sf_dir).select("mol_id", F.explode(columns.substructures("smiles", "[CX3](=O)[OH]")).alias("m"))
    return own.select("mol_id", F.array_join("m", ",").alias("atoms"))


def multitask_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_size").cast("double").alias("y0"), (F.col("p_partkey") % 11).cast("double").alias("y1"), F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).otherwise((F.col("p_partkey") % 50).cast("double")).alias("p0"), (F.col("p_partkey") % 13).cast("double").alias("p1"))
    out = metrics.regression_pooled(own, ["y0", "y1"], ["p0", "p1"])
    return out.select(F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n")


def smiles_file_roundtrip(spark, sf_dir):
    """The library as a text file, one SMILES and its number a line, read again by first words."""
    path = f"{shared_folder(spark)}/smiles-{uuid.uuid4().hex}"
    library(spark, sf_dir).select(F.concat("smiles", F.lit(" "), F.col("mol_id").cast("string")).alias("value")).write.text(path)
    return readers.smiles_file(spark, path, first_token=True).groupBy("smiles").agg(F.count(F.lit(1)).alias("n"))


def activity_records(spark, sf_dir):
    """Activity answers made of the library, one for each brand, read again; prices stand for values."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    lib = library(spark, sf_dir).join(p, F.col("mol_id") == F.col("p_partkey"))
    one = F.struct(F.concat(F.lit("CHEMBL"), F.col("mol_id").cast("string")).alias("molecule_chembl_id"), F.col("smiles").alias("canonical_smiles"), F.when(F.col("mol_id") % 10 != 0, F.col("p_retailprice").cast("string")).alias("standard_value"), F.lit("nM").alias("standard_units"), F.col("p_brand").alias("assay_chembl_id"))
    answers = lib.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(one).alias("activities"))).alias("json"))
    return readers.chembl_activities(answers.select("json"))


def record_lookup(spark, sf_dir):
    """SMILES by identifier: every third molecule and as many identifiers that do not exist are asked for; records of invalid molecules have no structure."""
    lib = library(spark, sf_dir)
    structure = F.when(F.col("pool_id") != 39, F.struct(F.col("smiles").alias("canonical_smiles")))
    json = lib.select(F.to_json(F.struct(F.concat(F.lit("CHEMBL"), F.col("mol_id").cast("string")).alias("molecule_chembl_id"), structure.alias("molecule_structures"))).alias("json"))
    asked = lib.where("mol_id % 3 = 0").select(F.explode(F.array(F.concat(F.lit("CHEMBL"), F.col("mol_id").cast("string")), F.concat(F.lit("NONE"), F.col("mol_id").cast("string")))).alias("chembl_id"))
    return readers.chembl_smiles(asked, readers.chembl_records(json))


def shape_descriptors(spark, sf_dir):
    """Each order's lines as points with masses."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100).alias("xyz"), F.col("l_linenumber").cast("double").alias("m")))).alias("p"))
    own = lines.select("l_orderkey", columns.shape_descriptors(F.transform("p", lambda x: x["xyz"]), F.transform("p", lambda x: x["m"])).alias("d"))
    return own.select("l_orderkey", F.round("d.RadiusOfGyration", 4).alias("radius"))


def fingerprint_columns(spark, sf_dir):
    return frames.add_fingerprints(library(spark, sf_dir).select("mol_id", "smiles"), nbits=64, expand_cols=True).drop("smiles")


def positional_rows(spark, sf_dir):
    """The last row, the first, and the last again, by place."""
    lib = library(spark, sf_dir)
    n = lib.count()
    return frames.subset(lib, [n - 1, 0, n - 1]).select("at", "mol_id").unionByName(frames.take(lib, -2).select(F.lit(3).cast("long").alias("at"), "mol_id"))


def rag_routed(spark, sf_dir):
    q = asked(spark, sf_dir, (*QUESTIONS, "logp of unknownium")).select("query")
    structures = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O", "C9H8O4", "180.16", 1.2, 63.6), ("CCO", "C2H6O", "46.07", -0.1, None)], "smiles string, formula string, mw string, xlogp double, tpsa double")
    names = spark.createDataFrame([("Unknownium", "[U]", "238.03", None)], "word string, smiles string, mw string, xlogp double")
    local = spark.createDataFrame([("CCO", "SMILES: CCO, MW=46.07, LogP=-0.00, TPSA=20.2")], "smiles string, content string")
    out = retrieval.rag(q, structures, names, local)
    return out.select("query", "answer", F.array_join("sources", ",").alias("sources"), F.col("relevant").cast("int").alias("relevant"), "score", F.col("iterations").cast("int").alias("iterations"), F.col("n_chunks").cast("int").alias("n_chunks"))


QUERIES = {f.__name__: f for f in (
    mol_scan, builtin_descriptors, atom_table, bond_table, atom_passes, node_features, edge_index, hetero_nodes, hetero_edges, ecfp_bits, ecfp_popcount, tanimoto_pairs, similarity_topk,
    screen_threshold, screen_counts, screen_best, tanimoto_embeddings, tanimoto_join, ro5_filter, rule_flags, pic50, scaffold_groups, scaffold_split, kfold_sizes, kfold, scaffold_kfold, duplicate_occurrence,
    substructure_acids, substructure_inverted, butina_neighbours, butina_clusters, maxmin_pick, mmp_pairs, regression_metrics, uncertainty_stats, skill_stats, running_totals, rag_relevance, rag_rewrite, rag_answer, fasta_parse,
    residue_composition, chembl_parse, parquet_roundtrip, record_layout, events_tumbling, label_rates, canonical_smiles, murcko_scaffolds, named_descriptors, admet_screen, other_fingerprints,
    mmpa, mmpa_double, reaction_products, rgroup_table, common_substructure, sdf_roundtrip, canonical_classes, drawn_forms, conformer_bonds, graph_regression, token_pooling, formula_descriptors, graph_descriptors, substructure_atoms, multitask_metrics, smiles_file_roundtrip,
    activity_records, record_lookup, shape_descriptors, fingerprint_columns, positional_rows, rag_routed,
)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The molecules most like benzoic acid."""
    found = similarity.pairs(query_fps(spark, [ACID]), fingerprints(spark, sf_dir), k=10)
    return similarity.top_k(found, 10).join(library(spark, sf_dir).select("mol_id", "smiles"), "mol_id").select("rank", "mol_id", "smiles", "sim").orderBy("rank")


