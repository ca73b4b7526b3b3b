"""Rule-based retrieval: query rewriting, relevance scores and answers over DataFrames of queries and text chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Molecule names with their SMILES, and property names with the words that ask for them.
SYNONYMS = {
    "aspirin": "CC(=O)Oc1ccccc1C(=O)O", "ibuprofen": "CC(C)Cc1ccc(cc1)C(C)C(=O)O", "paracetamol": "CC(=O)Nc1ccc(O)cc1", "caffeine": "Cn1cnc2c1c(=O)n(c(=O)n2C)C",
    "ethanol": "CCO", "benzene": "c1ccccc1", "acetone": "CC(=O)C",
}
PROPERTIES = {
    "logp": ["xlogp", "logp", "log p", "lipophilicity"], "mw": ["molecular weight", "mw", "mass", "dalton"], "tpsa": ["tpsa", "polar surface area"], "smiles": ["smiles", "structure"], "formula": ["formula", "molecular formula"],
}
THRESHOLD, MAX_ITERATIONS = 7.0, 5


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def rewrite(query: Column) -> Column:
    """The query with known names (as written in small letters) followed by their SMILES."""
    return reduce(lambda q, kv: F.when(F.lower(query).contains(kv[0]), F.replace(q, F.lit(kv[0]), F.lit(f"{kv[0]} (SMILES: {kv[1]})"))).otherwise(q), SYNONYMS.items(), query)


def extracted(query: Column) -> Column:
    """SMILES of the known names in the query, whatever their case."""
    return F.array_compact(F.array(*[F.when(F.lower(query).contains(k), F.lit(v)) for k, v in SYNONYMS.items()]))


def relevance(query: Column, content: Column) -> Column:
    """0 to 10: eight times the share of asked properties that the content names, and two for a number in it; 0 without content."""
    q, c = F.lower(query), F.lower(content)
    asked = [_any(q, words) for words in PROPERTIES.values()]
    n_asked = reduce(lambda a, b: a + b, [x.cast("int") for x in asked])
    met = reduce(lambda a, b: a + b, [(x & _any(c, words)).cast("int") for x, words in zip(asked, PROPERTIES.values(), strict=True)])
    share = F.when(n_asked == 0, F.lit(1.0)).otherwise(met / n_asked)
    return F.when(content.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(10.0), share * 8 + F.when(c.rlike(r"\d"), 2.0).otherwise(0.0)))


def descriptor_chunk(smiles: Column, mw: Column, logp: Column, tpsa: Column) -> Column:
    return F.concat(F.lit("SMILES: "), smiles, F.format_string(", MW=%.2f, LogP=%.2f, TPSA=%.1f", mw, logp, tpsa))


def name_words(query: Column) -> Column:
    """The first three words of more than four letters."""
    return F.slice(F.filter(F.split(query, r"\s+"), lambda w: (F.length(w) > 4) & w.rlike("^[A-Za-z]+$")), 1, 3)


def answer(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """queries (query) with chunks (query, source, content, pos): answer, sources, relevant, score and iterations.

    Retrieval does not change between iterations, so one pass scores it: a query that misses the threshold has used them all."""
    got = chunks.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "content"))).alias("chunks"))
    own = queries.join(got, "query", "left")
    content = F.when(F.size("chunks") > 0, F.array_join(F.transform("chunks", lambda c: F.lower(c["content"])), " "))
    own = own.withColumn("score", relevance(F.col("query"), content))
    text = F.concat(F.format_string("Based on %d source(s):", F.size("chunks")), F.lit("\n"), F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("  ["), F.upper(c["source"]), F.lit("] "), c["content"])), "\n"))
    return own.select(
        "query", F.when(F.size("chunks") > 0, text).otherwise(F.concat(F.lit("No information found for: "), F.col("query"))).alias("answer"),
        F.array_distinct(F.coalesce(F.transform("chunks", lambda c: c["source"]), F.array().cast("array<string>"))).alias("sources"),
        (F.col("score") >= THRESHOLD).alias("relevant"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(MAX_ITERATIONS).alias("iterations"),
    )


def structure_chunk(smiles: Column, formula: Column, mw: Column, xlogp: Column, tpsa: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("PubChem properties for SMILES="), smiles, F.lit(": Formula="), text(formula), F.lit(", MW="), text(mw), F.lit(", XLogP="), text(xlogp), F.lit(", TPSA="), text(tpsa))


def name_chunk(word: Column, smiles: Column, mw: Column, xlogp: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("PubChem: '"), word, F.lit("' \u2192 SMILES="), text(smiles), F.lit(", MW="), text(mw), F.lit(", XLogP="), text(xlogp))


def retrieve(queries: DataFrame, current: Column, iteration: int, structures: DataFrame, names: DataFrame, local: DataFrame) -> DataFrame:
    """(query, iteration, current, chunks): what one iteration finds for queries (query). Named molecules are looked up in local (smiles, content) and
    structures (smiles, formula, mw, xlogp, tpsa); without any, the current text's longer words in names (word, smiles, mw, xlogp), twice when it
    is not the first iteration."""
    own = queries.select("query", current.alias("current"), extracted(rewrite(F.col("query"))).alias("found"))
    known = own.select("query", F.posexplode("found").alias("pos", "smiles"))
    by_local = known.join(local, "smiles").select("query", F.lit(0).alias("part"), "pos", F.lit("local").alias("source"), "content")
    by_structure = known.join(structures, "smiles").select("query", F.lit(1).alias("part"), "pos", F.lit("pubchem").alias("source"), structure_chunk(*[F.col(c) for c in ("smiles", "formula", "mw", "xlogp", "tpsa")]).alias("content"))
    words = own.where(F.size("found") == 0).select("query", F.posexplode(name_words(F.col("current"))).alias("pos", "word"))
    by_name = words.join(names.select(F.lower("word").alias("key"), "smiles", "mw", "xlogp"), F.lower("word") == F.col("key"))
    by_name = by_name.select("query", F.lit(2).alias("part"), "pos", F.lit("pubchem_name").alias("source"), name_chunk(F.col("word"), F.col("smiles"), F.col("mw"), F.col("xlogp")).alias("content"))
    all_ = by_local.unionByName(by_structure).unionByName(by_name)
    if iteration > 1:
        all_ = all_.unionByName(by_name.withColumn("part", F.lit(3)))
    got = all_.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "pos", "source", "content"))), lambda c: F.struct(c["source"].alias("source"), c["content"].alias("content"))).alias("chunks"))
    empty = F.array().cast("array<struct<source: string, content: string>>")
    return own.join(got, "query", "left").select("query", F.lit(iteration).alias("iteration"), "current", F.coalesce("chunks", empty).alias("chunks"))


def rag(queries: DataFrame, structures: DataFrame, names: DataFrame, local: DataFrame) -> DataFrame:
    """(query, answer, sources, relevant, score, iterations, n_chunks): retrieval with routing. The first iteration asks with the rewritten query, all
    others with a broader text; they find the same, so two are run and the last one counts for all that follow. The first iteration that
    reaches the threshold answers with what it found; if none does, all that was found answers."""
    first = retrieve(queries, rewrite(F.col("query")), 1, structures, names, local)
    again = retrieve(queries, F.concat("query", F.lit(" properties structure synonyms")), 2, structures, names, local)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.lower(x["content"])), " "))
    own = first.withColumn("score_1", relevance(F.col("current"), text(F.col("chunks")))).select("query", F.col("chunks").alias("c1"), "score_1")
    own = own.join(again.withColumn("score_2", relevance(F.col("current"), text(F.col("chunks")))).select("query", F.col("chunks").alias("c2"), "score_2"), "query")
    one, two = F.col("score_1") >= THRESHOLD, F.col("score_2") >= THRESHOLD
    every = F.flatten(F.concat(F.array("c1"), F.array_repeat("c2", MAX_ITERATIONS - 1)))
    own = own.withColumn("used", F.when(one, F.col("c1")).when(two, F.col("c2")).otherwise(every)).withColumn("all", F.when(one, F.col("c1")).when(two, F.concat("c1", "c2")).otherwise(every))
    answer_ = F.concat(F.format_string("Based on %d source(s):", F.size("used")), F.lit("\n"), F.array_join(F.transform("used", lambda c: F.concat(F.lit("  ["), F.upper(c["source"]), F.lit("] "), c["content"])), "\n"))
    return own.select(
        "query", F.when(F.size("used") > 0, answer_).otherwise(F.concat(F.lit("Could not find sufficient information for: "), F.col("query"))).alias("answer"),
        F.array_distinct(F.transform("all", lambda c: c["source"])).alias("sources"), (one | two).alias("relevant"), F.when(one, F.col("score_1")).otherwise(F.col("score_2")).alias("score"),
        F.when(one, 1).when(two, 2).otherwise(MAX_ITERATIONS).alias("iterations"), F.size("all").alias("n_chunks"),
    )
