"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text's k-mers are K consecutive words (words longer than PIECE characters are cut into pieces). Equal k-mers are numbered in text
order, and each numbered k-mer is hashed. The hash range is divided into SLOTS equal ranges, each a hash function of its
own (one-permutation hashing); of each range the TUPLE smallest k-mers are taken, put back into text order, and hashed
as a tuple. A shuffled text has the same k-mers and other tuples. Likeness is the share of ranges, of those that either text fills, with equal tuples.

Everything happens within a row: sorting by hash numbers the k-mers, and ranges are stretches of the sorted array. Within a text
k-mers are told apart by 38 bits, places by 26.

Defined cases: null text is an empty one; texts without words have the empty fingerprint, which is like another empty
one (1.0) and unlike any other (0.0); a text of fewer words than K is one k-mer; equal texts have equal fingerprints;
of rows that repeat a doc_id the order is by text; rows without doc_id follow
the others among themselves, the last of them with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

K, PIECE, SLOT_BITS = 3, 16, 6
SLOTS = 1 << SLOT_BITS
#: A k-mer is a long: its hash above, its place in the text in the low bits, so that longs sort by hash, then place.
PLACE_BITS = 26
#: k-mers in a tuple; the tuple expressions below are written for two.
TUPLE = 2


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array column out: a hash for each filled range, in the order of ranges."""
    keep = df.columns
    a, v, f, r, t = (f"__{x}_{out}" for x in "avfrt")
    none = "cast(array() as array<bigint>)"
    hash_ = lambda x: f"shiftright({x}, {PLACE_BITS})"
    slot = lambda x: f"shiftright({x}, {64 - SLOT_BITS})"
    packed = lambda h, place: f"(({h} & {-(1 << PLACE_BITS)}L) | ({place} & {(1 << PLACE_BITS) - 1}L))"
    # each step is a projection of its own, so that an array is made once
    df = df.select(*keep, F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)), lambda w: F.xxhash64(w)).alias(a))
    kmer = ", ".join(f"get({a}, i + {j})" for j in range(K))
    df = df.select(*keep, F.expr(f"if(size({a}) = 0, {none}, sort_array(transform(sequence(0, greatest(size({a}) - {K}, 0)), i -> {packed(f'xxhash64({kmer})', 'cast(i as bigint)')})))").alias(v))
    # first occurrences, and the others
    again = f"i > 0 and {hash_('x')} = {hash_(f'{v}[i - 1]')}"
    df = df.select(*keep, F.expr(f"filter({v}, (x, i) -> not ({again}))").alias(f), F.expr(f"filter({v}, (x, i) -> {again})").alias(r))
    # the others' numbers: places within runs of equal k-mers
    df = df.withColumn(t, F.expr(f"if(size({r}) = 0, cast(array() as array<int>), filter(sequence(0, size({r}) - 1), i -> i = 0 or {hash_(f'{r}[i]')} <> {hash_(f'{r}[i - 1]')}))"))
    numbered = f"flatten(transform({t}, (start, k) -> transform(sequence(start, coalesce(get({t}, k + 1), size({r})) - 1), i -> {packed(f'xxhash64({hash_(f"{r}[i]")}, i - start + 1)', f'{r}[i]')})))"
    # of the first occurrences, sorted by hash as they are, each range's smallest are enough
    df = df.select(*keep, F.expr(f"sort_array(concat(filter({f}, (x, i) -> i < {TUPLE} or {slot('x')} <> {slot(f'{f}[i - {TUPLE}]')}), if(size({r}) = 0, {none}, {numbered})))").alias(t))
    df = df.select(*keep, F.expr(f"filter({t}, (x, i) -> i < {TUPLE} or {slot('x')} <> {slot(f'{t}[i - {TUPLE}]')})").alias(t))
    # a range's tuple, in text order
    place = lambda x: f"({x} & {(1 << PLACE_BITS) - 1}L)"
    one, two = f"{t}[i]", f"get({t}, i + 1)"
    tuple_ = f"""case when {two} is null or {slot(two)} <> {slot(one)} then xxhash64({slot(one)}, {hash_(one)})
        when {place(one)} < {place(two)} then xxhash64({slot(one)}, {hash_(one)}, {hash_(two)}) else xxhash64({slot(one)}, {hash_(two)}, {hash_(one)}) end"""
    starts = f"if(size({t}) = 0, cast(array() as array<int>), filter(sequence(0, size({t}) - 1), i -> i = 0 or {slot(one)} <> {slot(f'{t}[i - 1]')}))"
    return df.select(*keep, F.expr(f"transform({starts}, i -> struct(cast({slot(one)} as int) as slot, {tuple_} as v))").alias(out))


def likeness(a: str, b: str):
    filled = f"size(array_union({a}.slot, {b}.slot))"
    return F.expr(f"if({filled} = 0, 1.0D, cast(size(array_intersect({a}.v, {b}.v)) as double) / {filled})")


def printed(a: str):
    return F.expr(f"array_join(transform({a}.v, x -> lpad(hex(x), 16, '0')), '')")


def with_next(df: DataFrame, order: str, tie: str, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in descending order; after the last comes the first. Rows are dealt
    into ranges of the order column; each range's first row is also put at the end of the range above it, so that no
    step sees all rows. Ranges are quantiles; a few thousand of their first keys pass through the driver."""
    spark = df.sparkSession
    n = min(4096, 8 * partitions(spark))
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 1 / (4 * n))))
    splits = [float("-inf"), *cuts, float("inf")]
    own = df.withColumn("__key", F.col(order).cast("double"))
    own = Bucketizer(splits=splits, inputCol="__key", outputCol="__range", handleInvalid="keep").transform(own) if len(splits) > 2 else own.withColumn("__range", F.lit(0.0))
    ranges = Bucketizer(splits=splits, inputCol="__key", outputCol="__range", handleInvalid="keep").transform(df.select(order, F.col(order).cast("double").alias("__key"))) if len(splits) > 2 else df.select(order, F.lit(0.0).alias("__range"))
    firsts = ranges.groupBy("__range").agg(F.max(order).alias("first")).orderBy("__range").collect()
    firsts = [r for r in firsts if r["first"] is not None]
    if not firsts:
        return df.select("*", *[F.lit(None).cast(df.schema[c].dataType).alias(f"next_{c}") for c in columns])
    goes = spark.createDataFrame([(r["first"], firsts[(i + 1) % len(firsts)]["__range"]) for i, r in enumerate(firsts)], "__first long, __goes double")
    own = own.join(F.broadcast(goes), own[order] == goes["__first"], "left").drop("__first", "__key")
    place = F.array_compact(F.array(F.struct(F.col("__range").alias("range"), F.lit(False).alias("copy")), F.when(F.col("__goes").isNotNull(), F.struct(F.col("__goes").alias("range"), F.lit(True).alias("copy")))))
    own = own.withColumn("__place", F.explode(place)).withColumn("__range", F.col("__place.range")).withColumn("__copy", F.col("__place.copy"))
    w = Window.partitionBy("__range").orderBy("__copy", F.desc(order), tie)
    return own.select(*df.columns, "__copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("not __copy").drop("__copy")


def op5_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(docs, "text", "f"), "doc_id", "text", ["text", "f"])
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.coalesce(F.substr("next_text", F.lit(1), cut), F.lit("")))
    none = F.array().cast(own.schema["f"].dataType)
    own = own.select("doc_id", "n_chars", "f", F.coalesce("next_f", none).alias("next_f"), edited.alias("edited"))
    own = with_fingerprint(own, "edited", "e")
    return own.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed("f").alias("fingerprint"), printed("e").alias("edited_fingerprint"), likeness("f", "e").alias("near_edited"), likeness("f", "next_f").alias("near_next"))
