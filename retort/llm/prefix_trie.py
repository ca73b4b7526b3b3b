"""Conversation prefix trie by chained digests: shared beginnings of conversations, and what keeping them once would save.

Each turn has a digest of role and text, each prefix the digest of the prefix before it and its last turn, so equal digests are equal beginnings. Every
prefix is a row; grouped by depth and digest the rows are the trie's nodes. Chains are cut every CHUNK turns: within a chunk the
chain starts anew, and a prefix's digest is that of the chunk before it and of its place in the chunk. So a conversation of any length
is worked on in bounded pieces, and only one digest a chunk meets in one row.

Sums over subtrees: a node belongs to the smallest conversation that passes it. A conversation's own nodes are the end of its path (members
only get fewer with depth), so sums over them are running sums from the end. Their total is one row for the conversation, which is exploded to all
ancestors above its own nodes and summed there by digest: no more rows than prefixes. The root gets what all nodes sum up to.

Places of turns come from range partitions by (conversation, turn) and the row counts of (partition, conversation): no conversation is sorted in one task.
The hash over the members that end in a node must see them one after another: ids are joined to pieces where they lie sorted, and only the
pieces of one node meet, as a stream.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text is empty; turns are ordered by turn, null first, repeated
turns by the digest of role and text; repeated rows are turns of their own; an empty table has no root and gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored, table

#: Bytes of a digest (of SHA-256) that are kept, turns of a chunk, ids of a piece.
KEPT, CHUNK, PIECE = 16, 256, 4096
ROOT = bytes(KEPT)
#: The contract's rebuilding: families of conversations, and the most turns but one that are taken from a family's first.
FAMILY, HEADS = 5, 9


def cut_sha(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, KEPT)


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, digest, bytes), stored in order with __part and __at; and for each __part and conv_id: shift (place in the
    conversation less __at) and n, the turns of the conversation."""
    by = ["conv_id", "turn", "digest"]
    rows = turns.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(partitions(turns.sparkSession), *by, "__tie").sortWithinPartitions(*by).drop("__tie")
    rows = stored(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "trie-turns")
    spans = rows.groupBy("__part", "conv_id").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, spans.select("__part", "conv_id", before.alias("before"), (before - F.col("first")).alias("shift"), F.sum("n").over(every).alias("n"))


def own_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, place, digest, bytes, length), and (conv_id, length)."""
    rows, spans = placed(turns)
    out = rows.join(spans, ["__part", "conv_id"]).select("conv_id", (F.col("__at") + F.col("shift")).alias("place"), "digest", "bytes", F.col("n").alias("length"))
    return out, spans.where("before = 0").select("conv_id", F.col("n").alias("length"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its family's first turns in front, as own_turns. A family has at most 2 * FAMILY - 1 members."""
    rows, spans = placed(turns)
    spans = stored(spans, "trie-spans")
    first = "conv_id - conv_id % {0}".format(FAMILY)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    families = (
        spans.where("before = 0").groupBy(F.expr(first).alias("family"))
        .agg(F.coalesce(F.max(F.when(F.expr(f"conv_id = {first}"), F.col("n"))), F.lit(0)).alias("given"), F.collect_list(F.struct("conv_id", heads.alias("h"), "n")).alias("members"))
        .select("family", F.expr("transform(members, m -> struct(m.conv_id as conv_id, m.h as h, least(m.h, given) as kept, least(m.h, given) + greatest(m.n - m.h, 0) as length))").alias("members"))
    )
    lengths = families.select(F.explode("members").alias("m")).select("m.conv_id", "m.length")
    known = spans.withColumn("family", F.expr(first)).join(families, "family")
    place = "(__at + shift)"
    goes = f"""filter(transform(members, m -> struct(m.conv_id as conv_id, m.length as length,
        case when m.conv_id = conv_id and {place} >= m.h then {place} - m.h + m.kept when conv_id = family and {place} < m.h then {place} end as place)), x -> x.place is not null)"""
    out = rows.join(known, ["__part", "conv_id"]).select("digest", "bytes", F.explode(F.expr(goes)).alias("x"))
    return out.select("x.conv_id", "x.place", "digest", "bytes", "x.length"), lengths


def chain(start: bytes, digests: list[bytes]) -> list[bytes]:
    out = []
    for d in digests:
        start = hashlib.sha256(start + d).digest()[:KEPT]
        out.append(start)
    return out


def chained(df: DataFrame, name: str) -> DataFrame:
    """df with the array of digests `name` replaced by the chain along it."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(name)
            new = pa.array([chain(ROOT, x) for x in b.column(at).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def paths(turns: DataFrame) -> DataFrame:
    """From (conv_id, place, digest, bytes, length): for each chunk of a conversation (conv_id, chunk, length, base, digests, bytes), with the prefix digests along the chunk and the one before it."""
    rows = turns.groupBy("conv_id", F.expr(f"place div {CHUNK}").alias("chunk"), "length").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("t"))
    rows = chained(rows.select("conv_id", "chunk", "length", F.col("t.digest").alias("digests"), F.col("t.bytes").alias("bytes")), "digests")
    full = F.expr(f"(chunk + 1) * {CHUNK} < length")
    whole = lambda base, inner: cut_sha(F.concat(base, inner))
    rows = stored(rows, "trie-chunks")
    # conversations of more than one chunk: the digest before each chunk from the last ones of the chunks before
    lasts = rows.where(full).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", F.element_at("digests", -1).alias("last")))).alias("t"))
    bases = chained(lasts.select("conv_id", F.col("t.last").alias("bases")), "bases").select("conv_id", F.posexplode("bases").alias("chunk", "base"))
    bases = bases.select("conv_id", (F.col("chunk") + 1).cast("long").alias("chunk"), "base")
    out = rows.join(bases, ["conv_id", "chunk"], "left").withColumn("base", F.coalesce("base", F.lit(bytearray(ROOT))))
    return stored(out.select("conv_id", "chunk", "length", "base", F.transform("digests", lambda x: whole(F.col("base"), x)).alias("digests"), "bytes"), "trie-paths")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """From (digest, conv_id): for each digest the SHA-256 of its ids in ascending order, comma-joined."""
    n = partitions(ends.sparkSession)

    def pieces(batches):
        key, ids = None, []
        for b in batches:
            done = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == PIECE):
                    done.append((key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(c)
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "first", "piece"), x, strict=True)) for x in done], schema=pieces_schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"digest": key, "first": ids[0], "piece": ",".join(map(str, ids))}], schema=pieces_schema)

    def hashes(batches):
        key, h = None, None
        for b in batches:
            done = []
            for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        done.append({"digest": key, "ends_sha256": h.hexdigest()})
                    key, h = k, hashlib.sha256(piece.encode())
                else:
                    h.update(("," + piece).encode())
            yield pa.RecordBatch.from_pylist(done, schema=hash_schema)
        if h is not None:
            yield pa.RecordBatch.from_pylist([{"digest": key, "ends_sha256": h.hexdigest()}], schema=hash_schema)

    pieces_schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    hash_schema = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
    joined = ends.select("digest", "conv_id").repartitionByRange(n, "digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(pieces, "digest binary, first long, piece string")
    return joined.repartition(n, "digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes. turns: (conv_id, place, digest, bytes, length) with places from 0; lengths: (conv_id, length) of every conversation, also of those without turns."""
    chunks = paths(turns)
    base = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    before = "if(i = 0, base, get(digests, i - 1))"
    prefixes = chunks.select("conv_id", F.explode(F.expr(f"transform(digests, (d, i) -> struct(chunk * {CHUNK} + i + 1 as depth, d as digest, {before} as parent, bytes[i] as bytes))")).alias("p")).select("conv_id", "p.*")
    nodes = stored(prefixes.groupBy("depth", "digest", "parent", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-nodes")
    children = nodes.groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("stretch", F.expr(f"depth div {CHUNK}"))
    nodes = stored(nodes, "trie-own")
    # running sums from the end of a conversation's own nodes: within a stretch, and over later stretches
    stretches = nodes.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.min("depth").alias("start"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch"))
    past = later.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    stretches = stored(
        stretches.select("conv_id", "stretch", zero(F.sum("saved").over(past)).alias("later_saved"), zero(F.sum("leaf").over(past)).alias("later_leaf"), F.sum("saved").over(every).alias("all_saved"),
            F.sum("leaf").over(every).alias("all_leaf"), F.min("start").over(every).alias("start"), F.row_number().over(later).alias("k")),
        "trie-stretches",
    )
    owners = stretches.where("k = 1").select("conv_id", "start", "all_saved", "all_leaf")
    above = chunks.join(owners, "conv_id").where(f"chunk * {CHUNK} + 1 < start")
    above = above.select("all_saved", "all_leaf", F.explode(F.expr(f"slice(digests, 1, cast(least({CHUNK}, start - 1 - chunk * {CHUNK}) as int))")).alias("digest"))
    above = above.groupBy("digest").agg(F.sum("all_saved").alias("above_saved"), F.sum("all_leaf").alias("above_leaf"))
    on = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.select("*", F.sum("saved").over(on).alias("on_saved"), F.sum("leaf").over(on).alias("on_leaf")).join(stretches, ["conv_id", "stretch"])
    # the parent of a conversation's first own node belongs to another one
    firsts = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("other"))
    heads = owners.where("start > 1").select("conv_id", F.col("start").alias("depth")).join(nodes.select("conv_id", "depth", "parent"), ["conv_id", "depth"]).join(firsts, "parent").select("conv_id", "other")
    summed = summed.join(heads, "conv_id", "left")
    ends = chunks.where(f"(chunk + 1) * {CHUNK} >= length").select(F.element_at("digests", -1).alias("digest"), "conv_id")
    ends = ends.union(lengths.where("length = 0").select(F.lit(bytearray(ROOT)).alias("digest"), "conv_id"))
    hashes = stored(ends_hashes(ends), "trie-ends")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = summed.join(above, "digest", "left").join(hashes, "digest", "left").crossJoin(F.broadcast(base.select(F.col("conv_id").alias("root_conv"))))  # one row
    out = out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("start"), F.col("conv_id")).when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.col("other")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("on_leaf") + F.col("later_leaf") + zero(F.col("above_leaf"))).alias("n_leaves"), (F.col("on_saved") + F.col("later_saved") + zero(F.col("above_saved"))).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    total = nodes.agg(zero(F.sum((F.col("depth") == 1).cast("long"))).alias("n_children"), F.greatest(zero(F.sum("leaf")), F.lit(1)).alias("n_leaves"), zero(F.sum("saved")).alias("saved_tokens"))
    end = hashes.where(F.col("digest") == F.lit(bytearray(ROOT))).agg(F.coalesce(F.max("ends_sha256"), none).alias("ends_sha256"))
    root = base.where("n_convs > 0").crossJoin(total).crossJoin(end)  # one row each
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return out.union(root)


def read_turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = cut_sha(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt_turns(read_turns(table(spark, sf_dir, "conversations"))))


#: Nodes are whole sequences of turns here, and subtrees are found by comparing their beginnings.
OP12_SQL = f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place
  from conversations where conv_id is not null),
convs as (
  select c, c - c % {FAMILY} as b, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c::varchar)), lambda i: ascii(substr(c::varchar, i + 1, 1)))),
    lambda a, x: xor(a >> 8, list_extract(t, (xor(a, x) & 255) + 1))), 4294967295) % {HEADS} as h
  from (select distinct c from turns), crc),
rows_ as (
  select v.c, 0 as part, place, role, text from convs v join turns t on t.c = v.b and t.place < v.h
  union all select v.c, 1, place, role, text from convs v join turns t on t.c = v.c and t.place >= v.h),
seqs as (select v.c, coalesce(q.s, []) as s from convs v left join (select c, list({{'role': role, 'text': text}} order by part, place) as s from rows_ group by c) q on q.c = v.c),
prefixes as (select c, d, s[1:d] as p, len(s) = d as ends from (select c, s, unnest(range(0, len(s) + 1)) as d from seqs)),
nodes as (
  select d, p, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256,
    (count(*) - 1) * case when d = 0 then 0 else octet_length(encode(p[d].text)) end as saved
  from prefixes group by d, p),
kids as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
own as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k on k.p = n.p),
ups as (select o.*, unnest(range(0, d + 1)) as u from own o),
subs as (select p[1:u] as p, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from ups group by 1)
select o.conv_id, o.d as depth, q.conv_id as parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, o.ends_sha256
from own o join subs s on s.p = o.p left join own q on o.d > 0 and q.d = o.d - 1 and q.p = o.p[1:o.d - 1]
"""
