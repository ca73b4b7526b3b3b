"""Shards of near equal bytes: minimax contiguous partition of ordered atomic groups, in DataFrame functions only.

A group is all rows of one text; it is never cut. Groups stand in the order of their digests, so a row's shard follows from its own digest and
no row has to meet its group. A group larger than an even share of what is left, for the shards that are left, is a shard of its own:
no capacity below its size is feasible. Over the others the smallest feasible capacity is found by binary search, each
capacity checked greedily (a shard takes groups as long as they fit). The cuts lie as near to even places as this capacity allows.

The check asks for the largest prefix sum up to a number, a few times a capacity. Prefix sums are a stored table in their order. The driver
knows the sums at the ends of 4,096 parts of the digest range, and of stretches it doesn't know whether they hold a sum
that matters. A stretch counts as having no sum (then a capacity that fits is feasible) and as having every sum (then a capacity that fails isn't);
where the two differ, the table is asked for the sums of these stretches, by 1,024 bins each: at most 64 stretches a query,
three or four queries for any number of groups.

Slots follow the rows' order in range partitions, from each partition's number of rows of each shard: neither a shard nor a group meets in one task.

Defined cases: null text is an empty one, of size 1; repeated rows are rows of one group, each with a slot of its own; equal sums or ideal places
between two sums take the lower one; fewer groups than shards leave the last shards without rows; rows without doc_id come first; an empty table gives an
empty result; other columns are not read by the query and pass through the operator.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored, table

SHARDS = 16
PART_BITS = 12
BINS, MOST_STRETCHES = 1 << 10, 64


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class PrefixSums:
    """What the driver knows of an increasing row of sums: some of them, and between which neighbours there are others."""

    def __init__(self, sums: list[int], more: list[bool], ask):
        self.sums, self.more, self.ask = sums, more, ask  # more[i]: there are sums between sums[i] and sums[i + 1]
        self.touched: set[int] = set()

    def below(self, x: int) -> int:
        """The largest known sum up to x; a stretch that may hold a larger one is noted."""
        i = bisect_right(self.sums, x) - 1
        if self.sums[i] < x and i < len(self.more) and self.more[i]:
            self.touched.add(i)
        return self.sums[i]

    def above(self, x: int) -> int:
        i = bisect_left(self.sums, x)
        if self.sums[i] > x and i and self.more[i - 1]:
            self.touched.add(i - 1)
        return self.sums[i]

    def most_below(self, x: int) -> int:
        """No sum up to x is larger than this."""
        i = bisect_right(self.sums, x) - 1
        if self.sums[i] < x and i < len(self.more) and self.more[i]:
            self.touched.add(i)
            return x
        return self.sums[i]

    def learn(self) -> None:
        """Asks the table for the noted stretches."""
        stretches = sorted(self.touched)[:MOST_STRETCHES]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for at, low, high, n in self.ask([(self.sums[i], self.sums[i + 1]) for i in stretches]):
            found.setdefault(stretches[at], []).append((low, high, n))
        sums, more = [], []
        for i, s in enumerate(self.sums):
            sums.append(s)
            if i < len(self.more):
                more.append(self.more[i] and i not in stretches)
            for low, high, n in sorted(found.get(i, ())):
                sums.append(low)
                more.append(n > 2)
                if n > 1:
                    sums.append(high)
                    more.append(False)
        self.sums, self.more, self.touched = sums, more, set()

    def settled(self, ask):
        """ask(), again and again until nothing that it touches is unknown."""
        while True:
            self.touched = set()
            out = ask()
            if not self.touched:
                return out
            self.learn()


def feasible(p: PrefixSums, capacity: int, shards: int) -> bool | None:
    """Whether greedy filling needs no more shards; None where what is known doesn't tell."""
    least = most = 0
    for _ in range(shards):
        least, most = p.below(least + capacity), p.most_below(most + capacity)
    return True if least >= p.sums[-1] else False if most < p.sums[-1] else None


def smallest_capacity(p: PrefixSums, largest: int, shards: int) -> int:
    low = max(largest, -(-p.sums[-1] // shards)) - 1
    high = low + 1 + largest
    while high - low > 1:
        mid = (low + high) // 2
        p.touched = set()
        while (fits := feasible(p, mid, shards)) is None:
            for other in (low + 1, high):  # the search goes on there
                feasible(p, other, shards)
            p.learn()
        low, high = (low, mid) if fits else (mid, high)
    return high


def even_cuts(p: PrefixSums, capacity: int, shards: int) -> list[int]:
    """shards - 1 sums, as near to even places as the capacity allows."""

    def cut() -> list[int]:
        total = p.sums[-1]
        earliest = [total]
        for _ in range(shards - 1):
            earliest.append(p.above(max(0, earliest[-1] - capacity)))
        cuts = [0]
        for i in range(1, shards):
            ideal = i * total // shards
            a, b = p.below(ideal), p.above(ideal)
            near = a if ideal - a <= b - ideal else b
            cuts.append(max(cuts[-1], earliest[shards - i], min(near, p.below(cuts[-1] + capacity))))
        return cuts[1:]

    return p.settled(cut)


def oversized(sizes: list[int], total: int, shards: int) -> int:
    """How many of the sizes, in descending order, exceed an even share of what is left."""
    n = 0
    for s in sizes:
        if n == shards - 1 or s * (shards - n) <= total:
            break
        n, total = n + 1, total - s
    return n


def cut_keys(rows: DataFrame, shards: int, key: str, size: str) -> tuple[list[bytes], list[bytes | None]]:
    """The keys of the groups that are shards of their own, and for each further shard but the last the largest key that it
    holds at most (None: it is empty)."""
    groups = stored(rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("bytes")), "shard-groups")
    part = F.conv(F.substring(F.hex("key"), 1, PART_BITS // 4), 16, 10).cast("int")
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return [], [None] * (shards - 1)
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    own = [bytes(r["key"]) for r in largest[: oversized([r["bytes"] for r in largest], total, shards)]]
    left = shards - len(own)
    rest = groups.withColumn("part", part)
    if own:
        rest = rest.where(~F.col("key").isin(*[F.lit(bytearray(k)) for k in own]))
    parts = rest.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("part").collect()
    if not parts or left == 1:
        return own, [None] * (left - 1)
    sums, before = [0], []
    for r in parts:
        before.append((r["part"], sums[-1]))
        sums.append(sums[-1] + r["bytes"])
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))  # 4,096 rows at most
    within = F.sum("bytes").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    sums_table = stored(rest.join(offsets, "part").select("key", (within + F.col("before")).alias("sum")), "shard-sums")

    def ask(stretches: list[tuple[int, int]]):
        at, bin_, inside = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for i, (a, b) in reversed(list(enumerate(stretches))):
            here = (F.col("sum") > a) & (F.col("sum") < b)
            at, bin_, inside = F.when(here, i).otherwise(at), F.when(here, F.expr(f"(sum - {a}) div {max(1, -(-(b - a) // BINS))}L")).otherwise(bin_), here | inside
        found = sums_table.where(inside).groupBy(at.alias("at"), bin_.alias("bin")).agg(F.min("sum"), F.max("sum"), F.count("*"))
        return [(r[0], r[2], r[3], r[4]) for r in found.collect()]

    p = PrefixSums(sums, [r["n"] > 1 for r in parts], ask)
    biggest = next((r["bytes"] for r in largest[len(own) :]), 0)
    cuts = even_cuts(p, smallest_capacity(p, biggest, left), left)
    key_of = {r["sum"]: bytes(r["key"]) for r in sums_table.where(F.col("sum").isin(sorted(set(cuts)))).collect()}
    return own, [key_of.get(c) for c in cuts]


def shard(rows: DataFrame, shards: int = SHARDS, key: str = "key", size: str = "size", order: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard and slot. key: the group's digest (binary, evenly spread); size: a long of at least 1; order: of slots within a shard, then by key."""
    own, cuts = cut_keys(rows, shards, key, size)
    number = F.lit(len(own))
    for c in cuts:
        number = number + (F.lit(1) if c is None else (F.col(key) > F.lit(bytearray(c))).cast("int"))
    for i, k in enumerate(own):
        number = F.when(F.col(key) == F.lit(bytearray(k)), i).otherwise(number)
    spark = rows.sparkSession
    by = ["shard", *order, key]
    dealt = rows.withColumn("shard", number.cast("int")).withColumn("__tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), *by, "__tie").sortWithinPartitions(*by).drop("__tie")
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "shard-rows")
    # one row for each partition and shard that meet: partitions + shards rows at most
    spans = dealt.groupBy("__part", "shard").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("__part", "shard", (earlier - F.col("__first")).alias("__shift"))
    return dealt.join(F.broadcast(spans), ["__part", "shard"]).withColumn("slot", F.col("__at") + F.col("__shift")).select(*rows.columns, "shard", "slot")


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest(F.col("text").cast("string")).alias("key"))
    rows = shard(stored(docs, "shard-digests"), order=("doc_id",))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The smallest capacity by dynamic programming over all cuts, instead of a search; the same choice of cuts.
OP13_SQL = f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
docs as (select doc_id, coalesce(text, '') as text from documents),
d as (
  select doc_id, octet_length(encode(text)) + 1 as size, sha256(text) as key, hex(encode(text)) as h from docs),
crcs as (
  select key, any_value(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, list_extract(t, (xor(a, b) & 255) + 1))), 4294967295)) as text_crc32
  from (select key, any_value(h) as h from d group by key), crc group by key),
g as (select key, sum(size)::bigint as bytes from d group by key),
r as (select key, bytes, row_number() over w as k, sum(bytes) over () - coalesce(sum(bytes) over (order by bytes desc, key rows between unbounded preceding and 1 preceding), 0) as remaining
  from g window w as (order by bytes desc, key)),
o as (select key, k, min(case when k < {SHARDS} and bytes * ({SHARDS} + 1 - k) > remaining then 1 else 0 end) over (order by k) as own from r),
m as (select {SHARDS} - count(*) filter (where own = 1) as m from o),
s as (select key, sum(bytes) over (order by key)::bigint as s from g where key not in (select key from o where own = 1)),
pts as (select 0::bigint as s union all select s from s),
tot as (select max(s) as t from pts),
f as (
  select 1 as k, s as j, s as v from pts
  union all
  select f.k + 1, p.s, min(greatest(f.v, p.s - f.j)) from f join pts p on p.s >= f.j where f.k < (select m from m) group by f.k + 1, p.s),
cap as (select min(v) as c from f, m, tot where k = m and j = t),
e as (
  select m as i, t as v from m, tot
  union all
  select e.i - 1, min(p.s) from e, cap, pts p where e.i > 1 and p.s >= e.v - c group by e.i - 1),
near as (
  select i, (select max(s) from pts where s <= i * t // m) as a, (select min(s) from pts where s >= i * t // m) as b, i * t // m as ideal from (select unnest(range(1, m)) as i, m, t from m, tot)),
cut as (
  select 0::bigint as i, 0::bigint as v
  union all
  select cut.i + 1, greatest(cut.v, any_value(e.v), least(any_value(case when ideal - a <= b - ideal then a else b end), max(p.s)))
  from cut join near on near.i = cut.i + 1 join e on e.i = cut.i + 1 join pts p on p.s <= cut.v + (select c from cap) group by cut.i, cut.v),
place as (
  select key, ({SHARDS} - (select m from m)) + (select count(*) from cut where i > 0 and v < s.s) as shard from s
  union all select key, k - 1 from o where own = 1)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard::int as shard,
  row_number() over (partition by shard order by doc_id nulls first, key) - 1 as slot, null::int as grown_shard
from d join place using (key) join crcs using (key)
"""
