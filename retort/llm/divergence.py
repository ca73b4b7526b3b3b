"""Source divergence audit: how far apart the sources of a language are in their words, and which words stand out in each.

Counts are made by DuckDB in the tasks and merged by Spark. Each batch of texts is split into terms and counted in SQL; Spark sums the counts. The
sums are dealt into shards by a hash of (lang, term), so that a shard has all counts of its terms, and a shard is one in-memory table of bounded size:
their number follows the number of counts. A first pass over the shards keeps the terms that enough documents of the language
hold; a second one, knowing the totals of the groups, makes partial sums over pairs of sources and each group's best terms of the shard. Spark adds up the
sums and ranks.

A pair's sum over all kept terms is taken apart by whether a source has the term: with z the share of a term that a source doesn't have,
f(p, q) = [f(p, q) - f(p, z') - f(z, q) + f(z, z')] + [f(p, z') - f(z, z')] + [f(z, q) - f(z, z')] + f(z, z'). Only the first part needs both sources' counts of a
term (within a shard, where both have it); the next two depend on one source's count alone and are summed over how often each count occurs; the last one is the same for all terms.
All numbers are integers: shares in 128 bits, the rest in longs.

Defined cases: null text, lang or source is ''; groups without terms, and languages without kept terms, give pairs (value 0 without kept terms) and no terms;
repeated rows are documents of their own; ties in value are ranked by the item's bytes; texts of over STEP bytes are counted piece by piece; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, small_batches, stored, table

#: Documents of a language that a kept term is in at least, ranks of terms, share units, smoothing.
LEAST_DOCS, BEST, UNITS, MORE = 10, 10, 1_000_000_000, 2
#: What separates terms: all of ASCII but letters.
APART = r"\x00-\x40\x5B-\x60\x7B-\x7F"
#: Characters of a text that are counted at once; counts (rows) of a shard.
STEP, SHARD_ROWS = 1 << 20, 1 << 18
_CONFIG = {"threads": 1, "memory_limit": "400MB", "temp_directory": ""}

_COUNTS = "lang string, source string, term string, n long, docs long"
_KEPT = "lang string, source string, term string, n long, first long"
_FOUND = "part string, lang string, source string, item string, value long"
_TERMS = f"select k, unnest(regexp_extract_all(text, '[^{APART}]+')) as term from b"
_COUNT_SQL = f"""with t as ({_TERMS}), d as (select k, term, count(*) as n from t group by all)
select lang, source, term, sum(n)::bigint as n, count(*)::bigint as docs from d join g using (k) group by all"""
_KEEP_SQL = f"""select lang, source, term, n, (row_number() over (partition by lang, term order by source) = 1)::bigint as first from
(select *, sum(docs) over (partition by lang, term) as all_docs from b) where all_docs >= {LEAST_DOCS}"""
_FIND_SQL = f"""
with p as (select lang, source, term, n, (1 + ({UNITS}::hugeint * (n + {MORE})) // (total + {MORE} * kept))::bigint as p, (1 + ({UNITS}::hugeint * {MORE}) // (total + {MORE} * kept))::bigint as z, lang_total, kept from b),
l as (select lang, term, (1 + ({UNITS}::hugeint * (sum(n) + {MORE})) // (any_value(lang_total) + {MORE} * any_value(kept)))::bigint as q from b group by lang, term)
select 'pair' as part, a.lang, a.source, b.source as item, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z))::bigint as value
from p a join p b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all
union all
select * from (select 'term', p.lang, source, p.term as item, f(p, q) as value from p join l on l.lang = p.lang and l.term = p.term where p > q
  qualify row_number() over (partition by p.lang, source order by f(p, q) desc, p.term) <= {BEST})
"""


def _connect():
    import duckdb

    con = duckdb.connect(":memory:", config=_CONFIG)
    con.execute("create macro f(p, q) as ((p - q) * (p - q)) // (p + q)")
    return con


def _arrow(rel, schema: pa.Schema):
    return rel.to_arrow_table().cast(schema).to_batches()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


_BREAK = re.compile(f"[{APART}]")


def pieces(text: str, step: int = STEP):
    """Stretches of a text, cut where no term is."""
    at = 0
    while len(text) - at > step:
        m = _BREAK.search(text, at + step)
        to = m.end() if m else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def _count_batches(batches):
    con, schema = _connect(), _schema(_COUNTS)
    for b in batches:
        text = pc.ascii_lower(b.column(2))
        long = pc.greater(pc.utf8_length(text), STEP)
        k = pa.array(range(b.num_rows))
        con.register("g", pa.table({"k": k, "lang": b.column(0), "source": b.column(1)}))
        con.register("b", pa.table({"k": k, "text": text}).filter(pc.invert(long)))
        yield from _arrow(con.sql(_COUNT_SQL), schema)
        for i in pc.indices_nonzero(long).to_pylist():
            con.execute("create or replace temp table whole (term varchar, n bigint)")
            for piece in pieces(text[i].as_py()):
                con.register("b", pa.table({"k": [i], "text": [piece]}))
                con.execute(f"insert into whole select term, count(*) from ({_TERMS}) group by term")
            yield from _arrow(con.sql(f"select lang, source, term, sum(n)::bigint as n, 1::bigint as docs from whole, g where k = {i} group by all"), schema)
    con.close()


def _by_shard(sql: str, ddl: str):
    """A function for mapInArrow: the SQL over all rows of a partition, which is a shard."""

    def run(batches):
        rows = list(batches)
        if not rows:
            return
        con = _connect()
        con.register("b", pa.Table.from_batches(rows))
        yield from _arrow(con.sql(sql), _schema(ddl))
        con.close()

    return run


def _share(n: str) -> str:
    return f"(1 + (cast({UNITS} as decimal(10,0)) * cast({n} + {MORE} as decimal(20,0))) div cast(total + {MORE} * kept as decimal(20,0)))"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def divergence(docs: DataFrame) -> DataFrame:
    """From (lang, source, text): (lang, source, part, item, value, rank)."""
    spark = docs.sparkSession
    small_batches(spark)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    counts = docs.mapInArrow(_count_batches, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts, "audit-counts")
    shards = max(partitions(spark), -(-counts.count() // SHARD_ROWS))
    kept = stored(counts.repartition(shards, "lang", "term").mapInArrow(_by_shard(_KEEP_SQL, _KEPT), _KEPT), "audit-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("kept"))
    groups = stored(groups.join(langs, "lang").select("lang", "source", "total", "kept", "lang_total"), "audit-groups")
    own = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "total", "kept", "lang_total")
    found = stored(own.repartition(shards, "lang", "term").mapInArrow(_by_shard(_FIND_SQL, _FOUND), _FOUND), "audit-found")
    # what depends on one source's counts alone, and on none
    shares = groups.where("kept > 0").select("lang", "source", F.expr(_share("0")).alias("z"), "kept")
    others = shares.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    single = own.groupBy("lang", "source", "n", "total", "kept").agg(F.count("*").alias("times")).select("lang", "source", "times", F.expr(_share("n")).alias("p"), F.expr(_share("0")).alias("z"))
    single = single.join(others, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr(f"times * ({_f('p', 'y')} - {_f('z', 'y')})")).alias("value"))
    sums = found.where("part = 'pair'").select("lang", "source", "item", "value").union(single)
    sums = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    none = shares.join(others, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"kept * {_f('z', 'y')}").alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = sums.union(none).union(bare).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value", "part")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", "item", "value", "part").union(terms).withColumn("rank", rank)
    return ranked.where(f"part = 'pair' or rank <= {BEST}").select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: Every share of every kept term, whether the source has it or not.
OP11_SQL = f"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select k, lang, source, unnest(regexp_extract_all(text, '[^{APART}]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct k) >= {LEAST_DOCS}),
v as (select lang, (select count(*) from kept where kept.lang = x.lang) as v from (select distinct lang from d) x),
g as (select distinct lang, source from d),
c as (select w.lang, w.source, w.term, count(*) as n from w join kept on kept.lang = w.lang and kept.term = w.term group by all),
full_ as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from g join kept on kept.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select lang, source, term, n, (1 + ({UNITS}::hugeint * (n + {MORE})) // (sum(n) over (partition by lang, source) + {MORE} * v.v))::bigint as p from full_ join v using (lang)),
l as (select lang, term, (1 + ({UNITS}::hugeint * (n + {MORE})) // (sum(n) over (partition by lang) + {MORE} * v.v))::bigint as q from (select lang, term, sum(n) as n from c group by all) join v using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select p.lang, p.source, p.term as item, (p - q) * (p - q) // (p + q) as value from p join l on l.lang = p.lang and l.term = p.term where n > 0 and p > q),
r as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= {BEST})
select lang, source, part, item, value, rank::int as rank from r
"""
