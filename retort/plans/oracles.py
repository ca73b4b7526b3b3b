"""DuckDB SQL for the molecule queries. Molecules are read by a recursive query of its own, token by token."""

from __future__ import annotations

import random

from ..fixtures import FORMS, POOL, pool_sql
from ..functions.elements import LOGP_CENTI, MASS_MILLI, MASS_MILLI_GRAPH, NUMBERS, VALENCE
from ..operators.graph import LABELS
from ..operators.retrieval import PROPERTIES, SYNONYMS
from .molecules import LETTERS, QUERY_IDS, QUESTIONS, SCAFFOLDS


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


_LIBRARY = f"""pool(pool_id, smiles) AS {pool_sql()},
library AS (SELECT p_partkey AS mol_id, pool_id, smiles, p_retailprice AS label FROM part JOIN pool ON p_partkey % 40 = pool_id)"""

_WALK = rf"""
elements(sym, ez) AS {_values(NUMBERS.items())},
parts AS (SELECT pool_id, unnest(t) AS x, generate_subscripts(t, 1) AS i, len(t) AS n_tokens FROM (SELECT pool_id, regexp_extract_all(smiles, '\[[^\]]*\]|Br|Cl|%[0-9][0-9]|.') AS t FROM pool)),
named AS (SELECT *, CASE WHEN x LIKE '[%' THEN 'atom' WHEN regexp_full_match(x, 'Br|Cl|[BCNOFPSIbcnops]') THEN 'atom' WHEN x IN ('-', '=', '#', ':') THEN 'bond' WHEN x = '(' THEN 'open' WHEN x = ')' THEN 'close'
    WHEN regexp_full_match(x, '[0-9]|%[0-9][0-9]') THEN 'ring' WHEN x IN ('/', '\', '.', ' ') THEN 'skip' ELSE 'bad' END AS kind,
    CASE WHEN x LIKE '[%' THEN regexp_extract(x, '^\[[0-9]*([A-Za-z]*)', 1) ELSE x END AS sym,
    CASE WHEN x LIKE '%@@%' THEN 2 WHEN x LIKE '%@%' THEN 1 ELSE 0 END AS chir, CASE x WHEN '=' THEN 2 WHEN '#' THEN 3 WHEN ':' THEN 4 ELSE 1 END AS o FROM parts),
tokens AS (SELECT pool_id, i, n_tokens, x, kind, coalesce(ez, 0) AS z, regexp_matches(n.sym, '^[a-z]') AS arom, chir, o FROM named n LEFT JOIN elements e ON lower(n.sym) = e.sym),
walk AS (
  SELECT pool_id, 0 AS i, -1 AS last, 0 AS n, []::INTEGER[] AS stack, []::STRUCT(k VARCHAR, a INTEGER)[] AS rings, 0 AS nb, []::STRUCT(z INTEGER, arom BOOLEAN, chir INTEGER)[] AS al, []::STRUCT(s INTEGER, d INTEGER, o INTEGER)[] AS bl, true AS ok FROM pool
  UNION ALL
  SELECT w.pool_id, t.i, CASE kind WHEN 'atom' THEN n WHEN 'close' THEN stack[len(stack)] ELSE last END, CASE kind WHEN 'atom' THEN n + 1 ELSE n END,
    CASE kind WHEN 'open' THEN list_append(stack, last) WHEN 'close' THEN stack[1:len(stack) - 1] ELSE stack END,
    CASE WHEN kind <> 'ring' THEN rings WHEN len(list_filter(rings, lambda r: r.k = t.x)) > 0 THEN list_filter(rings, lambda r: r.k <> t.x) ELSE list_append(rings, {{'k': t.x, 'a': last}}) END,
    CASE WHEN kind = 'bond' THEN t.o WHEN kind = 'ring' OR kind = 'atom' AND last >= 0 THEN 0 ELSE nb END,
    CASE kind WHEN 'atom' THEN list_append(al, {{'z': t.z, 'arom': t.arom, 'chir': t.chir}}) ELSE al END,
    CASE WHEN kind = 'atom' AND last >= 0 THEN list_append(bl, {{'s': last, 'd': n, 'o': CASE WHEN nb > 0 THEN nb WHEN t.arom THEN 4 ELSE 1 END}})
         WHEN kind = 'ring' AND len(list_filter(rings, lambda r: r.k = t.x)) > 0 THEN list_append(bl, {{'s': list_filter(rings, lambda r: r.k = t.x)[1].a, 'd': last, 'o': CASE WHEN nb > 0 THEN nb ELSE 1 END}}) ELSE bl END,
    ok AND kind <> 'bad' AND NOT (kind = 'close' AND len(stack) = 0)
  FROM walk w JOIN tokens t ON t.pool_id = w.pool_id AND t.i = w.i + 1 WHERE w.ok
),
mols AS (SELECT w.pool_id, al, bl FROM walk w JOIN (SELECT DISTINCT pool_id, n_tokens FROM parts) p ON w.pool_id = p.pool_id AND w.i = p.n_tokens WHERE ok AND len(al) > 0 AND len(rings) = 0),
atoms AS (SELECT pool_id, generate_subscripts(al, 1)::INTEGER - 1 AS idx, unnest(al).z AS z, unnest(al).arom AS arom, unnest(al).chir AS chir FROM mols),
bonds AS (SELECT pool_id, generate_subscripts(bl, 1)::INTEGER - 1 AS b, unnest(bl).s AS s, unnest(bl).d AS d, unnest(bl).o AS o FROM mols),
ends AS (SELECT pool_id, b, s AS a, d AS other, o FROM bonds UNION ALL SELECT pool_id, b, d, s, o FROM bonds),
valence(z, v) AS {_values(VALENCE.items())}"""

_GRAPH = f"""{_WALK},
reach AS (
  SELECT pool_id, b, s AS node FROM bonds
  UNION
  SELECT r.pool_id, r.b, e.other FROM reach r JOIN ends e ON e.pool_id = r.pool_id AND e.a = r.node AND e.b <> r.b
),
ring_bonds AS (SELECT x.pool_id, x.b, x.s, x.d FROM bonds x JOIN reach r ON r.pool_id = x.pool_id AND r.b = x.b AND r.node = x.d),
ring_atoms AS (SELECT DISTINCT pool_id, s AS idx FROM ring_bonds UNION SELECT DISTINCT pool_id, d FROM ring_bonds),
full_atoms AS (
  SELECT a.*, coalesce(e.deg, 0) AS degree, (r.idx IS NOT NULL)::INTEGER AS in_ring,
    CASE WHEN e.triple THEN 1 WHEN e.double_ OR a.arom THEN 2 ELSE 3 END AS hyb,
    floor(greatest(0, coalesce(v.v, 0) - coalesce(e.total, 0) - CASE WHEN a.arom THEN 0.5 ELSE 0 END) + 0.5)::INTEGER AS hs
  FROM atoms a LEFT JOIN (SELECT pool_id, a AS idx, count(*) AS deg, bool_or(o = 3) AS triple, bool_or(o = 2) AS double_, sum(CASE o WHEN 4 THEN 1.5 ELSE o END) AS total FROM ends GROUP BY 1, 2) e ON e.pool_id = a.pool_id AND e.idx = a.idx
  LEFT JOIN ring_atoms r ON r.pool_id = a.pool_id AND r.idx = a.idx LEFT JOIN valence v ON v.z = a.z
)"""

_FOLD = "xor((((a::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT), b)"


def _combine(a: str, b: str) -> str:
    return f"xor(((({a})::HUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT, {b})"


_IDS = f"""
id0 AS (SELECT pool_id, idx, {_combine(_combine('xor(12638153115695167455::UBIGINT, z::UBIGINT)', '0::UBIGINT'), 'hs::UBIGINT')} AS id FROM full_atoms),
id1 AS (SELECT i.pool_id, i.idx, list_reduce(list_prepend(any_value(i.id), coalesce(list(o.id ORDER BY o.id) FILTER (WHERE o.id IS NOT NULL), [])), lambda a, b: {_FOLD}) AS id
  FROM id0 i LEFT JOIN ends e ON e.pool_id = i.pool_id AND e.a = i.idx LEFT JOIN id0 o ON o.pool_id = e.pool_id AND o.idx = e.other GROUP BY 1, 2),
id2 AS (SELECT i.pool_id, i.idx, list_reduce(list_prepend(any_value(i.id), coalesce(list(o.id ORDER BY o.id) FILTER (WHERE o.id IS NOT NULL), [])), lambda a, b: {_FOLD}) AS id
  FROM id1 i LEFT JOIN ends e ON e.pool_id = i.pool_id AND e.a = i.idx LEFT JOIN id1 o ON o.pool_id = e.pool_id AND o.idx = e.other GROUP BY 1, 2),
bits AS (SELECT DISTINCT pool_id, (id % 2048)::BIGINT AS bit FROM (SELECT * FROM id0 UNION ALL SELECT * FROM id1 UNION ALL SELECT * FROM id2))"""

_PAIRS = f"""
counts AS (SELECT p.pool_id, count(b.bit) AS n FROM pool p LEFT JOIN bits b ON b.pool_id = p.pool_id GROUP BY 1),
pool_pairs AS (SELECT q.pool_id AS query_id, l.pool_id, q.n AS qn, l.n AS ln, (SELECT count(*) FROM bits a JOIN bits b ON a.bit = b.bit WHERE a.pool_id = q.pool_id AND b.pool_id = l.pool_id) AS inter FROM counts q, counts l),
sims AS (SELECT query_id, pool_id, inter, qn + ln - inter AS union_n, CASE WHEN qn + ln - inter > 0 THEN inter / (qn + ln - inter) ELSE 0.0 END::DOUBLE AS sim FROM pool_pairs),
pairs AS (SELECT query_id::BIGINT AS query_id, mol_id, inter, union_n, sim FROM sims JOIN library USING (pool_id) WHERE query_id IN ({', '.join(map(str, QUERY_IDS))}))"""


# The library of distinct molecules: each its own pool entry, and hydrogens only.
_DISTINCT = rf"""base(pool_id, smiles) AS {pool_sql()},
pool AS (SELECT p_partkey AS pool_id, smiles || translate(list_reduce(list_prepend('', list_transform(range(1 + floor(ln(greatest(p_partkey, 1) + 0.5) / ln(3))::BIGINT), lambda i: ((p_partkey // (3 ** i)::BIGINT) % 3)::VARCHAR)), lambda a, b: b || a), '012', 'CNO') AS smiles FROM part JOIN base ON p_partkey % 40 = base.pool_id)"""
_HYDROGENS = """full_atoms AS (SELECT a.pool_id, a.idx, a.z, floor(greatest(0, coalesce(v.v, 0) - coalesce(e.total, 0) - CASE WHEN a.arom THEN 0.5 ELSE 0 END) + 0.5)::INTEGER AS hs
  FROM atoms a LEFT JOIN (SELECT pool_id, a AS idx, sum(CASE o WHEN 4 THEN 1.5 ELSE o END) AS total FROM ends GROUP BY 1, 2) e ON e.pool_id = a.pool_id AND e.idx = a.idx LEFT JOIN valence v ON v.z = a.z)"""

_CLASSES = """keys AS (SELECT pool_id, list(bit ORDER BY bit) AS fp FROM bits JOIN (SELECT pool_id FROM mols) m USING (pool_id) GROUP BY 1),
classes AS (SELECT fp, max(mol_id) AS rep, count(*) AS size, any_value(pool_id) AS pool_id FROM library JOIN keys USING (pool_id) GROUP BY 1),
near AS (SELECT x.rep AS a, y.rep AS b FROM classes x, classes y JOIN sims s ON s.query_id = x.pool_id AND s.pool_id = y.pool_id WHERE x.rep <> y.rep AND 1 - sim <= 0.4::DOUBLE)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_MASS = _values(MASS_MILLI.items())
_LOGP = _values(LOGP_CENTI.items())
_GRAPH_MASS = _values(MASS_MILLI_GRAPH.items())
_SCAFFOLD = f"""names(pool_id, scaffold) AS {_values(enumerate(SCAFFOLDS))}, lib AS (SELECT l.*, scaffold FROM library l JOIN names USING (pool_id))"""
_QUESTIONS = f"questions(question, query) AS {_values(enumerate(QUESTIONS))}"


def _asked(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


_N_ASKED = " + ".join(f"{_asked('query', w)}::INTEGER" for w in PROPERTIES.values())
_N_MET = " + ".join(f"({_asked('query', w)} AND {_asked('text', w)})::INTEGER" for w in PROPERTIES.values())


def _turns(questions) -> str:
    return f"asked(question, asked) AS {_values(enumerate(questions))}, turns AS (SELECT conv_id, turn, question, conv_id || '/' || turn || ': ' || asked AS query FROM conversations JOIN asked ON (conv_id + turn) % {len(questions)} = question)"


def _rewritten() -> str:
    out = "query"
    for k, v in SYNONYMS.items():
        out = f"CASE WHEN contains(lower(query), '{k}') THEN replace({out}, '{k}', '{k} (SMILES: {v})') ELSE {out} END"
    return out


def _kfold(n_of: str = "part") -> str:
    """Fold sizes of a shuffle dealt in turn do not depend on the shuffle."""
    return f"SELECT (i % 5)::INTEGER AS fold, count(*) AS n FROM (SELECT unnest(range((SELECT count(*) FROM {n_of}))) AS i) GROUP BY 1"


def _shuffled(n: int, seed: int = 42) -> list[int]:
    """Python's own shuffle, which folds must equal."""
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


# Sum formulas of the pool's molecules, hydrogens at N and O, and independent rings, all by hand.
_FORMULAS = [
    ("C2H6O", 1, 0), ("C6H6", 0, 1), ("C2H4O2", 1, 0), ("C5H5N", 0, 1), ("C3H8O", 1, 0), ("C3H8O", 1, 0), ("C4H10O", 1, 0), ("C8H10", 0, 1), ("C7H8", 0, 1), ("C6H6O", 1, 1),
    ("C9H8O4", 1, 1), ("C8H10N4O2", 0, 2), ("C8H9NO2", 2, 1), ("C7H6O3", 2, 1), ("C13H18O2", 1, 1), ("C20H12", 0, 5), ("C7H7NO2", 3, 1), ("C13H10O3", 1, 3), ("C6H8N2O2S", 4, 1), ("C7H6O2Na", 1, 1),
    ("C10H8", 0, 2), ("C10H14N2", 0, 2), ("C19H28O2", 1, 4), ("C7H6O2", 1, 1), ("C6H12", 0, 1), ("C5H5N", 0, 1), ("C2H5NO", 2, 0), ("C3H7NO2", 3, 0), ("C5H6N2", 2, 1), ("C20H22O5", 0, 3),
    ("C7H6O2", 1, 1), ("C7H7NO", 2, 1), ("C6H5F", 0, 1), ("C6H5Cl", 0, 1), ("C6H5Br", 0, 1), ("C6H7N", 2, 1), ("C6H6", 0, 1), ("C2H2", 0, 0), ("C3H7NO2", 3, 0),
]
# Standard atomic weights.
_WEIGHTS = {"C": 12.011, "H": 1.008, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.99, "S": 32.067, "Cl": 35.453, "Br": 79.904}
# Symbol, mass of the most common isotope, electrons of the outer shell.
_ISOTOPES = [("C", 12.0, 4), ("H", 1.00782503, 1), ("N", 14.003074, 5), ("O", 15.9949146, 6), ("F", 18.9984032, 7), ("Na", 22.9897693, 1), ("S", 31.9720711, 6), ("Cl", 34.9688527, 7), ("Br", 78.9183376, 7)]
# Scaffolds of the pool's molecules, by hand; those that are not named are benzene's for aromatic members, none for open chains.
_MURCKO = {3: "c1ccncc1", 11: "c1(c2c(nc[nH]2)[nH]c([nH]1)=O)=O", 15: "c12c3c4ccc1c1c(cc2ccc3ccc4)cccc1", 17: "C1=2C(c3c(C1CC(C2)=O)cccc3)=O", 20: "c12c(cccc1)cccc2", 21: "[C@H]1(CCCN1)c1cccnc1", 22: "C1(C=C2C(C3C(C4C(CC3)CCC4)CC2)CC1)=O", 24: "C1CCCCC1", 25: "c1ccncc1", 28: "c1ccncc1", 29: "C1(CC(Cc2c1cccc2)c1ccccc1)=O", 39: "INVALID_SMILES"}
_OPEN = {0, 2, 4, 5, 6, 26, 27, 37, 38}
_SCAFFOLDS = [(i, _MURCKO.get(i, "" if i in _OPEN else "c1ccccc1")) for i in range(len(POOL))]
# Pool members that are the same molecule as an earlier one, as they are, as free acid without counter-ion, and as carbon frame.
_SAME = {25: 3, 36: 1, 30: 23}
_SAME_STANDARD = _SAME | {23: 19, 30: 19}
_FRAMES = {0: 0, 2: 0, 4: 0, 5: 0, 6: 0, 26: 0, 27: 0, 37: 0, 38: 0, 11: 11, 15: 15, 17: 17, 20: 20, 21: 21, 22: 22, 29: 29}
# Atoms of the pool's carboxylic acids, by hand: the carbon, its oxygen, its hydroxyl.
_ACIDS = {2: "1,2,3", 10: "10,11,12", 13: "1,2,0", 14: "12,13,14", 16: "1,0,2", 19: "2,3,1", 23: "6,7,8", 27: "3,4,5", 30: "6,7,8", 38: "3,4,5"}
# Methyl esters of the pool's acids, by hand.
_ESTERS = ["C(C(C)N)(=O)OC", "C(C(C)c1ccc(CC(C)C)cc1)(=O)OC", "C(C)(=O)OC", "C(C)(=O)Oc1c(C(=O)OC)cccc1", "C([C@@H](C)N)(=O)OC", "C(c1c(cccc1)O)(=O)OC", "C(c1ccc(cc1)N)(=O)OC", "C(c1ccccc1)(=O)OC"]

_PROTEINS = """names AS (SELECT p_partkey, p_brand, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS s FROM part),
proteins AS (SELECT 'part|' || p_partkey || '|' || p_brand AS name, sequence FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN translate(s, 'BJOUXZ', 'ADEFGH') ELSE s END AS sequence FROM names) WHERE regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+'))"""

ORACLES = {
    "kfold": _with(_LIBRARY, f"shuffles(n, places) AS (VALUES {', '.join(f'({n}, {_shuffled(n)})' for n in (200, 2000))})", "dealt AS (SELECT unnest(places) AS pos, generate_subscripts(places, 1) - 1 AS i FROM shuffles WHERE n = (SELECT count(*) FROM part))", "placed AS (SELECT mol_id, row_number() OVER (ORDER BY mol_id) - 1 AS pos FROM library)")
    + "SELECT mol_id, pos, (i % 5)::INTEGER AS fold FROM placed JOIN dealt USING (pos)",
    "murcko_scaffolds": _with(_LIBRARY, f"names(pool_id, scaffold) AS {_values(_SCAFFOLDS)}") + "SELECT mol_id, scaffold FROM library JOIN names USING (pool_id)",
    "canonical_classes": _with(_LIBRARY, f"names(pool_id, canonical, standard, frame) AS {_values((i, _SAME.get(i, i), _SAME_STANDARD.get(i, i), _FRAMES.get(i, 1)) for i in range(39))}") + "SELECT mol_id, canonical::BIGINT AS canonical, standard::BIGINT AS standard, frame::BIGINT AS frame FROM library JOIN names USING (pool_id)",
    "formula_descriptors": _with(_LIBRARY, f"formulas(pool_id, formula, hs, rings) AS {_values((i, *x) for i, x in enumerate(_FORMULAS))}", f"weights(sym, w) AS {_values(_WEIGHTS.items())}",
        "parts AS (SELECT pool_id, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) AS x FROM formulas)", "counts AS (SELECT pool_id, regexp_extract(x, '[A-Za-z]+') AS sym, coalesce(try_cast(regexp_extract(x, '[0-9]+') AS INTEGER), 1) AS n FROM parts)",
        "sums AS (SELECT pool_id, sum(n * w::DOUBLE) AS mw, sum(n * w::DOUBLE) FILTER (WHERE sym <> 'H') AS hmw, sum(n) FILTER (WHERE sym <> 'H') AS heavy, coalesce(sum(n) FILTER (WHERE sym NOT IN ('H', 'C')), 0) AS hetero, coalesce(sum(n) FILTER (WHERE sym IN ('N', 'O')), 0) AS n_o FROM counts JOIN weights USING (sym) GROUP BY 1)")
    + "SELECT mol_id, round(mw, 3) AS \"MolWt\", round(hmw, 3) AS \"HeavyAtomMolWt\", heavy::DOUBLE AS \"HeavyAtomCount\", hetero::DOUBLE AS \"NumHeteroatoms\", n_o::DOUBLE AS \"NOCount\", hs::DOUBLE AS \"NHOHCount\", rings::DOUBLE AS \"RingCount\", CASE WHEN pool_id = 19 THEN 2.0 ELSE 1.0 END::DOUBLE AS \"NumFragments\" FROM library JOIN formulas USING (pool_id) JOIN sums USING (pool_id)",
    # degrees and bonds are those of the compat reading but for the salt's dot, which it takes for a bond
    "graph_descriptors": _with(_LIBRARY, _GRAPH, f"formulas(pool_id, formula, hs, rings) AS {_values((i, *x) for i, x in enumerate(_FORMULAS))}", f"isotopes(sym, w, e) AS {_values(_ISOTOPES)}",
        "pieces AS (SELECT pool_id, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) AS x FROM formulas)", "counts AS (SELECT pool_id, regexp_extract(x, '[A-Za-z]+') AS sym, coalesce(try_cast(regexp_extract(x, '[0-9]+') AS INTEGER), 1) AS n FROM pieces)",
        "sums AS (SELECT pool_id, sum(n * w::DOUBLE) AS mw, sum(n * e) AS el FROM counts JOIN isotopes USING (sym) GROUP BY 1)",
        "links AS (SELECT pool_id, s, d FROM bonds WHERE NOT (pool_id = 19 AND s = 0))", "sides AS (SELECT pool_id, s AS a, d AS b FROM links UNION ALL SELECT pool_id, d, s FROM links)", "deg AS (SELECT pool_id, a, count(*)::DOUBLE AS d FROM sides GROUP BY 1, 2)",
        "chi0 AS (SELECT pool_id, sum(1 / sqrt(d)) AS v FROM deg GROUP BY 1)", "chi1 AS (SELECT l.pool_id, sum(1 / sqrt(x.d * y.d)) AS v FROM links l JOIN deg x ON x.pool_id = l.pool_id AND x.a = l.s JOIN deg y ON y.pool_id = l.pool_id AND y.a = l.d GROUP BY 1)",
        "chi2 AS (SELECT p.pool_id, sum(1 / sqrt(x.d * y.d * z.d)) AS v FROM sides p JOIN sides q ON q.pool_id = p.pool_id AND q.a = p.a AND q.b > p.b JOIN deg x ON x.pool_id = p.pool_id AND x.a = p.b JOIN deg y ON y.pool_id = p.pool_id AND y.a = p.a JOIN deg z ON z.pool_id = p.pool_id AND z.a = q.b GROUP BY 1)")
    + "SELECT mol_id, round(mw, 4) AS \"ExactMolWt\", (el - (pool_id = 19)::INTEGER)::DOUBLE AS \"NumValenceElectrons\", round(coalesce(chi0.v, 0), 4) AS \"Chi0\", round(coalesce(chi1.v, 0), 4) AS \"Chi1\", round(coalesce(chi2.v, 0), 4) AS \"Chi2\", "
    + f"(pool_id IN ({', '.join(map(str, _ACIDS))}))::INTEGER::DOUBLE AS \"fr_COOH\", (pool_id IN (32, 33, 34))::INTEGER::DOUBLE AS \"fr_halogen\", CASE WHEN pool_id = 29 THEN 4.0 ELSE 0.0 END::DOUBLE AS \"fr_methoxy\", (pool_id = 37)::INTEGER::DOUBLE AS \"fr_alkyne\", "
    + "CASE pool_id WHEN 3 THEN 1.0 WHEN 11 THEN 2.0 WHEN 21 THEN 1.0 WHEN 25 THEN 1.0 WHEN 28 THEN 1.0 ELSE 0.0 END::DOUBLE AS \"NumAromaticHeterocycles\", CASE pool_id WHEN 22 THEN 3.0 WHEN 24 THEN 1.0 ELSE 0.0 END::DOUBLE AS \"NumSaturatedCarbocycles\" "
    + "FROM library JOIN formulas USING (pool_id) JOIN sums USING (pool_id) LEFT JOIN chi0 USING (pool_id) LEFT JOIN chi1 USING (pool_id) LEFT JOIN chi2 USING (pool_id)",
    "substructure_atoms": _with(_LIBRARY, f"acids(pool_id, atoms) AS {_values(_ACIDS.items())}") + "SELECT mol_id, atoms FROM library JOIN acids USING (pool_id)",
    "reaction_products": f"SELECT * FROM {_values((x,) for x in _ESTERS)} t(product)",
    # benzenes share the ring alone, as phenols and halides do with the others; pyridines the ring
    "common_substructure": f"SELECT * FROM {_values([('c1ccccc1', 19, 6), ('c1ccncc1', 3, 6)])} t(scaffold, n, n_atoms)",
    # a dot's bond of the compat reading is none
    "conformer_bonds": _with(_LIBRARY, _WALK, "n(pool_id, a, b) AS (SELECT p.pool_id, (SELECT count(*) FROM atoms x WHERE x.pool_id = p.pool_id), (SELECT count(*) FROM bonds x WHERE x.pool_id = p.pool_id) - len(regexp_extract_all(smiles, '\\.')) FROM pool p)")
    + "SELECT mol_id, a AS n_atoms, b::BIGINT AS n_bonds, 0::BIGINT AS n_close FROM library JOIN n USING (pool_id) WHERE a > 0",
    "token_pooling": "WITH w AS (SELECT conv_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM conversations), k AS (SELECT conv_id, CASE WHEN w NOT LIKE '%.' THEN w END AS w FROM w) SELECT conv_id, count(w) AS n_tokens, " + ", ".join(f"round(avg(length(w) - length(replace(w, '{c}', ''))), 9) AS mean_{c}" for c in LETTERS) + " FROM k GROUP BY 1",
    "drawn_forms": f"""WITH forms(form_id, compound, substance) AS {_values((i, c.replace("'", "''"), t.replace("'", "''")) for i, (_, c, t) in enumerate(FORMS))},
own AS (SELECT p_partkey AS mol_id, form_id, compound, substance FROM part JOIN forms ON p_partkey % {len(FORMS)} = form_id)
SELECT mol_id, form_id::BIGINT AS form_id, min(mol_id) OVER (PARTITION BY compound) AS canonical_first, count(*) OVER (PARTITION BY compound) AS canonical_n, min(mol_id) OVER (PARTITION BY substance) AS standard_first, count(*) OVER (PARTITION BY substance) AS standard_n FROM own""",
    "sdf_roundtrip": _with(_LIBRARY, _WALK, f"formulas(pool_id, formula, hs, rings) AS {_values((i, *x) for i, x in enumerate(_FORMULAS))}",
        "n(pool_id, a, b) AS (SELECT p.pool_id, (SELECT count(*) FROM atoms x WHERE x.pool_id = p.pool_id), (SELECT count(*) FROM bonds x WHERE x.pool_id = p.pool_id) - len(regexp_extract_all(smiles, '\\.')) FROM pool p)")
    + "SELECT mol_id, 1 AS same, a AS n_atoms, b::BIGINT AS n_bonds, coalesce(nullif(regexp_extract(formula, 'H([0-9]*)', 1), '')::BIGINT, 1) AS n_hydrogens FROM library JOIN n USING (pool_id) JOIN formulas USING (pool_id)",
    "multitask_metrics": """WITH d AS (SELECT p_size::DOUBLE AS y0, (p_partkey % 11)::DOUBLE AS y1, (p_partkey % 50)::DOUBLE AS p0, (p_partkey % 13)::DOUBLE AS p1 FROM part WHERE p_partkey % 9 <> 0), m AS (SELECT *, avg(y0) OVER () AS m0, avg(y1) OVER () AS m1 FROM d)
SELECT round(1 - sum((y0 - p0) ** 2 + (y1 - p1) ** 2) / sum((y0 - m0) ** 2 + (y1 - m1) ** 2), 6) AS r2, round(sum(abs(y0 - p0) + abs(y1 - p1)) / (2 * count(*)), 6) AS mae, round(sqrt(sum((y0 - p0) ** 2 + (y1 - p1) ** 2) / (2 * count(*))), 6) AS rmse, count(*) AS n FROM m""",
    "smiles_file_roundtrip": _with(_LIBRARY) + "SELECT smiles, count(*) AS n FROM library GROUP BY 1",
    "activity_records": _with(_LIBRARY) + "SELECT 'CHEMBL' || mol_id AS molecule_chembl_id, smiles AS canonical_smiles, CASE WHEN mol_id % 10 <> 0 THEN label END AS standard_value, 'nM' AS standard_units, p_brand AS assay_chembl_id FROM library JOIN part ON mol_id = p_partkey",
    "record_lookup": _with(_LIBRARY) + "SELECT 'CHEMBL' || mol_id AS chembl_id, smiles FROM library WHERE mol_id % 3 = 0 AND pool_id <> 39",
    "shape_descriptors": """WITH p AS (SELECT l_orderkey AS k, l_linenumber::DOUBLE AS m, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem), c AS (SELECT k, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM p GROUP BY 1)
SELECT k AS l_orderkey, round(sqrt(sum(m * ((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) / sum(m)), 4) AS radius FROM p JOIN c USING (k) GROUP BY 1""",
    "tanimoto_join": _with(_DISTINCT, _WALK, _HYDROGENS, _IDS, "sizes AS (SELECT pool_id, count(*) AS n FROM bits GROUP BY 1)",
        "met AS (SELECT a.pool_id AS query_id, b.pool_id AS mol_id, count(*) AS inter FROM bits a JOIN bits b ON a.bit = b.bit WHERE a.pool_id % 20 = 0 GROUP BY 1, 2)")
    + "SELECT query_id, mol_id, inter, p.n + q.n - inter AS union_n FROM met JOIN sizes p ON p.pool_id = query_id JOIN sizes q ON q.pool_id = mol_id WHERE inter / (p.n + q.n - inter) >= 0.6::DOUBLE",
    "fingerprint_columns": _with(_LIBRARY, _GRAPH, _IDS) + "SELECT mol_id, " + ", ".join(f"coalesce(max((bit % 64 = {i})::INTEGER), 0)::INTEGER AS fp_{i}" for i in range(64)) + " FROM library LEFT JOIN bits USING (pool_id) GROUP BY 1",
    "positional_rows": "SELECT w.k::BIGINT AS \"at\", p_partkey AS mol_id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part) JOIN (VALUES (0, 0), (1, 1), (2, 0), (3, -1)) w(k, place) ON r = CASE WHEN place > 0 THEN place ELSE n + place END",
    # by hand: named molecules by structure and locally, an unknown name by name, and two questions without any source
    "rag_routed": f"""WITH {_turns((*QUESTIONS, 'logp of unknownium'))}, a(question, answer, sources, relevant, score, iterations, n_chunks) AS (VALUES
(0, 'Based on 1 source(s):' || chr(10) || '  [PUBCHEM] PubChem properties for SMILES=CC(=O)Oc1ccccc1C(=O)O: Formula=C9H8O4, MW=180.16, XLogP=1.2, TPSA=63.6', 'pubchem', 1, 10.0::DOUBLE, 1, 1),
(1, NULL, '', 0, 0.0::DOUBLE, 5, 0),
(2, 'Based on 2 source(s):' || chr(10) || '  [LOCAL] SMILES: CCO, MW=46.07, LogP=-0.00, TPSA=20.2' || chr(10) || '  [PUBCHEM] PubChem properties for SMILES=CCO: Formula=C2H6O, MW=46.07, XLogP=-0.1, TPSA=?', 'local,pubchem', 1, 10.0::DOUBLE, 1, 2),
(3, NULL, '', 0, 0.0::DOUBLE, 5, 0),
(4, 'Based on 1 source(s):' || chr(10) || '  [PUBCHEM_NAME] PubChem: ''unknownium'' \u2192 SMILES=[U], MW=238.03, XLogP=?', 'pubchem_name', 1, 10.0::DOUBLE, 1, 1))
SELECT query, coalesce(answer, 'Could not find sufficient information for: ' || query) AS answer, sources, relevant, score, iterations, n_chunks FROM turns JOIN a USING (question)""",
    "rag_answer": f"""WITH {_turns(QUESTIONS)}, a(question, answer, sources, relevant, score, iterations) AS (VALUES (0, 'Based on 2 source(s):' || chr(10) || '  [PUBCHEM] XLogP=3.5 LogP logp' || chr(10) || '  [LOCAL] SMILES: CCO, MW=46.07', 'pubchem,local', 1, 10.0::DOUBLE, 1),
(1, NULL, '', 0, 0.0::DOUBLE, 5), (2, 'Based on 1 source(s):' || chr(10) || '  [LOCAL] no numbers', 'local', 0, 0.0::DOUBLE, 5), (3, NULL, '', 0, 0.0::DOUBLE, 5))
SELECT query, coalesce(answer, 'No information found for: ' || query) AS answer, sources, relevant, score, iterations FROM turns JOIN a USING (question)""",
    "mol_scan": _with(_LIBRARY) + "SELECT mol_id, smiles, length(smiles) AS n_chars FROM library",
    "builtin_descriptors": _with(_LIBRARY, _GRAPH, f"mass(z, w) AS {_MASS}, inc(z, c) AS {_LOGP}", "sums AS (SELECT pool_id, sum(coalesce(w, a.z * 2000)) AS mw, sum(coalesce(c, 0)) AS lp, count(*) AS n FROM atoms a LEFT JOIN mass ON mass.z = a.z LEFT JOIN inc ON inc.z = a.z GROUP BY 1)")
    + "SELECT mol_id, coalesce(mw, 0)::DOUBLE / 1000.0::DOUBLE AS mw, coalesce(lp, 0)::DOUBLE / 100.0::DOUBLE AS logp, coalesce(n, 0)::INTEGER AS heavy_atoms FROM library LEFT JOIN sums USING (pool_id)",
    "atom_table": _with(_LIBRARY, _GRAPH) + "SELECT mol_id, idx, z AS atomic_num, arom::INTEGER AS is_aromatic, chir AS chirality FROM library JOIN atoms USING (pool_id)",
    "bond_table": _with(_LIBRARY, _GRAPH) + "SELECT mol_id, b AS bond_idx, s AS src, d AS dst, o AS bond FROM library JOIN bonds USING (pool_id)",
    "atom_passes": _with(_LIBRARY, _GRAPH) + "SELECT mol_id, idx, hs AS num_hs, degree::INTEGER AS degree, in_ring, hyb AS hybridization FROM library JOIN full_atoms USING (pool_id)",
    "node_features": _with(_LIBRARY, _GRAPH, f"mass(z, w) AS {_GRAPH_MASS}")
    + "SELECT mol_id, idx, a.z::BIGINT AS f0, arom::BIGINT AS f1, 0::BIGINT AS f2, hs::BIGINT AS f3, degree::BIGINT AS f4, in_ring::BIGINT AS f5, hyb::BIGINT AS f6, chir::BIGINT AS f7, round(coalesce(w, a.z * 1000) / 100000.0::DOUBLE, 5) AS f8 FROM library JOIN full_atoms a USING (pool_id) LEFT JOIN mass ON mass.z = a.z",
    "edge_index": _with(_LIBRARY, _GRAPH) + "SELECT mol_id, (2 * b + way)::INTEGER AS edge, (CASE way WHEN 0 THEN s ELSE d END)::BIGINT AS src, (CASE way WHEN 0 THEN d ELSE s END)::BIGINT AS dst, (o = 1)::INTEGER AS b1, (o = 2)::INTEGER AS b2, (o = 3)::INTEGER AS b3, (o = 4)::INTEGER AS b4 FROM library JOIN bonds USING (pool_id), (VALUES (0), (1)) w(way)",
    "hetero_nodes": _with(_LIBRARY, _GRAPH, f"labels(z, t) AS {_values(LABELS.items())}", "typed AS (SELECT pool_id, idx, coalesce(t, 'other') AS node_type, row_number() OVER (PARTITION BY pool_id, coalesce(t, 'other') ORDER BY idx) - 1 AS local_idx FROM atoms LEFT JOIN labels ON labels.z = atoms.z)")
    + "SELECT mol_id, idx, node_type, local_idx FROM library JOIN typed USING (pool_id)",
    "hetero_edges": _with(_LIBRARY, _GRAPH, f"labels(z, t) AS {_values(LABELS.items())}", "typed AS (SELECT pool_id, idx, coalesce(t, 'other') AS node_type, row_number() OVER (PARTITION BY pool_id, coalesce(t, 'other') ORDER BY idx) - 1 AS local_idx FROM atoms LEFT JOIN labels ON labels.z = atoms.z)",
        "e AS (SELECT x.pool_id, a.node_type AS src_type, b.node_type AS dst_type, count(*) AS n_edges, sum(a.local_idx)::BIGINT AS src_sum, sum(b.local_idx)::BIGINT AS dst_sum FROM ends x JOIN typed a ON a.pool_id = x.pool_id AND a.idx = x.a JOIN typed b ON b.pool_id = x.pool_id AND b.idx = x.other GROUP BY 1, 2, 3)")
    + "SELECT mol_id, src_type, dst_type, n_edges, src_sum, dst_sum FROM library JOIN e USING (pool_id)",
    "ecfp_bits": _with(_LIBRARY, _GRAPH, _IDS) + "SELECT mol_id, bit FROM library JOIN bits USING (pool_id)",
    "ecfp_popcount": _with(_LIBRARY, _GRAPH, _IDS) + "SELECT mol_id, count(bit) AS n_bits FROM library LEFT JOIN bits USING (pool_id) GROUP BY 1",
    "tanimoto_pairs": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS) + "SELECT * FROM pairs",
    "similarity_topk": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS) + "SELECT query_id, mol_id, round(sim, 4) AS sim, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, mol_id) AS r FROM pairs) WHERE r <= 10",
    "screen_threshold": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS) + "SELECT query_id, mol_id, round(sim, 4) AS sim FROM pairs WHERE sim >= 0.3 ORDER BY round(sim, 4) DESC, query_id, mol_id LIMIT 50",
    "screen_counts": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS) + "SELECT count(DISTINCT mol_id) AS n_screened, count(*) FILTER (WHERE sim >= 0.3) AS n_hits FROM pairs",
    "screen_best": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS, "best AS (SELECT mol_id, max(sim) AS similarity FROM pairs GROUP BY 1)") + "SELECT row_number() OVER (ORDER BY similarity DESC, mol_id DESC) AS rank, mol_id, similarity FROM best ORDER BY similarity DESC, mol_id DESC LIMIT 100",
    "tanimoto_embeddings": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS s FROM embeddings),
p AS (SELECT q.vec_id AS query_id, l.vec_id AS mol_id, list_sum(list_transform(list_zip(q.s, l.s), lambda z: z[1] * z[2]))::BIGINT AS inter, list_sum(q.s) + list_sum(l.s) AS total FROM e q, e l WHERE q.vec_id % 20 = 0 AND q.vec_id <> l.vec_id)
SELECT query_id, mol_id, rank, inter FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN total - inter > 0 THEN inter::DOUBLE / (total - inter)::DOUBLE ELSE 0 END DESC, mol_id) AS rank FROM p) WHERE rank <= 5""",
    "ro5_filter": _with(_LIBRARY, _GRAPH, f"mass(z, w) AS {_MASS}, inc(z, c) AS {_LOGP}", "sums AS (SELECT pool_id, sum(coalesce(w, a.z * 2000)) AS mw, sum(coalesce(c, 0)) AS lp FROM atoms a LEFT JOIN mass ON mass.z = a.z LEFT JOIN inc ON inc.z = a.z GROUP BY 1)") + "SELECT mol_id, smiles FROM library JOIN sums USING (pool_id) WHERE mw <= 500000 AND lp <= 500",
    "rule_flags": """WITH d AS (SELECT p_partkey AS k, p_partkey % 700 AS mw, (p_partkey % 83)::DOUBLE / 10.0::DOUBLE AS logp, p_partkey % 9 AS hbd, p_partkey % 15 AS hba, p_partkey % 13 AS rot, p_partkey % 180 AS tpsa FROM part)
SELECT k AS mol_id, (mw <= 500 AND logp <= 5 AND hbd <= 5 AND hba <= 10)::INTEGER AS lipinski_pass, (rot <= 10 AND tpsa <= 140)::INTEGER AS veber_pass, (logp <= 5.88::DOUBLE AND tpsa <= 131.6)::INTEGER AS egan_pass FROM d""",
    "pic50": "SELECT p_partkey AS mol_id, round(-log10(greatest(p_retailprice * 1e-9, 1e-15)), 6) AS pic50 FROM part",
    "scaffold_groups": _with(_LIBRARY, _SCAFFOLD) + "SELECT scaffold, count(*) AS size, min(mol_id) AS first FROM lib GROUP BY 1",
    "scaffold_split": _with(_LIBRARY, _SCAFFOLD, "g AS (SELECT scaffold, count(*) AS size, min(mol_id) AS first FROM lib GROUP BY 1)", "c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)",
        "t AS (SELECT *, before < floor((SELECT count(*) FROM lib) * 0.8) AS tr FROM c)")
    + "SELECT mol_id, scaffold, CASE WHEN tr THEN 'train' WHEN before - (SELECT sum(size) FROM t WHERE tr) < floor((SELECT count(*) FROM lib) * 0.1) THEN 'val' ELSE 'test' END AS split FROM lib JOIN t USING (scaffold)",
    "kfold_sizes": _kfold(),
    "scaffold_kfold": _with(_LIBRARY, _SCAFFOLD, "g AS (SELECT scaffold, count(*) AS n, row_number() OVER (ORDER BY min(mol_id)) - 1 AS pos FROM lib GROUP BY 1)", f"dealt(pos, i) AS {_values((p, i) for i, p in enumerate(_shuffled(len(set(SCAFFOLDS)))))}")
    + "SELECT scaffold, 1::BIGINT AS folds, (i % 4)::INTEGER AS fold, n FROM g JOIN dealt USING (pos)",
    "duplicate_occurrence": _with(_LIBRARY) + "SELECT mol_id, row_number() OVER (PARTITION BY smiles ORDER BY mol_id) - 1 AS occurrence FROM library",
    # the members that hold a carboxylic acid, by eye
    "substructure_acids": _with(_LIBRARY) + "SELECT mol_id, smiles FROM library WHERE smiles IN ('CC(=O)O', 'CC(=O)Oc1ccccc1C(=O)O', 'OC(=O)c1ccccc1O', 'CC(C)Cc1ccc(cc1)C(C)C(=O)O', 'O=C(O)c1ccc(N)cc1', '[Na+].OC(=O)c1ccccc1', 'c1ccc(cc1)C(=O)O', 'CC(N)C(=O)O', 'c1ccccc1C(=O)O', 'N[C@H](C)C(=O)O')",
    "substructure_inverted": _with(_LIBRARY) + "SELECT mol_id, smiles FROM library WHERE smiles <> 'INVALID_SMILES' AND smiles NOT IN ('CC(=O)O', 'CC(=O)Oc1ccccc1C(=O)O', 'OC(=O)c1ccccc1O', 'CC(C)Cc1ccc(cc1)C(C)C(=O)O', 'O=C(O)c1ccc(N)cc1', '[Na+].OC(=O)c1ccccc1', 'c1ccc(cc1)C(=O)O', 'CC(N)C(=O)O', 'c1ccccc1C(=O)O', 'N[C@H](C)C(=O)O')",
    "butina_neighbours": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS, _CLASSES) + "SELECT a, b, x.size AS a_size, y.size AS b_size FROM near JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b",
    "butina_clusters": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS, _CLASSES,
        "seq AS (SELECT c.rep AS a, coalesce(list(n.b) FILTER (WHERE n.b IS NOT NULL), []) AS bs, row_number() OVER (ORDER BY c.size - 1 + coalesce(sum(o.size), 0) DESC, c.rep DESC) AS k FROM classes c LEFT JOIN near n ON n.a = c.rep LEFT JOIN classes o ON o.rep = n.b GROUP BY c.rep, c.size)",
        "greedy AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS centre, []::BIGINT[] AS members UNION ALL SELECT s.k, CASE WHEN list_contains(used, s.a) THEN used ELSE list_concat(used, list_prepend(s.a, list_filter(s.bs, lambda x: NOT list_contains(used, x)))) END, CASE WHEN list_contains(used, s.a) THEN NULL ELSE s.a END, CASE WHEN list_contains(used, s.a) THEN [] ELSE list_prepend(s.a, list_filter(s.bs, lambda x: NOT list_contains(used, x))) END FROM greedy g JOIN seq s ON s.k = g.k + 1)",
        "pieces AS (SELECT k AS step, unnest(members) AS rep FROM greedy WHERE centre IS NOT NULL), totals AS (SELECT step, sum(size) AS total FROM pieces JOIN classes USING (rep) GROUP BY 1)",
        "ids AS (SELECT step, row_number() OVER (ORDER BY total DESC, step) - 1 AS cluster_id FROM totals)")
    + "SELECT l.mol_id, coalesce(cluster_id, -1) AS cluster_id FROM library l LEFT JOIN keys USING (pool_id) LEFT JOIN classes USING (fp) LEFT JOIN pieces USING (rep) LEFT JOIN ids USING (step)",
    "maxmin_pick": _with(_LIBRARY, _GRAPH, _IDS, _PAIRS, "valid AS (SELECT mol_id, pool_id, row_number() OVER (ORDER BY mol_id) - 1 AS pos FROM library JOIN (SELECT pool_id FROM mols) m USING (pool_id))",
        "picks AS (SELECT 0 AS pick, [mol_id] AS own, [pool_id] AS pools FROM valid WHERE pos = 42 % (SELECT count(*) FROM valid) UNION ALL SELECT pick + 1, list_append(own, n.mol_id), list_append(pools, n.pool_id) FROM picks, LATERAL (SELECT v.mol_id, v.pool_id FROM valid v JOIN sims s ON s.pool_id = v.pool_id AND list_contains(pools, s.query_id) WHERE NOT list_contains(own, v.mol_id) GROUP BY v.mol_id, v.pool_id ORDER BY min(1 - s.sim) DESC, v.mol_id LIMIT 1) n WHERE pick < 5)")
    + "SELECT pick::BIGINT AS pick, own[len(own)]::BIGINT AS mol_id FROM picks",
    "mmp_pairs": "WITH f AS (SELECT p_partkey::VARCHAR AS mol, p_brand || '|' || p_size AS core, p_type AS variable FROM part) SELECT a.mol AS mol_a, b.mol AS mol_b, a.variable AS smiles_a, b.variable AS smiles_b, a.core, a.variable || '>>' || b.variable AS transform FROM f a JOIN f b ON a.core = b.core WHERE a.mol < b.mol AND a.variable <> b.variable",
    "regression_metrics": """WITH d AS (SELECT p_brand AS brand, p_size::DOUBLE AS y, (p_partkey % 50)::DOUBLE AS p FROM part WHERE p_partkey % 7 <> 0), m AS (SELECT *, avg(y) OVER (PARTITION BY brand) AS mean FROM d)
SELECT brand, CASE WHEN sum((y - mean) ** 2) > 0 THEN round(1 - sum((y - p) ** 2) / sum((y - mean) ** 2), 6) ELSE 'nan'::DOUBLE END AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, count(*) AS n FROM m GROUP BY 1""",
    "uncertainty_stats": "SELECT l_partkey AS mol_id, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1",
    "skill_stats": """WITH e AS (SELECT event_type AS skill, event_type <> 'error' AS ok, round(value * 1000)::BIGINT AS ms, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 1) AS items FROM events)
SELECT skill, count(*) AS calls, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures, sum(ms)::BIGINT AS total_ms, sum(items)::BIGINT AS items, round(count(*) FILTER (WHERE ok)::DOUBLE / count(*), 6) AS success_rate,
  round(sum(ms)::DOUBLE / count(*), 4) AS avg_ms, CASE WHEN sum(ms) > 0 THEN round(sum(items)::DOUBLE / (sum(ms)::DOUBLE / 1000.0::DOUBLE), 6) ELSE 0 END AS throughput FROM e GROUP BY 1""",
    "running_totals": "SELECT event_type AS skill, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successes, sum(round(value * 1000)::BIGINT)::BIGINT AS total_us, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 1))::BIGINT AS items FROM events GROUP BY 1",
    "rag_relevance": f"WITH {_QUESTIONS}, d AS (SELECT doc_id, question, {_N_ASKED} AS asked, {_N_MET} AS met, text FROM documents, questions) SELECT doc_id, question::BIGINT AS question, CASE WHEN text IS NULL THEN 0.0::DOUBLE ELSE least(10.0::DOUBLE, CASE WHEN asked = 0 THEN 1.0::DOUBLE ELSE met::DOUBLE / asked::DOUBLE END * 8 + CASE WHEN regexp_matches(text, '[0-9]') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM d",
    "rag_rewrite": f"WITH {_turns(QUESTIONS)} SELECT conv_id, turn, {_rewritten()} AS rewritten, array_to_string(list_filter([{', '.join(f'''CASE WHEN contains(lower(query), '{k}') THEN '{v}' END''' for k, v in SYNONYMS.items())}], lambda x: x IS NOT NULL), '|') AS extracted FROM turns",
    "fasta_parse": f"WITH {_PROTEINS} SELECT name, sequence FROM proteins",
    "residue_composition": f"WITH {_PROTEINS} SELECT name, residue, count(*) AS n, any_value(2 * (length(sequence) - 1))::BIGINT AS n_edges FROM (SELECT name, sequence, unnest(string_split(sequence, '')) AS residue FROM proteins) GROUP BY 1, 2",
    "chembl_parse": _with(_LIBRARY)
    + """SELECT 'CHEMBL' || mol_id AS chembl_id, CASE WHEN mol_id % 5 <> 0 THEN smiles ELSE '' END AS smiles, CASE WHEN mol_id % 3 <> 0 THEN 'NAME ' || mol_id ELSE '' END AS name, CASE WHEN p THEN mol_id % 700 + 0.25::DOUBLE ELSE 0 END AS mw,
CASE WHEN p AND mol_id % 4 <> 0 THEN mol_id % 9 - 0.5::DOUBLE ELSE 0 END AS logp, CASE WHEN p THEN (mol_id % 11)::INTEGER ELSE 0 END AS hba, CASE WHEN p THEN (mol_id % 6)::INTEGER ELSE 0 END AS hbd, CASE WHEN p THEN mol_id % 130 + 0.5::DOUBLE ELSE 0 END AS tpsa, CASE WHEN p THEN (mol_id % 3)::INTEGER ELSE 0 END AS ro5_violations
FROM (SELECT *, mol_id % 7 <> 0 AS p FROM library)""",
    "parquet_roundtrip": _with(_LIBRARY, _GRAPH, _IDS) + "SELECT mol_id, any_value(smiles) AS smiles, any_value(label) AS label, 1 AS same, count(bit) AS n_bits, 2048::BIGINT AS fp_nbits FROM library LEFT JOIN bits USING (pool_id) GROUP BY 1",
    "record_layout": _with(_LIBRARY, _GRAPH, _IDS) + "SELECT smiles, count(*) AS n, coalesce(any_value(len(al)), 0)::BIGINT AS n_atoms, coalesce(any_value(len(bl)), 0)::BIGINT AS n_bonds, 256::BIGINT AS n_bytes, coalesce(any_value(n_bits), 0)::BIGINT AS n_bits FROM library LEFT JOIN mols USING (pool_id) LEFT JOIN (SELECT pool_id, count(*) AS n_bits FROM bits GROUP BY 1) b USING (pool_id) GROUP BY 1",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS skill, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS successes, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 1))::BIGINT AS items FROM events GROUP BY 1, 2",
    "label_rates": "SELECT quality, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS positives FROM labels GROUP BY 1",
}
