"""Column functions over SMILES, Arrow batch by Arrow batch. A worker keeps what it has read of recent molecules.

Invalid text gives null, but where a function says otherwise.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fingerprints as fp
from . import molecule as m
from . import conformers as geometry
from . import properties, transforms
from .canonical import write
from .smarts import Target, compiled

KEPT = 1 << 16
_ints, _bools = T.ArrayType(T.IntegerType(), False), T.ArrayType(T.BooleanType(), False)
PARSED = T.StructType(
    [T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    + [T.StructField(n, k) for n, k in (("z", _ints), ("aromatic", _bools), ("charge", _ints), ("num_hs", _ints), ("degree", _ints), ("in_ring", _bools), ("hybridization", _ints), ("chirality", _ints), ("src", _ints), ("dst", _ints), ("bond", _ints))]
)
WORDS = T.ArrayType(T.LongType(), False)


@functools.lru_cache(KEPT)
def _read(smiles: str | None, mode: str):
    """(molecule, None) or (None, error)."""
    if smiles is None:
        return None, "null"
    if len(smiles) > m.MAX_SMILES:
        return None, f"longer than {m.MAX_SMILES} characters"
    try:
        return (m.parse_compat if mode == "compat" else m.parse_full)(smiles), None
    except m.SmilesError as e:
        return None, str(e)


@functools.lru_cache(KEPT)
def _kept(job, smiles: str | None, mode: str):
    mol, _ = _read(smiles, mode)
    return None if mol is None else job(mol)


class _Job:
    """A named function of a molecule with its parameters; equal ones share the cache."""

    def __init__(self, f, *args):
        self.f, self.args = f, args

    def __call__(self, mol):
        return self.f(mol, *self.args)

    def __hash__(self):
        return hash((self.f.__module__, self.f.__qualname__, self.args))

    def __eq__(self, other):
        return isinstance(other, _Job) and (self.f.__module__, self.f.__qualname__, self.args) == (other.f.__module__, other.f.__qualname__, other.args)


def _column(kind: T.DataType, f, *args, mode: str = "full", invalid=None):
    job = _Job(f, *args)

    def run(smiles: pd.Series) -> pd.Series:
        return pd.Series([invalid if (r := _kept(job, s, mode)) is None else r for s in smiles], dtype=object if isinstance(kind, (T.ArrayType, T.MapType, T.BooleanType, T.LongType, T.IntegerType)) else None)

    return F.pandas_udf(run, kind)


def _parsed_row(mol: m.Molecule):
    return (
        True, None, mol.z, mol.aromatic, mol.charge, mol.hs, m.degree(mol), m.in_ring(mol), m.hybridization(mol), mol.chirality,
        [b[0] for b in mol.bonds], [b[1] for b in mol.bonds], [b[2] for b in mol.bonds],
    )


def parse(smiles: Column | str, mode: str = "compat") -> Column:
    """The struct PARSED; ok is false and error says why where the text is not a molecule."""
    job = _Job(_parsed_row)

    def run(smiles: pd.Series) -> pd.DataFrame:
        rows = [_kept(job, s, mode) or (False, _read(s, mode)[1], *[None] * 11) for s in smiles]
        return pd.DataFrame(rows, columns=PARSED.names)

    return F.pandas_udf(run, PARSED)(smiles)


def parse_strict(smiles: Column | str, mode: str = "full") -> Column:
    """As parse, but a text that is not a molecule stops the query."""
    p = parse(smiles, mode)
    return F.when(p["ok"], p).otherwise(F.raise_error(F.concat(F.lit("invalid SMILES: "), F.coalesce(F.col(smiles) if isinstance(smiles, str) else smiles, F.lit("null")))))


def _maccs(mol: m.Molecule) -> np.ndarray:
    return fp.words({i for i, smarts in KEYS.items() if compiled(smarts).matches(Target(mol), most=1)} | {160 + k for k, n in enumerate((1, 2, 3)) if len(m.small_rings(mol)) >= n}, 192)


# Structural keys by number, each a pattern; a small published-style set in 167 places.
KEYS = {
    11: "*1~*~*~*1", 19: "*1~*~*~*~*~*~*1", 22: "*1~*~*1", 42: "F", 46: "Br", 84: "[NH2]", 96: "*1~*~*~*~*1", 103: "Cl", 110: "[#7]~[#6]~[#8]", 117: "[#7]~[#8]", 127: "*-&@*!@[#8]",
    135: "[#7]!:*:*", 139: "[OH]", 149: "[CH3]", 154: "C=O", 157: "C-O", 158: "C-N", 161: "[#7]", 163: "*1~*~*~*~*~*1", 164: "[#8]", 165: "[R]", 156: "[#7]~*(~*)~*", 151: "[NH]", 88: "[#16]", 27: "I", 29: "P",
}


def _circular(radius: int, nbits: int, mode: str):
    """An Arrow function: the distinct texts of a batch are read, and all their atoms step together."""

    def run(smiles: pa.Array) -> pa.Array:
        coded = smiles.dictionary_encode(null_encoding="encode")
        rows = fp.circular_batch([_read(s, mode)[0] for s in coded.dictionary.to_pylist()], radius, nbits)
        flat = rows[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1) if len(rows) else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(smiles) + 1, dtype=np.int32) * (nbits // 64)), pa.array(flat))

    return F.arrow_udf(run, WORDS)


def fingerprint(smiles: Column | str, kind: str = "ecfp4", radius: int = 2, nbits: int = 2048, backend: str = "rust", strict: bool | None = None) -> Column:
    """Words of 64 bits. ecfp4 with backend ``rust`` is the compat reading's and gives zeros for invalid text; other kinds and backends read
    fully. ecfp4 of the ``rdkit`` backend stops the query at invalid text; the others give zeros."""
    if nbits % 64 and kind != "maccs":
        raise ValueError("nbits must be a multiple of 64")
    kinds = {"ecfp4": (fp.circular, radius, nbits), "maccs": (_maccs,), "atompairs": (fp.atom_pairs, nbits), "atom_pairs": (fp.atom_pairs, nbits), "torsions": (fp.torsions, nbits), "topological_torsions": (fp.torsions, nbits), "rdkit_path": (fp.paths, nbits), "path": (fp.paths, nbits)}
    if kind not in kinds:
        raise ValueError(f"unknown fingerprint kind {kind!r}")
    if backend not in ("rust", "rdkit"):
        raise ValueError(f"unknown backend {backend!r}")
    compat = kind == "ecfp4" and backend == "rust"
    n = 3 if kind == "maccs" else nbits // 64
    if kind == "ecfp4":
        words = _circular(radius, nbits, "compat" if compat else "full")(smiles)
    else:
        words = _column(WORDS, *kinds[kind], invalid=[0] * n)(smiles)
    if strict is None:
        strict = kind == "ecfp4" and backend == "rdkit"
    return F.when(parse(smiles, "full")["ok"], words).otherwise(F.raise_error(F.lit("invalid SMILES"))) if strict else words


def canonical(smiles: Column | str) -> Column:
    return _column(T.StringType(), write)(smiles)


def _largest(mol: m.Molecule) -> str:
    return write(transforms.largest_fragment(mol))


def _neutral(mol: m.Molecule) -> str:
    return write(transforms.uncharged(mol))


def strip_salts(smiles: Column | str) -> Column:
    return _column(T.StringType(), _largest)(smiles)


def neutralize(smiles: Column | str) -> Column:
    return _column(T.StringType(), _neutral)(smiles)


def standardize(smiles: Column | str) -> Column:
    return _column(T.StringType(), transforms.standardized)(smiles)


def scaffold(smiles: Column | str, generic: bool = False) -> Column:
    """The Murcko scaffold; empty text for a molecule without rings."""
    return _column(T.StringType(), transforms.scaffold_smiles, generic)(smiles)


def _descriptors(mol: m.Molecule, names: tuple[str, ...]):
    out = []
    for n in names:
        try:
            out.append(float(properties.DESCRIPTORS[n](mol)))
        except (ArithmeticError, ValueError):
            out.append(float("nan"))
    return tuple(out)


def descriptor_names() -> list[str]:
    return list(properties.DESCRIPTORS)


def chosen_descriptors(names: list[str] | None = None, preset: str | None = None) -> list[str]:
    """An explicit preset wins over names; neither means lipinski."""
    if preset is not None:
        if preset != "all" and preset not in properties.PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        return descriptor_names() if preset == "all" else properties.PRESETS[preset]
    names = properties.PRESETS["lipinski"] if names is None else names
    if missing := [n for n in names if n not in properties.DESCRIPTORS]:
        raise ValueError(f"unknown descriptors {missing}")
    return names


def descriptors(smiles: Column | str, names: list[str] | None = None, preset: str | None = None) -> Column:
    """A struct of doubles; NaN for invalid text."""
    names = chosen_descriptors(names, preset)
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    job = _Job(_descriptors, tuple(names))

    def run(smiles: pd.Series) -> pd.DataFrame:
        nothing = (float("nan"),) * len(names)
        return pd.DataFrame([_kept(job, s, "full") or nothing for s in smiles], columns=names)

    return _with_nan(F.pandas_udf(run, kind)(smiles), names)


def _with_nan(c: Column, names: list[str]) -> Column:
    """Arrow turns NaN into null on the way back; this undoes it."""
    return F.struct(*[F.coalesce(c[n], F.lit(float("nan"))).alias(n) for n in names])


def _has(mol: m.Molecule, smarts: str) -> bool:
    return bool(compiled(smarts).matches(Target(mol), most=1))


def _found(mol: m.Molecule, smarts: str) -> list[list[int]]:
    return [list(x) for x in compiled(smarts).unique(Target(mol))]


def matches(smiles: Column | str, smarts: str) -> Column:
    compiled(smarts)
    return _column(T.BooleanType(), _has, smarts)(smiles)


def _fits(mol: m.Molecule, pattern) -> bool:
    return bool(pattern.matches(Target(mol), most=1))


def fits(smiles: Column | str, pattern) -> Column:
    """Whether a compiled pattern matches; null for invalid text."""

    def run(smiles: pd.Series) -> pd.Series:
        return pd.Series([None if (mol := _read(s, "full")[0]) is None else _fits(mol, pattern) for s in smiles], dtype=object)

    return F.pandas_udf(run, T.BooleanType())(smiles)


def substructures(smiles: Column | str, smarts: str) -> Column:
    """Atom numbers of each place that matches, one for each set of atoms."""
    compiled(smarts)
    return _column(T.ArrayType(T.ArrayType(T.IntegerType())), _found, smarts)(smiles)


def _alerts(mol: m.Molecule, which: str) -> list[str]:
    return properties.alerts(mol, getattr(properties, which))


def alerts(smiles: Column | str, which: str = "PAINS") -> Column:
    return _column(T.ArrayType(T.StringType()), _alerts, which)(smiles)


def _reacted(mol: m.Molecule, smarts: str) -> list[str]:
    return transforms.react(smarts, [mol])


def react(smiles: Column | str, smarts: str) -> Column:
    transforms.reaction(smarts)
    return _column(T.ArrayType(T.StringType()), _reacted, smarts)(smiles)


def react_pair(a: Column | str, b: Column | str, smarts: str) -> Column:
    """Products of two reactants in the template's order; null if either is invalid."""
    transforms.reaction(smarts)

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = _read(s, "full")[0], _read(t, "full")[0]
            out.append(None if p is None or q is None else transforms.react(smarts, [p, q]))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(a, b)


CUT = T.ArrayType(T.StructType([T.StructField("core", T.StringType()), T.StructField("variable", T.StringType()), T.StructField("environment", T.StringType())]))


def _cuts(mol: m.Molecule, most: int, radius: int):
    if most == 1:
        return [{"core": c, "variable": v, "environment": transforms.environment(mol, a, radius)} for c, v, a in transforms.single_cuts(mol)]
    return [{"core": c, "variable": v, "environment": None} for c, v in transforms.double_cuts(mol)]


def cuts(smiles: Column | str, max_cut_bonds: int = 1, radius: int = 3) -> Column:
    """Ways to cut one or two acyclic single bonds."""
    if max_cut_bonds not in (1, 2):
        raise ValueError("max_cut_bonds must be 1 or 2")
    return _column(CUT, _cuts, max_cut_bonds, radius)(smiles)


def _rgroups(mol: m.Molecule, core: str):
    return transforms.rgroups(core, mol)


def rgroups(smiles: Column | str, core: str) -> Column:
    """map of Core, R1, R2, ...; empty where the molecule is invalid or does not hold the core."""
    compiled(core)
    return _column(T.MapType(T.StringType(), T.StringType()), _rgroups, core, invalid={})(smiles)


def _block(mol: m.Molecule) -> str:
    return transforms.to_molblock(mol)


def molblock(smiles: Column | str) -> Column:
    return _column(T.StringType(), _block)(smiles)


def from_molblock(block: Column | str) -> Column:
    """Canonical SMILES of a V2000 mol block; null if it cannot be read."""

    def run(blocks: pd.Series) -> pd.Series:
        out = []
        for b in blocks:
            try:
                out.append(None if b is None or len(b) > 1_024_000 else write(transforms.from_molblock(b)))
            except m.SmilesError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.StringType())(block)


def shape_descriptors(xyz: Column | str, masses: Column | str) -> Column:
    """Moments and shape of given coordinates: PMI1-3, NPR1-2, radius of gyration, asphericity, eccentricity, inertial shape, spherocity."""
    names = ["PMI1", "PMI2", "PMI3", "NPR1", "NPR2", "RadiusOfGyration", "Asphericity", "Eccentricity", "InertialShapeFactor", "SpherocityIndex"]
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def run(points: pd.Series, weights: pd.Series) -> pd.DataFrame:
        rows = []
        for p, w in zip(points, weights, strict=True):
            if p is None or w is None or not len(p):
                rows.append([np.nan] * len(names))
                continue
            p, w = np.array([list(x) for x in p], float), np.array(list(w), float)
            p = p - (w[:, None] * p).sum(0) / w.sum()
            g = (w[:, None, None] * (p[:, :, None] * p[:, None, :])).sum(0)
            lam = np.sort(np.linalg.eigvalsh(g / w.sum()))
            pmi = np.sort(np.linalg.eigvalsh(np.trace(g) * np.eye(3) - g))
            s = lam.sum()
            safe = lambda a, b: a / b if b else 0.0
            plain = np.sort(np.linalg.eigvalsh((p - p.mean(0)).T @ (p - p.mean(0))))
            rows.append([*pmi, safe(pmi[0], pmi[2]), safe(pmi[1], pmi[2]), np.sqrt(s), safe(1.5 * ((lam - s / 3) ** 2).sum(), s * s), safe(np.sqrt(max(0, pmi[2] ** 2 - pmi[0] ** 2)), pmi[2]), safe(pmi[1], pmi[0] * pmi[2]), safe(3 * plain[0], plain.sum())])
        return pd.DataFrame(rows, columns=names)

    return _with_nan(F.pandas_udf(run, kind)(xyz, masses), names)


_POINTS = T.ArrayType(T.ArrayType(T.DoubleType()))


def conformers(smiles: Column | str, n_confs: int = 1, seed: int = 42, hydrogens: bool = False) -> Column:
    """Up to n_confs conformers, each the coordinates of the heavy atoms, or of all atoms with the hydrogens last. Null for invalid text; no conformer where no draw
    fits or the molecule has over conformers.MOST_ATOMS atoms."""

    def run(smiles: pa.Array) -> pa.Array:
        coded = smiles.dictionary_encode(null_encoding="encode")
        texts = coded.dictionary.to_pylist()
        there = [(k, s, mol) for k, s in enumerate(texts) if (mol := _read(s, "full")[0]) is not None]
        found: list = [None] * len(texts)
        for (k, _, mol), points in zip(there, geometry.embedded([(s, mol) for _, s, mol in there], n_confs, seed), strict=True):
            found[k] = [(x if hydrogens else x[: len(mol)]).tolist() for x in points]
        kept = pa.array(found, pa.list_(pa.list_(pa.list_(pa.float64()))))
        return kept.take(coded.indices)

    return F.arrow_udf(run, T.ArrayType(_POINTS))(smiles)


def _weights(mol: m.Molecule) -> list[float]:
    return [properties.WEIGHT.get(z, 0.0) for z in mol.z]


def shape_3d(smiles: Column | str, seed: int = 42) -> Column:
    """shape_descriptors of the heavy atoms of the first conformer; NaN where there is none."""
    return shape_descriptors(F.get(conformers(smiles, 1, seed), F.lit(0)), _column(T.ArrayType(T.DoubleType()), _weights)(smiles))


def register(spark) -> None:
    """SQL functions: ecfp, canonical_smiles, murcko, mol_standardize, has_substruct; and the table function mmp_fragments(smiles, cuts)."""
    for name, kind, f, args, mode, invalid in (
        ("ecfp", WORDS, fp.circular, (2, 2048), "compat", [0] * 32), ("canonical_smiles", T.StringType(), write, (), "full", None),
        ("murcko", T.StringType(), transforms.scaffold_smiles, (False,), "full", None), ("mol_standardize", T.StringType(), transforms.standardized, (), "full", None),
    ):
        spark.udf.register(name, _column(kind, f, *args, mode=mode, invalid=invalid))

    def has_substruct(smiles: pd.Series, smarts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or (mol := _read(x, "full")[0]) is None else _has(mol, s) for x, s in zip(smiles, smarts, strict=True)], dtype=object)

    spark.udf.register("has_substruct", F.pandas_udf(has_substruct, T.BooleanType()))

    @F.udtf(returnType="core string, variable string")
    class Fragments:
        def eval(self, smiles: str, max_cut_bonds: int):
            mol = _read(smiles, "full")[0]
            if mol is not None:
                for own in transforms.single_cuts(mol) if max_cut_bonds == 1 else transforms.double_cuts(mol):
                    yield own[0], own[1]

    spark.udtf.register("mmp_fragments", Fragments)
