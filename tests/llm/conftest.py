import random

import pytest

WORDS = "the of and to in that it is was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", "s", "ing", "ed")) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; ids with gaps and one missing."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    line = "this line is long enough to count as a repeated one"
    item = "an item of the benchmark that should never be seen in any training text at all"
    rows = [(3, None), (7, ""), (8, "   \n\t "), (9, "1234 5678 !!"), (10, "word"), (20, long), (21, long + " more"), (22, prose(rng, 80)), (22, prose(rng, 80))]
    rows += [(30 + i, f"{line}\n{prose(rng, 12)}\n  {line.upper()} ") for i in range(6)]
    same = prose(rng, 60)
    rows += [(50, same), (51, same), (52, same.upper()), (53, same + " end"), (53, same + " end"), (None, same + " end")]
    rows += [(60, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (61, item.replace("never", "nevr").upper()), (62, "Écrire à jean.dupont@mail.example.com\nnaïve ÀÉ +1 (555) 010-9999; 4111 1111 1111 1111")]
    rows += [(70 + i, prose(rng, rng.randint(1, 90))) for i in range(20)]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, odd_rows, tmp_path_factory):
    """The rows as tables with further columns whose names operators use themselves."""
    d = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en" if k % 2 else "fr", f"s{k % 3}", None if t is None else len(t), k, "x", True) for k, (i, t) in enumerate(odd_rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, key string, held_out boolean").write.parquet(f"{d}/documents.parquet")
    labels = [(i, k % 4 > 0 and 1 or 0, None) for k, (i, _) in enumerate(odd_rows)] + [(None, 1, 0), (7, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(0, "an item of the benchmark that should never be seen in any training text at all"), (1, None), (2, ""), (3, "tiny"), (None, "another item that is nowhere in the texts of this table")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = random.Random(8)
    turns = [(None, 0, "user", "nobody's turn"), (0, 0, "user", "hello"), (0, None, None, "before all"), (0, 1, "assistant", None), (0, 1, "assistant", None), (1, 0, "user", "hello"), (7, 5, "user", "alone"), (-3, 0, "user", "below zero"), (11, 0, "user", "")]
    turns += [(20 + c, t, ("user", "assistant")[t % 2], ("same start", "same answer", f"own {c % 3} {t}")[min(t, 2)]) for c in range(12) for t in range(rng.randint(1, 9))]
    turns += [(c, t, "user", f"turn {t}") for c in (40, 45, 46) for t in range(61 - c % 5 * 20)]
    spark.createDataFrame([(*x, k, "x") for k, x in enumerate(turns)], "conv_id long, turn long, role string, text string, depth long, digest string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for t in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)
