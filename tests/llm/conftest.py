import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared passages, nulls, empty and odd ones."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 220)) for _ in range(24)]
    passage = words(rng, 90)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]
    near = base[7].split()
    near[5] = "changed"
    rows += [(120, " ".join(near)), (121, base[3][:900]), (122, base[8] + "\n" + passage), (123, passage + " " + base[9]), (124, "x" + passage)]
    rows += [(130, None), (131, ""), (132, " \n\t "), (133, "a"), (134, "aaaa" * 400), (135, "aaaa" * 410), (136, "é" * 700 + " ü漢字 end"), (137, "the " * 500)]
    rows += [(0, base[0]), (None, base[1]), (None, "no id here and no copy of it")]
    lang, source = ("en", "de", None), ("src0", "src0", "src1", None, "src10")
    return [(i, t, lang[k % 3], source[k % 5], len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with extra columns, whose names the operators use inside too."""
    return spark.createDataFrame([(*r, 1, "y", 2.0) for r in corpus()], DOCS + ", size int, _source string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
