"""The pipeline's stages on their own input, and the whole of it."""

import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
from quernstone.llm import quality, simhash

from .conftest import DOCS, corpus, words


def test_stages(spark, docs):
    own = docs.select(*(c.split()[0] for c in DOCS.split(", ")))
    rows = own
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, "").collect()
        assert out and list(out[0].asDict()) == own.columns, name
        if name == "near_duplicates":
            before, kept = {r["doc_id"]: r["text"] for r in rows.collect()}, [r["doc_id"] for r in out]
            assert len(kept) == len(set(kept)) and max(Counter(before[k] for k in kept).values()) == 1
            assert 7 in kept and 120 not in kept  # a near copy of one word
        rows = spark.createDataFrame(out, DOCS)
    last = P.STAGES[-1][1](spark, rows, "").collect()
    assert len(last) == len(out) and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in last)


def test_stages_keep_odd_rows_and_extra_columns(spark, docs):
    """Null ids, equal ids, clashing columns: what no stage has a reason to drop stays."""
    rng = random.Random(33)
    plain = lambda: " ".join(rng.choice(["house", "river", "at", "on", "paper", "stone"]) + str(rng.randint(0, 999)) for _ in range(80))
    rows = [(i, plain(), "en", "s", None, 1, "y", 2.0) for i in range(60)]
    rows += [(None, plain(), "en", "s", None, 1, "y", 2.0) for _ in range(5)] + [(7, plain(), None, None, None, 1, "y", 2.0)]
    df = spark.createDataFrame(rows, DOCS + ", ids int, _source string, fps double")
    want = Counter((r[0], r[1]) for r in rows)
    for name, stage in P.STAGES[:3]:
        df = stage(spark, df, "")
        assert df.columns == [*(c.split()[0] for c in DOCS.split(", ")), "ids", "_source", "fps"], name
        assert Counter((r["doc_id"], r["text"]) for r in df.collect()) == want, name
    last = P.STAGES[-1][1](spark, P.STAGES[3][1](spark, df, ""), "").collect()
    assert all(r["round_trip"] for r in last) and sum(r["doc_id"] is None for r in last) >= 5


def test_passages_go(spark):
    """Passages of over fifty words that documents share go from all of them; near copies go."""
    rng = random.Random(34)
    passage = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(53))
    own = [words(rng, 120) for _ in range(6)]
    rows = [(k, f"{t[:200]} {passage} {t[200:]}", "en", "s", None) for k, t in enumerate(own)]
    out = P.repeated_passages(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert len(out) == 6 and not any(passage in r["text"] for r in out) and all(r["text"].startswith(own[r["doc_id"]][:190]) for r in out)


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_near_duplicates_are_verified(spark):
    """Equal word sets without a common shingle both stay; a chain of near copies goes."""
    rng = random.Random(3)
    text = words(rng, 120).split()
    chain = [text[:]]
    for k in range(4):  # each is alike to the one before, the last not to the first
        chain.append(chain[-1][:])
        chain[-1][10 + 25 * k] = "changed"
        chain[-1][20 + 25 * k] = "anew"
    mixed = sorted(text)
    rows = [(k, " ".join(t), "en", "src0", None) for k, t in enumerate([*chain, mixed, mixed[::-1]])] + [(9, " ".join(text).upper(), "en", "src0", None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, DOCS), word_seeds=P.NEAR_SEEDS, groups=6, verify=True).collect()
    assert sorted(r["doc_id"] for r in out) == [0, 5, 6]


def test_small_groups_take_pooled_estimates(spark):
    """A text of symbols goes from groups of one, by its language or else by all texts."""
    rng = random.Random(12)
    plain = lambda: " ".join(rng.choice(["house", "river", "at", "on", "paper", "stone"]) + str(rng.randint(0, 999)) for _ in range(80))
    odd = lambda: " ".join(rng.choice("abcdef") + str(rng.randint(0, 9999)) + "###$$$" for _ in range(80))
    rows = [(i, plain(), "en", "s", None) for i in range(100)]
    few = [("en", "t"), ("en", None), ("xx", "s"), (None, None)]
    rows += [(1000 + 2 * i + j, (plain, odd)[j](), lang, source, None) for i, (lang, source) in enumerate(few) for j in (0, 1)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in P.quality_rules(spark, df, "").collect()}
    assert kept == {r[0] for r in rows if r[0] < 1000 or r[0] % 2 == 0}
    assert kept == {r["doc_id"] for r in quality.judge(df, pooled=True).where("kept").collect()}


def test_alike():
    rng = random.Random(4)
    for _ in range(150):
        seeds = [rng.sample(range(60), 20) for _ in range(3)]
        sets = [np.array(sorted({*rng.choice(seeds)[: rng.randint(8, 20)], *rng.sample(range(60), rng.randint(0, 3))})) for _ in range(rng.randint(1, 30))]
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}):
                    low, high = sorted((want[i], want[j]))
                    want = [low if w == high else w for w in want]
        assert list(simhash.alike(sets)) == want


def test_blocks(spark, monkeypatch):
    """A component of several blocks is verified as in one go."""
    rng = random.Random(6)
    text, rows = words(rng, 100).split(), []
    for k in range(30):
        t = text[:]
        t[k * 3] = "changed"
        rows.append((k, " ".join(t), "en", "src0", None))
    monkeypatch.setattr(simhash, "BLOCK", 500)
    out = simhash.one_of_each(spark.createDataFrame(rows, DOCS), word_seeds=P.NEAR_SEEDS, groups=6, verify=True).collect()
    assert [r["doc_id"] for r in out] == [0]
