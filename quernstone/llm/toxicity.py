"""Operator 5: toxicity by weak supervision.

1. Voters that don't depend on labels: insults of four languages (fixed lists), insults aimed
   at a person, hostile phrases, exclamations, shouting.
2. Voters that are learned: the labelled rows outside the held-out fold (all of them, up to
   ``SAMPLE``) are dealt by a hash of their text into ``PARTS`` parts, so copies meet in one
   and count once there, and each part makes lexicons of its
   own: the words, and first 4, 5 and 6 letters of words, that come far more often in its
   toxic texts than expected, one for each of ``PRECISE``. No two parts share a labelled text,
   and what a lexicon says of texts that it was learned from is left out below.
3. All voters vote on all texts; the patterns of votes are counted, alone and with the labels
   of the training fold. A generative label model explains those counts: a hidden class, and
   for each voter its rate in either class, fitted by expectation-maximisation in which
   labelled texts keep theirs with ``TRUST``, and all others together weigh as much as they do. Voters that agree beyond what the class explains
   are correlated; their evidence is divided by one plus the sum of their correlations.
4. A logistic regression on the lexicons' entries and the votes is trained on the model's
   posterior labels: of the labelled sample, and of up to ``TEXTS`` texts without regard to
   labels (those outside the held-out fold of least id hash). It scores every text.

Labels, language, source and id are never inputs of a score.

Defined cases: null and empty texts get the score of a text without any vote; a null id
counts as the empty text in the fold's rule, has no label and is not in the samples; several
labels of one id count as their largest; of several texts of one id in a sample the one of
least votes, or of least hash, counts (rows that repeat both each count in the lexicons); without labels of both classes only the voters of 1 vote, at fixed rates;
a score of exactly 0.5 predicts 1; repeated rows are scored each; very long texts are read
whole, one at a time; an empty table gives no rows; extra columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, table

#: Most labelled rows that the lexicons and the classifier are fitted on, and most texts that
#: the classifier is fitted on besides.
SAMPLE = 20_000
TEXTS = 20_000
#: Most features in the lexicons together; parts of the labelled rows; least share of toxic ones
#: among the texts that have a feature, for each of a part's lexicons.
LEXICON = 4_000
PARTS = 3
PRECISE = (0.9, 0.5)
LISTS = PARTS * len(PRECISE)
FOLDS = 5
TRUST = 0.97
#: Deviations above the expected count of toxic texts from which a feature is taken.
SURE = 3.5
INSULTS = {
    "en": frozenset(
        "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns dumb fool imbecile garbage vermin filth retard bastard jerk creep".split()
    ),
    "de": frozenset("trottel dummkopf abschaum wertlos ekelhaft versager drecksack arschloch".split()),
    "fr": frozenset("imbécile crétin débile ordure minable dégueulasse connard abruti".split()),
    "es": frozenset("idiota estúpido estúpida imbécil basura escoria payaso inútil asqueroso".split()),
}
PATTERNS = (*(f"insult_{k}" for k in INSULTS), "aimed", "hostile", "exclaims", "shouts")
VOTERS = LISTS + len(PATTERNS)

_WORDS = re.compile(r"[^\W\d_]+").findall
_AIMED = re.compile(r"\b(?:you|your|you're|du|ihr|tu|vous|eres)\b(?:\W+\w+){0,3}?\W+(?:" + "|".join(sorted(frozenset().union(*INSULTS.values()))) + r")\b").search
_HOSTILE = re.compile(r"\b(?:shut up|get lost|go to hell|hate you|nobody likes|drop dead|halt die klappe|ferme ta|cállate)\b").search


def features(words: set[str]) -> set[str]:
    out = set(words)
    for n in (4, 5, 6):
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def read(text: str, lexicon: dict[str, int], lists: list[int]) -> tuple[int, list[int]]:
    """Votes as a bit mask, and the lexicon entries in the text; lists: bit mask of the
    lexicons that have each entry."""
    low = text.lower()
    words = set(_WORDS(low))
    found = {i for w in words if (i := lexicon.get(w)) is not None}
    for n in (4, 5, 6):
        found.update(i for w in words if len(w) > n and (i := lexicon.get(w[:n] + "*")) is not None)
    votes = 0
    for i in found:
        votes |= lists[i]
    own = [not words.isdisjoint(bad) for bad in INSULTS.values()]
    own += [any(own) and _AIMED(low) is not None, _HOSTILE(low) is not None, "!!" in text, len(text) >= 20 and sum(map(str.isupper, text)) * 2 > len(text)]
    for k, says in enumerate(own):
        votes |= says << (LISTS + k)
    return votes, sorted(found)


def _fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training fold."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(_fold(F.col("doc_id")) != 0)
    return own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _lexicon(sample: DataFrame) -> tuple[list[str], list[int]]:
    """Features of the toxic texts among (part, text, toxic), the surest first, and bit masks
    of the lexicons that have each."""

    def run(batches):
        seen: dict[tuple[int, str], list[int]] = {}  # part and feature -> toxic texts, texts

        def flush():
            cols = zip(*seen.values(), strict=True) if seen else ((), ())
            parts, names = ([k[j] for k in seen] for j in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["part", "f", "a", "n"])

        for b in batches:
            for part, text, toxic in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                for f in features(set(_WORDS((text.as_py() or "").lower()))):
                    own = seen.setdefault((part, f), [0, 0])
                    own[0] += toxic
                    own[1] += 1
                if len(seen) > 50_000:
                    yield flush()
                    seen.clear()
        yield flush()

    rates = {r["part"]: r["a"] / r["n"] for r in sample.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("a")).collect()}
    rates = {k: v for k, v in rates.items() if 0 < v < 1}
    if not rates:
        return [], []
    counts = sample.select("part", "text", "toxic").mapInArrow(run, "part int, f string, a bigint, n bigint").groupBy("part", "f").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("part"))
    expected = F.col("n") * rate
    sure = ((F.col("a") - expected) / F.sqrt(expected + 0.5)).alias("z")
    tier = F.coalesce(*(F.when(F.col("a") >= F.col("n") * p, F.lit(k)) for k, p in enumerate(PRECISE)))
    best = counts.where(F.col("part").isin(*rates)).select((F.col("part") * len(PRECISE) + tier).alias("list"), "f", sure).where("list IS NOT NULL").where(F.col("z") > SURE).orderBy(F.col("z").desc(), "f", "list").limit(LEXICON)
    masks: dict[str, int] = {}
    for r in best.collect():
        masks[r["f"]] = masks.get(r["f"], 0) | 1 << r["list"]
    return list(masks), list(masks.values())


def label_model(masks: np.ndarray, counts: np.ndarray, given: np.ndarray, part: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Log-odds of each voter's two votes (voters x 2) and of the class. masks, counts:
    patterns of votes and their numbers; given: 1, 0, or -1 where there's no label; part: the
    part of the labelled rows that these texts are in, whose lexicons' votes are left out, or -1."""
    votes = (masks[:, None] >> np.arange(VOTERS)) & 1
    there = voters_there(part)
    trust = np.where(given == 1, TRUST, 1 - TRUST)
    known = given >= 0
    if not (known & (given == 1)).any():
        return np.column_stack([np.full(VOTERS, -0.1), np.r_[np.zeros(LISTS), np.full(len(INSULTS), 4.0), 2.0, 2.0, 0.0, 0.0]]), -3.0
    post = np.where(known, trust, 0.0)
    weight = counts * np.where(known, 1.0, 0.0)  # the first step sees labelled texts alone
    # after it, all texts without a label together weigh as much as all with one
    free = counts[~known].sum()
    share = min(1.0, counts[known].sum() / free) if free else 1.0
    for _ in range(rounds):
        one, zero = weight * post, weight * (1 - post)
        rates = np.array([(w @ (votes * there) + 0.5) / (w @ there + 1) for w in (one, zero)])
        prior = math.log((one.sum() + 1) / (zero.sum() + 1))
        odds = np.stack([np.log((1 - rates[0]) / (1 - rates[1])), np.log(rates[0] / rates[1])], axis=1)
        # correlation of voters within the classes, from what the rates leave over
        excess = np.zeros((VOTERS, VOTERS))
        for w, r in ((one, rates[0]), (zero, rates[1])):
            left = (votes - r) * there
            excess += (left * w[:, None]).T @ left
        scale = np.sqrt(np.maximum(np.diag(excess), 1e-9))
        rho = np.clip(excess / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(rho, 1)
        odds /= rho.sum(axis=1)[:, None]  # its own correlation is the one
        logit = evidence(votes, there, odds, prior)
        was, post = post, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        labelled = np.clip(logit + np.where(given == 1, 1, -1) * math.log(TRUST / (1 - TRUST)), -30, 30)
        post = np.where(known, 1 / (1 + np.exp(-labelled)), post)
        weight = counts * np.where(known, 1.0, share)
        if np.abs(post - was).max() < 1e-6:
            break
    return odds, prior


def voters_there(part: np.ndarray) -> np.ndarray:
    """Texts x voters: 0 where a lexicon was learned from the text."""
    return np.where(part[:, None] == np.r_[np.arange(LISTS) // len(PRECISE), np.full(len(PATTERNS), -2)], 0.0, 1.0)


def evidence(votes: np.ndarray, there: np.ndarray, odds: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of the class given the votes that are there."""
    return prior + (there * np.where(votes == 1, odds[:, 1], odds[:, 0])).sum(axis=1)


def _regression(rows: list[np.ndarray], target: np.ndarray, size: int, steps: int = 300, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary features (lists of columns)."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    w, bias = np.zeros(size), math.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    m = np.zeros(size + 1)
    v = np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(rows)), -30, 30)))
        miss = p - target
        g = np.append(np.bincount(col, miss[row], size) + ridge * w, miss.sum()) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def _least(ids: DataFrame, most: int) -> DataFrame:
    """Up to most rows of least id hash."""
    return ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the columns of keep)."""
    bounded_batches(docs.sparkSession)
    train = materialize(_labels(labels), "toxicity-labels")
    # the samples are bounded by SAMPLE and TEXTS rows of 12 bytes, so they may go to all executors
    ids = _least(train, SAMPLE)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    part = F.pmod(h, F.lit(PARTS)).cast("int")
    # one text of an id, one id of a text: SAMPLE rows at most, and no text is shuffled
    once = docs.select("doc_id", h.alias("_h")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("_h").alias("_h"))
    once = materialize(once.groupBy("_h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxicity-once")
    words, lists = _lexicon(docs.select("doc_id", h.alias("_h"), part.alias("part"), "text").join(F.broadcast(once), ["doc_id", "_h"]).select("part", "text", "toxic"))
    lexicon = {f: i for i, f in enumerate(words)}
    rows = docs.select("doc_id", F.col("text").alias("_text"), part.alias("_part"), *keep)
    names = ["doc_id", "_part", *keep, "votes", "found"]

    def run(batches):
        for b in batches:
            got = [read(t.as_py() or "", lexicon, lists) for t in b.column(1)]
            new = [pa.array([v for v, _ in got], pa.int32()), pa.array([f for _, f in got], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in range(2, b.num_columns)), *new], names=names)

    schema = T.StructType([rows.schema["doc_id"], rows.schema["_part"], *(rows.schema[k] for k in keep), T.StructField("votes", T.IntegerType()), T.StructField("found", T.ArrayType(T.IntegerType()))])
    voted = materialize(rows.mapInArrow(run, schema), "toxicity-votes")
    # 2 ** VOTERS patterns at most, with one of three labels, in one of PARTS parts or none
    labelled = train.join(F.broadcast(ids.select("doc_id", F.lit(True).alias("_in"))), "doc_id", "left")
    own = F.when(F.col("_in"), F.col("_part")).otherwise(F.lit(-1))
    patterns = voted.join(labelled, "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("given"), own.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns.sort(key=lambda r: (r["votes"], r["given"], r["part"]))
    odds, prior = label_model(*np.array([(r["votes"], r["n"], r["given"], r["part"]) for r in patterns], np.int64).reshape(-1, 4).T)
    plain = voted.where(F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 0)).select("doc_id").distinct()
    plain = _least(plain, TEXTS).join(ids, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("toxic"))
    # one text of an id counts, so what comes to the driver is bounded by the samples
    one = voted.join(F.broadcast(ids.unionByName(plain)), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("votes", "found", "_part")).alias("r"))
    taught = one.select("r.votes", "r.found", "toxic", F.when(F.col("toxic") < 0, -1).otherwise(F.col("r._part")).alias("part")).collect()
    taught.sort(key=lambda r: (r["votes"], r["toxic"], r["part"], r["found"]))  # whatever order they came in
    size = len(words) + VOTERS
    given = np.array([r["toxic"] for r in taught], np.int64)
    if (given == 1).any() and (given == 0).any():
        votes = (np.array([r["votes"] for r in taught])[:, None] >> np.arange(VOTERS)) & 1
        there = voters_there(np.array([r["part"] for r in taught], np.int64))
        logit = evidence(votes, there, odds, prior) + np.select([given == 1, given == 0], [1, -1], 0) * math.log(TRUST / (1 - TRUST))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # what a lexicon says of texts that it was learned from is left out here, too
        own = {k: ((1 << len(PRECISE)) - 1) << (k * len(PRECISE)) for k in range(PARTS)} | {-1: 0}
        entries = [np.array([i for i in r["found"] if lists[i] & ~own[r["part"]]], np.int64) for r in taught]
        weights, bias = _regression([np.r_[e, len(words) + np.flatnonzero(v * t)] for e, v, t in zip(entries, votes, there, strict=True)], post, size)
    else:
        weights, bias = np.r_[np.zeros(len(words)), odds[:, 1] - odds[:, 0]], float(prior + odds[:, 0].sum())

    def weigh(batches):
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            votes = b.column(at["votes"]).to_numpy()
            total = bias + (((votes[:, None] >> np.arange(VOTERS)) & 1) * weights[len(words) :]).sum(axis=1)
            found = b.column(at["found"])
            n = np.diff(found.offsets.to_numpy())
            total = total + np.bincount(np.repeat(np.arange(len(n)), n), weights[found.flatten().to_numpy()], len(n)) if len(n) else total
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(at[k]) for k in ("doc_id", *keep)] + [pa.array(p, pa.float64())], names=["doc_id", *keep, "score"])

    scored = voted.mapInArrow(weigh, T.StructType([voted.schema["doc_id"], *(voted.schema[k] for k in keep), T.StructField("score", T.DoubleType())]))
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
