"""Operator 8: URL filters by host word segmentation and naive Bayes.

Rules come first: a rule fits its host and all subdomains if the path starts with the
rule's; the longest one decides. Other pages are judged by the words in their URL:

1. Host and path are cut into runs of letters. Each distinct run is split into words by a
   unigram Viterbi over its substrings that are known words. Word counts come from the
   pages' text and from the other runs; a run's own count as a run is no evidence that it
   is one word. The lattice of a run is gathered by joins on the run's number, so no word
   list is broadcast and no run travels with its substrings.
2. A URL is taken for unwanted if a word of it is a seed word of unwanted sites, or if its
   host speaks of such things: one in ``SPEAKING`` or more of the host's pages has two seed
   words or more, and one word in ``RARE`` or more, in its visible text. A multinomial naive Bayes is trained on all URLs with these
   two classes and scores each URL's segmented words, so names that keep company with the
   seeds, in URLs or on pages, count as well.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and
has no words, so the class prior decides; null html has no words; several pages of one URL
get one verdict; repeated rows each give a row; a score of exactly 0 allows; of equal splits
the one with the shorter last word; runs of any length are split, into words of ``LONGEST``
letters or fewer (longer words of the text are not counted); an empty table gives no rows;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, let, lower_ascii, materialize, table

#: The contract's rules (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEEDS = tuple("casino poker betting bets bet slots jackpot gamble pills pharmacy viagra cialis porn xxx sex escort nude adult ads adserver popup malware phishing warez torrent crack hack payday".split())
#: Count that a seed word has beyond what the pages say.
SEED_COUNT = 100
LONGEST = 20
#: A page speaks of unwanted things from two seed words on, if they are one word in so many.
RARE = 100
SPEAKING = 5
_LETTERS = r"\p{L}+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    body = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(body, pattern, 1)), F.regexp_extract(body, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def segment(lattice: list[tuple[int, int, float]], size: int, total: float) -> list[tuple[int, int]]:
    """Spans of the likeliest split of a run of `size` letters; lattice: (start, length,
    count) of known words. An unknown word of n letters has probability 10 / (total 10^n)."""
    known = {(s, n): c for s, n, c in lattice if c > 0}
    best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
    base = math.log(max(total, 1.0))
    for end in range(1, size + 1):
        for n in range(1, min(LONGEST, end) + 1):
            c = known.get((end - n, n))
            p = math.log(c) - base if c else math.log(10.0) - base - n * math.log(10.0)
            if best[end - n] + p > best[end]:
                best[end], back[end] = best[end - n] + p, n
    spans, end = [], size
    while end:
        spans.append((end - back[end], end))
        end -= back[end]
    return spans[::-1]


def _segments(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(part, tokens) of each distinct part (id, part); words: (word, text, url) counts."""
    total = float(words.agg(F.coalesce(F.sum(F.col("text") + F.col("url")), F.lit(0))).first()[0])
    n = F.length("part")

    def at(s: Column) -> Column:
        window = F.substring(F.col("part"), s, F.lit(LONGEST))
        return let(window, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda l: F.struct((s - 1).alias("s"), l.alias("n"), F.substring(w, F.lit(1), l).alias("word"))))

    pieces = parts.select("id", n.alias("_n"), F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), at))).alias("x")).select("id", "_n", "x.*")
    count = F.when(F.col("n") == F.col("_n"), F.col("text")).otherwise(F.col("text") + F.col("url")).cast("double")
    known = pieces.join(words, "word").select("id", F.struct("s", "n", count.alias("c")).alias("x"))
    lattices = known.groupBy("id").agg(F.collect_list("x").alias("x"))

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            out = [[p[a:z] for a, z in segment([(x["s"], x["n"], x["c"]) for x in lat or []], len(p), total)] for p, lat in zip(names, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "tokens"])

    return parts.join(lattices, "id", "left").select("part", "x").mapInArrow(run, "part string, tokens array<string>")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_LETTERS), F.lit(0))


def judge(pages: DataFrame, rules=RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of unwanted; of all pages)."""
    bounded_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    visible = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    own = pages.select("page_id", host.alias("host"), path.alias("path"), _words(visible).alias("_words"))
    # out of a generator, so that the text's words are cut once
    said = F.explode(F.array(F.struct(F.size("_words").alias("n"), F.size(F.filter("_words", lambda w: w.isin(*seeds))).alias("k")))).alias("_s")
    spoken = (F.col("_s.k") >= 2) & (F.col("_s.k") * RARE >= F.col("_s.n"))
    own = own.select("page_id", "host", "path", said).select("page_id", "host", "path", spoken.alias("_spoken"))
    own = materialize(own.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    share = F.count_if("_spoken") * SPEAKING >= F.count(F.lit(1))
    hosts = materialize(own.groupBy("host").agg(share.alias("spoken")), "url-hosts")
    urls = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(hosts, "host")
    runs = F.explode(F.regexp_extract_all(F.lower(F.concat_ws("/", "host", "path")), F.lit(_LETTERS), F.lit(0)))
    runs = materialize(urls.select("host", "path", "n", "spoken", runs.alias("part")), "url-parts")
    parts = materialize(runs.groupBy("part").agg(F.sum("n").alias("url")).withColumn("id", F.monotonically_increasing_id()), "url-runs")
    text = pages.select(F.explode(_words(visible)).alias("word")).where(F.length("word") <= LONGEST)
    counted = text.groupBy("word").agg(F.count(F.lit(1)).alias("text")).select("word", "text", F.lit(0).cast("bigint").alias("url"))
    given = pages.sparkSession.createDataFrame([(w, SEED_COUNT, 0) for w in seeds], "word string, text bigint, url bigint")
    seen = parts.select(F.col("part").alias("word"), F.lit(0).cast("bigint").alias("text"), "url")
    words = counted.unionByName(given).unionByName(seen).groupBy("word").agg(F.sum("text").alias("text"), F.sum("url").alias("url"))
    words = materialize(words, "url-words")
    tokens = _segments(parts.select("id", "part"), words)
    split = materialize(runs.join(tokens, "part").select("host", "path", "n", "spoken", F.explode("tokens").alias("token")), "url-tokens")
    bad = F.max(F.col("token").isin(*seeds) | F.col("spoken"))
    marked = materialize(split.groupBy("host", "path").agg(bad.alias("bad"), F.first("n").alias("n")), "url-classes")
    classed = split.join(marked.select("host", "path", "bad"), ["host", "path"])
    n, b = F.col("n"), F.col("bad")
    weights = classed.groupBy("token").agg(F.sum(F.when(b, n).otherwise(0)).alias("cb"), F.sum(F.when(b, 0).otherwise(n)).alias("cg"))
    weights = materialize(weights, "url-weights")
    tb, tg, v = (float(x or 0) for x in weights.agg(F.sum("cb"), F.sum("cg"), F.count(F.lit(1))).first())
    nb = float(marked.where("bad").agg(F.sum("n")).first()[0] or 0)
    ng = float(own.agg(F.count(F.lit(1))).first()[0]) - nb
    prior = math.log((nb + 1) / (ng + 1))
    weight = F.log((F.col("cb") + 1) / (tb + v + 1)) - F.log((F.col("cg") + 1) / (tg + v + 1))
    scores = split.join(weights, "token").groupBy("host", "path").agg(F.sum(weight).alias("_sum"))
    joined = own.join(scores, ["host", "path"], "left").withColumn("score", F.round(F.coalesce("_sum", F.lit(0.0)) + prior, 9))
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
