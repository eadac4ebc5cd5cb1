"""Operator 3: document fingerprints by spot signatures.

A spot is an occurrence of a very common word; its signature is that word with the next
``CHAIN`` content words (words that aren't common). A text's fingerprint is the set of its
signatures, each cut to 32 bits of its md5, sorted and written as hex. Likeness of two
fingerprints is the Jaccard coefficient of the sets.

The i-th word being the k-th common one, i - k content words stand before it, so chains
are read off two index arrays without walking the text.

Defined cases: null text counts as empty; a text without a spot takes every word as one;
a text without words has the empty fingerprint; two empty fingerprints are alike (1.0),
an empty and another are not (0.0); null ids (and -2**63, which stands for them) come first
in order; rows of one id follow each other by a hash of their texts; repeated rows each
count, the one after being the next; a single row is its own next; very long texts are read
whole, in one row's arrays; an empty table gives no rows; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TEXT_WORD, let, row_count, table

CHAIN = 2
#: Very common words of English, German, French and Spanish.
COMMON = tuple(sorted(set(
    "the of and to in is was it that for on with as at by this are be he an or not from"
    " der die das und ist ein eine zu den von mit auf für im nicht dem es sich"
    " le la les des et un une du que est dans pour sur qui au ne pas"
    " el los las en y por con para se no su lo una".split()
)))


#: Rows of a range of ids, most ranges, most cuts between quantiles of the ids.
RANGE, RANGES, CUTS = 1000, 1 << 20, 4096


def spot_set(text: Column) -> Column:
    """Sorted distinct signatures of a text (array of 8 hex digits each)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TEXT_WORD), F.lit(0))

    def chains(w: Column) -> Column:
        here = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        spots = F.filter(here, lambda i: F.get(w, i).isin(*COMMON))
        content = F.filter(w, lambda x: ~x.isin(*COMMON))

        def joined(c: Column, s: Column) -> Column:
            return F.transform(s, lambda i, k: F.concat_ws(" ", F.get(w, i), *(F.get(c, i - k + j) for j in range(CHAIN))))

        plain = F.transform(here, lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(CHAIN + 1))))
        spotted = let(F.struct(content.alias("c"), spots.alias("s")), lambda x: F.when(F.size(x["s"]) > 0, joined(x["c"], x["s"])).otherwise(plain))
        return F.transform(spotted, lambda x: F.substring(F.md5(x.cast("binary")), 1, 8))

    return F.array_sort(F.array_distinct(let(words, chains)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both.cast("double") / either).otherwise(F.lit(1.0))


def length_part(size: Column, threshold: float) -> Column:
    """Number of a set's partition by length: sets whose lengths can be within threshold of
    each other are in the same or in neighbouring partitions."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(1.0 / threshold)))).otherwise(F.lit(-2)).cast("int")


def similar(queries: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """query_id, doc_id, likeness of the pairs at threshold or more; both tables have
    doc_id and text, and queries is the smaller, stated set.

    Sets are partitioned by length, and within near partitions only pairs that share a
    signature of their prefixes are compared: two sets at the threshold agree in one of
    the first n - ceil(threshold n) + 1 of each. Lengths too far apart are pruned before
    the exact coefficient. A set without signatures is like another such set only.
    """
    made = lambda d: d.select("doc_id", spot_set(F.col("text")).alias("_s")).withColumn("_n", F.size("_s"))
    first = F.col("_n") - F.ceil(F.lit(threshold) * F.col("_n")).cast("int") + 1
    prefix = F.explode(F.when(F.col("_n") > 0, F.slice("_s", F.lit(1), first)).otherwise(F.array(F.lit(""))))
    part = length_part(F.col("_n"), threshold)
    near = F.explode(F.array(part - 1, part, part + 1))
    left = made(queries).select(F.col("doc_id").alias("query_id"), F.col("_s").alias("_q"), F.col("_n").alias("_m"), near.alias("_p"), "_n", "_s")
    left = left.select("query_id", "_q", "_m", "_p", prefix.alias("_k"))
    right = made(docs).select("doc_id", "_s", "_n", part.alias("_p"), prefix.alias("_k"))
    fits = F.least("_n", "_m") >= F.lit(threshold) * F.greatest("_n", "_m")
    pairs = left.join(right, ["_p", "_k"]).where(fits).select("query_id", "doc_id", likeness(F.col("_q"), F.col("_s")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold).distinct()


def with_next(docs: DataFrame, value: str, derived: dict[str, Column], key: str = "doc_id") -> DataFrame:
    """docs with the derived columns, and next_<name> of value and each of these: that
    of the next row by ascending key (rows of one key by the hash of value, then value), the
    last row having the first as its next. Only value travels; what is derived from it is
    computed once, where the row arrives.

    Rows go to ranges of about ``RANGE`` rows, or more if there were over ``RANGES`` of them:
    cuts between quantiles of the keys, cut evenly again, and a range by hash for a key that
    many rows have. The first row of a range also goes, as a ghost, to the range before, so
    each range finds the next row of all its rows without another pass.
    """
    at = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    places = docs.select(at.alias("_key"), F.xxhash64(value).alias("_h"))
    n = row_count(docs)
    if n == 0:
        return docs.withColumns(derived).withColumns({f"next_{c}": F.col(c) for c in (value, *derived)})
    per = max(RANGE, -(-n // RANGES))
    parts = max(1, min(CUTS, n // per))
    found = places.agg(F.percentile_approx("_key", [i / parts for i in range(parts)], 10000).alias("b"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
    # at most CUTS keys have so many rows
    crowds = {r[0]: r[1] for r in places.groupBy("_key").count().where(F.col("count") > max(4 * per, n // CUTS)).collect()}
    bounds = sorted({found["lo"], *(b for b in found["b"] if found["lo"] <= b <= found["hi"]), *crowds, *(k + 1 for k in crowds if k < found["hi"])})
    many = len(bounds)
    array = F.array(*(F.lit(b).cast("bigint") for b in bounds))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.get(array, mid) <= s["k"]
        inside = s["lo"] < s["hi"]
        lo = F.when(inside & up, mid + 1).otherwise(s["lo"])
        hi = F.when(inside & ~up, mid).otherwise(s["hi"])
        return F.struct(s["k"].alias("k"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def placed(rows: DataFrame) -> DataFrame:
        """rows (_key, _h, ..) with their range (_p, _q)."""
        start = F.struct(F.col("_key").alias("k"), F.lit(0).alias("lo"), F.lit(many).alias("hi"))
        steps = F.sequence(F.lit(1), F.lit(many.bit_length() + 1))
        rows = rows.withColumn("_p", F.aggregate(steps, start, halve, lambda s: s["lo"] - 1))
        finer = n // (parts * per)
        q = F.lit(0)
        if finer > 1:
            low, high = F.get(array, F.col("_p")).cast("double"), F.coalesce(F.get(array, F.col("_p") + 1).cast("double"), F.lit(float(found["hi"]) + 1.0))
            q = F.floor((F.col("_key").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * finer)
        if crowds:
            # a crowd's range by hash; the number of them is known by the range
            pieces = F.element_at(F.create_map(*(F.lit(x) for k, c in crowds.items() for x in (k, -(-c // per)))), F.col("_key"))
            q = F.when(F.col("_key").isin(*crowds), F.floor((F.col("_h").cast("double") + 2.0**63) / 2.0**64 * pieces)).otherwise(q)
        return rows.withColumn("_q", q.cast("int"))

    first = placed(places).groupBy("_p", "_q").agg(F.min(F.struct("_key", "_h")).alias("_first"))
    # RANGES rows at most, by far
    line = W.orderBy("_p", "_q")
    everyone = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    here = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"))
    first = first.withColumn("_before", F.coalesce(F.lag(here).over(line), F.max(here).over(everyone)))
    rows = placed(docs.withColumns({"_key": at, "_h": F.xxhash64(value)})).join(F.broadcast(first), ["_p", "_q"])
    own = F.struct(F.col("_p").alias("p"), F.col("_q").alias("q"), F.lit(0).alias("ghost"))
    other = F.struct(F.col("_before.p").alias("p"), F.col("_before.q").alias("q"), F.lit(1).alias("ghost"))
    leads = (F.col("_key") == F.col("_first._key")) & (F.col("_h") == F.col("_first._h"))
    rows = rows.withColumn("_to", F.explode(F.when(leads, F.array(own, other)).otherwise(F.array(own))))
    rows = rows.select(*docs.columns, "_key", "_h", "_to.*")
    # ghosts come last: they are above the range's rows, or close the circle
    order = W.partitionBy("p", "q").orderBy("ghost", "_key", "_h", value)
    rows = rows.withColumn(f"next_{value}", F.lead(value).over(order)).withColumns(derived)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in derived})
    return rows.where("ghost = 0").drop("_key", "_h", "p", "q", "ghost")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first of following."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs.select("doc_id", text.alias("text")), "text", {"_set": spot_set(F.col("text"))})
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "_set", "next__set", edited(F.col("text"), F.col("next_text")).alias("_edited"))
    rows = rows.withColumn("_edited_set", spot_set(F.col("_edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("_set", "").alias("fingerprint"), F.array_join("_edited_set", "").alias("edited_fingerprint"),
        likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"), likeness(F.col("_set"), F.col("next__set")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


_LIST = ", ".join(f"'{w}'" for w in COMMON)


def _sql_set(text: str) -> str:
    """DuckDB expression for spot_set over a VARCHAR expression, inside a lateral chain."""
    word = TEXT_WORD
    w = f"regexp_extract_all(lower({text}), '{word}')"
    return f"""list_sort(list_distinct(list_transform((
      SELECT CASE WHEN len(s) > 0
        THEN list_transform(range(1, len(s) + 1), lambda k: concat_ws(' ', w[s[k]], c[s[k] - k + 1], c[s[k] - k + 2]))
        ELSE list_transform(range(1, len(w) + 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END
      FROM (SELECT w, list_filter(range(1, len(w) + 1), lambda i: list_contains(cw, w[i])) AS s, list_filter(w, lambda x: NOT list_contains(cw, x)) AS c
            FROM (SELECT {w} AS w, [{_LIST}] AS cw))), lambda x: substr(md5(x), 1, 8))))"""


def _sql_like(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST), first_value(t) OVER (ORDER BY doc_id NULLS FIRST)) AS nx FROM d),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM n),
s AS (SELECT *, {_sql_set('t')} AS a, {_sql_set('ed')} AS b, {_sql_set('nx')} AS c FROM e)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a, '') AS fingerprint,
       array_to_string(b, '') AS edited_fingerprint, {_sql_like('a', 'b')} AS near_edited, {_sql_like('a', 'c')} AS near_next
FROM s
"""
