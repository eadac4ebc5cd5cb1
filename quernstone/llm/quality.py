"""Operator 9: quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics: mean word length (shrunk towards five
characters by fifty words, as short texts scatter), and the square roots of the shares of
symbols and of repeated words and lines. The vectors are rounded to a grid and counted by
(language, source, cell). On those cells a minimum-covariance-determinant estimate is made
for each group:

* Three deterministic starts: the coordinatewise medians with fixed scales, the medians with
  the quartiles' distances as scales, and the mean and covariance of all rows.
* Concentration steps from each: the rows whose Mahalanobis distance is at most the
  ``SUBSET`` quantile of their group's distances (ties included) give the next estimate. A
  step never raises the determinant; steps end when no estimate changes (or after ``STEPS``).
* Of the starts' estimates the one of least determinant is the group's (the first of equals).

The quantile is found without sorting a group: distances are counted by bucket, and only the
cells of the bucket where it falls are ranked. Rows whose distance from their group's
estimate is over ``CUT`` are rejected. Cell counts and sums are whole numbers, so results
don't depend on the order of rows. Groups of fewer than ``LEAST`` texts that pass the base
rules take the estimate of their language over all sources, or else that of all texts.

Defined cases: null text has no words and fails the base rules, as does empty text; null
language or source form groups of their own; fewer than ``LEAST`` texts in all reject
nothing, and neither does a group of fewer without ``pooled``; repeated rows count each; very
long texts are counted whole, in one row's arrays; an empty table gives no rows; extra
columns, whatever their names, are not read, and kept_documents gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, let, materialize, table

WINDOW = 8
SUBSET = 0.75
STEPS = 12
STARTS = 3
LEAST = 20
#: chi-square with 3 degrees of freedom: its 0.75 quantile is 4.108, and 0.466 of the
#: second moment lies below; the covariance of the subset is raised accordingly.
RAISE = 1.61
#: Squared distance beyond which a text is rejected; chi-square passes it once in 10**12.
CUT = 60.0
#: Least variance of a coordinate, in squared grid units: a statistic that is zero for
#: most texts must not reject the first text that has some of it.
RIDGE = (16.0, 16.0, 64.0)
_X = ("_x0", "_x1", "_x2")


def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash comes twice or more, from the hashes by start."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def found(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            kept = F.filter(s, lambda x, i: same(i, i + 1) | ((i > 0) & same(i, i - 1)))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        return let(let(pairs, twice), covered)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found(h)))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The base counts of each text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, body.alias("_text"))

    def counts(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
        letters = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w))
        return F.struct(n.cast("bigint").alias("n"), letters.alias("c"), _repeated_words(hashes).cast("bigint").alias("r"))

    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(SPACE_WORD))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    words = F.regexp_extract_all("_text", F.lit(SPACE_WORD), F.lit(0))
    symbols = F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint")
    made = F.struct(let(words, counts).alias("w"), symbols.alias("n_symbols"), repeats.cast("bigint").alias("n_dup_lines"))
    # out of a generator, so that filters on the counts don't go below and count again
    rows = rows.select(*keep, F.explode(F.array(made)).alias("_s"))
    n, r = F.col("_s.w.n"), F.col("_s.w.r")
    return rows.select(
        *keep, n.alias("n_words"), F.col("_s.w.c").alias("word_chars"), "_s.n_symbols", "_s.n_dup_lines", r.alias("n_repeat_words"),
        ((n < 20) | (r * 100 > n * 30)).alias("base_failed"),
    )


def _vector() -> list[Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: F.floor(F.sqrt(a.cast("double") / F.greatest(b, F.lit(1)).cast("double")) * 100).cast("bigint")
    return [F.floor((c + 250).cast("double") * 100 / (n + 50).cast("double")).cast("bigint"), share(F.col("n_symbols"), c), share(F.col("n_repeat_words") + F.col("n_dup_lines"), n)]


def _determinant(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def _distance(m: list[Column], s: list[Column]) -> Column:
    """Squared Mahalanobis distance of _X; s: upper triangle of the covariance by rows."""
    a, b, c, d, e, f = s
    det = _determinant(*s)
    i = (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)
    x, y, z = (F.col(v).cast("double") - u for v, u in zip(_X, m, strict=True))
    return (x * x * i[0] + y * y * i[3] + z * z * i[5] + (x * y * i[1] + x * z * i[2] + y * z * i[4]) * 2) / det


_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
_MEANS = tuple(f"_m{i}" for i in range(3))
_COVS = tuple(f"_c{i}{j}" for i, j in _PAIRS)


def _moments(cells: DataFrame, group: tuple[str, ...], subset: bool = True) -> DataFrame:
    """Mean and covariance (raised, if of a subset) of each group's weighted cells."""
    w = F.col("_w")
    sums = [F.sum(w * F.col(x)).alias(f"_s{i}") for i, x in enumerate(_X)]
    sums += [F.sum(w * F.col(_X[i]) * F.col(_X[j])).alias(f"_q{i}{j}") for i, j in _PAIRS]
    g = cells.groupBy(*group).agg(F.sum(w).alias("_n"), *sums)
    n, by = F.col("_n").cast("double"), RAISE if subset else 1.0
    mean = [F.col(f"_s{i}").cast("double") / n for i in range(3)]
    cov = [(F.col(f"_q{i}{j}").cast("double") / n - mean[i] * mean[j]) * by + (RIDGE[i] if i == j else 0.0) for i, j in _PAIRS]
    return g.select(*group, *(c.alias(k) for c, k in zip(mean, _MEANS, strict=True)), *(c.alias(k) for c, k in zip(cov, _COVS, strict=True)))


def _starts(cells: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, _start, means, covariances) of the three starts. A coordinate's quartiles are
    read off its counts by value, which the grid bounds."""

    def quartiles(x: str) -> DataFrame:
        k = x[-1]
        upto = F.sum("_w").over(W.partitionBy(*group).orderBy(x))
        counted = cells.groupBy(*group, x).agg(F.sum("_w").alias("_w"), F.first("_all").alias("_all")).withColumn("_upto", upto)
        at = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col(x))).cast("double")
        return counted.groupBy(*group).agg(at(2).alias(f"_m{k}"), (at(3) - at(1)).alias(f"_r{k}"))

    table_ = quartiles(_X[0])
    for x in _X[1:]:
        table_ = table_.join(quartiles(x), list(group))
    scales = (lambda i: F.lit(RIDGE[i] * 100), lambda i: F.col(f"_r{i}") * F.col(f"_r{i}") + RIDGE[i])
    named = lambda k, scale: table_.select(*group, F.lit(k).alias("_start"), *_MEANS, *((scale(i) if i == j else F.lit(0.0)).alias(c) for c, (i, j) in zip(_COVS, _PAIRS, strict=True)))
    own = _moments(cells, group, subset=False)
    return named(0, scales[0]).unionByName(named(1, scales[1])).unionByName(own.withColumn("_start", F.lit(2)))


def _spread(rows: DataFrame, params: DataFrame, group: tuple[str, ...], how: str = "left") -> DataFrame:
    d = _distance([F.col(m) for m in _MEANS], [F.col(c) for c in _COVS])
    return rows.join(params, list(group), how).withColumn("_d", d).drop(*_MEANS, *_COVS)


def _thresholds(spread: DataFrame, key: list[str]) -> DataFrame:
    """(key, _t): the least distance that the SUBSET share of a group's rows doesn't exceed."""
    bucket = F.floor(F.log2(F.greatest(F.col("_d"), F.lit(1e-9))) * 16).cast("int").alias("_b")
    counts = spread.groupBy(*key, bucket).agg(F.sum("_w").alias("_w"), F.first("_all").alias("_all"))
    upto = F.sum("_w").over(W.partitionBy(*key).orderBy("_b"))
    enough = F.ceil(F.col("_all") * SUBSET)
    falls = counts.withColumn("_upto", upto).where(F.col("_upto") >= enough).groupBy(*key).agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_w")).alias("_before"))).alias("_f"))
    falls = falls.select(*key, F.col("_f._b").alias("_b"), F.col("_f._before").alias("_before"))
    inside = spread.withColumn("_b", bucket).join(falls, [*key, "_b"]).groupBy(*key, "_d").agg(F.sum("_w").alias("_w"), F.first("_all").alias("_all"), F.first("_before").alias("_before"))
    place = F.col("_before") + F.sum("_w").over(W.partitionBy(*key).orderBy("_d"))
    return inside.withColumn("_upto", place).where(F.col("_upto") >= enough).groupBy(*key).agg(F.min("_d").alias("_t"))


def mcd(cells: DataFrame, group: tuple[str, ...], steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant means and covariances of each group of cells
    (group, _x0 .. _x2, _w); groups of fewer than LEAST rows are left out."""
    totals = cells.groupBy(*group).agg(F.sum("_w").alias("_all")).where(F.col("_all") >= LEAST)
    cells = materialize(cells.join(materialize(totals, "quality-totals"), list(group)), "quality-large")
    key = [*group, "_start"]
    now = materialize(_starts(cells, group), "quality-starts")
    done = None
    for _ in range(steps):
        spread = _spread(cells, now, group, "inner")
        subset = spread.join(_thresholds(spread, key), key).where(F.col("_d") <= F.col("_t"))
        after = materialize(_moments(subset, tuple(key)), "quality-step")
        same = F.lit(True)
        for c in (*_MEANS, *_COVS):
            same = same & (F.col(c) == F.col(f"{c}_was"))
        was = now.select(*key, *(F.col(c).alias(f"{c}_was") for c in (*_MEANS, *_COVS)))
        marked = materialize(after.join(was, key).select(*after.columns, same.alias("_same")), "quality-marked")
        settled = marked.where("_same").drop("_same")
        done = settled if done is None else done.unionByName(settled)
        now = marked.where("NOT _same").drop("_same")
        if now.isEmpty():
            break
    found = now if done is None else done.unionByName(now)
    a, b, c, d, e, f = (F.col(x) for x in _COVS)
    least = F.struct(_determinant(a, b, c, d, e, f).alias("det"), F.col("_start"))
    best = found.groupBy(*group).agg(F.min_by(F.struct(*_MEANS, *_COVS), least).alias("_p"))
    return best.select(*group, "_p.*")


_GROUP = ("_lang", "_source")


def _vectors(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    name = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    own = docs.select("doc_id", "text", name("lang").alias("_lang"), name("source").alias("_source"), *keep)
    return statistics(own, ("doc_id", *_GROUP, *keep)).withColumns(dict(zip(_X, _vector(), strict=True)))


_LEVEL = ("_level", *_GROUP)


def _estimates(rows: DataFrame, pooled: bool = True) -> DataFrame:
    """Means and covariances for each group (language, source) that has any. All levels, the
    groups and what small ones are pooled to, are estimated in one go."""
    # texts that the base rules reject are no part of what a group's good texts look like
    good = rows.where(~F.col("base_failed"))
    cells = materialize(good.groupBy(*_GROUP, *_X).agg(F.count(F.lit(1)).alias("_w")), "quality-cells")
    totals = materialize(cells.groupBy(*_GROUP).agg(F.sum("_w").alias("_n")), "quality-groups")
    levels = cells.select(F.lit(0).alias("_level"), *_GROUP, *_X, "_w")
    small = totals.where(F.col("_n") < LEAST)
    if pooled and not small.isEmpty():
        weight = F.sum("_w").alias("_w")
        mates = cells.join(small.select("_lang").distinct(), "_lang", "left_semi").groupBy("_lang", *_X).agg(weight)
        levels = levels.unionByName(mates.select(F.lit(1).alias("_level"), "_lang", F.lit("").alias("_source"), *_X, "_w"))
        few = totals.groupBy("_lang").agg(F.sum("_n").alias("_n")).where(F.col("_n") < LEAST)
        if not few.isEmpty():
            every = cells.groupBy(*_X).agg(weight)
            levels = levels.unionByName(every.select(F.lit(2).alias("_level"), F.lit("").alias("_lang"), F.lit("").alias("_source"), *_X, "_w"))
    found = materialize(mcd(levels, _LEVEL), "quality-mcd")
    at = lambda k, *by: found.where(F.col("_level") == k).drop("_level", *(g for g in _GROUP if g not in by))
    own = at(0, *_GROUP)
    if not pooled:
        return own
    rest = small.select(*_GROUP)
    by_lang = rest.join(at(1, "_lang"), "_lang")
    rest = rest.join(by_lang.select(*_GROUP), list(_GROUP), "left_anti")
    return materialize(own.unionByName(by_lang).unionByName(rest.crossJoin(F.broadcast(at(2)))), "quality-estimates")


def _verdicts(rows: DataFrame, params: DataFrame) -> DataFrame:
    far = F.coalesce(F.col("_d") > CUT, F.lit(False))
    return _spread(rows, params, _GROUP).withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame, pooled: bool = True) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    rows = materialize(_vectors(docs), "quality")
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return _verdicts(rows, _estimates(rows, pooled)).select("doc_id", *base, "kept")


def kept_documents(docs: DataFrame, pooled: bool = True) -> DataFrame:
    """The rows of docs that pass, with their columns. Counts are made twice, once for the
    estimates and once beside the texts, so that texts are neither stored nor shuffled."""
    names = docs.columns
    params = _estimates(_vectors(docs), pooled)
    packed = docs.select("doc_id", "text", "lang", "source", F.struct(*names).alias("_row"))
    return _verdicts(_vectors(packed, keep=("_row",)), params).where("kept").select(*(F.col("_row").getField(n).alias(n) for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The whole of query() in SQL: base counts, cells, medians, steps, verdicts."""
    m = [f"m{i}" for i in range(3)]
    c = {p: f"c{p[0]}{p[1]}" for p in _PAIRS}
    a, b, c_, d, e, f = (c[p] for p in _PAIRS)
    det = f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {c_} * {e}) + {c_} * ({b} * {e} - {c_} * {d}))"
    i = [f"({d} * {f} - {e} * {e})", f"({c_} * {e} - {b} * {f})", f"({b} * {e} - {c_} * {d})", f"({a} * {f} - {c_} * {c_})", f"({b} * {c_} - {a} * {e})", f"({a} * {d} - {b} * {b})"]
    x, y, z = (f"(x{k}::DOUBLE - {m[k]})" for k in range(3))
    dist = f"({x} * {x} * {i[0]} + {y} * {y} * {i[3]} + {z} * {z} * {i[5]} + ({x} * {y} * {i[1]} + {x} * {z} * {i[2]} + {y} * {z} * {i[4]}) * 2) / {det}"
    ctes = [
        f"""w AS (SELECT row_number() OVER () AS n, doc_id, coalesce('+' || lang, '-') AS l, coalesce('+' || source, '-') AS s, coalesce(text, '') AS t FROM documents)""",
        f"""ws AS (SELECT n, regexp_extract_all(t, '{SPACE_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) AS ls FROM w)""",
        f"""win AS (SELECT n, k, md5(array_to_string(ws[k:k + {WINDOW - 1}], ' ')) AS h FROM (SELECT n, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS k FROM ws))""",
        """twice AS (SELECT n, k FROM win QUALIFY count(*) OVER (PARTITION BY n, h) > 1)""",
        f"""rep AS (SELECT n, sum(least({WINDOW}, k - p))::BIGINT AS r FROM (SELECT n, k, coalesce(lag(k) OVER (PARTITION BY n ORDER BY k), k - {WINDOW}) AS p FROM twice) GROUP BY n)""",
        """base AS (SELECT w.n, doc_id, l, s, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
          len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM w JOIN ws USING (n) LEFT JOIN rep USING (n))""",
        """vec AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, floor((word_chars + 250)::DOUBLE * 100 / (n_words + 50)::DOUBLE)::BIGINT AS x0,
          floor(sqrt(n_symbols::DOUBLE / greatest(word_chars, 1)::DOUBLE) * 100)::BIGINT AS x1, floor(sqrt((n_repeat_words + n_dup_lines)::DOUBLE / greatest(n_words, 1)::DOUBLE) * 100)::BIGINT AS x2 FROM base)""",
        """c0 AS (SELECT l, s, x0, x1, x2, count(*) AS w FROM vec WHERE NOT base_failed GROUP BY ALL), tot AS (SELECT l, s, sum(w) AS n FROM c0 GROUP BY ALL)""",
        f"""lv AS (SELECT 0 AS v, * FROM c0 UNION ALL SELECT 1, l, '', x0, x1, x2, sum(w) FROM c0 WHERE l IN (SELECT l FROM tot WHERE n < {LEAST}) GROUP BY l, x0, x1, x2
          UNION ALL SELECT 2, '', '', x0, x1, x2, sum(w) FROM c0 GROUP BY x0, x1, x2)""",
        f"""cells AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY v, l, s) AS total FROM lv QUALIFY total >= {LEAST})""",
    ]
    for k in range(3):
        at = lambda q, k=k: f"min(x{k}) FILTER (upto * 4 >= total * {q})::DOUBLE"
        ctes.append(f"""med{k} AS (SELECT v, l, s, {at(2)} AS m{k}, {at(3)} - {at(1)} AS r{k} FROM (SELECT v, l, s, x{k}, total, sum(sum(w)) OVER (PARTITION BY v, l, s ORDER BY x{k}) AS upto FROM cells GROUP BY v, l, s, x{k}, total) GROUP BY v, l, s)""")
    sums = ", ".join([f"sum(w * x{j}) AS s{j}" for j in range(3)] + [f"sum(w * x{p} * x{q}) AS q{p}{q}" for p, q in _PAIRS])
    means = ", ".join(f"s{j}::DOUBLE / n::DOUBLE AS m{j}" for j in range(3))
    covs = lambda by: ", ".join(f"(q{p}{q}::DOUBLE / n::DOUBLE - (s{p}::DOUBLE / n::DOUBLE) * (s{q}::DOUBLE / n::DOUBLE)) * {by}::DOUBLE + {RIDGE[p] if p == q else 0.0}::DOUBLE AS {c[p, q]}" for p, q in _PAIRS)
    wide = ", ".join(f"{RIDGE[p] * 100 if p == q else 0.0}::DOUBLE AS {c[p, q]}" for p, q in _PAIRS)
    quart = ", ".join(f"{f'r{p} * r{p} + {RIDGE[p]}::DOUBLE' if p == q else '0.0::DOUBLE'} AS {c[p, q]}" for p, q in _PAIRS)
    ctes.append(f"""p0 AS MATERIALIZED (SELECT v, l, s, 0 AS st, m0, m1, m2, {wide} FROM med0 JOIN med1 USING (v, l, s) JOIN med2 USING (v, l, s)
      UNION ALL SELECT v, l, s, 1, m0, m1, m2, {quart} FROM med0 JOIN med1 USING (v, l, s) JOIN med2 USING (v, l, s)
      UNION ALL SELECT v, l, s, 2, {means}, {covs(1.0)} FROM (SELECT v, l, s, sum(w) AS n, {sums} FROM cells GROUP BY v, l, s))""")
    for k in range(STEPS):
        ctes.append(f"""d{k} AS MATERIALIZED (SELECT cells.*, st, {dist} AS d FROM cells JOIN p{k} USING (v, l, s))""")
        ctes.append(f"""t{k} AS (SELECT v, l, s, st, min(d) AS t FROM (SELECT *, sum(w) OVER (PARTITION BY v, l, s, st ORDER BY d) AS upto FROM d{k}) WHERE upto >= ceil(total * {SUBSET}::DOUBLE) GROUP BY v, l, s, st)""")
        ctes.append(f"""p{k + 1} AS MATERIALIZED (SELECT v, l, s, st, {means}, {covs(RAISE)} FROM (SELECT v, l, s, st, sum(w) AS n, {sums} FROM d{k} JOIN t{k} USING (v, l, s, st) WHERE d <= t GROUP BY v, l, s, st))""")
    names = [*m, *(c[p] for p in _PAIRS)]
    ctes.append(f"""best AS MATERIALIZED (SELECT * FROM p{STEPS} QUALIFY row_number() OVER (PARTITION BY v, l, s ORDER BY {det}, st) = 1)""")
    picked = ", ".join(f"CASE WHEN b0.m0 IS NOT NULL THEN b0.{x} WHEN n < {LEAST} AND b1.m0 IS NOT NULL THEN b1.{x} WHEN n < {LEAST} THEN b2.{x} END AS {x}" for x in names)
    ctes.append(f"""est AS (SELECT tot.l, tot.s, {picked} FROM tot LEFT JOIN best b0 ON b0.v = 0 AND b0.l = tot.l AND b0.s = tot.s LEFT JOIN best b1 ON b1.v = 1 AND b1.l = tot.l LEFT JOIN best b2 ON b2.v = 2)""")
    cols = ", ".join(f"{x}::BIGINT AS {x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return f"WITH {', '.join(ctes)} SELECT doc_id, {cols}, base_failed, NOT base_failed AND NOT coalesce({dist} > {CUT}::DOUBLE, false) AS kept FROM vec LEFT JOIN est USING (l, s)"


ORACLE_SQL = _sql()
