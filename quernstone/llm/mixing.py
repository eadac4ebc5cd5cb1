"""Operator 7: mixing sources to target weights by Sainte-Lague apportionment.

1. Sources, by code point and null last, weigh 1, 2, 3, repeating, and share all tokens;
   a target stops at ``MOST`` times its source's size and the excess is shared again by
   weight. That is water filling: in the order of limit / weight the sources that stop
   are a prefix, so running sums find the level in one pass.
2. The sum of the targets makes that many blocks of ``BLOCK`` tokens. Blocks are seats and
   targets votes: seats go to the highest quotients votes / (2 k + 1). The divisor that fits
   is known to within half a seat per source, so each source lists only the quotients that
   can be in doubt.
3. A source's documents are dealt to shards of about a thousand by a seeded hash, and its
   seats to its shards in the same way, sizes being votes: an integer quota for each shard.
4. A shard's documents, in seeded order, are one stream of tokens. Its quota goes round that
   stream: whole rounds take every document once more, and the last round takes the blocks
   up to the quota, so one document a shard at most is cut. Rows are summed up in cells of
   the hash, finer than shards, so no task gets a source.

A source's taken words differ from its target by half a block, and by less than a block for
each shard that its ``MOST`` sizes stop.

Defined cases: null text has size 0 and is taken 0 times; a null source is a source of
its own, last in order; if no text has a word all targets are 0; equal quotients go by source
(or shard) and place; equal hashes (repeated ids) go by size; repeated rows count each; very
long texts are counted whole; an empty table gives no rows; extra columns, whatever their
names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, hex_digits, materialize, row_count, table

MOST = 3
BLOCK = 16
SEED = 7


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def targets(sizes: DataFrame) -> DataFrame:
    """_source, source_size, target from rows (_source, source, source_size)."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("_weight", ((rank - 1) % 3 + 1).cast("bigint")).withColumn("_cap", F.col("source_size") * MOST)
    order = W.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    weights = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = left.cast("double") / weights.cast("double")
    shared = ranked.withColumn("_level", level)
    shared = shared.withColumn("_stops", F.col("_cap").cast("double") <= F.col("_level") * F.col("_weight"))
    # the level of the first source that doesn't stop holds for all after it
    final = F.min(F.when(~F.col("_stops"), F.struct((F.col("_cap") / F.col("_weight")).alias("r"), "_source", "_level"))).over(everything)
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(final["_level"] * F.col("_weight"))
    return shared.select("_source", "source_size", target.cast("double").alias("target"))


def apportion(groups: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, _seats from rows (by, key, _votes, _all): the _all seats of each `by` go to
    its keys by highest quotients."""
    each = W.partitionBy(by)
    voted = groups.where(F.col("_votes") > 0).withColumns({"_sum": F.sum("_votes").over(each), "_many": F.count(F.lit(1)).over(each)})
    share = F.col("_votes") / F.col("_sum")
    least = F.greatest(F.floor(share * (F.col("_all") - F.col("_many") / 2)) - 1, F.lit(0)).cast("bigint")
    most = (F.floor(share * (F.col("_all") + F.col("_many") / 2)) + 2).cast("bigint")
    voted = voted.withColumns({"_least": least, "_most": most})
    voted = voted.withColumn("_open", F.col("_all") - F.sum("_least").over(each))
    doubtful = voted.withColumn("_k", F.explode(F.sequence("_least", F.col("_most") - 1)))
    quotient = F.col("_votes") / (2 * F.col("_k") + 1)
    place = F.row_number().over(each.orderBy(quotient.desc(), key, "_k"))
    won = doubtful.withColumn("_place", place).groupBy(by, key, "_least")
    won = won.agg(F.sum(F.when(F.col("_place") <= F.col("_open"), 1).otherwise(0)).alias("_won"))
    return won.select(by, key, (F.col("_least") + F.col("_won")).cast("bigint").alias("_seats"))


def quotas(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """_source, _shard, _seats from rows (_source, _shard, _votes in words)."""
    seats = F.floor(F.sum("_votes").over(W.partitionBy("_shard")) / block + 0.5).cast("bigint")
    return apportion(groups.where(F.col("_votes") > 0).withColumn("_all", seats), "_shard", "_source")


def _digits(rows: Column, most: int) -> Column:
    """hex_digits() of a column of counts."""
    out = F.lit(most)
    for k in reversed(range(most)):
        out = F.when(rows <= 1000 * 16**k, F.lit(k)).otherwise(out)
    return out


def sized(docs: DataFrame, digits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACE_WORD)).cast("bigint")
    key = F.concat_ws(":", F.lit(str(SEED)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = F.md5(key.cast("binary"))
    return docs.select(
        "doc_id", "source", size.alias("size"), _source_key(F.col("source")).alias("_source"), order.alias("_order"), F.substring(order, 1, digits).alias("_cell"), *keep
    )


def mix(docs: DataFrame, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns of keep) of each row."""
    digits = hex_digits(row_count(docs))
    narrow = materialize(sized(docs, digits), "mixing")
    rows = sized(docs, digits, keep) if keep else narrow  # what is kept isn't stored
    cells = narrow.groupBy("_source", "_cell").agg(F.min("source").alias("source"), F.sum("size").alias("_cell_size"), F.count(F.lit(1)).alias("_rows"))
    cells = materialize(cells, "mixing-cells")
    by_source = cells.groupBy("_source").agg(F.min("source").alias("source"), F.sum("_cell_size").alias("source_size"), F.sum("_rows").alias("_rows"))
    by_source = materialize(by_source, "mixing-sources")
    target = targets(by_source.drop("_rows"))
    seats = quotas(target.select("_source", F.lit("").alias("_shard"), F.col("target").alias("_votes")), block).select("_source", F.col("_seats").alias("_all"))
    known = target.join(by_source.select("_source", _digits(F.col("_rows"), digits).alias("_digits")), "_source").join(seats, "_source", "left").na.fill(0, ["_all"])
    known = materialize(known, "mixing-targets")
    # a shard is a prefix of its cells
    fine = cells.drop("source", "_rows").join(known, "_source").withColumn("_shard", F.expr("substring(_cell, 1, _digits)"))
    shards = fine.groupBy("_source", "_shard").agg(F.sum("_cell_size").alias("_size"), F.first("_all").alias("_all"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = materialize(shards, "mixing-shards")
    won = apportion(shards.select("_source", "_shard", F.col("_size").cast("double").alias("_votes"), "_all"), "_source", "_shard")
    quota = F.least(F.coalesce("_seats", F.lit(0)) * block, F.col("_size") * MOST).cast("bigint")
    plan = shards.join(won, ["_source", "_shard"], "left").select("_source", "_shard", "_size", "source_size", "target", quota.alias("_quota"))
    offset = F.sum("_cell_size").over(W.partitionBy("_source", "_shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    plan = fine.select("_source", "_shard", "_cell", "_cell_size").withColumn("_offset", F.coalesce(offset, F.lit(0))).join(plan, ["_source", "_shard"])
    plan = plan.drop("_shard", "_cell_size")
    within = W.partitionBy("_source", "_cell").orderBy("_order", "size").rowsBetween(W.unboundedPreceding, -1)
    dealt = rows.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, ["_source", "_cell"])
    quota = F.col("_quota")
    rounds = F.when(F.col("_size") > 0, F.floor(quota / F.col("_size"))).otherwise(0).cast("bigint")
    rest = quota - rounds * F.col("_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_offset")))
    return dealt.select("doc_id", "size", "source_size", "target", (rounds * F.col("size") + last).cast("bigint").alias("taken"), *keep)


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time a document is taken,
    the last one cut after the last word taken (its white space stays as it was).
    Documents that the mix doesn't take are left out."""
    names = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*names).alias("_row"))
    dealt = mix(packed, block, keep=("_row",)).where(F.col("taken") > 0)
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    text = F.col("_row.text")
    head = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, words), "")
    cut = F.when(words < F.col("size"), head).otherwise(text)
    fields = {n: F.col("_row").getField(n) for n in names} | {"text": cut}
    if "n_chars" in names:
        fields["n_chars"] = F.length(cut).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(c.alias(n) for n, c in fields.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _apportion_sql(name: str, groups: str, by: str, key: str) -> str:
    """CTEs that end in `name` (by, key, seats) from `groups` (by, key, votes, seats_)."""
    return f"""{name}1 AS (SELECT {by}, {key}, votes, seats_, sum(votes) OVER p AS total, count(*) OVER p AS many FROM {groups} WHERE votes > 0 WINDOW p AS (PARTITION BY {by})),
{name}2 AS (SELECT *, greatest(floor(votes / total * (seats_ - many / 2.0::DOUBLE)) - 1, 0)::BIGINT AS least_, (floor(votes / total * (seats_ + many / 2.0::DOUBLE)) + 2)::BIGINT AS most_ FROM {name}1),
{name}3 AS (SELECT *, unnest(range(least_, most_)) AS k_ FROM (SELECT *, seats_ - sum(least_) OVER (PARTITION BY {by}) AS open_ FROM {name}2)),
{name}4 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY votes / (2 * k_ + 1) DESC, {key}, k_) AS place FROM {name}3),
{name} AS (SELECT {by}, {key}, (least_ + sum(CASE WHEN place <= open_ THEN 1 ELSE 0 END))::BIGINT AS seats FROM {name}4 GROUP BY {by}, {key}, least_)"""


_SQL_DIGITS = "CASE WHEN c <= 1000 THEN 0 WHEN c <= 16000 THEN 1 WHEN c <= 256000 THEN 2 WHEN c <= 4096000 THEN 3 ELSE 4 END"
ORACLE_SQL = rf"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
      CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
src AS (SELECT s, min(source) AS source, sum(size)::BIGINT AS source_size, count(*) AS c FROM r GROUP BY s),
rows_ AS (SELECT r.*, substr(o, 1, {_SQL_DIGITS}) AS sh FROM r JOIN src USING (s)),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * {MOST} AS cap FROM src),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, cap::DOUBLE <= lev * weight AS stops FROM l),
f AS (SELECT arg_min(lev, (cap::DOUBLE / weight, s)) AS final FROM st WHERE NOT stops),
t AS (SELECT s, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE final * weight END AS target FROM st LEFT JOIN f ON true),
g1 AS (SELECT 1 AS one, s, target AS votes, floor(sum(target) OVER () / {BLOCK} + 0.5)::BIGINT AS seats_ FROM t WHERE target > 0),
{_apportion_sql('a', 'g1', 'one', 's')},
g AS (SELECT s, sh, sum(size)::BIGINT AS gsize FROM rows_ GROUP BY s, sh),
g2 AS (SELECT g.s, sh, gsize::DOUBLE AS votes, coalesce(seats, 0) AS seats_ FROM g LEFT JOIN a USING (s)),
{_apportion_sql('b', 'g2', 's', 'sh')},
pl AS (SELECT g.s, g.sh, gsize, source_size, target, least(coalesce(seats, 0) * {BLOCK}, gsize * {MOST})::BIGINT AS quota FROM g JOIN t USING (s) LEFT JOIN b ON b.s = g.s AND b.sh = g.sh),
d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY s, sh ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ FROM rows_),
e AS (SELECT d.doc_id, d.size, d.before_, pl.*, CASE WHEN gsize > 0 THEN quota // gsize ELSE 0 END AS rounds FROM d JOIN pl ON d.s = pl.s AND d.sh = pl.sh)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (rounds * size + greatest(0, least(size, quota - rounds * gsize - before_)))::BIGINT AS taken FROM e
"""
