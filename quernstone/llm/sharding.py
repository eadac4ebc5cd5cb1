"""Operator 6: sharding by jump consistent hashing.

A key is a 64-bit integer. Jump hashing walks a linear congruential sequence seeded by
the key and jumps to ever higher shard numbers; the last number below the shard count is
the row's shard. No ring table exists, and appending a shard moves only the rows that the
new shard receives. Everything is built-in expressions: 2**64 arithmetic is done in
decimal(38), since a product of the generator stays below 10**38.

Defined cases: a null key counts as key 0; null text has size 1 and the checksum of no bytes;
an empty table gives no rows; repeated rows each get a slot of their own, one after another;
different texts of one checksum and size under one key go in any order; very long texts are measured whole; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hex_digits, materialize, row_count, table

SHARDS = 8
#: Rows of a group that is numbered in one task.
GROUP = 1000
#: Fixed value of the published algorithm: multiplier of its generator.
_STEP = 2862933555777941757
_TWO64 = 1 << 64


def jump_shard(key: Column, shards: int) -> Column:
    """Shard in 0 .. shards - 1 of a bigint key (read as unsigned)."""
    two64 = F.lit(str(_TWO64)).cast("decimal(20,0)")
    wide = key.cast("decimal(20,0)")
    seed = F.when(wide < 0, wide + two64).otherwise(wide).cast("decimal(20,0)")

    def jump(at: Column, _: Column) -> Column:
        stepped = ((at["k"] * F.lit(str(_STEP)).cast("decimal(19,0)") + 1) % two64).cast("decimal(20,0)")

        def moved(k: Column) -> Column:
            high = F.floor(k / F.lit("8589934592").cast("decimal(20,0)")).cast("bigint")
            ahead = (at["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double"))
            return F.struct(k.alias("k"), at["j"].alias("b"), F.floor(ahead).cast("bigint").alias("j"))

        return F.when(at["j"] >= shards, at).otherwise(F.transform(F.array(stepped), moved).getItem(0))

    start = F.struct(seed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda at: at["b"]).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, grown_shard and a gapless
    slot within the shard.

    Slots follow the first digits of the key's md5, then the md5 of the text's checksum and
    size, then the key's whole md5. They are numbered in two levels, so that no task holds a
    shard or a key: equal rows are counted, rows are summed up within groups of about a
    thousand by those digits, and by digits of the second hash where a key has more, and the
    groups' counts are summed up in their order.
    """
    digits = hex_digits(row_count(docs), per_group=GROUP * shards)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_order"),
    )
    number = F.coalesce(F.col("_key").cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows.withColumns({"shard": jump_shard(number, shards), "grown_shard": jump_shard(number, shards + 1)})
    mixed = F.md5(F.concat_ws(":", F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    rows = rows.withColumns({"_part": F.substring("_order", 1, digits), "_mix": mixed})
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")), "shards")
    crowded = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 8 * GROUP)
    finer = F.ceil(F.log2(F.col("_rows") / GROUP) / 4).cast("int")
    crowded = materialize(crowded.select("shard", "_part", finer.alias("_finer")), "shards-crowded")
    rows = rows.join(crowded, ["shard", "_part"], "left").withColumn("_sub", F.expr("substring(_mix, 1, coalesce(_finer, 0))")).drop("_finer")
    counts = rows.groupBy("shard", "_part", "_sub").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy("shard").orderBy("_part", "_sub").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", "_sub", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("shard", "_part", "_sub").orderBy("_mix", "_order", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_rank", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, ["shard", "_part", "_sub"])
    copies = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return copies.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank") + F.col("_copy")).cast("bigint").alias("slot"), "grown_shard"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _jump_sql(shards: int) -> str:
    """The jump walk as nested selects: a step for each shard there could be."""
    sql = "SELECT n, CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616::HUGEINT ELSE k::HUGEINT END AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM keyed"
    for _ in range(shards):
        sql = f"SELECT n, CASE WHEN j >= {shards} THEN k ELSE (k * {_STEP}::HUGEINT + 1) % 18446744073709551616::HUGEINT END AS k, j < {shards} AS goes, b, j FROM ({sql})"
        sql = f"SELECT n, k, CASE WHEN goes THEN j ELSE b END AS b, CASE WHEN goes THEN floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT ELSE j END AS j FROM ({sql})"
    return f"SELECT n, b::INT AS shard FROM ({sql})"


ORACLE_SQL = f"""
WITH keyed AS (SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, 0) AS k, coalesce(text, '') AS t FROM documents),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
crc AS (SELECT n, 4294967295 - list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT),
  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT) AS text_crc32 FROM keyed, tab),
now AS ({_jump_sql(SHARDS)}), grown AS ({_jump_sql(SHARDS + 1)}),
r AS (SELECT keyed.n, doc_id, (strlen(t) + 1)::BIGINT AS size, text_crc32, now.shard, grown.shard AS grown_shard
  FROM keyed JOIN crc ON crc.n = keyed.n JOIN now ON now.n = keyed.n JOIN grown ON grown.n = keyed.n)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY
  substr(md5(coalesce(doc_id::VARCHAR, '')), 1, CASE WHEN c <= {GROUP * SHARDS} THEN 0 WHEN c <= {GROUP * SHARDS * 16} THEN 1 WHEN c <= {GROUP * SHARDS * 256} THEN 2 WHEN c <= {GROUP * SHARDS * 4096} THEN 3 ELSE 4 END),
  md5(text_crc32 || ':' || size), md5(coalesce(doc_id::VARCHAR, '')), text_crc32, size) - 1 AS slot, grown_shard FROM r, (SELECT count(*) AS c FROM documents)
"""
