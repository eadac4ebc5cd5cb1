"""Versioning: amendments resolved against a base, clause order, diffs, hashes to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How an amendment says that clauses are deleted, carried forward, restated in
# part or replaced, and the format of clause ids (renumber).
_DELETES = r"(?i)\b(?:is|are|stand|stands)\s+(?:hereby\s+)?(?:deleted|superseded|withdrawn|of no further effect)\b"
_NUMBER = r"[0-9]{1,2}(?:\.[0-9]{1,2})*"
_REFERENCE = rf"(?i)clauses?\s+({_NUMBER}(?:\s*(?:,|and|&)\s*{_NUMBER})*)"
_CARRIES = r"(?i)all other\b[^.]{0,200}?\b(?:remain|continue)s?\b[^.]{0,40}?(?:unchanged|in full force|in effect|to apply)"
_PARTIAL = r"(?i)only\s+(?:the\s+)?(?:rows?|items?|entries|charges)\s+(?:changed|revised|amended|shown)"


def deleted_numbers(text: Column) -> Column:
    """Numbers of clauses that a text says are deleted, distinct and sorted as strings."""
    sentences = F.split(F.regexp_replace(text, r"([.;])\s+", "$1\u0001"), "\u0001")
    lists = F.transform(F.filter(sentences, lambda s: s.rlike(_DELETES)), lambda s: F.array_join(F.regexp_extract_all(s, F.lit(_REFERENCE), F.lit(1)), " "))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(lists, " "), F.lit(f"({_NUMBER})"), F.lit(1))))


def is_carry_forward(text: Column) -> Column:
    return text.rlike(_CARRIES)


def is_partial_restatement(text: Column) -> Column:
    return text.rlike(_PARTIAL) | is_carry_forward(text)


def replaces_as_well(text: Column) -> Column:
    t = F.lower(text)
    return t.contains("replaced as follows") | t.contains("substituted")


def sort_key(number: Column, ordinal: Column) -> list[Column]:
    """Clause order: numbers by their parts as integers, then the unnumbered by place."""
    digits = F.coalesce(number.rlike(r"^[0-9]"), F.lit(False))
    parts = F.transform(F.regexp_extract_all(F.coalesce(number, F.lit("")), F.lit(r"([0-9]+)"), F.lit(1)), lambda p: p.cast("int"))
    return [F.when(digits, 0).otherwise(1), F.when(digits, parts), ordinal]


def renumber(clauses: DataFrame, key: tuple[str, ...] = ("document_id", "version")) -> DataFrame:
    """Ordinals from 0 in clause order, and clause ids from them."""
    order = W.partitionBy(*key).orderBy(*sort_key(F.col("number"), F.col("ordinal")), *(["src"] if "src" in clauses.columns else []), "content_hash")
    rows = clauses.withColumn("ordinal", F.row_number().over(order) - 1)
    return rows.withColumn("clause_id", F.format_string("%s-v%d-c%04d", F.col(key[0]), F.col(key[1]).cast("int"), F.col("ordinal")))


def resolve_standalone(clauses: DataFrame) -> DataFrame:
    return renumber(clauses.withColumn("operation", F.lit("added")))


def _text_of(clauses: DataFrame) -> DataFrame:
    """document_id and the text of all its clauses, in order, a line each."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return clauses.groupBy("document_id").agg(F.array_join(lines, "\n").alias("_text"), F.max("version").alias("version"))


def resolve_amendment(base: DataFrame, amendment: DataFrame) -> DataFrame:
    """The version that an amendment makes of its base.

    base, amendment: (document_id, version, ordinal, number, text, content_hash). Deletions
    are what the amendment as a whole says; a clause of it that only deletes, or only says
    that the rest stands, enacts nothing. Base clauses that it is silent about, and sections
    that it restates in part, stay. Returns the new version's rows with operation and
    previous_hash; rows of operation ``deleted`` only record the hash of what went and have
    no text, ordinal or id.
    """
    doc, number = "document_id", "number"
    first = W.partitionBy(doc, number).orderBy("ordinal")
    known = base.where("number IS NOT NULL").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    known = known.select(doc, number, F.col("content_hash").alias("_b_hash"), F.col("text").alias("_b_text"), F.col("ordinal").alias("_b_ordinal"))
    whole = _text_of(amendment)
    deleted = whole.select(doc, F.explode(deleted_numbers(F.col("_text"))).alias(number)).withColumn("_deleted", F.lit(True))
    versions = whole.select(doc, "version")

    t, own, has = F.col("text"), F.col("_deleted").isNotNull(), F.col("_b_hash").isNotNull()
    stated = amendment.drop("version").join(versions, doc).join(deleted, [doc, number], "left").join(known, [doc, number], "left")
    way = (
        F.when(own & ~replaces_as_well(t), "deletes").when(F.col(number).isNotNull() & is_carry_forward(t), "carries")
        .when(has, F.when(F.col("_b_hash") == F.col("content_hash"), "same").otherwise("replaces")).otherwise("adds")
    )
    stated = stated.withColumn("_way", way)
    none = F.lit(None).cast("string")

    def rows(of: DataFrame, operation: str, stage: int, ordinal: str, text: str, hash_: str, previous: Column = none) -> DataFrame:
        return of.select(doc, "version", F.col(ordinal).alias("ordinal"), number, F.col(text).alias("text"), F.col(hash_).alias("content_hash"), F.lit(operation).alias("operation"), previous.alias("previous_hash"), F.lit(stage).alias("src"))

    said = lambda way: stated.where(F.col("_way") == way)
    live = rows(said("replaces"), "replaced", 1, "ordinal", "text", "content_hash", F.col("_b_hash"))
    live = live.unionByName(rows(said("same"), "carried_forward", 1, "ordinal", "text", "content_hash")).unionByName(rows(said("adds"), "added", 1, "ordinal", "text", "content_hash"))
    live = live.unionByName(rows(said("carries").where(has), "carried_forward", 1, "_b_ordinal", "_b_text", "_b_hash"))
    # base clauses that nothing consumed
    restated = amendment.where("number IS NOT NULL").select(doc, number).distinct()
    consumed = restated.unionByName(deleted.select(doc, number)).distinct()
    live = live.unionByName(rows(base.drop("version").join(consumed, [doc, number], "left_anti").join(versions, doc), "carried_forward", 2, "ordinal", "text", "content_hash"))
    # sections restated in part keep the original beside the new rows
    partial = stated.where(has & is_partial_restatement(t)).select(doc, "version", number, "_b_ordinal", "_b_text", "_b_hash").distinct()
    kept = said("carries").select(doc, number).distinct()
    live = live.unionByName(rows(partial.join(kept, [doc, number], "left_anti"), "carried_forward", 3, "_b_ordinal", "_b_text", "_b_hash"))
    # what went: deletions that a clause announces, and those that another one names
    named = deleted.join(restated, [doc, number], "left_anti").join(known, [doc, number]).join(versions, doc)
    gone = said("deletes").where(has).select(doc, "version", number, "_b_hash").unionByName(named.select(doc, "version", number, "_b_hash"))
    kind = base.schema["ordinal"].dataType
    dead = gone.select(doc, "version", F.lit(None).cast(kind).alias("ordinal"), number, none.alias("text"), none.alias("content_hash"), F.lit("deleted").alias("operation"), F.col("_b_hash").alias("previous_hash"))
    return renumber(live).drop("src").unionByName(dead.withColumn("clause_id", none))


def partial_notes(amendment: DataFrame) -> DataFrame:
    """document_id, numbers: the sections that an amendment restates only in part, in order;
    both versions of these stay in the resolved version."""
    rows = amendment.where(F.col("number").isNotNull() & is_partial_restatement(F.col("text")))
    return rows.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "number"))), lambda x: x["number"]).alias("numbers"))


def resolve_chain(base: DataFrame, amendments: list[DataFrame], save) -> DataFrame:
    """Amendments applied one after another; save(df) writes and rereads each version, so
    that plans don't grow with the chain."""
    out = save(resolve_standalone(base))
    for a in amendments:
        live = out.where("operation <> 'deleted'").select("document_id", "version", "ordinal", "number", "text", "content_hash")
        out = save(resolve_amendment(live, a))
    return out


def embedding_required(resolved: DataFrame) -> DataFrame:
    """(document_id, version, content_hash) whose text is new in the version."""
    return resolved.where(F.col("operation").isin("added", "replaced")).select("document_id", "version", "content_hash").distinct()


def reused(resolved: DataFrame) -> DataFrame:
    """(document_id, version, content_hash) whose vector the version takes over."""
    return resolved.where("operation = 'carried_forward'").select("document_id", "version", "content_hash").distinct()


def diff(earlier: DataFrame, later: DataFrame, key: list[str]) -> DataFrame:
    """Hashes of two versions (key.., content_hash) by side: added, removed, unchanged."""
    a = earlier.select(*key, "content_hash").distinct().withColumn("_a", F.lit(1))
    b = later.select(*key, "content_hash").distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, [*key, "content_hash"], "full_outer").select(*key, "content_hash", side.alias("side"))


def next_version(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(document_id, next_version) of each incoming document."""
    last = existing.groupBy("document_id").agg(F.max("version").alias("_v"))
    return incoming.select("document_id").distinct().join(last, "document_id", "left").select("document_id", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version"))


def require_base(amendments: DataFrame, bases: DataFrame) -> DataFrame:
    """amendments, or an error at run time if one has no base document."""
    found = bases.select("document_id").distinct().withColumn("_base", F.lit(True))
    rows = amendments.join(found, "document_id", "left")
    checked = F.when(F.col("_base").isNull(), F.raise_error(F.concat(F.lit("amendment without a base: "), F.col("document_id")))).otherwise(F.col("document_id"))
    return rows.withColumn("document_id", checked).drop("_base")
