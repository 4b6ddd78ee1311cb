"""Detectors: structured identifiers by pattern, and labelled mentions checked against the text.

Documents have doc_id and text; mentions have doc_id, seq (the order of arrival, which breaks ties), text, type, role
and source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import document, rows, spans, text as T
from ..functions import patterns as P

MENTION = "struct<text:string,type:string,role:string,source:string>"


def pattern_array(text: Column) -> Column:
    """Structured identifiers of a text in the detectors' order, repeats included (they are votes)."""
    return rows.column(lambda t: [(surface, kind, "", "pattern") for *_, surface, kind in document.identifiers(t)], f"array<{MENTION}>")(text)


def pattern_mentions(docs: DataFrame) -> DataFrame:
    """The pattern mentions of every document. No shuffle: one scan, one explode."""
    return docs.select("doc_id", F.posexplode(pattern_array(F.col("text"))).alias("seq", "m")).select("doc_id", F.col("seq").cast("long").alias("seq"), "m.*")


def detector_counts(docs: DataFrame) -> DataFrame:
    """doc_id and how often each detector fires: d1 to d7, parcels, plates."""
    counts = [F.size(F.regexp_extract_all(F.col("text"), F.lit(P.java(rx)), F.lit(0))).cast("long").alias(f"d{k}") for k, (_, rx) in enumerate(P.DETECTORS, 1)]
    return docs.select("doc_id", *counts)


def verified(raw: Column, type_: Column, text: Column) -> Column:
    """The surfaces of a labelled mention that occur in the text: the people of a list if all occur, else the whole, else
    the parts that do."""
    return rows.column(document.verified, "array<string>")(raw, type_, text)


def accept_labels(docs: DataFrame, labels: DataFrame, source: str = "labeler") -> tuple[DataFrame, DataFrame]:
    """Labelled items (doc_id, seq, mention, role, type) as mentions whose types are corrected and whose surfaces occur in
    the text, and the rejected items (doc_id, seq, mention)."""

    def accept(text: str | None, items: list[tuple]) -> list[tuple]:
        out = []
        for seq, mention, role, kind in items:
            kind = document.typed(kind, role, mention)
            out.append((seq, mention, document.squeeze(role), kind, document.verified(mention, kind, text)))
        return out

    lists = labels.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "mention", "role", "type")).alias("items"))
    seq = labels.schema["seq"].dataType.simpleString()
    found = rows.column(accept, f"array<struct<seq:{seq},mention:string,role:string,type:string,found:array<string>>>")
    items = docs.select("doc_id", "text").join(lists, "doc_id").select("doc_id", F.inline(found("text", "items")))
    kept = items.select("doc_id", "seq", F.posexplode("found").alias("k", "surface"), "type", "role")
    mentions = kept.select("doc_id", (F.col("seq") * 1000 + F.col("k")).alias("seq"), F.col("surface").alias("text"), "type", "role", F.lit(source).alias("source"))
    return mentions, items.where(F.size("found") == 0).select("doc_id", "seq", "mention")


def union_mentions(*parts: DataFrame) -> DataFrame:
    """Mentions of several detectors, those of earlier ones first."""
    step = 1_000_000_000
    shifted = [p.withColumn("seq", F.col("seq") + k * step) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, shifted)


def titled(text: Column, surface: Column) -> Column:
    """Whether the text introduces a name with a judge's, clerk's or lawyer's title somewhere."""
    found = spans.find(text, spans.surface(surface))
    # One more character on the left, for the pattern's look behind, may not itself begin the match.
    return F.exists(found, lambda s: T.matches(T.before(text, s["start"], 40), P.PUBLIC_TITLE))


def accept_sweep(docs: DataFrame, items: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Names found on a second reading of the redacted text, as further mentions: those that occur in the original, are not
    typed yet, do not consist of words of kept names and are not introduced with a public title. First ones win."""
    items = items.join(docs.select("doc_id", "text"), "doc_id")
    items = items.withColumn("surface", F.explode(verified(F.col("name"), F.col("type"), F.col("text"))))
    items = items.where(~titled(F.col("text"), F.col("surface"))).drop("text").withColumn("folded", T.fold(F.col("surface")))
    known = mentions.select("doc_id", T.fold(F.col("text")).alias("folded")).distinct()
    items = items.join(known, ["doc_id", "folded"], "left_anti")
    words = F.transform(F.flatten(F.transform("names", T.words)), T.fold)
    kept = entities.where("action = 'keep'").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(words))).alias("kept"))
    items = items.join(kept, "doc_id", "left").where(F.size(F.array_except(T.words(F.col("folded")), F.coalesce("kept", F.array().cast("array<string>")))) > 0)
    first = items.groupBy("doc_id", "folded").agg(F.min_by(F.struct("seq", "surface", "type", "reason"), "seq").alias("x"))
    return first.select("doc_id", F.col("x.seq").alias("seq"), F.col("x.surface").alias("text"), F.col("x.type").alias("type"), F.trim("x.reason").alias("role"), F.lit("sweep").alias("source"))
