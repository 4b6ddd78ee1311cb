"""Plans from mentions to reviewed results: everything here is recomputed when only the rule pack changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import document
from ..operators import audit, detect, redact
from ..session import materialize
from .rules import load_pack


def review(docs: DataFrame, mentions: DataFrame, pack: str = "bger-2020", reader: DataFrame | None = None) -> DataFrame:
    """One row per document: pack, title, language, social insurance, original, output, edits, kept, entities, risks.

    ``reader`` holds a second reader's quotes (doc_id, quote, severity, reason, source); they are screened and located
    in this pack's output. No model is called.
    """
    rows = redact.with_mentions(docs.select("doc_id", "text", "legal_area"), mentions)
    if reader is not None:
        quotes = reader.groupBy("doc_id").agg(F.collect_list(F.struct("quote", "severity", "reason", "source")).alias("reader"))
        rows = rows.join(quotes, "doc_id", "left")
    return review_rows(rows, pack)


def review_rows(rows: DataFrame, pack: str = "bger-2020", patterns: bool = False) -> DataFrame:
    """The same of rows with doc_id, text, legal_area, mentions and, if there was a second reader, their quotes in an array
    ``reader``; with ``patterns`` the pattern mentions are found in the same go."""
    rules = load_pack(pack)
    more = ("reader",) if "reader" in rows.columns else ()
    wanted: redact.Wanted = redact.OUTPUT | redact.EDITS | redact.KEPT | redact.GUARD | {
        "entities": (f"array<{redact.SUMMARY}>", lambda r, *_: r.summary or None),
        "risks": (f"array<{RISK}>", _risks),
        "language": ("string", lambda r, *_: document.language(r.text)),
        "social_insurance": ("boolean", lambda r, area, *_: document.social_insurance(r.text, area)),
    }
    out = redact.decide(rows, rules, wanted, patterns=patterns, more=("legal_area", *more))
    return out.select(
        "doc_id", F.lit(pack).alias("pack"), F.lit(rules["title"]).alias("pack_title"), F.lit(rules["source"]).alias("pack_source"), "language", "social_insurance",
        F.col("text").alias("original"), "output", "edits", "kept", "entities", "risks", "guard_ok",
    )


RISK = "struct<start:int,far:int,end:int,quote:string,severity:string,reason:string,source:string>"


def _risks(r: redact.Redaction, area: str | None = None, reader: list[tuple] | None = None, *_) -> list[tuple] | None:
    """Deterministic risks, then what the reader saw, one per span; null where there is none."""
    found = audit.document_risks(r.output, r.entities)
    spans = {risk[:2] for risk in found}
    seen: dict[tuple[int, int], tuple] = {}
    left = set(audit.screened([q[0] for q in reader or ()], r.entities))
    for quote, severity, reason, source in reader or ():
        at = document.find(r.output, quote) if quote in left and quote.strip(" ") else []
        if at and at[0] not in spans:
            risk = (*at[0], quote, severity, reason, source)
            key = lambda x: [(v is not None, v or "") for v in x[3:5]]
            if at[0] not in seen or key(risk) < key(seen[at[0]]):
                seen[at[0]] = risk
    rows = [(start, -end, end, *rest) for start, end, *rest in (*found, *seen.values())]
    return sorted(rows, key=lambda x: [(v is not None, v or 0 if k < 3 else v or "") for k, v in enumerate(x)]) or None


def anonymize(docs: DataFrame, labels: DataFrame | None = None, pack: str = "bger-2020", sweep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mentions and applied documents: patterns, then recorded labels, then a sweep of the first draft."""
    mentions = detect.pattern_mentions(docs)
    if labels is not None:
        mentions = detect.union_mentions(mentions, detect.accept_labels(docs, labels)[0])
    mentions = materialize(mentions, "mentions")
    ents, applied = redact.redact(docs, mentions, load_pack(pack))
    if sweep is not None:
        mentions = materialize(detect.union_mentions(mentions, detect.accept_sweep(docs, sweep, mentions, ents)), "mentions")
        ents, applied = redact.redact(docs, mentions, load_pack(pack))
    return mentions, applied


#: Detectors by name: documents (and recorded labels) to mentions.
SYSTEMS = {
    "patterns": lambda docs, labels=None: detect.pattern_mentions(docs),
    "labelled": lambda docs, labels: detect.union_mentions(detect.pattern_mentions(docs), detect.accept_labels(docs, labels)[0]),
}
