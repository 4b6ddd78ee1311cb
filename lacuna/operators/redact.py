"""Redaction: where entities occur, which occurrences become edits, what is written, and the proof that nothing else changed.

A document is redacted in one go, in one row: its text, its mentions and what comes of them meet nothing of other documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import document as D
from ..functions import patterns as P
from ..functions import rows as R
from ..plans.rules import letters
from ..session import materialize
from . import resolve

SPAN = "struct<start:int,end:int,seq:int,ent:int>"
EDIT = "struct<start:int,end:int,original:string,replacement:string,entity:int,type:string,action:string,basis:string>"
ENTITY = resolve.ENTITY.removesuffix(">") + ",first:int,count:bigint,label:string>"
#: The places in an entity of its type, names, roles, action, why, first and label.
TYPE, NAMES, ROLES, ACTION, BASIS, WHY, FIRST, LABEL = 1, 2, 3, 5, 6, 7, 8, 10
SUMMARY = "struct<place:int,id:int,label:string,type:string,action:string,basis:string,why:string,count:bigint,names:array<string>,roles:array<string>>"
#: Detected mentions come before those of later detectors.
STEP = 1_000_000_000


def by_length(names: Column) -> Column:
    """Distinct names, longest first, then by value."""
    keyed = F.transform(F.array_distinct(names), lambda n: F.struct((-F.char_length(n)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])


def occurrences(text: str | None, entities: list[tuple]) -> list[tuple[int, int, int, int]]:
    """start, end, seq (order of finding), ent of every name's occurrences, overlapping ones included."""
    out: list[tuple[int, int, int, int]] = []
    for e in entities:
        kind = e[TYPE]
        person = kind in P.PERSON
        for name in D.by_length(e[NAMES] or ()):
            for start, end in D.find(text, name, person):
                if kind != "birth_date" or D.near_birth(text, start, end):
                    out.append((start, end, len(out) + 1, e[0]))
    return out


def authority_addresses(text: str | None, entities: list[tuple], hits: list[tuple]) -> set[int]:
    """The addresses of which every occurrence follows, within 150 characters and the same paragraph, a body that the pack
    keeps: the nearest name that ends before it."""
    asked = {e[0] for e in entities if e[TYPE] == "address"}
    if not asked:
        return set()
    bodies = {e[0] for e in entities if e[TYPE] in P.AUTHORITY and e[ACTION] == "keep"}
    named = sorted((end, seq, start, ent in bodies) for start, end, seq, ent in hits if ent not in asked)
    ends = [x[0] for x in named]
    judged: dict[int, bool] = {}
    for begin, _, _, ent in hits:
        if ent in asked:
            k = bisect_right(ends, begin) - 1
            near = k >= 0 and begin - ends[k] <= 150 and "\n\n" not in text[ends[k] : begin]
            judged[ent] = judged.get(ent, True) and near and named[k][3]
    return {ent for ent, kept in judged.items() if kept}


class Pack:
    """A rule pack as the workers use it."""

    def __init__(self, pack: dict):
        self.rules = resolve.by_type(pack)
        self.placeholder, self.removed = pack["placeholder"], pack["removed"]
        self.people, self.places = letters(pack["person_letters"], ""), letters(pack["place_letters"], pack["person_letters"])


class Redaction:
    """One document's entities, edits, output and guard; each is worked out when it is asked for."""

    def __init__(self, text: str | None, legal_area: str | None, mentions: list[tuple] | None, pack: Pack):
        self.text, self.pack = text, pack
        self.social = D.social_insurance(text, legal_area) if mentions else None
        found = resolve.document_entities(mentions or [], self.social, pack.rules)
        self.hits = occurrences(text, found)
        kept = authority_addresses(text, found, self.hits)
        if kept:
            found = [(e[0], "authority_address", *e[2:5], *resolve.rule(pack.rules, "authority_address", self.social)) if e[0] in kept else e for e in found]
        self._found = found
        replaced = {e[0] for e in found if e[ACTION] != "keep"}
        self._chosen = D.greedy(h for h in self.hits if h[3] in replaced)

    @cached_property
    def entities(self) -> list[tuple]:
        """The entities with first, count and label: placeholders by first occurrence, places and others in sequences of
        their own; removal marks."""
        first, count = {}, {}
        for start, _, _, ent in self.hits:
            first[ent] = min(first.get(ent, start), start)
            count[ent] = count.get(ent, 0) + 1
        length = None if self.text is None else len(self.text)
        edited = {s[3] for s in self._chosen}
        labels = {e[0]: self.pack.removed for e in self._found if e[ACTION] == "remove"}
        used = [(first[e[0]], e[0], e[TYPE] in P.PLACE) for e in self._found if e[ACTION] == "pseudonymize" and e[0] in edited]
        turn = {True: iter(self.pack.places), False: iter(self.pack.people)}
        for _, ent, place in sorted(used):
            letter = next(turn[place], None)
            labels[ent] = None if letter is None else self.pack.placeholder.replace("{letter}", letter)
        return [(*e, first.get(e[0], length), count.get(e[0], 0), labels.get(e[0], "")) for e in self._found]

    @cached_property
    def edits(self) -> list[tuple]:
        out = []
        for start, end, _, ent in self._chosen:
            e = self.entities[ent]
            shown = e[LABEL]
            # A label's own point is left out before a full stop.
            if shown and shown[-1] == "." and self.text[end : end + 1] == ".":
                shown = shown[:-1]
            out.append((start, end, self.text[start:end], shown, ent, e[TYPE], e[ACTION], e[BASIS]))
        return out

    @cached_property
    def written(self) -> list[tuple]:
        return [(e[0], e[1], e[3]) for e in self.edits]

    @cached_property
    def output(self) -> str:
        return D.splice(self.text or "", self.written)

    @cached_property
    def guard_ok(self) -> bool | None:
        return None if self.text is None else D.untouched(self.text, self.output, self.written)

    @cached_property
    def kept(self) -> list[tuple] | None:
        """Where kept names occur outside every edit, first entities first; None where they don't occur at all."""
        keeping = {e[0] for e in self._found if e[ACTION] == "keep"}
        hits = [h for h in self.hits if h[3] in keeping]
        return _kept([(start, end, k, ent) for k, (start, end, _, ent) in enumerate(hits, 1)], [e[:2] for e in self.edits])

    @property
    def summary(self) -> list[tuple]:
        return summarized(self.entities, self.edits, self.kept or [])


def _kept(hits: list[tuple], taken: list[tuple[int, int]] | None) -> list[tuple] | None:
    return D.first_come(hits, taken or ()) if hits else None


def summarized(entities: list[tuple], edits: list[tuple], kept: list[tuple]) -> list[tuple]:
    seen: dict[int, int] = {}
    for ent in (*(e[4] for e in edits), *(k[3] for k in kept)):
        seen[ent] = seen.get(ent, 0) + 1
    rows = sorted((e for e in entities if e[0] in seen), key=lambda e: (e[FIRST] is not None, e[FIRST], e[0]))
    return [
        (place, e[0], e[LABEL], e[TYPE], e[ACTION], e[BASIS], e[WHY], seen[e[0]], D.by_length(e[NAMES]), e[ROLES][:3]) for place, e in enumerate(rows, 1)
    ]


#: What a redaction can give, and how it is asked for.
Wanted = dict[str, tuple[str, Callable[..., Any]]]
OUTPUT: Wanted = {"output": ("string", lambda r, *_: r.output)}
EDITS: Wanted = {"edits": (f"array<{EDIT}>", lambda r, *_: r.edits)}
COUNT: Wanted = {"n_edits": ("bigint", lambda r, *_: len(r.edits))}
GUARD: Wanted = {"guard_ok": ("boolean", lambda r, *_: r.guard_ok)}
ENTITIES: Wanted = {"entities": (f"array<{ENTITY}>", lambda r, *_: r.entities)}
KEPT: Wanted = {"kept": (f"array<{SPAN}>", lambda r, *_: r.kept)}
SUMMARIES: Wanted = {"summary": (f"array<{SUMMARY}>", lambda r, *_: r.summary)}


def decide(rows: DataFrame, pack: dict, wanted: Wanted, patterns: bool = False, strict: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows with doc_id, text, legal_area (null where unknown) and mentions (an array) -> also what is wanted of their
    redaction; the columns named in ``more`` are given on to each function of ``wanted``.

    With ``patterns`` the pattern mentions are found in the same go, and come before the others; with ``strict`` a failed guard
    fails the job.
    """
    used = Pack(pack)
    parts = [f for _, f in wanted.values()]

    def run(doc_id: str | None, text: str | None, legal_area: str | None, mentions: list[tuple] | None, *values: Any) -> tuple:
        if patterns:
            found = [(k, x[2], x[3], "") for k, x in enumerate(D.identifiers(text))]
            mentions = found + [(seq + STEP, *rest) for seq, *rest in mentions or ()]
        r = Redaction(text, legal_area, mentions, used)
        if strict and not r.guard_ok:
            raise ValueError(f"text changed outside the edits of document {doc_id}")
        return tuple(f(r, *values) for f in parts)

    shape = ",".join(f"{name}:{kind}" for name, (kind, _) in wanted.items())
    found = R.column(run, f"struct<{shape}>")(F.col("doc_id").cast("string"), "text", F.col("legal_area").cast("string"), resolve.as_mentions(F.col("mentions")), *more)
    return rows.withColumn("__redaction", found).select(*rows.columns, "__redaction.*").drop("mentions")


def entity_rows(decided: DataFrame) -> DataFrame:
    """doc_id, ent, type, names, roles, social, action, basis, why, first, count, label of decided documents."""
    return decided.select("doc_id", F.inline("entities"))


def kept_spans(docs: DataFrame, ents: DataFrame, applied: DataFrame) -> DataFrame:
    """doc_id, kept: where kept names occur outside every edit, first entities first."""
    keeping = ents.where("action = 'keep'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ent", "type", "names"))).alias("keeping"))
    taken = applied.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))).alias("taken"))
    rows = docs.select("doc_id", "text").join(keeping, "doc_id").join(taken, "doc_id")
    kept = R.column(lambda text, keeping, taken: _kept(occurrences(text, keeping), taken), f"array<{SPAN}>")
    return rows.select("doc_id", kept("text", "keeping", "taken").alias("kept")).where("kept is not null")


def summary(ents: DataFrame, applied: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, id, label, type, action, basis, why, count, names, roles, first of the entities seen in edits or kept spans;
    a document's entities stand in the order of their first occurrence."""
    seen = applied.select("doc_id", F.explode("edits").alias("e")).select("doc_id", F.col("e.entity").alias("ent"))
    seen = seen.unionByName(kept.select("doc_id", F.explode("kept").alias("k")).select("doc_id", F.col("k.ent").alias("ent")))
    counts = seen.groupBy("doc_id", "ent").agg(F.count("*").alias("seen"))
    rows = ents.drop("count").join(counts, ["doc_id", "ent"])
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "ent"))
    return rows.select(
        "doc_id", order.alias("place"), F.col("ent").alias("id"), "label", "type", "action", "basis", "why", F.col("seen").alias("count"),
        by_length(F.col("names")).alias("names"), F.slice("roles", 1, 3).alias("roles"),
    )


def with_mentions(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Documents with the array of their mentions, null where there are none."""
    return docs.join(resolve.mention_lists(mentions), "doc_id", "left")


def redact(docs: DataFrame, mentions: DataFrame, pack: dict, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and applied documents (doc_id, text, output, edits, guard_ok).

    ``docs`` has doc_id, text and legal_area (null where unknown).
    """
    rows = with_mentions(docs.select("doc_id", "text", "legal_area"), mentions)
    decided = materialize(decide(rows, pack, OUTPUT | EDITS | GUARD | ENTITIES, strict=strict), "decided")  # read twice
    return entity_rows(decided), decided.select("doc_id", "text", "output", "edits", "guard_ok")
