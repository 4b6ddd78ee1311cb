"""Span algebra: arrays of struct<start, end, text> with half-open code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import words

SPAN = "struct<start:int,end:int,text:string>"


#: A character that stands around matches while they are marked; no character of Unicode text has this code.
_EDGE = "\uffff"


def find(text: Column, pattern: Column | str, group: int | None = None) -> Column:
    """All matches, left to right: their offsets, and their text or that of a group.

    JVM offsets count UTF-16 units, so offsets are sums of the lengths of what lies between matches and of the matches.
    The pattern runs once: matches are marked and the text is split at the marks. A text that has the mark itself is
    searched and split by the pattern instead.
    """
    rx = F.lit(P.java(pattern)) if isinstance(pattern, str) else pattern
    width = 2 if group is None else 3  # a gap, a match and its group
    shown = "$0" + _EDGE if group is None else f"$0{_EDGE}${group}{_EDGE}"
    parts = F.split(F.regexp_replace(text, rx, F.lit(_EDGE + shown)), F.lit(_EDGE), -1)

    def triples(p: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(p) - 1, F.lit(width)), lambda k: k + 1 < F.size(p))
        return F.transform(places, lambda k: F.struct(F.char_length(F.get(p, k)).alias("gap"), F.get(p, k + 1).alias("h"), F.get(p, k + width - 1).alias("s")))

    # Bound to a variable of a function, the parts are computed once and not for each of them.
    marked = F.get(F.transform(F.array(parts), triples), 0)
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    own = hits if group is None else F.regexp_extract_all(text, rx, F.lit(group))
    split = F.zip_with(F.split(text, rx, -1), F.arrays_zip(hits.alias("h"), own.alias("s")), lambda g, h: F.struct(F.char_length(g).alias("gap"), h["h"].alias("h"), h["s"].alias("s")))
    split = F.filter(split, lambda x: x["h"].isNotNull())
    pieces = F.when(F.contains(text, F.lit(_EDGE)), split).otherwise(marked)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["h"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x["s"].alias("text"))).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(pieces, start, step, lambda acc: acc["out"]))


def surface(name: Column, suffix: Column | str = "") -> Column:
    """The Java pattern of a name with any white space between its words and no word character around it."""
    suffix = F.lit(suffix) if isinstance(suffix, str) else suffix
    quoted = F.transform(words(name), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E")))
    return F.concat(F.lit(P.UNIX + P.NOT_AFTER_WORD), F.array_join(quoted, f"[{P.S}]+"), suffix, F.lit(P.NOT_BEFORE_WORD))


def occurs(text: Column, name: Column) -> Column:
    """Whether a name occurs in the text."""
    return F.regexp_like(text, surface(name))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def greedy(spans: Column, kind: str) -> Column:
    """Longest spans first, then earliest, then first in order (field ``seq``); those that overlap a chosen one go. By start."""
    ordered = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k1"), s["start"].alias("k2"), s["seq"].alias("k3"), s.alias("s")))
    # A linear check against all chosen spans: documents have few edits.
    chosen = F.aggregate(
        F.array_sort(ordered),
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when(F.exists(acc, lambda c: overlaps(c, x["s"])), acc).otherwise(F.array_append(acc, x["s"])),
    )
    by_start = F.transform(chosen, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))
    return F.transform(F.array_sort(by_start), lambda x: x["s"])


def first_come(spans: Column, taken: Column, kind: str) -> Column:
    """Spans in order of ``seq`` that overlap neither the taken ones nor one accepted before; by start."""
    ordered = F.transform(spans, lambda s: F.struct(s["seq"].alias("k"), s.alias("s")))
    accepted = F.aggregate(
        F.array_sort(ordered),
        F.array().cast(f"array<{kind}>"),
        lambda acc, x: F.when(F.exists(acc, lambda c: overlaps(c, x["s"])) | F.exists(taken, lambda c: overlaps(c, x["s"])), acc).otherwise(F.array_append(acc, x["s"])),
    )
    by_start = F.transform(accepted, lambda s: F.struct(s["start"].alias("k"), s["seq"].alias("q"), s.alias("s")))
    return F.transform(F.array_sort(by_start), lambda x: x["s"])


def splice(text: Column, edits: Column) -> Column:
    """The text with each edit's span replaced; edits are ordered and don't overlap."""
    parts = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, e: F.struct(e["end"].cast("int").alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"])).alias("out")),
        lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.char_length(text)))),
    )
    return F.array_join(parts, "")


def untouched(original: Column, output: Column, edits: Column) -> Column:
    """Whether the output equals the original outside the edits and has their replacements in them."""
    state = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(True).alias("ok")),
        lambda acc, e: F.struct(
            e["end"].cast("int").alias("o"),
            (acc["p"] + (e["start"] - acc["o"]) + F.char_length(e["replacement"])).cast("int").alias("p"),
            (
                acc["ok"]
                & (F.substring(output, acc["p"] + 1, e["start"] - acc["o"]) == F.substring(original, acc["o"] + 1, e["start"] - acc["o"]))
                & (F.substring(output, acc["p"] + (e["start"] - acc["o"]) + 1, F.char_length(e["replacement"])) == e["replacement"])
            ).alias("ok"),
        ),
    )
    rest = F.substring(output, state["p"] + 1, F.char_length(output)) == F.substring(original, state["o"] + 1, F.char_length(original))
    return state["ok"] & rest


def to_output(position: Column, edits: Column) -> Column:
    """The place in the output of a place in the original that lies in no edit."""
    return F.aggregate(
        F.filter(edits, lambda e: e["end"] <= position),
        F.lit(0).cast("int"),
        lambda acc, e: (acc + F.char_length(e["replacement"]) - (e["end"] - e["start"])).cast("int"),
        lambda acc: (acc + position).cast("int"),
    )


def to_original(position: Column, edits: Column) -> Column:
    """The place in the original of a place in the output; inside a replacement, the edit's start if exactly there, else its end."""
    state = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("delta"), F.lit(None).cast("int").alias("found")),
        lambda acc, e: F.struct(
            (acc["delta"] + F.char_length(e["replacement"]) - (e["end"] - e["start"])).cast("int").alias("delta"),
            F.coalesce(
                acc["found"],
                F.when(position < e["start"] + acc["delta"], position - acc["delta"])
                .when(position == e["start"] + acc["delta"], e["start"])
                .when(position < e["start"] + acc["delta"] + F.char_length(e["replacement"]), e["end"])
                .cast("int"),
            ).alias("found"),
        ),
    )
    return F.coalesce(state["found"], position - state["delta"])


def chunks(text: Column, size: int = 6000) -> Column:
    """array<struct<start, end>> of windows of about ``size`` characters, cut after the last line feed of their second half."""
    length = F.char_length(text)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        end = F.least(length, at + size)
        half = F.substring(text, at + size // 2 + 1, F.lit(size - size // 2))
        cut = end - F.locate("\n", F.reverse(half)) + 1
        stop = F.when((end < length) & F.contains(half, F.lit("\n")), cut).otherwise(end).cast("int")
        grown = F.struct(stop.alias("at"), F.array_append(acc["out"], F.struct(at.alias("start"), stop.alias("end"))).alias("out"))
        return F.when(at >= length, acc).otherwise(grown)

    # No window is shorter than half the size plus one, which bounds the number of steps.
    steps = F.sequence(F.lit(0), F.ceil(length / (size // 2 + 1)).cast("int"))
    return F.when(length > 0, F.aggregate(steps, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
