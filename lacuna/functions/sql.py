"""The detectors as functions of SQL: ``detect_spans(text)`` and the table function ``redact(text)``.

SQL has no name for an expression tree, so these two run in Python workers, ``detect_spans`` in Arrow batches; the patterns are
the same as those of the DataFrame functions, in their own dialect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import patterns as P

SPANS = "array<struct<start:int,end:int,text:string,type:string>>"


def scan(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, text, type) of the structured identifiers of a text, in the detectors' order."""
    if text is None:
        return []
    found = [(*m.span(), m[0], kind) for kind, rx in P.DETECTORS for m in re.finditer(rx, text)]
    found += [(*m.span(1), m[1], "parcel_number") for m in re.finditer(P.PARCEL, text)]
    plates = (m for m in re.finditer(P.PLATE, text) if re.search(P.PLATE_CUE, text[max(0, m.start() - 60) : m.start()]))
    found += [(*m.span(), m[0], "identifier") for m in plates]
    return [(s, e, " ".join(t.split()), kind) for s, e, t, kind in found]


def covered(text: str | None, removed: str = "[…]") -> tuple[str | None, int]:
    """The text with what the detectors find removed, longest spans first, and the number of edits."""
    chosen: list[tuple[int, int]] = []
    for start, end, *_ in sorted(scan(text), key=lambda x: (x[0] - x[1], x[0])):
        if all(end <= a or start >= b for a, b in chosen):
            chosen.append((start, end))
    pieces, at = [], 0
    for start, end in sorted(chosen):
        pieces += [text[at:start], removed]
        at = end
    return (None if text is None else "".join([*pieces, text[at:]])), len(chosen)


class Redact:
    def eval(self, text: str):
        yield covered(text)


def register(spark: SparkSession) -> None:
    """Make both functions known to the session."""

    @F.pandas_udf(SPANS)
    def detect_spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(("start", "end", "text", "type"), x, strict=True)) for x in scan(t)])

    spark.udf.register("detect_spans", detect_spans)
    spark.udtf.register("redact", F.udtf(Redact, returnType="output string, n_edits int"))
