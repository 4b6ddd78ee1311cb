"""License scans by sentence rules: sentences become identifiers, sequences of identifiers become licences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, in normal form (lower case, runs of other characters as one blank).
SENTENCES = {
    "agpl-3-is": "this work is licensed under the gnu affero general public license version 3",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2-is": "licensed under the apache license version 2 0",
    "apache-2-file": "you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-is": "released under the bsd license",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-is": "licensed under cc by 4 0",
    "cc-by-nc-is": "licensed under cc by nc 4 0",
    "cc-by-sa-is": "licensed under cc by sa 4 0",
    "cc0-is": "released under cc0 1 0",
    "copying-free": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "epl-2-is": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-is": "this work is licensed under the gnu general public license version 2",
    "gpl-3-is": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-is": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2-is": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "proprietary": "this software is proprietary and confidential",
    "public-domain": "this work is in the public domain",
    "reserved": "all rights reserved",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Other wordings of known sentences, in normal form, as the official notices have them.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": "apache-2-is",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}

#: Rules in the order in which they are tried; the first whose sequence stands at a place wins there.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-disclaimer")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-is", "apache-2-file", "apache-2-copy", "apache-2-as-is")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("EPL-2.0", ("epl-2-is",)),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("Apache-2.0", ("apache-2-is",)),
    ("AGPL-3.0-only", ("agpl-3-is",)),
    ("BSD", ("bsd-is",)),
    ("CC-BY-4.0", ("cc-by-is",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-is",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-is",)),
    ("CC0-1.0", ("cc0-is",)),
    ("GPL-2.0-only", ("gpl-2-is",)),
    ("GPL-3.0-only", ("gpl-3-is",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-is",)),
    ("MPL-2.0", ("mpl-2-is",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("proprietary",)),
    ("All-Rights-Reserved", ("reserved",)),
)

_OTHER = re.compile(r"[^0-9a-z]+")
#: A mark ends a sentence after something else than white space or the marks that decorate comments.
_END = re.compile(r"(?<=[^\s;#/*-][.!?;:])(?=\s)|\n[^\S\n]*\n")
#: Marks inside a known sentence: what they cut may go on in the next piece.
_GOES_ON = re.compile(r"(?:[;:]|\bv\.)\Z", re.IGNORECASE)
#: Pieces of one sentence at most.
PIECES = 3
_LINE_END = re.compile(r"(?<=[^\s;#/*-][.!?;:])(?=\s)|\n")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def check_rules(sentences: dict[str, str], rules) -> str:
    """A pattern of words of which each known sentence has at least one; fails on rules that cannot match."""
    for name, ids in rules:
        if not ids or any(i not in sentences for i in ids):
            raise ValueError(f"rule {name} has no or unknown sentences")
    if any(s != normalise(s) or not s for s in sentences.values()):
        raise ValueError("a sentence is not in normal form")
    # Long words first, as they are rare in other text; of these, one that covers many sentences.
    left, words = set(sentences.values()), []
    while left:
        counts: dict[str, int] = {}
        for s in left:
            for w in set(s.split()):
                if len(w) >= 4:
                    counts[w] = counts.get(w, 0) + 1
        if not counts:
            raise ValueError("a sentence has no word of four letters")
        word = max(counts, key=lambda w: (min(len(w), 6), counts[w], len(w), w))
        words.append(word)
        left = {s for s in left if word not in s.split()}
    return "|".join(map(re.escape, words))


class Recognizer:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        known = {s: i for i, s in sentences.items()}
        self.ids = known | {s: i for s, i in VARIANTS.items() if i in sentences and s not in known}
        self.rules = rules
        anchors = check_rules(sentences | {f"{i} {k}": s for k, (s, i) in enumerate(self.ids.items())}, rules)
        self.anchor = re.compile(anchors, re.IGNORECASE)

    def sentences(self, text: str) -> list[tuple[int, str]]:
        """(place, identifier) of every known sentence, in order. A sentence ends at a mark before white space and at an
        empty line; a line's end closes one too if what it closes is known. Pieces cut at a mark that known sentences have
        inside are also read together."""
        anchors = [m.start() for m in self.anchor.finditer(text)]
        if not anchors:
            return []
        found: dict[int, str] = {}
        for cut in (_LINE_END, _END):
            at, k = 0, 0
            ends = [(m.start(), m.end()) for m in cut.finditer(text)] + [(len(text), len(text))]
            begins: list[int] = []  # of pieces that lead up to this one by marks inside a sentence
            for end, after in ends:
                while k < len(anchors) and anchors[k] < at:
                    k += 1
                begins = [*begins[1 - PIECES :], at]
                for begin in begins:  # the longest first
                    if not (k < len(anchors) and anchors[k] < end or begin < at and self.anchor.search(text, begin, at)):
                        continue
                    name = self.ids.get(normalise(text[begin:end]))
                    if name:
                        found.setdefault(begin + len(text[begin:end]) - len(text[begin:end].lstrip()), name)
                        break
                if after > end or not _GOES_ON.search(text, max(at, end - 3), end):
                    begins = []
                at = after
        return sorted(found.items())

    def licenses(self, ids: list[str]) -> list[str]:
        """Rules tried in order at each place of the sequence; what a rule takes is not matched again."""
        out, at = [], 0
        while at < len(ids):
            for name, rule in self.rules:
                if tuple(ids[at : at + len(rule)]) == rule:
                    out.append(name)
                    at += len(rule)
                    break
            else:
                at += 1
        return out


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """id, n_sentences (known ones), sentence_ids and license_ids (in the text's order), licenses (distinct, sorted).

    One row per row of df. Defined cases: a null or empty text, or one without known sentences, has empty lists; texts
    are read whole; repeated rows are each scanned; an empty table gives no rows; other columns are ignored whatever
    their names; two rules that fit at one place: the first in order.
    """
    recognizer = Recognizer(sentences, rules)
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            seen = [[i for _, i in recognizer.sentences(t.as_py() or "")] for t in batch.column(1)]
            named = [recognizer.licenses(x) for x in seen]
            lists = pa.list_(pa.string())
            columns = [pa.array([len(x) for x in seen], pa.int64()), pa.array(seen, lists), pa.array(named, lists), pa.array([",".join(sorted(set(x))) for x in named], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_sentences", "sentence_ids", "license_ids", "licenses"])

    schema = f"id {kind}, n_sentences long, sentence_ids array<string>, license_ids array<string>, licenses string"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
