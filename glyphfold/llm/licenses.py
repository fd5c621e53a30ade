"""License detection by ordered signature rules.

Rules are regular expressions over words, made from :data:`LICENSES` and
:data:`FORMS`: each license is looked for as an identifier tag, an address, a
notice, a title and a passage of its text.  A rule carries a keyword; one scan
of a text for all keywords decides which rules run at all.  Detections are word
intervals with a priority.  Going by priority, then length, then rule order, a
detection that lies inside a kept one is suppressed, so that "GNU Lesser
General Public License" is not also a mention of something shorter.

Phrases of the base list are found beside the rules and never suppressed.

A text is scanned whole and by itself, so nothing is shuffled.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows
are judged each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphfold.llm.bytescan import PLAIN, word_bounds

#: Phrases whose places are always reported, and their labels.
BASE_PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: (label, identifiers, names, address parts, passages): words of a name in order; | separates variants.
LICENSES: list[tuple[str, str, str, str, str]] = [
    ("mit", "mit|x11", "mit license|mit licence|mit x11 license|expat license|mit open source license", "opensource org licenses mit|mit license org", "permission is hereby granted free of charge to any person obtaining a copy of this software|without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mit-0", "mit 0", "mit no attribution license|mit no attribution", "opensource org licenses mit 0", ""),
    ("apache-2", "apache 2 0", "apache license version 2 0|apache license version 2|apache license 2 0|apache license v2|apache 2 0 license|apache software license version 2 0|asl 2 0", "apache org licenses license 2 0|opensource org licenses apache 2 0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis|you may not use this file except in compliance with the license"),
    ("apache-1.1", "apache 1 1", "apache software license version 1 1|apache license version 1 1", "apache org licenses license 1 1", ""),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause license|simplified bsd license|2 clause bsd license|freebsd license", "opensource org licenses bsd 2 clause", ""),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause license|new bsd license|modified bsd license|3 clause bsd license|revised bsd license", "opensource org licenses bsd 3 clause", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("bsd", "bsd", "bsd license|bsd style license|berkeley software distribution license", "opensource org licenses bsd license", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "isc", "isc license|internet systems consortium license", "opensource org licenses isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "zlib", "zlib license|zlib libpng license", "opensource org licenses zlib|zlib net zlib license", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("gpl-3", "gpl 3 0|gpl 3 0 only|gpl 3 0 or later", "gnu general public license version 3|gnu general public license v3|gnu gpl version 3|gnu gpl v3|gpl version 3|gpl v3|gplv3", "gnu org licenses gpl 3 0|opensource org licenses gpl 3 0", ""),
    ("gpl-2", "gpl 2 0|gpl 2 0 only|gpl 2 0 or later", "gnu general public license version 2|gnu general public license v2|gnu gpl version 2|gnu gpl v2|gpl version 2|gpl v2|gplv2", "gnu org licenses gpl 2 0|gnu org licenses old licenses gpl 2 0", ""),
    ("gpl", "gpl", "gnu general public license|gnu gpl", "gnu org licenses gpl|gnu org copyleft gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl-3", "lgpl 3 0|lgpl 3 0 only|lgpl 3 0 or later", "gnu lesser general public license version 3|gnu lgpl version 3|lgpl version 3|lgplv3", "gnu org licenses lgpl 3 0", ""),
    ("lgpl-2.1", "lgpl 2 1|lgpl 2 1 only|lgpl 2 1 or later", "gnu lesser general public license version 2 1|gnu lgpl version 2 1|lgpl version 2 1|lgplv2 1", "gnu org licenses old licenses lgpl 2 1|gnu org licenses lgpl 2 1", ""),
    ("lgpl", "lgpl", "gnu lesser general public license|gnu library general public license|gnu lgpl", "gnu org licenses lgpl", "this library is free software you can redistribute it and or modify it"),
    ("agpl-3", "agpl 3 0|agpl 3 0 only|agpl 3 0 or later", "gnu affero general public license version 3|gnu affero general public license|affero general public license|gnu agpl|agplv3", "gnu org licenses agpl", ""),
    ("fdl", "gfdl 1 3|gfdl 1 2", "gnu free documentation license", "gnu org licenses fdl", ""),
    ("mpl-2", "mpl 2 0", "mozilla public license version 2 0|mozilla public license v 2 0|mozilla public license 2 0|mpl 2 0", "mozilla org mpl 2 0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mpl 1 1|mpl 1 0", "mozilla public license version 1 1|mozilla public license", "mozilla org mpl", ""),
    ("epl-2", "epl 2 0", "eclipse public license version 2 0|eclipse public license v2 0|eclipse public license 2 0", "eclipse org legal epl 2 0", ""),
    ("epl", "epl 1 0", "eclipse public license version 1 0|eclipse public license", "eclipse org legal epl v10", ""),
    ("cddl", "cddl 1 0|cddl 1 1", "common development and distribution license", "opensource org licenses cddl", ""),
    ("cpl", "cpl 1 0", "common public license version 1 0|common public license", "opensource org licenses cpl", ""),
    ("artistic-2", "artistic 2 0", "artistic license version 2 0|artistic license 2 0", "opensource org licenses artistic 2 0|perlfoundation org artistic license 2 0", ""),
    ("artistic", "artistic 1 0", "artistic license", "opensource org licenses artistic license", ""),
    ("boost", "bsl 1 0", "boost software license version 1 0|boost software license", "boost org license 1 0", ""),
    ("unlicense", "unlicense", "the unlicense|unlicense", "unlicense org", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "wtfpl net", ""),
    ("python", "python 2 0|psf 2 0", "python software foundation license|psf license agreement", "docs python org license", ""),
    ("postgresql", "postgresql", "postgresql license", "opensource org licenses postgresql", ""),
    ("openssl", "openssl", "openssl license", "openssl org source license", ""),
    ("upl", "upl 1 0", "universal permissive license", "opensource org licenses upl", ""),
    ("eupl", "eupl 1 2|eupl 1 1", "european union public licence|european union public license", "eupl eu", ""),
    ("osl", "osl 3 0", "open software license version 3 0|open software license", "opensource org licenses osl 3 0", ""),
    ("ms-pl", "ms pl", "microsoft public license", "opensource org licenses ms pl", ""),
    ("ofl", "ofl 1 1", "sil open font license version 1 1|sil open font license|open font license", "scripts sil org ofl", ""),
    ("odbl", "odbl 1 0", "open database license|open data commons open database license", "opendatacommons org licenses odbl", ""),
    ("cc0", "cc0 1 0", "cc0 1 0 universal|cc0 license|creative commons zero|cc0", "creativecommons org publicdomain zero", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "cc by 4 0|cc by 3 0|cc by 2 0", "creative commons attribution license|creative commons attribution 4 0 international license|creative commons attribution 4 0|creative commons attribution 3 0|cc by 4 0|cc by 3 0|cc by", "creativecommons org licenses by", ""),
    ("cc-by-sa", "cc by sa 4 0|cc by sa 3 0", "creative commons attribution sharealike|creative commons attribution share alike|cc by sa 4 0|cc by sa", "creativecommons org licenses by sa", ""),
    ("cc-by-nd", "cc by nd 4 0", "creative commons attribution noderivatives|creative commons attribution no derivatives|cc by nd 4 0|cc by nd", "creativecommons org licenses by nd", ""),
    ("cc-by-nc", "cc by nc 4 0|cc by nc 3 0", "creative commons attribution noncommercial|creative commons attribution non commercial|cc by nc 4 0|cc by nc 3 0|cc by nc", "creativecommons org licenses by nc", ""),
    ("cc-by-nc-sa", "cc by nc sa 4 0", "creative commons attribution noncommercial sharealike|creative commons attribution non commercial share alike|cc by nc sa 4 0|cc by nc sa", "creativecommons org licenses by nc sa", ""),
    ("cc-by-nc-nd", "cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives|creative commons attribution non commercial no derivatives|cc by nc nd 4 0|cc by nc nd", "creativecommons org licenses by nc nd", ""),
    ("public-domain", "", "public domain", "", "this work is in the public domain|dedicated to the public domain|released into the public domain"),
    ("proprietary", "", "proprietary license|commercial license|proprietary and confidential", "", "all rights reserved|unauthorized copying of this file via any medium is strictly prohibited"),
]

VERBS = "licensed|licenced|released|distributed|available|published|provided|covered|shared|offered|redistributable"

#: (form, pattern around {}, priority, confidence); an earlier form wins a tie.
FORMS: list[tuple[str, str, int, float]] = [
    ("tag", "spdx license identifier {}", 100, 1.0),
    ("address", "{}", 90, 0.95),
    ("passage", "{}", 80, 0.95),
    ("notice", f"(?:{VERBS}) (?:(?:publicly|freely|only|to you) )?(?:under|with|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{{}}", 70, 0.9),
    ("grant", "(?:subject to|governed by|in accordance with|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", 60, 0.85),
    ("field", "(?:license|licence|licensing|copyright) (?:is )?(?:the )?{}", 50, 0.8),
    ("mention", "{}", 20, 0.5),
]


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    form: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    confidence: float


_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BEFORE, _AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


def _over_words(pattern: str) -> re.Pattern:
    return re.compile(_BEFORE + b"(?:" + pattern.encode().replace(b" ", _GAP) + b")" + _AFTER)


def _keyword(words: str) -> bytes:
    """The longest word of a phrase; every match holds it."""
    return max(words.split(), key=len).encode()


def build_rules() -> list[Rule]:
    """All rules in order: by license, form and variant."""
    rules: list[Rule] = []
    for label, tags, names, addresses, passages in LICENSES:
        variants = {"tag": tags, "address": addresses, "passage": passages}
        for form, around, priority, confidence in FORMS:
            for words in filter(None, variants.get(form, names).split("|")):
                pattern = _over_words(around.format(words))
                rules.append(Rule(len(rules), label, form, _keyword(words), pattern, priority, confidence))
    return rules


class Scanner:
    """The compiled rules; one for each task."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES) -> None:
        self.rules = build_rules()
        self.base = [(label, _over_words(words)) for words, label in base.items()]
        self.base_words = re.compile(b"|".join(sorted({re.escape(_keyword(w)) for w in base})))
        by_keyword: dict[bytes, list[Rule]] = {}
        for rule in self.rules:
            by_keyword.setdefault(rule.keyword, []).append(rule)
        self.by_keyword = by_keyword
        self.keywords = re.compile(_BEFORE + b"(?:" + b"|".join(map(re.escape, sorted(by_keyword))) + b")" + _AFTER)

    def scan(self, text: str | None) -> dict:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        starts, _ = word_bounds(data, PLAIN)
        found = {"n_words": len(starts), "base": [], "detections": []}
        if self.base_words.search(data):
            for label, pattern in self.base:
                places = [m.start() for m in pattern.finditer(data)]
                found["base"] += [(label, int(i)) for i in np.searchsorted(starts, places)]
        hits = []
        for keyword in sorted(set(self.keywords.findall(data))):
            for rule in self.by_keyword[keyword]:
                for match in rule.pattern.finditer(data):
                    first, last = np.searchsorted(starts, [match.start(), match.end()])
                    hits.append((-rule.priority, int(first) - int(last), rule.order, int(first), int(last), rule))
        kept: list[tuple[int, int, Rule]] = []
        ends: dict[int, int] = {}  # the furthest end of the kept detections that start at a word
        longest = 0
        for *_, first, last, rule in sorted(hits, key=lambda h: h[:4]):
            if not any(ends.get(at, -1) >= last for at in range(max(0, last - longest), first + 1)):
                kept.append((first, last, rule))
                ends[first] = max(ends.get(first, -1), last)
                longest = max(longest, last - first)
        found["detections"] = sorted(((a, b, r.label, r.form, r.confidence) for a, b, r in kept))
        return found


DETECTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("form", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row."""
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_base", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("detections", DETECTION),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = ["first_word", "end_word", "label", "form", "confidence"]
        inner = pa.list_(
            pa.struct(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()], strict=True)))
        )
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), inner]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = scanner.scan(text.as_py())
                base = sorted({label for label, _ in found["base"]})
                places = [at for _, at in found["base"]]
                labels = sorted({*base, *(d[2] for d in found["detections"])})
                score = max([1.0 if base else 0.0, *(d[4] for d in found["detections"])])
                rows.append(
                    (
                        found["n_words"],
                        len(places),
                        min(places, default=None),
                        max(places, default=None),
                        ",".join(base),
                        ",".join(labels),
                        score,
                        [dict(zip(names, d, strict=True)) for d in found["detections"]],
                    )
                )
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("detections")
