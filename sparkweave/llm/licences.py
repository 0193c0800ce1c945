"""License scan: ordered signature rules over whole texts.

A rule is a regular expression with a keyword and a priority.  Only rules
whose keyword occurs in a text are tried on it.  Detections are taken by
priority, then length, then place; one that lies within a detection already
taken is suppressed, so "version 3 or later" hides the bare title inside it.

Beside the rules, a list of base phrases is counted as runs of whole words.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sparkweave.llm import bytesnp
from sparkweave.session import share_code

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GAP = rb"[^0-9a-z\x80-\xff]+"
_OPEN, _CLOSE = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
#: How certain a detection is, by priority.
CERTAIN = {5: 0.99, 4: 0.95, 3: 0.85, 2: 0.7, 1: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern[bytes]
    keyword: bytes
    priority: int


def _words(text: str) -> bytes:
    """A title as a pattern: its words (which may be patterns) with any gap between them."""
    return _OPEN + _GAP.join(w.encode() for w in text.split()) + _CLOSE


def _optional(title: str) -> str:
    """Spaces within optional groups become patterns, so that a title splits at the others only."""
    return re.sub(r"\([^()]*\)", lambda m: m[0].replace(" ", r"\s"), title)


def _version(v: str) -> str:
    """A version as words or joined: 2.0 also as 2 where the last part is 0."""
    major, _, minor = v.partition(".")
    if minor == "0":
        return rf"v?\.?{major}(?:\.0)?(?!\.?[0-9])"
    return rf"v?\.?{major}\.{minor}" if minor else rf"v?\.?{major}(?!\.?[0-9])"


# Families, their titles, abbreviations and versions.
_GNU = {
    "gpl": ("general public licen[cs]e", "gpl", ["1.0", "2.0", "3.0"]),
    "lgpl": ("(?:lesser|library) general public licen[cs]e", "lgpl", ["2.0", "2.1", "3.0"]),
    "agpl": ("affero general public licen[cs]e", "agpl", ["1.0", "3.0"]),
    "gfdl": ("free documentation licen[cs]e", "gfdl", ["1.1", "1.2", "1.3"]),
}
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv[a-z]*", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv[a-z]*"}
_CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
_VERSIONED = {
    "apache": ("apache (?:software )?licen[cs]e", "apache", ["1.0", "1.1", "2.0"]),
    "mpl": ("mozilla public licen[cs]e", "mpl", ["1.0", "1.1", "2.0"]),
    "epl": ("eclipse public licen[cs]e", "epl", ["1.0", "2.0"]),
    "cddl": ("common development and distribution licen[cs]e", "cddl", ["1.0", "1.1"]),
    "cpl": ("common public licen[cs]e", "cpl", ["1.0"]),
    "eupl": ("european union public licen[cs]e", "eupl", ["1.0", "1.1", "1.2"]),
    "osl": ("open software licen[cs]e", "osl", ["1.0", "2.0", "2.1", "3.0"]),
    "afl": ("academic free licen[cs]e", "afl", ["1.2", "2.0", "2.1", "3.0"]),
    "artistic": ("artistic licen[cs]e", "artistic", ["1.0", "2.0"]),
    "bsl": ("boost software licen[cs]e", "bsl", ["1.0"]),
    "busl": ("business source licen[cs]e", "busl", ["1.1"]),
    "elastic": ("elastic licen[cs]e", "elastic", ["1.0", "2.0"]),
    "sspl": ("server side public licen[cs]e", "sspl", ["1.0"]),
    "ofl": ("open font licen[cs]e", "ofl", ["1.0", "1.1"]),
    "odbl": ("open data(?:base| commons open database) licen[cs]e", "odbl", ["1.0"]),
    "php": ("php licen[cs]e", "php", ["3.0", "3.01"]),
    "psf": ("python software foundation licen[cs]e", "psf", ["2.0"]),
    "zpl": ("zope public licen[cs]e", "zpl", ["1.1", "2.0", "2.1"]),
    "lppl": ("latex project public licen[cs]e", "lppl", ["1.0", "1.1", "1.2", "1.3"]),
    "cecill": ("cecill(?: free software)? licen[cs]e", "cecill", ["1.0", "1.1", "2.0", "2.1"]),
    "qpl": ("q public licen[cs]e", "qpl", ["1.0"]),
    "apsl": ("apple public source licen[cs]e", "apsl", ["1.0", "1.1", "1.2", "2.0"]),
    "ipl": ("ibm public licen[cs]e", "ipl", ["1.0"]),
    "npl": ("netscape public licen[cs]e", "npl", ["1.0", "1.1"]),
    "rpl": ("reciprocal public licen[cs]e", "rpl", ["1.1", "1.5"]),
    "ecl": ("educational community licen[cs]e", "ecl", ["1.0", "2.0"]),
    "vsl": ("vovida software licen[cs]e", "vsl", ["1.0"]),
    "upl": ("universal permissive licen[cs]e", "upl", ["1.0"]),
    "mulan-psl": ("mulan (?:permissive software|psl) licen[cs]e", "mulanpsl", ["1.0", "2.0"]),
}
_PLAIN = {
    "mit": "(?:mit|expat) licen[cs]e",
    "mit-0": "mit no attribution",
    "x11": "x11 licen[cs]e",
    "isc": "isc licen[cs]e",
    "zlib": "zlib(?: libpng)? licen[cs]e",
    "ncsa": "(?:university of illinois )?ncsa open source licen[cs]e",
    "postgresql": "postgresql licen[cs]e",
    "openssl": "openssl licen[cs]e",
    "vim": "vim licen[cs]e",
    "ruby": "ruby licen[cs]e",
    "curl": "curl licen[cs]e",
    "unicode": "unicode (?:data files and software )?licen[cs]e",
    "w3c": "w3c software(?: and document)? (?:notice and )?licen[cs]e",
    "wtfpl": "do what the f[a-z*]+ you want to public licen[cs]e",
    "beerware": "beer-?ware licen[cs]e",
    "sleepycat": "sleepycat licen[cs]e",
    "ms-pl": "microsoft public licen[cs]e",
    "ms-rl": "microsoft reciprocal licen[cs]e",
    "json": "json licen[cs]e",
    "ntp": "ntp licen[cs]e",
    "hippocratic": "hippocratic licen[cs]e",
    "commons-clause": "commons clause licen[cs]e condition",
    "bsd": "(?:new |revised |simplified |modified )?bsd(?: style)? licen[cs]e",
    "public-domain": "licen[cs]ed? (?:in|to|into) the public domain",
}
_SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", b"hereby granted", 4),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", b"permission notice", 3),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", b"permission to use", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", b"redistribution and use", 3),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors", b"neither the name", 4),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", b"advertising materials", 4),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", b"express or implied", 3),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", b"applicable law", 4),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", b"source code form", 5),
    ("unlicense", "this is free and unencumbered software released into the public domain", b"unencumbered", 5),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", b"hereby granted", 5),
    ("gpl", "this program is free software you can redistribute it and or modify it", b"free software", 3),
    ("lgpl", "this library is free software you can redistribute it and or modify it", b"free software", 3),
    ("public-domain", "dedicated to the public domain", b"public domain", 2),
    ("public-domain", "released into the public domain", b"public domain", 2),
    ("all-rights-reserved", "all rights reserved", b"rights reserved", 1),
    ("proprietary", "proprietary and confidential", b"proprietary", 2),
    ("proprietary", r"unauthorized (?:copying|use|distribution)[a-z\s,]{0,40} is strictly prohibited", b"strictly prohibited", 2),
    ("license-notice", "licen[cs]ed under", b"licen", 1),
]


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which they are tried."""
    found: list[tuple[str, bytes, bytes, int]] = []
    spdx: list[str] = []
    for name, (title, short, versions) in chain(_GNU.items(), _VERSIONED.items()):
        gnu = name in _GNU
        full = rf"(?:gnu\s+)?{title}" if gnu else title.replace("(?:software )?", r"(?:software\s+)?").replace("(?: free software)?", r"(?:\s+free\s+software)?")
        found.append((name, _words(full), b"licen", 2))
        for v in versions:
            ver, label = _version(v), f"{name}-{v}"
            spdx.append(label)
            body = _words(full) + rb"[^0-9a-z\x80-\xff]*(?:version|ver|v)?[^0-9a-z\x80-\xff]*" + ver.encode()
            found.append((label, body + rb"(?![0-9])", b"licen", 3))
            if gnu:
                found.append((f"{label}-or-later", body + rb"[^0-9a-z\x80-\xff]*(?:of[^a-z]+the[^a-z]+licen[cs]e)?[^0-9a-z\x80-\xff]*or[^a-z]+(?:at[^a-z]+your[^a-z]+option[^a-z]+)?(?:any[^a-z]+)?later", b"later", 5))
                found.append((f"{label}-only", body + rb"[^0-9a-z\x80-\xff]+only" + _CLOSE, b"only", 5))
            found.append((label, _OPEN + short.encode() + rb"[ _-]*" + ver.encode() + rb"(?![0-9])", short.encode(), 3))
    for parts, title in _CC.items():
        long = _OPEN + rb"creative[^0-9a-z\x80-\xff]+commons[^0-9a-z\x80-\xff]+" + _GAP.join(w.encode() for w in title.replace(" ?", r"[-_\s]?").split())
        found.append((f"cc-{parts}", _OPEN + b"cc" + _GAP + _GAP.join(p.encode() for p in parts.split("-")) + _CLOSE, b"cc", 2))
        found.append((f"cc-{parts}", long, b"creative", 2))
        for v in _CC_VERSIONS:
            label, ver = f"cc-{parts}-{v}", re.escape(v).encode()
            spdx.append(label)
            found.append((label, _OPEN + b"cc" + _GAP + _GAP.join(p.encode() for p in parts.split("-")) + rb"[^0-9a-z\x80-\xff]*(?:v|version )?" + ver + rb"(?![0-9])", b"cc", 3 + parts.count("-") // 2))
            found.append((label, long + rb"[^0-9a-z\x80-\xff]+(?:international|unported|generic)?[^0-9a-z\x80-\xff]*" + ver + rb"(?![0-9])", b"creative", 4))
            found.append((label, rb"creativecommons\.org/licenses/" + parts.encode() + b"/" + ver, b"creativecommons", 5))
    found += [("cc0-1.0", _OPEN + rb"cc0(?:[ -]?1\.0)?" + _CLOSE, b"cc0", 3), ("cc0-1.0", rb"creativecommons\.org/publicdomain/zero/1\.0", b"creativecommons", 5)]
    for n in range(5):
        for head, priority in ((f"{n}", 3), (("zero", "one", "two", "three", "four")[n], 3)):
            found.append((f"bsd-{n}-clause", _words(f"{head} clause bsd(?: licen[cs]e)?"), b"bsd", priority))
        found.append((f"bsd-{n}-clause", _words(f"bsd {n} clause(?: licen[cs]e)?"), b"bsd", 3))
        spdx.append(f"bsd-{n}-clause")
    for label, title in _PLAIN.items():
        found.append((label, _words(_optional(title)), b"licen" if "licen" in title else title.split()[0].encode(), 3))
        spdx.append(label)
    found += [(label, _words(text.replace(".{1,80}?", "[^.]{1,80}?")) if "[^" not in text else _OPEN + text.replace(" ", r"\s+").encode(), keyword, priority) for label, text, keyword, priority in _SENTENCES]
    found += [(label, rb"spdx-license-identifier:\s*" + re.escape(label).encode() + rb"(?![0-9a-z.])", b"spdx", 5) for label in dict.fromkeys(spdx)]
    ordered = sorted(range(len(found)), key=lambda i: (-found[i][3], i))
    return tuple(Rule(label, re.compile(pattern), keyword, priority) for label, pattern, keyword, priority in (found[i] for i in ordered))


@cache
def _base() -> tuple[tuple[re.Pattern[bytes], bytes, str], ...]:
    return tuple((re.compile(_words(phrase)), max(phrase.encode().split(), key=len) if "cc" not in phrase else b"cc", label) for phrase, label in BASE.items())


def detect(data: bytes, tried: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Detections in a lower-cased text, with those inside a stronger or longer one suppressed."""
    found = [(m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(data)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    kept: list[tuple[int, int, Rule]] = []
    # The intervals kept that lie in no other one: with their starts their ends rise too.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in found:
        at = bisect_right(starts, start)
        if at and end <= ends[at - 1]:
            continue
        kept.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low : max(low, high)], ends[low : max(low, high)] = [start], [end]
    return sorted(kept, key=lambda d: (d[0], d[1]))


def scan(docs: DataFrame, text: str = "text", spans: bool = False) -> DataFrame:
    """Append the word count, base phrase places, labels and score of every whole text.

    ``score`` is the certainty of the strongest detection (0 without any).
    With ``spans`` the detections follow as an array.  Null texts are empty;
    columns of the added names are replaced.
    """
    share_code(docs.sparkSession)
    added = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    if spans:
        added.append(("spans", "array<struct<start:int,stop:int,label:string,priority:int>>"))
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in {n for n, _ in added}])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = rules()
        by_keyword: dict[bytes, list[Rule]] = {}
        for rule in ordered:
            by_keyword.setdefault(rule.keyword, []).append(rule)
        for batch in batches:
            rows = batch.num_rows
            buf, offs = bytesnp.flat(batch.column(batch.schema.get_field_index(text)))
            n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            first_word, last_word = [None] * rows, [None] * rows
            base, labels, score, places = [""] * rows, [""] * rows, np.zeros(rows), [[] for _ in range(rows)]
            for a, b in bytesnp.slices(offs):
                x = bytesnp.LOWER[buf[offs[a] : offs[b]]]
                own = offs[a : b + 1] - offs[a]
                starts, _, first = bytesnp.words(x, own, bytesnp.ALNUM)
                n_words[a:b] = np.diff(first)
                data = x.tobytes()
                gates: dict[int, list[bytes]] = {}
                for keyword in by_keyword:
                    at = data.find(keyword)
                    while at >= 0:
                        i = int(np.searchsorted(own, at, "right")) - 1
                        # A keyword that runs over the end of its row is none of the row's.
                        if at + len(keyword) <= own[i + 1]:
                            gates.setdefault(i, []).append(keyword)
                            at = data.find(keyword, int(own[i + 1]))
                        else:
                            at = data.find(keyword, at + 1)
                for i, keywords in gates.items():
                    piece = data[own[i] : own[i + 1]]
                    where, have = [], set()
                    for pattern, keyword, label in _base():
                        if keyword in piece:
                            got = [m.start() for m in pattern.finditer(piece)]
                            where += got
                            have |= {label} if got else set()
                    got = detect(piece, [r for k in keywords for r in by_keyword[k]])
                    if where:
                        n_base[a + i] = len(where)
                        first_word[a + i] = int(np.searchsorted(starts, own[i] + min(where)) - first[i])
                        last_word[a + i] = int(np.searchsorted(starts, own[i] + max(where)) - first[i])
                    base[a + i] = ",".join(sorted(have))
                    labels[a + i] = ",".join(sorted(have | {r.label for _, _, r in got}))
                    sure = max([CERTAIN[r.priority] for _, _, r in got] + [CERTAIN[2]] * bool(where), default=0.0)
                    score[a + i] = sure
                    places[a + i] = [{"start": s, "stop": e, "label": r.label, "priority": r.priority} for s, e, r in got]
            values = [pa.array(n_words), pa.array(n_base), pa.array(first_word, pa.int64()), pa.array(last_word, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score)]
            if spans:
                values.append(pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, *(n for n, _ in added)])

    return kept.mapInArrow(run, StructType([*kept.schema, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in added))]))
