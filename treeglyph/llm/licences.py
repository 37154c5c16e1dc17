"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and known licence sentences are mapped to identifiers. The identifiers of a text, in order, are then
matched against ordered rules: from the first identifier on, the first rule whose whole sequence follows names a licence and consumes
it; an identifier from which no rule goes on is passed over and reported as unmatched.

Comment marks at the start and end of lines count as blanks. Sentences end with a full stop, exclamation or question mark before white space, or at an
empty line, also one that has comment marks only; a line break alone does not end one, as licence texts are wrapped. A sentence is normalised by
lower-casing, squeezing white space and giving each licence of an SPDX expression a tag of its own.

A normalised sentence, or a part of one from one punctuation mark to another, has an identifier if it is a known one as a whole: patterns stand for known
sentences with variables, and have to match from end to end. Before them a few words may lead in ("this work is"), but none that turn the sense (not,
unless, formerly ...), and a question grants nothing. A sentence of several known parts gives several identifiers, in order of position; of parts that
overlap, those of the earlier pattern in the table. Spans are those of the sentences.

Null and empty texts have no sentences and give empty lists; repeated rows give repeated results; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# SPDX identifiers, and what the tables call some of them.
SPDX: tuple[str, ...] = tuple(
    """MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 MPL-2.0 EPL-1.0 EPL-2.0
    GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
    AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later""".split()
)
_SHORT = {"Apache-2.0": "apache-2", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "BSD-3-Clause": "bsd-3"}
_BY = r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?"
_QUOTED_AS_IS = "[\"'`]*as[ -]is[\"'`]*"
#: The GNU licences: start of an identifier, licence, what its text calls it, versions.
_GNU = (("agpl", "AGPL", "gnu affero general public licen[sc]e", ("3",)), ("lgpl", "LGPL", "gnu (?:lesser|library) general public licen[sc]e", ("3", "2.1", "2")), ("gpl", "GPL", "gnu general public licen[sc]e", ("3", "2")))
_LATER = r",? (?:or|and) (?:\(at your option\) )?(?:any )?later(?: versions?)?"


def _spdx(name: str) -> str:
    return "spdx-" + _SHORT.get(name, name.lower())


def _number(version: str) -> str:
    return version.replace(".", r"\.") + r"(?:\.0)?" * ("." not in version)


def _gnu_sentences() -> Iterator[tuple[str, str]]:
    for kind, _, name, versions in _GNU:
        for v in versions:
            line = rf"licensed under (?:the )?(?:terms of )?(?:the )?{name},? (?:version|v)? ?{_number(v)}"
            yield f"{kind}-{v}-line-later", line + _LATER
            yield f"{kind}-{v}-line", line + "(?: only)?"
            terms = rf"you can redistribute it and/or modify it under the terms of (?:version {_number(v)} of the {name}|the {name},? version {_number(v)})"
            yield f"{kind}-{v}-grant", terms + "(?: only)?(?:,? as published by the free software foundation)?"
        yield f"{kind}-grant", rf"you can redistribute it and/or modify it under the terms of the {name}(?: as published by the free software foundation)?"
        yield f"{kind}-received", rf"you should have received a copy of the {name}(?: along with this \w+)?"
    for v in ("3", "2.1", "2"):
        yield f"version-{v}-later", rf"(?:either )?version {_number(v)} of the licen[sc]e{_LATER}"
        yield f"version-{v}", rf"version {_number(v)} of the licen[sc]e"
    yield "gpl-hope", "distributed in the hope that it will be useful, but without any warranty"


# Identifiers of licence sentences, and the normalised sentences as patterns. Groups that may be missing are what copies leave out.
SENTENCES: tuple[tuple[str, str], ...] = (
    *((_spdx(x), rf"spdx-license-identifier: {re.escape(x.lower())}") for x in SPDX),
    ("apache-2-line", r"licensed under the apache license,? (?:version |v)?2(?:\.0)?(?: \(the .?license.?\))?"),
    ("apache-compliance", r"you may not use (?:this file|these files|this software) except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at(?: \S+)?"),
    ("apache-as-is", rf"(?:software )?distributed under the license is distributed on an {_QUOTED_AS_IS} basis"),
    ("apache-permissions", r"see the license for the specific language governing permissions(?: and limitations(?: under the license)?)?"),
    ("mit-line", _BY + r"mit(?:/x11)? licen[sc]e(?: \(mit\))?"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy(?: of this software and associated documentation files(?: \(the .software.\))?)?"),
    ("mit-notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included(?: in all copies or substantial portions of the software)?"),
    ("mit-as-is", rf"the software is provided {_QUOTED_AS_IS}, without warranty of any kind"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable(?: for any claim)?"),
    ("bsd-2-line", _BY + r"(?:simplified|2-clause|bsd 2-clause) (?:bsd )?licen[sc]e"),
    ("bsd-3-line", _BY + r"(?:new|modified|revised|3-clause|bsd 3-clause) (?:bsd )?licen[sc]e"),
    ("bsd-line", _BY + r"(?:a )?bsd(?:-style)? licen[sc]e"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are permitted(?: provided that the following conditions are met)?"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the names? of .{1,120}? may be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-as-is", rf"this software is provided by .{{1,80}}? {_QUOTED_AS_IS} and any express or implied warranties"),
    ("isc-grant", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", rf"the software is provided {_QUOTED_AS_IS} and the author disclaims all warranties with regard to this software(?: including all implied warranties of merchantability and fitness)?"),
    ("isc-line", _BY + r"isc licen[sc]e"),
    ("zlib-as-is", rf"this software is provided {_QUOTED_AS_IS}, without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost-line", r"distributed under the boost software license, version 1\.0"),
    ("unlicense-domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0-line", r"(?:released|licensed|dedicated to the public domain) under (?:the )?(?:cc0(?: 1\.0)?(?: universal)?|creative commons zero(?: v?1\.0)?(?: universal)?)(?: licen[sc]e)?"),
    *_gnu_sentences(),
    ("cc-by-nc-4", r"licensed under (?:a |the )?(?:cc by-nc 4\.0|creative commons attribution-noncommercial 4\.0)(?: international)?(?: licen[sc]e)?"),
    ("cc-by-sa-4", r"licensed under (?:a |the )?(?:cc by-sa 4\.0|creative commons attribution-sharealike 4\.0)(?: international)?(?: licen[sc]e)?"),
    ("cc-by-4", r"licensed under (?:a |the )?(?:cc by 4\.0|creative commons attribution 4\.0)(?: international)?(?: licen[sc]e)?"),
    ("mpl-2", r"(?:this source code form is )?subject to the terms of the mozilla public license, v\. 2\.0"),
    ("epl-2", r"under the terms of the eclipse public license,? (?:version |v\.? )?2\.0"),
)


def _steps(licence: str, needed: tuple[str, ...], *more: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """The rule with all that may follow what it needs, and then with less and less of that."""
    for n in range(len(more), -1, -1):
        yield licence, needed + more[:n]


def _gnu_rules() -> Iterator[tuple[str, tuple[str, ...]]]:
    for kind, licence, _, versions in _GNU:
        after = ("gpl-hope", f"{kind}-received")
        for v in versions:
            full = f"{licence}-{v if '.' in v else v + '.0'}"
            yield from _steps(f"{full}-or-later", (f"{kind}-grant", f"version-{v}-later"), *after)
            yield from _steps(f"{full}-only", (f"{kind}-grant", f"version-{v}"), *after)
            yield from _steps(f"{full}-only", (f"{kind}-{v}-grant",), *after)
            yield from _steps(f"{full}-or-later", (f"{kind}-{v}-line-later",), *after)
            yield from _steps(full, (f"{kind}-{v}-line",), *after)
        yield from _steps(licence, (f"{kind}-grant", "gpl-hope"), f"{kind}-received")


# Licences and the sentences that make them, in the order in which they are tried.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    *_steps("Apache-2.0", ("apache-2-line",), "apache-compliance", "apache-copy", "apache-as-is", "apache-permissions"),
    ("MIT", ("mit-line", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    *_steps("MIT", ("mit-grant", "mit-notice", "mit-as-is"), "mit-liability"),
    ("MIT", ("mit-line",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-2-line",)),
    ("BSD-3-Clause", ("bsd-3-line",)),
    ("BSD", ("bsd-line",)),
    *_steps("ISC", ("isc-grant",), "isc-as-is"),
    ("ISC", ("isc-line",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-line",)),
    ("Unlicense", ("unlicense-domain",)),
    ("CC0-1.0", ("cc0-line",)),
    *_gnu_rules(),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("MPL-2.0", ("mpl-2",)),
    ("EPL-2.0", ("epl-2",)),
    *((x, (_spdx(x),)) for x in SPDX),
)

# Every pattern of SENTENCES needs one of these words or parts of words.
HOOKS: tuple[str, ...] = ("licens", "licenc", "permission", "redistribut", "copyright", "warrant", "endorse", "unencumbered", "cc0", "creative")
# Words that turn the sense of what follows them.
_TURNING = r"(?:not|no|never|nor|neither|nothing|none|nobody|without|unless|except|if|whether|was|were|once|formerly|previously|former|instead|rather|than|unlike|like|with|cannot|\w+n['’]t)"
_FROM = rf"(?:(?:^|(?<=[,;:(] )|(?<=\())[\"'(]*)(?:(?!{_TURNING} )[^\s,;:()]+ ){{0,8}}?"
_TO = r"(?=[\"')\]]*(?:[.,;:!?]+[\"')]*(?: |$)| \(| - |$))"

_END = re.compile(r"(?<=[.!?])\s+|\n[^\S\n]*(?=\n)")
_MARKS = re.compile(r"^[ \t]*(?:(?:/\*+/?|\*+/|[#*;%]+|//+|--+>?|<!--+)[ \t]*)+|(?:(?<!\*)\*+/|(?<!-)--+>|(?<=[ \t])[#*;%]+)[ \t\r]*$", re.M)
_SPACE = re.compile(r"\s+")


def unmarked(text: str) -> str:
    """The text with blanks for comment marks; positions stay."""
    return _MARKS.sub(lambda m: " " * len(m[0]), text)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text without comment marks."""
    out, at = [], 0
    for m in _END.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


_PLUS = re.compile(r"\+$")
_TAGGED = re.compile(r"(spdx-license-identifier:) ?([^ ]+(?: (?:or|and|with) [^ ]+)*)")


def normalise(sentence: str) -> str:
    """Lower case, single blanks, and a tag, after a mark of its own, for each licence of an SPDX expression."""
    low = _SPACE.sub(" ", sentence).strip().lower()
    each = lambda m: "; " + "; ".join(f"{m[1]} {_PLUS.sub('-or-later', x.strip('()'))}" for x in re.split(" (?:or|and|with) ", m[2])) + ";"
    return _TAGGED.sub(each, low).removeprefix("; ") if "spdx-" in low else low


@functools.cache
def _whole(pattern: str) -> re.Pattern[str]:
    """The pattern as a known part of a sentence: group 1."""
    return re.compile(f"{_FROM}({pattern}){_TO}")


@dataclass(frozen=True)
class Recogniser:
    """``known``: (identifier, pattern); ``rules``: (licence, identifiers); ``hooks``: of which a known sentence has one (none: no such test)."""

    known: tuple[tuple[str, str], ...] = SENTENCES
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES
    hooks: tuple[str, ...] = HOOKS

    def identify(self, sentence: str) -> list[str]:
        """Identifiers of a sentence without comment marks, in order of position."""
        low = sentence.lower()
        if self.hooks and not any(h in low for h in self.hooks):
            return []
        s = normalise(sentence)
        if s.endswith("?"):
            return []
        got: list[tuple[int, int, str]] = []
        for name, pattern in self.known:
            got += [(*m.span(1), name) for m in _whole(pattern).finditer(s) if all(m.end(1) <= a or b <= m.start(1) for a, b, _ in got)]
        return [name for _, _, name in sorted(got)]

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int]], list[tuple[str, int, int]], list[str]]:
        """Number of sentences, known ones with spans, licences with spans, identifiers that no rule took."""
        text = unmarked(text)
        spans = sentences(text)
        ids = [(name, a, b) for a, b in spans for name in self.identify(text[a:b])]
        found, lost, i = [], [], 0
        while i < len(ids):
            for licence, seq in self.rules:
                if seq and tuple(x[0] for x in ids[i : i + len(seq)]) == seq:
                    found.append((licence, ids[i][1], ids[i + len(seq) - 1][2]))
                    i += len(seq)
                    break
            else:
                lost.append(ids[i][0])
                i += 1
        return len(spans), ids, found, lost


def scan_licences(docs: DataFrame, recogniser: Recogniser = Recogniser(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_sentences, sentence_ids, licences (name and span in code points) and unmatched identifiers of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [recogniser.scan(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[x[0] for x in r[1]] for r in rows], pa.list_(pa.string())),
                    pa.array([[{"licence": n, "start": s, "end": e} for n, s, e in r[2]] for r in rows], span),
                    pa.array([r[3] for r in rows], pa.list_(pa.string())),
                ],
                names=[id_col, "n_sentences", "sentence_ids", "licences", "unmatched"],
            )

    schema = f"{id_col} {kind}, n_sentences long, sentence_ids array<string>, licences array<struct<licence:string,start:long,end:long>>, unmatched array<string>"
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string")), run, schema)
