"""License scans by sentences: known sentences get identifiers, and ordered rules read their sequence.

A text is cut at sentence ends, colons, semicolons and blank lines. Where a piece holds one of the
words that every known sentence holds, runs of its lines are normalised (letters and digits, lower
case, single spaces, one spelling of license) and looked up: in the dictionary of whole sentences, among
the openings of sentences whose rest varies, and, where they are short, in the pattern of notices that
name a licence. Runs grow by lines up to the words of the longest known sentence, a sentence that opens
as a known one to the end of its piece. The identifiers, in the order of the text, are matched against
ordered rules: a rule is a sequence of identifiers, rules with more sentences come first, and at most
GAP unknown sentences may stand between two of a rule. A title right before the licence's own text, and
one alone, is one licence.

Defined results: a null or empty text has no licence; texts and sentences of any length are scanned
whole; a licence that occurs twice is found twice; offsets are in code points; an empty table gives an
empty table; columns other than the text and the ones kept are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import slices, tidied

#: Sentences between two sentences of a rule that the scan reads over.
GAP = 3
#: Every known sentence holds one of these, normalised or not: parts of one word, which no line break divides.
TRIGGERS = ("licen", "copyright", "permission", "warrant", "redistribut", "domain", "liable", "endorse", "under", "fuck")

# Whole sentences, normalised, and their identifiers.
SENTENCES = {
    "this is free and unencumbered software released into the public domain": "is:Unlicense",
    "this work has been released into the public domain": "is:Unlicense",
    "this work has been dedicated to the public domain": "is:Unlicense",
    "this work has been released to the public domain": "is:Unlicense",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    **{f"{n}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source" for n in ("", "1 ")},
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "you just do what the fuck you want to": "wtfpl-grant",
    "0 you just do what the fuck you want to": "wtfpl-grant",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    **{f"{v} version {n} of the license or at your option any later version": f"later:{n}" for v in ("either",) for n in ("2", "2 1", "3")},
    **{f"version {n} of the license": f"only:{n}" for n in ("2", "2 1", "3")},
    **{f"you can redistribute it and or modify it under the terms of the gnu {kind} public license{by}{rest}": f"grant:{name}{tail}"
       for kind, name in (("general", "GPL"), ("lesser general", "LGPL"), ("library general", "LGPL"), ("affero general", "AGPL"))
       for by in ("", " as published by the free software foundation")
       for rest, tail in (("", ""), *((f" either version {n} of the license or at your option any later version", f":{n}") for n in ("2", "2 1", "3")))},
}

# How sentences open whose rest differs from copy to copy.
OPENINGS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied": "mit-as-is",
    "in no event shall the authors or copyright holders be liable for any claim": "mit-liable",
    "the software is provided as is and the author disclaims all warranties with regard to this software": "isc-as-is",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "bsd-binary",
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation": "bsd-binary",
    "neither the name of": "bsd-endorse",
    "3 neither the name of": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties": "bsd-as-is",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
}
#: What such a sentence has to hold further on, where its opening alone says too little.
HOLDS = {"bsd-endorse": "may be used to endorse or promote products derived from this software"}

NAMED = r"(?:(?:the|this|all|our) (?:[a-z0-9]+ ){1,8}?(?:is|are) )?(?:dual )?(?:licensed|released|distributed|available|published|provided|covered|used)(?: and distributed)?(?: to you)?"
UNDER = rf"{NAMED} under(?: the terms of)?(?: the terms and conditions of)?(?: an?| the)?"
VERSION = r"(?: v| version| license version| license v| license)?"
TAIL = r"(?: see (?:[a-z0-9]+ ?){1,8})?"
LATER = r"(?: or (?:any )?later(?: version)?)?"
DATE = r"(?: [0-9]{1,2} [a-z]+ [0-9]{4}| [a-z]+ [0-9]{4}| [a-z]+ [0-9]{1,2}th [0-9]{4})?"

#: Short notices and titles as patterns, and what they name.
NOTICES: tuple[tuple[str, str], ...] = (
    (rf"{UNDER}(?: gnu)? affero general public license{VERSION} ?3(?: 0)?{LATER}{TAIL}", "is:AGPL-3.0"),
    (rf"{UNDER}(?: gnu)? agpl{VERSION} ?3(?: 0)?{TAIL}", "is:AGPL-3.0"),
    (rf"{UNDER}(?: gnu)? (?:lesser|library) general public license{VERSION} ?2 1{LATER}{TAIL}", "is:LGPL-2.1"),
    (rf"{UNDER}(?: gnu)? lesser general public license{VERSION} ?3(?: 0)?{LATER}{TAIL}", "is:LGPL-3.0"),
    (rf"{UNDER}(?: gnu)? lgpl{VERSION} ?2 1{LATER}{TAIL}", "is:LGPL-2.1"),
    (rf"{UNDER}(?: gnu)? lgpl{VERSION} ?3(?: 0)?{LATER}{TAIL}", "is:LGPL-3.0"),
    (rf"{UNDER}(?: gnu)? (?:general public license|gpl){VERSION} ?3(?: 0)?{LATER}{TAIL}", "is:GPL-3.0"),
    (rf"{UNDER}(?: gnu)? (?:general public license|gpl){VERSION} ?2(?: 0)?{LATER}{TAIL}", "is:GPL-2.0"),
    (rf"{UNDER}(?: gnu)? general public license(?: as published by the free software foundation)?{TAIL}", "is:GPL"),
    (rf"{UNDER} apache(?: software)?{VERSION} ?2(?: 0)?(?: the license)?{TAIL}", "is:Apache-2.0"),
    (rf"{UNDER} mit(?: x11| open source)?(?: license)?{TAIL}", "is:MIT"),
    (rf"{UNDER} isc(?: license)?{TAIL}", "is:ISC"),
    (rf"{UNDER} zlib(?: libpng)?(?: license)?{TAIL}", "is:Zlib"),
    (rf"{UNDER} boost(?: software)?(?: license)?(?: version)?(?: 1 0)?{TAIL}", "is:BSL-1.0"),
    (rf"{UNDER}(?: new| modified| revised| 3 clause) bsd(?: 3 clause)?(?: license)?{TAIL}", "is:BSD-3-Clause"),
    (rf"{UNDER} bsd 3 clause(?: license)?{TAIL}", "is:BSD-3-Clause"),
    (rf"{UNDER}(?: simplified| freebsd| 2 clause) bsd(?: 2 clause)?(?: license)?{TAIL}", "is:BSD-2-Clause"),
    (rf"{UNDER} bsd 2 clause(?: license)?{TAIL}", "is:BSD-2-Clause"),
    (rf"{UNDER} bsd license{TAIL}", "is:BSD"),
    (rf"{UNDER} mozilla public license{VERSION} ?2 0{TAIL}", "is:MPL-2.0"),
    (rf"{UNDER} mpl{VERSION} ?2 0{TAIL}", "is:MPL-2.0"),
    (rf"{UNDER} eclipse public license{VERSION} ?2 0{TAIL}", "is:EPL-2.0"),
    (r"this source code form is subject to the terms of the mozilla public license v ?2 0", "is:MPL-2.0"),
    *((rf"(?:{UNDER} )?(?:cc {code}(?: license)?|creative commons {words})(?: license)?(?: version)? {v}(?: international| unported)?(?: (?:public )?license)?{TAIL}", f"is:CC-{code.upper().replace(' ', '-')}-{v.replace(' ', '.')}")
      for v in ("4 0", "3 0")
      for code, words in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))),
    (rf"{UNDER} (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: license| public domain dedication)?{TAIL}", "is:CC0-1.0"),
    (r"(?:the )?mit license(?: mit)?", "title:MIT"),
    (r"(?:the )?isc license(?: isc)?", "title:ISC"),
    (r"(?:the )?zlib license", "title:Zlib"),
    (r"(?:the )?bsd 3 clause license", "title:BSD-3-Clause"),
    (r"(?:the )?bsd 2 clause license", "title:BSD-2-Clause"),
    (rf"boost software license version 1 0{DATE}", "title:BSL-1.0"),
    (r"(?:the )?unlicense license", "title:Unlicense"),
    (r"do what the fuck you want to public license(?: version 2(?: december 2004)?)?", "title:WTFPL"),
    (rf"gnu general public license version 3{DATE}", "title:GPL-3.0"),
    (rf"gnu general public license version 2{DATE}", "title:GPL-2.0"),
    (rf"gnu lesser general public license version 3{DATE}", "title:LGPL-3.0"),
    (rf"gnu lesser general public license version 2 1{DATE}", "title:LGPL-2.1"),
    (rf"gnu affero general public license version 3{DATE}", "title:AGPL-3.0"),
    (rf"apache license version 2 0{DATE}(?: https? www apache org licenses)?", "title:Apache-2.0"),
    (r"mozilla public license version 2 0", "title:MPL-2.0"),
    (r"copyright(?: c)?(?: [0-9]{4})?(?: .{0,120})?", "copyright"),
)
#: Words of the longest text that a notice or a whole sentence may be.
MOST_WORDS = max(48, *[s.count(" ") + 1 for s in SENTENCES])

GNU = {(f"{kind}:{n}"): v for kind, versions in (("GPL", ("2", "3")), ("LGPL", ("2", "2 1", "3")), ("AGPL", ("3",))) for n in versions for v in [n.replace(" ", ".") if " " in n else f"{n}.0"]}
#: Licence and the identifiers that name it, in order; for * the one identifier, but its kind, names the licence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Apache-2.0", ("is:Apache-2.0", "apache-comply", "apache-copy")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    *((f"{key.split(':')[0]}-{v}-or-later", (f"grant:{key.split(':')[0]}", f"later:{key.split(':')[1]}")) for key, v in GNU.items()),
    *((f"{key.split(':')[0]}-{v}", (f"grant:{key.split(':')[0]}", f"only:{key.split(':')[1]}")) for key, v in GNU.items()),
    ("Apache-2.0", ("apache-comply", "apache-copy")),
    *((f"{key.split(':')[0]}-{v}-or-later", (f"grant:{key}",)) for key, v in GNU.items()),
    ("BSL-1.0", ("bsl-grant",)),
    ("WTFPL", ("wtfpl-grant",)),
    ("*", ("is:",)),
    ("*", ("title:",)),
)

CUT = re.compile(r"[.!?](?=\s|$)|[:;]\s|\n[ \t\r]*\n")
NOT_WORD = re.compile(r"[^a-z0-9]+")
ANY = re.compile("|".join(f"(?P<s{k}>{p})" for k, (p, _) in enumerate(NOTICES)))
OPENS = re.compile("|".join(f"(?P<s{k}>{p}(?= |$))" for k, p in enumerate(OPENINGS)))
SPDX_NAME = r"\(*([A-Za-z0-9][A-Za-z0-9.+-]*)\)*"
SPDX_ID = re.compile(rf"SPDX-License-Identifier:[ \t]*{SPDX_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{SPDX_NAME})*")
SPDX_PART = re.compile(rf"(?:(AND|OR|WITH)[ \t]+|:[ \t]*){SPDX_NAME}")


def normalised(sentence: str) -> str:
    return NOT_WORD.sub(" ", sentence.lower()).strip().replace("licence", "license")


def identifier(sentence: str) -> str | None:
    """The identifier of a normalised sentence: a whole one's, else by its opening, else of the first notice it is."""
    if name := SENTENCES.get(sentence):
        return name
    if m := OPENS.match(sentence):
        name = OPENINGS[m[0]]
        if HOLDS.get(name, "") in sentence:
            return name
    if sentence.count(" ") < MOST_WORDS and (m := ANY.fullmatch(sentence)):
        return NOTICES[int(m.lastgroup[1:])][1]
    return None


def sentences(text: str) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the pieces between cuts that hold a trigger."""
    at = number = 0
    for m in CUT.finditer(text):
        yield number, at, m.start()
        at, number = m.end(), number + 1
    yield number, at, len(text)


def known(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences in a piece, whole or as runs of its lines, the longest first."""
    lines, at = [], start
    for line in text[start:end].split("\n"):
        lines.append((at, at + len(line), normalised(line)))
        at += len(line) + 1
    k = 0
    while k < len(lines):
        words, runs = "", []
        for j in range(k, len(lines)):
            words = f"{words} {lines[j][2]}".strip()
            runs.append(words)
            if words.count(" ") >= MOST_WORDS:
                break
        last = None
        if m := OPENS.match(words):
            name = OPENINGS[m[0]]
            if HOLDS.get(name, "") in (" ".join(x[2] for x in lines[k:]) if name in HOLDS else ""):
                last, found = len(lines), name
        if last is None:
            for n in range(len(runs), 0, -1):
                if any(t in runs[n - 1] for t in TRIGGERS) and (found := identifier(runs[n - 1])):
                    last = k + n
                    break
        if last is not None:
            a, b = lines[k][0], lines[last - 1][1]
            yield a + len(text[a:b]) - len(text[a:b].lstrip()), b, found
            k = last - 1
        k += 1


def find(text: str | None) -> list[dict]:
    """The licences of a text: license, start, end, sentences (how many sentences the rule read)."""
    if not text:
        return []
    low = text.lower()
    if not any(t in low for t in TRIGGERS):
        return []
    hits: list[tuple[int, int, int, str]] = []
    for number, a, b in sentences(text):
        piece = text[a:b].lower()
        if any(t in piece for t in TRIGGERS):
            hits += [(number, *h) for h in known(text, a, b)]
    out = []
    for m in SPDX_ID.finditer(text):
        out += [{"license": p[2], "start": m.start(), "end": m.start() + p.end(), "sentences": 1} for p in SPDX_PART.finditer(m[0]) if p[1] != "WITH"]
    title = None  # the title before, if nothing but a copyright line came since
    k = 0
    while k < len(hits):
        for name, rule in RULES:
            used = _follow(hits, k, rule)
            if used:
                license_ = hits[k][3].split(":", 1)[1] if name == "*" else name
                if title and title["license"] == license_:
                    title.update(end=hits[used[-1]][2], sentences=title["sentences"] + len(used))
                else:
                    out.append({"license": license_, "start": hits[k][1], "end": hits[used[-1]][2], "sentences": len(used)})
                title = out[-1] if rule == ("title:",) else None
                k = used[-1]
                break
        else:
            if hits[k][3] != "copyright":
                title = None
        k += 1
    return sorted(out, key=lambda f: (f["start"], f["end"]))


def _follow(hits: list[tuple[int, int, int, str]], k: int, rule: Sequence[str]) -> list[int]:
    """The hits from k on that carry the rule's identifiers in order, or none."""
    if rule in (("is:",), ("title:",)):
        return [k] if hits[k][3].startswith(rule[0]) else []
    used: list[int] = []
    for wanted in rule:
        j = used[-1] + 1 if used else k
        while j < len(hits) and hits[j][3] != wanted and used and hits[j][0] - hits[used[-1]][0] <= GAP:
            j += 1
        if j >= len(hits) or hits[j][3] != wanted or (used and hits[j][0] - hits[used[-1]][0] > GAP + 1):
            return []
        used.append(j)
    return used


FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.int32())]))


def scan(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of keep and found, an array of the licences of each row's text."""
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    kind = "array<struct<license:string,start:bigint,end:bigint,sentences:int>>"
    schema = source.drop("__text").select("*", F.lit(None).cast(kind).alias("found")).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: list[list[dict]] = []
            for a, b in slices(batch.columns[-1]):
                found += map(find, batch.columns[-1].slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, FOUND)], names=[*keep, "found"])

    return source.mapInArrow(tidied(batches), schema)
