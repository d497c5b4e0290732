import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textwarden.llm import html_text, licenses

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<ul><li>a<li>b<ol start=3><li>x</ol><li>c</ul>", "- a\n- b\n  3. x\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
        ("<td>loose<div>block", "loose\nblock"),
        ("<div hidden>no</div><p style='display : none'>no</p><script>if (a<b) '<p>'</script>yes", "yes"),
        ("<pre>  keep\n   this</pre>x", "  keep\n   this\n\nx"),
        ("<head><title>t</title><body>b &amp; c &copy;", "b & c ©"),
        ("3 < 4 > 2 <!-- no --> <b>bold", "3 < 4 > 2 bold"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<a href='x>y'>link</a", "link</a"),
    ],
)
def test_layout(page, text):
    assert html_text.render(page) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<td>", "<td rowspan=2>", "<th colspan=3>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<tr>", "<b>", "</b>", "<dd>", "<pre>", "</x>", "<", ">", "&amp;", "\n", " "]) | st.from_regex(r"w[a-z]{1,3}", fullmatch=True), max_size=40))
def test_all_visible_words_once(parts):
    words = [p for p in parts if re.fullmatch(r"w[a-z]+", p)]
    page = " ".join(parts)
    assert sorted(re.findall(r"w[a-z]+", html_text.render(page))) == sorted(words)


@pytest.mark.parametrize("unit", ["<div>", "<", "<a href=\"", "<!--", "<table><tr><td>", "<li>", "</p>", "<script>"])
def test_deep_and_broken(unit):
    html_text.render(unit * 20_000 + "x")


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (2, None), (None, "b")], "page_id long, html string").selectExpr("*", "1 AS text")
    assert sorted(((r.page_id or 0, r.text) for r in html_text.extract(df).collect())) == [(0, "b"), (1, "a"), (2, ""), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,found",
    [
        (None, []),
        ("", []),
        (MIT, ["MIT"]),
        ("junk | x |\nLicensed under CC BY-NC 4.0.\nmore", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("# SPDX-License-Identifier: BSD-3-Clause\ncode", ["BSD-3-Clause"]),
        ("A talk about the MIT License and its history.", []),
        ("copies or substantial portions of the Software.", []),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING X, ARE DISCLAIMED.", ["BSD-2-Clause"]),
    ],
)
def test_licenses(text, found):
    assert [f["license"] for f in licenses.find(text)] == found


def test_every_sentence_holds_a_trigger():
    for sentence in [*licenses.SENTENCES, *[s + licenses.HOLDS.get(name, "") for s, name in licenses.OPENINGS.items()]]:
        assert any(t in sentence for t in licenses.TRIGGERS), sentence


@pytest.mark.parametrize(
    "text,found",
    [
        ("MIT License", ["MIT"]),
        ("The MIT License (MIT)\n\n" + MIT.split("\n", 1)[1], ["MIT"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", ["GPL-3.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", ["Apache-2.0"]),
        ("Boost Software License - Version 1.0 - August 17th, 2003", ["BSL-1.0"]),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ["ISC"]),
        ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", ["Zlib"]),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n\n0. You just DO WHAT THE FUCK YOU WANT TO.", ["WTFPL"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", ["GPL-2.0"]),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-2-Clause and more", ["GPL-2.0-only", "BSD-2-Clause"]),
        ("The project is licensed under the MIT License", ["MIT"]),
        ("All code is released under the MIT license.", ["MIT"]),
        ("Licensed under MIT", ["MIT"]),
        ("Licensed under the MIT license (see LICENSE).", ["MIT"]),
        ("\n".join(("this work is licensed under the gnu general public license version 3").split()), ["GPL-3.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including " + "very " * 3000 + "much\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["MIT"]),
    ],
)
def test_common_licences(text, found):
    assert [f["license"] for f in licenses.find(text)] == found
    assert [f["license"] for f in licenses.find(f"Some words first.\n\n{text}\n\nSome words after.")] == found


def test_licence_table(spark):
    rows = [(1, "Licensed under MIT"), (1, "Licensed under MIT"), (2, None), (None, "MIT License"), (3, "x " * 200_000 + "\n\nMIT License\n\n" + "word\n" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS licenses")
    got = sorted((r.doc_id or 0, [f.license for f in r.found]) for r in licenses.scan(df).collect())
    assert got == [(0, ["MIT"]), (1, ["MIT"]), (1, ["MIT"]), (2, []), (3, ["MIT"])]


def test_lines_against_plain_search(spark, sf_dir):
    """Each sentence that a full match of the notices' pattern finds, by trying every run of lines."""
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect():
        text = r.text + "\n\nline one\nLicensed under the\nMIT\nLicense\n"
        for number, a, b in licenses.sentences(text):
            lines, at = [], a
            for line in text[a:b].split("\n"):
                lines.append((at, at + len(line)))
                at += len(line) + 1
            want, k = [], 0
            while k < len(lines):
                for j in range(len(lines), k, -1):
                    clean = licenses.normalised(text[lines[k][0] : lines[j - 1][1]])
                    if clean and licenses.identifier(clean):
                        want.append((lines[j - 1][1], licenses.identifier(clean)))
                        k = j - 1
                        break
                k += 1
            assert [(end, name) for _, end, name in licenses.known(text, a, b)] == want


def test_scan_against_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in licenses.scan(docs, keep=("doc_id", "text")).collect():
        want = sorted((m.start(), n) for line, n in lines.items() for m in re.finditer(re.escape(line), r.text))
        assert [(f.start, f.license) for f in r.found] == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_short_notices_pass_the_filter():
    notices = {
        "Released under CC BY 4.0.": "CC-BY-4.0", "This work is released under Creative Commons Attribution 4.0.": "CC-BY-4.0", "Distributed under the GPL v3.": "GPL-3.0",
        "Released under Apache 2.0.": "Apache-2.0", "Available under AGPL v3.": "AGPL-3.0", "Released under MPL 2.0.": "MPL-2.0", "This project is distributed under BSD 3-Clause.": "BSD-3-Clause",
        "Used\nunder\nCreative\nCommons\nCC0.": "CC0-1.0", "This work has been dedicated to the public\ndomain.": "Unlicense",
    }
    for notice, name in notices.items():
        assert [f["license"] for f in licenses.find(f"junk\n\n{notice}\n\nmore")] == [name], notice


@pytest.mark.parametrize(
    "page,text",
    [
        ("<head><title>T</title>Hello <b>world</b> <a>x</a>", "Hello world x"),
        ("<html><head><meta charset=u>\n<title>T</title>\n<a>link</a> and <i>more</i>", "link and more"),
        ("<head><style>p {}</style><script>x</script> <link rel=a><body>b", "b"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text>one</text><text>two</text></svg>three", "one two three"),
        ("<svg><title/><path d='x'/><text>a<tspan>b</tspan></text></svg>", "ab"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds", "so x = 1 holds"),
        ("<table><tr><td>a<svg><text>b</text></svg><td>c</table>", "a b  c"),
        ("<div><svg><path d=x></div>after<p>last", "after\n\nlast"),
        ("<svg><defs><g><p>shown<math><annotation>no<b>bold", "shown\u0020bold"),
        ("<svg><foreignObject><div>in</div></foreignObject><text>next</text></svg>", "in\nnext"),
        ("<desc>plain</desc> <defs>too</defs>", "plain too"),
        ("<object data=x>no</object>yes", "yes"),
        ("<div><object data=x>rest", "rest"),
    ],
)
def test_head_and_foreign_text(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>", ""),
        ("<p>a<div>b</p>c", "a\n\nb\n\nc"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>x<td rowspan=0>y<tr><td>z</table>", "x  y\nz"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
        ("<table><tr><td>one<ul><li>p<li>q</ul><td>two<tr><td>3<td>4</table>", "one  two\n- p\n- q\n3    4"),
        ("<table><tr><td>a<td><table><tr><td>x<td>y<tr><td>z</table><tr><td>b<td>c</table>", "a  x  y\n   z\nb  c"),
        ("<table><caption>t</caption><tr><td>a<p>b</table>", "t\na\nb"),
        ("<ol><li value=5>a<li>b</ol><ol reversed><li>x<li>y</ol><ol start=-1><li>n</ol>", "5. a\n6. b\n\n2. x\n1. y\n\n-1. n"),
        ("<form><input type=submit value=Go> <input type=submit> <input type=hidden value=no><input type=checkbox value=no> <input value=typed></form>", "Go Submit typed"),
        ("<table><tr style='visibility:hidden'><td>no<td style='visibility:visible'>yes<tr><td>c<td>d</table>", "   yes\nc  d"),
    ],
)
def test_visibility_tables_and_lists(page, text):
    assert html_text.render(page) == text


class Plain(HTMLParser):
    """Text outside what pages do not show, without any layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        of = dict(attrs)
        self.out.append(" ")
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            self.out.append((of.get("alt") or "") + " " if tag == "img" and not self.skip else "")
        elif self.skip:
            self.skip.append(tag)
        elif tag in ("script", "style", "head", "title", "noscript", "template") or "hidden" in of or "display:none" in (of.get("style") or "").replace(" ", ""):
            self.skip = [tag]

    def handle_endtag(self, tag):
        self.out.append(" ")
        while tag in self.skip and self.skip.pop() != tag:
            continue

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_pages_against_a_plain_parser(spark, sf_dir):
    from textwarden.llm.queries import op8_html_text

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op8_html_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r.page_id] or "")
        plain.close()
        assert Counter(re.findall(r"\w+", re.sub(r"(?m)^\s*\d+\. ", "", r.text))) == Counter(re.findall(r"\w+", "".join(plain.out)))


def test_nested_tables_lose_no_text():
    for depth in (3, html_text.DEEPEST + 5, 5000):
        page = "".join(f"<table><tr><td>w{k}<td>" for k in range(depth)) + "x"
        assert re.findall(r"\w+", html_text.render(page)) == [*[f"w{k}" for k in range(depth)], "x"]


@pytest.mark.parametrize("unit", ["<svg>", "<svg><g>", "<math><mi>", "<head>", "<svg><p>", "<object>"])
def test_deep_foreign(unit):
    assert html_text.render(unit * 20_000 + "x") == "x"
