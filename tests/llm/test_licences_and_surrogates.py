"""Licence lines and personal data that are easily missed, through the whole operators, and plain versions of both."""

import collections
import re

import numpy as np
import pytest

from sketchlake.llm import licenses, surrogates

STATED = {
    "SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: Apache-2.0\nint main() { return 0; }": ["Apache-2.0"], "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "SPDX-License-Identifier: GPL-3.0-only": ["GPL-3.0"],
    "License: MIT": ["MIT"], "Licence: Apache License, Version 2.0": ["Apache-2.0"], "Apache License\nVersion 2.0, January 2004": ["Apache-2.0"], "This is licensed under CC-BY-4.0": ["CC-BY-4.0"],
    "It is dual-licensed under MIT or Apache-2.0": ["Apache-2.0", "MIT"], "# SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "Released under GPLv3": ["GPL-3.0"], "Distributed under GPL v3": ["GPL-3.0"], "GPL-3.0": ["GPL-3.0"], "MIT-Lizenz": ["MIT"],
    "Not released under the MIT license.": [], "the license: see below": [], "the gpl was written by lawyers": [], "A license or a permit is needed.": [], "We compare the gpl v3 license with others": [], "licensed under contract or permit": [],
}


def test_identifiers_short_names_and_choices(spark):
    rows = spark.createDataFrame(list(enumerate(STATED)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan_licenses(rows).collect()}
    assert got == dict(enumerate(STATED.values()))


def plain_scan(text, needed, contained=0.6):
    """Statements cut and judged one by one."""
    classes, weight, bias, threshold = licenses.model()
    may = lambda s, strings: any(re.search(x.replace(" ", r"\s+"), s, re.I) for x in strings)
    ends = r"(?<=[.!?;])\s+|\n[ \t\r]*\n\s*"
    pieces = [p for line in _lines(text) for p in re.split(ends, line)]
    families, n = collections.Counter(), 0
    for s in (re.sub(r"\s+", " ", p) for p in pieces):
        for one in _choices(s) if may(s, needed) else []:
            grams = [g for g in licenses.grams(one) if g in weight]
            z = bias + sum((weight[g] for g in grams), np.zeros(len(bias)))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            family = classes[int(p.argmax())]
            held = max((len(licenses.pairs(t) & licenses.grams(one)) / len(licenses.pairs(t)) for t in licenses.TEMPLATES.get(family, ())), default=0)
            known = family != licenses.UNKNOWN and p.max() >= threshold and held >= contained
            families[family] += known
            n += may(one, licenses.NEEDED) or known
    return n, sorted(f for f, k in families.items() if k)


def _lines(piece):
    """A line with an identifier ends its statement."""
    out, held = [], ""
    for line in piece.split("\n"):
        held += ("\n" if held else "") + line
        if re.search(r"-identifier:", line, re.I):
            out.append(held)
            held = ""
    return [*out, held] if held or not out else out


def _choices(s):
    found = re.search(licenses._CHOICE, s)
    return [f"{found[1]} {x}" for x in re.split(r"(?i)\s+(?:or|and|with)\s+", re.sub(r"[()]", "", found[2]))] if found else [s]


def test_the_scan_equals_a_plain_one(spark):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t] + list(STATED) + ["\n".join(STATED), ". ".join(STATED)]
    got = {r.doc_id: (r.n_paragraphs, r.families) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    needed = licenses.needed_strings(0.6)
    assert got == {i: plain_scan(t, needed) for i, t in enumerate(texts)}
    assert sum(bool(f) for _, f in got.values()) > 15


LEAKS = {
    "Mr. A. Smith came": ["Smith"], "Mr. I. Jones came": ["Jones"], "Mr. A. B. Smith came": ["Smith"], "Prof. An Li spoke": ["An Li"], "Frau Das spoke": ["Das"], "Mr John\nSmith left": ["John", "Smith"], "Dr.-Ing. Hans Meier left": ["Hans", "Meier"],
    "Mrs  Anna Smith left": ["Anna", "Smith"], "pay to de89370400440532013000 now": ["de89370400440532013000"], "card 3782 822463 10005 ok": ["3782", "10005"], "ring 030 1234567 today": ["1234567"], "mail ann.b2@mail.x.com": ["ann", "mail.x.com"],
}


def test_names_and_numbers_that_were_left(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(LEAKS)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_entities(rows, "k").collect()}
    for i, (text, words) in enumerate(LEAKS.items()):
        assert got[i].n_entities == 1 and not any(w in got[i].text for w in words), (text, got[i].text)
        assert got[i].text.split()[0] == text.split()[0] and got[i].text.split()[-1][-1] == text.split()[-1][-1] or "mail" in text


def test_words_that_are_also_names_stay_elsewhere(spark):
    text = "Frau Das spoke. Das Haus. Prof. An Li spoke. An end. Mr. White sat. The White one. It stayed."
    got = surrogates.replace_entities(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first().text
    assert "Das Haus" in got and "An end" in got and "It stayed" in got and "White" not in got and "Frau Das" not in got and "An Li" not in got


def test_mail_keeps_format_script_and_hosts_and_addresses_their_class(spark):
    texts = ["ann.b2@x.com and bob@x.com and ann.b2@y.org", "иван.п@почта.рф", "10.0.0.1 192.168.4.5 172.20.1.1 127.0.0.1 8.8.8.8"]
    got = [r.text for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    a, _, b, _, c = got[0].split()
    assert a.split("@")[1] == b.split("@")[1] != c.split("@")[1] and len({a, b, c}) == 3
    assert re.fullmatch(r"[a-z]{3}\.[a-z]\d[a-z]*", a.split("@")[0]) and re.fullmatch(r"[а-я]{4}\.[а-я][а-яa-z]*", got[1].split("@")[0])
    assert all(x.endswith(".example") for x in (a, b, c))
    ips = got[2].split()
    assert ips[0].startswith("10.") and ips[1].startswith("192.168.") and ips[2].startswith("172.") and 16 <= int(ips[2].split(".")[1]) <= 31 and ips[3].startswith("127.")
    assert 11 <= int(ips[4].split(".")[0]) <= 125 and not set(ips) & set(texts[2].split())


@pytest.mark.parametrize("copies", [1, 3])
def test_texts_equal_a_plain_rewrite_with_the_map(spark, copies):
    """Every entity's new form is read off one-entity texts; whole texts then have it in its place and are else as they were."""
    sentences = ["Call +1 (017) 555-7713 today", "from 10.0.0.1 or 8.8.4.4", "card 4111 1111 1111 1111", "IBAN DE89 3704 0044 0532 0130 00", "id 078-05-1120", "write ann@x.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "nothing here 12 3.5"]
    whole = [". ".join(sentences[i:] + sentences[:i]) for i in range(len(sentences))] * copies
    rows = [(i, t) for i, t in enumerate([*sentences, *whole])]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = {s: got[i].text for i, s in enumerate(sentences)}
    assert new[sentences[-1]] == sentences[-1] and all(new[s] != s for s in sentences[:-1])
    for i, text in rows[len(sentences) :]:
        assert got[i].text == ". ".join(new[s] for s in text.split(". "))
