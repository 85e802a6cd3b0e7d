"""License scan against a plain loop over words and rules."""

import re

from riskengine.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CASES = [None, "", "  \n", "MIT License. mit license, MIT LICENSE", "Licensed under CC BY-NC 4.0.",
         "This work is licensed under the GNU General Public License, version 3.", "cc--by É cc by", "submit license",
         "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "\x01apache\x02license",
         "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
         "word " * 3000 + "GPLv2 or later " * 200, "Copyright (c) 2020 x. All rights reserved. SPDX-License-Identifier: MIT License",
         "ÀCC BY", "the Mozilla Public Licence 2.0 and the BSD 3-Clause License"]


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    base = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words))
                  if words[i:i + len(p.split())] == p.split())
    spans = []
    for i, w in enumerate(words):
        context = " ".join(words[i:i + licenses.CONTEXT_WORDS])
        for r in licenses.rules():
            if r.lead == w and r.keyword in context and (m := re.match(f"({r.regex})(?: |$)", context)):
                spans.append((i, i + len(m[1].split(" ")), r))
    kept = [(s, e, r) for s, e, r in spans if r.base or not any(
        a <= s and e <= b and (q.priority < r.priority or q.priority == r.priority and (b - a > e - s or (a, b) == (s, e) and q.rule < r.rule))
        for a, b, q in spans)]
    return (len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
            ",".join(sorted({x for _, x in base})), ",".join(sorted({r.label for *_, r in kept})),
            max((r.confidence for *_, r in kept), default=0.0))


def test_scan_equals_a_plain_loop(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(CASES)] + [(None, "mit license", None, None)],
                               "doc_id long, text string, label string, start int")
    got = sorted(tuple(r) for r in licenses.scan(df).where("doc_id is not null").collect())
    assert got == [(i, *plain(t)) for i, t in enumerate(CASES)]
    assert licenses.scan(df).where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 300
    assert {r.lead for r in licenses.rules()}.isdisjoint({""})


GATE_FREE = ["BSD 3-Clause", "bsd 2 clause", "Released under Apache 2.0", "apache", "CC0 1.0", "distributed under MPL 2.0", "MPL", "wtfpl",
             "Creative\nCommons\tAttribution 4.0", "in the PUBLIC\n domain", "all  rights\nreserved", "governed by the GNU GPL v3", "Cc-\u0001bY sa 4.0",
             "plain words on a domain", "a public road, all rights"]


def test_no_text_with_a_detection_fails_the_gate(spark):
    df = spark.createDataFrame(list(enumerate(GATE_FREE)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.scan(df).collect())
    assert got == [(i, *plain(t)) for i, t in enumerate(GATE_FREE)]
    assert all(r[6] for r in got[:-2]) and not any(r[6] for r in got[-2:])


def test_gate_holds_a_part_of_every_rule_as_written():
    gates = licenses.gate_words()
    for r in licenses.rules():
        shortest = re.sub(r"\[sc\]", "s", r.regex)
        while "(" in shortest:  # the first choice of each group, nothing for optional ones
            shortest = re.sub(r"\(\?:([^()|]*)[^()]*\)(\??)", lambda m: "" if m[2] else m[1], shortest)
        shortest = re.sub(r".\?", "", shortest).replace("[0-9]{2}", "20")
        assert re.fullmatch(r.regex, shortest) and any(all(w in shortest for w in g) for g in gates), r
