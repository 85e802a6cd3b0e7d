"""Base spans against plain regexes, and the fit on votes."""

import hashlib
import random
import re

from riskengine.llm import pii

# fixed values: the patterns of the base kinds
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    ds = [int(c) for c in reversed(number)]
    return sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(ds)) % 10 == 0


def fine(kind, m):
    n = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")),
            "card": 14 <= len(n) <= 19 and luhn(n), "phone": 10 <= len(n) <= 15}[kind]


def plain(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(BASE.items())
           for m in re.finditer(p, text or "") if fine(k, m[0])]
    return [x[2] for x in sorted(out)]


def texts():
    r = random.Random(9)
    pieces = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f", "a@b.c.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.255", "4539 1488 0343 6467",
              "4539148803436467", "4539-1488-0343-6468", "+1 (555) 010-9999", "+1", "+49-30 1234567890123", " ", "\n", "é", "\U0001f600", "word",
              "12", "-", ".", "+", "call ", "AKIA" + "A1" * 8, "0" * 40, "%", "@name_x", "a" * 30]
    return [None, "", *pieces, *["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(400)],
            "a" * 200_000 + "@", "1." * 60_000, "1 " * 60_000, "a@b" + ".c" * 60_000, "+1" + " " * 60_000]


def test_base_spans_equal_plain_regexes(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows + [(None, "a@b.c")], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.report(pii.spans(df.withColumnsRenamed({}), keep=("doc_id",))).collect()}
    assert len(got) == len(rows) + 1
    for i, t in rows:
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:200]
        assert [getattr(got[i], f"n_{k}") for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(",")) or not want


def test_empty_and_repeated(spark):
    assert pii.report(pii.spans(spark.createDataFrame([], "doc_id long, text string"), keep=("doc_id",))).count() == 0
    twice = spark.createDataFrame([(1, "a@b.c")] * 2 + [(2, None)], "doc_id long, text string")
    assert sorted(x.n_email for x in pii.report(pii.spans(twice, keep=("doc_id",))).collect()) == [0, 1, 1]


def test_fit_separates_agreeing_votes():
    got = pii.fit([("card", "+++++0"[:6], 2, 500), ("card", "---0-0", 1, 500), ("card", "++0000", 2, 50), ("ip", "-0-000", 0, 80)])
    assert got["card", "+++++0", 2] > 0.8 > 0.2 > got["card", "---0-0", 1]
    assert got["ip", "-0-000", 0] < 0.5
