"""License scan: ordered signature rules behind a keyword gate, native Spark only.

A document passes the gate if it holds what some rule cannot match without; only then
is it cut into words. Every word that opens a signature is a hit, with the words after it as
context; hits meet the rules of their opening word (a hash join with some hundred
rows), and a rule's regex is tried only if its own keyword stands in the context.
Of overlapping detections, one that lies inside another of the same or a better
priority is suppressed: in the order (start, longest first, priority), it is
enough to carry the largest end of each priority so far.
"""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.llm.text import ROW, ascii_lower, whole, with_row

# -- fixed values: the phrases every result has to report
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
CONTEXT_WORDS = 24
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# short words that many other words hold, as whole words
EXACT = {("cc", "by"): f"(?i)cc{GAP}by", ("mpl",): f"(?i)(?:^|{GAP})mpl(?:{GAP}|$)"}


@dataclass(frozen=True)
class Rule:
    rule: int
    lead: str        # first word of every match
    keyword: str     # must stand in the context before the regex is tried
    regex: str       # over words joined by one space
    label: str
    priority: int    # 1 statements, 2 names with a version, 3 bare names
    confidence: float
    base: bool


# (label, name over single-space words, keyword, versions)
LICENSES = [
    ("gpl", "gnu (?:general public licen[sc]e|gpl)", "gnu", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public licen[sc]e", "general public", ("2", "2 1", "3")),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "gnu affero general public licen[sc]e", "affero", ("1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("gfdl", "gnu free documentation licen[sc]e", "documentation", ("1 1", "1 2", "1 3")),
    ("apache", "apache (?:software )?licen[sc]e", "apache", ("1 0", "1 1", "2 0")),
    ("apache", "apache", "apache", ("2 0",)),
    ("mit", "mit (?:x11 )?licen[sc]e", "mit", ()),
    ("mit", "expat licen[sc]e", "expat", ()),
    ("bsd", "bsd (?:style )?licen[sc]e", "bsd", ()),
    ("bsd-2-clause", "bsd 2 clause(?: licen[sc]e)?", "bsd", ()),
    ("bsd-3-clause", "bsd 3 clause(?: licen[sc]e)?", "bsd", ()),
    ("bsd-2-clause", "simplified bsd licen[sc]e", "simplified", ()),
    ("bsd-3-clause", "new bsd licen[sc]e", "new bsd", ()),
    ("isc", "isc licen[sc]e", "isc", ()),
    ("mpl", "mozilla public licen[sc]e", "mozilla", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 1", "2 0")),
    ("epl", "eclipse public licen[sc]e", "eclipse", ("1 0", "2 0")),
    ("cddl", "common development and distribution licen[sc]e", "development", ("1 0", "1 1")),
    ("eupl", "european union public licen[sc]e", "european", ("1 1", "1 2")),
    ("artistic", "artistic licen[sc]e", "artistic", ("1 0", "2 0")),
    ("bsl", "boost software licen[sc]e", "boost", ("1 0",)),
    ("zlib", "zlib licen[sc]e", "zlib", ()),
    ("unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl", "wtfpl", ()),
    ("ofl", "sil open font licen[sc]e", "font", ("1 0", "1 1")),
    ("odbl", "open database licen[sc]e", "database", ("1 0",)),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("public-domain", "public domain", "public domain", ()),
    *[(f"cc-by{s.replace(' ', '-')}", f"{n}{s if n == 'cc by' else long}(?: licen[sc]e)?", k, ("1 0", "2 0", "2 5", "3 0", "4 0"))
      for s, long in (("", ""), (" sa", " share ?alike"), (" nc", " non ?commercial"), (" nd", " no ?derivatives"),
                      (" nc sa", " non ?commercial share ?alike"), (" nc nd", " non ?commercial no ?derivatives"))
      for n, k in (("cc by", "by"), ("creative commons attribution", "attribution"))],
]
STATEMENTS = ["licensed under", "released under", "distributed under", "published under", "available under",
              "covered by", "governed by", "subject to", "under the terms of", "spdx license identifier"]
OTHERS = [("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 2, 0.5),
          ("all", "rights reserved", "all rights reserved", "all-rights-reserved", 2, 0.5)]


def rules() -> list[Rule]:
    """Every license alone and in every statement, bare and with each version; then the base phrases."""
    out: list[tuple] = []
    for label, name, keyword, versions in LICENSES:
        for version in ("", *versions):
            tail = f"(?: licen[sc]e)?,? ?(?:version |v ?)?{version.replace(' ', ' ?')}(?: or (?:any )?later(?: version)?| only)?" if version else ""
            full = label + (f"-{version.replace(' ', '.')}" if version else "")
            out.append((name.split(" ")[0], keyword, name + tail, full, 2 if version else 3, 0.8 if version else 0.6))
            out += [(s.split(" ")[0], keyword, f"{s} (?:the |a |an )?(?:terms of the )?{name}{tail}", full, 1, 0.95)
                    for s in STATEMENTS]
    out += OTHERS
    made = [Rule(i, *x, False) for i, x in enumerate(out)]
    return made + [Rule(len(made) + i, p.split(" ")[0], p, p, label, 3, 0.6, True) for i, (p, label) in enumerate(BASE.items())]


RULE_SCHEMA = "rule int, lead string, keyword string, regex string, label string, priority int, confidence double, base boolean"
PRIORITIES = (1, 2, 3)


def needed(rule: Rule) -> tuple[str, ...]:
    """Words, or parts of words, that stand in every text the rule matches."""
    must, left = rule.regex, ""
    while must != left:
        left, must = must, re.sub(r"\(\?:[^()]*\)\??", " ", must)  # optional parts and choices need not be there
    if "licen" in must:
        return ("licen",)
    return ("cc", "by") if "cc by" in must else tuple(rule.keyword.split(" "))


def gate_words() -> list[tuple[str, ...]]:
    """What :func:`needed` gives for all rules, without entries that another one implies."""
    every = sorted({needed(r) for r in rules()})
    implied = lambda x: any(y != x and y not in EXACT and all(any(w in v for v in x) for w in y) for y in every)
    return [x for x in every if not implied(x)]


def gate(text: Column) -> Column:
    low, hit = F.lower(text), F.lit(False)
    for words in gate_words():
        here = F.lit(True)
        for w in words:
            here = here & low.contains(w)
        hit = hit | (here & text.rlike(EXACT[words]) if words in EXACT else here)
    return hit


def detections(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with ``start`` NULL, and one per detection: its words [start, end),
    rule, label, priority, confidence, base, and whether another one ``suppressed`` it.

    ``keep`` names the columns to carry; NULL and empty texts have no words; repeated
    rows stay apart. The result is partitioned by the row number.
    """
    table = rules()
    leads = sorted({r.lead for r in table})
    words = F.when(gate(F.col("_text")), F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(WORD), F.lit(0)))
    doc = with_row(df.select(*[F.col(c).alias(c) for c in keep], whole(text).alias("_text")))
    doc = doc.select(ROW, *keep, F.regexp_count("_text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
                     words.alias("_words"))
    at = F.filter(F.transform("_words", lambda w, i: F.struct(i.cast("long").alias("start"), w.alias("lead"))),
                  lambda h: h["lead"].isin(leads))
    hits = F.transform(at, lambda h: F.struct(
        h["start"].alias("start"), h["lead"].alias("lead"),
        F.array_join(F.slice(F.col("_words"), (h["start"] + 1).cast("int"), CONTEXT_WORDS), " ").alias("context")))
    itself = F.struct(F.lit(None).cast("long").alias("start"), F.lit("").alias("lead"), F.lit("").alias("context"))
    rows = doc.withColumn("_hit", F.explode(F.concat(F.array(itself), F.coalesce(hits, F.array().cast(
        "array<struct<start:bigint,lead:string,context:string>>"))))).select(ROW, *keep, "n_words", "_hit.*")
    signatures = F.broadcast(df.sparkSession.createDataFrame([astuple(r) for r in table], RULE_SCHEMA))
    found = rows.join(signatures, "lead", "left").withColumn("_match", F.when(
        F.col("context").contains(F.col("keyword")),
        F.expr("regexp_extract(context, concat('^(', regex, ')(?: |$)'), 1)")))
    found = found.where(F.col("start").isNull() | (F.col("_match") != "")).withColumn(
        "end", F.col("start") + F.length("_match") - F.length(F.replace("_match", F.lit(" "), F.lit(""))) + 1)
    found = found.select(ROW, *keep, "n_words", "start", "end", "rule", "label", "priority", "confidence", "base")
    order = Window.partitionBy(ROW).orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in PRIORITIES:
        best = F.max(F.when(F.col("priority") <= p, F.col("end"))).over(order)
        inside = inside | ((F.col("priority") == p) & F.coalesce(best >= F.col("end"), F.lit(False)))
    return found.withColumn("suppressed", inside)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: word and base counts, first and last base word, labels, score.

    The score is the largest confidence of the detections that stand, 0 without any.
    """
    base, stands = F.col("base"), ~F.col("suppressed") | F.col("base")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return detections(df, text, keep).groupBy(ROW).agg(
        *[F.first(c).alias(c) for c in keep], F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(stands & F.col("label").isNotNull()).alias("labels"),
        F.coalesce(F.max(F.when(stands, F.col("confidence"))), F.lit(0.0)).alias("score")).drop(ROW)
