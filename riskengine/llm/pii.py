"""Personal data by weak supervision, native Spark only.

1. Candidates: linear-time patterns per kind over the whole text. Valid ones of the
   four base kinds are always spans; failing ones and looser kinds are candidates.
2. Labelers vote on every candidate: pattern checks (regex), value lists (gazetteer)
   and words around it (context); each says yes, no or nothing.
3. Expectation-maximisation over the counts of vote patterns estimates how often each
   labeler is right, per kind the share of true spans, and a posterior per pattern.
4. A logistic span classifier, fitted to these posteriors over all candidates, decides.

Steps 3 and 4 work on one row per distinct pattern (kinds x votes x length class: a few
hundred at most, whatever the corpus), so every candidate counts and nothing is sampled.
Positions are code points. Offsets come from the lengths of matches and of the pieces
between them, summed by a window per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.llm.text import ROW, whole, with_row
from riskengine.session import materialise

# -- fixed values: kinds in report order
KINDS = ("email", "ip", "card", "phone", "secret", "handle")
BASE_KINDS = KINDS[:4]
#: Leftmost non-overlapping matches, written so that no input costs more than linear time:
#: a run is entered at its start (or right after the last match) and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{32,}+|[A-Za-z_]{1,32}+=[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z0-9_]{3,}+(?![A-Za-z0-9_@])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
AROUND = 40
#: Value lists. Public top-level domains, card issuer ranges, country codes in common use.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "info", "co", "us")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35)"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel", "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|credit|karte|tarjeta|carte|pay", "phone": "call|phone|tel|mobile|fax|anruf|appel|llam",
    "secret": "key|token|secret|password|api|aws", "handle": "follow|twitter|user|contact|dm",
}
DOUBTS = r"(?i)(?:version|v|section|chapter|page|isbn|no|nr|id|order|invoice)[.:# ]*$"
LABELERS = ("shape", "check", "list", "cue", "doubt", "edge")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, digit sums, modulo 10."""
    each = F.split(F.reverse(number), "")
    total = F.aggregate(F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 1, F.floor(d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(m))
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def votes(kind: str, m: Column, left: Column, right: Column) -> Column:
    """One character per labeler: + yes, - no, 0 nothing said."""
    n = F.length(digits(m))
    say = lambda yes, no=None: F.when(yes, "+").otherwise("0" if no is None else F.when(no, "-").otherwise("0"))
    shape = {"email": say(m.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}$"), F.lit(True)),
             "ip": say(~m.rlike(r"(?:^|\.)0[0-9]"), F.lit(True)),
             "card": say(m.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), n < 12),
             "phone": say(m.rlike(r"[ ().-]"), n < 8), "secret": say(m.rlike("^AKIA|[0-9].*[a-z]|[a-z].*[0-9]"), F.lit(True)),
             "handle": say(m.rlike("[a-z]"), ~m.rlike("[A-Za-z]"))}[kind]
    check = {"secret": say(F.length(m) >= 20, F.lit(True)), "handle": say(F.length(m).between(5, 16), F.lit(True))}.get(
        kind, say(valid(kind, m), F.lit(True)))
    listed = {"email": say(F.lower(F.substring_index(m, ".", -1)).isin(*DOMAINS)),
              "ip": say(~m.rlike(r"^(?:0|127|255|2[2-5][0-9])\."), F.lit(True)), "card": say(digits(m).rlike(ISSUERS), F.lit(True)),
              "phone": say(m.rlike(CODES), F.lit(True)), "secret": say(m.rlike("(?i)^(?:AKIA|api|key|token|secret|pass)")),
              "handle": say(F.lit(False))}[kind]
    cue = say(left.rlike(rf"(?i)\b(?:{CUES[kind]})"))
    doubt = say(F.lit(False), left.rlike(DOUBTS))
    edge = say(left.rlike(r"(?:^|[\s(\"':,;])$") & right.rlike(r"^(?:$|[\s)\"',;.!?])"), left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]"))
    return F.concat(shape, check, listed, cue, doubt, edge)


def occurrences(t: Column, kind: str, pattern: str) -> Column:
    """Every match of the pattern in order, with the length of the gap before it and the text around."""
    found = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("g"))

    def rows(x: Column) -> Column:
        return F.transform(x["m"], lambda m, j: F.struct(
            F.lit(kind).alias("kind"), j.alias("j"), F.length(F.get(x["g"], j)).alias("gap"), m.alias("m"),
            F.right(F.get(x["g"], j), F.lit(AROUND)).alias("left"), F.left(F.get(x["g"], j + 1), F.lit(AROUND)).alias("right")))
    return F.transform(F.array(found), rows)[0]


def candidates(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a document: itself (``kind`` NULL), and each match of each pattern with its
    order, length, the gap before it, whether it is a base span, votes and length class."""
    doc = with_row(df.select(*keep, whole(text).alias("_text")))
    t = F.col("_text")
    numbers = t.rlike("[0-9]")
    may = {"email": t.contains("@"), "ip": numbers, "card": numbers, "phone": numbers & t.contains("+"),
           "secret": numbers, "handle": t.contains("@")}
    shape = "array<struct<kind:string,j:int,gap:int,m:string,left:string,right:string>>"
    lists = [F.when(may[kind] & t.rlike(p), occurrences(t, kind, p)).otherwise(F.array().cast(shape))
             for kind, p in PATTERNS.items()]
    itself = F.array(F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (
        ("kind", "string"), ("j", "int"), ("gap", "int"), ("m", "string"), ("left", "string"), ("right", "string"))]))
    rows = doc.select(ROW, *keep, F.explode(F.concat(itself, *lists)).alias("c")).select(ROW, *keep, "c.*")
    by_kind = lambda f: F.coalesce(*[F.when(F.col("kind") == k, f(k)) for k in KINDS])
    size = F.length("m")
    return rows.select(
        ROW, *keep, "kind", "j", "gap", size.alias("length"),
        by_kind(lambda k: valid(k, F.col("m")) if k in BASE_KINDS else F.lit(False)).alias("base"),
        by_kind(lambda k: votes(k, F.col("m"), F.col("left"), F.col("right"))).alias("votes"),
        F.when(size < 8, 0).when(size < 16, 1).when(size < 32, 2).otherwise(3).alias("size_class"))


def fit(patterns: list[tuple[str, str, int, int]], rounds: int = 60, steps: int = 300) -> dict[tuple[str, str, int], float]:
    """Probability of each (kind, votes, size class) from (kind, votes, size class, count) rows.

    EM with two latent states: per kind a share of true spans, per labeler the chances
    of yes and no in either state (add-one smoothing; starts from a vote majority).
    Then a logistic model on kind, votes and size class is fitted to the posteriors.
    """
    patterns = sorted(patterns)
    post = [min(0.9, max(0.1, 0.5 + 0.15 * (v.count("+") - v.count("-")))) for _, v, _, _ in patterns]
    for _ in range(rounds):
        share, table = {}, {}
        for k in {p[0] for p in patterns}:
            own = [(q, p[3]) for q, p in zip(post, patterns) if p[0] == k]
            share[k] = (1 + math.fsum(q * n for q, n in own)) / (2 + sum(n for _, n in own))
        for i in range(len(LABELERS)):
            for state in (0, 1):
                mass = {s: 1.0 for s in "+-0"}
                for q, p in zip(post, patterns):
                    mass[p[1][i]] += p[3] * (q if state else 1 - q)
                table[i, state] = {s: m / sum(mass.values()) for s, m in mass.items()}
        for x, (k, v, _, _) in enumerate(patterns):
            odds = math.log(share[k] / (1 - share[k])) + sum(
                math.log(table[i, 1][s] / table[i, 0][s]) for i, s in enumerate(v) if s != "0")
            post[x] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    feats = [[f"kind{k}", f"size{z}", *(f"{i}{s}" for i, s in enumerate(v) if s != "0")] for k, v, z, _ in patterns]
    weight = dict.fromkeys(sorted({f for row in feats for f in row}), 0.0)
    total = sum(p[3] for p in patterns) or 1
    model = lambda row: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight[f] for f in row)))))
    for _ in range(steps):
        grad = dict.fromkeys(weight, 0.0)
        for row, q, p in zip(feats, post, patterns):
            gap = (q - model(row)) * p[3] / total
            for f in row:
                grad[f] += gap
        for f in weight:
            weight[f] += 2.0 * grad[f] - 1e-4 * weight[f]
    return {p[:3]: model(row) for row, p in zip(feats, patterns)}


def spans(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """One row per document with ``kind`` NULL, and one per span: kind, start, end, base, probability.

    NULL and empty texts have no spans; repeated rows stay apart. Candidates are written
    once to the shared folder, without texts.
    """
    rows = materialise(candidates(df, text, keep), "pii-candidates")
    found = rows.where("kind is not null").groupBy("kind", "votes", "size_class").count().collect()
    chance = fit([tuple(r) for r in found])
    lookup = df.sparkSession.createDataFrame(
        [(*k, p) for k, p in chance.items()], "kind string, votes string, size_class int, probability double")
    by_kind = Window.partitionBy(ROW, "kind").orderBy("j")
    before = by_kind.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum(F.col("gap").cast("long")).over(by_kind.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum(F.col("length").cast("long")).over(before), F.lit(0))
    placed = (rows.join(F.broadcast(lookup), ["kind", "votes", "size_class"], "left").repartition(ROW)
              .withColumn("start", start).withColumn("end", F.col("start") + F.col("length")))
    return placed.where(F.col("kind").isNull() | F.col("base") | (F.col("probability") >= threshold)).select(
        ROW, *keep, "kind", "start", "end", "base", "probability")


def report(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and digest of base spans, and all spans as text, per document."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    item = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, item))), lambda x: x["said"]), ",")
    base = F.col("base")
    return found.groupBy(ROW).agg(
        *[F.first(c).alias(c) for c in keep],
        *[F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("kind").isNotNull()).alias("spans")).drop(ROW)
