"""Document fingerprints by consistent weighted sampling, native Spark only.

A document is a weighted set: its five-word shingles with their counts. Sample k draws for
every term x of weight w, from hashes of (x, k) alone, r and c from Gamma(2, 1) and b
from U(0, 1); with t = floor(ln w / r + b) the sample is the pair (x, t) with the smallest
ln c - r (t - b) - r. Two documents agree on a sample with a chance equal to their
generalised Jaccard similarity, sum of minima over sum of maxima.

The draws are made in an order that suits weight 1, which most terms have: then t is 0 and the
value is the logarithm of a = c exp(-r (1 - b)), which follows Exp(1). So a is drawn first, from
one hash, and r, c and b given a: with z = 1 + E / a and another exponential F, c = a z,
r = ln z + F and b = 1 - ln z / r have the joint distribution above. Terms of weight 1 are thus compared by
their hashes; only the smallest one, and terms of larger weight, need logarithms.

Terms of weight 1 that a text and its edited text share are drawn once for both. Terms become rows only inside a task: explode and a partial aggregate of minima per
text stand next to each other, so what is dealt out is one row per text. A minimum is kept
as one long: the value in steps of 2^-20 above the low bits of the term and t. A signature holds 16 bits
of a hash of each minimum; different samples share them with a chance of 2^-16, far below the error of 128 samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.llm.text import whole
from riskengine.session import materialise

WIDTH = 5
SAMPLES = 128
LANE = 8         # samples drawn from one copy of a term's row
GAP = r"[\x20\x09-\x0D]+"
VALUE_STEPS = 1 << 20
NAME_BITS = 28
NAME = (1 << NAME_BITS) - 1
ORDER_BITS = 64 - NAME_BITS  # of a hash, above the term's low bits


def terms(text: Column) -> Column:
    """array<struct<term: long, weight: int>> of the distinct shingles, sorted by term."""
    words = F.transform(F.filter(F.split(text, GAP), lambda w: w != ""), lambda w: F.xxhash64(w))
    at = lambda h: F.when(F.size(h) >= WIDTH, F.sequence(F.lit(0), F.size(h) - WIDTH)).otherwise(
        F.when(F.size(h) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    # places past the end are NULL, which a hash passes over
    grams = lambda h: F.transform(at(h), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]))
    ordered = F.transform(F.array(F.transform(F.array(words), grams)[0]), lambda a: F.sort_array(a))[0]

    def counted(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        # as above, transform over one element names a value, so that it is made only once
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("weight"))))[0]
    return F.transform(F.array(ordered), counted)[0]


def order(term: Column, k: Column) -> Column:
    """Sample k of a term as a hash that orders terms of weight 1, with the term's low bits below."""
    return F.xxhash64(term, k).bitwiseAND(~NAME).bitwiseOR(term.bitwiseAND(NAME))


def exponential(order: Column) -> Column:
    """The value a of Exp(1) that an order stands for; it rises with the order."""
    u = (F.shiftright(order, NAME_BITS) + F.lit(float(1 << (ORDER_BITS - 1)) + 0.5)) / F.lit(float(1 << ORDER_BITS))
    return -F.log1p(-u)


def packed(value: Column, name: Column) -> Column:
    return F.shiftleft(F.floor(value * VALUE_STEPS).cast("long"), NAME_BITS) + name


def once(order: Column) -> Column:
    """The sample (term, 0) of a term of weight 1."""
    return packed(F.ln(exponential(order)), order.bitwiseAND(NAME))


def often(df: DataFrame, weight: Column, k: Column, out: str) -> DataFrame:
    """Add ``out``: the sample (term, t) of the rows' terms, of any weight; NULL for a NULL weight.

    Step by step, so that what is used several times is computed once.
    """
    own, more = f"{out}_own", f"{out}_more"
    half = lambda i: (F.shiftrightunsigned(more, 32 * i).bitwiseAND((1 << 32) - 1) + F.lit(0.5)) / F.lit(float(1 << 32))
    a, z, r, b, t, lw = (f"{out}_{x}" for x in ("a", "z", "r", "b", "t", "lw"))
    kept = df.columns
    df = df.withColumn(lw, F.ln(weight.cast("double")))
    df = df.withColumns({own: F.when(F.col(lw).isNotNull(), order(F.col("term"), k)), more: F.when(F.col(lw).isNotNull(), F.xxhash64("term", k, F.lit(1)))})
    df = df.withColumn(a, exponential(F.col(own)))
    df = df.withColumn(z, F.log1p(-F.ln(half(0)) / F.col(a)))
    df = df.withColumn(r, F.col(z) - F.ln(half(1)))
    df = df.withColumn(b, 1 - F.col(z) / F.col(r))
    df = df.withColumn(t, F.floor(F.col(lw) / F.col(r) + F.col(b)))
    later = F.when(F.col(t) == 0, F.lit(0.0)).otherwise(F.col(z) - F.col(r) * (F.col(t) - F.col(b)) - F.col(r))
    return df.select(*kept, packed(F.ln(a) + later, F.col("term").bitwiseXOR(F.col(t) * 7919).bitwiseAND(NAME)).alias(out))


def drawn(x: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """From rows (keys, term, weight): keys, ``orders`` and ``mores``, the minima of terms of weight 1 and of the others.

    A term of weight 1 has one row per ``LANE`` samples, another one a row per sample; slots tell them
    apart. If the rows are dealt out by some of the keys, no further exchange is needed; otherwise a few
    rows per text are exchanged. A row without a term draws nothing, and its keys stay.
    """
    lanes = -(-samples // LANE)
    slots = [F.array(*[F.lit(i) for i in range(lanes)]), F.sequence(F.lit(lanes), F.lit(lanes + samples - 1)), F.array(F.lit(-1))]
    single = F.col("weight") == 1
    each = x.select(*keys, "term", "weight", F.explode(F.when(single, slots[0]).when(F.col("weight") > 1, slots[1]).otherwise(slots[2])).alias("slot"))
    names = [f"m{k}" for k in range(LANE)]
    several = often(each, F.when(F.col("weight") > 1, F.col("weight")), F.col("slot") - lanes, "more")
    values = several.select(*keys, "slot", "more", *[F.when(single, order(F.col("term"), F.col("slot") * LANE + k)).alias(n) for k, n in enumerate(names)])
    least = values.groupBy(*keys, "slot").agg(*[F.min(n).alias(n) for n in names], F.min("more").alias("more"))
    parts = F.sort_array(F.collect_list(F.struct("slot", F.when(F.col("slot") < lanes, F.array(*names)).alias("m"), "more")))
    return least.groupBy(*keys).agg(parts.alias("parts")).select(
        *keys, F.slice(F.flatten(F.transform(F.filter("parts", lambda p: (p["slot"] >= 0) & (p["slot"] < lanes)), lambda p: p["m"])), 1, samples).alias("orders"),
        F.transform(F.filter("parts", lambda p: p["slot"] >= lanes), lambda p: p["more"]).alias("mores"))


def smaller(a: Column, b: Column) -> Column:
    """The minima of two sets of terms; a set without terms has none."""
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def names_of(least: Column) -> Column:
    """A name of each sample: only equality counts from here on."""
    return F.transform(least, lambda v: (F.hash(v).bitwiseAND(0xFFFF) - 0x8000).cast("short"))


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``rows`` (unique by ``keys``) with words: keys and ``signature``, array<short>, a name of each sample.

    Texts without words are left out.
    """
    x = rows.select(*keys, F.explode(terms(F.col(text))).alias("x")).select(
        *keys, F.col("x.term").alias("term"), F.col("x.weight").alias("weight"))
    return drawn(x, keys, samples).select(*keys, names_of(smaller(F.transform("orders", once), F.col("mores"))).alias("signature"))


BOTH = 2  # side of the terms of weight 1 that both texts of a row have


def signatures_of_both(rows: DataFrame, keys: list[str], texts: tuple[str, str], also: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``rows`` (unique by ``keys``): the keys, the columns ``also``, and ``own`` and ``changed``,
    the signatures of both texts (see :func:`signatures`), empty for a text without words.

    Terms of weight 1 that both texts have are drawn once: a text's minima are the smaller ones of
    these terms and of the rest of its terms. What is passed on travels with one row without a term,
    so signatures need not be dealt out to meet it.
    """
    at = rows.select(*keys, F.struct(*also).alias("also"), F.array(*[terms(F.col(t)) for t in texts]).alias("t"))
    ones = lambda i: F.transform(F.filter(F.col("t")[i], lambda e: e["weight"] == 1), lambda e: e["term"])
    at = at.withColumns({"a": ones(0), "b": ones(1)}).withColumn("c", F.array_intersect("a", "b"))
    tagged = lambda terms, side: F.transform(terms, lambda e: F.struct(F.lit(side).alias("side"), e.alias("term"), F.lit(1).alias("weight")))
    heavy = lambda i: F.transform(F.filter(F.col("t")[i], lambda e: e["weight"] > 1), lambda e: F.struct(
        F.lit(i).alias("side"), e["term"].alias("term"), e["weight"].alias("weight")))
    none = F.array(F.struct(F.lit(BOTH).alias("side"), F.lit(None).cast("long").alias("term"), F.lit(None).cast("int").alias("weight")))
    every = F.concat(tagged(F.col("c"), BOTH), tagged(F.array_except("a", "c"), 0), tagged(F.array_except("b", "c"), 1), heavy(0), heavy(1), none)
    x = at.select(*keys, "also", F.explode(every).alias("x")).select(
        *keys, *[F.col(f"x.{c}").alias(c) for c in ("side", "term", "weight")], F.when(F.col("x.term").isNull(), F.col("also")).alias("also"))
    sides = drawn(x, [*keys, "side", "also"], samples).groupBy(*keys).agg(
        F.first("also", ignorenulls=True).alias("also"), *[F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{c}{i}") for i in range(BOTH + 1) for c in ("orders", "mores") if (c, i) != ("mores", BOTH)])
    empty = F.array().cast("array<bigint>")
    part = lambda c: F.coalesce(F.col(c), empty)
    least = [smaller(F.transform(smaller(part(f"orders{BOTH}"), part(f"orders{i}")), once), part(f"mores{i}")) for i in (0, 1)]
    return sides.select(*keys, *[F.col(f"also.{c}").alias(c) for c in also], names_of(least[0]).alias("own"), names_of(least[1]).alias("changed"))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing samples; two empty signatures are alike, an empty and another one are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).when(F.size(b) == 0, 0.0).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.hex(v.cast("long") + 0x8000)), " ")


CONTENT = ["k0", "h"]  # a row's content: its key (a number also for NULL) and the hash of its text


def content(df: DataFrame, key: str, text: str) -> DataFrame:
    t = whole(text)
    return df.select(F.col(key).alias("key"), t.alias("text")).select(
        F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))).alias("k0"),
        F.xxhash64(F.col("key").isNull(), "text").alias("h"), "key", "text")


def followers(contents: DataFrame) -> DataFrame:
    """Each content's next one (n_k0, n_h) in the order of key and text hash; the last is followed by the first.

    Only ids are sorted: ranges are written with their number, neighbours are found inside
    each range, and ranges meet through one row each.
    """
    dealt = contents.repartitionByRange(*CONTENT).select(*CONTENT, F.spark_partition_id().alias("part"))
    ids = materialise(dealt, "cws-order")
    heads = ids.groupBy("part").agg(F.min(F.struct(*CONTENT)).alias("o"))
    first = heads.agg(F.min("o").alias("first"))
    # one row per range of Spark's own partitioning
    after = heads.select("part", F.lead("o").over(Window.orderBy("part")).alias("o")).join(F.broadcast(first)).select(
        "part", F.coalesce("o", "first").alias("o"))
    inside = F.lead(F.struct(*CONTENT)).over(Window.partitionBy("part").orderBy(*CONTENT))
    return ids.withColumn("next", inside).join(F.broadcast(after), "part").select(
        *CONTENT, F.coalesce("next", "o").alias("next")).select(*CONTENT, F.col("next.k0").alias("n_k0"), F.col("next.h").alias("n_h"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the first quarter of the following row's text. NULL texts are
    empty; NULL keys come first; rows of one key are ordered by text hash; a repeated row is
    followed by its own copy. Texts are dealt out once, by content, and the quarters once more.
    """
    rows = content(df, key, text)
    order = materialise(followers(rows.select(*CONTENT).distinct()).join(
        rows.groupBy(*CONTENT).agg(F.min(F.length("text")).alias("n"), F.count("*").alias("copies")), CONTENT), "cws-next")
    dealt = rows.repartition(*CONTENT)
    numbered = dealt.withColumn("copy", F.row_number().over(Window.partitionBy(*CONTENT).orderBy("key")))
    single = numbered.where("copy = 1").select(F.col("k0").alias("n_k0"), F.col("h").alias("n_h"), F.col("text").alias("next_text"))
    quarter = (F.col("n") / 4).cast("int")
    heads = single.join(order, ["n_k0", "n_h"]).select(*CONTENT, "n", "copies", F.left("next_text", quarter).alias("head"))
    both = numbered.join(heads, CONTENT)
    head = F.when(F.col("copy") < F.col("copies"), F.left("text", quarter)).otherwise(F.col("head"))
    both = both.withColumn("edited", F.concat(F.left("text", F.col("n") - quarter), head))
    signed = materialise(signatures_of_both(
        both.withColumn("edited_sha256", F.sha2("edited", 256)), [*CONTENT, "copy"], ("text", "edited"),
        ["copies", "key", "n", "edited_sha256"], samples), "cws-signatures")
    following = signed.where("copy = 1").select(F.col("k0").alias("n_k0"), F.col("h").alias("n_h"), F.col("own").alias("after"))
    nexts = order.select(*CONTENT, "n_k0", "n_h").join(following, ["n_k0", "n_h"]).select(*CONTENT, "after")
    after = F.when(F.col("copy") < F.col("copies"), F.col("own")).otherwise(F.col("after"))
    return signed.join(nexts, CONTENT).select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), after).alias("near_next"))
