"""The named queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskengine.llm import (chat, contamination, hard_negatives, html_text, licenses, mixing, ngram_join, pii, ranked_search, simhash, token_files,
                            toxicity, weighted_sampling)
from riskengine.llm.mixing import Target
from riskengine.session import materialise as stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Holds the template's own control strings in both of its texts.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.parse(stored(chat.render(chat.fold(chat.as_events(rows))), "chat")))


SQL["op6_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
q AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS quoted FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 7 + length(quoted) ELSE 14 + length(role) + length(quoted) END)::BIGINT AS formatted_chars
FROM q GROUP BY conv_id
"""


def license_sql() -> str:
    """The scan as joins over one row per word, with suppression as NOT EXISTS."""
    quote = lambda x: str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(quote(v) for v in (r.rule, r.lead, r.keyword, r.regex, r.label, r.priority, r.confidence, r.base)) + ")"
                     for r in licenses.rules())
    return f"""
WITH rules(rule, lead, keyword, regex, label, priority, confidence, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT row, words, unnest(range(len(words))) AS s FROM d),
h AS (SELECT row, s, words[s + 1] AS lead, array_to_string(words[s + 1 : s + {licenses.CONTEXT_WORDS}], ' ') AS context
      FROM p WHERE words[s + 1] IN (SELECT lead FROM rules)),
f AS (SELECT row, s, r.*, regexp_extract(context, '^(' || regex || ')(?: |$)', 1) AS found
      FROM h JOIN rules r USING (lead) WHERE contains(context, keyword)),
g AS (SELECT *, s + len(string_split(found, ' ')) AS e FROM f WHERE found <> ''),
k AS (SELECT * FROM g a WHERE base OR NOT EXISTS (SELECT 1 FROM g b WHERE b.row = a.row AND b.s <= a.s AND a.e <= b.e
      AND (b.priority < a.priority OR b.priority = a.priority
           AND (b.e - b.s > a.e - a.s OR b.s = a.s AND b.e = a.e AND b.rule < a.rule))))
SELECT doc_id, any_value(len(words))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
  min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(confidence), 0)::DOUBLE AS score
FROM d LEFT JOIN k USING (row) GROUP BY row, doc_id
"""


SQL["op8_license_scan"] = license_sql()


@query
def op10_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op10_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM d),
u AS (SELECT row, len(s) AS n, unnest(s) AS t FROM g),
c AS (SELECT a.row AS a, b.row AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
    FROM u a JOIN u b ON a.t = b.t AND a.row <> b.row GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (n + m - k)),
r AS (SELECT row AS a, row AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(h.doc_id) AS component_id
FROM g JOIN r ON g.row = r.a JOIN g h ON h.row = r.b GROUP BY g.row, g.doc_id, g.s
"""


@query
def op2_pii_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.spans(docs, keep=("doc_id",)))


@query
def op5_token_files(spark, sf_dir):
    return token_files.write_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_benchmark_containment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.contained(docs, table(spark, sf_dir, "benchmark")).drop("_key")


SQL["op9_benchmark_containment"] = r"""
WITH a AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark),
s AS (SELECT item, item_id, least(5, len(w)) AS width, list_distinct(list_transform(range(len(w) - least(5, len(w)) + 1),
  lambda i: array_to_string(w[i + 1 : i + least(5, len(w))], ' '))) AS g FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
q AS (SELECT item, item_id, width, len(g) AS n_item, unnest(g) AS gram FROM s),
k AS (SELECT DISTINCT width FROM s),
p AS (SELECT row, doc_id, width, unnest(list_distinct(list_transform(range(len(w) - width + 1), lambda i: array_to_string(w[i + 1 : i + width], ' ')))) AS gram
  FROM a, k WHERE len(w) >= width)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM p JOIN q USING (gram, width) GROUP BY row, doc_id, item, item_id, n_item HAVING count(*) * 4 >= n_item * 3
"""


@query
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).drop("segments")


@query
def op3_weighted_fingerprint(spark, sf_dir):
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_temperature_mix(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("_h")


SQL["op4_temperature_mix"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, '') AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents),
s AS (SELECT name, sum(n)::BIGINT AS total, sum(n) / sum(sum(n)) OVER () AS p FROM d GROUP BY name),
m AS (SELECT max(p) AS top, min(p) AS low, max(total) AS largest FROM s),
e AS (SELECT *, CASE WHEN low = top THEN 0 ELSE greatest(0, ceil({mixing.STEPS} * (1 - ln({Target().repeat}) / ln(top / low)))) / {mixing.STEPS} END AS a FROM m),
z AS (SELECT any_value(a) AS a, sum(p ** a) AS z, any_value(largest) * sum(p ** a) / any_value(top) ** any_value(a) AS budget FROM s, e),
t AS (SELECT name, total, round(p ** a / z * budget)::BIGINT AS quota, greatest(1, ceil(round(budget) / {mixing.BLOCK_TOKENS})) AS blocks FROM s, z),
u AS (SELECT d.*, total, quota, blocks, unnest(range(greatest(1, ceil(quota / total))::BIGINT)) AS epoch FROM d JOIN t USING (name) WHERE quota > 0),
v AS (SELECT *, ('0x' || substr(md5({mixing.SEED} || ':' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u,
    ('0x' || substr(md5({mixing.SEED + 1} || ':' || epoch || ':' || name || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS v FROM u),
w AS (SELECT *, epoch * total + coalesce(sum(n) OVER (PARTITION BY name, epoch ORDER BY u, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM v),
x AS (SELECT *, floor(pos / quota * blocks)::BIGINT AS block FROM w WHERE pos < quota)
SELECT doc_id, source, epoch, block, row_number() OVER (PARTITION BY block ORDER BY v, doc_id, epoch, n) AS slot, n AS n_tokens FROM x
"""


@query
def op1_host_suffix_array(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).drop("n_repeated")


SQL["op1_host_suffix_array"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, row_number() OVER () AS row, regexp_split_to_array(regexp_replace(h, '</?b>', '', 'g'), '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT row, page_id, url, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM b),
d AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(part, '<br>', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM c)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text,
  length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), ''))::BIGINT AS n_chars FROM d GROUP BY row, page_id, url
"""


@query
def op11_simhash_pivots(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_hard_negatives(spark, sf_dir):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=shifted, anchor=F.col("id") % 100 == 0)


SQL["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding,
    lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS row FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM e a JOIN e b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
q AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 5
"""


@query
def op13_bag_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_bag_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
u AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM u GROUP BY row, term),
g AS (SELECT f.*, count(*) OVER (PARTITION BY term) AS df FROM f),
s AS (SELECT row, doc_id, term, floor(1000 * ln((2 * t.n + 2) / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * g.n * t.n) // t.l)))) AS value FROM g, t),
j AS (SELECT item, item_id, unnest(w) AS term FROM i),
k AS (SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, sum(value)::BIGINT AS score FROM j JOIN s USING (term) GROUP BY item, row),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM k WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
