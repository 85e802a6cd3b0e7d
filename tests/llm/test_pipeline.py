"""Each stage of the pipeline on the smallest tables against a plain version."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from riskengine.llm import mixing, token_files, toxicity
from test_contamination import plain as contained
from test_ngram_join import plain_components, plain_set


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, 0), (10**6, "", "en", "src0", 0)], docs.schema))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    step = lambda name: (lambda d: spark.createDataFrame(d.collect(), d.schema))(stages[name](spark, docs, sf))
    row = lambda d: Counter((x.doc_id, x.text) for x in d.collect())

    clean = step("toxicity")
    verdict = {(x.doc_id, x.score < toxicity.THRESHOLD) for x in toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert row(clean) == Counter({k: n for k, n in row(docs).items() if (k[0], True) in verdict}) and clean.columns == columns
    docs = clean

    unique = step("n-gram Jaccard join")
    rows = sorted(row(docs), key=str)
    s = [plain_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and 4 * len(s[i] & s[j]) >= 3 * len(s[i] | s[j])]
    part = plain_components(links, range(len(s)))
    kept = Counter(part[rows.index(k)] for k in row(unique).elements() if plain_set(k[1]))
    assert set(kept.values()) == {1} and len(kept) == len({part[i] for i in range(len(s)) if s[i]}) and unique.columns == columns
    for i, k in row(unique):
        if plain_set(k):
            assert i == min((rows[j][0] for j in range(len(rows)) if part[j] == part[rows.index((i, k))] and rows[j][0] is not None), default=None)
    assert {k: n for k, n in row(unique).items() if not plain_set(k[1])} == {k: n for k, n in row(docs).items() if not plain_set(k[1])}
    docs = unique

    free = step("benchmark decontamination")
    items = [tuple(x) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert row(free) == Counter({k: n for k, n in row(docs).items() if not contained([k], items)}) and free.columns == columns
    docs = free

    mixed = step("mixing sources to target weights")
    want = Counter(x.doc_id for x in mixing.plan(docs).collect())
    assert Counter(x.doc_id for x in mixed.collect()) == want and set(row(mixed)) == set(row(docs)) and mixed.columns == columns
    docs = mixed

    written = sorted(map(tuple, step("token-ID / binary output").select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    t, _ = token_files.tokenizer(token_files.TOKENIZER)
    at, out = 0, []
    for x in sorted(docs.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, (x.text or "").encode())):
        ids = np.array(t.encode(x.text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((at, x.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert written == out
