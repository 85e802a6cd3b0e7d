"""Token files against the tokenizer itself, and the grammar as an exact round trip."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskengine.llm import grammar, token_files

HARD = ["", None, "a", " a", "a ", "a  b", "a b", "a \nb", "a\n b c", "a  b", "a  b", "a   b", "a\x85 b", "a \x1c b", "a b\n\nc d", "don't we'll 12 345 ...!",
        "É é ñ \U0001f600 x", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>b", "one two<|endoftext|> three four", "<|endoftext", "a <|endoftext|>", "word " * 5000 + "end", "x" * 30000, " ", "\n", "a\tb c", "  ", "a　 b c", "﻿a b", "a\x0b b"]


def plain(texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))  # the library's own settings
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encode_equals_the_tokenizer():
    assert [x.tolist() for x in token_files.encode(pa.array(HARD * 2))] == plain(HARD * 2)


@pytest.mark.parametrize("kept", [0, 7, 10**6])
def test_words_are_told_apart_whatever_is_kept(monkeypatch, kept):
    """Also if all words share one hash."""
    monkeypatch.setattr(token_files, "CACHED_WORDS", kept)
    texts = ["one two three", "two one three four", "é two é zwei zweí", "one", "four three two one é", "a bb aa b", "bb aa a"]
    for constant in (False, True):
        token_files.words_of.cache_clear()
        if constant:
            monkeypatch.setattr(token_files.shingles, "word_hashes", lambda d, a, b, f: np.zeros(len(a), np.uint64))
        for _ in range(3):
            for i in range(0, len(texts), 2):
                part = texts[i:i + 2]
                assert [x.tolist() for x in token_files.encode(pa.array(part))] == plain(part)
    token_files.words_of.cache_clear()


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    r = np.random.default_rng(seed)
    for ids in (np.zeros(0, int), np.array([5]), np.array([7] * 1001), np.array([1, 2] * 500 + [3]), r.integers(0, 5, 4000),
                r.integers(0, 2**30, 900), np.array([1, 1, 2] * 300), np.tile(r.integers(0, 60000, 40), 60)):
        block = grammar.compress(ids, 4)
        assert (grammar.decompress(block) == ids).all() and len(grammar.decompress(block)) == len(ids)
        for a, b in np.sort(r.integers(0, len(ids) + 1, (40, 2)), axis=1):
            assert (grammar.decode_range(block, a, b) == ids[a:b]).all()
    first, rules, lengths, seq = grammar.unpack(block)
    assert len(rules) and lengths.max() >= 8 and len(seq) < len(ids) / 8


@pytest.mark.parametrize("block_ids", [50, 1_000_000])
def test_files_equal_the_tokenizer(spark, block_ids):
    rows = [(i * 2, t) for i, t in enumerate(HARD)][::-1] + [(4, "same"), (4, "same"), (None, "no key"), (-3, "first")]
    got = sorted(token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string"), block_ids=block_ids).collect(),
                 key=lambda x: x.start)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want, at = [], 0
    for (k, _), ids in zip(ordered, plain([t for _, t in ordered])):
        ids = ids + [2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(x) for x in got] == want


def test_empty_table(spark):
    assert token_files.write_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_places_of_chosen_pairs_are_looked_up(monkeypatch):
    """A place counts as such if its first id opens and its second one closes a chosen pair; the input stays as it is."""
    ids = np.array([9, 10] * 1000 + [7, 8] * 500 + [7, 9, 10] * 300, np.uint32)
    before, looked_up, inner = ids.copy(), [], np.searchsorted
    monkeypatch.setattr(grammar.np, "searchsorted", lambda a, v, *x, **k: looked_up.append(len(v)) or inner(a, v, *x, **k))
    block = grammar.compress(ids, 200)
    monkeypatch.undo()
    assert (ids == before).all() and (grammar.decompress(block) == ids).all()
    assert looked_up[0] == 1300 + 500  # of 9 10 and 7 8; the 300 of 7 9 are none, since 9 opens a better pair
