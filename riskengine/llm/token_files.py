"""Token ids as grammar-compressed block files.

Texts are dealt out by ranges of the key and sorted; each task encodes its texts, cuts
the ids into blocks of about a million and writes each block in the format of
:mod:`grammar`, as a row (part, block, keys, sizes, payload) of a Parquet folder, so that
Spark commits files and repeats lost tasks. Blocks in the order (part, block) hold the
documents in the order of the key. Memory holds one block, whatever a task holds.

A cut before a single space between two other characters that are not white space is
always a boundary of the tokenizer's own pieces, so distinct words are encoded once
and gathered; texts with other white space around spaces are encoded whole, and so are
texts with a string that the tokenizer's file declares as a token (it becomes that token, as
with the library's own settings).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskengine.llm import grammar, shingles
from riskengine.llm.text import small_batches, tidy, whole
from riskengine.session import shared_dir

TOKENIZER = "byte_bpe_50k.json"
END = 2                    # id after each document
BLOCK_IDS = 1_000_000
PIECE = 8 << 20            # bytes of text split at a time
CACHED_WORDS = 750_000     # some 40 MB a worker
GROUP = 50                 # words of one string given to the tokenizer: longer ones take more time a word
OTHER_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
ODD = f"^ | $|{OTHER_SPACE} | {OTHER_SPACE}"
SCHEMA = "part int, block int, keys array<bigint>, sizes array<bigint>, payload binary"


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """One per worker process; the vocabulary file belongs to an installed package."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(name))
    opens = np.zeros(t.get_vocab_size(), dtype=bool)
    opens[[i for s, i in t.get_vocab().items() if s.startswith("Ġ")]] = True
    return t, opens


@lru_cache(maxsize=4)
def odd_texts(name: str) -> str:
    """Texts that are encoded whole: other white space around spaces, or strings that the tokenizer's file declares as tokens."""
    declared = [re.escape(a.content) for a in tokenizer(name)[0].get_added_tokens_decoder().values()]
    return "|".join([ODD, *declared])


def encode_whole(t, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def encode(column: pa.Array, name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """The ids of each text (without an end id); NULL is the empty text."""
    t, odd_text = tokenizer(name)[0], odd_texts(name)
    for part in shingles.pieces(column.fill_null(""), PIECE):
        odd = pc.match_substring_regex(part, odd_text).to_numpy(zero_copy_only=False)
        empty = pc.equal(part, "").to_numpy(zero_copy_only=False)
        plain = part.filter(pa.array(~odd & ~empty))
        apart = iter(encode_whole(t, part.filter(pa.array(odd)).to_pylist()))
        words = iter(encode_words(name, plain) if len(plain) else ())
        for o, e in zip(odd, empty):
            yield np.zeros(0, np.uint32) if e else next(apart) if o else next(words)


AS_IS = np.arange(256, dtype=np.uint8)


def gathered(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of stretches, one stretch after another."""
    ends = np.cumsum(size)
    return np.repeat(starts - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Words:
    """Ids of words with a space before them, kept by a worker process for all its tasks.

    The first ``CACHED_WORDS`` distinct words stay; later ones are encoded again in each piece.
    Words are found by a hash and told apart by their bytes, so results do not depend on what is kept.
    """

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # in order, with the word each belongs to
        self.word = np.zeros(0, np.int64)
        self.text, self.text_cut = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.cut = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def known(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The kept word that equals each of the given ones, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.where(self.hashes[near] == h, self.word[near], -1)
        at[(at >= 0) & (self.text_cut[at + 1] - self.text_cut[at] != size)] = -1
        hit = np.flatnonzero((at >= 0) & (size > 0))
        if len(hit):
            same = data[gathered(starts[hit], size[hit])] == self.text[gathered(self.text_cut[at[hit]], size[hit])]
            at[hit[~np.logical_and.reduceat(same, np.cumsum(size[hit]) - size[hit])]] = -1
        return at

    def find(self, t, opens: np.ndarray, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) for the words of ``table``, which are distinct."""
        offsets = np.frombuffer(table.buffers()[1], np.int64)[table.offset:table.offset + len(table) + 1]
        data = np.frombuffer(table.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        starts, size = offsets[:-1] - offsets[0], np.diff(offsets)
        h = shingles.word_hashes(data, starts, starts + size, AS_IS)
        at = self.known(h, data, starts, size)
        missing = np.flatnonzero(at < 0)
        new = table.take(pa.array(missing)).to_numpy(zero_copy_only=False).tolist()
        parts = encode_whole(t, [" " + " ".join(new[i:i + GROUP]) for i in range(0, len(new), GROUP)])
        more = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        cut = np.append(np.flatnonzero(opens[more]), len(more)).astype(np.int64)
        first = len(self.cut) - 1
        at[missing] = first + np.arange(len(new))
        ids, ends = np.concatenate([self.ids, more]), np.concatenate([self.cut, len(self.ids) + cut[1:]])
        if first + len(new) <= CACHED_WORDS:
            order = np.argsort(h[missing], kind="stable")
            place = np.searchsorted(self.hashes, h[missing][order])
            self.hashes, self.word = np.insert(self.hashes, place, h[missing][order]), np.insert(self.word, place, first + order)
            self.text_cut = np.concatenate([self.text_cut, self.text_cut[-1] + np.cumsum(size[missing])])
            self.text = np.concatenate([self.text, data[gathered(starts[missing], size[missing])]])
            self.ids, self.cut = ids, ends
        return ids, ends[at], ends[at + 1] - ends[at]


@lru_cache(maxsize=4)
def words_of(name: str) -> Words:
    return Words()


def encode_words(name: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """Texts whose spaces stand single between other characters: each distinct word is encoded once."""
    t, opens = tokenizer(name)
    lists = pc.split_pattern(texts, " ")
    at = lists.offsets.to_numpy()
    flat = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at = at - at[0]
    code = flat.indices.to_numpy().astype(np.int64)
    table = flat.dictionary
    first = np.unique(code[at[:-1]])  # words that open a text have no space before them
    heads = encode_whole(t, table.take(pa.array(first)).to_pylist())
    every, begin, size = words_of(name).find(t, opens, table)
    ids = np.concatenate([every, *heads])
    length = np.array([len(h) for h in heads], np.int64)
    size = np.concatenate([size, length])
    begin = np.concatenate([begin, len(every) + np.cumsum(length) - length])
    code[at[:-1]] = len(table) + np.searchsorted(first, code[at[:-1]])
    n = size[code]
    ends = np.cumsum(n)
    index = np.repeat(begin[code] - (ends - n), n) + np.arange(int(ends[-1]))
    out, bounds = ids[index], np.concatenate([[0], ends])[at]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield out[a:b]


def write(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", name: str = TOKENIZER, end: int = END,
          block_ids: int = BLOCK_IDS) -> None:
    """Encode and write. NULL keys come first; rows of one key are ordered by text; repeated rows are all
    written, and a key with very many rows spreads over several parts."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        keys, held, total = [], [], 0

        def flush():
            sizes = [len(x) for x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([grammar.compress(np.concatenate(held))], pa.binary())],
                names=["part", "block", "keys", "sizes", "payload"])
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), name)):
                keys.append(k)
                held.append(np.append(ids, np.uint32(end)))
                total += len(held[-1])
                if total >= block_ids:
                    yield flush()
                    keys, held, total, block = [], [], 0, block + 1
        if held:
            yield flush()

    small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), whole(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("key", F.xxhash64("text"), "row").sortWithinPartitions("key", "text")
    dealt.select("key", "text").mapInArrow(blocks, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: key, start, n_tokens (with the end id), ids_crc32.

    Starts are sums over blocks of a part, over parts of a group and over groups; no window
    grows beyond the square root of the number of parts.
    """
    files = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, keys, sizes, payload in zip(*(batch.column(i) for i in range(5))):
                sizes = np.array(sizes.values.to_numpy(zero_copy_only=False), np.int64)
                ids = grammar.decompress(payload.as_buffer().to_pybytes()).astype("<u4")
                stop = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(stop - sizes, stop)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part.as_py()), pa.int32()), pa.array(np.full(n, block.as_py()), pa.int32()), keys.values,
                     pa.array(stop - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "block", "key", "inside", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(tidy(decode), "part int, block int, key long, inside long, n_tokens long, ids_crc32 long")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")
    block = files.select("part", "block", total)
    group = (F.col("part") / 1024).cast("int").alias("group")
    parts = block.groupBy("part").agg(F.sum("n").alias("n")).withColumn("group", group)
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (block.withColumn("in_part", before(Window.partitionBy("part").orderBy("block"))).drop("n")
              .join(parts.withColumn("in_group", before(Window.partitionBy("group").orderBy("part"))).drop("n"), "part")
              .join(groups.withColumn("in_all", before(Window.orderBy("group"))).drop("n"), "group")
              .select("part", "block", (F.col("in_part") + F.col("in_group") + F.col("in_all")).alias("from")))
    return docs.join(starts, ["part", "block"]).select(
        "key", (F.col("from") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Both ways through files in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stages/tokens-{uuid.uuid4().hex}"
    write(df, path, key, text, **options)
    return read(df.sparkSession, path).withColumnRenamed("key", key)
