"""Byte-level BPE over a corpus: each distinct pre-token of the whole corpus is encoded once.

1. Every text is split into pre-tokens. Texts are taken in blocks of bounded size; a block keeps, for each text, the positions
   of its pre-tokens as codes into the block's own list of distinct pre-tokens, so a word as frequent as "the" is sent once a
   block and not once a position. Codes and lists go to a table in the shared folder, bucketed by block, so that a repeated
   task can't number them anew, and texts are never shuffled.
2. The lists are dealt out by a hash of the pre-token, packed as columns, so that all occurrences of one meet in one group of
   bounded size; there each distinct one is encoded once, and its ids are joined to every block that asked for it.
3. Ids return to their blocks, in the buckets of the table, and each text is put together by position.
4. Decoding joins every id to the token-byte table, a table as large as the vocabulary whatever the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.text import blocks
from nearfield.storage import bucketed

BLOCK_BYTES = 64 << 20
#: Input bytes for each group of the word shuffle, and least number of groups.
GROUP_BYTES = 64 << 20
#: Buckets of the table of blocks, at most (Spark's own bound).
MOST_BUCKETS = 100_000
_ROWS = "block long, bucket int, payload binary"
#: The bucket of rows that hold texts.
TEXTS = -1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pat: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pat, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def token_counts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each text; null has none."""
    one = _encoding(path, pattern())
    return np.array([len(one.encode_ordinary(t)) if t else 0 for t in texts], np.int64)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The token-byte table, dense in the id; null for an unused id."""
    ranks = _ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return pa.array(out, pa.binary())


class _Codes(dict):
    """Numbers pre-tokens in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart so that they compress well."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T
        n = 4
        while n and not planes[n - 1].any():
            n -= 1
        raw = np.ascontiguousarray(planes[:n]).tobytes()
        z = zstandard.compress(raw, 3)
        out.append(struct.pack("<QBQ", len(a), n, len(z)) + z)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, n, z = struct.unpack_from("<QBQ", data, at)
        at += 17
        planes = np.zeros((4, size), np.uint8)
        raw = zstandard.decompress(data[at : at + z], max_output_size=max(1, n * size))
        planes[:n] = np.frombuffer(raw, np.uint8).reshape(n, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += z
    return out


def _pack_words(words: pa.Array) -> bytes:
    """UTF-8 pre-tokens: their lengths, and their bytes."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2].to_pybytes()[off[0] : off[-1]] if len(words) else b""
    return pack(np.diff(off).astype(np.uint32), np.frombuffer(raw, np.uint8).astype(np.uint32))


def _unpack_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    codes, size, raw = unpack(data)
    raw, ends = raw.astype(np.uint8).tobytes(), np.cumsum(size).tolist()
    return codes, [raw[e - n : e] for e, n in zip(ends, size.tolist(), strict=True)]


def pretokens(docs: DataFrame, pat: str, groups: int, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds for each block: some texts' ids and codes (bucket TEXTS), and its distinct pre-tokens of each bucket."""

    def split(batches):
        find = regex.compile(pat).findall
        block, seen, held, size = TaskContext.get().partitionId() << 24, _Codes(), [], 0

        def rows():
            # frequent pre-tokens get small codes
            count = np.zeros(len(seen), np.int64)
            for _, _, codes in held:
                count += np.bincount(codes, minlength=len(seen))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(seen), np.uint32)
            rank[order] = np.arange(len(seen), dtype=np.uint32)
            out = []
            for ids, sizes, codes in held:
                known = np.array([i is not None for i in ids], np.uint32)
                wide = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
                low, high = (wide & np.uint64(0xFFFFFFFF)).astype(np.uint32), (wide >> np.uint64(32)).astype(np.uint32)
                out.append((TEXTS, pack(known, low, high, sizes, rank[codes])))
            words = list(seen)
            hashed = np.fromiter((crc32(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(groups)
            by = order[np.argsort(hashed[order], kind="stable")]
            listed = pa.array(words, pa.string())
            ends = np.searchsorted(hashed[by], np.arange(groups), side="right")
            for k, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                if i < j:
                    out.append((k, pack(rank[by[i:j]]) + _pack_words(listed.take(pa.array(by[i:j])))))
            return pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["block", "bucket", "payload"])

        for b in blocks(batches, text):
            found = [find(t or "") for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in found], np.uint32)
            codes = np.fromiter(map(seen.__getitem__, chain.from_iterable(found)), np.uint32, int(sizes.sum()))
            held.append((b.column(0).to_pylist(), sizes, codes))
            size += b.column(1).nbytes
            if size >= block_bytes:
                yield rows()
                block, seen, held, size = block + 1, _Codes(), [], 0
        if held:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(split, _ROWS)


def encode_words(listed: DataFrame, path: str, pat: str) -> DataFrame:
    """For each (block, bucket): codes, number of ids of each, and the ids; a distinct pre-token is encoded once."""

    def encode_group(table: pa.Table) -> pa.Table:
        one, ids_of, flat, ends = _encoding(path, pat)._encode_single_piece, {}, [], [0]
        payloads = []
        for payload in table.column("payload").to_pylist():
            codes, words = _unpack_words(payload)
            at = []
            for w in words:
                k = ids_of.get(w)
                if k is None:
                    k = ids_of[w] = len(ids_of)
                    flat += one(w)
                    ends.append(len(flat))
                at.append(k)
            payloads.append((codes, np.array(at, np.int64)))
        flat, ends = np.array(flat, np.uint32), np.array(ends, np.int64)
        start, size = ends[:-1], np.diff(ends)
        packed = [pack(codes, size[at], _ragged(flat, start[at], size[at])) for codes, at in payloads]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(packed, pa.binary())})

    return listed.groupBy("bucket").applyInArrow(encode_group, _ROWS)


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start:start+size] for each pair, end to end."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return values[at]


def _assembled(texts: pa.Table, listed: pa.Table):
    """For a block: each of its texts, as doc_id and ids."""
    parts = [unpack(p) for p in listed.column("payload").to_pylist()]
    codes = np.concatenate([c for c, _, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    sizes = np.concatenate([n for _, n, _ in parts]).astype(np.int64) if parts else codes
    flat = np.concatenate([i for _, _, i in parts]) if parts else np.zeros(0, np.uint32)
    size, start = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    size[codes], start[codes] = sizes, np.cumsum(sizes) - sizes
    del parts
    for payload in texts.column("payload"):
        known, low, high, per, text_codes = unpack(payload.as_py())
        ids = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
        ends = np.cumsum(per.astype(np.int64))
        n = size[text_codes]
        tokens = _ragged(flat, start[text_codes], n)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])]
        for i in range(len(per)):
            yield int(ids[i]) if known[i] else None, tokens[bounds[i] : bounds[i + 1]]


def _groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """So many groups that one holds a bounded part of the words: from the size that the planner knows of the input."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(known // group_bytes, 1 << 20) if known < 1 << 60 else least)


def encode(docs: DataFrame, finish, schema: str, path: str | None = None, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode every text and hand (doc_id, ids) pairs of a block to ``finish``, which makes the block's result table.

    Null and empty texts have no ids. Repeated rows come out each. Other columns are ignored. No rows for an empty table.
    """
    where, pat, groups = path or tokenizer_path(), pattern(), _groups(docs)
    split = bucketed(pretokens(docs, pat, groups, text, block_bytes), "block", min(groups, MOST_BUCKETS), "bpe_pretokens")
    back = encode_words(split.where(F.col("bucket") != TEXTS), where, pat)

    def assemble(texts: pa.Table, listed: pa.Table) -> pa.Table:
        return finish(_assembled(texts, listed), where)

    return split.where(F.col("bucket") == TEXTS).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assemble, schema)


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes that ids stand for: each id joined to the token-byte table, in order."""
    known = token_bytes(path)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(known) or (got := known.take(pa.array(ids))).null_count:
        raise ValueError("an id outside the vocabulary")
    off = np.frombuffer(got.buffers()[1], np.int32)
    return got.buffers()[2].to_pybytes()[off[0] : off[len(got)]] if len(got) else b""


def decoded_texts(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become replacement characters, null ids null."""
    where = path or tokenizer_path()

    def back(batches):
        for b in batches:
            text = [None if i is None else decode(np.array(i, np.int32), where).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")


def _finisher(with_ids: bool):
    def finish(pairs, where) -> pa.Table:
        out = [(d, len(i), i.astype(np.int32) if with_ids else None, hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(i, where)).hexdigest()) for d, i in pairs]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        return pa.table({n: pa.array(c, k) for c, (n, k) in zip(cols, kinds.items(), strict=True) if with_ids or n != "ids"})

    return finish


def digests(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return encode(docs, _finisher(False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path, block_bytes=block_bytes)


def encoded(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same with the ids themselves."""
    return encode(docs, _finisher(True), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", path, block_bytes=block_bytes)


def query(spark, sf_dir: str) -> DataFrame:
    """op10_byte_bpe over all documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
