"""Blocks of documents, and packed messages between blocks and buckets of keys.

Documents are dealt to blocks by a hash of doc_id and text, so that null and repeated ids spread.  A block sends each
bucket for which it has keys one packed message; the bucket answers each block.  Per-key work is thus done in numpy over
sorted arrays, keys are combined within a block before they are shuffled (a key in a third of all rows costs a bucket
one entry a block), and texts are shuffled once: every step that needs them reuses that exchange.

There are as many buckets as blocks.  A block holds BLOCK_BYTES of text, or more: the root of the input times
MESSAGE_BYTES, which keeps the text behind each message at MESSAGE_BYTES (5.6 MB at 30 GB, 33 MB at 1 TB, 330 MB at
100 TB, where 300,000 blocks are; a worker holds some six times a block).
"""

from __future__ import annotations

import ctypes
import math
import pickle
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import prepare, text_bytes

BLOCK_BYTES, MESSAGE_BYTES = 4 << 20, 1 << 10
MESSAGE = "bucket int, block int, payload binary"
ANSWER = "block int, bucket int, payload binary"


@cache
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Of a worker; made once, as messages are many and small."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    return _coders()[0].compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    return pickle.loads(_coders()[1].decompress(data))


def block_bytes(total: int) -> int:
    return max(BLOCK_BYTES, math.isqrt(total * MESSAGE_BYTES))


def blocks(docs: DataFrame, size: int | None = None) -> tuple[DataFrame, int, int]:
    """(block, doc_id, text), the number of blocks, and the bytes of text."""
    prepare(docs.sparkSession)
    total = text_bytes(docs)
    n = total // (size or block_bytes(total)) + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), n, total


def ordered(t: pa.Table) -> pa.Table:
    """A block's rows in an order that does not depend on how the shuffle delivered them: by doc_id, then by text."""
    ids = t["doc_id"].to_numpy(zero_copy_only=False) if not t["doc_id"].null_count else t["doc_id"].fill_null(int(K.NULL_ID)).to_numpy()
    at = np.argsort(ids, kind="stable")
    ids_sorted = ids[at]
    if (ids_sorted[1:] == ids_sorted[:-1]).any():
        texts = t["text"].to_pylist()
        at = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], zlib.crc32((texts[i] or "").encode()), texts[i] or "")))
    return t.take(pa.array(at))


def ids_of(t: pa.Table) -> np.ndarray:
    return t["doc_id"].fill_null(int(K.NULL_ID)).to_numpy()


def rows(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields})


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket and where each bucket starts (n + 1 bounds)."""
    at = np.argsort(bucket, kind="stable")
    return at, np.searchsorted(bucket[at], np.arange(n + 1))


def squeezed(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as their differences, byte planes apart: what pack() then compresses well."""
    return np.diff(keys, prepend=K.U64(0)).view(np.uint8).reshape(-1, 8).T


def unsqueezed(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(K.U64).reshape(-1), dtype=K.U64)


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8 if not len(a) or a.max() < 256 else np.uint32 if a.max() < 2**32 else np.uint64)


def planes(a: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs, the bytes of one rank together."""
    size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size].T


def unplanes(p: np.ndarray) -> np.ndarray:
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, : p.shape[0]] = p.T
    return out.view("<u8").reshape(-1)


def release() -> None:
    """Gives freed memory back to the system: a worker keeps what the largest of its groups took otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def frugal(f):
    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        release()
        return out

    return run


def frugal_pair(f):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        release()
        return out

    return run
