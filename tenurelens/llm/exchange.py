"""Blocks of documents that ask a table spread over shards, and get their answers back.

A document belongs to a fixed block (a hash of its id), a key to a fixed shard (its
top bits).  A block sends each distinct key once, as one packed row per shard; the
shard merges what all blocks sent and answers in the order asked.  So a key that
every document holds reaches its shard once per block, never once per row.  Empty
pieces are not sent: there are never more rows than keys.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.tables import cuts, give_back, partitions_for

#: Bytes of text in a block, about.
BLOCK_BYTES = 8 << 20
PIECES = "shard long, block long, kind int, data binary"
U = np.uint64


def block_hash():
    """Hash of a document's id; of its text where the id is null, so that such rows are spread too."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")))


def into_blocks(docs: DataFrame, total_bytes: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with its ``block``, dealt out by it; and how many blocks there are."""
    n = cuts(total_bytes, block_bytes)
    out = docs.withColumn("block", F.pmod(block_hash(), F.lit(n)))
    return out.repartition(partitions_for(docs.sparkSession, n), "block"), n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes; the first is ascending and kept as differences."""
    out = [np.int64(len(arrays[0])).tobytes()]
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        if i == 0:
            with np.errstate(over="ignore"):
                a = np.diff(a, prepend=a.dtype.type(0))
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for i, t in enumerate(map(np.dtype, types)):
        a = np.ascontiguousarray(raw[at:at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n)
        at += n * t.itemsize
        if i == 0:
            with np.errstate(over="ignore"):
                a = np.cumsum(a, dtype=t)
        out.append(a)
    return out


def pack_values(a: np.ndarray) -> bytes:
    """An array in any order as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def unpack_values(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def split(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that ascending 64-bit keys fall into, and where each one's keys start and end."""
    shard = (((keys >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[cut], np.append(cut, len(keys))


def lowest(shard: int, shards: int) -> int:
    """Smallest key of a shard."""
    return -(-(shard << 32) // shards) << 32


def pack_flags(flags: np.ndarray) -> bytes:
    return np.int64(len(flags)).tobytes() + np.packbits(flags).tobytes()


def unpack_flags(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=8), count=int(np.frombuffer(data, dtype=np.int64, count=1)[0])).astype(bool)


def zipped(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unzipped(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def pieces(block: int, kind: int, shards: int, keys: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Rows of PIECES for ascending ``keys``."""
    which, cut = split(keys, shards)
    return [(int(s), block, kind, pack(keys[a:b], *(m[a:b] for m in more))) for s, a, b in zip(which, cut[:-1], cut[1:])]


def as_table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
                    names=["shard", "block", "kind", "data"])


def listed(table: pa.Table) -> list[tuple]:
    """Rows of PIECES in a fixed order."""
    return sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "block", "data"))))


def lean(work):
    """What ``work()`` gives; the memory it took is given back."""
    try:
        return work()
    finally:
        give_back()


def ask(blocks: DataFrame, request) -> DataFrame:
    """``request(block, table)`` gives each block's pieces."""

    def run(key, table):
        return lean(lambda: as_table(request(int(key[0].as_py()), table.combine_chunks())))

    return blocks.groupBy("block").applyInArrow(run, PIECES)


def ask_again(blocks: DataFrame, answers: DataFrame, request) -> DataFrame:
    """As ``ask`` for blocks that have had answers: ``request(block, table, answers)``."""

    def run(key, table, told):
        return lean(lambda: as_table(request(int(key[0].as_py()), table.combine_chunks(), listed(told)) if table.num_rows else []))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, PIECES)


def answer(requests: DataFrame, reply, shards: int) -> DataFrame:
    """``reply(pieces)`` gives the answers of one shard, as rows of PIECES."""

    def run(key, table):
        return lean(lambda: as_table(reply(listed(table))))

    asked = requests.repartition(partitions_for(requests.sparkSession, shards), "shard")
    return asked.groupBy("shard").applyInArrow(run, PIECES)


def finish(blocks: DataFrame, answers: DataFrame, apply, schema: str) -> DataFrame:
    """``apply(block, table, answers)`` gives each block's result."""

    def run(key, table, told):
        return lean(lambda: apply(int(key[0].as_py()) if table.num_rows else None, table.combine_chunks(), listed(told)))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
