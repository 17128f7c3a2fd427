"""Byte-level BPE over texts as a tree reduction: halves are encoded and joined at their seam."""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.tables import documents

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, and of the first window at a seam.
LEAF, WINDOW = 8192, 64
#: A character that no white space rule matches, before a plain blank: the pattern never matches across the
#: two, so a match ends here whatever stands further left or right.
SAFE = regex.compile(r"[^\s\x1c-\x1f\x85](?=[ \t\n\r])")
_CODECS: dict = {}


class Codec:
    """One vocabulary: encode, join and decode. Built once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for k, v in ranks.items():
            self.size_of[v] = len(k)
        self.pattern = regex.compile(pattern)
        self.leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from those of both parts; only a window at the seam is encoded again."""
        a, b = last_cut(left), first_cut(right)
        n_left = self.ids_in(left_ids[::-1], len(left[a:].encode()))
        n_right = self.ids_in(right_ids, len(right[:b].encode()))
        return left_ids[:len(left_ids) - n_left] + self.leaf(left[a:] + right[:b]) + right_ids[n_right:]

    def ids_in(self, ids: list[int], n_bytes: int) -> int:
        """How many of the first ids make up ``n_bytes``."""
        n = 0
        while n_bytes > 0:
            n_bytes -= int(self.size_of[ids[n]])
            n += 1
        if n_bytes < 0:
            raise ValueError("a token reaches over a cut")
        return n

    def decode(self, ids) -> bytes:
        """Bytes of all ids; neighbours are concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def last_cut(text: str) -> int:
    """The last place in ``text`` where a match is certain to end; the window looked at grows."""
    width = WINDOW
    while True:
        low = max(0, len(text) - width)
        at = [m.end() for m in SAFE.finditer(text, low)]
        if at or low == 0:
            return at[-1] if at else 0
        width *= 2


def first_cut(text: str) -> int:
    width = WINDOW
    while True:
        m = SAFE.search(text, 0, width + 1)
        if m and m.end() < width + 1:
            return m.end()
        if width >= len(text):
            return len(text)
        width *= 2


def small(batches, rows: int = 128):
    """The same rows in batches that stay small when each row grows to a list of ids."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    if (path, pattern) not in _CODECS:
        import public_tokenizers

        _CODECS[path, pattern] = Codec(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and its ``ids``, as the tiktoken library gives them.

    A text longer than a leaf is halved down to leaves.  Two neighbours are joined by
    encoding again the stretch between the last certain match end of the left one and the
    first of the right one; the window in which these are looked for doubles until they are
    found.  Outside the stretch no token can change, since no match of the pattern spans a
    non-blank and a following blank.  Null or empty text: no ids.  Equal texts and ids are
    encoded each on its own; other columns are ignored.
    """
    def run(batches):
        own = codec(path, pattern)
        for b in small(batches):
            ids = [own.encode(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(x) for x in ids])
            flat = np.concatenate([np.zeros(0, dtype=np.int32), *(np.array(x, dtype=np.int32) for x in ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: ``doc_id``, ``ids`` and the ``decoded`` bytes. Null ids decode to no bytes; an unknown id is an error."""
    def run(batches):
        own = codec(path, pattern)
        for b in small(batches):
            col = b.column("ids")
            out = [own.decode(x.values.to_pylist()) for x in col]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    given = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return given.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
