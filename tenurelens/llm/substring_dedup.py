"""Repeated word windows, found with a count-min prefilter and then grouped exactly."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm import exchange as X
from tenurelens.llm import text as T
from tenurelens.llm.tables import cuts, documents, text_bytes

U = np.uint64
#: Counters per window and row of the sketch, and rows.
WIDTH, ROWS = 8, 2
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def counter(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of a window hash in one row of the sketch, as the top bits of a 64-bit key."""
    return T.mix(h + U(0x632BE59BD9B4E019) * U(row + 1)) & U((1 << 64) - (1 << (64 - bits)))


def by_document(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def windows(table: pa.Table, width: int):
    """Both hashes of each window, its first word and its row; and the words before each row."""
    data, offsets = T.utf8(table.column("text"))
    values, first = T.all_words(data, offsets)
    return *T.runs(values, first, width, second=True), first, data, offsets


def estimate(h: np.ndarray, told: list[tuple], bits: int) -> np.ndarray:
    """Windows that every row of the sketch counts more than once."""
    repeated = np.ones(len(h), dtype=bool)
    for row in range(ROWS):
        uniq, inverse = np.unique(counter(h, row, bits), return_inverse=True)
        flags = X.joined([X.unpack_flags(d) for kind, _, _, d in told if kind == row], bool)
        if len(flags) != len(uniq):
            raise ValueError(f"{len(uniq)} counters asked, {len(flags)} answered")
        repeated &= flags[inverse]
    return repeated


def distinct(h1, h2, ids):
    """Each distinct window once, ascending, with its smallest id; and the place of every window among them."""
    order = np.lexsort((ids, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], ids[order][new], place


def substring_dedup(docs: DataFrame, width: int = 50, block_bytes: int = X.BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words not covered by a window that also starts in a document with a smaller id.

    A window is ``width`` consecutive words.  The text goes through three passes over the
    same blocks of documents.  (1) Each block counts its windows in the cells of a
    count-min sketch (sparse: the cells it touched); shards own ranges of cells and add
    up the blocks' sketches.  The sketch grows with the data, and a cell's sum is never
    below a window's true count.  (2) Windows whose cells all count more than once are
    sent, each distinct one once per block with its smallest id, under a 128-bit key; the
    shards find the smallest id of all.  (3) Blocks mark and cut the words.

    Null or empty text: no words, kept text empty.  A document shorter than a window
    keeps everything.  Rows with equal ids count as one document for the comparison, and
    each gives a row; rows with a null id are compared with nothing and kept whole.  Other
    columns are ignored.
    """
    d = documents(docs, id_col, text_col)
    spark = d.sparkSession
    total = text_bytes(d)
    bits = max(16, int(np.ceil(np.log2(max(total, 64) / 6 * WIDTH))))
    shards = cuts(total, block_bytes)
    blocks, _ = X.into_blocks(d, total, block_bytes)

    def sketch(block, table):
        h, _, _, _, first, _, _ = windows(table, width)
        out = []
        for row in range(ROWS):
            cells, n = np.unique(counter(h, row, bits), return_counts=True)
            out += X.pieces(block, row, shards, cells, (n > 1).astype(np.uint8))
        return out

    def merge(pieces):
        out = []
        for row in range(ROWS):
            own = [(s, b, *X.unpack(p, U, np.uint8)) for k, s, b, p in pieces if k == row]
            if not own:
                continue
            low, high = (X.lowest(own[0][0] + i, shards) >> (64 - bits) for i in (0, 1))
            counts = np.zeros(high - low + 2, dtype=np.uint8)
            cells = [((c >> U(64 - bits)) - U(low)).astype(np.int64) for _, _, c, _ in own]
            for c, (_, _, _, more) in zip(cells, own):
                counts[c] = np.minimum(counts[c] + 1 + more, 2)
            out += [(s, b, row, X.pack_flags(counts[c] > 1)) for c, (s, b, _, _) in zip(cells, own)]
        return out

    def candidates(table, told):
        table = by_document(table)
        h1, h2, start, row, first, data, offsets = windows(table, width)
        ids = table.column("doc_id").to_numpy()
        if table.column("doc_id").null_count:
            known = ~table.column("doc_id").is_null().to_numpy()
            ids = np.where(known, np.nan_to_num(ids), 0).astype(np.int64)
        else:
            known = np.ones(len(ids), dtype=bool)
        take = estimate(h1, told, bits) & known[row]
        return table, h1[take], h2[take], ids[row[take]], start[take], row[take], first, data, offsets

    def exact(block, table, told):
        _, h1, h2, ids, *_ = candidates(table, told)
        a, b, least, _ = distinct(h1, h2, ids)
        return X.pieces(block, 9, shards, a, b, least)

    def smallest(pieces):
        own = [(s, b, *X.unpack(p, U, U, np.int64)) for _, s, b, p in pieces]
        h1, h2, ids = (np.concatenate([o[i] for o in own]) for i in (2, 3, 4))
        _, _, least, place = distinct(h1, h2, ids)
        cut = np.cumsum([0] + [len(o[2]) for o in own])
        return [(s, b, 9, X.pack(least[place[x:y]])) for (s, b, *_), x, y in zip(own, cut[:-1], cut[1:])]

    def cut_words(block, table, told):
        if block is None:
            return result([], [], [], [], [])
        table, h1, h2, ids, start, row, first, data, offsets = candidates(table, told)
        _, _, _, place = distinct(h1, h2, ids)
        least = X.joined([X.unpack(p, np.int64)[0] for k, _, _, p in told if k == 9], np.int64)
        hit = least[place] < ids if len(ids) else np.zeros(0, dtype=bool)
        edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        np.add.at(edge, start[hit], 1)
        np.add.at(edge, start[hit] + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        return cut_result(table, gone, first, data, offsets)

    first_asked = X.ask(blocks, sketch)
    sketched = X.answer(first_asked, merge, shards)
    least = X.answer(X.ask_again(blocks, sketched, exact), smallest, shards)
    return X.finish(blocks, sketched.unionByName(least), cut_words, SCHEMA)


def result(ids, n_words, n_removed, spans, kept) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "spans": spans if isinstance(spans, pa.Array) else pa.array(spans, span), "kept": kept if isinstance(kept, pa.Array) else pa.array(kept, pa.string())})


def cut_result(table, gone, first, data, offsets) -> pa.Table:
    """Rows of SCHEMA once ``gone`` says which words go."""
    n = np.diff(first)
    inner = np.zeros(len(gone) + 1, dtype=bool)
    inner[first] = True
    before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    after = np.concatenate((gone[1:], [False])) if len(gone) else gone
    s = np.flatnonzero(gone & (~before | inner[:-1]))
    e = np.flatnonzero(gone & (~after | inner[1:])) + 1
    at = np.searchsorted(s, first)
    row = np.repeat(np.arange(len(n)), np.diff(at))
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(s - first[row], pa.int64()), pa.array(e - first[row], pa.int64())], ["start", "end"]))
    removed = np.concatenate(([0], np.cumsum(gone)))
    removed = removed[first[1:]] - removed[first[:-1]]
    texts, sizes = [], []
    for i, j in T.slices(offsets):
        own = data[offsets[i]:offsets[j]].copy()
        ws, we, at = T.words(own, offsets[i:j + 1] - offsets[i])
        keep = np.flatnonzero(~gone[first[i]:first[j]])
        doc = np.searchsorted(at, keep, "right") - 1
        edge = np.zeros(len(own) + 1, dtype=np.int8)
        edge[ws[keep]] += 1
        np.add.at(edge, we[keep], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        gap = we[keep[:-1]][doc[1:] == doc[:-1]]
        own[gap] = 32
        mask[gap] = True
        texts.append(own[mask])
        sizes.append(np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets[i:j + 1] - offsets[i]]))
    blob = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32) if sizes else np.zeros(1, dtype=np.int32)
    kept = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(blob)])
    return result(table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id"), n, removed, spans, kept)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
