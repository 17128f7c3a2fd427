"""Repeated byte strings, found by interval expansion on the Burrows-Wheeler transform of candidate stretches."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm import exchange as X
from tenurelens.llm import text as T
from tenurelens.llm.tables import cuts, documents, give_back, ship, text_bytes

U = np.uint64
#: Distinct stretches of a group up to which it is put into one text; larger groups are compared by window hash.
HOT = 4096
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: A byte that UTF-8 never holds stands between stretches.
BETWEEN = 0xFF
REPEATED, SEND, STAND_IN, HASHES, REPEATED_HASHES, ALONE = range(6)
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (w - width)], h[w - width:]) if width < w else h


def stretches(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows (strings of ``length`` bytes within one text) that have the same least inner hash.

    The hash of a window's least k-gram depends on the window alone, so equal windows have
    equal keys wherever they start.  Returns first window, number of windows, key, hash of the
    run's bytes, and whether a window may recur inside the run.
    """
    k = max(1, length * 8 // 25)
    w, out = length - k + 1, []
    for i, j in T.slices(offsets):
        base, own = offsets[i], data[offsets[i]:offsets[j]]
        n = len(own) - length + 1
        if n <= 0:
            continue
        at = offsets[i:j + 1] - base
        sums = T.prefix_sums(T._BYTE[own], T._BASE)
        with np.errstate(over="ignore"):
            h = (sums[k:] - sums[:-k]) * T.powers(T._BASE, len(sums))[1][:len(sums) - k]
            h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        least = sliding_min(h, w)
        out_of = np.zeros(len(own) + 1, dtype=np.int32)
        np.add.at(out_of, np.maximum(at[:-1], at[1:] - length + 1), 1)
        np.add.at(out_of, at[1:], -1)
        inside = np.cumsum(out_of[:n]) == 0
        same = np.zeros(n, dtype=bool)
        same[1:] = (least[1:] == least[:-1]) & inside[:-1]
        start = np.flatnonzero(inside & ~same)
        last = np.zeros(n, dtype=bool)
        last[:-1] = ~same[1:] | ~inside[1:]
        last[-1] = True
        end = np.flatnonzero(inside & last)
        leaves = np.flatnonzero((h[:n] == least) & inside & ~last)  # the least k-gram moves out, yet the run goes on
        again = np.zeros(len(start), dtype=bool)
        again[np.searchsorted(start, leaves, "right") - 1] = True
        with np.errstate(over="ignore"):
            content = T.mix(T.range_hashes(sums, start, end + length, T._BASE) + (end - start).astype(U))
        out.append((start + base, end - start + 1, T.mix(least[start]), content, again))  # least values are small; mixed, they fill all shards
    kinds = (np.int64, np.int64, U, U, bool)
    return [X.joined([o[c] for o in out], kind) for c, kind in enumerate(kinds)]


def suffix_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the cyclic text ``t``, by doubling; and which neighbours differ within 8 bytes."""
    n = len(t)
    cyclic = np.concatenate((t, np.resize(t, 8)))
    key = np.zeros(n, dtype=U)
    for i in range(8):
        key = (key << U(8)) | cyclic[i:i + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    apart = new.copy()
    rank = np.empty(n, dtype=np.int64)
    width = 8
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = first
        if width >= n:
            break
        alone = new & np.append(new[1:], True)
        slot = np.flatnonzero(~alone)
        if not len(slot):
            break
        at = order[slot]
        key = (rank[at] << 32) | rank[(at + width) % n]
        by = np.argsort(key, kind="stable")
        order[slot] = at[by]
        key = key[by]
        new[slot[1:]] |= key[1:] != key[:-1]
        width *= 2
    return order, apart


def recurring(t: np.ndarray, length: int) -> np.ndarray:
    """Positions of ``t`` whose ``length`` bytes also start at another position.

    Neighbours in suffix order that differ within their first 8 bytes are read off the sorted
    keys.  From there on, level by level, each interval of suffixes that begin with one string
    is extended to the left through the transform: the end of an extended interval that is
    not marked yet has a common prefix of just this level.  Only intervals that got a new end
    are extended again.  What is unmarked at ``length`` has a common prefix of that or more.
    """
    n = len(t)
    order, mark = suffix_order(t)
    if length < 8:
        raise ValueError("length must be 8 or more")
    bwt = t[order - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[by] = np.arange(n)
    following = np.full(n, n, dtype=np.int64)  # next place of the same character
    follows = bwt[by[1:]] == bwt[by[:-1]]
    following[by[:-1][follows]] = by[1:][follows]
    places = bwt[by].astype(np.int64) * n + by  # every character's places, ascending
    # the characters of an interval are met at the ends of the transform's runs: few where texts repeat
    run_ends = np.append(np.flatnonzero(bwt[1:] != bwt[:-1]), n - 1)
    run = np.zeros(n, dtype=np.int64)
    run[run_ends[:-1] + 1] = 1
    run = np.cumsum(run)
    mark = np.append(mark, True)
    ends = np.flatnonzero(mark[1:]) + 1
    low = np.append(0, ends[:-1])
    for _ in range(8, length):
        if not len(ends):
            break
        size = run[ends - 1] - run[low] + 1
        whole = np.cumsum(size)
        of = np.repeat(np.arange(len(ends)), size)
        at = run_ends[np.arange(whole[-1]) + np.repeat(run[low] - whole + size, size)]
        at[whole - 1] = ends - 1
        last = following[at] >= ends[of]
        at, of = at[last], of[last]
        new = ~mark[lf[at] + 1]
        at, of = at[new], of[new]
        # the extended interval starts where the character first occurs from the old start on
        low = np.searchsorted(places, bwt[at].astype(np.int64) * n + low[of])
        ends = lf[at] + 1
        mark[ends] = True
    long = ~mark[:-1]
    out = np.zeros(n, dtype=bool)
    at = np.flatnonzero(long)
    out[order[at]] = True
    out[order[at - 1]] = True
    return out


def suffix_dedup(docs: DataFrame, length: int = 200, hot: int = HOT, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes not covered by a string of ``length`` bytes that also starts anywhere else.

    One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, the maximal removed ``spans`` and
    the ``kept`` bytes (which may cut a character).  Nothing matches across documents; the same
    document and overlaps count.

    1. A text's windows fall into stretches by their least k-gram.  Blocks send the key and
       content hash of each distinct stretch; a shard sees all stretches that can share a window.
       A stretch whose content occurs twice is repeated throughout; one that is alone in its
       group and can't recur in itself is not.
    2. Stretches that occur once send their bytes, together with one copy of each repeated one
       of their group.  The shard builds the transform of these and expands its intervals.
       A group of more than ``hot`` stretches instead sends the 128-bit hashes of its windows,
       which spread over all shards; the result is the same.
    3. Blocks mark the bytes.

    Null or empty text: no bytes.  Texts shorter than ``length`` stay whole.  Rows with equal
    or null ids are documents of their own.  Other columns are ignored, but for those named in
    ``carry``, which come back in a struct ``carried``.
    """
    if length < 25:
        raise ValueError("length must be 25 or more")
    d = documents(docs, id_col, text_col)
    schema = SCHEMA
    if carry:
        carried = F.struct(*[F.col(c) for c in carry])
        ship(docs.sparkSession)
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), carried.alias("carried"))
        schema += ", carried " + d.schema["carried"].dataType.simpleString()
    total = text_bytes(d)
    shards = cuts(total, block_bytes)
    blocks, _ = X.into_blocks(d, total, block_bytes)

    def found(table):
        data, offsets = T.utf8(table.column("text"))
        start, n, key, content, again = stretches(data, offsets, length)
        order = np.lexsort((content, key))
        a, b = key[order], content[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(a), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        return data, offsets, start, n, key, content, again, order[new], place

    def first_request(block, table):
        *_, key, content, again, pick, place = found(table)
        count = (np.minimum(np.bincount(place, minlength=len(pick)), 2) + 4 * again[pick]).astype(np.uint8)
        return X.pieces(block, 0, shards, key[pick], content[pick], count)

    def first_reply(pieces):
        own = [(sh, b, *X.unpack(p, U, U, np.uint8)) for _, sh, b, p in pieces]
        key, content, count = (np.concatenate([o[i] for o in own]) for i in (2, 3, 4))
        order = np.lexsort((content, key))  # stable: the smallest block first
        a, b = key[order], content[order]
        new_key = np.ones(len(a), dtype=bool)
        new_key[1:] = a[1:] != a[:-1]
        new = new_key.copy()
        new[1:] |= b[1:] != b[:-1]
        group, kind = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        times = np.bincount(kind, weights=count[order] & 3).astype(np.int64)
        kinds = np.bincount(group[new])
        single = np.bincount(group, weights=times[kind] == 1) > 0
        state = np.where(times[kind] == 1, SEND, REPEATED)
        state[(times[kind] > 1) & new & single[group]] = STAND_IN
        state[(state != REPEATED) & (kinds[group] > hot)] += HASHES - SEND
        state[(times[kind] == 1) & (kinds[group] == 1) & (count[order] < 4)] = ALONE
        out = np.empty(len(key), dtype=np.uint8)
        out[order] = state
        ends = np.cumsum([0] + [len(o[2]) for o in own])
        return [(sh, b, 0, X.zipped(out[x:y])) for (sh, b, *_), x, y in zip(own, ends[:-1], ends[1:])]

    def states(told):
        return X.joined([X.unzipped(p, np.uint8) for k, _, _, p in told if k == 0], np.uint8)

    def sent(data, start, n, pick, state):
        """Indexes of the stretches that are sent as bytes, in order; and as window hashes."""
        return pick[(state == SEND) | (state == STAND_IN)], pick[(state == HASHES) | (state == REPEATED_HASHES)]

    def window_hashes(data, start, n, some):
        a, b = [], []
        for i in some:
            own = data[start[i]:start[i] + n[i] + length - 1]
            a.append(T.byte_windows(own, length))
            s = T.prefix_sums(T.mix(T._BYTE[own]), T._OTHER_BASE)
            at = np.arange(n[i])
            b.append(T.mix(T.range_hashes(s, at, at + length, T._OTHER_BASE)))
        return X.joined(a, U), X.joined(b, U)

    def second_request(block, table, told):
        data, _, start, n, key, _, _, pick, place = found(table)
        state = states(told)
        by_bytes, by_hash = sent(data, start, n, pick, state)
        which, cut = X.split(key[by_bytes], shards)
        out = []
        for sh, x, y in zip(which, cut[:-1], cut[1:]):
            part = by_bytes[x:y]
            sizes = np.array([len(part), *(n[part] + length - 1)], dtype=np.int64)
            out.append((int(sh), block, 1, X.zipped(np.concatenate((sizes.view(np.uint8), *(data[start[i]:start[i] + n[i] + length - 1] for i in part))))))
        h1, h2 = window_hashes(data, start, n, by_hash)
        twice = np.repeat(state[(state == HASHES) | (state == REPEATED_HASHES)] == REPEATED_HASHES, n[by_hash])
        a, b, count, _ = tallied(h1, h2, 1 + twice.astype(np.int64))
        return out + X.pieces(block, 2, shards, a, b, np.minimum(count, 2).astype(np.uint8))

    def second_reply(pieces):
        out, texts, owners = [], [], []
        for k, sh, b, p in pieces:
            if k == 1:
                raw = X.unzipped(p, np.uint8)
                m = int(raw[:8].view(np.int64)[0])
                sizes = raw[8:8 + 8 * m].view(np.int64)
                body, ends = raw[8 + 8 * m:], np.cumsum(sizes)
                edge = np.insert(body, ends, BETWEEN)
                texts.append(edge)
                owners.append((sh, b, sizes))
        if texts:
            hit, at = recurring(np.concatenate(texts), length), 0
            for sh, b, sizes in owners:
                starts = np.cumsum(sizes + 1) - sizes - 1 + at
                n = sizes - length + 1
                place = np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n)
                out.append((sh, b, 1, X.pack_flags(hit[place])))
                at += int((sizes + 1).sum())
        own = [(sh, b, *X.unpack(p, U, U, np.uint8)) for k, sh, b, p in pieces if k == 2]
        if own:
            h1, h2, count = (np.concatenate([o[i] for o in own]) for i in (2, 3, 4))
            _, _, sums, place = tallied(h1, h2, count.astype(np.int64))
            ends = np.cumsum([0] + [len(o[2]) for o in own])
            out += [(sh, b, 2, X.pack_flags(sums[place[x:y]] > 1)) for (sh, b, *_), x, y in zip(own, ends[:-1], ends[1:])]
        return out

    def cut_bytes(block, table, told):
        if block is None:
            return result(table, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
        data, offsets, start, n, key, _, _, pick, place = found(table)
        state = states(told)
        by_bytes, by_hash = sent(data, start, n, pick, state)
        hit = np.zeros(len(data) + 1, dtype=bool)
        whole = np.flatnonzero(np.isin(state[place], (REPEATED, STAND_IN, REPEATED_HASHES))) if len(place) else place
        hit[spread(start[whole], n[whole])] = True
        flags = X.joined([X.unpack_flags(p) for k, _, _, p in told if k == 1], bool)
        hit[spread(start[by_bytes], n[by_bytes])[flags]] = True
        h1, h2 = window_hashes(data, start, n, by_hash)
        flags = X.joined([X.unpack_flags(p) for k, _, _, p in told if k == 2], bool)
        hit[spread(start[by_hash], n[by_hash])[flags[tallied(h1, h2, np.ones(len(h1), dtype=np.int64))[3]]]] = True
        edge = np.zeros(len(data) + length + 1, dtype=np.int64)
        at = np.flatnonzero(hit)
        edge[at] += 1
        edge[at + length] -= 1
        return result(table, np.cumsum(edge)[:len(data)] > 0, data, offsets)

    one = X.answer(X.ask(blocks, first_request), first_reply, shards)
    two = X.answer(X.ask_again(blocks, one, second_request), second_reply, shards)
    return X.finish(blocks, one.unionByName(two), cut_bytes, schema)


def spread(start, n):
    """All positions of ranges."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def tallied(h1, h2, count):
    """Distinct pairs, ascending, their summed counts, and the place of each entry among them."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(place, weights=count, minlength=int(new.sum())).astype(np.int64), place


def result(table, gone, data, offsets) -> pa.Table:
    """Rows of SCHEMA, with what the table carries, once ``gone`` says which bytes go."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
    after = np.concatenate((gone[1:], [False])) if len(gone) else gone
    s = np.flatnonzero(gone & (~before | first[:-1]))
    e = np.flatnonzero(gone & (~after | first[1:])) + 1
    at = np.searchsorted(s, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(s - offsets[row], pa.int64()), pa.array(e - offsets[row], pa.int64())], ["start", "end"]))
    removed = np.concatenate(([0], np.cumsum(gone)))[offsets]
    ends = (offsets - removed).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[~gone])])
    out = {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "spans": spans, "kept": kept}
    return pa.table(out | {"carried": table.column("carried")} if "carried" in table.column_names else out)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def clean_documents(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` with the repeated bytes cut from the texts.

    A character that a cut splits goes as a whole.  ``n_chars``, where there is such a column, counts
    the new text.  A text that is repeated throughout becomes empty; a null one too.
    """
    cut = suffix_dedup(docs, length, carry=[c for c in docs.columns if c != text_col], id_col=id_col, text_col=text_col, **how)

    def decode(batches):
        for b in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("carried"), texts], ["carried", "kept"])
        give_back()

    plain = cut.select("carried", "kept").mapInArrow(decode, f"carried {cut.schema['carried'].dataType.simpleString()}, kept string")
    new = {text_col: F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return plain.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])
