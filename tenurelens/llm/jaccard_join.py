"""Set similarity join on word shingles with a token-group matrix."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm import exchange as X
from tenurelens.llm import text as T
from tenurelens.llm.components import components, same_id_links
from tenurelens.llm.tables import cuts, documents, give_back, stored, text_bytes

U = np.uint64
#: Cells of the frequency sketch for each shingle; documents and bytes of sets in a group, about; bytes of text in a block.
WIDTH, GROUP, GROUP_BYTES, BLOCK_BYTES = 8, 256, 2 << 20, 4 << 20
SETS = "doc_id long, rep_id long, n_shingles long, label long, tokens array<long>, shingles binary"
EDGES = "a long, b long"


def shingle_sets(table: pa.Table, width: int):
    """Ids, and each row's ascending distinct shingle hashes; rows with no id have an empty set."""
    data, offsets = T.utf8(table.column("text"))
    values, first = T.all_words(T.lowered(data), offsets)
    h, _, row = T.runs(values, first, width)
    at = np.searchsorted(row, np.arange(len(first)))
    ids = table.column("doc_id").to_pylist()
    out = []
    for i, doc in enumerate(ids):
        if doc is None or first[i + 1] == first[i]:
            out.append(np.zeros(0, dtype=U))
        elif at[i + 1] > at[i]:
            out.append(np.unique(h[at[i]:at[i + 1]]))
        else:
            words = values[first[i]:first[i + 1]]
            out.append(T.range_hashes(T.prefix_sums(words, T._OTHER_BASE), np.array([0]), np.array([len(words)]), T._OTHER_BASE) + U(len(words)))
    return ids, out


def class_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def prefix_length(n: int, percent: int) -> int:
    """So many shingles of a set, in any one order for all, that a partner must share one of them."""
    return n - -(-percent * n // 100) + 1


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90, group: int = GROUP, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` of the join at a Jaccard similarity of ``percent`` or more.

    A set holds a text's distinct runs of ``width`` words (A-Z lower-cased), or the whole
    sequence where there are fewer.  No link is missed:

    1. Rows with equal sets become one class with its smallest id.  A frequency sketch over all
       shingles of all documents orders shingles, rare ones first.
    2. Two sets that reach the threshold share a shingle within the first few of each.  Exact
       counts of these shingles show which documents can have a partner at all.
    3. Those go to groups of similar documents (by the most frequent such shingle), cut
       to about ``group`` members.  Each group keeps the union of its members' shingles; the
       matrix has a row for each such shingle and group.
    4. For two groups that share a row, a member's overlap with the other group's union bounds
       its overlap with any member; only qualifying members are compared, exactly.  A task
       gives back a spanning forest of the links it found, never all pairs.

    Null or empty text, or no words: empty set, linked with nothing.  Rows with equal ids are
    one document for the components; a null id gives a row with a null component, linked
    with nothing.  Other columns are ignored.
    """
    d = documents(docs, id_col, text_col)
    sets = stored(candidate_sets(d, width, percent, block_bytes), "sets")
    comp = components(group_links(sets, percent, group).unionByName(same_id_links(sets.select("doc_id", "rep_id"), "doc_id", "rep_id")))
    got = sets.select("doc_id", "n_shingles", "rep_id").join(comp, F.col("rep_id") == F.col("id"), "left")
    return got.select("doc_id", "n_shingles", F.coalesce("component_id", "rep_id").alias("component_id"))


def candidate_sets(d: DataFrame, width: int, percent: int, block_bytes: int) -> DataFrame:
    """Rows of SETS: every document with its class, and the sets of those that can have a partner."""
    total = text_bytes(d)
    bits = max(16, int(np.ceil(np.log2(max(total, 64) / 6 * WIDTH))))
    shards = cuts(total, block_bytes)
    blocks, _ = X.into_blocks(d, total, block_bytes)
    cut = U((1 << 64) - (1 << (64 - bits)))

    def cells(s):
        return np.unique(np.concatenate(s) & cut, return_inverse=True) if s else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))

    def classes(ids, s):
        """Ascending distinct class keys with the smallest id, and the place of each row among them (-1: empty set)."""
        least: dict = {}
        keys = [class_key(x) if len(x) else None for x in s]
        for doc, k in zip(ids, keys):
            if k is not None:
                least[k] = min(doc, least.get(k, doc))
        order = {k: i for i, k in enumerate(sorted(least))}
        return sorted(least), least, np.array([order.get(k, -1) for k in keys], dtype=np.int64)

    def first_request(block, table):
        ids, s = shingle_sets(table, width)
        uniq, inverse = cells(s)
        out = X.pieces(block, 0, shards, uniq, np.minimum(np.bincount(inverse, minlength=len(uniq)), 255).astype(np.uint8))
        keys, least, _ = classes(ids, s)
        k = np.array(keys, dtype=U).reshape(-1, 2)
        return out + X.pieces(block, 1, shards, k[:, 0], k[:, 1], np.array([least[x] for x in keys], dtype=np.int64))

    def first_reply(pieces):
        out = []
        own = [(sh, b, *X.unpack(p, U, np.uint8)) for k, sh, b, p in pieces if k == 0]
        if own:
            low, high = (X.lowest(own[0][0] + i, shards) >> (64 - bits) for i in (0, 1))
            counts = np.zeros(high - low + 2, dtype=np.uint16)
            at = [((c >> U(64 - bits)) - U(low)).astype(np.int64) for _, _, c, _ in own]
            for c, o in zip(at, own):
                counts[c] = np.minimum(counts[c] + o[3], 255)
            out += [(sh, b, 0, X.zipped(counts[c].astype(np.uint8))) for c, (sh, b, *_) in zip(at, own)]
        own = [(sh, b, *X.unpack(p, U, U, np.int64)) for k, sh, b, p in pieces if k == 1]
        if own:
            k1, k2, ids = (np.concatenate([o[i] for o in own]) for i in (2, 3, 4))
            least = smallest_of(k1, k2, ids)
            ends = np.cumsum([0] + [len(o[2]) for o in own])
            out += [(sh, b, 1, X.pack(least[x:y])) for (sh, b, *_), x, y in zip(own, ends[:-1], ends[1:])]
        return out

    def prefixes(table, told):
        """Ids, class ids, sets, and for each row that stands for its class the shared-looking shingles of its prefix."""
        ids, s = shingle_sets(table, width)
        _, inverse = cells(s)
        freq = X.joined([X.unzipped(p, np.uint8) for k, _, _, p in told if k == 0], np.uint8)
        freq = freq[inverse] if len(inverse) else np.zeros(0, dtype=np.uint8)
        least = X.joined([X.unpack(p, np.int64)[0] for k, _, _, p in told if k == 1], np.int64)
        _, _, place = classes(ids, s)
        reps = [doc if p < 0 else int(least[p]) for doc, p in zip(ids, place)]
        front, at = [], 0
        for doc, rep, x in zip(ids, reps, s):
            f = freq[at:at + len(x)]
            at += len(x)
            if not len(x) or doc != rep:
                front.append(np.zeros(0, dtype=U))
                continue
            order = np.lexsort((x, f))[:prefix_length(len(x), percent)]
            front.append(x[order][f[order] > 1])
        return ids, reps, s, front

    def second_request(block, table, told):
        _, _, _, front = prefixes(table, told)
        keys, n = np.unique(X.joined(front, U), return_counts=True)
        return X.pieces(block, 2, shards, keys, n.astype(np.uint32))

    def second_reply(pieces):
        own = [(sh, b, *X.unpack(p, U, np.uint32)) for _, sh, b, p in pieces]
        uniq, inverse = np.unique(np.concatenate([o[2] for o in own]), return_inverse=True)
        counts = np.zeros(len(uniq), dtype=np.int64)
        np.add.at(counts, inverse, np.concatenate([o[3] for o in own]))
        ends = np.cumsum([0] + [len(o[2]) for o in own])
        return [(sh, b, 2, X.pack(counts[inverse[x:y]])) for (sh, b, *_), x, y in zip(own, ends[:-1], ends[1:])]

    def emit(block, table, told):
        rows = []
        if block is not None:
            ids, reps, s, front = prefixes(table, told)
            _, inverse = np.unique(X.joined(front, U), return_inverse=True)
            shared = X.joined([X.unpack(p, np.int64)[0] for k, _, _, p in told if k == 2], np.int64)[inverse] if len(inverse) else inverse
            at = 0
            for doc, rep, x, f in zip(ids, reps, s, front):
                n = shared[at:at + len(f)]
                at += len(f)
                f, n = f[n > 1], n[n > 1]
                if len(f):
                    most = int(n.max()).bit_length()
                    label = int(f[np.flatnonzero(np.array([int(v).bit_length() for v in n]) == most)[0]].view(np.int64))
                    rows.append((doc, rep, len(x), label, f.view(np.int64), x.tobytes()))
                else:
                    rows.append((doc, rep, len(x), None, None, None))
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "rep_id", "n_shingles", "label", "tokens", "shingles"])

    one = X.answer(X.ask(blocks, first_request), first_reply, shards)
    two = X.answer(X.ask_again(blocks, one, second_request), second_reply, shards)
    return X.finish(blocks, one.unionByName(two), emit, SETS)


def smallest_of(k1, k2, ids):
    """For each entry the smallest id among those with its key."""
    order = np.lexsort((ids, k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = ids[order][new][np.cumsum(new) - 1]
    return out


def group_links(sets: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) between class representatives that connect all that reach the threshold."""
    active = sets.where("label is not null").select("doc_id", "n_shingles", "label", "tokens", "shingles")
    sizes = active.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / group, F.sum("n_shingles") * 8 / GROUP_BYTES)).alias("parts"))
    member = active.join(sizes, "label").withColumn("grp", F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    payload = member.select("grp", "doc_id", "shingles").groupBy("grp").applyInArrow(packed_group, "grp long, n int, members binary")
    matrix = member.select("grp", F.explode("tokens").alias("token")).distinct()
    other = matrix.select(F.col("grp").alias("grp2"), "token")
    pairs = matrix.join(other, "token").where("grp < grp2").select("grp", "grp2").distinct()
    right = payload.select(F.col("grp").alias("grp2"), F.col("members").alias("members2"))
    across = pairs.join(payload.select("grp", "members"), "grp").join(right, "grp2").select("members", "members2")
    within = payload.where("n > 1").select("members", F.lit(None).cast("binary").alias("members2"))

    def open_groups(batches):
        for b in batches:
            found = []
            for x, y in zip(b.column("members"), b.column("members2")):
                found += compared(read_group(x.as_py()), read_group(y.as_py()) if y.is_valid else None, percent)
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        give_back()

    return across.unionByName(within).mapInArrow(open_groups, EDGES)


def packed_group(table: pa.Table) -> pa.Table:
    """One row for a group: its members' ids and sizes, their union, and each member's places in it."""
    table = table.combine_chunks().sort_by("doc_id")
    ids = table.column("doc_id").to_numpy()
    sets = [np.frombuffer(x.as_py(), dtype=U) for x in table.column("shingles")]
    union, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    data = b"".join(x.tobytes() for x in (np.array([len(ids), len(union)], dtype=np.int64), ids.astype(np.int64), np.array([len(s) for s in sets], dtype=np.int64), union, inverse.astype(np.int32)))
    return pa.table({"grp": table.column("grp").slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "members": pa.array([data], pa.binary())})


def read_group(data: bytes):
    n, m = np.frombuffer(data, dtype=np.int64, count=2)
    ids = np.frombuffer(data, dtype=np.int64, count=n, offset=16)
    size = np.frombuffer(data, dtype=np.int64, count=n, offset=16 + 8 * n)
    union = np.frombuffer(data, dtype=U, count=m, offset=16 + 16 * n)
    return ids, size, union, np.frombuffer(data, dtype=np.int32, offset=16 + 16 * n + 8 * m)


def compared(one, two, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the members of two groups, or within one."""
    ids, size, union, places = one
    ids2, size2, union2, places2 = two or one
    doc, doc2 = np.repeat(np.arange(len(ids)), size), np.repeat(np.arange(len(ids2)), size2)
    if two:  # both in the places that the unions share
        common, i, j = np.intersect1d(union, union2, assume_unique=True, return_indices=True)
        to, to2 = np.full(len(union), -1, dtype=np.int64), np.full(len(union2), -1, dtype=np.int64)
        to[i], to2[j] = np.arange(len(common)), np.arange(len(common))
        p, p2 = to[places], to2[places2]
        doc, p, doc2, p2 = doc[p >= 0], p[p >= 0], doc2[p2 >= 0], p2[p2 >= 0]
        bound, bound2 = np.bincount(doc, minlength=len(ids)), np.bincount(doc2, minlength=len(ids2))
        open1, open2 = np.flatnonzero(100 * bound >= percent * size), np.flatnonzero(100 * bound2 >= percent * size2)
        if not len(open1) or not len(open2):
            return []
    else:
        p, p2, common = places, places, union
        held = np.bincount(places, minlength=len(union))
        keep = held[p] > 1  # a shingle of one member alone meets nothing
        doc, p = doc[keep], p[keep]
        bound = np.bincount(doc, minlength=len(ids))
        open1 = open2 = np.flatnonzero(100 * bound >= percent * size)
        doc2, p2 = doc, p
    row, row2 = np.full(len(ids), -1), np.full(len(ids2), -1)
    row[open1], row2[open2] = np.arange(len(open1)), np.arange(len(open2))
    inter = np.zeros((len(open1), len(open2)), dtype=np.float32)
    step = max(1, (8 << 20) // (len(open1) + len(open2) + 1))
    order, order2 = np.argsort(p, kind="stable"), np.argsort(p2, kind="stable")
    p, doc, p2, doc2 = p[order], doc[order], p2[order2], doc2[order2]
    for low in range(0, len(common), step):
        a, b = np.searchsorted(p, (low, low + step))
        c, d = np.searchsorted(p2, (low, low + step))
        m, m2 = (np.zeros((k, min(step, len(common) - low)), dtype=np.float32) for k in (len(open1), len(open2)))
        r, r2 = row[doc[a:b]], row2[doc2[c:d]]
        m[r[r >= 0], p[a:b][r >= 0] - low] = 1
        m2[r2[r2 >= 0], p2[c:d][r2 >= 0] - low] = 1
        inter += m @ m2.T
    n = inter.astype(np.int64)
    linked = 100 * n >= percent * (size[open1][:, None] + size2[open2][None, :] - n)
    return forest(ids[open1], ids2[open2], linked)


def forest(a, b, linked) -> list[tuple[int, int]]:
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = root(int(a[i])), root(int(b[j]))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(a[i]), int(b[j])))
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows and columns of ``docs`` with one document of each component: the one with the smallest id. Null ids stay."""
    joined = jaccard_join(docs, id_col=id_col, text_col=text_col, **how)
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")
