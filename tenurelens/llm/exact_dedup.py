"""Exact duplicates through an extendible-hash index kept in shared files."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.tables import cuts, documents, give_back, partitions_for, stored, text_bytes, write
from tenurelens.sources.shared import new_path

#: Texts a bucket holds before it splits; bits the directory may double to; bytes of text an owner task works on.
CAPACITY, MOST_BITS, OWNER_BYTES = 512, 18, 16 << 20
INDEX = "bucket int, depth int, key long, chain int, text_sha256 string, keep_id long, group_size long, text string"
_SENT = "owner int, bucket int, depth int, key long, sha string, text string, last_id long, n long"


def directory(counts: np.ndarray, capacity: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each directory entry and each bucket's depth, for ``counts`` of keys by their first ``most_bits`` bits.

    It starts with one bucket.  An overfull bucket splits by its next bit; where its depth is
    the directory's, the directory doubles first.  At ``most_bits`` a bucket may overflow.
    """
    up_to = np.concatenate(([0], np.cumsum(counts)))
    entries, depth, first = np.zeros(1, dtype=np.int32), [0], [0]
    todo, bits = [0], 0
    while todo:
        b = todo.pop()
        width = 1 << (most_bits - depth[b])
        if depth[b] == most_bits or up_to[first[b] + width] - up_to[first[b]] <= capacity:
            continue
        if depth[b] == bits:
            entries, bits = np.repeat(entries, 2), bits + 1
        depth[b] += 1
        depth.append(depth[b])
        first.append(first[b] + width // 2)
        new = len(depth) - 1
        per = 1 << (bits - depth[b])
        at = first[new] >> (most_bits - bits)
        entries[at:at + per] = new
        todo += [b, new]
    return entries, np.array(depth, dtype=np.int32)


def owners(counts: np.ndarray, entries: np.ndarray, n: int, most_bits: int) -> np.ndarray:
    """Owner task of each bucket: runs of neighbouring key ranges with about equally many keys."""
    per = len(counts) // len(entries)
    cum = np.cumsum(counts.reshape(len(entries), per).sum(1))
    share = np.minimum((cum - 1).clip(0) * n // max(1, int(cum[-1])), n - 1)
    out = np.zeros(int(entries.max()) + 1, dtype=np.int32)
    out[entries[::-1]] = share[::-1]
    return out


def key_of(text, key_bits: int = 64):
    """Signed 64-bit hash of a text; fewer ``key_bits`` make collisions (for tests)."""
    h = F.xxhash64(text)
    return h if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def build_index(docs: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS, owner_bytes: int = OWNER_BYTES, key_bits: int = 64, keep_texts: bool = True) -> str:
    """Writes the index of the texts of ``docs`` (doc_id, text) and returns its path.

    The directory is planned from the number of distinct keys under each prefix: at most
    2**most_bits numbers, whatever the input.  Map tasks send each distinct text once, with the
    largest id and the number of its rows in that task, to the task that owns its key range;
    a text that a third of all rows hold so reaches its owner once per map task.  Owners walk
    their keys in order, compare bytes and chain different texts under one key.  The texts are
    stored too, for later comparison with new ones, unless ``keep_texts`` is false.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    keyed = docs.select("doc_id", "text", key_of(F.col("text"), key_bits).alias("key"))
    prefix = F.shiftrightunsigned("key", 64 - most_bits).cast("int")
    seen = keyed.select("key").distinct().groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(1 << most_bits, dtype=np.int64)
    for r in seen:
        counts[r.p] = r.n
    entries, depth = directory(counts, capacity, most_bits)
    n = partitions_for(spark, cuts(total, owner_bytes))
    owner_of = owners(counts, entries, n, most_bits)
    shift = np.uint64(64 - int(np.log2(len(entries))))

    def send(batches):
        found: dict = {}
        for b in batches:
            key = b.column("key").to_numpy()
            bucket = entries[(key.view(np.uint64) >> shift).astype(np.int64)] if shift < 64 else np.zeros(len(key), dtype=np.int32)
            rows = []
            for doc, text, k, bu in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), key.tolist(), bucket.tolist()):
                sha = hashlib.sha256(text.encode()).hexdigest()
                got = found.get(sha)
                if got is None:
                    found[sha] = [bu, k, doc, 1]
                    rows.append((int(owner_of[bu]), bu, int(depth[bu]), k, sha, text, None, 0))
                else:
                    got[2] = doc if got[2] is None else got[2] if doc is None else max(got[2], doc)
                    got[3] += 1
            yield sent(rows)
        yield sent([(int(owner_of[bu]), bu, int(depth[bu]), k, sha, None, doc, m) for sha, (bu, k, doc, m) in found.items()])
        give_back()

    def own(batches):
        at, chain = None, []
        for b in batches:
            rows = []
            for _, bu, dep, k, sha, text, doc, m in zip(*(b.column(c).to_pylist() for c in ("owner", "bucket", "depth", "key", "sha", "text", "last_id", "n"))):
                if at != (bu, k):
                    rows += chained(chain)
                    at, chain = (bu, k), []
                if text is not None:
                    if not any(text == c[7] for c in chain):  # strings are equal where their bytes are
                        chain.append([bu, dep, k, len(chain), sha, None, 0, text])
                else:
                    c = next(c for c in chain if c[4] == sha)
                    c[5] = doc if c[5] is None else c[5] if doc is None else max(c[5], doc)
                    c[6] += m
            yield indexed(rows)
        yield indexed(chained(chain))
        give_back()

    routed = keyed.mapInArrow(send, _SENT).repartition(n, "owner").sortWithinPartitions("bucket", "key", F.col("text").isNull())
    path = new_path(spark, "exact-index")
    index = routed.mapInArrow(own, INDEX)
    write(index if keep_texts else index.drop("text"), path)
    return path


def sent(rows):
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["owner", "bucket", "depth", "key", "sha", "text", "last_id", "n"])


def chained(chain):
    return [tuple(c) for c in chain]


def indexed(rows):
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "depth", "key", "chain", "text_sha256", "keep_id", "group_size", "text"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays.  Null text counts as empty.  Equal ids
    give a row each and, where their texts are equal too, are all kept.  A null id never stays
    beside a number; a text that only rows with a null id hold has a null ``keep_id`` and is
    kept.  Other columns are ignored.
    """
    d = documents(docs, id_col, text_col)
    found = d.sparkSession.read.parquet(build_index(d, **index)).select("text_sha256", "keep_id", "group_size")
    members = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return members.join(found, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: of the rows that ``exact_dedup`` keeps.

    Where several rows hold a text under the id that stays (or under null ids only), the one whose columns have the
    smallest hash stays. Null and empty texts are one text. An empty table gives no rows.
    """
    found = exact_dedup(docs, id_col, text_col, **index).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    once, repeated = (stored(found.where(c).select("doc_id", "text_sha256"), "kept") for c in ("n = 1", "n > 1"))
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"), 256)
    of = lambda f: docs.join(f, docs[id_col].cast("long").eqNullSafe(f["doc_id"]) & (sha == f["text_sha256"]), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = of(repeated).select(row.alias("row")).groupBy(F.sha2(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).cast("binary"), 256)).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return of(once).unionByName(first.select("row.*"))
