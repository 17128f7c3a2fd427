"""Target-distribution importance resampling: documents whose n-grams are like those of a target."""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.functions.scale import running_totals
from tenurelens.llm.tables import documents, stored
from tenurelens.llm.text import lowered, slices, utf8

#: n-grams interned at once.
AT_ONCE = 1 << 18
#: Fixed value: bytes of words are digits, letters (lower-cased) and all bytes of non-ASCII characters.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in which the words of a text are one space apart, start and end of each word there, and words before each text."""
    data = lowered(data)
    inside = _IN_WORD[data]
    new = np.zeros(len(data) + 1, dtype=bool)
    new[offsets] = True
    was = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~was | new[:-1]))
    follows = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~follows | new[1:])) + 1
    kept = inside | was
    at = np.concatenate(([0], np.cumsum(kept)))
    return np.where(inside, data, np.uint8(32))[kept], at[starts], at[ends], np.searchsorted(starts, offsets)


def intern(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of each n-gram in an open-addressed table, and each slot's bucket and count.

    The table is at most half full.  A slot holds the first n-gram that took it; another one with the same 64-bit key belongs
    there only if its bytes are the same, eight of them compared at a time; otherwise it goes on to the next slot.
    """
    n, raw = len(starts), data.tobytes()
    size = 1 << (2 * n).bit_length()
    keys = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), dtype=np.uint64, count=n)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    lanes = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts

    def equal(a, b):
        same = (keys[a] == keys[b]) & (lengths[a] == lengths[b])
        left = np.flatnonzero(same)
        at = 0
        while len(left):
            mask = _KEEP[np.minimum(lengths[a[left]] - at, 8)]
            bad = (lanes[starts[a[left]] + at] & mask) != (lanes[starts[b[left]] + at] & mask)
            same[left[bad]] = False
            at += 8
            left = left[~bad & (lengths[a[left]] > at)]
        return same

    holder = np.full(size, -1, dtype=np.int64)
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    todo = np.arange(n)
    while len(todo):
        at = slot[todo]
        free = holder[at] < 0
        holder[at[free][::-1]] = todo[free][::-1]
        other = todo[~equal(todo, holder[at])]
        slot[other] = (slot[other] + 1) & (size - 1)
        todo = other
    bucket = np.zeros(size, dtype=np.int64)
    used = np.flatnonzero(holder >= 0)
    bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(starts[holder[used]].tolist(), ends[holder[used]].tolist())]
    return slot, bucket, np.bincount(slot, minlength=size)


def gram_tables(column, low: int, high: int, buckets: int):
    """For stretches of a batch: rows it covers, their words, and per table of n-grams (slot, bucket, count, row)."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        own, starts, ends, first = spaced_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        words = np.diff(first)
        row = np.repeat(np.arange(j - i), words)

        def tables():
            for n in range(low, high + 1):
                begin = np.flatnonzero(np.arange(len(row)) + n <= first[row + 1]) if len(row) else row
                for k in range(0, len(begin), AT_ONCE):
                    b = begin[k:k + AT_ONCE]
                    base = starts[b[0]]
                    yield *intern(own[base:ends[b[-1] + n - 1]], starts[b] - base, ends[b + n - 1] - base, buckets), row[b]

        yield slice(i, j), words, tables()


def bucket_counts(texts: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; each task sends one array."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, tables in gram_tables(batch.column("text"), low, high, buckets):
                for _, bucket, count, _ in tables:
                    used = np.flatnonzero(count)
                    np.add.at(total, bucket[used], count[used])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths by which the logarithm of a bucket's share is larger in the target, each count one more, rounded down."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def importance_weights(docs: DataFrame, gain: np.ndarray, low: int, high: int) -> DataFrame:
    """``n_features``, ``n_words`` and ``weight`` (sum of the gains of all its n-grams) of each document."""

    def run(batches):
        for batch in batches:
            features, words, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for rows, n, tables in gram_tables(batch.column("text"), low, high, len(gain)):
                words[rows] = n
                for slot, bucket, _, row in tables:
                    total = np.concatenate(([0], np.cumsum(gain[bucket][slot])))
                    cut = np.searchsorted(row, np.arange(len(n) + 1))
                    features[rows] += np.diff(cut)
                    weight[rows] += np.diff(total[cut])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *map(pa.array, (features, words, weight))],
                                             ["doc_id", "tie", "n_features", "n_words", "weight"])

    with_tie = docs.select("doc_id", "text", F.when(F.col("doc_id").isNull(), F.sha2("text", 256)).alias("tie"))
    return with_tie.mapInArrow(run, "doc_id long, tie string, n_features long, n_words long, weight long")


def importance_resampling(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20,
                          seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """Weight, score and rank of each document: ``doc_id``, ``n_features``, ``n_words``, ``weight``, ``score``, ``rank``.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case; features all runs of ``low`` to ``high`` words.  A
    document's weight adds up its features' gains: how much likelier the feature's bucket is in ``target`` than in ``docs``.  The
    score adds noise that a hash of the id draws, so that the highest scores are a sample without replacement by weight.  Of the documents with
    ``least_words`` words at least, ``percent`` in a hundred (rounded down) are drawn and ranked from 1; all others have a null rank.

    Both passes intern each batch's n-grams in a table of their own, sized by their number; the only thing that goes through the driver is one count per
    bucket.  Ranks come from counts per score, added up over ranges of scores, and from the order of ids within a score.

    Nulls: a null text has no words; a null id takes its noise from the text and comes after all ids.  Equal ids have equal noise; equal rows take neighbouring ranks.
    An empty target or empty table gives gains of 0 or no rows.  Other columns are left out, so their names can't clash.
    """
    own = documents(docs, id_col, text_col)
    gain = gains(bucket_counts(own, low, high, buckets), bucket_counts(documents(target, target_id, target_text), low, high, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), "tie")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(importance_weights(own, gain, low, high).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    drawn = counts.agg(F.floor(F.sum("n") * percent / 100)).first()[0] or 0
    places = running_totals(counts, [], "score", ["n"], descending=True).select("score", (F.col("cum_n") - F.col("n")).alias("above")).where(F.col("above") < drawn)
    within = F.row_number().over(W.partitionBy("score").orderBy(F.desc(F.col("able")), F.asc_nulls_last("doc_id"), "tie"))
    place = F.col("above") + F.col("within")
    return scored.join(places, "score", "left").withColumn("able", able).withColumn("within", within).select(
        "doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("able") & (place <= drawn), place).cast("long").alias("rank"))


ORACLE_SQL = r"""
with words as (
  select 0 as of, doc_id as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all
  select 1, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
byte_codes as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as codes
  from (select unnest(range(256)) as i)),
buckets as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(w)) // 2), lambda k: ('0x' || substr(hex(w), 2 * k + 1, 2))::bigint)),
                   lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select distinct w from words), byte_codes),
n as (select bucket, count(*) filter (of = 0) as s, count(*) filter (of = 1) as t from words join buckets using (w) group by bucket),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from n),
weights as (select id as doc_id, count(*) as n_features, sum(gain)::bigint as weight from words join buckets using (w) join gains using (bucket) where of = 0 group by id),
scores as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from documents d left join weights using (doc_id)),
ranks as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scores where n_features >= 20)
select doc_id, n_features, n_features as n_words, weight, score,
  case when rank <= (select count(*) from ranks) * 10 // 100 then rank end as rank
from scores left join ranks using (doc_id)"""
