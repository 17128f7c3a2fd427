"""Katz backoff language model of any order, trained and evaluated through tables spread over shards."""
from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm import exchange as X
from tenurelens.llm import text as T
from tenurelens.llm.tables import cuts, documents, partitions_for, text_bytes, write
from tenurelens.sources.shared import new_path

U = np.uint64
#: Counts up to which Good-Turing discounts.
DISCOUNTED = 5
#: Bytes of text in a block; a history with this share of all tokens is spread over all shards.
BLOCK_BYTES, HOT_SHARE = 8 << 20, 1 / 1024
END, START = U(0x3C6EF372FE94F82B), U(0xA54FF53A5F1D36F1)
#: Kinds of pieces, each with 10 x its order: grams by history, grams of hot histories, numbers by count, sums of hot histories, stored tables, blocks as word numbers.
GRAMS, HOT_GRAMS, STATS, HOT_SUMS, TABLE, STATE = range(6)
N_STATS = DISCOUNTED + 4  # by count 0 .. DISCOUNTED + 1, then tokens and distinct ones
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id) -> bool:
    """Whether a document is kept from training; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def packed_blocks(docs: DataFrame, total: int, block_bytes: int) -> tuple[DataFrame, int]:
    """Documents dealt to blocks, several to a row as compressed bytes: less than half of the plain text is moved."""
    n = cuts(total, block_bytes)
    dealt = docs.withColumn("block", F.pmod(X.block_hash(), F.lit(n)))

    def run(batches):
        for b in batches:
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            rows = []
            for x, y in zip(cut, [*cut[1:], len(order)]):
                part = b.take(pa.array(order[x:y]))
                data, offsets = T.utf8(part.column("text"))
                ids = part.column("doc_id")
                known = np.array([v is not None for v in ids.to_pylist()], dtype=np.int64)
                head = np.concatenate(([y - x], ids.fill_null(0).to_numpy(), known, np.diff(offsets))).astype(np.int64)
                rows.append((int(block[order[x]]), zstandard.ZstdCompressor(level=1).compress(head.tobytes() + data.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "docs"])

    return dealt.select("doc_id", "text", "block").mapInArrow(run, "block long, docs binary").repartition(partitions_for(docs.sparkSession, n), "block"), n


def tokens_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block's documents, whether each has one, where its tokens start, and the tokens: hashes of lower-cased words, and one end each."""
    ids, known, sizes, bodies = [], [], [], []
    for raw in sorted(zstandard.ZstdDecompressor().decompress(x) for x in table.column("docs").to_pylist()):
        n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
        part = np.frombuffer(raw, dtype=np.int64, count=3 * n, offset=8).reshape(3, n)
        ids.append(part[0])
        known.append(part[1])
        sizes.append(part[2])
        bodies.append(np.frombuffer(raw, dtype=np.uint8, offset=8 + 24 * n))
    offsets = np.concatenate(([0], np.cumsum(X.joined(sizes, np.int64)))).astype(np.int64)
    words, first = T.all_words(T.lowered(X.joined(bodies, np.uint8)), offsets)
    return X.joined(ids, np.int64), X.joined(known, np.int64), first + np.arange(len(first)), np.insert(words, first[1:], END)


def narrow(a: np.ndarray) -> np.ndarray:
    """Signed integers and marks as the smallest unsigned kind that holds them, unless some are negative; others as they are."""
    if a.dtype.kind == "b":
        return a.astype(np.uint8)
    if a.dtype.kind == "i" and (not len(a) or a.min() >= 0):
        return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    return np.ascontiguousarray(a)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes; integers take as few bytes as their largest value needs."""
    head, planes = [len(arrays)], []
    for a in map(narrow, arrays):
        head += [ord(a.dtype.kind), a.itemsize, len(a)]
        planes.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(np.array(head, dtype=np.int64).tobytes() + b"".join(planes))


def unpacked(data: bytes) -> list[np.ndarray]:
    """What ``packed`` was given; whole numbers as int64, those of 2**63 and more as uint64."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8:8 + 24 * n].view(np.int64).reshape(n, 3), 8 + 24 * n, []
    for kind, size, length in head.tolist():
        a = np.ascontiguousarray(raw[at:at + size * length].reshape(size, length).T).view(f"{chr(kind)}{size}").reshape(length)
        at += size * length
        out.append(a if kind == ord("f") or (size == 8 and kind == ord("u")) else a.astype(np.int64))
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Word numbers as differences, modulo 2**32; mostly ascending ones become small."""
    return np.diff(a.astype(np.uint32), prepend=np.uint32(0))


def unstepped(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a.astype(np.uint32), dtype=np.uint32).astype(np.int64)


def sparse(a: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (as differences) and values of what isn't the usual value."""
    at = np.flatnonzero(a != usual)
    return np.diff(at, prepend=0), a[at]


def dense(n: int, at: np.ndarray, values: np.ndarray, usual: float) -> np.ndarray:
    out = np.full(n, usual)
    out[np.cumsum(at)] = values
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where one of each distinct key is, in ascending order, and the place of every key among them."""
    order = np.argsort(key)
    own = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def in_order(key: np.ndarray) -> np.ndarray:
    """Stable order of small keys; the same on every machine, since a block works it out again for each pass."""
    if (int(key.max(initial=0)) + 1) * len(key) < 1 << 63:
        return np.argsort(key * len(key) + np.arange(len(key)))
    return np.argsort(key, kind="stable")


def with_mark(count: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Training count of a gram and whether a held-out document has it, as asked of a shard."""
    return count.astype(np.int64) * 2 + held


def marked_count(count: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A shard's answer: 0 for unseen, 1 for a gram seen once in training and in no held-out document, else count + 1."""
    return np.where((count == 1) & ~held, 1, count + (count > 0))


def count_of(marked: np.ndarray) -> np.ndarray:
    return marked - (marked > 1)


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(before * U(0xD6E8FEB86659FD93) + word.astype(U))


class Block:
    """The tokens of a block's documents as numbers of known words (0: unknown), and the grams that end with each.

    Words are numbered once, the more frequent ones lower; grams are told apart by these numbers.
    ``before_cols`` has the words of the block's distinct histories, last word first.
    A history seen once in training and in no held-out document (``alone``) is followed by one token
    of this block and asked for by no other: its gram's count is one, and no shard need be asked.
    """

    def __init__(self, data: bytes, told, shards: int, hot_share: float):
        ids, known, length, tokens, rank = unpacked(data)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.first, self.shards, self.hot_share = np.concatenate(([0], np.cumsum(length))), shards, hot_share
        self.held_out = np.array([held_out(i) for i in self.ids], dtype=bool)
        self.trains = ~np.repeat(self.held_out, length)
        got = [unpacked(p) for k, _, _, p in told if k == 10 + GRAMS]
        number, marked = (X.joined([g[j] for g in got], np.int64) for j in (0, 1))
        order = np.argsort(number)
        order = order[np.count_nonzero(number == 0):]
        self.words, marked = np.append(0, number[order]), np.append(0, marked[order])
        local = np.zeros(len(number), dtype=np.int64)
        local[rank[order]] = np.arange(1, len(order) + 1)
        self.tokens = local[tokens]
        self.counts, self.alone_words = count_of(marked), marked == 1
        self.ends = int(self.counts[self.tokens[-1]])  # a document's last token is its end

    @staticmethod
    def of_texts(table: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The documents with their tokens as places among the block's words, frequent ones first; the words' hashes, and their marked counts."""
        ids, known, first, tokens = tokens_of(table)
        length = np.diff(first)
        trains = ~np.repeat(np.array([held_out(int(i) if k else None) for i, k in zip(ids, known)], dtype=bool), length)
        pick, word = distinct(tokens)
        rank = np.empty(len(pick), dtype=np.int64)
        rank[np.argsort(-np.bincount(word), kind="stable")] = np.arange(len(pick))
        held = np.zeros(len(pick), dtype=bool)
        held[word[~trains]] = True
        return packed(ids, known, length, rank[word], rank), tokens[pick], with_mark(np.bincount(word, weights=trains), held)

    def shifted(self, values, first):
        """The value of the token before each; ``first`` where a document starts."""
        out = np.append(first, values[:-1]).astype(values.dtype)
        out[self.first[:-1]] = first
        return out

    def told(self, told, order: int, stats: dict, hot: dict, least: int, p: bool = False):
        """Takes in the answers up to ``order``: count, with ``p`` also the probability, and history of every token at that order."""
        n = len(self.tokens)
        self.order, self.stats, self.count = 1, stats, self.counts[self.tokens]
        self.p = word_probability(self.counts, stats[1])[self.tokens] if p else None
        self.of, self.factor = np.ones(n, dtype=np.int64), np.ones(n)
        self.alone = self.alone_words[self.tokens]
        self.gram, self.cols, self.hashes = self.tokens, [self.words], chained(END, self.words)
        for _ in range(2, order + 1):
            self.longer()
            self.take(told, hot, least)

    def longer(self):
        """Turns to grams one token longer; what the shorter ones gave is kept as ``below``, ``below_factor`` and ``lower``.

        Finds the distinct grams after a known history, in the order asked: by shard, history and word,
        those of hot histories last.  ``history`` and ``token`` say what each consists of.
        """
        self.below, self.below_factor, self.lower = self.of, self.factor, self.count
        if self.order > 1:
            word = self.words[self.last]
            self.cols = [word] + [c[self.history] for c in self.before_cols]
            self.hashes = chained(self.before_hashes[self.history], word)
        self.order += 1
        n = len(self.hashes)  # the start of a document comes after all grams
        before = self.shifted(self.gram, n)
        self.before_cols = [np.append(c, 1 if j == 0 else 0) for j, c in enumerate(self.cols)]
        self.before_hashes = np.append(self.hashes, START)
        self.of = self.shifted(self.count, self.ends)
        alone = self.shifted(self.alone, False)
        self.settled = np.flatnonzero(alone)
        self.asks = np.flatnonzero((self.of > 0) & ~alone)
        h, w = before[self.asks], self.tokens[self.asks]
        is_hot = np.zeros(n + 1, dtype=bool)
        is_hot[h] = self.of[self.asks] >= max(1, self.stats[1][-2] * self.hot_share)
        # plain histories by shard and last word, then hot ones by number
        last = self.last if self.order > 2 else np.arange(n)
        place_of, shard_of = np.empty(n + 1, dtype=np.int64), self.shard_of(self.before_hashes)
        place_of[in_order((shard_of + is_hot * self.shards) * (len(self.words) + 1) + np.append(last, len(self.words)))] = np.arange(n + 1)
        key, shard = place_of[h] * len(self.words) + w, shard_of[h]
        n_plain, n_hot = n + 1 - np.count_nonzero(is_hot), np.count_nonzero(is_hot)
        i = np.flatnonzero(is_hot[h])
        if len(i):  # grams of hot histories by a shard of their own
            own = self.shard_of(chained(self.before_hashes[h[i]], self.words[w[i]]))
            shard[i] = own + self.shards
            rank = np.cumsum(is_hot) - 1
            key[i] = (n_plain + own * n_hot + rank[h[i]]) * len(self.words) + w[i]
        pick, self.place = distinct(key)
        self.token, self.history, self.last = self.asks[pick], h[pick], w[pick]
        self.hot = is_hot[self.history]
        self.gram = np.zeros(len(self.tokens), dtype=np.int64)
        self.gram[self.asks] = self.place
        self.shard = shard[pick]
        self.new = np.diff(self.shard * (n + 1) + self.history, prepend=-1) != 0

    def shard_of(self, key):
        return (((key >> U(32)) * U(self.shards)) >> U(32)).astype(np.int64)

    def requests(self):
        """The distinct grams for every shard, with training counts and what gives the shorter gram's probability."""
        trains = self.trains[self.asks]
        held = np.zeros(len(self.token), dtype=bool)
        held[self.place[~trains]] = True
        count = with_mark(np.bincount(self.place, weights=trains, minlength=len(self.token)), held)
        count, lower, words, new = (narrow(x) for x in (count, self.lower[self.token], self.words[self.last], self.new))
        t, h = self.token[self.new], self.history[self.new]
        of, below, factor, hashes, *cols = (narrow(x[i]) for x, i in ((self.of, t), (self.below, t), (self.below_factor, t), (self.before_hashes, h), *((c, h) for c in self.before_cols)))
        cut = np.flatnonzero(np.diff(self.shard, prepend=-1))
        at = np.append(np.cumsum(self.new)[cut] - 1, len(h)).tolist()
        for x, y, i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(self.shard)], at[:-1], at[1:]):
            hot = bool(self.hot[x])
            data = packed(of[i:j], below[i:j], *sparse(factor[i:j], 1.0), hashes[i:j] if hot else hashes[:0],
                          new[x:y], words[x:y], count[x:y], lower[x:y], steps(cols[0][i:j]), *(c[i:j] for c in cols[1:]))
            yield int(self.shard[x]) % self.shards, 10 * self.order + (HOT_GRAMS if hot else GRAMS), data

    def take(self, told, hot: dict, least: int):
        """Counts and probabilities of the grams of the present order: a kept gram's share, or else the history's weight times the shorter one's."""
        kind = 10 * self.order
        d = cut_discounts(self.stats[self.order], least)
        grams, n = len(self.token), len(self.tokens)
        own, weight, factor = np.zeros(grams, dtype=np.int64), np.ones(grams), np.ones(grams)
        parts = [unpacked(p) for k, _, _, p in told if k == kind + GRAMS]
        plain = len(self.hot) - np.count_nonzero(self.hot)
        own[:plain] = X.joined([p[0] for p in parts], np.int64)
        at = np.cumsum(self.new[:plain]) - 1
        weight[:plain], factor[:plain] = (X.joined([dense(int(p[1][0]), p[j], p[j + 1], usual) for p in parts], np.float64)[at] for j, usual in ((2, 0.0), (4, 1.0)))
        own[plain:] = X.joined([unpacked(p)[0] for k, _, _, p in told if k == kind + HOT_GRAMS], np.int64)
        if plain < grams and hot.get(self.order) is not None:
            sums = hot_rows(hot[self.order], least)
            hist, of, *by, rest, lower = sums
            both = backoff((sum(d[c] * c_tokens for c, c_tokens in zip(range(least, DISCOUNTED + 1), by)) + rest) / of, lower, of)
            hist, asked = hist.view(U), self.before_hashes[self.history[plain:]]
            if len(hist):
                at = np.minimum(np.searchsorted(hist, asked), len(hist) - 1)
                weight[plain:], factor[plain:] = (np.where(hist[at] == asked, x[at], 1.0) for x in both)
        self.count, self.factor, self.alone = np.zeros(n, dtype=np.int64), np.ones(n), np.zeros(n, dtype=bool)
        self.count[self.asks], self.factor[self.asks], self.alone[self.asks] = count_of(own)[self.place], factor[self.place], (own == 1)[self.place]
        self.count[self.settled], self.alone[self.settled] = 1, True
        self.factor[self.settled] = backoff(d[1:2], np.zeros(1), np.ones(1))[1]
        if self.p is not None:
            all_weight = np.ones(n)
            all_weight[self.asks] = weight[self.place]
            kept = self.count >= least
            self.p = np.where(kept, self.factor * share(self.count, np.maximum(self.of, 1), d), all_weight * self.p)


def stats_of(pieces, order: int) -> np.ndarray:
    return next((np.frombuffer(p, dtype=np.int64) for k, _, _, p in pieces if k == 10 * order + STATS), np.zeros(N_STATS, dtype=np.int64))


def hot_rows(data: bytes, least: int) -> np.ndarray:
    """History, its count, tokens by count from ``least`` to DISCOUNTED, those of higher counts, lower probabilities."""
    return np.frombuffer(data, dtype=np.float64).reshape(DISCOUNTED - least + 5, -1)


def numbers_by_count(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(N_STATS, dtype=np.int64)
    out[1:DISCOUNTED + 2] = np.bincount(counts[counts <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:]
    out[-2:] = counts.sum(), (counts > 0).sum()
    return out


def discounts(numbers: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing factor for counts 0 .. DISCOUNTED, from the numbers of items by count.

    Where the numbers give no factor between 0 and 1, (c - 0.5) / c stands in.
    """
    k = DISCOUNTED
    out = np.zeros(k + 1)
    a = (k + 1) * numbers[k + 1] / numbers[1] if numbers[1] else 1.0
    for c in range(1, k + 1):
        r = (c + 1) * numbers[c + 1] / (c * numbers[c]) if numbers[c] else 0.0
        d = (r - a) / (1 - a) if a != 1 else 0.0
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return out


def share(count: np.ndarray, of, d: np.ndarray) -> np.ndarray:
    """Discounted relative frequency."""
    return np.append(d, 1.0)[np.minimum(count, len(d))] * count / of


def word_probability(count: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Probability of words by their training count; what discounting leaves belongs to all unknown words together (count 0)."""
    total = int(stats[-2])
    if not total:
        return np.ones(len(count))
    d = discounts(stats)
    left = float((stats[1:DISCOUNTED + 1] * np.arange(1, DISCOUNTED + 1) * (1 - d[1:])).sum())
    if left <= 0:  # every word is frequent: the unknown ones get half a count
        return np.where(count > 0, count, 0.5) / (total + 0.5)
    return np.where(count > 0, share(count, total, d), left / total)


def cut_discounts(numbers: np.ndarray, least: int) -> np.ndarray:
    """Factors for grams of two words or more; those with fewer than ``least`` counts are left to the shorter history (1: none)."""
    d = discounts(numbers)
    d[:least] = 0
    return d


def backoff(mass: np.ndarray, lower: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the single words after a history, and the factor of its kept pairs: with these the history sums to one.

    Kept pairs that leave nothing for others are scaled as if the history occurred once more.
    """
    factor = np.where(mass > 1 - 1e-9, of / (of + 1.0) / np.maximum(mass, 1e-300), 1.0)
    return (1 - mass * factor) / np.maximum(1 - lower, 1e-15), factor


def read_grams(pieces, kind: int, order: int):
    """All that a shard was sent of one kind, merged.

    The askers (shard, block, their histories and grams by place), the distinct histories (words, count,
    count and factor of the shorter history, hash) and the distinct grams (history, word, count, count of the
    shorter gram, whether a held-out document has it).
    """
    own, hists, grams, at = [], [], [], 0
    for k, s, b, p in pieces:
        if k == 10 * order + kind:
            of, below, places, factor, hashes, new, w, n, c, *cols = unpacked(p)
            cols[0] = unstepped(cols[0])
            own.append((s, b, len(of), len(w)))
            hists.append((of, below, dense(len(of), places, factor, 1.0), hashes, *cols))
            grams.append((at + np.cumsum(new) - 1, w, n, c))
            at += len(of)
    if not own:
        return None
    of, below, factor, hashes, *cols = (np.concatenate(x) for x in zip(*hists))
    g, w, n, c = (np.concatenate(x) for x in zip(*grams))
    del hists, grams
    key = cols[0]
    for col in cols[1:]:
        if key is not cols[0]:
            key = distinct(key)[1]
        key = key.astype(U) << U(32) | col.astype(U)
    pick, hist = distinct(key)
    g = hist[g]
    some, place = distinct(g.astype(U) << U(32) | w.astype(U))
    count = np.bincount(place, weights=n >> 1, minlength=len(some)).astype(np.int64)
    held = np.zeros(len(some), dtype=bool)
    held[place[n & 1 == 1]] = True
    h = [x[pick] for x in (of, below, factor)] + [hashes[pick] if len(hashes) else hashes, [x[pick] for x in cols]]
    return own, hist, place, h, (g[some], w[some], count, c[some], held)


def lower_probability(h, grams, stats: np.ndarray, order: int, least: int) -> np.ndarray:
    """Probability of the grams one token shorter."""
    (_, below, factor, *_), (g, _, _, c, _) = h, grams
    if order == 2:
        return word_probability(c, stats)
    return factor[g] * share(c, np.maximum(below[g], 1), cut_discounts(stats, least))


@dataclass
class Model:
    """The blocks as numbered words, for each order the folder with the shards' tables and the answers to the blocks, and the totals by order."""

    blocks: DataFrame
    paths: list[str]
    order: int
    least: int
    hot_share: float
    shards: int
    stats: dict
    hot: dict

    def answers(self) -> DataFrame:
        return answers_in(self.blocks.sparkSession, self.paths)


def answers_in(spark, paths: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (stored(spark, p, "answers") for p in paths))


def stored(spark, path: str, part: str) -> DataFrame:
    return spark.read.schema(f"{X.PIECES}, part string").parquet(path).where(F.col("part") == part).drop("part")


def fit(docs: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = 2, least: int = 2) -> Model:
    """The model of the training documents, spread over shards, with the answers that each block needs.

    (1) Blocks send their distinct words with training counts; shards number the words, and the
    blocks are written as word numbers.  Texts aren't needed from then on.
    (2) For each order from two up, blocks send their distinct grams with training counts, the
    count of the gram one token shorter and, per history, what gives that one's probability.
    Shards add up, and the numbers of grams by count go through one small total to all shards.
    A shard holds all words of a history, so it knows what they leave: the backoff weight.
    A history with more than HOT_SHARE of all tokens is spread over all shards by the word; its
    sums are totalled (there are 1 / HOT_SHARE such histories at most).
    Each order's tables and answers are written before the next one starts.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    shards = cuts(total, 2 * block_bytes)  # grams take less than half of what their texts take in a block; every piece costs time
    texts, n_blocks = packed_blocks(docs, total, block_bytes)
    hot_share, stats, hot = HOT_SHARE, {}, {}

    def word_request(block, table):
        state, words, counts = Block.of_texts(table)
        return [(-1 - block, block, 10 + STATE, state)] + X.pieces(block, 10 + GRAMS, shards, words, counts.astype(np.uint32))

    def word_reply(pieces):
        shard = pieces[0][1]
        if shard < 0:  # a block, passed on
            return [(s, b, k, p) for k, s, b, p in pieces]
        own = [(s, b, *X.unpack(p, U, np.uint32)) for k, s, b, p in pieces]
        words, place = np.unique(np.concatenate([o[2] for o in own]), return_inverse=True)
        asked = np.concatenate([o[3] for o in own])
        counts = np.bincount(place, weights=asked >> 1).astype(np.int64)
        held = np.zeros(len(words), dtype=bool)
        held[place[asked & 1 == 1]] = True
        marked = marked_count(counts, held)
        known = np.lexsort((words, -counts))[:np.count_nonzero(counts)]
        number = np.zeros(len(words), dtype=np.int64)
        number[known] = 2 + np.arange(len(known)) * shards + shard  # 0: unknown, 1: start of a document
        if number.max(initial=0) >> 32:
            raise ValueError("too many distinct words for 32-bit numbers")
        ends = np.cumsum([0] + [len(o[2]) for o in own])
        out = [(s, b, 10 + GRAMS, packed(number[place[x:y]], marked[place[x:y]])) for (s, b, *_), x, y in zip(own, ends[:-1], ends[1:])]
        out.append((shard, -1 - shard, 10 + STATS, numbers_by_count(counts).tobytes()))
        return out + [(shard, -1 - shard, 10 + TABLE, X.pack(words[counts > 0], number[counts > 0], counts[counts > 0]))]

    def requests(n):
        by_order, sums = dict(stats), dict(hot)

        def run(block, table, told):
            b = Block(table.column("data")[0].as_py(), told, shards, hot_share)
            b.told(told, n - 1, by_order, sums, least)
            b.longer()
            out = [(s, block, kind, data) for s, kind, data in b.requests()]
            return out + [(block % shards, block, 10 * n + STATS, numbers_by_count(np.ones(len(b.settled), dtype=np.int64)).tobytes())]
        return run

    def gram_numbers(n):
        lower = stats[n - 1]

        def run(pieces):
            found = {kind: g for kind in (GRAMS, HOT_GRAMS) if (g := read_grams(pieces, kind, n))}
            shard = pieces[0][1]
            settled = [np.frombuffer(p, dtype=np.int64) for k, _, _, p in pieces if k == 10 * n + STATS]
            out = [(shard, -1, 10 * n + STATS, sum([numbers_by_count(g[4][2]) for g in found.values()] + settled).tobytes())]
            if HOT_GRAMS in found:
                _, _, _, h, grams = found[HOT_GRAMS]
                kept = grams[2] >= least
                p, (g, _, count, *_) = lower_probability(h, grams, lower, n, least)[kept], (x[kept] for x in grams)
                order_of = np.argsort(h[3])
                hist, at = h[3][order_of], np.argsort(order_of)[g]
                by = [np.bincount(at, weights=count * (count == c), minlength=len(hist)) for c in range(least, DISCOUNTED + 1)]
                by += [np.bincount(at, weights=count * (count > DISCOUNTED), minlength=len(hist)), np.bincount(at, weights=p, minlength=len(hist))]
                out.append((shard, -1, 10 * n + HOT_SUMS, np.concatenate((hist.view(np.float64), h[0][order_of].astype(np.float64), *by)).tobytes()))
            return out
        return run

    def replies(n):
        lower_stats = stats[n - 1]

        def run(key, pieces, told):
            return X.lean(lambda: X.as_table(work(int(key[0].as_py()), X.listed(pieces), X.listed(told))))

        def work(shard, pieces, told):
            d = cut_discounts(stats_of(told, n), least)
            out = [(shard, -1, k, p) for k, _, _, p in told] if shard == 0 else []
            for kind in (GRAMS, HOT_GRAMS):
                got = read_grams(pieces, kind, n)
                if not got:
                    continue
                own, hist, place, h, grams = got
                g, w, count, c, held = grams
                kept, of, marked = count >= least, h[0], marked_count(count, held)
                if kind == GRAMS:
                    part = np.where(kept, share(count, np.maximum(of[g], 1), d), 0.0)
                    lower = lower_probability(h, grams, lower_stats, n, least) * kept
                    weight, factor = backoff(np.bincount(g, weights=part, minlength=len(of)), np.bincount(g, weights=lower, minlength=len(of)), of)
                x = i = 0
                backs_off = np.zeros(len(of), dtype=bool)
                for s, b, n_hist, n_grams in own:
                    at, asked = place[x:x + n_grams], hist[i:i + n_hist]
                    x, i = x + n_grams, i + n_hist
                    if kind == GRAMS:
                        back = g[at[~kept[at]]]
                        backs_off[back] = True
                        data = packed(marked[at], np.array([n_hist]), *sparse(np.where(backs_off[asked], weight[asked], 0.0), 0.0), *sparse(factor[asked], 1.0))
                        backs_off[back] = False
                    else:
                        data = packed(marked[at])
                    out.append((s, b, 10 * n + kind, data))
                out.append((shard, -1, 10 * n + TABLE, packed(of, h[1], *sparse(h[2], 1.0), np.diff(g[kept], prepend=0), w[kept], count[kept], c[kept], steps(h[4][0]), *h[4][1:])))
            return out
        return run

    def add_numbers(parts):
        return sum(np.frombuffer(p, dtype=np.int64) for p in parts).tobytes()

    def add_hot(parts):
        rows = np.concatenate([hot_rows(p, least) for p in parts], axis=1)
        hist, at = np.unique(rows[0].view(U), return_inverse=True)
        of = np.zeros(len(hist))
        of[at] = rows[1]
        return np.concatenate((hist.view(np.float64), of, *(np.bincount(at, weights=x, minlength=len(hist)) for x in rows[2:]))).tobytes()

    def totalled(numbers: DataFrame) -> DataFrame:
        """One small row per shard and kind, added up: numbers by count go to every shard, sums of hot histories to one."""
        def run(key, table):
            kind = int(key[0].as_py())
            is_hot = kind % 10 == HOT_SUMS
            data = (add_hot if is_hot else add_numbers)([x[3] for x in X.listed(table)])
            return X.as_table([(i, -1, kind, data) for i in range(1 if is_hot else shards)])
        return numbers.groupBy("kind").applyInArrow(run, X.PIECES)

    def per_shard(asked, run):
        def apply(table):
            return X.lean(lambda: X.as_table(run(X.listed(table))))
        return asked.groupBy("shard").applyInArrow(apply, X.PIECES)

    def written(rows: DataFrame, n: int) -> str:
        path, kind = new_path(spark, f"grams{n}"), F.col("kind") % 10
        part = F.when(kind == TABLE, "tables").when(kind.isin(STATS, HOT_SUMS), "totals").when(kind == STATE, "blocks").otherwise("answers")
        write(rows.withColumn("part", part), path, "part")
        return path

    def totals(path: str, n: int):
        """At most a hundred kilobytes: nine numbers, and sums of at most 1 / HOT_SHARE histories."""
        found = stored(spark, path, "totals")
        rows = [(r.kind, r.shard, r.block, bytes(r.data)) for r in (totalled(found).where("shard = 0") if n == 1 else found).collect()]
        stats[n], hot[n] = stats_of(rows, n), next((p for k, _, _, p in rows if k == 10 * n + HOT_SUMS), None)

    words = X.answer(X.ask(texts, word_request), word_reply, shards)
    paths = [written(words, 1)]
    totals(paths[0], 1)
    blocks = stored(spark, paths[0], "blocks").select("block", "data").repartition(partitions_for(spark, n_blocks), "block")
    for n in range(2, order + 1):
        asked = X.ask_again(blocks, answers_in(spark, paths), requests(n)).repartition(partitions_for(spark, shards), "shard")
        sums = totalled(per_shard(asked, gram_numbers(n)))
        paths.append(written(asked.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(replies(n), X.PIECES), n))
        totals(paths[-1], n)
    return Model(blocks, paths, order, least, hot_share, shards, stats, hot)


def stored_grams(model: Model, n: int) -> DataFrame:
    """The kept grams of order ``n`` (two or more): ``history`` (a hash), ``word`` (its number), ``count`` and discounted ``share`` of the history.

    Shards have stored most of them; those of histories that a shard need not be asked for are in the blocks.
    """
    least, hot_share, shards, stats, hot = model.least, model.hot_share, model.shards, model.stats, model.hot
    d = cut_discounts(stats[n], least)

    def as_rows(cols, w, count, of):
        hist = np.full(len(w), START)
        for col in reversed(cols):
            hist = chained(hist, col)
        return pa.table([pa.array(x) for x in (hist.view(np.int64), w, count, share(count, of, d))], ["history", "word", "count", "share"])

    def shard_rows(batches):
        for b in batches:
            for data in b.column("data").to_pylist():
                of, _, _, _, g, w, count, _, *cols = unpacked(data)
                g, cols[0] = np.cumsum(g), unstepped(cols[0])
                yield from as_rows([c[g] for c in cols], w, count, of[g]).to_batches()

    def block_rows(key, table, told):
        if not table.num_rows:
            return as_rows([], *np.zeros((3, 0), dtype=np.int64))
        told = X.listed(told)
        b = Block(table.column("data")[0].as_py(), told, shards, hot_share)
        b.told(told, n - 1, stats, hot, least)
        b.longer()
        word, i, cols = b.words[b.tokens], b.settled if least < 2 else b.settled[:0], []
        for j in range(n - 1):
            cols.append(b.shifted(cols[-1] if cols else word, int(j == 0)))
        one = np.ones(len(i), dtype=np.int64)
        return as_rows([c[i] for c in cols], word[i], one, one)

    schema = "history long, word long, count long, share double"
    spark = model.blocks.sparkSession
    told = answers_in(spark, model.paths[:n - 1])
    in_blocks = model.blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(block_rows, schema)
    return stored(spark, model.paths[n - 1], "tables").select("data").mapInArrow(shard_rows, schema).unionByName(in_blocks)


def evaluate(model: Model) -> DataFrame:
    """Scores the documents of the blocks from the written answers, from the longest history down to the single words."""
    order, least, hot_share, shards, stats, hot = model.order, model.least, model.hot_share, model.shards, model.stats, model.hot

    def run(block, table, told):
        if block is None:
            return scored([], [], [], [], 0, [], [])
        b = Block(table.column("data")[0].as_py(), told, shards, hot_share)
        total, distinct_words = int(stats[1][-2]), int(stats[1][-1])
        known = (b.counts > 0)[b.tokens]
        base = np.log10((b.counts + 0.5) / (total + 0.5 * (distinct_words + 1)))[b.tokens]
        b.told(told, order, stats, hot, least, p=True)
        doc = np.repeat(np.arange(len(b.ids)), np.diff(b.first))
        add = lambda x: np.bincount(doc, weights=x, minlength=len(b.ids))
        return scored(b.ids, b.held_out, np.diff(b.first), add(known), total, add(base), add(np.log10(b.p)))

    return X.finish(model.blocks, model.answers(), run, SCHEMA)


def scored(ids, out, n, known, total, base, score) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(list(out), pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.array(known, dtype=np.int64)),
                     "train_tokens": pa.array([total] * len(ids), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})


def katz_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", order: int = 2, least: int = 2) -> DataFrame:
    """One row per document: tokens, known tokens, training tokens, base and model log10 probability.

    Histories have up to ``order`` - 1 words; grams of two words or more with fewer than ``least``
    counts are left to the shorter history (``least=1`` keeps all).
    The model learns from documents that ``held_out`` doesn't name and scores all.  Tokens are
    words (A-Z lower-cased) and one end.  Null or empty text: only the end.  Equal rows are
    learned and scored each; null ids are learned from.  Without training tokens every score is
    that of a certain event, 0.  Other columns are ignored.
    """
    return evaluate(fit(documents(docs, id_col, text_col), block_bytes, order, least))
