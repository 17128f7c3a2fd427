"""Packing token pieces into sequences: best two fit, planned on the histogram of lengths."""
from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.llm.tables import cuts, documents, give_back, stored

VOCABULARY, SEQUENCE, END = "word_bpe_49k.json", 2048, 0
#: Words whose ids a task remembers before it starts afresh; texts looked up together; words merged together and their longest.
REMEMBERED, TOGETHER, MERGED, LONGEST = 400_000, 512, 4096, 24
#: Places in the table of merge rules, a power of two.
SLOTS = 1 << 18
#: A character that is a token of its own between blanks; it parts words that are encoded in one call.
PART = "\x01"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = np.array([END], dtype="<u4").tobytes()
_MARK, _CARE = re.compile(r"(?<=[a-z])([.,])(?=[ \n]|\Z)"), re.compile("[Σİ]|<[|]")
_CACHES: dict = {}


class WordIds:
    """Ids of words between blanks, as bytes. The tokenizer splits at blanks and drops them, so words are encoded one by one."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.part = self.raw(PART)
        assert len(self.part) == 1
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.merges = Merges(path)

    def raw(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, text):
        """Pieces of ``text`` whose ids, in a row, are the text's: fewer different ones than plain words.

        A closing mark after a letter is a token of its own, and the tokenizer lower-cases; texts
        for which one lower case isn't sure to be the other's, or with special tokens, keep their case.
        """
        if text.isascii() and "<|" not in text or not _CARE.search(text) and unicodedata.is_normalized("NFC", text):
            text = _MARK.sub(r" \1", text.lower())
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def learn(self, words):
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        new = [w for w in words if w not in self.known]
        for w in [w for w in new if PART in w]:
            self.known[w] = np.array(self.raw(w), dtype="<u4").tobytes()
        new = [w for w in new if PART not in w]
        plain, letters, others = [], [], []
        for w in new:
            if not w.isalpha():
                others.append(w)
            else:
                (plain if w.islower() and len(w) <= LONGEST and (w.isascii() or unicodedata.is_normalized("NFC", w)) else letters).append(w)
        self.known.update(zip(plain, self.merges.encode([w.encode() for w in plain])))
        for k in range(0, len(letters), 512):
            some = letters[k:k + 512]
            ids = np.array(self.raw(" ".join(some)), dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):  # every word is one or more pieces
                self.keep(some, ids, ends, 0)
            else:
                others += some
        for k in range(0, len(others), 512):
            some = others[k:k + 512]
            ids = np.array(self.raw(f" {PART} ".join(some) + f" {PART}"), dtype="<u4")
            ends = np.flatnonzero(ids == self.part[0])
            if len(ends) != len(some):
                raise ValueError(f"{len(some)} words, {len(ends)} parts")
            self.keep(some, ids, ends, 1)

    def keep(self, words, ids, ends, gap):
        flat, at = ids.tobytes(), 0
        for w, e in zip(words, ends.tolist()):
            self.known[w] = flat[4 * at:4 * e]
            at = e + gap

    def encode(self, texts):
        """Ids of each text, as arrays."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + _END, dtype="<u4") for words in split]


class Merges:
    """The tokenizer's merge rules, applied to many lower-case words of letters at once: to each word its best pair, until none is left."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        # the byte level's letters: printable bytes are themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner, self.last = (np.array([vocab[letter[b] + end] for b in range(256)], dtype=np.int32) for end in ("", "</w>"))
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        # where a pair's rule is: a table that is a fifth full, in which a pair takes the first free place from its hash on
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.place, self.rule, self.none = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.int32), np.int32(len(pairs))
        todo, at = np.arange(len(key)), self.slot(key)
        while len(todo):
            free = self.place[at] < 0
            self.place[at[free][::-1]], self.rule[at[free][::-1]] = key[todo[free]][::-1], todo[free][::-1]
            left = self.place[at] != key[todo]
            todo, at = todo[left], (at[left] + 1) % SLOTS
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)

    @staticmethod
    def slot(pair):
        with np.errstate(over="ignore"):
            return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def ranks(self, left, right):
        """Rank of the rule for each pair; ``none`` where there is none."""
        pair = left.astype(np.int64) << 32 | right
        at = self.slot(pair)
        found = self.place[at]
        out = np.where(found == pair, self.rule[at], self.none)
        more = np.flatnonzero((found != pair) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) % SLOTS
            found = self.place[at[more]]
            hit = found == pair[more]
            out[more[hit]] = self.rule[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids. Words of about equal lengths are merged together."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        order, found = np.argsort(lengths, kind="stable"), [b""] * len(words)
        for k in range(0, len(order), MERGED):
            rows = order[k:k + MERGED]
            ids, n = self.merged([words[i] for i in rows], lengths[rows])
            flat = ids[ids >= 0].astype("<u4").tobytes()
            at = np.concatenate(([0], np.cumsum(n))) * 4
            for i, x, y in zip(rows.tolist(), at[:-1].tolist(), at[1:].tolist()):
                found[i] = flat[x:y]
        return found

    def merged(self, words, lengths):
        """A row of ids for each word, the first of each merged pair in its place and -1 in that of the second; and how many are left."""
        width = int(lengths[-1]) + 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        row = np.arange(len(words))
        ids = self.inner[raw]
        ids[row, lengths - 1] = self.last[raw[row, lengths - 1]]
        inside = np.arange(width - 1) < lengths[:, None] - 1
        rank = np.full(ids.shape, self.none, dtype=np.int32)
        rank[:, :-1][inside] = self.ranks(ids[:, :-1][inside], ids[:, 1:][inside])
        ids[np.arange(width) >= lengths[:, None]] = -1
        first, end = row * width, row * width + lengths
        flat, ranks = ids.reshape(-1), rank.reshape(-1)
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat) - 1)
        while len(row):
            own = rank[row]
            best = own.argmin(1)
            low = own[np.arange(len(row)), best]
            some = low < self.none
            row, best, low = row[some], best[some], low[some]
            here = first[row] + best
            second = after[here]
            next_ = after[second]
            flat[here], flat[second], ranks[second] = self.result[low], -1, self.none
            after[here] = next_
            inner = next_ < end[row]
            before[next_[inner]] = here[inner]
            ranks[here] = self.none
            ranks[here[inner]] = self.ranks(flat[here[inner]], flat[next_[inner]])
            prior = before[here]
            inner = prior >= first[row]
            ranks[prior[inner]] = self.ranks(flat[prior[inner]], flat[here[inner]])
        return ids, (ids >= 0).sum(1)


def word_ids(path):
    if path not in _CACHES:
        import public_tokenizers

        _CACHES[path] = WordIds(path or public_tokenizers.path(VOCABULARY))
    return _CACHES[path]


def tokenize(docs: DataFrame, path: str | None = None, longest: int = SEQUENCE, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``longest`` ids of each document's ids and a closing 0; with ``keep_ids`` also the ``ids``."""
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches):
        known = word_ids(path)
        for b in batches:
            rows, docs_, texts = [], b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for low in range(0, len(texts), TOGETHER):
                for doc, ids in zip(docs_[low:low + TOGETHER], known.encode(texts[low:low + TOGETHER])):
                    for k, at in enumerate(range(0, len(ids), longest)):
                        part = ids[at:at + longest]
                        rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * keep_ids)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:5 + keep_ids]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        known.known = {"": b""}  # a worker that goes on to other work keeps no words
        give_back()

    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def plan(counts: np.ndarray, size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Bins as (lengths in falling order, how many bins alike) for ``counts[length]`` pieces of each length.

    A bin is filled greedily, the longest piece that fits first.  Then, while its gap is not
    closed, its smallest piece gives way to the two unpacked pieces that together fit the
    expanded gap most tightly, if they fill it better.  Bins alike are made at once, as many as
    the pieces last for, so the work depends on the number of lengths and not of pieces.
    """
    left, out = counts.astype(np.int64).copy(), []
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        bin_, gap, at = [], size, len(lengths) - 1
        used: dict = {}
        while gap > 0:
            at = min(at, int(np.searchsorted(lengths, gap, "right")) - 1)
            while at >= 0 and used.get(lengths[at], 0) >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            x = lengths[at]
            k = min(gap // x, int(left[x]) - used.get(x, 0))
            bin_ += [x] * k
            used[x] = used.get(x, 0) + k
            gap -= k * x
        if gap > 0 and bin_:
            small = bin_[-1]
            pair = best_two(lengths, left, used, gap + small, small)
            if pair:
                bin_.pop()
                used[small] -= 1
                for x in pair:
                    bin_.append(x)
                    used[x] = used.get(x, 0) + 1
                bin_.sort(reverse=True)
        times = min(int(left[x]) // n for x, n in used.items() if n)
        out.append((bin_, times))
        for x, n in used.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x] > 0]
    return out


def best_two(lengths, left, used, room, more_than):
    """Two unpacked lengths with the largest sum over ``more_than`` that fits ``room``."""
    free = [x for x in lengths if left[x] - used.get(x, 0) > 0 and x < room]
    i, j, best, sum_ = 0, len(free) - 1, None, more_than
    while i <= j:
        s = free[i] + free[j]
        if s > room or i == j and left[free[i]] - used.get(free[i], 0) < 2:
            j -= 1
        else:
            if s > sum_:
                best, sum_ = (free[j], free[i]), s
                if s == room:
                    break
            i += 1
    return best


def slots(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by their rank: rows in order of (length, first rank)."""
    rows, taken, base = [], {}, 0
    for bin_, times in planned:
        at, i = 0, 0
        while i < len(bin_):
            x = bin_[i]
            n = bin_.count(x)
            rows.append((x, taken.get(x, 0), n, base, at))
            taken[x] = taken.get(x, 0) + n * times
            at, i = at + n * x, i + n
        base += times
    rows = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), rows.T))


def pack(pieces: DataFrame, size: int = SEQUENCE, per_block: int = 8192) -> DataFrame:
    """``pieces`` (as ``tokenize`` gives them) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length (at most ``size`` numbers) reaches the driver,
    which plans all sequences on it.  Each piece then finds its place by its rank among the
    pieces of its length; ranks come from counts per block of documents, so a length that a
    third of all pieces have is still ranked in many tasks.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        if not 0 < r.length <= size:
            raise ValueError(f"a piece of {r.length} tokens doesn't fit a sequence of {size}")
        counts[r.length] = r.n
    table = slots(plan(counts, size))
    n = cuts(int(counts.sum()), per_block)
    given = pieces.columns
    b = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(n)))
    offsets = b.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = b.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_block"])
    ranked = ranked.select(*given, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches):
        key = (table["length"] << 44) + table["first"]
        for x in batches:
            length, rank = x.column("length").to_numpy(), x.column("_rank").to_numpy()
            s = np.searchsorted(key, (length << 44) + rank, "right") - 1
            k = rank - table["first"][s]
            each = table["each"][s]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in given), pa.array(table["base"][s] + k // each), pa.array(table["offset"][s] + k % each * length)],
                                             [*given, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places in sequences of at most ``size`` tokens.

    A document is its ids and a closing 0; only longer ones are cut.  The ids are made once: the
    pieces go to a table in the shared folder, which counting and placing read.  Null or empty
    text: one piece that holds the closing 0.  No document, no row.  Equal rows are packed
    each; rows with a null id are packed too.  Other columns are ignored.
    """
    return pack(stored(tokenize(docs, path, size, keep_ids, id_col, text_col), "pieces"), size)
