"""Token counts that follow edits: a segment tree over each document's pre-tokens."""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tenurelens.llm.tables import documents

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a leaf, about; pre-tokens a Python worker remembers; rows of a batch.
LEAF, REMEMBERED, ROWS = 256, 300_000, 256
#: A character that no white space rule matches, before a plain blank: a pre-token ends here whatever stands around.
SAFE = regex.compile(r"[^\s\x1c-\x1f\x85](?=[ \t\n\r])")
#: What the registered query blanks out: e-mail addresses and longer numbers.
PERSONAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9][0-9-]{5,}"
TREES = ("doc_id long, text string, leaf_chars array<int>, leaf_pre_tokens array<int>, leaf_tokens array<int>, "
         "edits array<struct<start:int,end:int,replacement:string>>")
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("replacement", pa.string())]))
_COUNTERS: dict = {}


class Counter:
    """Tokens of pre-tokens under one vocabulary. Built once in each Python worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict = {}

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        parts, known, n = self.pattern.findall(text), self.known, 0
        for p in parts:
            k = known.get(p)
            if k is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                k = known[p] = len(self.encode(p))
            n += k
        return len(parts), n


def counter(path: str | None = None, pattern: str | None = None) -> Counter:
    if (path, pattern) not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[path, pattern] = Counter(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    return _COUNTERS[path, pattern]


def leaves(text: str) -> list[int]:
    """Where the leaves of a text end: certain pre-token ends about LEAF characters apart."""
    out, at = [], 0
    while at < len(text):
        m = SAFE.search(text, at + LEAF - 1)
        at = m.end() if m else len(text)
        out.append(at)
    return out


class Tree:
    """Sums of characters, pre-tokens and tokens over a text's leaves; node i has children 2i and 2i + 1.

    Characters stay those of the text as it was, since edits are given in its positions.
    """

    def __init__(self, chars: list[int], pre_tokens: list[int], tokens: list[int]):
        chars, pre_tokens, tokens = (chars, pre_tokens, tokens) if len(chars) else ([0], [0], [0])
        self.n, self.origin, self.now = len(chars), chars, np.array([pre_tokens, tokens], dtype=np.int64).T
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), dtype=np.int64)
        self.sums[self.size:self.size + self.n] = np.array([chars, pre_tokens, tokens], dtype=np.int64).T.reshape(-1, 3)
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if char >= before + self.sums[i, 0]:
                before += int(self.sums[i, 0])
                i += 1
        return i - self.size, before

    def update(self, leaf: int, change) -> None:
        i = leaf + self.size
        while i:
            self.sums[i] += change
            i //= 2


def apply_edits(tree: Tree, text: str, edits: list[tuple[int, int, str]], own: Counter) -> int:
    """Brings the tree to the edited text; returns how many pre-tokens were counted again.

    An edit touches the leaves from the one with the character before it to the one with the
    character after it.  Leaves that edits touch together are counted again as one stretch,
    whose borders are certain ends that no edit changed; sums are updated up the tree.
    """
    again, k = 0, 0
    while k < len(edits):
        first, low = tree.leaf_at(max(0, edits[k][0] - 1))
        parts, at = [], low
        while True:
            start, end, new = edits[k]
            parts += [text[at:start], new]
            at = end
            last, before = tree.leaf_at(min(end, len(text) - 1))
            high = before + int(tree.origin[last])
            k += 1
            if k == len(edits) or edits[k][0] - 1 >= high:
                break
        stretch = "".join(parts) + text[at:high]
        n_pre, n_tokens = own.count(stretch)
        again += n_pre
        for leaf in range(first, last + 1):
            was = tree.now[leaf]
            now = np.array([n_pre, n_tokens]) if leaf == first else np.zeros(2, dtype=np.int64)
            tree.update(leaf, np.array([0, *(now - was)]))
            tree.now[leaf] = now
    return again


def build_trees(docs: DataFrame, find=None, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the leaves of its tree: ``leaf_chars``, ``leaf_pre_tokens``, ``leaf_tokens``.

    A leaf is a stretch between certain pre-token ends, so leaves are counted on their own and
    their sums are the document's counts.  ``find(text)`` may give edits, kept as ``edits``.
    Null or empty text: no leaves.  Other columns are left out; equal rows and null ids give rows
    of their own.
    """
    def run(batches):
        own = counter(path, pattern)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            chars, pre, tokens, edits = [], [], [], []
            for text in b.column("text").to_pylist():
                ends = leaves(text)
                got = [own.count(text[x:y]) for x, y in zip([0, *ends], ends)]
                chars.append(np.diff([0, *ends]).tolist())
                pre.append([g[0] for g in got])
                tokens.append([g[1] for g in got])
                edits.append([dict(zip(("start", "end", "replacement"), e)) for e in find(text)] if find else [])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(chars, kind), pa.array(pre, kind), pa.array(tokens, kind), pa.array(edits, _EDITS)],
                                             ["doc_id", "text", "leaf_chars", "leaf_pre_tokens", "leaf_tokens", "edits"])

    return documents(docs, id_col, text_col).mapInArrow(run, TREES)


def edited_counts(trees: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per tree: tokens before and after its ``edits``, and how much was counted again.

    ``edits`` holds (start, end, replacement) in characters of the text, in order and without
    overlap; null or empty means none.  Columns: ``doc_id``, ``n_pre_tokens``, ``n_tokens``,
    ``n_edits``, ``n_recounted`` (pre-tokens) and ``n_tokens_after``.
    """
    def run(batches):
        own = counter(path, pattern)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            rows = []
            for doc, text, chars, pre, tokens, edits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "leaf_chars", "leaf_pre_tokens", "leaf_tokens", "edits"))):
                again, after = 0, sum(tokens)
                if edits:
                    tree = Tree(chars, pre, tokens)
                    again = apply_edits(tree, text, [(e["start"], e["end"], e["replacement"]) for e in edits], own)
                    after = int(tree.sums[1, 2])
                rows.append((doc, sum(pre), sum(tokens), len(edits or ()), again, after))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [[]] * 6], ["doc_id", "n_pre_tokens", "n_tokens", "n_edits", "n_recounted", "n_tokens_after"])

    return trees.mapInArrow(run, "doc_id long, n_pre_tokens long, n_tokens long, n_edits long, n_recounted long, n_tokens_after long")


def redactions(pattern: str = PERSONAL, replacement: str = "<removed>"):
    """Edits that blank out what a pattern matches: ``text`` to (start, end, replacement), in order and apart."""
    def edits(text):
        found = regex.compile(pattern, regex.ASCII)
        return [(m.start(), m.end(), replacement) for m in found.finditer(text)]
    return edits
