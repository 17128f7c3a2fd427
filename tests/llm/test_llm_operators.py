"""Each operator against its plain-Python version, on hand-made tables with nulls, ties, empty and long texts, and clashing columns."""
import base64
import collections
import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tenurelens.llm import byte_bpe, embedding_dedup, exact_dedup, jaccard_join, lm, packing, substring_dedup, suffix_dedup, token_counts, toxicity
from tenurelens.llm import queries as Q
from tenurelens.llm.components import components


def corpus(seed=1, n=60, vocabulary=400):
    """Texts with exact and near copies, shared passages, a repeated word, a null, blanks and one long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    known = [word() for _ in range(vocabulary)]
    text = lambda k: " ".join(r.choice(known) for _ in range(k))
    passage, base = text(70), text(120)
    docs = [text(r.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 5):
        docs[i] = text(20) + "\n" + passage + "\t" + text(15)
    for i in range(1, n, 7):
        w = base.split(" ")
        w[r.randrange(len(w))] = "new" + str(i % 14)
        docs[i] = " ".join(w)
    for i in range(2, n, 9):
        docs[i] = docs[3].upper() if i % 2 else docs[3]
    docs += [None, "", " \n\t ", "one", "one two", "One two", "same " * 90, text(3000), docs[3], None]
    return dict(enumerate(docs))


EMPTY = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, docs):
    """The corpus with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(list(docs.items()), EMPTY).repartition(3)
    for c in ("block", "shard", "kind", "kept", "label", "key", "length", "grp", "rep_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_substring(table, docs, block_bytes):
    got = rows(substring_dedup.substring_dedup(table, 10, block_bytes))
    want = brute.substring(docs, 10)
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 500
    for i, r in got.items():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_null_and_equal_ids(spark):
    t = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(None, t), (None, t), (1, t), (1, t), (2, t)], EMPTY)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(df, 10).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 12), (True, 0, 0), (True, 0, 0)]


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix(table, docs, hot):
    got = rows(suffix_dedup.suffix_dedup(table, 40, hot, 3000))
    want = brute.suffix(docs, 40)
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 2000


def test_suffix_repeats_in_one_text_and_cut_characters(spark):
    docs = {1: "ab" * 100, 2: "x" + "é" * 60, 3: "y" + "é" * 60 + "z", 4: "short"}
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in docs.items()], "doc_id long, text string, kept string, n_chars int")
    want = brute.suffix(docs, 41)
    got = rows(suffix_dedup.suffix_dedup(df, 41))
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for i, r in got.items()} == want
    clean = suffix_dedup.clean_documents(df, 41)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes
    for i, r in rows(clean).items():
        assert r.text == want[i][3].decode("utf-8", "ignore") and r.n_chars == len(r.text) and r.kept == "k"


def test_recurring_positions():
    r = np.random.default_rng(3)
    for _ in range(60):
        t = r.integers(0, int(r.integers(2, 5)), int(r.integers(30, 200))).astype(np.uint8)
        t = np.append(t, np.uint8(255))
        k = int(r.integers(8, 24))
        c = np.concatenate((t, t))
        seen = collections.Counter(bytes(c[i:i + k]) for i in range(len(t)))
        assert (suffix_dedup.recurring(t, k) == [seen[bytes(c[i:i + k])] > 1 for i in range(len(t))]).all()


@pytest.mark.parametrize("width,percent,group", [(3, 90, 256), (3, 90, 3), (5, 80, 4)])
def test_jaccard(table, docs, width, percent, group):
    got = rows(jaccard_join.jaccard_join(table, width, percent, group, 3000))
    want = brute.jaccard(docs, width, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert sum(c != i for i, (_, c) in want.items()) > 8
    stay = jaccard_join.one_of_each(table, width=width, percent=percent)
    assert stay.columns == table.columns and sorted(r.doc_id for r in stay.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


@pytest.mark.parametrize("index", [{}, {"key_bits": 3, "capacity": 2, "owner_bytes": 500}])
def test_exact(table, docs, index):
    got = rows(exact_dedup.exact_dedup(table, **index))
    groups = collections.defaultdict(list)
    for i, t in docs.items():
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), brute.sha(t)) for t, g in groups.items() for i in g}
    assert {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in got.items()} == want
    stay = exact_dedup.without_copies(table, **index)
    assert stay.columns == table.columns and sorted(r.doc_id for r in stay.collect()) == sorted(max(g) for g in groups.values())


def test_exact_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (None, "b"), (5, None)], EMPTY)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()))
    assert got == [(False, 3, 3, 2, True), (False, 5, 5, 1, True), (True, 0, -1, 2, True), (True, 0, -1, 2, True), (True, 0, 3, 2, False)]


def test_directory_doubles():
    counts = np.zeros(16, dtype=np.int64)
    counts[[0, 1, 2, 9]] = [5, 4, 1, 3]
    entries, depth = exact_dedup.directory(counts, 5, 4)
    assert len(entries) == 16 and entries[0] != entries[1] and len(set(entries[8:].tolist())) == 1
    for b in set(entries.tolist()):
        own = counts[entries == b].sum()
        assert own <= 5 or depth[b] == 4
    assert len(exact_dedup.directory(counts, 100, 4)[0]) == 1


def test_packing(spark, table, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.pack_documents(table, size=64, keep_ids=True).collect()
    want = {}
    for i, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, ids[k:k + 64], brute.crc(ids[k:k + 64]))
    assert {(r.doc_id, r.piece): (r.start, list(r.ids), r.ids_crc32) for r in got} == want
    check_places(got, 64)
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= math.ceil(total / 64) * 1.02 + 1


def check_places(got, size):
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size


def test_words_between_blanks_give_the_texts_ids():
    t = packing.word_ids(None)
    odd = ["It's I'm THE'LL x.y. a,b, don't. 3.5, É. Ünï, ΣΑΣ. İx.", "a\x01b \x01", "", "  ", "\x0b a\x0cb", "a.. b., c,. 'S,", "ß. SS, ﬁ. ½,", "é. É,", "<|ENDOFTEXT|>. <|endoftext|>,", "a　b c."]
    for text, ids in zip(odd, t.encode(odd)):
        assert ids.tolist() == t.raw(text) + [0], text


def test_best_two_fit():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedily 6 + 3; 3 gives way to 2 + 2
    assert packing.plan(counts, 10)[0] == ([6, 2, 2], 1)
    r = np.random.default_rng(0)
    for _ in range(50):
        c = np.zeros(31, dtype=np.int64)
        c[1:] = r.integers(0, 50, 30) * (r.random(30) < 0.4)
        made = packing.plan(c, 30)
        used = np.zeros(31, dtype=np.int64)
        for bin_, times in made:
            assert sum(bin_) <= 30 and times > 0
            for x in bin_:
                used[x] += times
        assert (used == c).all()


def test_bytes_bpe(spark, table, docs, monkeypatch):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = rows(byte_bpe.digest(byte_bpe.decode_documents(byte_bpe.encode_documents(table))))
    for i, t in docs.items():
        ids = whole(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    own, r = byte_bpe.codec(), random.Random(5)
    parts = list("abcé'.1 \n\t") + ["  ", "'re", "'ll", "　", "\x85", "\x1c", "日本", " the", "\r\n"]
    for leaf, window in ((1, 1), (3, 2), (8, 64)):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        monkeypatch.setattr(byte_bpe, "WINDOW", window)
        for _ in range(300):
            t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
            assert own.encode(t) == whole(t), repr(t)
            assert own.decode(whole(t)).decode() == t


def test_edits(monkeypatch):
    own, r = token_counts.counter(), random.Random(7)
    parts = list("abc de f'st 12 .,!?\n\t é") + ["  ", "the ", "'ll", "\n\n"]
    for trial in range(400):
        monkeypatch.setattr(token_counts, "LEAF", r.choice([1, 4, 16]))
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        edits, at = [], 0
        while at <= len(text) and r.random() < 0.7:
            a = r.randint(at, len(text))
            b = r.randint(a, min(len(text), a + 8))
            edits.append((a, b, "".join(r.choice(parts) for _ in range(r.randint(0, 6)))))
            at = b + 1
        ends = token_counts.leaves(text)
        got = [own.count(text[x:y]) for x, y in zip([0, *ends], ends)]
        tree = token_counts.Tree(np.diff([0, *ends]).tolist(), [g[0] for g in got], [g[1] for g in got])
        assert tree.sums[1, 2] == len(own.encode(text))
        token_counts.apply_edits(tree, text, edits, own)
        new, at = "", 0
        for a, b, x in edits:
            new, at = new + text[at:a] + x, b
        assert tree.sums[1, 2] == len(own.encode(new + text[at:]))


def test_token_counts(spark):
    texts = {1: "mail me at a.b@example.org or 0123-456-789, thanks", 2: None, 3: "", 4: "nothing here", 5: "x " * 3000 + "9999999" + " y" * 3000}
    df = spark.createDataFrame(list(texts.items()), EMPTY)
    got, own = rows(token_counts.edited_counts(token_counts.build_trees(df, token_counts.redactions()))), token_counts.counter()
    find = token_counts.redactions()
    for i, t in texts.items():
        t, new, at = t or "", "", 0
        for a, b, x in find(t):
            new, at = new + t[at:a] + x, b
        new += t[at:]
        assert (got[i].n_tokens, got[i].n_tokens_after, got[i].n_edits) == (len(own.encode(t)), len(own.encode(new)), len(find(t)))
    assert got[1].n_edits == 2 and 0 < got[5].n_recounted < 500 < got[5].n_pre_tokens


@pytest.mark.parametrize("share,block_bytes", [(1 / 1024, 4000), (0.02, 4000), (2.0, 1 << 20)])
def test_katz(spark, monkeypatch, share, block_bytes):
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    docs = corpus(4, 50, 40)
    df = spark.createDataFrame(list(docs.items()), EMPTY).withColumn("score", F.lit(1)).repartition(3)
    got = rows(lm.katz_scores(df, block_bytes))
    want, p, vocabulary, histories = brute.katz(docs, lm.held_out)
    for i, w in want.items():
        r = got[i]
        assert r.held_out == lm.held_out(i) and (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)
    for h in histories[:40]:
        assert sum(p(h, w) for w in vocabulary) + p(h, "?") == pytest.approx(1, abs=1e-9)


def vectors(seed=2):
    r = np.random.default_rng(seed)
    out = []
    for c in range(12):
        center = r.standard_normal(16)
        for _ in range(8):
            out.append(((center + 0.1 * r.standard_normal(16)).astype(np.float32).tolist(), c % 3))
    out += [out[0], out[0], ([2 * x for x in out[5][0]], 0), (None, 1), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1),
            ([float("inf")] + [1.0] * 15, 1), (out[3][0], None), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([], 1), ([1e-30] * 16, 2), ([3e30] * 16, 2)]
    return [(i, v, y) for i, (v, y) in enumerate(out)]


@pytest.mark.parametrize("block", [3, 512])
def test_vectors(spark, block):
    given = vectors()
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).repartition(3)
    got = rows(embedding_dedup.embedding_dedup(df, 0.93, block=block), "vec_id")
    want = brute.cosine([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in given], 0.93)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_toxicity(spark):
    r = random.Random(3)
    known = ["w" + str(i) for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [r.choice(known) for _ in range(r.randint(5, 60))]
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["vileword", "nastyone", "bad" + "stem" + r.choice("abcdefgh")])
        if junk:
            w = [x + "%%%" if r.random() < 0.5 else x for x in w]
        docs.append((i, " ".join(w), "t"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    docs += [(900, None, "t"), (901, "", "t"), (None, "vileword nastyone", "t"), (902, "w1 " * 20000, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(3)
    known_labels = spark.createDataFrame(labels[:400] + [labels[0], (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = rows(toxicity.toxicity(df, known_labels))
    right = sum(got[i].toxic == bool(t) for i, _, t in labels[400:])
    assert right >= 194 and len(got) == len(docs) and got[None].toxic and not got[900].toxic and not got[902].toxic
    mean = [np.mean([got[i].p_low_quality for i, q, _ in labels[400:] if q == k]) for k in (0, 1)]
    assert mean[0] > 3 * mean[1]
    clean = toxicity.without_toxic(df, toxicity.learned(df, known_labels))
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, r in got.items() if not r.toxic)
    nothing = toxicity.toxicity(df, known_labels.limit(0))
    assert nothing.where("toxic").count() == 0 and nothing.count() == len(docs)


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    nodes = {x for l in links for x in l if l[0] != l[1]}
    got = {x.id: x.component_id for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute.component_ids(nodes, [l for l in links if l[0] != l[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("apply", [
    lambda d, e, y: substring_dedup.digest(substring_dedup.substring_dedup(d)), lambda d, e, y: packing.pack_documents(d), lambda d, e, y: lm.katz_scores(d),
    lambda d, e, y: embedding_dedup.embedding_dedup(e), lambda d, e, y: exact_dedup.exact_dedup(d), lambda d, e, y: toxicity.toxicity(d, y),
    lambda d, e, y: token_counts.edited_counts(token_counts.build_trees(d, token_counts.redactions())), lambda d, e, y: jaccard_join.jaccard_join(d),
    lambda d, e, y: byte_bpe.digest(byte_bpe.decode_documents(byte_bpe.encode_documents(d))), lambda d, e, y: suffix_dedup.digest(suffix_dedup.suffix_dedup(d))])
def test_empty_tables(spark, apply):
    d, e, y = (spark.createDataFrame([], s) for s in (EMPTY, "vec_id long, embedding array<float>, label int", "doc_id long, quality int, toxic int"))
    assert apply(d, e, y).collect() == []


def test_only_nulls(spark):
    d = spark.createDataFrame([(None, None), (1, None)], EMPTY)
    assert [r.n_removed for r in substring_dedup.substring_dedup(d).collect()] == [0, 0]
    assert [r.n_bytes for r in suffix_dedup.suffix_dedup(d).collect()] == [0, 0]
    assert sorted(r.length for r in packing.pack_documents(d).collect()) == [1, 1]
    assert sorted(r.n_tokens for r in lm.katz_scores(d).collect()) == [1, 1]
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_join(d).collect()} == {None: None, 1: 1}


def test_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(Q.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
