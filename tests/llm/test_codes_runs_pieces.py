"""Vector codes, periodic runs and sentence pieces against brute force and the library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from topicloom.llm import catalog, codes, pieces, runs
from topicloom.llm.words import Hasher, find_words

PATH = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = "doc_id long, text string, ids string, runs string, n_tokens string, _n string, k long, lab int"
ODD = [
    (1, "a b c a b c a b c a b c a b c", "a", "b", "c", "d", 1, 2),
    (2, None, None, None, None, None, None, None),
    (3, "", "a", "b", "c", "d", 1, 2),
    (4, " \n\t ", "a", "b", "c", "d", 1, 2),
    (5, "x " * 40, "a", "b", "c", "d", 1, 2),
    (5, "x " * 40, "a", "b", "c", "d", 1, 2),
    (None, "no id </s> <0x41>  ▁x", None, "b", None, "d", 1, 2),
    (6, LONG, "a", "b", "c", "d", 1, 2),
    (7, "日本 語 nul\x00byte 😀 é\r\n ﬁ", "a", "b", "c", "d", 1, 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


# --- vector codes --------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    points = [np.floor(np.array(v, dtype=np.float64) * 256).astype(np.int64).reshape(parts, -1) for _, v in rows]
    books = [[p[i].copy() for p in points[:entries]] for i in range(parts)]

    def nearest():
        return [[min(range(len(b)), key=lambda j: (int(((p[i] - b[j]) ** 2).sum()), j)) for i, b in enumerate(books)] for p in points]

    for _ in range(rounds):
        own = nearest()
        for i in range(parts):
            for j in range(len(books[i])):
                members = [p[i] for p, o in zip(points, own) if o[i] == j]
                if members:
                    books[i][j] = sum(members) // len(members)
    own = nearest()
    error = [sum(int(((p[i] - books[i][o[i]]) ** 2).sum()) for i in range(parts)) for p, o in zip(points, own)]
    return own, error, books


@pytest.mark.parametrize("entries,rounds", [(2, 1), (8, 4), (64, 2), (16, 0)])
def test_codes_equal_brute_force(spark, entries, rounds):
    draw = np.random.default_rng(entries)
    # coarse values, so that ties, copies and unused entries occur
    rows = [(i, (draw.integers(-3, 4, 8) / (1 if i % 3 else 64)).tolist()) for i in range(150)]
    rows += [(150 + i, rows[i % 4][1]) for i in range(30)]
    table = spark.createDataFrame([(k, k % 3, v) for k, v in rows], "vec_id long, label int, embedding array<float>").repartition(5)
    made, books = codes.compress(table, parts=4, entries=entries, rounds=rounds)
    own, error, want = brute_codes(rows, 4, entries, rounds)
    got = {r.vec_id: (r.codes, r.error) for r in made.collect()}
    assert got == {k: (o, e) for (k, _), o, e in zip(rows, own, error)}
    assert [[x.tolist() for x in b] for b in want] == books.tolist()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    ok = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, 1, ok), (1, 1, ok), (2, None, [0.1] * 4), (3, 1, None), (4, 1, []), (5, 1, [nan, 1.0, 1.0, 1.0]), (6, 1, [inf, 1.0, 1.0, 1.0]),
            (7, 1, [None, 1.0, 1.0, 1.0]), (8, 1, [1.0, 2.0, 3.0]), (9, 1, [1.0] * 8), (None, 2, [9.0] * 4), (0, 1, [0.0] * 4)]
    schema = "vec_id long, label int, embedding array<double>, codes string, k string, far string"
    table = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)
    made, books = codes.compress(table, parts=2, entries=4, rounds=1)
    got = made.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.label or 0) for r in got) == [(False, 0, 1), (False, 1, 1), (False, 1, 1), (False, 2, 0), (True, 0, 2)]
    assert books.shape == (2, 4, 2)
    made, books = codes.compress(table.where("vec_id = 3"))
    assert made.count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        codes.compress(table, entries=1)


def test_ring_and_core_leave_out_no_nearer_entry():
    draw = np.random.default_rng(4)
    for _ in range(200):
        before = draw.integers(-20, 20, (draw.integers(2, 12), 3))
        points = draw.integers(-25, 25, (60, 3))
        first = codes.codebook(before)
        own = codes.assign(points, np.zeros(60, dtype=np.int64), first)
        gaps = ((points[:, None] - before[None]) ** 2).sum(2)
        assert (own == gaps.argmin(1)).all()
        after, radii = before.copy(), np.zeros(len(before), dtype=np.int64)
        np.maximum.at(radii, own, gaps.min(1))
        moving = draw.random(len(before)) < 0.3
        after[moving] += draw.integers(-4, 5, (moving.sum(), 3))
        again = codes.assign(points, own, codes.codebook(after, before, radii))
        assert (again == ((points[:, None] - after[None]) ** 2).sum(2).argmin(1)).all()


# --- periodic runs -------------------------------------------------------------------------


def brute_runs(words, least=12):
    n, seen = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                seen.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def drawn_words(draw):
    words = [str(draw.randrange(draw.choice([1, 2, 3, 5, 30]))) for _ in range(draw.randint(0, 90))]
    for _ in range(draw.randint(0, 3) if words else 0):
        a, p = draw.randrange(len(words)), draw.randint(1, 20)
        for i in range(a, min(len(words), a + draw.randint(5, 60))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("counted,block", [(0, 100), (1, 1 << 20), (64, 100), (64, 1 << 20)])
def test_runs_equal_brute_force(monkeypatch, counted, block):
    monkeypatch.setattr(runs, "COUNTED", counted)
    monkeypatch.setattr(runs, "BLOCK", block)
    draw = random.Random(counted + block)
    for _ in range(60):
        texts = [drawn_words(draw) for _ in range(15)]
        words = find_words(pa.array([" ".join(t) for t in texts], pa.large_string()))
        found = [[] for _ in texts]
        for text, *run in zip(*(v.tolist() for v in runs.find_runs(runs.word_numbers(words, Hasher(lower=False)), words.first))):
            found[text].append(tuple(run))
        assert found == [brute_runs(t) for t in texts]


def test_runs_of_odd_rows(odd):
    got = runs.periodic_runs(odd).collect()
    assert got[0].asDict().keys() == {"doc_id", "ids", "n_tokens", "_n", "k", "lab", "runs", "collapsed", "n_words"}
    want = []
    for key, text, *_ in ODD:
        words = (text or "").replace("\x00", "\x01").split()
        found = brute_runs(words) if len(words) < 1000 else []
        want.append((key or -1, len(words), found, collapse(words, found).replace("\x01", "\x00")))
    assert sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id != 6) == sorted(w for w in want if w[0] != 6)
    assert runs.periodic_runs(odd.limit(0)).count() == 0


def test_repeats_of_any_size_cost_no_square():
    words = find_words(pa.array(["a " * 200_000, " ".join("abcdefg" * 20_000)], pa.large_string()))
    found = runs.find_runs(runs.word_numbers(words, Hasher(lower=False)), words.first)
    assert [v.tolist() for v in found] == [[0, 1], [0, 0], [200_000, 140_000], [1, 7]]


def test_equal_hashes_of_different_words(monkeypatch):
    words = find_words(pa.array(["ab cd ab", "cd"], pa.large_string()))
    monkeypatch.setattr(Hasher, "spans", lambda self, raw, start, stop: np.zeros(len(start), dtype=np.uint64))
    numbers = runs.word_numbers(words, Hasher())
    assert numbers[0] == numbers[2] != numbers[1] == numbers[3]


def test_query_of_periodic_runs(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.op12_periodic_runs(spark, sf_dir).collect()
    assert len(got) == len(texts)
    some = 0
    for r in got:
        words = find_words(pa.array([texts[r.doc_id] or ""], pa.large_string()))
        raw = words.raw.tobytes()
        w = [raw[a:b].decode() for a, b in zip(words.start, words.stop)]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1200:
            continue
        found = brute_runs(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        some += bool(found)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(w, found).encode()).hexdigest()
    assert some > 5


# --- sentence pieces -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def equal_to_library(library, texts):
    model = pieces.load(PATH)
    ids, counts = pieces.Encoder(model).encode(texts)
    want = library.encode(texts, add_eos=True, num_threads=1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    decoded = pieces.Decoder(model).decode(ids.astype(np.int64), counts).to_pylist()
    assert decoded == [library.decode(x) for x in want]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_pieces_equal_the_library(monkeypatch, library, block):
    monkeypatch.setattr(pieces, "BLOCK_CHARS", block)
    draw = random.Random(block)
    parts = ["a", "b", " ", "  ", "\n", "\t", "▁", "漢", "é", "😀", "\0", "<s>", "</s>", "<unk>", "<0x41>", "the", "ing", "=", "--", "0", "12", "�", "​", "ﬁ", "Ω", "अ"]
    vocabulary = [library.id_to_piece(i) for i in range(259, len(library))]
    texts = ["", "a" * 500, "=" * 700, " " * 300, "ab" * 90]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 30))).replace("▁", draw.choice([" ", "▁", ""])) for _ in range(1500)]
    texts += ["".join(draw.choice("abcdefghij=-_ ") for _ in range(draw.randint(1, 300))) for _ in range(300)]
    equal_to_library(library, texts)


def test_a_merge_that_makes_an_earlier_pair():
    # "ab" merges twice, but the first merge makes "aba", which comes before the second
    model = pieces.load(PATH)
    names = {"a": 300, "b": 301, "ab": 302, "aba": 303}
    model.size, model.letters, model.symbols = 304, np.array([97, 98]), np.array([300, 301], dtype=np.int32)
    pairs = [("a", "b", "ab", 5), ("ab", "a", "aba", 3)]
    model.keys = np.array([names[x] << 21 | names[y] for x, y, *_ in pairs])
    model.ranks, model.merged = np.array([p[3] for p in pairs], dtype=np.int32), np.array([names[p[2]] for p in pairs], dtype=np.int32)
    model.neighbours = np.array([300 << 21 | 301, 301 << 21 | 300])
    flat, count = pieces.Encoder(model)._merge(np.array([300, 301, 300, 301], dtype=np.int32), np.array([4]))
    assert flat.tolist() == [303, 301] and count.tolist() == [2]


def test_decoding_any_ids(library):
    decoder, draw = pieces.Decoder(pieces.load(PATH)), random.Random(2)
    lists = [[draw.randrange(len(library)) if draw.random() < 0.5 else draw.randrange(3, 259) for _ in range(draw.randint(0, 12))] for _ in range(1500)]
    got = decoder.decode(np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists]))
    assert got.to_pylist() == [library.decode(x) for x in lists]
    with pytest.raises(ValueError):
        decoder.decode(np.array([len(library)]), np.array([1]))


def test_pieces_of_odd_rows(odd, library):
    made = pieces.decode_ids(pieces.encode_texts(odd, PATH), PATH)
    assert set(made.columns) == {"doc_id", "runs", "_n", "k", "lab", "ids", "n_tokens", "decoded"}
    ids = [library.encode(t or "", add_eos=True) for _, t, *_ in ODD]
    want = sorted((r[0] or -1, len(i), i, library.decode(i)) for r, i in zip(ODD, ids))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids, r.decoded) for r in made.collect()) == want
    assert pieces.encode_texts(odd.limit(0), PATH, end=False).count() == 0
    nulls = odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids"), F.lit(1).alias("decoded"))
    assert {r.decoded for r in pieces.decode_ids(nulls, PATH).collect()} == {""}


def test_query_of_sentence_pieces(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in catalog.op13_sentence_pieces(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
