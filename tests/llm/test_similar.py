"""Near copies, repeated passages, near vectors and components against brute force on small fixtures."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import neardup, repeats, vectors
from topicloom.llm.components import components

DOCS = "doc_id long, text string, class_id string, kept string, start string"
VOCABULARY = [f"w{i}" for i in range(4000)]


def text_of(draw, n):
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(draw, text, edits):
    words = text.split()
    for _ in range(edits):
        at = draw.randrange(len(words))
        words[at : at + draw.randint(0, 1)] = [draw.choice(VOCABULARY)] * draw.randint(0, 1)
    return " ".join(words)


def smallest_by_union(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_classes(rows):
    sequences = {}
    for key, text, *_ in rows:
        words = (text or "").lower().split()
        if key is None or not words:
            continue
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)]
        seen = collections.Counter()
        labelled = []
        for g in grams:
            labelled.append((g, seen[g]))
            seen[g] += 1
        sequences.setdefault(key, []).append(labelled)

    def similar(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            last = line[:]
            for j, y in enumerate(b, 1):
                line[j] = last[j - 1] + 1 if x == y else max(last[j], line[j - 1])
        return line[-1] >= 0.8 * (len(a) + len(b) - line[-1])

    keys = sorted(sequences)
    pairs = [
        (a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]
        for x in sequences[a] for y in sequences[b]
        if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) and similar(x, y)
    ]
    return smallest_by_union({r[0] for r in rows if r[0] is not None}, pairs)


def near_rows():
    draw = random.Random(5)
    rows = []
    for g in range(25):
        base = text_of(draw, draw.randint(3, 160))
        rows += [(100 * g + i, edited(draw, base, draw.randint(0, 4)) if len(base.split()) > 20 else base, "a", "b", "c") for i in range(4)]
    crowd = text_of(draw, 120)
    rows += [(5000 + i, edited(draw, crowd, draw.randint(0, 9)), "a", "b", "c") for i in range(60)]
    halves = text_of(draw, 100).split()
    rows += [(7000, " ".join(halves), "a", "b", "c"), (7001, " ".join(halves[50:] + halves[:50]), "a", "b", "c")]
    rows += [
        (9000, None, None, None, None), (9001, "", "a", "b", "c"), (9002, " \n ", "a", "b", "c"), (None, crowd, "a", "b", "c"),
        (9003, "Short  text", "a", "b", "c"), (9004, "short\ntext", "a", "b", "c"), (9005, "la " * 500, "a", "b", "c"), (9006, "la " * 490, "a", "b", "c"),
        (9007, text_of(draw, 8000), "a", "b", "c"),
    ]
    rows.append(rows[0])
    return rows


@pytest.mark.parametrize("blocks", [(256, 1024, 1024), (5, 3, 10)])
def test_near_texts(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "VISITOR_ROWS", "BATCH_ROWS"), blocks):
        monkeypatch.setattr(neardup, name, value)
    rows = near_rows()
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    got = neardup.near_texts(table).collect()
    want = brute_classes(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    kept = neardup.drop_near_copies(table)
    assert kept.columns == table.columns
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == sorted(k for k, c in want.items() if k == c) and left.count(None) == 1
    assert neardup.near_texts(table.limit(0)).count() == 0


def test_alignment_is_banded_and_ordered():
    a = np.arange(100)
    assert neardup.alignment(a, a) == 1.0
    assert neardup.alignment(a, np.delete(a, [3, 50, 97])) == 97 / 100
    assert neardup.alignment(a, np.roll(a, 50)) < 0.8
    assert neardup.alignment(a, np.concatenate([a[:40], [40, 42, 41], a[43:]])) == 99 / 101
    assert neardup.alignment(a, np.zeros(0)) == 0.0


def test_repeats(spark):
    draw = random.Random(9)
    bodies = [text_of(draw, 200) for _ in range(60)]
    planted = set()
    for g in range(0, 50, 2):
        passage = text_of(draw, draw.randint(51, 120))
        for i in (g, g + 1):
            words, at = bodies[i].split(), draw.randrange(200)
            bodies[i] = " ".join(words[:at]) + "\n" * (g % 3 == 0) + " " + passage.upper() * (i % 2) + passage * (1 - i % 2) + " " * (g % 4) + " " + " ".join(words[at:])
        planted.add(g + 1)
    line, short = text_of(draw, 60), text_of(draw, 13)
    bodies += [f"æ{i} start\n{short}\n{line}\nend {i}" for i in range(5)]
    planted |= {61, 62, 63, 64}
    bodies += [text_of(draw, 50) + f"\n{short}\n" + text_of(draw, 50) for _ in range(5)]
    rows = [(i, b, "a", "b", "c") for i, b in enumerate(bodies)]
    rows += [(500, None, None, None, None), (501, "", "a", "b", "c"), (None, line, "a", "b", "c"), (502, "x " * 20, "a", "b", "c")]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    spans = repeats.repeated_spans(table)
    got = spans.collect()
    assert {r.doc_id for r in got} == planted
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        piece = texts[r.doc_id][r.start : r.start + r.length]
        assert len(piece.split()) == r.n_words and piece == piece.strip()
        assert " ".join(piece.lower().split()) in " ".join(texts[r.first_doc_id].lower().split()) and r.first_doc_id < r.doc_id
    assert all(line in texts[i][r.start : r.start + r.length] for r in got for i in [r.doc_id] if i > 60)
    cleaned = repeats.remove_spans(table, spans)
    assert cleaned.columns == table.columns
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append((r.start, r.start + r.length))
    back = cleaned.collect()
    assert len(back) == len(rows)
    for r in back:
        want = texts[r.doc_id]
        for a, b in sorted(by_doc[r.doc_id], reverse=True):
            want = want[:a] + want[b:]
        assert r.text == want
    assert repeats.repeated_spans(table.limit(0)).count() == 0


def test_whole_copies(spark):
    draw = random.Random(1)
    text = text_of(draw, 300) + "\n" + text_of(draw, 80)
    table = spark.createDataFrame([(i, text) for i in (3, 1, 2)] + [(9, text + "\n" + text)], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.length) for r in repeats.repeated_spans(table).collect()}
    assert got == {(2, 0, len(text)), (3, 0, len(text)), (9, 0, 2 * len(text) + 1)}
    assert {r.doc_id: r.text for r in repeats.remove_spans(table, repeats.repeated_spans(table)).collect()} == {1: text, 2: "", 3: "", 9: ""}


def test_repeats_across_line_breaks(spark):
    """Passages with line breaks inside, that begin and end within lines, are found whole."""
    draw = random.Random(12)
    rows, planted = [], {}
    for g in range(40):
        size = 69 if g == 0 else draw.randint(51, 110)
        words = text_of(draw, size).split()
        cuts = {12, 57} if g == 0 else set(draw.sample(range(1, size), draw.randint(1, 8)))
        passage = "".join(w + ("\n" if i + 1 in cuts else " ") for i, w in enumerate(words)).strip()
        for i in (2 * g, 2 * g + 1):
            before, after = f"æ{i} " + text_of(draw, 59) + " ", f" {i}z " + text_of(draw, 60)
            rows.append((i, before + passage + after))
            planted[i] = (len(before), len(passage), size)
    got = {r.doc_id: r for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert sorted(got) == list(range(1, 80, 2))
    for i, r in got.items():
        start, length, size = planted[i]
        # a neighbour may be equal by chance
        assert r.start <= start and r.start + r.length >= start + length and size <= r.n_words <= size + 1 and r.first_doc_id == i - 1


def test_rows_of_known_lines_stay(spark):
    """Text whose pieces all occurred before, but in other places and orders, is no repeated passage."""
    draw = random.Random(13)
    lines = [text_of(draw, 4) for _ in range(60)]
    shared = [text_of(draw, 30) for _ in range(4)]
    rows = [(i, text_of(draw, 30) + "\n" + line + "\n" + text_of(draw, 30)) for i, line in enumerate(lines)]
    rows += [(100 + i, text_of(draw, 40) + " " + words + " " + text_of(draw, 40)) for i, words in enumerate(shared)]
    rows.append((200, "\n".join(draw.sample(lines, 60))))
    rows.append((201, " ".join(shared)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats.repeated_spans(table).count() == 0


def vector_rows():
    draw = np.random.default_rng(4)
    rows, key = [], 0
    for label in (0, 1, None):
        centres = draw.normal(size=(6, 16))
        for c in range(6):
            for _ in range(30):
                rows.append((key, (centres[c] + draw.normal(0, 0.1, 16)).tolist(), label, "x"))
                key += 1
    rows += [(key + i, rows[0][1], 0, "x") for i in range(40)]
    key += 40
    for odd in (None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1e30] * 16):
        rows.append((key, odd, 1, "x"))
        key += 1
    rows.append((None, rows[0][1], 0, "x"))
    rows.append(rows[1])
    return rows


@pytest.mark.parametrize("blocks", [(1024, 4096, 256), (7, 5, 4)])
def test_near_vectors(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "VISITOR_ROWS", "CELL_ROWS"), blocks):
        monkeypatch.setattr(vectors, name, value)
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    got = vectors.near_vectors(table).collect()
    good = []
    for i, (key, v, label, _) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v or [np.nan]], np.float32).astype(float)
        if key is not None and label is not None and np.isfinite(x).all() and x.any():
            good.append((i, key, label, x / np.linalg.norm(x)))
    links, pairs = collections.Counter(), []
    for a, (i, k, la, x) in enumerate(good):
        for j, m, lb, y in good[a + 1 :]:
            if la == lb and len(x) == len(y) and x @ y >= 0.98:
                links[i] += 1
                links[j] += 1
                pairs.append((k, m))
    comps = smallest_by_union({r[0] for r in rows if r[0] is not None}, pairs)
    want = sorted((r[0] if r[0] is not None else -1, links[i], comps.get(r[0], -1)) for i, r in enumerate(rows))
    found = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got)
    assert found == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_recall_of_the_index(spark):
    draw = np.random.default_rng(8)
    points = draw.normal(size=(1500, 64)).astype(np.float32)
    points[750:] = points[:750] + draw.normal(0, 0.12, (750, 64))
    table = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int")
    unit = vectors.units(points)
    true = (np.triu(unit @ unit.T, 1) >= 0.98).sum()
    found = vectors.near_vectors(table).agg(F.sum("n_links")).first()[0] / 2
    assert true > 300 and 0.99 * true <= found <= true


def circle(draw, n, dims):
    angle = draw.uniform(0, 2 * np.pi, n)
    points = np.zeros((n, dims))
    points[:, 0], points[:, dims // 2] = np.cos(angle), np.sin(angle)
    return points @ np.linalg.qr(draw.normal(size=(dims, dims)))[0]


def factors(draw, n, dims):
    return draw.normal(size=(n, 3)) @ draw.normal(size=(3, dims))


@pytest.mark.parametrize("shape", [circle, factors])
@pytest.mark.parametrize("dims,codes", [(64, 2), (64, 16), (384, 64), (768, 32)])
def test_no_link_is_lost_on_vectors_of_low_rank(shape, dims, codes):
    """Every pair at 0.98 meets in a cell, however few directions the vectors fill."""
    points = vectors.units(shape(np.random.default_rng(dims), 700, dims))
    half = dims // 2
    books = vectors.fit_codes(points[:, :half], codes), vectors.fit_codes(points[:, half:], codes)
    own, row, cell = vectors.traverse(points, books, np.sqrt(2 - 2 * 0.98) * (1 + vectors.SLACK))
    met = own[:, None] == own[None]
    for r, c in zip(row.tolist(), cell.tolist()):
        met[r] |= own == c
    linked = points @ points.T >= 0.98
    assert linked.sum() > 2000 and (met | met.T)[linked].all()


def test_links_of_low_rank_vectors_through_spark(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 2)  # some 17 codes a half
    points = circle(np.random.default_rng(5), 600, 64).astype(np.float32)
    table = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<float>, label int")
    unit = vectors.units(points)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(table).collect()} == dict(enumerate(links.tolist()))


def test_one_key_on_several_texts(spark):
    draw = random.Random(12)
    shared, own, other = text_of(draw, 70), text_of(draw, 30), text_of(draw, 120)
    rows = [(1, f"{shared} {text_of(draw, 20)}"), (2, f"{own} {shared}"), (2, other), (2, None), (None, f"{shared} x")]
    for parts in (1, 4):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = repeats.remove_spans(table, repeats.repeated_spans(table)).collect()
        assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in got) == sorted(
            [(0, f"{shared} x"), (1, rows[0][1]), (2, own), (2, other), (2, "")])
    a, b = text_of(draw, 100), text_of(draw, 100)
    rows = [(5, a), (5, b), (9, edited(draw, a, 1)), (12, edited(draw, b, 1)), (13, text_of(draw, 80))]
    for parts in (1, 2, 5):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((r.doc_id, r.class_id) for r in neardup.near_texts(table).collect()) == [(5, 5), (5, 5), (9, 5), (12, 5), (13, 13)]


def test_components(spark):
    draw = random.Random(3)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(draw.randrange(2000, 2200), draw.randrange(2000, 2200)) for _ in range(120)]
    got = {r.vertex: r.comp for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    want = smallest_by_union(nodes, pairs)
    assert {n: got[n] for n in nodes} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
