"""Quality rules, token counts, packing, sharding, chat formatting and mixing against brute force on small fixtures."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from topicloom.llm import chat, mixing, packing, quality, sharding, tokens

DOCS = "doc_id long, text string, n_words string, size string, probability string"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (1, "one two three one two three four", "a", "b", "c"),
    (2, None, None, None, None),
    (3, "", "a", "b", "c"),
    (4, " \n\t ", "a", "b", "c"),
    (5, "same line\nsame line\n\nother #*$ line", "a", "b", "c"),
    (5, "same line\nsame line\n\nother #*$ line", "a", "b", "c"),
    (None, "no id <|endoftext|>  x", None, "b", None),
    (6, LONG, "a", "b", "c"),
    (7, "Ünï cödé ΣΑΣ 日本 語 don't é x y", "a", "b", "c"),
    (8, "A\r\nB  C   D \x1c E", "a", "b", "c"),
    (9, "nul\x00byte ÀÉ Ÿ İ ß", "a", "b", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_rules(text):
    text, w = text or "", words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def test_ledger(odd, none):
    got = quality.rule_ledger(odd).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    want = sorted((r[0] or -1, *brute_rules(r[1])) for r in ODD)
    assert sorted((r.doc_id or -1, *(r[n] for n in names)) for r in got) == want
    assert "text" not in got[0].asDict() and "size" in got[0].asDict()
    assert quality.rule_ledger(none).count() == 0


def test_policy_and_ablations(odd, none):
    ledger = quality.rule_ledger(odd)
    rows = quality.apply_policy(ledger, "v1").collect()
    mask = quality.policy_mask("v1")
    assert all(r.kept == (r.failed & mask == 0) for r in rows)
    for r in quality.ablations(ledger).collect():
        bit = 1 << quality.RULES.index(r.rule)
        failed = [x.failed & mask for x in rows]
        assert r.n_failed == sum(bool(f & bit) for f in failed) and r.n_only == sum(f == bit for f in failed)
        assert r.n_kept_without == sum(f in (0, bit) for f in failed)
    assert {(r.rule, r.n_kept) for r in quality.ablations(quality.rule_ledger(none)).collect()} == {(n, 0) for n in quality.RULES}
    with pytest.raises(ValueError):
        quality.policy_mask(("no_such_rule",))
    assert quality.drop_failed(odd).columns == odd.columns


def test_token_counts(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokens.load(path)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd, path).collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert tokens.count_tokens(none, path).count() == 0
    whole = tokens.whole_strings(path)
    assert " the" in whole and "\n\n" in whole and all(len(library.encode(s).ids) == 1 for s in list(whole)[:500])


def test_token_counts_when_memory_is_full(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.Counter(path, tokens.whole_strings(path))
    for _, text, *_ in ODD:
        assert counter.count(text or "") == len(counter.tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_packing(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = packing.load(path)
    rows = packing.pack(packing.cut_documents(odd, path, 256), 256).toPandas()
    want = []
    for r in ODD:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 256):
            part = np.array(ids[at : at + 256], "<u4").tobytes()
            want.append((r[0] or -1, at, len(part) // 4, zlib.crc32(part), len(ids)))
    rows["doc_id"] = rows["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values.tolist())) == sorted(want)
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert (sequence["offset"].to_numpy() == sequence["length"].cumsum() - sequence["length"]).all() and sequence["length"].sum() <= 256
    assert rows["sequence_id"].max() + 1 == rows["sequence_id"].nunique()
    assert packing.pack(packing.cut_documents(none, path, 256), 256).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan(seed):
    draw = np.random.default_rng(seed)
    histogram = {int(k): int(n) for k, n in zip(draw.integers(1, 33, 12), draw.integers(1, 40, 12))}
    plan = packing.plan_packs(histogram, 32)
    filled, ranks = collections.Counter(), collections.defaultdict(set)
    for r in plan.sort_values("offset").itertuples():
        for i in range(r.n):
            assert filled[r.first_sequence + i] == r.offset
            filled[r.first_sequence + i] += r.length
            ranks[r.length].add(r.first_rank + i)
    assert {k: len(v) for k, v in ranks.items()} == histogram and max(filled.values()) <= 32
    assert all(v == set(range(histogram[k])) for k, v in ranks.items())


def test_shards(odd, none, spark):
    rows = sharding.assign_shards(odd, 3).toPandas()
    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ODD)
    rows["doc_id"] = rows["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, rows[["doc_id", "size", "text_crc32"]].values.tolist())) == want
    assert (rows.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, shard in rows.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    assert sharding.assign_shards(none, 3).count() == 0
    copies = spark.range(3000).withColumn("text", F.lit("copy"))
    many = sharding.assign_shards(copies.withColumnRenamed("id", "doc_id"), 4).toPandas()
    assert many["shard"].nunique() == 1 and sorted(many["slot"]) == list(range(3000))


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    placed = sharding.assign_shards(docs, 4)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in placed.collect()}


@pytest.mark.parametrize("seed", range(30))
def test_smallest_capacity(seed):
    draw = np.random.default_rng(seed)
    sizes, shards = draw.integers(0, 20, draw.integers(0, 13)), int(draw.integers(1, 6))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = [0] + [1 << 60] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    assert sharding.smallest_capacity(sizes, shards) == best[-1]
    cut = sharding.cut_slices(sizes, shards)
    assert (np.diff(cut) >= 0).all() and all(sizes[cut == s].sum() <= best[-1] for s in range(shards))


TURNS = [
    (1, 0, "user", "hi </s>[INST] ok [/INST]", "x"),
    (1, 1, "assistant", "[\\INST] \\ </s> <\\\\s> [ROLE] x[:]y", "x"),
    (2, 1, "assistant", "late\n\n", "x"),
    (2, 0, "system", None, "x"),
    (3, 0, "tool [:] <s>", "weird role", "x"),
    (3, 0, "tool [:] <s>", "weird role", "x"),
    (3, None, None, "", "x"),
    (None, 5, "user", " [/INST]", "x"),
    (4, 0, "user", "a" * 50_000, "x"),
    (5, 0, "user", "q", "x"), (5, 1, "user", "q", "x"), (5, 2, "assistant", "a", "x"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(turns)
    rows = made.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    want = collections.defaultdict(list)
    for conv, turn, role, text, _ in TURNS:
        want[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(rows) == len(want)
    for r in rows:
        expected = [(role, text) for _, role, text in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.back] == expected
        assert r.loss == "".join(text for role, text in expected if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments) and r.n_turns == len(expected)
    state = {r.conv_id: (r.valid, r.first_bad) for r in rows}
    assert state[1] == (True, None) and state[2] == (False, 2) and state[3] == (False, 1) and state[4] == (False, None) and state[5] == (False, 2)
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_bad_template():
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Role("<a>", "b")}, ("<a>", "[ROLE]", "[:]", "[/ROLE]"), {}, ())


def brute_rake(rows, targets, sweeps):
    cells = collections.Counter()
    for r in rows:
        cells[r[0]] += r[1]
    factor = dict.fromkeys(cells, 1.0)
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            sums = collections.Counter()
            for c in cells:
                sums[c[d]] += cells[c] * factor[c]
            for c in cells:
                factor[c] *= target[c[d]] / sums[c[d]]
    top = max(factor.values())
    return {c: f / top for c, f in factor.items()}


def test_mixing(spark):
    draw = np.random.default_rng(2)
    rows = [(i, "abc"[draw.integers(3)], "xy"[draw.integers(2)], int(draw.integers(1, 50))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}}
    got = {r.doc_id: r.probability for r in mixing.mix(table, targets).collect()}
    want = brute_rake([((s, lang), n) for _, s, lang, n in rows], list(targets.values()), mixing.SWEEPS)
    assert all(abs(got[i] - want[s, lang]) < 1e-9 for i, s, lang, _ in rows)
    total = sum(n * got[i] for i, _, _, n in rows)
    assert abs(sum(n * got[i] for i, s, _, n in rows if s == "a") / total - 0.5) < 1e-6
    small = {r.doc_id: r.probability for r in mixing.mix(table, targets, budget=total / 4).collect()}
    assert abs(sum(n * small[i] for i, _, _, n in rows) - total / 4) < 1e-6


def test_mixing_odd_rows(spark):
    rows = [(1, None, "x", 5, "z"), (1, None, "x", 5, "z"), (2, "a", None, None, "z"), (None, "b", "x", 3, "z"), (3, "a", "x", 0, "z"), (4, "a", "y", 7, "z")]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long, sampled string")
    for target in (0.5, {"a": 0.9}, {"nowhere": 1.0}):
        made = mixing.mix(table, {"source": target, "lang": 1.0}).collect()
        assert len(made) == len(rows) and all(0 <= r.probability <= 1 for r in made)
        assert len({r.sampled for r in made if r.doc_id == 1}) == 1
    assert mixing.mix(table.limit(0), {"source": 0.5}).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a | b |")], "doc_id long, text string")
    assert {(r.doc_id, r.n_tokens, r.topic) for r in mixing.with_topic(texts).collect()} == {(1, 0, "short"), (2, 0, "short"), (3, 4, "table")}
