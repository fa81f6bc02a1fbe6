"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import chat, codes, lm, mixing, neardup, packing, pieces, quality, repeats, runs, sharding, tokens, vectors
from topicloom.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Shares of the languages, and how far the shares of sources and kinds of text are flattened.
MIX = {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "source": 0.5, "topic": 0.5}

@query
def op1_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mixing.mix(mixing.with_topic(docs).drop("text"), MIX)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


_SQL["op1_mixing"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), d AS (SELECT doc_id, source, lang, n_tokens, {mixing.KIND} AS topic FROM w
), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
), s AS (SELECT source, sqrt(sum(tokens)) AS want FROM cells GROUP BY 1 HAVING sum(tokens) > 0
), t AS (SELECT topic, sqrt(sum(tokens)) AS want FROM cells GROUP BY 1 HAVING sum(tokens) > 0
), l AS (SELECT lang, CASE lang WHEN 'en' THEN 0.4 ELSE 0.2 END AS want FROM cells GROUP BY 1
), start AS (
  SELECT 0 AS sweep, cells.*, 1.0::DOUBLE AS factor, s.want / (SELECT sum(want) FROM s) AS ts,
    t.want / (SELECT sum(want) FROM t) AS tt, l.want / (SELECT sum(want) FROM l) AS tl
  FROM cells JOIN s USING (source) JOIN t USING (topic) JOIN l USING (lang)
), ipf AS (
  SELECT * FROM start UNION ALL
  SELECT sweep + 1, source, lang, topic, tokens, factor * tt / sum(tokens * factor) OVER (PARTITION BY topic), ts, tt, tl FROM (
    SELECT * REPLACE (factor * ts / sum(tokens * factor) OVER (PARTITION BY source) AS factor) FROM (
      SELECT * REPLACE (factor * tl / sum(tokens * factor) OVER (PARTITION BY lang) AS factor) FROM ipf WHERE sweep < {mixing.SWEEPS}))
), p AS (
  SELECT source, lang, topic, least(1.0, factor / max(CASE WHEN tokens > 0 THEN factor END) OVER ()) AS p FROM ipf WHERE sweep = {mixing.SWEEPS}
)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 < p AS sampled
FROM d JOIN p USING (source, lang, topic)
"""


@query
def op2_chat(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_chats(turns).withColumn("_read", chat.read_turns(F.col("formatted")))
    whole = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.withColumn("_loss", chat.loss_text(F.col("segments")))
    return made.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad",
    )


_SQL["op2_chat"] = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    len(regexp_extract_all(text, '[\[<]\\*(?:<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|:\]|/ROLE\])')) AS signs,
    CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END AS marks
  FROM rows
), fsm AS (
  SELECT conv_id, 0::BIGINT AS pos, 'start' AS state FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT fsm.conv_id, t.pos, CASE fsm.state || '>' || t.role WHEN 'start>system' THEN 'told' WHEN 'start>user' THEN 'asked'
    WHEN 'told>user' THEN 'asked' WHEN 'asked>assistant' THEN 'answered' WHEN 'answered>user' THEN 'asked' ELSE 'error' END
  FROM fsm JOIN t ON t.conv_id IS NOT DISTINCT FROM fsm.conv_id AND t.pos = fsm.pos + 1
), machine AS (
  SELECT conv_id, arg_max(state, pos) = 'answered' AS valid, min(pos) FILTER (state = 'error')::INT AS first_bad FROM fsm GROUP BY 1
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS whole,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss,
    sum(length(text) + signs + marks)::BIGINT AS formatted_chars
  FROM t GROUP BY 1
)
SELECT c.conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, valid, first_bad
FROM c JOIN machine ON machine.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op3_packing(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.cut_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), path))


@query
def op4_quality_rules(spark, sf_dir):
    ledger = quality.rule_ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(ledger, "base", "_base"), "v1")
    return judged.selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "not _base as base_failed", "failed", "kept"
    )


_SQL["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), spots AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram
  FROM d WHERE len(w) >= 3
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM spots
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
      + 4 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 8 * (10 * n_symbols > n_words)::BIGINT
      + 16 * (2 * n_dup_lines > n_lines)::BIGINT + 32 * (2 * n_upper > n_letters)::BIGINT)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, failed = 0 AS kept FROM f
"""


@query
def op5_lm_scores(spark, sf_dir):
    return lm.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_token_counts(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(table, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_repeated_passages(spark, sf_dir):
    return repeats.repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_sharding(spark, sf_dir):
    placed = sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op9_near_vectors(spark, sf_dir):
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op10_near_texts(spark, sf_dir):
    return neardup.near_texts(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_vector_codes(spark, sf_dir):
    made, books = codes.compress(read(spark, sf_dir, "embeddings"))
    made = cut_lineage(made)
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    per_label = made.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return made.join(per_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


def _code_rounds(rounds: int) -> str:
    """Common tables a0, c1, a1, ... of the assignments and codebooks of parts of four components."""
    gap = " + ".join(f"(p.x{i} - c.x{i}) * (p.x{i} - c.x{i})" for i in range(4))
    sql = []
    for r in range(rounds + 1):
        sql.append(f"""a{r} AS (
  SELECT p.vec_id, p.part, min({{'d': ({gap})::BIGINT, 'entry': c.entry}}) AS best, any_value(p.x0) AS x0, any_value(p.x1) AS x1,
    any_value(p.x2) AS x2, any_value(p.x3) AS x3
  FROM p JOIN c{r} c USING (part) GROUP BY p.vec_id, p.part)""")
        mean = ", ".join(f"coalesce(floor(sum(a.x{i}) / count(a.vec_id)), any_value(c.x{i}))::BIGINT AS x{i}" for i in range(4))
        sql.append(f"""c{r + 1} AS (
  SELECT c.part, c.entry, {mean} FROM c{r} c LEFT JOIN a{r} a ON a.part = c.part AND a.best.entry = c.entry GROUP BY c.part, c.entry)""")
    return ", ".join(sql[:-1])


_SQL["op11_vector_codes"] = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS rn
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), p AS (
  SELECT vec_id, rn, part, v[4 * part + 1] AS x0, v[4 * part + 2] AS x1, v[4 * part + 3] AS x2, v[4 * part + 4] AS x3
  FROM k, range(16) AS parts(part)
), c0 AS (SELECT part, rn AS entry, x0, x1, x2, x3 FROM p WHERE rn < 64), {_code_rounds(2)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id
), labelled AS (
  SELECT coded.*, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM coded JOIN k USING (vec_id)
), digest AS (
  SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2
)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM labelled, digest
"""


@query
def op12_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return run_digests(runs.periodic_runs(plant_runs(docs)))


def plant_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its id, goes on with a repeated stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.withColumn("_h", h).withColumn("_g", F.floor(F.col("_h") / 10))
    worded = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("_w", worded).withColumn("_n", F.size("_w").cast("long"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    rest = (F.col("_n") - F.col("_a")).cast("int")
    piece = F.slice("_w", F.col("_a").cast("int") + 1, F.col("_p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(piece, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_sentence_pieces(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return pieces.decode_ids(encoded, path).select(
        "doc_id",
        "n_tokens",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
