"""SQL equivalents of the registered queries, in the dialect of an embedded SQL engine.

Each text reads the same tables as its query, whole.
"""

from __future__ import annotations

from topicloom.functions import fixed_values as fv
from topicloom.functions.fixed_values import DANISH_STOPWORDS
from topicloom.plans.catalog import PHRASE, SEEDS

STOP = ", ".join("'" + w + "'" for w in DANISH_STOPWORDS)
POSTS = "SELECT CAST(doc_id AS VARCHAR) AS id, text, doc_id AS ord FROM documents WHERE text IS NOT NULL"
TOPIC = r"CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER)"
CLASSED = f"SELECT doc_id, text, {TOPIC} AS topic FROM documents"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def cleaned(x: str) -> str:
    x = f"replace(regexp_replace({x}, '{fv.HTML_TAG}', ' ', 'g'), '{fv.ESCAPED_TAB}', ' ')"
    return strip(f"regexp_replace({x}, '{fv.BLANKS}', ' ', 'g')")


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) > 0)"


def sensitive(x: str) -> str:
    date = f"regexp_matches({x}, '{fv.DATE}', 'i')"
    phone = f"regexp_matches({x}, '{fv.PHONE}')"
    email = f"regexp_matches({x}, '{fv.EMAIL}')"
    home = f"regexp_matches({x}, '{fv.HOMEPAGE}', 'i')"
    return f"({date} OR {phone} OR {email} OR {home})"


def safe(x: str) -> str:
    kept = f"list_filter({sentences(x)}, lambda s: NOT {sensitive('s')})"
    line = strip(rf"regexp_replace(s, '[\r\n]+', ' ', 'g')")
    return f"list_filter(list_transform({kept}, lambda s: {line}), lambda s: length(s) > 0)"


def toks(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '{fv.TOKEN}')"


def words(x: str) -> str:
    return f"list_filter({toks(x)}, lambda t: t NOT IN ({STOP}))"


def grams(table: str, keep: str, high: int = 3) -> str:
    """CTE parts: one row per n-gram occurrence of ``table`` (keep, text)."""
    parts = [f"SELECT {keep}, unnest(w) AS term FROM lists"]
    if high >= 2:
        parts.append(f"SELECT {keep}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM lists")
    if high >= 3:
        parts.append(
            f"SELECT {keep}, unnest(list_transform(range(1, len(w) - 1), "
            "lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS term FROM lists"
        )
    return f"lists AS (SELECT {keep}, {words('text')} AS w FROM ({table})), terms AS ({' UNION ALL '.join(parts)})"


def counts(high: int = 3, table: str = CLASSED) -> str:
    return f"{grams(table, 'topic', high)}, counts AS (SELECT topic, term, count(*) AS tf FROM terms GROUP BY ALL)"


VOCAB = (
    "vocab AS (SELECT term, sum(tf) AS total FROM counts GROUP BY term HAVING count(*) >= 10 "
    "ORDER BY total DESC, term LIMIT 10000), "
    "used AS (SELECT topic, term, tf FROM counts WHERE term IN (SELECT term FROM vocab))"
)
TOTALS = (
    "sizes AS (SELECT topic, sum(tf) AS n FROM used GROUP BY topic), "
    "totals AS (SELECT term, sum(tf) AS total FROM used GROUP BY term), "
    "average AS (SELECT CAST(floor(avg(n)) AS DOUBLE) AS a FROM sizes)"
)


def plain(table: str = CLASSED) -> str:
    return (
        f"{counts(1, table)}, used AS (SELECT * FROM counts), {TOTALS}, "
        "scored AS (SELECT topic, term, tf, ln(1 + a / total) AS weight, (tf / n) * ln(1 + a / total) AS score "
        "FROM used JOIN sizes USING (topic) JOIN totals USING (term), average)"
    )


BM25 = (
    f"{counts(3)}, {VOCAB}, {TOTALS}, "
    "scored AS (SELECT topic, term, tf, sqrt(tf / n) * ln(1 + (a - total + 0.5) / (total + 0.5)) AS score "
    "FROM used JOIN sizes USING (topic) JOIN totals USING (term), average)"
)


def ranked(n: int) -> str:
    return (
        "ranked AS (SELECT topic, term, score, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) "
        f"AS rank FROM scored QUALIFY rank <= {n})"
    )


def bit(d: str) -> str:
    half = "CASE WHEN dim < 32 THEN h0 >> dim ELSE h1 >> (dim - 32) END"
    return f"(({half}) & 1)".replace("dim", d)


def static(table: str, keys: str, name: str = "emb", dims: int = 64, weight: str | None = None) -> str:
    """CTE parts ending in ``name`` (keys, dim, value): unit vectors of the signed token sums."""
    p = name
    w = "1" if weight is None else "coalesce(weight, 1)"
    join = "" if weight is None else f" LEFT JOIN {weight} USING (token)"
    return (
        f"{p}_t AS (SELECT {keys}, unnest(CASE WHEN len({toks('text')}) = 0 THEN [NULL] ELSE {toks('text')} END) AS token FROM ({table})), "
        f"{p}_v AS (SELECT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h0, "
        f"CAST('0x' || substr(md5(token), 9, 8) AS BIGINT) AS h1 FROM (SELECT DISTINCT token FROM {p}_t WHERE token IS NOT NULL)), "
        f"{p}_n AS (SELECT {keys}, token, CASE WHEN token IS NULL THEN 0 ELSE sum({w}) END AS w FROM {p}_t{join} GROUP BY {keys}, token), "
        f"{p}_s AS (SELECT {keys}, CAST(d.dim AS INTEGER) AS dim, "
        f"sum(coalesce(w * (1 - 2 * {bit('d.dim')}), 0)) AS s FROM {p}_n LEFT JOIN {p}_v USING (token), range({dims}) d(dim) GROUP BY {keys}, d.dim), "
        f"{p} AS (SELECT {keys}, dim, CASE WHEN q = 0 THEN 0 ELSE s / sqrt(q) END AS value FROM "
        f"(SELECT *, sum(CAST(s AS DOUBLE) * s) OVER (PARTITION BY {keys}) AS q FROM {p}_s))"
    )


def similar(n: int) -> str:
    phrase = f"SELECT 1 AS one, '{PHRASE}' AS text"
    return (
        f"{static(CLASSED, 'doc_id, topic')}, {static(phrase, 'one', 'ph')}, "
        "cen AS (SELECT topic, dim, avg(value) AS value FROM emb GROUP BY topic, dim), "
        "sims AS (SELECT topic, sum(cen.value * ph.value) / (sqrt(sum(cen.value ^ 2)) * sqrt(sum(ph.value ^ 2))) AS similarity "
        "FROM cen JOIN ph USING (dim) GROUP BY topic), "
        f"best_topics AS (SELECT topic, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, topic) AS INTEGER) AS rank FROM sims QUALIFY rank <= {n})"
    )


LABELLED = "SELECT vec_id, label AS topic, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
COORDS = (
    f"v AS ({LABELLED}), c AS (SELECT vec_id, topic, unnest(e) AS x, unnest(range(len(e))) AS dim FROM v)"
)
CENTRES = f"{COORDS}, cen AS (SELECT topic, dim, avg(x) AS value FROM c GROUP BY topic, dim)"


def knn(k: int, cosine: bool = False) -> str:
    d = "1 - list_cosine_similarity(a.e, b.e)" if cosine else "list_distance(a.e, b.e)"
    return (
        f"v AS ({LABELLED}), near AS (SELECT a.vec_id, b.vec_id AS neighbor, {d} AS distance, "
        f"CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {d}, b.vec_id) AS INTEGER) AS rank "
        f"FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY rank <= {k})"
    )


LANG = r"""
WITH g AS (
    SELECT doc_id, lang, string_split(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g'), '') AS c FROM documents
), grams AS (
    SELECT doc_id, lang, unnest(c) AS gram FROM g
    UNION ALL
    SELECT doc_id, lang, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM g
    UNION ALL
    SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM g
), n AS (
    SELECT doc_id, lang, gram, count(*) AS k FROM grams GROUP BY ALL
), freq AS (
    SELECT lang, gram, sum(k) AS f FROM n GROUP BY ALL
), size AS (
    SELECT lang, sum(f) AS total, (SELECT count(DISTINCT gram) FROM freq) AS vocab FROM freq GROUP BY lang
), seen AS (
    SELECT doc_id, freq.lang, sum(k * ln(f + 1)) AS s FROM n JOIN freq USING (gram) GROUP BY ALL
), len AS (
    SELECT doc_id, sum(k) AS m FROM n GROUP BY doc_id
), score AS (
    SELECT len.doc_id, size.lang, coalesce(s, 0) - m * ln(total + vocab) AS s
    FROM len CROSS JOIN size LEFT JOIN seen ON seen.doc_id = len.doc_id AND seen.lang = size.lang
), top AS (
    SELECT doc_id, max(s) AS best, arg_max(lang, s) AS lang FROM score GROUP BY doc_id
), decided AS (
    SELECT doc_id, CASE WHEN (SELECT count(*) FROM score x WHERE x.doc_id = top.doc_id AND x.s >= best - 1e-6) > 1 THEN 'unknown'
        ELSE CASE lang WHEN 'de' THEN 'DEU' WHEN 'en' THEN 'ENG' WHEN 'es' THEN 'SPA' WHEN 'fr' THEN 'FRA' ELSE upper(lang) END
        END AS language FROM top
)
"""

PARAGRAPH_POSTS = r"SELECT id, ord, replace(text, chr(10), chr(10) || chr(10)) AS text FROM (" + POSTS + ")"
PARTS = r"string_split_regex(text, '(?:\r?\n){2,}')"


def segments(table: str, parts: str) -> str:
    return (
        f"s AS (SELECT id, ord, {parts} AS parts FROM ({table})), "
        "seg AS (SELECT id, ord, unnest(parts) AS text, unnest(range(len(parts))) AS idx FROM s), "
        "named AS (SELECT id || '#' || ord || '#' || idx AS seg_key, printf('%s_%02d', id, idx) AS label, text, id FROM seg)"
    )


PARAGRAPHS = (
    f"list_filter(list_transform({PARTS}, lambda p: array_to_string({safe('p')}, ' ')), lambda p: length(p) > 0)"
)


def abbreviations() -> str:
    def ll(p: str) -> str:
        q = f"least(greatest({p}, 1e-9), 1 - 1e-9)"
        return f"(dots * ln({q}) + (n - dots) * ln(1 - {q}))"

    return rf"""
WITH p AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+\.?')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT regexp_replace(piece, '\.$', '') AS word, count(*) AS n, CAST(sum(CASE WHEN piece LIKE '%.' THEN 1 ELSE 0 END) AS BIGINT) AS dots FROM p GROUP BY 1),
r AS (SELECT sum(dots) / sum(n) AS rate FROM w),
x AS (SELECT word, n, dots, 2 * ({ll('0.99')} - {ll('rate')}) * exp(-length(word)) * pow(length(word), -1.0 * (n - dots)) AS score
  FROM w, r WHERE dots > 0 AND length(word) <= 6)
SELECT word, n, dots, round(score, 6) AS score FROM x WHERE score >= 0.3"""


REPRESENTED = (
    f"{plain()}, docs AS (SELECT doc_id, topic, unnest({words('text')}) AS term FROM ({CLASSED})), "
    "own AS (SELECT doc_id, topic, term, count(*) AS n FROM docs GROUP BY ALL), "
    "len AS (SELECT topic, sum(score * score) AS t2 FROM scored GROUP BY topic), "
    "dots AS (SELECT doc_id, topic, sum(own.n * weight * score) AS dot, sum((own.n * weight) ^ 2) AS d2 "
    "FROM own JOIN scored USING (topic, term) GROUP BY ALL), "
    "rep AS (SELECT topic, doc_id, round(CASE WHEN d2 * t2 > 0 THEN dot / (sqrt(d2) * sqrt(t2)) ELSE 0 END, 10) AS similarity, "
    "CAST(row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank "
    f"FROM ({CLASSED}) LEFT JOIN dots USING (doc_id, topic) LEFT JOIN len USING (topic))"
)


def keybert() -> str:
    term_table = "SELECT DISTINCT term, term AS text FROM ranked"
    return (
        f"WITH {REPRESENTED}, {ranked(100)}, {static(f'SELECT doc_id, text FROM documents', 'doc_id')}, "
        f"{static(term_table, 'term', 'wv')}, "
        "centre AS (SELECT topic, dim, avg(value) AS value FROM rep JOIN emb USING (doc_id) WHERE rank <= 5 GROUP BY topic, dim), "
        "fit AS (SELECT ranked.topic, term, CASE WHEN sum(wv.value ^ 2) * sum(centre.value ^ 2) > 0 THEN "
        "sum(wv.value * centre.value) / (sqrt(sum(wv.value ^ 2)) * sqrt(sum(centre.value ^ 2))) ELSE 0 END AS score "
        "FROM ranked JOIN wv USING (term) JOIN centre ON centre.topic = ranked.topic AND centre.dim = wv.dim GROUP BY ALL) "
        "SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS INTEGER) AS rank, term, "
        "round(score, 6) AS score FROM fit QUALIFY rank <= 10"
    )


def seeded() -> str:
    rows = ", ".join(f"({i}, '{' '.join(s)}')" for i, s in enumerate(SEEDS))
    seeds = f"SELECT * FROM (VALUES {rows}) AS x(seed, text)"
    return (
        f"WITH {static('SELECT doc_id, text FROM documents', 'doc_id')}, {static(seeds, 'seed', 'sd')}, "
        "targets AS (SELECT seed, dim, value FROM sd UNION ALL SELECT 999 AS seed, dim, avg(value) FROM emb GROUP BY dim), "
        "lens AS (SELECT seed, sqrt(sum(value ^ 2)) AS len FROM targets GROUP BY seed), "
        "sims AS (SELECT doc_id, seed, sum(emb.value * targets.value) / max(len) AS s "
        "FROM emb JOIN targets USING (dim) JOIN lens USING (seed) GROUP BY doc_id, seed) "
        "SELECT doc_id, CAST(CASE WHEN seed = 999 THEN -1 ELSE seed END AS INTEGER) AS seed FROM sims "
        "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, seed) = 1"
    )


HOOKED = (
    r"WITH n AS (SELECT doc_id, len(regexp_replace(text, '[^\p{L}]', '', 'g')) AS a, len(regexp_replace(text, '[^\p{Nd}]', '', 'g')) AS b, "
    "len(text) - len(replace(text, ' ', '')) AS c FROM documents) SELECT doc_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS dim, "
    "CAST(unnest([a, b, c]) AS DOUBLE) AS value FROM n"
)


def all_sql() -> dict[str, str]:
    plain_sql = plain()
    sql = {
        "load_rename_notnull": f"SELECT id, text FROM ({POSTS})",
        "load_texts_column": "SELECT conv_id, turn, text FROM conversations",
        "first_rows": f"SELECT id, CAST(length(text) AS INTEGER) AS n FROM ({POSTS}) ORDER BY ord LIMIT 137",
        "clean_text": f"SELECT page_id, {cleaned('html')} AS text FROM pages",
        "disambiguate_ids": "SELECT CASE WHEN source = 'src0' THEN 'jobcenter_' || CAST(1 + count(*) OVER "
        "(PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) ELSE source END AS id, doc_id AS ord FROM documents",
        "split_paragraphs": "WITH s AS (SELECT id, unnest(p) AS part, unnest(range(len(p))) AS idx FROM "
        f"(SELECT id, {PARTS} AS p FROM ({PARAGRAPH_POSTS}))) SELECT printf('%s_%02d', id, idx) AS label, part FROM s",
        "split_sentences": "SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS sentence FROM "
        f"(SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "segment_paragraph": f"WITH {segments(PARAGRAPH_POSTS, PARAGRAPHS)} SELECT seg_key, label, text FROM named",
        "segment_sentence": f"WITH {segments(POSTS, safe('text'))} SELECT seg_key, label, text FROM named",
        "segment_none": f"SELECT id, text FROM ({POSTS})",
        "sensitive_flags": f"SELECT id, regexp_matches(text, '{fv.DATE}', 'i') AS date, regexp_matches(text, '{fv.PHONE}') AS phone, "
        f"regexp_matches(text, '{fv.EMAIL}') AS email, regexp_matches(text, '{fv.HOMEPAGE}', 'i') AS homepage FROM ({POSTS})",
        "drop_sensitive": f"SELECT id, len({sentences('text')}) AS sentences, len({safe('text')}) AS safe FROM ({POSTS})",
        "learn_abbreviations": abbreviations(),
        "prepare_counts": f"WITH {segments(POSTS, safe('text'))} SELECT 'posts' AS what, count(*) AS n FROM ({POSTS}) "
        "UNION ALL SELECT 'segments', count(*) FROM named",
        "stage_metrics": f"WITH chosen AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, {cleaned('text')} AS text "
        f"FROM documents WHERE lang = 'fr' AND text IS NOT NULL), {segments('SELECT * FROM chosen', safe('text'))} "
        "SELECT 'prepare' AS stage, 'posts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents WHERE text IS NOT NULL "
        "UNION ALL SELECT 'prepare', 'posts_in_language', count(*) FROM chosen UNION ALL SELECT 'prepare', 'segments', count(*) FROM named",
        "detect_languages": f"{LANG} SELECT doc_id, language FROM decided",
        "filter_language": f"{LANG} SELECT doc_id, lang, language FROM decided JOIN documents USING (doc_id) WHERE language = 'FRA'",
        "prepare_posts": f"{LANG}, chosen AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, {cleaned('text')} AS text "
        "FROM documents JOIN decided USING (doc_id) WHERE language = 'FRA'), "
        f"{segments('SELECT * FROM chosen', safe('text'))} SELECT seg_key, label, text FROM named",
        "tokens": f"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
        "remove_stopwords": f"SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT doc_id, {words('text')} AS t FROM documents)",
        "ngrams": f"WITH {grams('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL",
        "class_term_counts": f"WITH {counts()} SELECT topic, term, tf FROM counts",
        "term_totals": f"WITH {counts(1)} SELECT term, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term",
        "term_doc_freq": f"WITH {counts()} SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 10",
        "avg_class_length": f"WITH {counts(1)} SELECT CAST(floor(avg(n)) AS BIGINT) AS avg_len FROM (SELECT sum(tf) AS n FROM counts GROUP BY topic)",
        "vocab_cap": f"WITH {counts()} SELECT term, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 10000",
        "count_terms": f"WITH {counts()}, {VOCAB} SELECT topic, term, tf FROM used",
        "class_tfidf_plain": f"WITH {plain_sql} SELECT topic, term, tf, round(score, 8) AS score FROM scored",
        "class_tfidf_bm25": f"WITH {BM25} SELECT topic, term, tf, round(score, 8) AS score FROM scored",
        "rank_terms": f"WITH {BM25}, {ranked(20)} SELECT topic, rank, term, round(score, 8) AS score FROM ranked",
        "top_words_text": f"WITH {plain_sql}, {ranked(10)} SELECT topic, '# Topic ' || (topic + 1) || ': ' || string_agg(term, ', ' ORDER BY rank) AS line FROM ranked GROUP BY topic",
        "embed_static": f"WITH {static(CLASSED, 'doc_id, topic')} SELECT doc_id, dim, round(value, 6) AS value FROM emb",
        "embed_weighted": f"WITH tdf AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({toks('text')})) AS token FROM documents) GROUP BY token), "
        "idf AS (SELECT token, ln((SELECT count(*) FROM documents) / df) AS weight FROM tdf), "
        f"{static('SELECT doc_id, text FROM documents', 'doc_id', dims=32, weight='idf')} SELECT doc_id, dim, round(value, 6) AS value FROM emb",
        "embed_hook": HOOKED,
        "embed_loaded": HOOKED,
        "rescale_init": f"WITH {COORDS} SELECT vec_id, CAST(dim AS INTEGER) AS dim, "
        "round(x / (10000 * (SELECT stddev_pop(x) FROM c WHERE dim = 0)), 9) AS value FROM c",
        "reduce_none": f"WITH {COORDS} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS value FROM c",
        "knn_exact": f"WITH {knn(5)} SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM near",
        "knn_cosine": f"WITH {knn(9, True)} SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM near",
        "core_distance": f"WITH {knn(30)} SELECT vec_id, round(max(distance), 6) AS core FROM near GROUP BY vec_id",
        "align_embeddings": "SELECT doc_id, lang, 64 AS dims FROM documents",
        "align_topics": f"SELECT topic, CAST(sum(length(text)) AS BIGINT) AS chars FROM ({CLASSED}) GROUP BY topic",
        "topic_sizes": "SELECT label AS topic, count(*) AS count FROM embeddings GROUP BY label",
        "topic_count": "SELECT count(DISTINCT label) AS n_topics FROM embeddings",
        "renumber_topics": "WITH v AS (SELECT vec_id, label - 1 AS topic FROM embeddings), "
        "s AS (SELECT topic, row_number() OVER (ORDER BY count(*) DESC, topic) - 1 AS new FROM v WHERE topic <> -1 GROUP BY topic) "
        "SELECT vec_id, CAST(coalesce(new, -1) AS INTEGER) AS topic FROM v LEFT JOIN s USING (topic)",
        "topic_centroids": f"WITH {CENTRES} SELECT topic, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM cen",
        "topic_similarity_matrix": f"WITH {CENTRES} SELECT a.topic AS topic_a, b.topic AS topic_b, "
        "round(sum(a.value * b.value) / (sqrt(sum(a.value ^ 2)) * sqrt(sum(b.value ^ 2))), 6) AS similarity "
        "FROM cen a JOIN cen b USING (dim) GROUP BY ALL",
        "find_topics": f"WITH {similar(8)} SELECT topic, rank, round(similarity, 6) AS similarity FROM best_topics",
        "restrict_topics": f"WITH {similar(8)} SELECT doc_id, topic FROM ({CLASSED}) WHERE topic IN (SELECT topic FROM best_topics)",
        "topic_barchart_data": f"WITH {similar(8)}, {plain_sql}, {ranked(5)} SELECT topic, rank, term, round(score, 8) AS score "
        "FROM ranked WHERE topic IN (SELECT topic FROM best_topics)",
        "topic_probabilities": f"WITH {CENTRES}, s AS (SELECT vec_id, cen.topic, 1 + sum(x * value) / (sqrt(sum(x ^ 2)) * sqrt(sum(value ^ 2))) AS s "
        "FROM c JOIN cen USING (dim) GROUP BY vec_id, cen.topic) "
        "SELECT vec_id, topic, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS probability FROM s",
        "guide_with_seeds": seeded(),
        "representative_docs": f"WITH {REPRESENTED} SELECT topic, rank, doc_id, round(similarity, 6) AS similarity FROM rep WHERE rank <= 3",
        "rerank_keybert": keybert(),
        "topic_info": f"WITH {REPRESENTED}, {ranked(10)}, "
        "w AS (SELECT topic, string_agg(term, ', ' ORDER BY rank) AS words, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS start FROM ranked GROUP BY topic), "
        "d AS (SELECT topic, string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY rank) AS docs FROM rep WHERE rank <= 3 GROUP BY topic) "
        f"SELECT topic, count(*) AS count, any_value(topic || '_' || start) AS name, any_value(words) AS words, any_value(docs) AS docs "
        f"FROM ({CLASSED}) LEFT JOIN w USING (topic) LEFT JOIN d USING (topic) GROUP BY topic",
        "sentence_topics": "WITH "
        + segments(f"SELECT CAST({TOPIC} AS VARCHAR) AS id, doc_id AS ord, {cleaned('text')} AS text FROM documents WHERE text IS NOT NULL", safe("text"))
        + ", "
        + plain("SELECT CAST(id AS INTEGER) AS topic, text FROM named")
        + f", {ranked(10)} SELECT topic, rank, term, round(score, 8) AS score FROM ranked",
    }
    return sql
