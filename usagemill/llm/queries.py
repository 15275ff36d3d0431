"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, mixing, near_dup, nearest, phrases, pii, quality, sharding, spelling, token_counts, toxicity, url_filter, warc

URL_RULES = [
    url_filter.Rule.parse("allow", "org/"),
    url_filter.Rule.parse("block", "example.org/es/"),
    url_filter.Rule.parse("block", "example.org/en/1"),
    url_filter.Rule.parse("allow", "com/fr/"),
    url_filter.Rule.parse("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = pii.find_personal_data(documents, pii.fit_redactor(documents))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.hilbert_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"))
    return quality.judge_quality(documents, model)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit_models(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", (toxicity.part_of(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted", "log_ratio")


def op8_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.similar_documents(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_url_filter, op3_pii, op4_token_counts, op5_sharding, op6_quality, op7_toxicity, op8_similar_documents, op9_decontamination, op10_mixing, op11_phrase_collocations, op12_spelling_variants, op13_nearest_neighbours)
}

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(d, {5 * g + 1}, 5)) AS BIGINT) >> {5 * (3 - i)}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8)
    for i in range(4)
)

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM r""",
    "op2_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, r_host, r_path) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
        FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fit ON p.page_id = fit.page_id""",
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIXED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL["op9_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_FIXED}) AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_FIXED}) AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, UNNEST(generate_series(1, len(w) - n + 1)) AS i FROM b)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, UNNEST(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT DISTINCT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, UNNEST(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)"""

ORACLE_SQL["op8_similar_documents"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, UNNEST(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS links, min(CASE WHEN same THEN b END) AS copy FROM l GROUP BY a)
SELECT g.doc_id, coalesce(least(g.doc_id, copy), g.doc_id) AS copy_of, class_id, coalesce(links, 0) AS n_links FROM g LEFT JOIN k ON g.doc_id = k.doc_id"""

ORACLE_SQL["op11_phrase_collocations"] = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, UNNEST(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w, UNNEST(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM o, (SELECT UNNEST([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, UNNEST(generate_series(1, size - 1)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.size], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM s) WHERE j = 1),
i AS (SELECT lang, array_to_string(w[b:b + z - 1], ' ') AS phrase, f FROM (SELECT lang, f, size, w, z, UNNEST(generate_series(1, size - z + 1)) AS b
  FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w, UNNEST(generate_series(2, size - 1)) AS z FROM f WHERE size > 2))),
d AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY lang, phrase),
t AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN d ON d.lang = m.lang AND d.phrase = m.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""

#: crc32 of the Latin-1 code points of an id and a run: one step for each UTF-8 byte, by the table made from its polynomial.
ORACLE_SQL["op12_spelling_variants"] = r"""
WITH RECURSIVE t AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) AS x FROM (SELECT UNNEST(generate_series(CAST(0 AS BIGINT), 255)) AS i))),
u AS (SELECT doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM u WHERE length(run) >= 6 GROUP BY doc_id, run),
b AS (SELECT run, n, list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(concat(CAST(doc_id AS VARCHAR), ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))) AS b FROM r),
h AS (SELECT run, n, xor(list_reduce(b, lambda a, c: xor(a >> 8, t[1 + (xor(a, c) & 255)])), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) + 2 AS BIGINT))) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, UNNEST(generate_series(1, length(word))) AS i FROM v)),
p AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
g AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS j, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM g WHERE j = 1) k ON k.word = v.word),
s(word, top, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.top WHERE f.form IS NOT NULL)
SELECT f.word, form, s.top AS root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(top, step) AS top FROM s GROUP BY word) s ON s.word = f.word"""

ORACLE_SQL["op13_nearest_neighbours"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
c AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id != v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM c)
SELECT * FROM r WHERE rank <= 5"""
