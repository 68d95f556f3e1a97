"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, linerules, mixing, neardup, quality, ranking, spelling, tokencount, toxicity, urlfilter, warc
from .common import bucket_of_id, table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(verdict, host, path)")
    return urlfilter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
won AS (
  SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN won USING (rid)
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket_of_id(F.col("doc_id"), 4) == 2
    return langid.language_of(docs.select("doc_id", "text"), docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP4_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT rid, p, h.n, item_id FROM (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM places) h JOIN windows USING (n, k)),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train_rows=bucket_of_id(F.col("doc_id"), 5) != 0)
    held_out = bucket_of_id(F.col("doc_id"), 5) == 0
    return toxicity.score(docs, spark.sparkContext.broadcast(model)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held_out = bucket_of_id(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), metadata=("n_chars",), train_rows=~held_out)
    return quality.score(docs, spark.sparkContext.broadcast(model), metadata=("n_chars",)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


MIX_TARGETS = {"source": 0.5, "lang": 0.5, "topic": 0.8}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.word_count(F.col("text")).alias("n_tokens"))
    return mixing.mix(counted, MIX_TARGETS, tokens="n_tokens", detail=True).withColumn("probability", F.round("probability", 6))


def op7_sql(rounds: int = 24, keep: float = 0.5, steps: int = 8) -> str:
    """The same fitting, unrolled: ``rounds`` times over the margins (they are met to 1e-10 by then; the operator goes on until they are), then ``steps`` of sharing out what full cells leave."""
    steps_sql, last = [], "start"
    for i in range(rounds):
        for d in MIX_TARGETS:
            name = f"fit_{i}_{d}"
            steps_sql.append(f"{name} AS (SELECT * REPLACE (weight * share_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    rates = [f"rate_0 AS (SELECT {keep} * sum(tokens) / sum(weight) AS f FROM {last})"]
    for i in range(steps):
        rates.append(
            f"rate_{i + 1} AS (SELECT greatest(f, coalesce((SELECT ({keep} * sum(tokens) - coalesce(sum(tokens) FILTER (weight * f >= tokens), 0)) / sum(weight) FILTER (weight * f < tokens) FROM {last}), f)) AS f FROM rate_{i})"
        )
    margins = [f"m_{d} AS (SELECT {d}, n ** {t} / sum(n ** {t}) OVER () AS share_{d} FROM (SELECT {d}, sum(tokens)::DOUBLE AS n FROM cells GROUP BY 1))" for d, t in MIX_TARGETS.items()]
    joins = " ".join(f"JOIN m_{d} USING ({d})" for d in MIX_TARGETS)
    return f"""
WITH docs AS (
  SELECT doc_id, source, lang,
         CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '!!') THEN 'notice' WHEN contains(t, '***') OR contains(t, '%%%') OR contains(t, '&&&') THEN 'marked' ELSE 'prose' END AS topic,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
{", ".join(margins)},
start AS (SELECT *, tokens::DOUBLE AS weight FROM cells {joins}),
{", ".join(steps_sql)},
{", ".join(rates)}
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability
FROM (SELECT d.*, least(1.0, weight * f / tokens) AS p FROM docs d JOIN {last} USING (source, lang, topic), rate_{steps})
WHERE ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 < p
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linerules.line_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_kept")


OP8_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
grams AS (SELECT rid, p, w[p] || chr(10) || w[p + 1] || chr(10) || w[p + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM docs)),
twice AS (SELECT rid, p FROM grams QUALIFY count(*) OVER (PARTITION BY rid, k) >= 2),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY rid),
base AS (
  SELECT rid, doc_id, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM docs LEFT JOIN covered USING (rid)),
judged AS (
  SELECT *, list_filter(l, lambda x: NOT (length(x) > 400 AND NOT regexp_matches(x, '[@SENTENCE@UNMARKED]'))
    AND NOT (length(x) <= 200 AND regexp_matches(x, '\\b(?:[Cc]ookie|[Pp]rivacy [Pp]olicy|[Tt]erms of (?:[Uu]se|[Ss]ervice)|[Aa]ll [Rr]ights [Rr]eserved|[Cc]opyright|[Jj]ava[Ss]cript|[Ss]ubscribe|[Nn]ewsletter|[Ss]ign (?:in|up)\\b|[Ll]og ?in\\b|[Rr]ead more|[Cc]lick here|[Ll]orem ipsum|[Ss]hare this|[Ff]ollow us|[Aa]dd to cart)'))
    AND len(regexp_extract_all(x, '[|\\x{bb}\\x{203a}\\x{2022}]')) <= 3
    AND (len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) > 3 OR len(regexp_extract_all(x, '[@SPACELESS]')) > 12 OR regexp_matches(x, '[@SENTENCE@CLOSING][\\x20\\x09-\\x0D]*$'))) AS k FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (len(k) < len(l) AND length(regexp_replace(array_to_string(k, chr(10)), '[\\x20\\x09-\\x0D]+', '', 'g')) < 0.5 * word_chars) AS kept,
       len(l)::BIGINT AS n_lines, len(k)::BIGINT AS n_lines_kept
FROM judged
"""


for _name in ("SENTENCE", "UNMARKED", "SPACELESS", "CLOSING"):
    OP8_SQL = OP8_SQL.replace(f"@{_name}", getattr(linerules, _name).replace("'", "''"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


OP9_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +') AS w0 FROM documents),
words AS (SELECT doc_id, list_filter(w0, lambda x: x <> '') AS w FROM docs),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE 100 * c >= 75 * (s.n + t.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    read, _ = warc.read_archives(spark, archives)
    return read.select(F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP11_SQL = """
WITH sized AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM firsts
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slips=199))


OP12_SQL = """
WITH RECURSIVE steps(byte, crc, i) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END, i + 1 FROM steps WHERE i < 8),
crcs AS (SELECT list(crc ORDER BY byte) AS crc_of FROM steps WHERE i = 8),
runs AS (
  SELECT k, w, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, 'null') AS k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY ALL),
coded AS (
  SELECT k, w, n, list_transform(range(0, octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::INT) AS bytes
  FROM (SELECT *, encode(k || ':' || w) AS b FROM runs)),
hashed AS (SELECT k, w, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc_of[(xor(c, x::UBIGINT) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM coded, crcs),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
links AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, less.n, rest, words.n FROM less JOIN (SELECT word AS rest, n FROM words) words USING (rest)
  UNION SELECT rest, words.n, word, less.n FROM less JOIN (SELECT word AS rest, n FROM words) words USING (rest)),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM links GROUP BY 1),
judged AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow(word, root) AS (SELECT word, word FROM judged UNION ALL SELECT follow.word, form FROM follow JOIN judged ON follow.root = judged.word WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n
FROM judged JOIN (SELECT follow.word, follow.root FROM follow JOIN judged ON follow.root = judged.word WHERE form IS NULL) roots USING (word)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    found = ranking.search(ranking.build_index(table(spark, sf_dir, "documents"), items), items)
    return found.select(F.col("key").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP13_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
  FROM benchmark),
whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS length FROM docs WHERE len(w) > 0),
asked AS (SELECT q, item_id, t, count(*) AS times FROM items GROUP BY ALL),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, whole GROUP BY t, n_docs),
impacts AS (SELECT rid, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // length)) AS impact FROM tf JOIN docs USING (rid), whole),
scores AS (SELECT q, item_id, rid, sum(times * weight * impact)::BIGINT AS score FROM asked JOIN weights USING (t) JOIN impacts USING (t) GROUP BY ALL HAVING sum(times * weight * impact) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores JOIN docs USING (rid)) WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_url_filters, op2_html_extraction, op3_language_id, op4_decontamination, op5_toxicity,
            op6_quality, op7_mixing, op8_quality_rules, op9_near_duplicates, op10_token_counts,
            op11_warc, op12_spelling_variants, op13_ranked_search,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op4_decontamination": OP4_SQL, "op7_mixing": op7_sql(), "op8_quality_rules": OP8_SQL, "op9_near_duplicates": OP9_SQL, "op11_warc": OP11_SQL,
            "op12_spelling_variants": OP12_SQL, "op13_ranked_search": OP13_SQL}
