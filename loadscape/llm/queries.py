"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.llm import chat, decontam, fillmiddle, langid, linededup, mixing, piecebpe, quality, sharding, simhash, toxicity, urlfilter, vectorcodes
from loadscape.llm.scratch import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [urlfilter.Rule(*r) for r in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))]
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text, and of one made of control strings."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(turns))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, severity_grade, toxic_flag of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model).select("doc_id", "expected_severity", "severity_grade", "toxic_flag")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept, of every document."""
    docs = linededup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes, of every document."""
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("words"))
    docs = mixing.assign_copies(Scratch(spark, "sizes").table(sized), size_col="words")
    taken = F.col("_llm_size") * F.col("_llm_copies")
    return docs.select("doc_id", F.col("_llm_size").alias("size"), F.col("_llm_source_size").alias("source_size"), F.col("_llm_target").alias("target"), taken.alias("taken"))


def held_out(doc_id: Column) -> Column:
    """Rows that language identification never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.fit(docs, VOCABULARY, ~F.col("held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = sharding.assign_shards(sharding.assign_shards(docs), shards=sharding.SHARDS + 1, shard_col="grown_shard")
    text = F.col("text").cast("binary")
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "grown_shard")
    return sharding.number_within(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", Scratch(spark, "sharding"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(docs, quality.fit(docs, trusted)).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and overlaps of every document that holds a benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, _table(spark, sf_dir, "benchmark"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, of every document."""
    vocabulary = piecebpe.load(VOCABULARY)
    docs = piecebpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    docs = piecebpe.decode(docs, vocabulary)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vectorcodes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of output and restored text, of every document."""
    docs = fillmiddle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fillmiddle.restored(F.col("form"), F.col("output"))
    digests = [F.sha2(x.cast("binary"), 256).alias(c) for c, x in (("output_sha256", F.col("output")), ("restored_sha256", restored))]
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_toxicity, op3_url_filter, op4_line_dedup, op5_mixing, op6_langid, op7_sharding, op8_simhash, op9_quality, op10_decontamination,
        op11_sentencepiece, op12_vector_codes, op13_fill_middle,
    )
}


def _codes_sql(rounds: int = 4) -> str:
    """Codebooks round by round, each one table of (part, entry, components)."""
    square = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    sql = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, whole[len(whole) * p // 4 + 1 : len(whole) * (p + 1) // 4] AS v FROM kept, range(4) AS r(p)),
book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),"""
    for r in range(rounds + 1):
        sql += f"""
near{r} AS MATERIALIZED (SELECT vec_id, p, min({square} * 256 + e) AS best FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p),"""
        if r < rounds:
            sql += f"""
mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best % 256 AS e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM parts JOIN near{r} USING (vec_id, p), unnest(range(1, len(v) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e)),"""
    return sql + f"""
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(best % 256 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM near{rounds} JOIN kept USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books"""


ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</turn>')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + n + 8
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#+'), lambda r: greatest(length(r) - 2, 0))), 0)) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op3_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN best USING (page_id)""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, k, line, shared.key IS NOT NULL AND doc_id <> keep AS dropped FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op5_mixing": r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source) AS k FROM weighed),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM ranked),
level AS (SELECT level AS l FROM levels WHERE w * level <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN w * l > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE w * l END AS target FROM weighed, level),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0), 0) AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM rated""",
    "op12_vector_codes": _codes_sql(),
    "op13_fill_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
seeded AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM seeded),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts""",
}
