"""The registered queries of this package: each operator over its whole table.

``QUERIES`` maps names to functions of (spark, folder); ``ORACLE_SQL`` holds
DuckDB statements for those SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import (credentials, decontaminate, linededup, mixing, onebit, pii, quality,
                         simhash, spelling, tokens, toxicity, warc, whitening)
from mercato.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), min_revisit=1_000).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"), window=10, near=16)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op5_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return onebit.search(rows, rows.where("vec_id % 100 = 0"), k=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           mod=3, held=1)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             mod=5, held=0).drop("text_hash")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"), min_length=6, min_count=5,
                                   ratio=5)


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_decontaminate, op3_personal_data, op4_token_planes, op5_one_bit_codes, op6_quality,
    op7_mixing, op8_toxicity, op9_line_dedup, op10_simhash, op11_secrets, op12_whitening,
    op13_spelling)}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH page AS (
            SELECT page_id, url, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n
            FROM pages),
        keeper AS (SELECT body, max(page_id) AS keep FROM page WHERE n >= 1000 GROUP BY body)
        SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND keep <> page_id THEN keep END AS refers_to
        FROM page LEFT JOIN keeper USING (body)""",
    "op9_line_dedup": """
        WITH line AS (
            SELECT doc_id, d.text, unnest(string_split(coalesce(d.text, ''), chr(10))) AS txt,
                   generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos
            FROM documents d),
        keyed AS (
            SELECT doc_id, pos, txt,
                   translate(trim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM line),
        first_doc AS (
            SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        marked AS (
            SELECT keyed.*, (owner IS NOT NULL AND owner <> doc_id) AS gone
            FROM keyed LEFT JOIN first_doc USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(txt, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
                   AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op13_spelling": """
        WITH RECURSIVE code AS (
            SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                        lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                        ORDER BY i) AS t
            FROM range(256) r(i)),
        run AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
            FROM documents),
        own AS (SELECT doc_id, r, count(*) AS k FROM run GROUP BY ALL),
        hashed AS (
            SELECT r, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
                       string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda c:
                       CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))),
                       lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1]))) AS h
            FROM own, code),
        slipped AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT)
                                              || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k
            FROM hashed),
        words AS (
            SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE length(word) >= 6
            GROUP BY word HAVING sum(k) >= 5),
        cut AS (
            SELECT word, n, length(word) AS m, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pair AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b
                ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
        best AS (
            SELECT word, count(*) AS n_near, max(n) AS most,
                   min(other) FILTER (WHERE n = top) AS other
            FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM pair) GROUP BY word),
        linked AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN most >= 5 * w.n THEN other END AS form,
                   CASE WHEN most >= 5 * w.n THEN most END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS spot, 0 AS step FROM linked
            UNION ALL
            SELECT c.word, l.form, step + 1 FROM chain c JOIN linked l ON l.word = c.spot
            WHERE l.form IS NOT NULL)
        SELECT l.word, form, arg_max(spot, step) AS root, n, n_near, form_n
        FROM linked l JOIN chain c ON c.word = l.word
        GROUP BY l.word, form, n, n_near, form_n""",
}
