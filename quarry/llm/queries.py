"""Thin queries over the training-data operators, one for each, at production parameters over whole tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, exact_dedup, html_text, language, ngram_join, packing, periodic, prefix_trie, quality, secrets, token_counts, warc
from quarry.llm.base import table, written

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def listed(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    index = warc.read_index(warc.normalise(archives))
    return warc.read_records(index, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECES).select("doc_id", "n_tokens", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.numbered(table(spark, sf_dir, "conversations")), "numbered")
    own = F.col("conv_id")
    heads = F.crc32(own.cast("string").cast("binary")) % 6
    return prefix_trie.build(*prefix_trie.grafted(turns, heads, 5, own - own % 100))


def planted(words: list[bytes], h: float | None) -> list[bytes]:
    """The contract's words of a document: those from a on repeat with period p where its id's checksum h ends in 0."""
    n = len(words)
    if not n or h is None or h != h or h % 10:
        return words
    g = int(h) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_digest(runs: list[tuple[int, int, int]], collapsed: bytes) -> tuple:
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.detect(docs, columns, run_digest, planted, with_col=checksum).drop("text")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", F.coalesce(language.held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    own = (
        op1_secrets, op2_ann, op3_html, op4_bpe, op5_ngram_join, op6_quality, op7_warc, op8_exact_dedup, op9_token_counts, op10_packing,
        op11_prefix_trie, op12_periodic, op13_language,
    )
    return {f.__name__: f for f in own}


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP1_SQL = """
WITH rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 18), ('hex', 2, '[0-9a-f]+', 0, 16)),
m AS (SELECT doc_id, kind, rank, least,
    CASE rank WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS found,
    CASE rank WHEN 0 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)
      WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS judged,
    CASE rank WHEN 0 THEN regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(t, '[0-9a-f]+') END AS pieces
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules),
e AS (SELECT doc_id, kind, rank, least, unnest(range(1, len(found) + 1)) AS i, found, judged, pieces FROM m),
s AS (SELECT doc_id, kind, rank, i, length(judged[i]) AS n, least,
    list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS a,
    length(found[i]) AS w FROM e),
k AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + w AS BIGINT), ',' ORDER BY a, rank) AS spans FROM s WHERE n >= least GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN k USING (doc_id)
"""

#: Exact overlaps of all pairs that share a shingle, then components by propagation of the smallest id.
OP5_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n_shingles + nb.n_shingles - shared)),
r AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM n LEFT JOIN m USING (doc_id)"""

#: The base-32 digits of a SHA-1 from eight groups of twenty bits.
OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) % 32 + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM c"""


#: Nodes are prefixes of concatenated turn ids of 32 digits; CRC-32 is worked out bit by bit.
OP11_SQL = """WITH t AS (SELECT conv_id, length(x) AS n, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM (
  SELECT conv_id, turn, coalesce(text, '') AS x, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS id FROM conversations WHERE conv_id IS NOT NULL)),
l AS (SELECT conv_id, list(id ORDER BY pos) AS ids, list(n ORDER BY pos) AS ns,
  CAST(xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS BIGINT) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT l.conv_id, list_concat(coalesce(b.ids, [])[1:l.h], l.ids[l.h + 1:]) AS ids, list_concat(coalesce(b.ns, [])[1:l.h], l.ns[l.h + 1:]) AS ns FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 100),
m AS (SELECT conv_id, len(ids) AS size, array_to_string(ids, '') AS whole, ns, unnest(range(0, len(ids) + 1)) AS depth FROM r),
p AS (SELECT *, substr(whole, 1, CAST(32 * depth AS INTEGER)) AS node FROM m),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * any_value(ns[depth]) END AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM p GROUP BY node, depth),
c AS (SELECT substr(node, 1, CAST(32 * (depth - 1) AS INTEGER)) AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.node = n.node AND c.depth = n.depth),
a AS (SELECT substr(node, 1, CAST(32 * d AS INTEGER)) AS node, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT node, own, n_children, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN a ON a.node = f.node LEFT JOIN n u ON f.depth > 0 AND u.depth = f.depth - 1 AND u.node = substr(f.node, 1, CAST(32 * (f.depth - 1) AS INTEGER))"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": OP11_SQL, "op1_secrets": OP1_SQL, "op5_ngram_join": OP5_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL}
