"""The numbered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversations, fingerprints, language, lm, minhash, mixing, neighbours, quality, ranking, substrings, token_counts, toxicity
from .common import fold, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def fingerprint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banding and verification of operator 1 over all documents; a query of its own, so that op1_fingerprints moves each text once."""
    return fingerprints.near_documents(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "nearest", "cosines")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.coalesce(gone, F.lit(0)).alias("n_chars_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), "text", "removed", "earlier_doc_ids")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, language.learnable()))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summarize(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, fingerprint_links, op2_token_counts, op3_source_mix, op4_neighbours, op5_byte_bpe, op6_toxicity, op7_substrings, op8_quality, op9_near_duplicates, op10_language, op11_language_model, op12_ranked_search, op13_conversations)}


#: Terms as the contract of op12 has them, and its scores, in whole numbers.
OP12 = r"""
WITH term AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM term GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM size, total),
tf AS (SELECT doc_id, t, count(*) AS tf FROM term WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
score AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

#: crc32 bit by bit; then the cheapest edits up to each row, by the state that they lead to (0 none, 1 system, 2 user, 3 assistant), with the least audit of equal costs.
OP13 = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS fate
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, left(role, 1) AS i FROM damaged),
faulty AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM placed),
edit(q, e, i, q2, price) AS (
  VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
    (0, 'D', '*', 0, 4), (1, 'D', '*', 1, 4), (2, 'D', '*', 2, 4), (3, 'D', '*', 3, 4), (0, 'R', '*', 2, 3), (1, 'R', '*', 2, 3), (2, 'R', '*', 3, 3), (3, 'R', '*', 2, 3)),
insertion(q, s, q2, price) AS (
  VALUES (0, '', 0, 0), (1, '', 1, 0), (2, '', 2, 0), (3, '', 3, 0), (0, 'I', 2, 3), (1, 'I', 2, 3), (2, 'I', 3, 3), (3, 'I', 2, 3), (0, 'II', 3, 6), (1, 'II', 3, 6), (2, 'II', 2, 6), (3, 'II', 3, 6)),
new(s, role) AS (VALUES (2, 'user'), (3, 'assistant')),
best AS (
  SELECT conv_id, 0::BIGINT AS rn, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'rows': []::VARCHAR[]} AS b FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, rn, q, min(b) AS b FROM (
    SELECT best.conv_id, f.rn, e.q2 AS q,
      {'cost': b.cost + s.price + e.price + CASE WHEN e.e <> 'D' AND f.cut THEN 3 ELSE 0 END, 'audit': b.audit || s.s || e.e,
       'rows': b.rows || CASE s.s WHEN '' THEN [] WHEN 'I' THEN [CASE s.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE [CASE s.q2 WHEN 2 THEN 'assistant:' ELSE 'user:' END, CASE s.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END] END
         || CASE e.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] END} AS b
    FROM best JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.rn = best.rn + 1 JOIN insertion s ON s.q = best.q JOIN edit e ON e.q = s.q2
    WHERE (e.i = '*' OR e.i = f.i) AND (e.e = 'D' OR NOT (f.blank OR f.again))) GROUP BY ALL),
done AS (
  SELECT conv_id, min({'cost': b.cost + p, 'audit': b.audit || a, 'rows': b.rows || r}) AS b FROM best
  JOIN (SELECT conv_id, max(rn) AS rn FROM placed GROUP BY conv_id) n USING (conv_id, rn)
  JOIN (VALUES (0, 0, '', []::VARCHAR[]), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])) AS tail(q, p, a, r) USING (q) GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM g.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": OP12, "op13_conversations": OP13}
