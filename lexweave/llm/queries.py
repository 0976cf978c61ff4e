"""Queries of the ten operators, with the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, lattice, mixing, neardup, pieces, quality, quotes, sharding, topk
from .common import id_fold, table
from .pieces import piece_model


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)))
    languages, profile = langid.prototypes(docs.where("not held_out"))
    return langid.predict(docs, languages, profile, keep=("doc_id", "held_out"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = F.coalesce(id_fold("doc_id", 10) != 0, F.lit(True))
    rows = lattice.score(table(spark, sf_dir, "documents"), learns, piece_model())
    return rows.withColumn("held_out", ~F.col("learns")).drop("learns")


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         source IS NULL AS none, coalesce(source, '') AS name
  FROM documents),
salts AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) + 1 AS salts FROM d),
sized AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY none, name),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY none, name) - 1) % 3 + 1] AS weight FROM sized),
levels AS (
  SELECT *, 3 * source_size / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY 3 * source_size / weight, none, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT first(level ORDER BY ratio, none, name) AS level FROM levels WHERE level * weight <= 3 * source_size),
targets AS (SELECT none, name, source_size, least(CAST(3 * source_size AS DOUBLE), chosen.level * weight) AS target FROM levels, chosen),
ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('7:' || CAST(d.none AS VARCHAR) || ':' || d.name), 1, 4) AS BIGINT) / 65536.0 AS shift,
         row_number() OVER (PARTITION BY d.none, d.name ORDER BY d.size,
           CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % salts.salts, d.doc_id) - 1 AS rank
  FROM d JOIN targets t ON t.none = d.none AND t.name = d.name, salts)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN least(3, floor(rate * (rank + 1) + shift) - floor(rate * rank + shift)) ELSE 0 END AS BIGINT) * size AS taken
FROM ranked
"""


def op5_spherical_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


EMBEDDING_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM valid),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
component AS (SELECT node AS vec_id, min(root) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM component c LEFT JOIN counted n ON n.vec_id = c.vec_id
"""


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


TOPK_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op6_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"), threshold=0.8)


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_sha256"))


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2)
    scored = quality.score(docs, quality.fit(docs.where("not held_out"), labels), keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


QUOTES_SQL = r"""
WITH RECURSIVE message AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {
           'level': length(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')),
           'content': regexp_replace(x, '^[ \t]*(>[ \t]*)+', '')}) AS lines
  FROM conversations),
leveled AS (
  SELECT conv_id, turn, lines, unnest(list_distinct(list_transform(lines, lambda x: x.level))) AS level
  FROM message WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
single AS (
  SELECT conv_id, turn, level, list_transform(lines, lambda x: CASE WHEN x.level = level THEN x.content ELSE '' END) AS one
  FROM leveled),
unit AS (
  SELECT DISTINCT conv_id, turn, level, passage FROM (
    SELECT conv_id, turn, level, lower(trim(regexp_replace(piece, '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS passage
    FROM (SELECT conv_id, turn, level, unnest(list_concat(
            regexp_split_to_array(array_to_string(one, chr(10)), '\n[ \t\r\f\x0b]*\n'), one)) AS piece FROM single))
  WHERE passage <> ''),
link AS (
  SELECT q.conv_id, q.turn, q.level, q.passage, max(o.turn) AS source, length(q.passage) AS chars
  FROM unit q JOIN unit o ON o.conv_id = q.conv_id AND o.passage = q.passage AND o.level = 0 AND o.turn < q.turn
  WHERE q.level > 0 GROUP BY ALL),
linked AS (SELECT conv_id, turn, count(*) AS n_linked, min(level) AS level FROM link GROUP BY ALL),
weight AS (
  SELECT l.conv_id, l.turn, l.source, sum(l.chars) AS chars
  FROM link l JOIN linked k ON k.conv_id = l.conv_id AND k.turn = l.turn AND k.level = l.level GROUP BY ALL),
parent AS (
  SELECT conv_id, turn, source AS parent FROM weight
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY chars DESC, source DESC) = 1),
walk(conv_id, turn, top) AS (
  SELECT conv_id, turn, parent FROM parent
  UNION ALL
  SELECT w.conv_id, w.turn, p.parent FROM walk w JOIN parent p ON p.conv_id = w.conv_id AND p.turn = w.top),
root AS (SELECT conv_id, turn, min(top) AS root FROM walk GROUP BY ALL),
whole AS (
  SELECT m.conv_id, m.turn, m.role, m.text, m.lines, p.parent, coalesce(r.root, m.turn) AS root, coalesce(k.n_linked, 0) AS n_linked
  FROM message m LEFT JOIN parent p USING (conv_id, turn) LEFT JOIN root r USING (conv_id, turn) LEFT JOIN linked k USING (conv_id, turn))
SELECT conv_id, turn, role,
       CASE WHEN len(list_filter(lines, lambda x: x.level > 0)) > 0
            THEN regexp_replace(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.content), chr(10)), '^[\n\r]+|[\n\r]+$', '', 'g')
            ELSE text END AS text,
       CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL
            THEN row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY root, turn, role, text) - 1 END AS position,
       parent AS parent_turn, root AS root_turn,
       CAST(list_max(list_transform(lines, lambda x: x.level)) AS INTEGER) AS quote_depth,
       len(list_filter(lines, lambda x: x.level > 0)) AS n_quoted, n_linked
FROM whole
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_hyperdimensional_langid, op3_subword_lattice, op4_systematic_mix, op5_spherical_kmeans_dedup, op6_bagminhash_dedup, op7_piece_codec, op8_ball_tree_topk, op9_line_crf_quality, op10_quotation_linking)}


def oracle_sql() -> dict[str, str]:
    return {"op4_systematic_mix": MIX_SQL, "op5_spherical_kmeans_dedup": EMBEDDING_SQL, "op8_ball_tree_topk": TOPK_SQL, "op10_quotation_linking": QUOTES_SQL}
