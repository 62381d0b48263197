"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, langid, merkle, mixing, pieces_bpe, quality_gam, simhash, spotsigs, substring_fm, token_counts, toxicity_crf, warc, weak_rules
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    return warc.digests(warc.read(manifest)).drop("target")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        coded = pieces_bpe.encode(table(spark, sf_dir, "documents"), f.read())
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 4)
    gam = quality_gam.train(docs, table(spark, sf_dir, "labels"), fold != 2)
    scored = quality_gam.assess(docs, gam, ["doc_id"])
    return scored.withColumn("doc_id", F.col("carried.doc_id")).select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 5)
    model = langid.fit(langid.training_rows(docs, fold != 0))
    found = langid.identify(docs, model, ["doc_id"])
    return found.withColumn("doc_id", F.col("carried.doc_id")).select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.against_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_fm.dedupe(table(spark, sf_dir, "documents"))
    return left.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("carried.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 3)
    crf = toxicity_crf.train(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = toxicity_crf.score(docs, crf, ["doc_id"])
    return scored.withColumn("doc_id", F.col("carried.doc_id")).select("doc_id", F.coalesce(fold == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before, text = [F.col(c) for c in ("doc_id", "source", "lang")], F.col("text")
    tampered = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    other = F.when(tampered, merkle.leaf(*before, F.col("n_chars").cast("decimal(20,0)") + 1, text))
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), merkle.leaf(*before, F.col("n_chars"), text).alias("leaf"), other.alias("other"))
    return merkle.proofs(leaves, path=False).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        counted = token_counts.count(table(spark, sf_dir, "documents"), f.read(), ["doc_id"])
    return counted.select("carried.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, i = F.col("label").cast("long"), F.col("vec_id")
    label = F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select(i.alias("id"), label.alias("label"), F.col("embedding").alias("vector")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_spotsigs": op6_spotsigs,
    "op7_substring": op7_substring,
    "op8_rules": op8_rules,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_token_counts": op12_token_counts,
    "op13_hard_negatives": op13_hard_negatives,
}



def _merkle_sql(levels: int = 40) -> str:
    """Level after level of both trees, each a subquery: enough for 2 ** levels documents a language, and languages."""
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ord(d)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, s: xor(xor(c, s) // 2, 3988292384::UBIGINT * (xor(c, s) % 2))), 4294967295::UBIGINT)"
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"
    leaf = lambda n: " || ".join(map(field, ("doc_id", "source", "lang", n, "text")))
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({leaf("n_chars")}) AS leaf, CASE WHEN n_chars IS NOT NULL AND ({crc}) % 7 = 0 THEN sha256({leaf("(n_chars + 1)")}) END AS other
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (
  SELECT 0 AS level, lang, pos, n, leaf AS node FROM r
  UNION ALL
  SELECT level + 1, lang, pos // 2, (n + 1) // 2, sha256(node || coalesce(after, ''))
  FROM (SELECT *, lead(node) OVER (PARTITION BY level, lang ORDER BY pos) AS after FROM t WHERE n > 1 AND level < {levels}) WHERE pos % 2 = 0),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(after, ''))
  FROM (SELECT *, lead(node) OVER (PARTITION BY level ORDER BY pos) AS after FROM u WHERE n > 1 AND level < {levels}) WHERE pos % 2 = 0),
w AS (
  SELECT r.doc_id, r.lang, r.pos AS leaf_pos, r.leaf, r.other, s.subroot, s.pos AS lang_pos, s.n AS n_langs, 0 AS step, 0 AS tree, r.pos AS pos, r.n AS n, coalesce(r.other, r.leaf) AS now, '' AS siblings
  FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT w.doc_id, w.lang, leaf_pos, leaf, other, subroot, lang_pos, n_langs,
         CASE WHEN w.n = 1 THEN 0 ELSE step + 1 END, CASE WHEN w.n = 1 THEN 1 ELSE w.tree END,
         CASE WHEN w.n = 1 THEN lang_pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN n_langs ELSE (w.n + 1) // 2 END,
         CASE WHEN w.n = 1 THEN now WHEN w.pos % 2 = 1 THEN sha256(b.node || now) ELSE sha256(now || coalesce(b.node, '')) END,
         CASE WHEN w.n = 1 THEN siblings ELSE siblings || coalesce(b.node, '') END
  FROM w LEFT JOIN (SELECT 0 AS tree, level, lang, pos, node FROM t UNION ALL SELECT 1, level, NULL, pos, node FROM u) b
    ON b.tree = w.tree AND b.level = w.step AND b.pos = xor(w.pos, 1) AND (w.tree = 1 OR b.lang IS NOT DISTINCT FROM w.lang)
  WHERE w.n > 1 OR w.tree = 0)
SELECT doc_id, leaf, subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, now AS folded_root, now = (SELECT node FROM u WHERE n = 1) AS verified
FROM w WHERE tree = 1 AND n = 1"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op1_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m""",
    "op5_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (
  SELECT *, 3 * source_size AS cap,
         coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS caps_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(source_size)::BIGINT AS total, sum(weight)::BIGINT AS weights FROM w),
l AS (SELECT r.*, (total - caps_before)::DOUBLE / (weights - weight_before)::DOUBLE AS level FROM r, t),
lv AS (SELECT level FROM l WHERE cap > level * weight ORDER BY k LIMIT 1),
p AS (
  SELECT l.source, source_size, least(3.0::DOUBLE * source_size::DOUBLE, coalesce((SELECT level FROM lv), l.level) * weight) AS target FROM l),
f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
m AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS owed,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN upto <= owed OR (upto - size < owed AND upto - owed < owed - (upto - size)) THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM m""",
    "op7_substring": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
o AS (
  SELECT d.doc_id, s.pos, array_to_string(list_slice(w, s.pos, s.pos + 19), ' ') AS win
  FROM d, unnest(range(1, greatest(len(w) - 18, 1)::BIGINT)) AS s(pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS later FROM o),
c AS (
  SELECT t.doc_id, t.pos, t.word,
         coalesce(bool_or(f.later) OVER (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM t LEFT JOIN f ON t.doc_id = f.doc_id AND t.pos = f.pos),
g AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
