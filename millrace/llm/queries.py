"""The named queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import ann, bpe, collocations, decontam, html, lines, negatives, quality, secrets, shards, simhash, topk, toxicity
from millrace.llm.common import load


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secret_scan(spark, sf_dir):
    found = secrets.find_secrets(load(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)
    return secrets.digests(found)


def op2_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return html.main_text(load(spark, sf_dir, "pages"))


def op4_quality_classifier(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op5_kd_sharding(spark, sf_dir):
    found = shards.kd_shards(load(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark, sf_dir):
    return lines.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(load(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


def remainder(column="doc_id"):
    """crc32(doc_id as text) mod 4; rows with remainder 2 are held out from training."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


def toxicity_model(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").where(remainder() != 2)
    return toxicity.fit(load(spark, sf_dir, "documents"), labels)


def op8_toxicity(spark, sf_dir):
    scored = toxicity.score(load(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (remainder() == 2).alias("held_out"), "score", "predicted")


def op9_benchmark_decontamination(spark, sf_dir):
    return decontam.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_top_k(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = load(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_nearest(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash_near_dedup, op3_html_extraction, op4_quality_classifier, op5_kd_sharding, op6_line_dedup, op7_byte_bpe, op8_toxicity, op9_benchmark_decontamination, op10_top_k, op11_collocations, op12_hard_negatives, op13_nearest)}

#: SQL for DuckDB over the given tables.
ORACLES: dict[str, str] = {
    "op6_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM lines),
        firsts AS (SELECT *, length(line) AS n, length(line) // 3 AS third FROM ranked WHERE nth = 1 AND length(line) >= 30),
        near AS (
            SELECT DISTINCT b.line FROM firsts a JOIN firsts b
            ON b.n BETWEEN a.n - 2 AND a.n + 2 AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos))
            WHERE (contains(b.line, substr(a.line, 1, a.third)) OR contains(b.line, substr(a.line, a.third + 1, a.third)) OR contains(b.line, substr(a.line, 2 * a.third + 1)))
            AND levenshtein(a.line, b.line) <= 2),
        marked AS (
            SELECT r.doc_id, r.pos, r.line, length(r.line) >= 10 AND (r.nth > 1 OR n.line IS NOT NULL) AS gone
            FROM ranked r LEFT JOIN near n ON r.line = n.line)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY doc_id""",
    "op10_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op11_collocations": """
        WITH pieces AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang, generate_subscripts(cut, 1) AS piece, unnest(cut) AS body FROM (
                SELECT doc_id, lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS cut FROM documents)),
        words AS (SELECT lang, doc_id, piece, unnest(held) AS w, generate_subscripts(held, 1) AS pos FROM (SELECT *, list_filter(regexp_split_to_array(body, '[ \t]+'), lambda x: x <> '') AS held FROM pieces)),
        near AS (SELECT lang, w, lead(w) OVER later AS w2, lead(w, 2) OVER later AS w3 FROM words WINDOW later AS (PARTITION BY doc_id, piece ORDER BY pos)),
        totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
        f AS (
            SELECT lang, w AS phrase, 1 AS size, count(*) AS c FROM near GROUP BY lang, w
            UNION ALL SELECT lang, w || ' ' || w2, 2, count(*) FROM near WHERE w2 IS NOT NULL GROUP BY lang, w, w2
            UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3, count(*) FROM near WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3),
        candidates AS (SELECT lang, phrase, size, c AS a, string_split(phrase, ' ') AS p FROM f WHERE size > 1 AND c >= 10),
        longer AS (
            SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS part FROM candidates WHERE size = 3) GROUP BY lang, part),
        kept AS (
            SELECT c.* FROM candidates c LEFT JOIN longer o ON c.size = 2 AND o.lang = c.lang AND o.part = c.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
        cuts AS (
            SELECT *, 1 AS k, p[1] AS lp, array_to_string(p[2:], ' ') AS rp FROM kept UNION ALL SELECT *, 2, p[1] || ' ' || p[2], p[3] FROM kept WHERE size = 3),
        scored AS (
            SELECT cuts.*, x.c AS l, y.c AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(x.c AS HUGEINT) * y.c) AS BIGINT) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
            FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        mined AS (
            SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
            FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * positive_score AND 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10""",
}
