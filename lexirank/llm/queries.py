"""The queries of this folder, by the names that the driver calls, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_rules, quality, toxicity
from .bpe import bpe_digests
from .common import held_out, read
from .exact_dedup import exact_dedup
from .jaccard_join import near_duplicates
from .mixing import mix_sources
from .substring_dedup import remove_repeats
from .warc import warc_round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    found = language.identify(docs, language.train(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_langs"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    model = quality.train(docs, read(spark, sf_dir, "labels"), ~held)
    scored = quality.apply(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return line_rules.label_lines(docs, line_rules.train(docs, read(spark, sf_dir, "labels"))).drop("labels")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def line_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts, without the labeller's verdict, so that SQL can be held against it."""
    docs = read(spark, sf_dir, "documents")
    counted = line_rules.label_lines(docs, line_rules.train(docs, read(spark, sf_dir, "labels").where("false")))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 sets out to meet, without the draws, so that SQL can be held against it."""
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_warc, op4_language, op5_quality, op6_jaccard_join, op7_bpe, op8_substring_dedup, op9_line_rules, op10_mixing, line_base_counts, mixing_targets)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op3_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha FROM t),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS winner,
                list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(sha, i, 10))::UBIGINT) AS parts FROM h)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(parts, lambda p: list_aggregate(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((p >> s) & 31)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
        FROM g""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
        s AS (SELECT DISTINCT r, array_to_string(l[i:i + 4], ' ') AS g FROM (SELECT r, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM t WHERE len(l) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
        e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        reach(a, b) AS (SELECT r, r FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
        c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN t ON t.r = b GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM t JOIN c ON c.a = t.r LEFT JOIN n USING (r)""",
    "op8_substring_dedup": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        w AS (SELECT r, i, array_to_string(l[i:i + 34], ' ') AS k FROM (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM t)),
        twice AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
        words AS (SELECT r, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM t),
        kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, len(l) AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)""",
    "line_base_counts": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
        lines AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
        dup AS (SELECT r, sum(n - 1) AS n FROM lines GROUP BY r),
        w AS (SELECT r, i, array_to_string(l[i:i + 4], ' ') AS k FROM (SELECT r, l, unnest(range(1, len(l) - 3)) AS i FROM t)),
        twice AS (SELECT r, i FROM w SEMI JOIN (SELECT r, k FROM w GROUP BY ALL HAVING count(*) > 1) USING (r, k)),
        again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
        c AS (SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: len(x))), 0)::BIGINT AS word_chars,
                len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
              FROM t LEFT JOIN dup USING (r) LEFT JOIN again USING (r))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c""",
    "mixing_targets": r"""
        WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM t GROUP BY source),
        -- each round caps the sources above three times their size, and the rest share what is left
        f(round, source, n, weight, capped) AS (
            SELECT 0, source, n, weight, false FROM s
            UNION ALL
            SELECT round + 1, source, n, weight, capped OR weight * ((sum(n) OVER ()) - (sum(CASE WHEN capped THEN 3 * n ELSE 0 END) OVER ())) / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) > 3 * n
            FROM f WHERE round < (SELECT count(*) FROM s)),
        e AS (SELECT * FROM f WHERE round = (SELECT max(round) FROM f)),
        g AS (SELECT source, n, CASE WHEN capped THEN 3.0 * n ELSE weight * ((sum(n) OVER ()) - (sum(CASE WHEN capped THEN 3 * n ELSE 0 END) OVER ())) / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM e)
        SELECT doc_id, size, n AS source_size, round(target::DOUBLE, 6) AS target FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source""",
}
