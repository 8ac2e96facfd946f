"""The operators of this folder as queries over whole tables, and the SQL to check some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff, byte_network, collocations, factor_machine, license_scan, main_text, mixing,
    near_duplicates, norm_buckets, quality_rules, secret_spans, shared_passages, string_tiling)
from .text import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_license_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat("places.label", "detections.label")))
    places = F.col("places.word")
    score = F.greatest(F.coalesce(F.array_max("detections.score"), F.lit(0.0)),
                       F.when(F.size("places") > 0, F.lit(0.8)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"), F.concat_ws(",", every).alias("labels"),
        score.alias("score"))


@query("op2_quality_rules", r"""
    WITH t AS (SELECT doc_id, text, coalesce(text, '') AS x,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, w, x, len(w) AS n_words,
                 list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
          FROM t),
    p AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS i FROM l),
    k AS (SELECT doc_id, i, concat_ws(' ', s, lead(s) OVER o, lead(s, 2) OVER o, lead(s, 3) OVER o,
                                      lead(s, 4) OVER o) AS run, lead(s, 4) OVER o AS last
          FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM k
          WHERE last IS NOT NULL),
    r AS (SELECT doc_id, count(DISTINCT k) AS n
          FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM g WHERE c > 1) GROUP BY doc_id),
    f AS (SELECT l.doc_id, n_words, len(array_to_string(w, '')) AS word_chars,
                 len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols,
                 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 coalesce(r.n, 0) AS n_repeat_words,
                 len(regexp_extract_all(x, '[A-ZÀ-ÖØ-Þ]')) AS capitals,
                 len(list_filter(w, lambda s: contains(s, '!!'))) AS shouts,
                 len(list_filter(w, lambda s: regexp_matches(s, '[A-Za-zÀ-\x{10FFFF}]'))) AS letters
          FROM l LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
                OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                OR 100 * capitals > 30 * word_chars OR 10 * shouts > n_words
                OR 100 * letters < 70 * n_words) AS kept
    FROM b""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_cascade(table(spark, sf_dir, "documents"), counts=True)
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_network.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op4_near_duplicates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.duplicate_classes(table(spark, sf_dir, "documents"), size=4)
    return found.withColumn("kept", F.expr("doc_id <=> component_id"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.contaminated(table(spark, sf_dir, "documents"),
                                      table(spark, sf_dir, "benchmark"))


@query("op6_source_mix", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''),
                      '[^\x20\x09-\x0D]+')) AS size,
                      md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))))
                          AS h FROM documents),
    s AS (SELECT source, sum(size) AS source_size,
                 (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
          FROM d GROUP BY source),
    o AS (SELECT *, 3 * source_size AS lim, sum(source_size) OVER () AS total,
                 sum(weight) OVER () AS all_weight,
                 row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s),
    p AS (SELECT *, CAST(total - coalesce(sum(lim) OVER w, 0) AS DOUBLE)
                    / CAST(all_weight - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
          FROM o WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT coalesce(min_by(level, k), 0) AS level FROM p WHERE NOT weight * level > lim),
    t AS (SELECT source, source_size, CASE WHEN weight * v.level > lim THEN CAST(lim AS DOUBLE)
                 ELSE v.level * weight END AS target FROM p, v),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
          FROM t),
    c AS (SELECT d.source, d.doc_id, d.size, h, e.source_size, e.target, e.whole,
                 e.target - e.whole * e.source_size AS need,
                 sum(d.size) OVER (PARTITION BY d.source
                                   ORDER BY h, CAST(doc_id AS VARCHAR), d.size) AS done
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
    g AS (SELECT *, done <= need AS fits,
                 need - coalesce(max(CASE WHEN done <= need THEN done END)
                                 OVER (PARTITION BY source), 0) AS gap FROM c),
    n AS (SELECT *, row_number() OVER (
                     PARTITION BY source, NOT fits AND size > 0 AND abs(size - gap) < gap
                     ORDER BY abs(size - gap), h, CAST(doc_id AS VARCHAR), size) = 1
                 AND NOT fits AND size > 0 AND abs(size - gap) < gap AS filler FROM g)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(size * (whole + CASE WHEN need > 0 AND (fits OR filler) THEN 1 ELSE 0 END)
                AS BIGINT) AS taken
    FROM n""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("repeats")).alias("taken"))


@query("op7_backoff_scores")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factor_machine.quality_scores(table(spark, sf_dir, "documents"),
                                          table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans.secret_spans(table(spark, sf_dir, "documents"))

    def line(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s.kind != "guess")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"))


@query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op11_ranked_search", r"""
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
    c AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
    f AS (SELECT t, count(*) AS df FROM c GROUP BY t),
    s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1)))
                     AS BIGINT)
                 * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
          FROM q JOIN c USING (t) JOIN f USING (t) JOIN d USING (doc_id) CROSS JOIN g
          GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM s WHERE score > 0) WHERE rank <= 10""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_shared_passages", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
               FROM documents),
    i AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
                 w FROM d WHERE len(w) >= 50),
    h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
    f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN f USING (h)
          WHERE first < doc_id),
    g AS (SELECT doc_id, list(k) AS gone FROM r GROUP BY doc_id),
    o AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id))
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
           sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(gone, k)), ' '))
               AS kept_sha256
    FROM o""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, changed = shared_passages.without_shared_passages(table(spark, sf_dir, "documents"))
    return whole.select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"),
        F.col("digest").alias("kept_sha256")
    ).unionByName(changed.select("doc_id", "n_words", "n_removed",
                                 F.sha2(F.col("kept"), 256).alias("kept_sha256")))


@query("op13_collocations", r"""
    WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM i),
    f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
    f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
    f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
    c AS (SELECT f2.lang, w1, w2, NULL AS w3, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
          FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
          WHERE f2.f >= 10
          UNION ALL
          SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 1, x.f, y.f
          FROM f3 JOIN f1 x USING (lang, w1)
                  JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
          WHERE f3.f >= 10
          UNION ALL
          SELECT f3.lang, f3.w1, f3.w2, f3.w3, f3.f, 2, x.f, y.f
          FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2
                  JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
          WHERE f3.f >= 10),
    s AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT)
                    AS score FROM c),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3
                                                     ORDER BY score, k) = 1),
    m AS (SELECT lang, x, y, max(f) AS f FROM (
              SELECT lang, w1 AS x, w2 AS y, f FROM f3 WHERE f >= 10
              UNION ALL SELECT lang, w2, w3, f FROM f3 WHERE f >= 10) GROUP BY ALL),
    k AS (SELECT b.*, concat_ws(' ', w1, w2, w3) AS phrase
          FROM b LEFT JOIN m ON m.lang = b.lang AND m.x = b.w1 AND m.y = b.w2 AND b.w3 IS NULL
          WHERE m.f IS NULL OR 100 * m.f < 50 * b.a),
    n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
          FROM k)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
