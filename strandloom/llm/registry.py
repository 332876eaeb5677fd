"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, language_id, license_scan, mixing, packing, quality, simhash, syncmers, toxicity, url_filter
from strandloom.plans.runtime import table

VOCABULARY = "word_bpe_49k.json"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, radius=3)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.url_filter(pages, rules, url_filter.page_edges(pages))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, end_id=1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.get("position", F.lit(0)).asc_nulls_last(), "doc_id")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.document_fingerprints(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_url_filter, op3_packing, op4_mixing, op5_syncmers, op6_exact_dedup, op7_language_id, op8_toxicity, op9_quality, op10_license_scan)}


OP6_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


OP2_SQL = r"""
WITH RECURSIVE
raw(page_id, url, html) AS (SELECT page_id, url, html FROM pages),
tags AS (
    SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag FROM raw WHERE url IS NOT NULL
    UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')) FROM raw WHERE url IS NOT NULL),
aims AS (SELECT src, replace(CASE WHEN starts_with(lower(tag), '<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS aim FROM tags),
paths AS (
    SELECT src, aim, CASE WHEN starts_with(aim, '/') THEN aim ELSE coalesce(nullif(regexp_extract(src, '(?s)^.*?://[^/?#]*([^?#]*/)?', 1), ''), '/') || aim END AS path FROM aims WHERE aim <> ''),
cuts AS (SELECT src, aim, string_split(substr(regexp_extract(path, '(?s)^([^?#]*)', 1), 2), '/') AS parts, regexp_extract(path, '(?s)^[^?#]*(.*)$', 1) AS rest FROM paths),
folds AS (SELECT src, aim, rest, parts, list_reduce(list_transform(parts, lambda s: [s]), lambda a, s: CASE WHEN s[1] = '.' THEN a WHEN s[1] = '..' THEN a[:-2] ELSE list_concat(a, s) END, CAST([] AS VARCHAR[])) AS kept FROM cuts),
edges AS (
    SELECT src, CASE WHEN contains(aim, '://') THEN aim WHEN starts_with(aim, '//') THEN regexp_extract(src, '(?s)^(.*?:)//', 1) || aim WHEN starts_with(aim, '?') THEN regexp_extract(src, '(?s)^([^?#]*)', 1) || aim WHEN starts_with(aim, '#') THEN src
        ELSE regexp_extract(src, '(?s)^(.*?://[^/?#]*)', 1) || '/' || array_to_string(kept, '/') || CASE WHEN parts[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END || rest END AS dst
    FROM folds),
urls AS (SELECT DISTINCT url FROM raw UNION SELECT src FROM edges UNION SELECT dst FROM edges),
rests AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls),
parts AS (
    SELECT url, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM rests),
rules(place, starts, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
own AS (
    SELECT p.url, arg_max(r.place || r.starts, length(r.place || r.starts)) AS rule, arg_max(r.verdict, length(r.place || r.starts)) AS own
    FROM parts p JOIN rules r ON (p.host = r.place OR ends_with(p.host, '.' || r.place)) AND starts_with(p.path, r.starts) GROUP BY p.url),
nodes AS (SELECT p.url, p.host || ' ' || p.path || ' ' || p.query AS node FROM parts p WHERE p.url IS NOT NULL),
steps AS (
    SELECT a.node AS u, b.node AS v FROM edges e JOIN nodes a ON a.url = e.src JOIN nodes b ON b.url = e.dst
    UNION SELECT b.node, a.node FROM edges e JOIN nodes a ON a.url = e.src JOIN nodes b ON b.url = e.dst),
reach(u, v) AS (SELECT DISTINCT n.node, n.node FROM nodes n JOIN own o USING (url) WHERE o.own = 'block' UNION SELECT r.u, s.v FROM reach r JOIN steps s ON s.u = r.v),
bad AS (SELECT DISTINCT v FROM reach)
SELECT w.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, o.rule, coalesce(o.own, CASE WHEN b.v IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM raw w LEFT JOIN parts p ON p.url = w.url LEFT JOIN own o ON o.url = w.url LEFT JOIN nodes n ON n.url = w.url LEFT JOIN bad b ON b.v = n.node
"""


def _place(share: str, weight: str) -> str:
    """SQL of the inverted cumulative demand, from the schedules."""

    def one(knots: list[tuple[float, float]]) -> str:
        parts = [(a[0], a[1], b[1], b[0] - a[0], (a[1] + b[1]) / 2 * (b[0] - a[0])) for a, b in zip(knots, knots[1:], strict=False)]
        whole, before, out = sum(p[4] for p in parts), 0.0, ""
        for t, lo, hi, width, area in parts:
            y = f"(({share}) * {whole!r}::DOUBLE - {before!r}::DOUBLE)"
            at = f"({t!r}::DOUBLE + 2.0::DOUBLE * {y} / ({lo!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {lo * lo!r}::DOUBLE + {2 * (hi - lo) / width!r}::DOUBLE * {y}))))"
            out = at if not out else f"CASE WHEN ({share}) * {whole!r}::DOUBLE < {before!r}::DOUBLE THEN {out} ELSE {at} END"
            before += area
        return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {out}))"

    return f"CASE {weight} " + " ".join(f"WHEN {w} THEN {one(k)}" for w, k in mixing.SCHEDULES.items()) + " END"


OP4_SQL = rf"""
WITH d AS (
    SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':' || CAST(size AS VARCHAR)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, coalesce(sum(source_size * 3) OVER u, 0) AS capped, coalesce(sum(weight) OVER u, 0) AS light, sum(source_size) OVER () AS total, sum(weight) OVER () AS heavy
    FROM w WINDOW u AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(capped) AS capped, min(light) AS light FROM o WHERE source_size * 3 >= (CAST(total - capped AS DOUBLE) / CAST(heavy - light AS DOUBLE)) * weight),
t AS (SELECT o.source, o.source_size, o.weight, least(CAST(o.source_size * 3 AS DOUBLE), o.weight * CAST(o.total - f.capped AS DOUBLE) / CAST(o.heavy - f.light AS DOUBLE)) AS target FROM o, f),
p AS (SELECT k.doc_id, k.size, t.source_size, t.weight, t.target, CAST(floor(t.target) AS BIGINT) AS goal, CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM p),
g AS (SELECT *, greatest(0, least(size, goal - whole * source_size - place)) AS part FROM e)
SELECT doc_id, size, source_size, target, CAST(whole * size + part AS BIGINT) AS taken,
    CASE WHEN whole * size + part > 0 THEN list_transform(range(0, whole + CASE WHEN part > 0 THEN 1 ELSE 0 END), lambda c: {_place("CAST(c * source_size + place AS DOUBLE) / target", "weight")}) ELSE [] END AS position
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_mixing": OP4_SQL, "op6_exact_dedup": OP6_SQL}
