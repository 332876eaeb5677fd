"""URL allow and block rules with redirect equivalence.

A url's own longest fitting rule decides first. Urls without one get the decision of their component in the
graph of redirect and canonical-link edges: blocked if any alias there is blocked. An explicit allow rule
of the url itself always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.plans.runtime import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and query of what follows the first ``://``; null or none: all empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    part = lambda pattern: F.regexp_extract(rest, pattern, 1)
    return {"host": F.translate(part(r"(?s)^([^/?#]*)"), _UPPER, _LOWER), "path": part(r"(?s)^[^/?#]*([^?#]*)"), "query": part(r"(?s)^[^?#]*(\?[^#]*)")}


def with_rule(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``urls`` (key, host, path) and the longest fitting rule of each: ``rule`` and ``own`` verdict, else null.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's. Of
    rules of one length and text, allow wins. Hosts are cut into their suffixes once, so that rules of any
    number meet by an equi-join; pages are pre-reduced to distinct (host, path).
    """
    places = urls.select("host", "path").distinct()
    named = rules.select(F.col("host").alias("at"), F.col("path").alias("starts"), "verdict")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = places.withColumn("at", F.explode(suffixes)).join(named, "at").where(F.col("path").startswith(F.col("starts")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(F.concat("at", "starts")).alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("at", "starts").alias("rule"), "verdict")).alias("b"))
    return urls.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("own")), ["host", "path"], "left")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` urls of all canonical links and meta refreshes in ``html``.

    Of a target ``&amp;`` is decoded; targets without a scheme are resolved against the page, ``.`` and ``..``
    segments included. Null urls and pages without html have none.
    """
    tags = lambda pattern: F.regexp_extract_all(F.col("h"), F.lit(pattern), F.lit(0))
    base = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(F.col(url).alias("src"), F.col(html).alias("h")).where("src is not null")
    links = F.transform(tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    moves = F.transform(tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = base.select("src", F.explode(F.concat(links, moves)).alias("to")).where("to <> ''").select("src", F.replace("to", F.lit("&amp;"), F.lit("&")).alias("to"))
    origin, scheme = F.regexp_extract("src", r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract("src", r"(?s)^(.*?:)//", 1)
    page, folder = F.regexp_extract("src", r"(?s)^([^?#]*)", 1), F.regexp_extract("src", r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    path = F.when(F.col("to").startswith("/"), F.col("to")).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), "to"))
    own, rest = F.regexp_extract(path, r"(?s)^([^?#]*)", 1), F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(F.expr("substring(_own, 2)"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    joined = F.concat(origin, F.lit("/"), F.array_join(kept, "/"), ends, "_rest")
    full = F.when(F.col("to").contains("://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, "to")).when(F.col("to").startswith("?"), F.concat(page, "to")).when(F.col("to").startswith("#"), F.col("src")).otherwise(joined)
    return found.withColumns({"_own": own, "_rest": rest}).select("src", full.alias("dst"))


def url_filter(pages: DataFrame, rules: DataFrame, edges: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules``: (host, path, verdict allow or block). ``edges``: (src, dst) urls that redirect or name their
    canonical form; ends need not be pages, and an end that a rule blocks blocks its aliases too. Scheme and
    fragment do not tell urls apart, the query does. No rule and no blocked alias: allow. Null urls and urls
    without ``://`` have empty host and path, no rule, and are allowed. Repeated rows are judged alike; an
    empty table gives no rows; other columns are not looked at.
    """
    parts = url_parts(F.col("u"))
    node = F.xxhash64("host", "path", "query")
    located = pages.select(F.col(id).alias("id"), F.col(url).alias("u")).select("id", *[c.alias(n) for n, c in parts.items()])
    ruled = with_rule(located, rules, "id")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("u")).distinct().select(*[c.alias(n) for n, c in parts.items()]).distinct()
    pairs = edges.select(F.col("src").alias("u"), "dst").select(F.xxhash64(*parts.values()).alias("s"), F.col("dst").alias("u")).select("s", F.xxhash64(*parts.values()).alias("d"))
    linked = connected_components(cut(pairs.distinct(), "aliases"), "s", "d")
    judged = with_rule(ends, rules, "u").select(node.alias("node"), "own")
    spread = linked.join(judged, "node", "left").groupBy("component").agg(F.max((F.col("own") == "block").cast("int")).alias("bad")).where("bad = 1")
    blocked = linked.join(spread, "component").select("node", F.lit("block").alias("alias"))
    out = ruled.withColumn("node", node).join(blocked, "node", "left")
    return out.select(F.col("id").alias(id), "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))
