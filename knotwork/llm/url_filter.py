"""URL filters by association rules.

A URL becomes a set of tokens (scheme, host labels, path segments, file ending, query keys).
Spark's FP-growth mines token combinations from labelled URLs; rules "tokens -> bad" that pass
the support and confidence bounds, and that no shorter rule implies, are kept. They are matched
through an inverted index: each rule is filed under its rarest token, a URL meets only the
rules filed under one of its own tokens, and the rest of the rule's tokens is then verified.

Explicit (host, path) rules take precedence: a rule fits its host and all subdomains where the
URL's path starts with the rule's; of several that fit, the longest wins (then the smaller).

Only DataFrame functions and Spark's own FP-growth run here.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, share_broadcast

BAD = "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Set of a URL's tokens. Digits in path segments count as one class; null has no token."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    tag = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segment = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.translate(x, UPPER, LOWER), "[0-9]+", "0"))
    parts = [
        tag("scheme:", F.array(F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER))),
        tag("host:", F.split(host, r"[.:@]")),
        tag("path:", segment),
        tag("query:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
    ]
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*parts)))


def mine_rules(urls: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = 0.005, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """Rules (tokens array, home string, confidence double, support_count long) for bad URLs.

    ``urls`` has a URL and a boolean per labelled row; rows with a null label are left out. A
    rule's tokens and the label occur together in at least ``min_support`` of the labelled rows
    and in at least ``min_count``; ``home`` is its rarest token. No labelled row: no rules.
    """
    baskets = cut(urls.filter(F.col(bad_col).isNotNull()).select(F.concat(tokens_of(F.col(url_col)), F.when(F.col(bad_col), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
    n = baskets.count()
    if n < min_count:
        return urls.sparkSession.createDataFrame([], "tokens array<string>, home string, confidence double, support_count long")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == BAD) & (F.col("lift") > 1))
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n).cast("long").alias("support_count")))
    # a rule that a shorter one implies adds nothing; the shorter one's first token is among its own
    inner, outer = rules.select(F.col("tokens").alias("inner"), F.element_at("tokens", 1).alias("t")), rules.select("tokens", F.explode("tokens").alias("t"))
    implied = outer.join(inner, "t").filter((F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0)).select("tokens").distinct()
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("t"), "freq")
    homes = outer.join(single, "t").groupBy("tokens").agg(F.min_by("t", F.struct("freq", "t")).alias("home"))
    return cut(rules.join(implied, "tokens", "left_anti").join(homes, "tokens").select("tokens", "home", "confidence", "support_count"))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (``(verdict, "host/path")``) that fits, or null."""
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(F.lit(len(rule)).alias("size"), F.lit(slash + rest).alias("path"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    index = F.create_map(*[x for name, found in by_host.items() for x in (F.lit(name), F.array(*found))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    filed = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(index, s)), lambda x: x.isNotNull()))
    fit = F.filter(filed, lambda x: F.startswith(path, x["path"]))
    best = F.reduce(fit, F.lit(None).cast("struct<size:int,path:string,rule:string,verdict:string>"), lambda a, x: F.when(a.isNull() | (x["size"] > a["size"]) | ((x["size"] == a["size"]) & (x["rule"] < a["rule"])), x).otherwise(a))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def judge_urls(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every row: (id, host, path, rule, verdict, confidence).

    ``rule`` is the explicit rule that decided, else null; then a URL that matches a mined rule
    is blocked (``confidence``: the best rule's) and any other allowed. A null URL or one
    without ``://`` has an empty host and path and is allowed. Rows that repeat are judged each;
    an empty table gives no rows; other columns are not read.
    """
    urls = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    index = share_broadcast(mined.select(F.col("home").alias("token"), "tokens", "confidence"), mined.count(), 50_000)
    terms = urls.select("rid", "id", "url", tokens_of(F.col("url")).alias("all")).select("rid", "id", "url", "all", F.explode_outer("all").alias("token"))
    met = terms.join(index, "token", "left").select("rid", "id", "url", F.when(F.size(F.array_except("tokens", "all")) == 0, F.col("confidence")).alias("confidence"))
    judged = met.groupBy("rid", "id", "url").agg(F.max("confidence").alias("confidence"))
    out = judged.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence")
    out = out.withColumn("found", explicit_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), "confidence")
