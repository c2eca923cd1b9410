"""URL filtering by mined association rules.

Every URL becomes a set of tokens (host labels, path segments with digits folded, query keys). URLs with a
known verdict are transactions that carry the verdict as one more item; Spark's FP-growth mines them, and
rules ``tokens -> verdict`` are pruned by support and confidence, and dropped where a part of the tokens
already gives the verdict as surely. Rules are matched through an inverted index: each rule is filed under
its rarest token, a URL probes the index with its tokens, and a hit is verified against all of the rule's
tokens. The surest matching rule decides; URLs without one are allowed.

The query's labels are the verdicts of the given host rules, which also take precedence; pages that no
rule fits are transactions labelled ``open``, so that a rule's confidence is its share of all pages with its
tokens, not only of those that some host rule happens to cover.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and has no
tokens (allowed); equal URLs are judged once and share the verdict; empty tables give empty results.
Only DataFrame functions and MLlib are used; work is per distinct URL and joins are by key.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SUPPORT, CONFIDENCE = 0.005, 0.8
RULES_BROADCAST = 50_000
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    return (pages.withColumn("host", X.lower_ascii(F.regexp_extract(url, ADDRESS, 1)))
            .withColumn("path", F.regexp_extract(url, ADDRESS, 2)))


def fitting(rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits ``host`` and ``path``; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of ``url``, ``host`` and ``path``."""
    def named(prefix: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda s: s != ""), lambda s: F.concat(F.lit(prefix), F.regexp_replace(s, "[0-9]+", "#")))

    query = F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    return F.array_distinct(F.concat(
        named("h:", F.split("host", r"\.")), named("p:", F.split("path", "/")),
        named("q:", F.transform(query, lambda s: F.split(s, "=")[0]))))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, anchor) from rows (tokens, verdict)."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double, anchor string"
    rows = X.written(labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("y:"), F.col("verdict")))).alias("items")), "urls")
    if not rows.take(1):
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = X.written(
        model.associationRules
        .select("antecedent", F.col("consequent")[0].alias("head"), "confidence", "support")
        .where(F.col("head").startswith("y:") & ~F.exists("antecedent", lambda a: a.startswith("y:")))
        .select("antecedent", F.substring("head", 3, 100).alias("verdict"), "confidence", "support"), "mined")
    single = X.written(model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq"), "items")
    # a rule is redundant if one with fewer tokens, filed under one of its tokens, is as sure
    shorter = rules.select(F.col("antecedent").alias("a2"), F.col("verdict").alias("v2"), F.col("confidence").alias("c2"),
                           F.col("antecedent")[0].alias("t2"))
    own = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t2"))
    covered = (own.join(shorter, "t2").where((F.col("verdict") == F.col("v2")) & (F.size("a2") < F.size("antecedent"))
                                             & (F.col("c2") >= F.col("confidence"))
                                             & (F.size(F.array_except("a2", "antecedent")) == 0))
               .select("antecedent", "verdict").distinct())
    kept = rules.join(covered, ["antecedent", "verdict"], "left_anti")
    anchors = (kept.select("*", F.explode("antecedent").alias("token")).join(single, "token")
               .groupBy("antecedent", "verdict", "confidence", "support")
               .agg(F.min_by("token", F.struct("freq", "token")).alias("anchor")))
    return X.written(anchors.select("antecedent", "verdict", "confidence", "support", "anchor"), "rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of URLs (url, tokens) that a rule matches: the surest, then best supported rule."""
    index = X.small(rules.withColumnRenamed("anchor", "token"), RULES_BROADCAST)
    probes = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    hits = probes.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max_by("verdict", F.struct("confidence", "support", "verdict")).alias("mined"))


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rule, verdict = fitting(rules)
    known = parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("known", verdict)
    labelled = known.where("host != ''").select(tokens().alias("tokens"), F.coalesce("known", F.lit("open")).alias("verdict"))
    mined = mine(labelled, support, confidence)
    open_urls = (known.where("known is null and host != ''").select("url", "host", "path").distinct()
                 .select("url", tokens().alias("tokens")))
    found = match(open_urls, mined.where("verdict != 'open'")).where("mined = 'block'")
    out = known.join(X.small(X.written(found, "verdicts"), RULES_BROADCAST), "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("known", "mined", F.lit("allow")).alias("verdict"))
