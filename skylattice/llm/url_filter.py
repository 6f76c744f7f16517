"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that go with a bad label. Rules pruned by
support, confidence and lift are kept in an inverted index under their rarest token; a URL
looks up its tokens there and is checked for the rest of the rule. Fixed host and path rules
go first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import HOT_SHARE, split_join, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The item that stands for a bad label; no URL token begins with a space.
BAD = " bad"
# Fixed rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A[\s\S]*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fixed rule that fits; null without one."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Different tokens of a URL: host labels, host suffixes, words of the path and names of
    the query's parameters, each with a prefix for where it stands."""
    labels = F.transform(F.filter(F.split(host, r"[.:]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(r"[^/._~-]+"), 0), lambda x: F.concat(F.lit("p:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)="), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(labels, words, names))


#: Labelled rows that a token combination needs at least, whatever its share.
LEAST_ROWS = 10


def mine(labelled: DataFrame, support: float, confidence: float, lift: float) -> DataFrame:
    """antecedent, confidence, lift and support of the rules with a bad label, for rows of
    (tokens, bad)."""
    spark, rows = labelled.sparkSession, labelled.count()
    support = min(1.0, max(support, LEAST_ROWS / max(1, rows)))
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")).filter(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift))
    rules = stash(spark, rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support"), "url-rules")
    # a rule says nothing more than a part of it with at least its confidence
    part = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("as_sure"))
    by = F.explode("antecedent").alias("token")
    wider = rules.select("antecedent", "confidence", by).join(part.select("part", "as_sure", F.col("part")[0].alias("token")), "token")
    covered = wider.filter((F.size("part") < F.size("antecedent")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return rules.join(covered.select("antecedent").distinct(), "antecedent", "left_anti")


def index(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """The rules under their rarest token (by rows of ``baskets``): token, antecedent, confidence."""
    seen = baskets.select(F.explode("tokens").alias("token")).groupBy("token").count()
    listed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(seen, "token")
    return listed.groupBy("antecedent", "confidence").agg(F.min(F.struct("count", "token"))["token"].alias("token"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, support: float = 0.005, confidence: float = 0.6, lift: float = 1.5) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern and confidence of every page's url.

    rule is the longest of the fixed ``rules`` (host, path, verdict) that fits, like ``net/``,
    else null. Where none fits, the verdict is block if a mined rule does (pattern: its tokens,
    space-joined; confidence: its own, the highest one's), else allow. Rules are mined from the
    pages whose page_id has a label; bad are those labelled toxic or of quality 0. Null urls
    and urls without ``://`` have an empty host and path and no tokens. Labels with nulls count
    as not bad; repeated labels as one, bad if any is. Repeated urls are judged once, each row
    is returned. Without labels nothing is mined. Only page_id, url and the labels' doc_id,
    quality and toxic are read.
    """
    spark: SparkSession = pages.sparkSession
    parsed = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    labelled = parsed.join(bad, parsed["page_id"] == bad["doc_id"]).select(tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"), "bad")
    labelled = stash(spark, labelled, "url-baskets")
    fixed, verdict = fixed_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    ruled = parsed.withColumn("rule", fixed).withColumn("fixed", verdict)
    if labelled.isEmpty():
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("double").alias("confidence"))
    listed = stash(spark, index(mine(labelled, support, confidence, lift), labelled), "url-index")
    # each different url that no fixed rule decides looks up its tokens
    undecided = F.col("rule").isNull() & F.col("url").isNotNull()
    urls = stash(spark, ruled.filter(undecided).groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("rows")), "urls")
    total = urls.agg(F.sum("rows")).first()[0] or 0
    open_ = urls.select("url", tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    hits = open_.select("url", "tokens", F.explode("tokens").alias("token")).join(listed, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("pattern"))).alias("hit"))
    named = urls.select("url", "rows").join(best, "url", "left")
    judged = split_join(ruled.filter(undecided), named, "url", F.col("rows") > max(1, total * HOT_SHARE)).drop("rows")
    out = judged.unionByName(ruled.filter(~undecided), allowMissingColumns=True)
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.col("hit.pattern").alias("pattern"), F.col("hit.confidence").alias("confidence"))
