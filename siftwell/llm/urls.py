"""URL filters: fixed host rules, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with a bad label; rules
are pruned by support, confidence and generality. A page is looked up in an inverted
index that holds each rule under its rarest token alone, and a candidate counts if
the page has all the rule's tokens. DataFrame operations throughout.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise

#: A mined rule needs so many labelled rows, or this share of them where that is more: a
#: token of lesser support is in no rule, so FP-growth's list of frequent tokens, which
#: Spark keeps on the driver, has at most a url's tokens times 100,000 entries.
LEAST_ROWS, LEAST_SHARE = 20, 1e-5
#: (verdict, host/path). A rule fits its host and subdomains if the path starts with its path.
FIXED = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BAD = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for what has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = FIXED) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.find("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and path segments, the parts of both between hyphens or
    underscores, and names of query parameters. Numbers in path segments count as 0."""
    divided = lambda a: F.flatten(F.transform(F.filter(a, lambda x: x.rlike("[-_]")), lambda x: F.filter(F.split(x, "[-_]"), lambda y: y != "")))
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^[^?#]*[?]([^#]*)", 1), "&"), lambda x: x != "")
    named = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(named("h:", labels), named("w:", divided(labels)), named("p:", segments), named("s:", divided(segments)), named("q:", F.transform(query, lambda x: F.split(x, "=")[0]))))


def mine(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float) -> DataFrame:
    """Rules ``(antecedent, confidence, support, token)`` for a bad label, from ``labelled(items, bad)``.

    A rule needs ``min_support`` as a share and ``min_count`` labelled rows; it goes if
    one with fewer of the same tokens is as sure. ``token`` is its rarest one.
    """
    n = labelled.count()
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double, token string")
    min_support = max(min_support, min_count / n)
    items = F.array_union("items", F.array(F.when(F.col("bad"), BAD).otherwise("=allow")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled.select(items.alias("items")))
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(~F.array_contains("antecedent", "=allow"))
    rules = materialise(found.select(F.sort_array("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    # Each rule meets its more general ones through the tokens they share.
    general = rules.select(F.col("antecedent").alias("less"), F.col("confidence").alias("as_sure"), F.col("antecedent")[0].alias("token"))
    met = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(general, "token")
    beaten = met.where((F.size("less") < F.size("antecedent")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0)).select("antecedent").distinct()
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    kept = rules.join(beaten, "antecedent", "left_anti")
    rarest = kept.select("*", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
    return materialise(rarest, "index")


def filter_urls(pages: DataFrame, labels: DataFrame, min_support: float = LEAST_SHARE, min_count: int = LEAST_ROWS, min_confidence: float = 0.8, rules: tuple[tuple[str, str], ...] = FIXED) -> DataFrame:
    """One row per row of ``pages(page_id, url, ...)``: host, path, fixed rule, verdict.

    ``labels(doc_id, quality, toxic)`` label pages of the same number: quality 0 or
    toxic 1 is bad; null labels are ignored. Null urls and such without ``://`` have
    empty host and path, fit no fixed rule and no mined one. Repeated rows stay
    repeated; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    told = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    items = tokens(F.col("url"), F.col("host"), F.col("path"))
    labelled = base.join(told, base["page_id"] == told["doc_id"]).select(items.alias("items"), "bad")
    index = mine(materialise(labelled, "labelled"), min_support, min_count, min_confidence)
    # Equal urls are matched once.
    urls = base.where("host <> ''").select("url", "host", "path").distinct().select("url", items.alias("items"))
    hit = urls.select("url", "items", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "items")) == 0)
    bad = materialise(hit.groupBy("url").agg(F.max("confidence").alias("sure")), "bad_urls")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("sure").isNotNull(), "block").otherwise("allow")
    return base.join(bad, "url", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
