"""URL filters: written rules, and gradient-boosted trees on lexical features for what no rule fits.

All of it is DataFrame expressions and the JVM's own boosted trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

#: (verdict, rule): a host with all its subdomains, and what the path starts with. The longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words whose presence in a host marks a URL as one to block, for training beside the rules.
SEEDS = ("casino", "bets", "pills", "track")
#: Different labelled URLs that the trees are trained on, at most. Shares and counts come from all labelled rows.
TRAINING_URLS = 20_000
#: Suffixes or sections that are broadcast, at most; beyond, they are joined by a shuffle.
FEW = 20_000
FEATURES = ("length", "host_length", "depth", "labels", "digits", "symbols", "hyphens", "entropy", "parameters", "fragment", "longest_label", "suffix_share", "suffix_log", "section_share")


def parts(url: Column) -> tuple[Column, Column]:
    """host, path of a URL; both empty where it is null or has no "://"."""
    whole = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.translate(F.regexp_extract(whole, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(whole, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """rule, verdict of the longest rule that fits; null without one."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith(f".{text[:at]}")) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Of the distribution of a string's letters, in bits."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters)
    each = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def _lexical(rows: DataFrame) -> DataFrame:
    """rows (with url, host, path) and what can be told from the URL alone."""
    url, host, labels = F.coalesce("url", F.lit("")), F.col("host"), F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        _count(F.col("path"), "/[^/]").alias("depth"),
        F.size(labels).cast("double").alias("labels"),
        (_count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1))).alias("digits"),
        (_count(url, "[^A-Za-z0-9/.:]") / F.greatest(F.length(url), F.lit(1))).alias("symbols"),
        _count(host, "-").alias("hyphens"),
        _entropy(host).alias("entropy"),
        (F.when(query == "", 0).otherwise(1) + _count(query, "&")).cast("double").alias("parameters"),
        F.when(F.locate("#", url) > 0, 1.0).otherwise(0.0).alias("fragment"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (with host, path) and the keys of what is counted."""
    suffix = F.substring_index("host", ".", -2)
    return rows.withColumns({"_suffix": suffix, "_section": F.concat_ws("/", suffix, F.regexp_extract("path", r"\A/([^/]*)", 1))})


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """url, host, path, label of at most `limit` different URLs, chosen by their hash; weight: how many rows each has."""
    n = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    part = int(min(1.0, limit / max(1, n)) * (1 << 40)) + 1
    few = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < part)
    counted = few.groupBy("url", "host", "path", "label").agg(F.count("*").cast("double").alias("weight"))
    return counted.orderBy(F.xxhash64("url"), "url").limit(limit)


def _shares(labelled: DataFrame, by: str, name: str) -> DataFrame:
    """Of each value of `by`, how many labelled URLs there are, and how many of them are to be blocked."""
    return labelled.groupBy(F.col(by).alias(f"_{name}")).agg(F.count("*").cast("double").alias(f"{name}_n"), F.sum("label").alias(f"{name}_bad"))


class UrlModel:
    """Boosted trees and the suffix and section statistics that they read."""

    def __init__(self, labelled: DataFrame, limit: int = TRAINING_URLS) -> None:
        """labelled: url, host, path, label (1: to block). All rows are counted; the trees learn from `limit` URLs at most."""
        labelled = _keyed(labelled.withColumn("label", F.col("label").cast("double")))
        self.suffixes = settled(_shares(labelled, "_suffix", "suffix"))
        self.sections = settled(_shares(labelled, "_section", "section"))
        self.known = [(by, F.broadcast(t) if t.count() <= FEW else t) for by, t in (("_suffix", self.suffixes), ("_section", self.sections))]
        rows = settled(self._assembled(settled(_sample(labelled, limit)), F.col("label"), F.col("weight")).select("x", "label", "weight"))
        kinds = [r["label"] for r in rows.select("label").distinct().collect()]
        self.constant = "allow" if not kinds or max(kinds) == 0 else "block" if len(kinds) == 1 else None
        if self.constant is None:
            self.trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=8, maxDepth=4, maxBins=32, stepSize=0.3, seed=5).fit(rows)

    def _assembled(self, rows: DataFrame, label: Column | None = None, weight: Column | None = None) -> DataFrame:
        """rows with their features. Of rows with a label their own part (weight times) is left out of the shares."""
        own, own_bad = (F.lit(0.0), F.lit(0.0)) if label is None else (weight, weight * label)
        rows = _keyed(rows)
        for by, table in self.known:
            rows = rows.join(table, by, "left")
        shares = {}
        for name in ("suffix", "section"):
            n, bad = (F.greatest(F.coalesce(f"{name}_{c}", F.lit(0.0)) - o, F.lit(0.0)) for c, o in (("n", own), ("bad", own_bad)))
            shares[f"{name}_share"] = (bad + 1.0) / (n + 2.0)
            shares[f"{name}_log"] = F.log1p(n)
        return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(_lexical(rows.withColumns(shares)))

    def judge(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """keep, and judged: allow or block, for rows with url, host, path."""
        if self.constant is not None:
            return rows.select(*keep, F.lit(self.constant).alias("judged"))
        scored = self.trees.transform(self._assembled(rows))
        return scored.select(*keep, F.when(F.col("prediction") == 1, "block").otherwise("allow").alias("judged"), vector_to_array("probability")[1].alias("risk"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, limit: int = TRAINING_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    Rules decide what they fit. The trees decide the rest; they learn from URLs that rules or seeds label. A null url,
    or one without a scheme, has an empty host and path and is judged by the trees; repeated rows are judged alike; other
    columns are ignored; an empty table gives no rows. With no labelled URL at all everything is allowed.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").select("*", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_ruled"))
    seeded = F.col("host").rlike("|".join(seeds)) if seeds else F.lit(False)
    label = F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0).when(seeded, 1).when((F.col("host") != "") & (F.xxhash64("host") % 2 == 0), 0)
    labelled = rows.select("url", "host", "path", label.alias("label")).where("label is not null and url is not null")
    keep = ["page_id", "host", "path", "rule", "_ruled"]
    judged = UrlModel(labelled, limit).judge(rows, keep)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_ruled", "judged").alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
