"""URL filters: allow and block rules by host and path, then gradient-boosted trees on lexical features.

DataFrame functions and Spark ML only. Rules compile to one expression. The trees are fitted on at most SAMPLE labelled
URLs (by hash of the URL). Suffix statistics are counted over all labelled URLs and joined, so a hot suffix is a join that
adaptive execution can split or broadcast by size; a training row gets its suffix's rate from the other folds, so the
trees do not read a row's own label from it. URLs are judged beside their row, which is one column, so no name of the
caller's clashes with a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import evaluation
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import ascii_lower, named, stored, table

#: (verdict, host, path); a rule is shown as host + path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 20_000
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "suffix_rate")
TREES = {"maxIter": 10, "maxDepth": 4, "seed": 7}
#: Labelled URLs that the overall rate counts for in a suffix's rate.
PRIOR = 20.0
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), null if none: its host or a subdomain, a path that starts so."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        choice = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def lexical(urls: DataFrame) -> DataFrame:
    """`urls` (url, not null, host, path and more) with all features but suffix_rate, and suffix."""
    url = F.col("url")
    n = F.greatest(F.length(url), F.lit(1))
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    counts = F.transform(letters, lambda c: (F.length("url") - F.length(F.replace(F.col("url"), c, F.lit("")))) / n)
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("/")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / n,
            "entropy": F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "params": F.regexp_count(url, F.lit("[?&][^=&#]+=")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
        }
    )


class UrlModel:
    """Fitted trees (None if the labels hold one class only: then every URL gets that class) and suffix rates."""

    def __init__(self, trees: GBTClassificationModel | None, constant: str, suffixes: DataFrame, rate: float):
        self.trees, self.constant, self.suffixes, self.rate = trees, constant, suffixes, rate

    def with_features(self, urls: DataFrame) -> DataFrame:
        joined = lexical(urls).join(self.suffixes, "suffix", "left")
        return _assembled(joined.withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.rate))))

    def scored(self, urls: DataFrame) -> DataFrame:
        """`urls` (url, host, path and more) with block_probability."""
        if self.trees is None:
            return urls.withColumn("block_probability", F.lit(1.0 if self.constant == "block" else 0.0))
        return self.trees.transform(self.with_features(urls)).withColumn("block_probability", vector_to_array("probability")[1])


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def _parts(url: Column) -> list[Column]:
    return [F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path")]


def fit_urls(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """labelled: url, block (0 or 1); rows with a null label are left out.

    Equal URLs are in one fold. The rate of a suffix is shrunk to the overall rate as by PRIOR labels of that rate.
    """
    rows = labelled.where("block IS NOT NULL").select(*_parts(F.col("url")), F.col("block").cast("double").alias("block"))
    suffix, fold = F.substring_index("host", ".", -2), F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))
    rows = stored(rows.withColumns({"suffix": suffix, "fold": fold}), "url-labels")
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0.0))).first()
    rate = ones / n if n else 0.0
    by_fold = stored(rows.groupBy("suffix", "fold").agg(F.sum("block").alias("own"), F.count(F.lit(1)).alias("own_n")), "url-folds")
    totals = stored(by_fold.groupBy("suffix").agg(F.sum("own").alias("ones"), F.sum("own_n").alias("n")), "url-totals")
    rates = totals.select("suffix", ((F.col("ones") + PRIOR * rate) / (F.col("n") + PRIOR)).alias("suffix_rate"))
    model = UrlModel(None, "block" if n and ones == n else "allow", stored(rates, "url-suffixes"), rate)
    chosen = stored(rows.orderBy(F.xxhash64("url"), "url", "block").limit(sample), "url-sample")
    if chosen.select("block").distinct().count() == 2:
        others = by_fold.join(totals, "suffix").select("suffix", "fold", F.col("ones") - F.col("own"), F.col("n") - F.col("own_n")).toDF("suffix", "fold", "ones", "n")
        out_of_fold = (F.col("ones") + PRIOR * rate) / (F.col("n") + PRIOR)
        train = lexical(chosen.join(others, ["suffix", "fold"]).withColumn("suffix_rate", out_of_fold))
        model.trees = GBTClassifier(featuresCol="features", labelCol="block", **TREES).fit(_assembled(train).select("features", "block"))
    return model


def held_out_auc(labelled: DataFrame, sample: int = SAMPLE) -> float:
    """Area under the ROC curve over all labelled URLs, each scored by a model fitted without its fold."""
    rows = stored(labelled.where("block IS NOT NULL").select("url", F.col("block").cast("double").alias("block")), "url-labels")
    fold = F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit("held out")), F.lit(FOLDS))
    parts = []
    for f in range(FOLDS):
        model = fit_urls(rows.where(fold != f), sample)
        parts.append(model.scored(rows.where(fold == f).select(*_parts(F.col("url")), "block")).select("block_probability", "block"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    metric = evaluation.BinaryClassificationEvaluator(rawPredictionCol="block_probability", labelCol="block", metricName="areaUnderROC")
    return metric.evaluate(every)


def judge(urls: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """`urls` with host, path, rule (null if none fits), verdict (the rule's, else the model's) and block_probability.

    Null urls and urls without :// have an empty host and path and are judged by the model. Columns of `urls` with the
    names of these five are replaced, all others stay as they are; repeated rows are judged each.
    """
    new = ("host", "path", "rule", "verdict", "block_probability")
    held = [c for c in urls.columns if c not in new]
    rows = urls.select(F.struct(*[named(c).alias(c) for c in held]).alias("row"), *_parts(F.col("url")))
    chosen = matched_rule(F.col("host"), F.col("path"), rules)
    scored = model.scored(rows).withColumn("chosen", chosen)
    learned = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in held],
        "host",
        "path",
        F.col("chosen.rule").alias("rule"),
        F.coalesce("chosen.verdict", learned).alias("verdict"),
        "block_probability",
    )


def labelled_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose path names a labelled document: block if its quality is 0."""
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html|/)?(?:[?#].*)?$", 1).alias("number"))
    ids = pages.where("number <> ''").select("url", F.col("number").cast("bigint").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((1 - F.min("quality")).alias("block"))
    return ids.join(labels, "doc_id").select("url", "block")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = fit_urls(labelled_urls(spark, sf_dir))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))
