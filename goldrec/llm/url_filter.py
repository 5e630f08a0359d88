"""URL filter: host rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame code and Spark's own tree learner. Features: length, depth,
digit ratio, entropy, parameter counts, and statistics of the host's suffix taken from
all labelled URLs. The trees are fitted on at most ``TRAIN_ROWS`` different labelled URLs,
of each label those with the smallest hashes, weighted by how often they occur.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is judged by its (mostly zero) features; without labels of both kinds every
verdict of the method is the one there is, ``allow`` if there is none; equal rows are
judged alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
FEATURES = (
    "length",
    "host_length",
    "depth",
    "labels",
    "digits",
    "hyphens",
    "entropy",
    "params",
    "has_fragment",
    "suffix_rate",
    "suffix_log_n",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the filter.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.split(url, "://", 2)[1]).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """``value`` of the longest rule that fits; a rule fits its host and all below it."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def _times(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def lexical(rows: DataFrame) -> DataFrame:
    """Add the lexical features of ``url``, and ``suffix``; needs ``host`` and ``path``."""
    url, host = F.coalesce(F.col("url"), F.lit("")), F.col("host")
    n = F.length(url)

    def bits(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(url, c, F.lit("")))) / n
        return total - share * F.log2(share)

    characters = F.array_distinct(F.filter(F.split(url, ""), lambda c: F.length(c) > 0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": n,
            "host_length": F.length(host),
            "depth": _times(F.col("path"), "/"),
            "labels": _times(host, "."),
            "digits": F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")), n), F.lit(0.0)),
            "hyphens": _times(url, "-") + _times(url, "_"),
            "entropy": F.aggregate(characters, F.lit(0.0), bits),
            "params": F.when(query == "", 0).otherwise(_times(query, "&") + 1),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "suffix": F.substring_index(host, ".", -1),
        }
    )


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per suffix the smoothed rate of blocked URLs and the log of their number."""
    n, blocked = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy("suffix").agg(
        ((blocked + 1) / (n + 2)).alias("suffix_rate"), F.log1p(n).alias("suffix_log_n")
    )


def _vectors(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    rows = rows.join(suffixes, "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_log_n": 0.0})
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def train(labelled: DataFrame, suffixes: DataFrame, rows: int = TRAIN_ROWS) -> GBTClassificationModel | None:
    """Trees from labelled, featurised URLs; None where only one label occurs.

    Each label gives the same number of different URLs at most, weighted by their rows and
    so that the labels keep their shares, however often one URL occurs.
    """
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (totals.get(0) and totals.get(1)):  # labels are 0 and 1
        return None
    urls = labelled.groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = [urls.filter(F.col("label") == x).orderBy(F.xxhash64("url"), "url").limit(rows // 2) for x in (0, 1)]
    sample = each[0].unionByName(each[1]).cache()
    try:
        sums = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        share = F.when(F.col("label") == 1, totals[1] / sums[1]).otherwise(totals[0] / sums[0])
        host, path = host_and_path(F.col("url"))
        featured = lexical(sample.withColumns({"host": host, "path": path, "weight": F.col("n") * share}))
        vectors = _vectors(featured, suffixes).select("features", F.col("label").cast("double"), "weight")
        trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, seed=1, weightCol="weight")
        return trees.fit(vectors)
    finally:
        sample.unpersist()


def judge(
    pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``pages``. ``labelled``: ``url``
    and ``label`` (1: block)."""
    host, path = host_and_path(F.col("url"))
    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
    known = lexical(known.filter("url is not null and label is not null").withColumns({"host": host, "path": path}))
    suffixes = suffix_statistics(known)
    model = train(known, suffixes)
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"))
    rows = lexical(rows.withColumns({"host": host, "path": path}))
    if model is None:
        only = known.select("label").first()
        rows = rows.withColumn("prediction", F.lit(float(only[0]) if only else 0.0))
    else:
        rows = model.transform(_vectors(rows, suffixes))
    by_model = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    rule = matched(F.col("host"), F.col("path"), rules, "text")
    verdict = F.coalesce(matched(F.col("host"), F.col("path"), rules, "verdict"), by_model)
    return rows.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def labelled_by_rules(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """URLs that a rule decides, as labels for the trees."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[url].cast("string").alias("url"))
    verdict = matched(host, path, rules, "verdict")
    return rows.select("url", (verdict == "block").cast("int").alias("label")).filter("label is not null")
