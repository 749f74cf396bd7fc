"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The features are native columns; the trees are Spark ML's, fitted on a bounded sample of labelled URLs (the same
number of each label, chosen by the URL's hash). Statistics of host suffixes are counted over all URLs, kept as tables
and joined, with a broadcast only where a table was counted to be small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import ascii_lower, of_each_label, written

ALLOW, BLOCK = "allow", "block"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest (verdict, rule) that fits, else null; a tie goes to the longer host."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1]))
    fits = []
    for verdict, rule in order:
        at = rule.index("/")
        domain = rule[:at].lower()
        fits.append(F.when(((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(rule[at:])),
                           F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, of, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    chars = F.array_distinct(F.split(text, ""))
    n = F.length(text).cast("double")
    share = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label and the last two labels of a host."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def lexical_features(url: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"), "labels": _count(host, ".") + 1,
        "digit_ratio": _count(url, "0123456789") / n, "host_digits": _count(host, "0123456789"), "path_digits": _count(path, "0123456789"),
        "entropy": _entropy(url), "host_entropy": _entropy(host), "hyphens": _count(host, "-"),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "query_length": F.length(query).cast("double"),
        "marks": _count(url, "%_~@=+"), "fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": F.startswith(url, F.lit("https")).cast("double"), "vowels": _count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
        "extension": F.regexp_like(path, F.lit(r"\.[a-z0-9]{2,5}$")).cast("double")}


SUFFIXES = 2
BROADCAST_ROWS = 100_000


@dataclass
class UrlModel:
    """Fitted trees and tables of suffix statistics (suffix, rate, share); `constant` stands in when the labels leave nothing to learn."""

    constant: float | None = None
    trees: GBTClassificationModel | None = None
    base: float = 0.5
    statistics: list[DataFrame] = field(default_factory=list)

    def with_features(self, df: DataFrame, url: Column) -> DataFrame:
        """`df` with the vector `_features` of the url; a suffix never counted has the base rate and share 0."""
        names = []
        for k, c in lexical_features(url).items():
            df = df.withColumn(f"_f_{k}", c)
            names.append(f"_f_{k}")
        for i, end in enumerate(suffixes(host_of(F.coalesce(url, F.lit(""))))):
            table = self.statistics[i].select(F.col("suffix").alias(f"_s{i}"), F.col("rate").alias(f"_r{i}"), F.col("share").alias(f"_p{i}"))
            few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
            df = df.withColumn(f"_s{i}", end).join(F.broadcast(table) if few else table, f"_s{i}", "left") \
                .withColumns({f"_f_rate{i}": F.coalesce(f"_r{i}", F.lit(self.base)), f"_f_share{i}": F.coalesce(f"_p{i}", F.lit(0.0))}) \
                .drop(f"_s{i}", f"_r{i}", f"_p{i}")
            names += [f"_f_rate{i}", f"_f_share{i}"]
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df).drop(*names)

    def score(self, df: DataFrame, url_col: str, out: str) -> DataFrame:
        """Adds `out`: probability of `block`."""
        if self.trees is None:
            return df.withColumn(out, F.lit(self.constant))
        packed = self.with_features(df, F.col(url_col))
        return self.trees.transform(packed).withColumn(out, vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def suffix_statistics(urls: DataFrame, base: float, level: int, weight: float = 10.0) -> DataFrame:
    """(suffix, rate, share) over all rows (url, blocked or null): of a suffix's labelled urls the blocked ones, drawn towards
    `base` by `weight`, and its part of all urls."""
    counted = urls.select(suffixes(host_of(F.col("url")))[level].alias("suffix"), "blocked").groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.count_if("blocked").alias("hit"))
    total = urls.agg(F.count(F.lit(1))).first()[0]
    return counted.select("suffix", ((F.col("hit") + weight * base) / (F.col("labelled") + weight)).alias("rate"), (F.col("n") / total).alias("share"))


def train(urls: DataFrame, *, max_sample: int = 20_000, iterations: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fits on (url, blocked boolean or null). The trees are fitted on at most max_sample / 2 distinct URLs of each label, those with
    the smallest hashes of all; the suffix statistics cover all rows, the shares those without a label too.

    Rows with a null url are left out. Without labelled rows the verdict is allow; with one label only, that label.
    """
    urls = urls.select("url", "blocked").filter(F.col("url").isNotNull())
    found = urls.agg(F.count("blocked").alias("n"), F.count_if("blocked").alias("hit")).first()
    if found.hit in (0, found.n):
        return UrlModel(constant=1.0 if found.hit else 0.0)
    model = UrlModel(base=found.hit / found.n)
    model.statistics = [written(suffix_statistics(urls, model.base, i), "suffix-statistics") for i in range(SUFFIXES)]
    chosen = of_each_label(urls.filter(F.col("blocked").isNotNull()), "blocked", F.col("url"), max_sample // 2, ["url"], distinct=True)
    packed = model.with_features(chosen.withColumn("label", F.col("blocked").cast("double")), F.col("url")).select("label", "_features")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=iterations, maxDepth=depth,
                          stepSize=0.3, seed=seed)
    # at most max_sample rows
    model.trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(written(packed.coalesce(1), "url-sample"))
    return model


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, *, url_col: str = "url") -> DataFrame:
    """All rows and columns of `urls` with judged = struct(host, path, rule, verdict, score); a column of that name is replaced.

    A null url or one without `://` has an empty host and path, fits no rule and is left to the model.
    """
    scored = model.score(urls.drop("judged"), url_col, "_score")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule = matching_rule(host, path, rules)
    return scored.withColumn("judged", F.struct(
        host.alias("host"), path.alias("path"), rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("_score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.col("_score").alias("score"))).drop("_score")
