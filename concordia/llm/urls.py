"""Operator 6 [native]: URL filter, rules first, then a logistic regression on hashed character n-grams.

A url is split into host and path. Rules (verdict, host, path) fit their host and
all its subdomains when the url's path begins with the rule's; the longest rule
that fits decides. Every other url is judged by a logistic regression on hashed
character n-grams of host and path, trained from a small labelled table of urls.
Only DataFrame functions and Spark ML's own estimators are used; nothing is
shuffled, the model is ``features`` weights.

Defined results: a null url, or one without ``://``, has an empty host and path
and is judged on those; repeated rows are judged alike; rules of equal length
are decided for ``block``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
NGRAMS = (3, 4)
#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The small labelled table (url, 1 for block) a model is trained from by default.
LABELLED = (
    ("https://spam-farm.example.org/en/1", 1), ("http://spam-farm.example.net/de/20?utm_source=feed", 1),
    ("https://www.spam-links.example.org/en/buy", 1), ("https://link-farm.example.net/en/772", 1),
    ("http://cheap-pills.example.org/order", 1), ("https://pills-online.example.net/en/cheap/44", 1),
    ("https://best-casino.example.org/en/win", 1), ("http://casino-bonus.example.net/de/spin/9", 1),
    ("https://free-slots.example.org/casino/3", 1), ("https://win-prize.example.net/en/free-prize", 1),
    ("http://adult-cams.example.org/en/live", 1), ("https://xxx-video.example.net/en/88", 1),
    ("https://malware-host.example.org/setup.exe", 1), ("http://phish-login.example.net/en/verify-account", 1),
    ("https://click-ads.example.org/track/click", 1), ("https://payday-loans.example.net/apply", 1),
    ("https://spam.example.org/en/spam/17", 1), ("http://farm-spam.example.net/en/12.html", 1),
    ("https://news.example.org/en/1", 0), ("https://blog.anthor.example.net/en/7198#top", 0),
    ("https://m.theher.example.org/de/39547.html", 0), ("http://www.example.org/de/12", 0),
    ("https://docs.example.net/en/guide/2", 0), ("https://wiki.example.org/en/page/77", 0),
    ("http://thering.example.net/en/35332/", 0), ("https://ingand.example.org/en/3?page=2&ref=x", 0),
    ("https://school.example.net/de/lesson/4", 0), ("https://library.example.org/en/book/90", 0),
    ("https://erthan.example.net/de/110.html", 0), ("http://tionre.example.org/fr/50", 0),
    ("https://www.museum.example.org/es/tour", 0), ("https://science.example.net/en/article/6", 0),
    ("http://m.ouston.example.net/de/71", 0), ("https://blog.hener.example.org/en/9/", 0),
    ("https://stedth.example.org/es/31", 0), ("https://forum.example.net/en/topic/15", 0),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, else null. ``rules`` is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def ngrams(host: Column, path: Column, sizes=NGRAMS) -> Column:
    """Character n-grams; each part is fenced and marked, so a path's n-gram is not a host's."""
    def of(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    fenced = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))]
    return F.concat(*[of(mark, text, n) for mark, text in fenced for n in sizes])


def _featured(urls: DataFrame, url: str, features: int) -> DataFrame:
    got = urls.withColumns({"__url_host": host_of(F.col(url)), "__url_path": path_of(F.col(url))}) \
        .withColumn("__url_grams", ngrams(F.col("__url_host"), F.col("__url_path")))
    return HashingTF(numFeatures=features, binary=True, inputCol="__url_grams", outputCol="__url_x").transform(got)


def train(labelled: DataFrame, url: str = "url", label: str = "block", features: int = FEATURES) -> LogisticRegressionModel:
    """Fit on a labelled table; null labels are left out."""
    rows = _featured(labelled.where(F.col(label).isNotNull()), url, features) \
        .select("__url_x", F.col(label).cast("double").alias("__url_y"))
    return LogisticRegression(featuresCol="__url_x", labelCol="__url_y", regParam=0.01, maxIter=100,
                              predictionCol="__url_block", probabilityCol="__url_probability",
                              rawPredictionCol="__url_raw").fit(rows)


def labelled_urls(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, block)")


def judge(urls: DataFrame, model: LogisticRegressionModel, rules=RULES, url: str = "url", features: int = FEATURES) -> DataFrame:
    """``urls`` with ``__url_host``, ``__url_path``, ``__url_rule`` and ``__url_verdict``."""
    got = model.transform(_featured(urls, url, features))
    rule = longest_rule(F.col("__url_host"), F.col("__url_path"), rules)
    by_model = F.when(F.col("__url_block") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return got.withColumn("__url_fit", rule).withColumns({
        "__url_rule": F.col("__url_fit.rule"), "__url_verdict": F.coalesce(F.col("__url_fit.verdict"), by_model)}) \
        .drop("__url_fit", "__url_grams", "__url_x", "__url_raw", "__url_probability", "__url_block")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    got = judge(pages, train(labelled_urls(spark)))
    return got.select("page_id", F.col("__url_host").alias("host"), F.col("__url_path").alias("path"),
                      F.col("__url_rule").alias("rule"), F.col("__url_verdict").alias("verdict"))


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES: dict[str, str] = {}
