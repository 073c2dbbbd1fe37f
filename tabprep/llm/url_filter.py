"""Judging URLs: rules for hosts and path beginnings first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprep.llm.text import lower_ascii, packed
from tabprep.session import scratch_path

#: Hashed features, n-gram lengths and the probability from which a URL is blocked.
FEATURES = 1 << 13
GRAMS = (3, 4, 5)
BLOCK_FROM = 0.7
ROUNDS = 60
RIDGE = 0.002
#: Rules are part of the plan; more than this belong in a table of their own.
MOST_RULES = 1_000

#: A small labelled table: words that name what a host is for. Each is used in several typical URLs.
UNWANTED_WORDS = (
    "spam", "link-farm", "farm-links", "cheap-pills", "pills-online", "viagra", "casino", "casino-bonus", "win-big", "slots-win", "free-bets",
    "bets-online", "poker", "lottery-win", "adult", "adult-video", "xxx-cams", "porn", "ads", "ad-track", "ads-server", "track-clicks",
    "click-ads", "payday-loan", "replica-watch", "free-prize", "warez", "hot-x-girls", "seo-boost", "buy-followers",
)
WANTED_WORDS = (
    "news", "library", "museum", "weather", "university", "science", "history", "recipes", "garden", "travel", "docs", "health", "council",
    "archive", "journal", "music", "theatre", "sport", "school", "market", "river", "mountain", "notes", "research", "letters", "nation",
    "weather-report", "city-library", "open-notes", "health-center", "thread", "station", "northern", "window", "addition", "tension",
    "other", "reading", "address", "headline",
)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, blocked``: each word of the two lists under a few subdomains, endings and paths that carry no signal."""
    rows = []
    for label, words in ((1.0, UNWANTED_WORDS), (0.0, WANTED_WORDS)):
        for i, word in enumerate(words):
            for j, front in enumerate(("", "www.", "blog.", "m.")):
                domain = ("com", "net", "org")[(i + j) % 3]
                path = ("/", f"/en/{i * 7 + j}", f"/de/{i * 13 + j}.html", f"/a/b/{word}")[(i // 3 + j) % 4]
                rows.append((f"https://{front}{word}.example.{domain}{path}", label))
    return spark.createDataFrame(rows, "url string, blocked double")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct ``size, rule, verdict``, or null. Of equally long ones, the later in text order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fitting = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fitting))


def _grams_of(text: Column, n: int, tag: str) -> Column:
    """Every n-gram of ``text``, tagged; a text shorter than ``n`` gives itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(tag), F.substr(text, i, F.lit(n))))


def _grams(text: Column, tag: str) -> Column:
    return F.concat(*[_grams_of(text, n, tag) for n in GRAMS])


def _features(df: DataFrame) -> DataFrame:
    host, path = F.concat(F.lit("^"), F.col("host"), F.lit("$")), F.concat(F.col("path"), F.lit("$"))
    grams = df.withColumn("grams", F.concat(_grams(host, "h"), _grams(path, "p")))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams).drop("grams")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> LogisticRegressionModel:
    """Fit on a small table of URLs (1 blocked, 0 allowed). Rows without a label teach nothing.

    The model is stored and read again: a fresh one has a training summary that refers to the session, which tasks cannot carry.
    """
    url = F.col(f"`{url_col}`")
    rows = labelled.select(F.col(f"`{label_col}`").cast("double").alias("label"), host_of(url).alias("host"), path_of(url).alias("path"))
    path = scratch_path(labelled.sparkSession, "url-model")
    LogisticRegression(maxIter=ROUNDS, regParam=RIDGE, standardization=False).fit(_features(rows.dropna()).coalesce(1)).save(path)
    return LogisticRegressionModel.load(path)


def judge(urls: DataFrame, model: LogisticRegressionModel, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """Each row as struct ``row`` with ``host, path, rule, verdict, score``.

    A rule fits its host and all subdomains if the path begins with the rule's; the longest one (host and path
    together) decides, and ``rule`` names it. Without one ``rule`` is null and the model decides: block from
    ``BLOCK_FROM`` on. ``score`` is the model's probability of blocking in either case. A null URL or one
    without ``://`` has an empty host and path and is judged by the model like any other. No row moves.
    """
    url = F.col(f"`{url_col}`")
    parts = urls.select(packed(urls.columns), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(_features(parts)).withColumn("score", vector_to_array("probability")[1])
    decided = scored.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("score") >= BLOCK_FROM, F.lit("block")).otherwise(F.lit("allow"))
    return decided.select(
        "row", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), "score"
    )
