"""URL filter (operator 7): rules by host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.binding import bound
from tomewright.sources.artifacts import staged

# Rules of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 1 << 12
LABELLED = 2000
SIZES = (2, 3, 4)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parsed(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(pages["url"])
    return pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), host.alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    def fits(r: Column) -> Column:
        under = (F.col("host") == r["host"]) | F.col("host").endswith(F.concat(F.lit("."), r["host"]))
        return under & F.col("path").startswith(r["path"])

    # Longest first, so that the first that fits is the longest.
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("verdict", "host", "path"), r, strict=True)]) for r in order])
    best = F.get(F.filter(listed, fits), F.lit(0)) if order else F.lit(None).cast("struct<verdict: string, host: string, path: string>")
    rows = rows.withColumn("_best", best)
    return rows.withColumns(
        {"rule": F.concat("_best.host", "_best.path"), "rule_verdict": F.col("_best.verdict")}
    ).drop("_best")


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with the part it is from."""
    def of(part: Column, mark: str) -> Column:
        def cut(text: Column, n: int) -> Column:
            places = F.sequence(F.lit(1), F.length(text) - n + 1)
            pieces = F.transform(places, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
            return F.when(F.length(text) >= n, pieces).otherwise(F.array().cast("array<string>"))

        return bound(F.concat(F.lit("^"), part, F.lit("$")), lambda text: F.flatten(F.array(*[cut(text, n) for n in SIZES])))

    return F.concat(of(host, "h "), of(path, "p "))


def featured(rows: DataFrame) -> DataFrame:
    hashing = HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features")
    return hashing.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")


def labelled_from_rules(rows: DataFrame, most: int = LABELLED, seed: int = 7) -> DataFrame:
    """A small labelled table ``host, path, verdict``: of the URLs that a rule decides, ``most`` of each verdict.

    They are those with the least hash of the URL, so the table is the same in every run.
    """
    rows = rows.where(F.col("rule_verdict").isNotNull()).select("host", "path", F.col("rule_verdict").alias("verdict")).distinct()
    ticket = F.xxhash64(F.lit(seed), "host", "path")
    parts = [rows.where(F.col("verdict") == v).orderBy(ticket, "host", "path").limit(most) for v in ("allow", "block")]
    return parts[0].unionByName(parts[1])


def trained(labelled: DataFrame) -> LogisticRegressionModel | str:
    """Fit the small table, or the one verdict there is (``allow`` without any row)."""
    verdicts = sorted(r["verdict"] for r in labelled.select("verdict").distinct().limit(2).collect())
    if len(verdicts) < 2:
        return verdicts[0] if verdicts else "allow"
    # One sorted partition: sums, and so the model, come out the same in every run.
    rows = featured(labelled.coalesce(1).sortWithinPartitions("host", "path", "verdict"))
    rows = rows.withColumn("label", (F.col("verdict") == "block").cast("double"))
    return LogisticRegression(regParam=0.01, maxIter=50).fit(rows)


def judged(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Judge each URL: ``page_id, url, host, path, rule, verdict, block_score``.

    The verdict is that of the longest rule that fits, else that of a logistic
    regression on hashed character n-grams of host and path, fitted to the small
    table ``labelled`` (``host, path, verdict``); without one, to at most
    ``LABELLED`` URLs of each verdict that the rules decide.  ``block_score`` is
    the model's probability of ``block``.

    A null URL or one without ``://`` has an empty host and path; no rule fits
    it and the model judges it.  Repeated rows are judged one by one; with one
    verdict among the labelled rows that verdict is the model, without any it is
    ``allow``; no rows give no rows.  Other columns are not read.
    """
    rows = ruled(parsed(pages), rules)
    if labelled is None:
        labelled = staged(labelled_from_rules(rows), "labelled_urls")
    model = trained(labelled)
    if isinstance(model, str):
        scored = rows.withColumn("block_score", F.lit(float(model == "block")))
    else:
        scored = model.transform(featured(rows))
        scored = scored.withColumn("block_score", vector_to_array("probability")[1])
    learned = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", learned).alias("verdict"), "block_score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
