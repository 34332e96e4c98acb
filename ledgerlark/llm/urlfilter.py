"""URL filter: rules first, then a character language-model ratio, all in DataFrame functions.

Two smoothed variable-order Markov models (contexts of two characters, backing off to one and none by the
Witten-Bell weights) are counted over the URLs that rules accept and reject. A URL's score is the difference of the
two log-likelihoods divided by its length. A fifth of the labelled URLs is held back from counting; the threshold is
the score that parts accepted from rejected best there (mean of both classes' accuracies).

Characters fold into 40 symbols, so a model has at most 40**3 entries whatever the input: it is held as one array and
looked up by position, and scoring needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_?=&%#:~"  # 0: any digit, ~: anything else; symbol 0 stands before the start
SIZE = 40
#: (host, path, verdict): fixed by the contract.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first) and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The url as an array of symbol numbers from 1."""
    folded = F.regexp_replace(F.regexp_replace(_ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), r"(?s)[^a-z0./\-_?=&%#:]", "~")
    return F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def train(labelled: DataFrame) -> DataFrame:
    """From columns (codes, good): one row with ``ratio``, the array of log-probability differences by context and symbol."""
    at = lambda i: F.when(i >= 1, F.element_at("codes", F.greatest(i, F.lit(1)))).otherwise(0)
    grams = labelled.where(F.size("codes") > 0).select("good", F.explode(F.transform(F.sequence(F.lit(1), F.size("codes")), lambda i: at(i - 2) * SIZE**2 + at(i - 1) * SIZE + F.element_at("codes", i))).alias("g"))
    counts = stored(grams.groupBy("g").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r")), "url-grams")  # at most SIZE**3 rows
    spark = labelled.sparkSession
    total = lambda by, name: counts.groupBy(by.alias(name)).agg(*[F.sum(x).alias(f"{name}_{x}") for x in "ar"], *[F.count_if(F.col(x) > 0).alias(f"{name}_t{x}") for x in "ar"])
    two = counts.groupBy((F.col("g") % SIZE**2).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    one = counts.groupBy((F.col("g") % SIZE).alias("c")).agg(F.sum("a").alias("c_a"), F.sum("r").alias("c_r"))
    context1 = two.groupBy(F.floor(F.col("g") / SIZE).cast("int").alias("x1")).agg(*[F.sum(x).alias(f"x1_{x}") for x in "ar"], *[F.count_if(F.col(x) > 0).alias(f"x1_t{x}") for x in "ar"])
    alls = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(f"n_{x}") for x in "ar"]).withColumn("k", F.lit(0))
    cells = spark.range(SIZE**3).select(F.col("id").cast("int").alias("g")).select("g", (F.col("g") % SIZE**2).alias("b"), (F.col("g") % SIZE).alias("c"), F.floor(F.col("g") / SIZE).cast("int").alias("x2"), F.floor(F.col("g") % SIZE**2 / SIZE).cast("int").alias("x1"), F.lit(0).alias("k"))
    for table, key in ((counts.select("g", F.col("a").alias("g_a"), F.col("r").alias("g_r")), "g"), (two.select(F.col("g").alias("b"), F.col("a").alias("b_a"), F.col("r").alias("b_r")), "b"), (one, "c"), (total(F.floor(F.col("g") / SIZE).cast("int"), "x2"), "x2"), (context1, "x1"), (alls, "k")):
        cells = cells.join(F.broadcast(table), key, "left")  # each at most SIZE**3 rows
    cells = cells.fillna(0)

    def log_p(x: str) -> Column:
        p1 = (F.col(f"c_{x}") + 1) / (F.col(f"n_{x}") + SIZE)
        p2 = F.when(F.col(f"x1_{x}") > 0, (F.col(f"b_{x}") + F.col(f"x1_t{x}") * p1) / (F.col(f"x1_{x}") + F.col(f"x1_t{x}"))).otherwise(p1)
        return F.log(F.when(F.col(f"x2_{x}") > 0, (F.col(f"g_{x}") + F.col(f"x2_t{x}") * p2) / (F.col(f"x2_{x}") + F.col(f"x2_t{x}"))).otherwise(p2))

    diff = cells.select("g", (log_p("a") - log_p("r")).alias("d"))
    return diff.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda e: e["d"]).alias("ratio"))


def scored(codes: Column, ratio: Column) -> Column:
    """Length-normalised log-likelihood difference; 0 for an empty url."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("x"))
    fold = F.aggregate(codes, start, lambda acc, c: F.struct((acc["s"] + F.element_at(ratio, acc["x"] * SIZE + c + 1)).alias("s"), ((acc["x"] * SIZE + c) % SIZE**2).alias("x")))
    return fold["s"] / F.greatest(F.size(codes), F.lit(1))


def calibrated(labelled: DataFrame, ratio: Column) -> DataFrame:
    """From (codes, good): one row with the threshold that parts the classes best, in steps of 1/64; 0 without both classes."""
    bins = labelled.withColumn("ratio", ratio).select("good", F.floor(scored(F.col("codes"), F.col("ratio")) * 64).cast("long").alias("bin")).groupBy("bin").agg(F.count_if("good").alias("a"), F.count_if(~F.col("good")).alias("r"))
    # bins are few: scores are differences of log-probabilities of smoothed models
    listed = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "a", "r"))).alias("bins"), F.sum("a").alias("na"), F.sum("r").alias("nr"))
    part = lambda b: F.aggregate("bins", F.lit(0.0), lambda acc, e: acc + F.when(e["bin"] >= b["bin"], e["a"] / F.col("na")).otherwise(e["r"] / F.col("nr")))
    best = F.array_max(F.transform("bins", lambda b: F.struct(part(b).alias("gain"), (-F.abs(b["bin"])).alias("near"), b["bin"].alias("bin"))))
    return listed.select(F.coalesce(F.when((F.col("na") > 0) & (F.col("nr") > 0), best["bin"] / 64), F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, *, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (longest that fits, else null), verdict (the rule's, else the method's), score.

    Without rule-labelled URLs of both kinds the threshold is 0 and equal models score 0, so all else is allowed. Null
    and empty URLs score 0. Repeated rows get a row each; other columns are not read; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), symbols(F.col("url")).alias("codes"), F.pmod(F.xxhash64("url"), F.lit(5)).alias("fold"))
    known = ruled.where("ruled is not null").select("codes", "fold", (F.col("ruled") == "allow").alias("good"))
    ratio = stored(train(known.where("fold <> 0")), "url-model").scalar()
    threshold = stored(calibrated(known.where("fold = 0"), ratio), "url-threshold").scalar()
    scores = ruled.withColumn("ratio", ratio).select("page_id", "host", "path", "rule", "ruled", scored(F.col("codes"), F.col("ratio")).alias("score"))
    return scores.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
