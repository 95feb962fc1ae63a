"""URL filters: rules first, then the log-likelihood ratio of two character models.

URLs that rules allow or block train one character model each: a variable-order Markov model, in which every
character is judged after the longest context it has been seen in, smoothed down the orders (Witten-Bell).
The other URLs are judged by the difference of log-likelihoods a character, against a threshold calibrated on
the ruled ones. All of it is DataFrame operations. Characters are taken as they are, and both models have all
grams of the ruled URLs up to ``ORDER`` characters, so they grow with the table: they are shuffled and joined,
never sent whole. What follows which context is worked out once for each distinct gram of the URLs to be judged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.llm import store

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 6
# Every join here is with a table that grows with the urls. Without the hint Spark sends those of up to 10 compressed MB to all
# tasks, through the driver, where each is many times as large and up to a dozen are held at once.
JOIN = "merge"
BEGIN, END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one. Rules are few and given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _read(url: Column) -> Column:
    """What the models read: the url after its scheme, the host lower-cased, between marks for its ends."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.concat(F.lit(BEGIN), F.translate(host, _UPPER, _LOWER), F.substring(after, F.length(host) + 1, F.length(after)), F.lit(END))


def _grams(df: DataFrame, order: int, *keep: str) -> DataFrame:
    """``gram``: the last character of each place with up to ``order - 1`` before it; the start mark is given."""
    place = F.explode(F.sequence(F.lit(2), F.length("chars"))).alias("p")
    first = F.greatest(F.col("p") - (order - 1), F.lit(1))
    return df.where(F.length("chars") >= 2).select("chars", *keep, place).select(*keep, F.substring("chars", first, F.col("p") - first + 1).alias("gram"))


def train(ruled: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram`` and ``ratio``: the log of the two models' probabilities of its last character after the rest.

    ``ruled`` has ``chars``, ``accepted`` (boolean) and ``weight``. Counts are over all of it. A context that
    one side has never seen leaves that side with its shorter context.
    """
    longest = _grams(ruled, order, "accepted", "weight")
    counts = longest.groupBy("gram").agg(*[F.sum(F.when(F.col("accepted") == side, F.col("weight")).otherwise(0)).alias(k) for k, side in (("n_a", True), ("n_r", False))])
    counts = store.stored(counts, "counts")
    characters = counts.select(F.substring("gram", -1, 1).alias("c")).agg(F.count_distinct("c")).first()[0]
    models = None
    below = None
    for k in range(1, order + 1):
        # Places at the start have less before them than k - 1 characters; their grams belong to lower orders too.
        grams = counts.where(F.length("gram") >= k).groupBy(F.substring("gram", -k, k).alias("gram")).agg(F.sum("n_a").alias("n_a"), F.sum("n_r").alias("n_r"))
        grams = grams.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("shorter", F.substring("gram", 2, k - 1))
        seen = grams.groupBy("context").agg(
            F.sum("n_a").alias("c_a"), F.sum("n_r").alias("c_r"), F.sum((F.col("n_a") > 0).cast("int")).alias("t_a"), F.sum((F.col("n_r") > 0).cast("int")).alias("t_r")
        )
        grams = grams.join(seen.hint(JOIN), "context")
        if below is None:
            grams = grams.withColumns({"q_a": F.lit(1.0 / (characters + 1)), "q_r": F.lit(1.0 / (characters + 1))})
        else:
            grams = grams.join(below.select(F.col("gram").alias("shorter"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r")).hint(JOIN), "shorter")
        smooth = lambda s: F.when(F.col(f"c_{s}") > 0, (F.col(f"n_{s}") + F.col(f"t_{s}") * F.col(f"q_{s}")) / (F.col(f"c_{s}") + F.col(f"t_{s}"))).otherwise(F.col(f"q_{s}"))
        below = store.stored(grams.select("gram", smooth("a").alias("p_a"), smooth("r").alias("p_r")), "order")
        models = below if models is None else models.unionByName(below)
    return models.select("gram", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def score(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``chars`` and ``score``: the mean over the characters of the ratio after the longest known context.

    Every distinct gram is looked up once, the longest order first; its ratio then goes to all places that have it.
    """
    urls = urls.select("chars", F.xxhash64("chars").alias("u"))
    places = _grams(urls, order, "u")
    known, ratio = places.select("gram").distinct(), F.lit(None).cast("double")
    for k in range(order, 0, -1):
        own = model.where(F.length("gram") == k).select(F.col("gram").alias(f"g{k}"), F.col("ratio").alias(f"r{k}"))
        known = known.join(own.hint(JOIN), F.when(F.length("gram") >= k, F.substring("gram", -k, k)) == F.col(f"g{k}"), "left").drop(f"g{k}")
        ratio = F.coalesce(ratio, f"r{k}")
    known = known.select("gram", F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    return places.join(known.hint(JOIN), "gram").groupBy("u").agg(F.avg("ratio").alias("score")).join(urls.hint(JOIN), "u").select("chars", "score")


def calibrate(scored: DataFrame) -> float:
    """The threshold, to 0.01, with the best balanced accuracy on ruled urls; 0 if one side has none.

    ``scored`` has ``score``, ``accepted`` and ``weight``. Only sums by hundredths of the score are ordered.
    """
    step = F.floor(F.col("score") * 100).cast("long")
    bins = scored.groupBy(step.alias("step")).agg(*[F.sum(F.when(F.col("accepted") == side, F.col("weight")).otherwise(0)).alias(k) for k, side in (("a", True), ("r", False))])
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    right = (F.sum("a").over(every) - F.coalesce(F.sum("a").over(below), F.lit(0))) / F.sum("a").over(every) + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)
    # Any cut above the bin below splits alike; the one nearest to 0 is taken.
    cut = F.greatest(F.least(F.lit(0), "step"), F.coalesce(F.lag("step").over(Window.orderBy("step")) + 1, F.lit(-(1 << 40))))
    best = bins.withColumns({"right": right, "cut": cut}).where("right is not null").orderBy(F.desc("right"), F.abs("cut"), "cut").first()
    return best.cut / 100 if best else 0.0


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decided) of every page.

    A null url, or one without ``://``, has an empty host and path and is judged by the models as it stands
    (null as empty). Equal urls get equal verdicts and are scored once. Where rules allow or block nothing there
    is one model less to hold against, and the threshold is 0: what isn't worse than that is allowed.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "chars": _read(F.col("url"))})
    ruled = rows.where("ruled is not null").groupBy("chars", (F.col("ruled") == "allow").alias("accepted")).agg(F.count(F.lit(1)).alias("weight"))
    ruled = store.stored(ruled, "ruled")
    model = store.stored(train(ruled, order), "model")
    threshold = calibrate(ruled.join(score(ruled.select("chars").distinct(), model, order).hint(JOIN), "chars"))
    scores = score(rows.where("ruled is null").select("chars").distinct(), model, order)
    scores = scores.withColumnRenamed("chars", "scored")
    out = rows.join(scores.hint(JOIN), (F.col("chars") == F.col("scored")) & F.col("ruled").isNull(), "left")
    judged = F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block")
    return out.select("id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), F.round("score", 6).alias("score"))


def op3_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
