"""URL filter by the likelihood ratio of two character models.

Variable-order Markov models of accepted and of rejected URLs are learned from those that a rule decides. The score of
a URL is the difference of its log likelihoods over its length; URLs that no rule decides are blocked below a threshold
that is calibrated on accepted URLs held out from the models. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.session import materialize

from .common import lower_ascii

#: verdict, host, start of the path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ORDER = 4
#: Share of accepted held-out URLs that the threshold lets through.
KEEP = 0.98
START = "\x02"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits host and path: struct of its length, its string and its verdict."""
    fits = [F.when(((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path)),
                   F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")))
            for verdict, host, path in rules]
    return F.array_max(F.filter(F.array(*fits), lambda r: r.isNotNull()))


def strings(text: str, order: int) -> Column:
    """All runs of up to ``order + 1`` characters that end at a character of ``text``, as (depth, s)."""
    ends = F.sequence(F.lit(2), F.length(text))

    def of(d: int) -> Column:  # no default arguments in the lambdas: a second one is the element's index
        return F.transform(F.filter(ends, lambda i: i > d), lambda i: F.struct(F.lit(d).alias("depth"), F.substring(text, i - d, F.lit(d + 1)).alias("s")))

    runs = [of(d) for d in range(order + 1)]
    return F.when(F.length(text) > 1, F.concat(*runs))


def char_models(urls: DataFrame, order: int) -> DataFrame:
    """s, ratio: log of P(last character of s | the ones before) of accepted over rejected, for all strings seen.

    Witten-Bell: each context mixes its counts with the next shorter context in proportion to the number of different
    characters seen after it; the shortest mixes with 1/256.
    """
    counted = urls.select("accepted", F.explode(strings("text", order)).alias("g")).groupBy("g.depth", "g.s").agg(
        F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    counted = materialize(counted.withColumn("context", F.expr("left(s, depth)")), "strings")
    spread = counted.groupBy(F.col("depth").alias("d"), F.col("context").alias("c")).agg(
        *(f(v).alias(f"{n}_{v}") for v in ("yes", "no") for n, f in (("sum", F.sum), ("kinds", lambda x: F.sum((F.col(x) > 0).cast("long"))))))
    near = counted.join(spread, (F.col("depth") == F.col("d")) & (F.col("context") == F.col("c")))
    level: DataFrame | None = None
    for depth in range(order + 1):
        at = near.where(F.col("depth") == depth)
        if level is None:
            at = at.withColumns({"below_yes": F.lit(1 / 256), "below_no": F.lit(1 / 256)})
        else:
            below = level.select(F.col("s").alias("end"), F.col("p_yes").alias("below_yes"), F.col("p_no").alias("below_no"))
            at = at.join(below, F.expr(f"substring(s, 2, {depth})") == F.col("end"))
        p = {f"p_{v}": F.when(F.col(f"sum_{v}") > 0, (F.col(v) + F.col(f"kinds_{v}") * F.col(f"below_{v}")) / (F.col(f"sum_{v}") + F.col(f"kinds_{v}")))
             .otherwise(F.col(f"below_{v}")) for v in ("yes", "no")}
        level = materialize(at.withColumns(p).select("s", "yes", "no", "p_yes", "p_no"), "level")
        ratio = level.select("s", F.log(F.col("p_yes") / F.col("p_no")).alias("ratio"))
        kept = ratio if depth == 0 else kept.unionByName(ratio)
    return kept


def url_scores(urls: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """at, score: the mean over the characters of ``text`` of the ratio at the longest context that the model holds.

    The model is met once for each different run of ``order + 1`` characters, by shuffled joins with its ends.
    """
    spots = urls.where("length(text) > 1").select("at", "text", F.explode(F.sequence(F.lit(2), F.length("text"))).alias("i"))
    spots = spots.select("at", F.substring("text", F.greatest(F.col("i") - order, F.lit(1)), F.least("i", F.lit(order + 1))).alias("run"))
    ends = spots.select("run").distinct().select(
        "run", F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda n: F.right("run", n))).alias("s"))
    longest = ends.join(model, "s").groupBy("run").agg(F.max_by("ratio", F.length("s")).alias("ratio"))
    return spots.join(longest, "run", "left").groupBy("at").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("score"))


def judged_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, order: int = ORDER,
                keep: float = KEEP) -> DataFrame:
    """key, host, path, rule, verdict and score (null where a rule decides).

    A null URL and one without ``://`` have an empty host and path, which no rule fits; the models judge the URL's text
    from the host on, and an empty one, which has no characters, scores 0. Without both kinds of decided URLs the
    threshold is 0 and every URL scores 0 or is allowed. One URL in five, by hash, calibrates instead of training.
    """
    parts = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select("key", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("found", rule_of(rules)).withColumn("at", F.monotonically_increasing_id())
    text = F.concat(F.lit(START), "host", F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit("")))
    base = materialize(ruled.select("key", "host", "path", "at", "found.rule", F.col("found.verdict").alias("ruled"), text.alias("text"),
                                    (F.pmod(F.xxhash64("url", F.lit(3)), F.lit(5)) == 0).alias("held")), "urls")
    known = base.where("ruled IS NOT NULL").select("text", "held", (F.col("ruled") == "allow").alias("accepted"), "at")
    model = materialize(char_models(known.where("NOT held"), order), "model")
    trial = url_scores(known.where("held AND accepted").select("at", "text"), model, order)
    found = trial.agg(F.percentile_approx("score", F.lit(1 - keep), F.lit(10_000)).alias("t")).first().t
    threshold = min(found or 0.0, 0.0)  # what the accepted model fits better is never blocked
    asked = url_scores(base.where("ruled IS NULL").select("at", "text"), model, order)
    asked = asked.select(F.col("at").alias("of"), "score")
    full = base.join(asked, F.col("at") == F.col("of"), "left").withColumn("score", F.when(F.col("ruled").isNull(), F.coalesce("score", F.lit(0.0))))
    verdict = F.coalesce("ruled", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return full.select("key", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4(pages: DataFrame) -> DataFrame:
    return judged_urls(pages).withColumnRenamed("key", "page_id")
