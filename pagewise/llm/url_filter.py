"""URL filters by association rules.

Fixed rules (host, path) judge the urls they fit, the longest winning.  Those
verdicts are also the labels that the rest is learned from: a url's tokens
(scheme, parts of the host, shapes of all segments of the path, those after the
fourth without their position, all query keys) make a transaction, its verdict one more item, and Spark's FP-growth mines the
combinations.  Rules whose consequent is a verdict are pruned by support (a
share of the labelled urls, and ``MIN_ROWS`` at least), confidence and length
(``MAX_TOKENS`` tokens), and a rule that a shorter one with the same verdict and no less
confidence covers is dropped.  Each rule is indexed under its rarest token;
token sets (pages that look alike are one set) meet the index by an equality
join on tokens, the other tokens are checked, and the most confident rule
decides; without one a url is allowed.

FP-growth lists every frequent subset of a transaction.  Where one has more than
``FP_ITEMS`` frequent tokens that would not end, and the same rules are mined
level by level: a set is only extended while it has the support, isn't sure of
its verdict yet, and no token of it goes without saying given the others, as
every rule of a longer set would be covered.  That takes at most n choose
``MAX_TOKENS`` sets for a url of n frequent tokens.

Only DataFrame functions and Spark ML's FP-growth are used.

Defined results: a null url, or one without ``://``, has empty host and path,
no tokens and the method's default verdict; rows that repeat and null page_ids
are judged like any other; very long urls (very many segments or query keys)
are judged whole; with no labelled url nothing is blocked by the
method; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import stored

#: Verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MIN_ROWS = 5  # labelled urls that a rule must have been seen in
MAX_TOKENS = 3  # of a rule
FP_ITEMS = 12  # frequent tokens of a url up to which FP-growth mines
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        "url",
        F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """The url's tokens, distinct and sorted; none without a host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = F.transform(
        segments,
        lambda s, i: F.concat(F.lit("path"), F.when(i < 4, (i + 1).cast("string")).otherwise(""), F.lit("="), F.regexp_replace(s, r"(?<=[0-9])[0-9]+", "0")),
    )
    query = F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1)
    found = F.concat(
        F.array(
            F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
            F.concat(F.lit("host="), host),
            F.concat(F.lit("tld="), F.element_at(parts, -1)),
            F.concat(F.lit("site="), F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")),
            F.concat(F.lit("sub="), F.when(n > 2, F.element_at(parts, 1)).otherwise("")),
        ),
        shape,
        F.transform(F.regexp_extract_all(query, F.lit(r"(?:^|&)([^=&#]+)="), F.lit(1)), lambda k: F.concat(F.lit("query="), k)),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(found)))


def _by_growth(sets: DataFrame, least: int, total: int, most: int) -> DataFrame:
    """antecedent, verdict, n (urls with both), of (of urls with the antecedent): FP-growth over (tokens, label, n)."""
    rows = sets.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    items = rows.select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), F.col("label")))).alias("items"))
    # a support a little below the count: a share is no exact number
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total).fit(items).freqItemsets
    is_verdict = lambda x: x.startswith("verdict:")
    found = found.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("antecedent"), F.get(F.filter("items", is_verdict), F.lit(0)).alias("verdict"), "freq")
    found = stored(found.filter(F.size("antecedent").between(1, most)), "url_itemsets")
    whole = found.filter("verdict is null").select("antecedent", F.col("freq").alias("of"))
    both = found.filter("verdict is not null").select("antecedent", F.substring("verdict", 9, 100).alias("verdict"), F.col("freq").alias("n"))
    return both.join(whole, "antecedent")


def _by_level(sets: DataFrame, least: int, most: int) -> DataFrame:
    """The same, level by level; of longer sets only those that can have a rule no shorter one covers."""
    sets = stored(sets.groupBy("tokens").agg(*[F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block")]).withColumn("id", F.monotonically_increasing_id()), "url_sets")
    held = sets.select("id", F.explode("tokens").alias("token"))
    votes = sets.select("id", "allow", "block")
    now, out, before = held.select("id", F.array("token").alias("a")), None, None
    for size in range(1, most + 1):
        now = stored(now, "url_level")
        counts = now.join(votes, "id").groupBy("a").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        counts = stored(counts.filter(F.greatest("allow", "block") >= least).withColumn("of", F.col("allow") + F.col("block")), "url_counts")
        out = counts if out is None else out.unionByName(counts)
        if size == most:
            break
        go_on = counts.filter(((F.col("allow") >= least) & (F.col("block") > 0)) | ((F.col("block") >= least) & (F.col("allow") > 0)))
        if before is not None:  # each set with a token less goes on, and holds for more urls
            less = go_on.select("a", "of", F.explode("a").alias("gone")).select("a", "of", F.array_remove("a", F.col("gone")).alias("b"))
            less = less.join(before.select(F.col("a").alias("b"), F.col("of").alias("wider")), "b").filter("wider > of")
            go_on = go_on.join(less.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == size).select("a"), "a", "left_semi")
        before = stored(go_on, "url_open")
        now = now.join(before.select("a"), "a", "left_semi").join(held, "id").filter(F.col("token") > F.element_at("a", -1)).select("id", F.concat("a", F.array("token")).alias("a"))
    rules = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in ("allow", "block")]))
    return out.select(F.col("a").alias("antecedent"), "of", rules.alias("r")).select("antecedent", "r.verdict", "r.n", "of").filter(F.col("n") >= least)


def mine(sets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, most: int = MAX_TOKENS, fp_items: int = FP_ITEMS) -> DataFrame:
    """Rules (id, antecedent, verdict, confidence, support) from labelled transactions (tokens, label)."""
    sets = stored(sets.groupBy("tokens", "label").agg(F.count(F.lit(1)).alias("n")), "url_labelled")
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_ROWS, -int(-min_support * total // 1))
    held = sets.select("tokens", "label", "n", F.explode("tokens").alias("token"))
    often = held.groupBy("token").agg(F.sum("n").alias("all")).filter(F.col("all") >= least).select("token")
    kept = held.join(often, "token", "left_semi").groupBy("tokens", "label", "n").agg(F.array_sort(F.collect_list("token")).alias("kept"))  # tokens of one url
    kept = stored(kept.groupBy(F.col("kept").alias("tokens"), "label").agg(F.sum("n").alias("n")), "url_frequent")
    longest = kept.agg(F.max(F.size("tokens"))).first()[0] or 0
    found = _by_growth(kept, least, total, most) if longest <= fp_items else _by_level(kept, least, most)
    confidence = F.col("n") / F.col("of")
    rules = found.select("antecedent", "verdict", confidence.alias("confidence"), (F.col("n") / total).alias("support")).filter(F.col("confidence") >= min_confidence)
    rules = stored(rules.withColumn("id", F.xxhash64("antecedent", "verdict")), "url_rules")
    # a rule is covered by one with a token less; what that covers in turn is covered by the shorter ones
    less = rules.filter(F.size("antecedent") > 1).select(
        "id", "verdict", "confidence", F.explode("antecedent").alias("gone"), "antecedent"
    ).select("id", "verdict", F.col("confidence").alias("c"), F.array_remove("antecedent", F.col("gone")).alias("antecedent"))
    covered = less.join(rules.select("antecedent", "verdict", "confidence"), ["antecedent", "verdict"]).filter("confidence >= c").select("id").distinct()
    return rules.join(covered, "id", "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, verdict, confidence, antecedent of the best rule for each distinct token set that any rule matches."""
    seen = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.select("id", F.explode("antecedent").alias("token")).join(seen, "token")
    rarest = posted.groupBy("id").agg(F.min(F.struct("n", "token")).alias("r")).select("id", F.col("r.token").alias("token"))
    index = rarest.join(rules, "id").select("token", "antecedent", "verdict", "confidence", "support")
    asked = sets.select("tokens", F.explode("tokens").alias("token"))
    found = asked.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct("confidence", F.col("support"), -F.size("antecedent"), F.col("verdict"), F.col("antecedent"))
    return found.groupBy("tokens").agg(F.max(order).alias("best")).select("tokens", F.col("best.verdict").alias("mined"), "best.confidence", "best.antecedent")


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, and why: confidence and antecedent of the mined rule (null where a fixed one decides)."""
    urls = parsed(pages)
    urls = urls.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), tokens(F.col("host"), F.col("path"), F.coalesce(F.col("url"), F.lit(""))).alias("tokens"))
    urls = stored(urls, "urls")
    labelled = urls.filter("fit is not null").select("tokens", F.col("fit.verdict").alias("label"))
    open_sets = urls.filter("fit is null and size(tokens) > 0").select("tokens").distinct()
    if labelled.take(1):
        best = matched(open_sets, mine(labelled, min_support, min_confidence))
    else:
        best = open_sets.select("tokens", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"), F.col("tokens").alias("antecedent")).limit(0)
    out = urls.join(best, "tokens", "left")
    free = F.col("fit").isNull()
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.col("mined"), F.lit(DEFAULT)).alias("verdict"),
        F.when(free, F.col("confidence")).alias("confidence"),
        F.when(free, F.col("antecedent")).alias("antecedent"),
    )
