"""URL filters: a fixed rule list, and association rules for the urls it leaves open.

All steps are DataFrame operations and Spark's FP-growth. A rule ``host/path`` fits its host and
all subdomains if the url's path starts with its path; the longest rule that fits decides.

The method. Distinct urls are labelled: ``block`` if the list blocks them, their host holds one of
``SEED_WORDS`` or the caller's own labels (``url``, ``label``) say so; all others are ``open``, so that a
combination seen mostly on unlabelled urls is no rule. The tokens of a url are words of its host, parts
of its path and names of its query parameters. FP-growth mines the combinations of up to ``LONGEST``
tokens that occur on at least ``MIN_SUPPORT`` of all urls, and ``MIN_COUNT`` urls, that are blocked.

* Only tokens that are themselves so frequent on blocked urls take part: no other can be in a rule.
* Tokens that occur on the same urls are one: the first by name stands for all of them.
* A token of which all urls are blocked is a rule by itself, as sure as can be, so that nothing it is
  a part of can be one: it takes part in no combination.
* A url with more than ``BASKET`` such tokens is dealt into baskets, so that any ``LONGEST`` of its
  tokens meet in one of them: its tokens are cut into groups, and a basket holds ``LONGEST`` groups.
  That counts some combinations more than once and none too few; so FP-growth names candidates, and
  each candidate's counts are then taken exactly, over all urls, by the inverted index.

A combination of which at least ``MIN_CONFIDENCE`` of all urls are blocked becomes a rule, unless a
part of it is a rule of no less confidence. Rules are filed in an inverted index under their rarest
token; the tokens of a url fetch the rules filed under them, and a rule matches if all its tokens
are there. Open urls that match a rule are blocked, all others are allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path and is allowed; equal
urls get equal verdicts; an empty table gives no rule and an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored, table

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SEED_WORDS = ("adult", "ads", "bets", "casino", "malware", "phishing", "pills", "porn", "spam", "viagra")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COUNT, LONGEST, BASKET, BROADCAST_ROWS = 0.001, 0.9, 10, 3, 9, 200_000
_TOKENS_SCHEMA = "array<string>"


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def decided(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null. The list is the caller's, so it fits the driver."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` words of the host, ``p:`` parts of the path, ``q:`` parameter names."""
    some = lambda prefix, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    parts = F.filter(F.split(path, r"[/._\-]+"), lambda x: ~x.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(some("h:", F.split(host, r"[.:@\-]")), some("p:", parts), some("q:", names)))


def _baskets(tokens: Column) -> Column:
    """An array of baskets in which any LONGEST of the tokens meet: one for few tokens."""
    size = BASKET // LONGEST
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / size)), lambda g: F.slice(tokens, (g * size + 1).cast("int"), F.lit(size)))
    at = F.sequence(F.lit(0), F.size(groups) - 1)
    of = lambda start: F.filter(at, lambda i: i > start)
    dealt = F.flatten(F.transform(at, lambda a: F.flatten(F.transform(of(a), lambda b: F.transform(of(b), lambda c: F.concat(F.get(groups, a.cast("int")), F.get(groups, b.cast("int")), F.get(groups, c.cast("int"))))))))
    return F.when(F.size(tokens) > BASKET, dealt).otherwise(F.array(tokens))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _filed(rules: DataFrame, often: DataFrame) -> DataFrame:
    """``rules`` (tokens, ...) with key: their rarest token by ``often`` (t, n)."""
    rest = [c for c in rules.columns if c != "tokens"]
    return rules.select("*", F.explode("tokens").alias("t")).join(often, "t").groupBy("tokens", *rest).agg(F.min_by("t", F.struct("n", "t")).alias("key"))


def _matched(urls: DataFrame, filed: DataFrame, n: int) -> DataFrame:
    """Each of ``urls`` (with tokens) with each of the rules whose tokens it holds all."""
    rest = [F.col(c) for c in filed.columns if c not in ("tokens", "key")]
    fetched = urls.select("*", F.explode("tokens").alias("key")).join(_sized(filed.select("key", F.col("tokens").alias("needs"), *rest), n), "key")
    return fetched.filter(F.size(F.array_except("needs", "tokens")) == 0).drop("key")


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(tokens, confidence, support, key): pruned combinations that foretell ``block``.

    ``labelled`` has tokens and label, a row for each url. ``key`` is the rule's rarest token.
    """
    spark = labelled.sparkSession
    labelled = stored(labelled.select(F.col("tokens").cast(_TOKENS_SCHEMA).alias("tokens"), (F.col("label") == "block").alias("bad"), F.monotonically_increasing_id().alias("id")), "labelled-urls")
    total = labelled.count()
    least = max(min_count, -(-int(min_support * total * 1_000_000) // 1_000_000))
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, key string")
    seen = labelled.select("bad", "id", F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    often = stored(seen, "url-tokens")
    # tokens that stand on the same urls are one
    twins = often.filter(F.col("n_bad") >= least).groupBy("n", "n_bad", "x", "y").agg(F.min("t").alias("t"))
    useful = stored(twins.select("t", (F.col("n") == F.col("n_bad")).alias("sure")), "url-useful")
    n_useful = useful.count()
    if not n_useful:
        return none
    singles = useful.filter("sure").select(F.array("t").alias("tokens"))
    bad = labelled.filter("bad").select("id", F.explode("tokens").alias("t")).join(_sized(useful.filter("not sure").select("t"), n_useful), "t").groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("tokens"))
    items = bad.select(F.explode(_baskets(F.col("tokens"))).alias("items"))
    items = stored(items, "url-baskets")
    n_items = items.count()
    named = singles
    if n_items:
        # shares are of all baskets, of which there may be more than urls
        model = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / n_items, 1.0)).fit(items)
        named = singles.union(model.freqItemsets.filter(F.size("items") <= LONGEST).select(F.array_sort("items").alias("tokens")).distinct())
    filed = stored(_filed(named, often), "url-candidates")
    counted = _matched(labelled, filed, filed.count()).groupBy("needs").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    sure = counted.filter((F.col("n_bad") >= least) & (F.col("n_bad") / F.col("n") >= min_confidence))
    found = stored(sure.select(F.col("needs").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / total).alias("support")), "url-rules")
    # a rule is superfluous if one of its parts is a rule that is as sure; it has few parts
    parts = F.array(*[F.array_compact(F.array(*[F.get("tokens", F.lit(i)) for i in range(LONGEST) if m >> i & 1])) for m in range(1, 2**LONGEST)])
    smaller = found.select("tokens", "confidence", F.explode(F.array_distinct(parts)).alias("part")).filter((F.size("part") > 0) & (F.size("part") < F.size("tokens")))
    wider = smaller.join(found.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure")), "part").filter("sure >= confidence").select("tokens").distinct()
    return stored(_filed(found.join(wider, "tokens", "left_anti"), often), "url-index")


def judge(pages: DataFrame, rules: dict[str, str] = RULES, seed_words: tuple[str, ...] = SEED_WORDS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict and mined (the tokens of the surest mined rule).

    ``labels`` (url, label) are further labels of urls, beside the rule list's and the seed words'.
    """
    url = F.col("url").cast("string")
    base = pages.select("page_id", url.alias("url")).withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    base = stored(base.withColumn("rule", decided(F.col("host"), F.col("path"), rules)), "urls")
    table_of = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    once = base.filter("host <> ''").select("url", "host", "path", "rule").distinct().select("url", "rule", tokens.alias("tokens"))
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{w}") for w in seed_words]).cast(_TOKENS_SCHEMA))
    bad = F.coalesce(table_of[F.col("rule")] == "block", F.lit(False)) | seeded
    if labels is not None:
        told = labels.select(F.col("url").cast("string").alias("url"), (F.col("label") == "block").alias("told")).groupBy("url").agg(F.bool_or("told").alias("told"))
        once, bad = once.join(told, "url", "left"), bad | F.coalesce("told", F.lit(False))
    once = stored(once.withColumn("label", F.when(bad, "block").otherwise("open")), "urls-once")
    filed = mined_rules(once, min_support, min_confidence, min_count)
    matches = _matched(once.filter("rule is null").select("url", "tokens"), filed, filed.count()).groupBy("url").agg(F.max_by("needs", F.struct("confidence", "needs")).alias("mined"))
    judged = base.join(matches, "url", "left")
    mined = F.when(F.col("rule").isNull(), F.col("mined"))
    verdict = F.coalesce(table_of[F.col("rule")], F.when(mined.isNotNull(), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), mined.alias("mined"))


def op4_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("mined", " ").alias("mined"))
