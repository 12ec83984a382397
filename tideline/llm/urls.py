"""URL filters (operator 2): explicit host and path rules, then association rules mined by FP-growth. DataFrame functions only.

An explicit rule fits its host and all subdomains, if the path starts with the rule's; the longest wins (of equally long ones
the later). A url that none fits is judged by the method. Labels are of documents; a page shows the document whose id is the
number that ends its url's path, and is bad if that has quality 0 or is toxic. From the bad pages Spark's FP-growth mines
frequent combinations of tokens (host suffixes, path segments, query names; numbers and file endings left out). A
combination is a rule if MIN_PAGES bad pages at least have it, it is bad in CONFIDENCE of all labelled pages that have it and
LIFT times as often as a labelled page is, and no part of it is a rule. A rule is indexed under its rarest token; a
url that has this token is checked for the others. Urls are judged once each, whatever number of pages has them.

A null url, or one without ``://``, has an empty host and path and no tokens: allowed. Repeated rows are judged alike, and
count as pages of their own. A document with several labels is bad if one of them says so; null labels say nothing. Without
labels no rule is mined. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, table

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
CONFIDENCE = 0.8
LIFT = 1.5
#: Least share of the bad pages that have a rule's tokens, and their least number.
SUPPORT = 0.002
MIN_PAGES = 20
#: Sets of tokens (some hundred bytes each) up to which their index is broadcast.
INDEX = 20_000
#: The document that a page shows.
DOCUMENT = r"/([0-9]{1,18})/?(?:\.\w+)?$"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))
    segments = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, r"\.\w+$", "")))
    query = F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda q: F.concat(F.lit("query:"), F.substring_index(q, "=", 1)))
    every = F.flatten(F.array(F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), segments, query))
    return F.array_distinct(F.filter(every, lambda t: ~t.rlike(r"^(path|query):[0-9]*$")))


def _having(urls: DataFrame, sets: DataFrame) -> DataFrame:
    """urls(tokens, ...) joined with each of sets(antecedent) whose tokens it all has, through an inverted index of the sets' rarest
    tokens. Up to INDEX sets the index is broadcast, more go by a shuffle; urls are never broadcast, however small their file is."""
    few = sets.limit(INDEX + 1).count() <= INDEX
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df.hint("merge"))
    needed = sets.select("antecedent", F.explode("antecedent").alias("token"))
    found = urls.withColumn("token", F.explode("tokens"))
    often = found.join(small(needed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = needed.join(often, "token", "left").groupBy("antecedent").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return found.join(small(index), "token").where(F.size(F.array_intersect("tokens", "antecedent")) == F.size("antecedent")).drop("token")


def mine(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(antecedent array, confidence, support) of rules for bad pages, from pages(path, tokens) and labels(doc_id, quality, toxic)."""
    bad = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    shown = F.regexp_extract("path", DOCUMENT, 1)
    scratch = Scratch(pages.sparkSession)
    marked = scratch.keep(pages.select("tokens", F.when(shown != "", shown.cast("long")).alias("d")).hint("merge").join(bad, "d").select("tokens", "bad"), "marked")
    n, n_bad = marked.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    none = pages.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support long")
    if n_bad < MIN_PAGES:
        return none
    model = FPGrowth(itemsCol="tokens", minSupport=max(SUPPORT, MIN_PAGES / n_bad)).fit(marked.where("bad").select("tokens"))
    # a host's suffixes contain each other: one of them says it all
    sets = scratch.keep(model.freqItemsets.select(F.sort_array("items").alias("antecedent"), "freq").where(F.size(F.filter("items", lambda t: t.startswith("host:"))) <= 1), "sets")
    totals = _having(marked, sets).groupBy("antecedent").agg(F.count_if("bad").alias("support"), F.count(F.lit(1)).alias("total"))
    sure = totals.select("antecedent", (F.col("support") / F.col("total")).alias("confidence"), "support").where((F.col("confidence") >= CONFIDENCE) & (F.col("confidence") >= LIFT * n_bad / n))
    sure = scratch.keep(sure, "rules")
    larger = _having(sure.select(F.col("antecedent").alias("tokens")), sure.select("antecedent")).where(F.size("tokens") > F.size("antecedent")).select(F.col("tokens").alias("antecedent")).distinct()
    return scratch.keep(sure.join(larger, "antecedent", "left_anti"), "minimal")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule fits, from urls(url, tokens)."""
    return _having(urls.select("url", "tokens"), rules.select("antecedent")).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url)."""
    url = F.col("url")
    host, path = parts(url)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    pages = pages.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens(url, F.col("host"), F.col("path"))))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    # written: the expressions for tokens are large, and would stand in every plan below
    judged = Scratch(pages.sparkSession).keep(pages.withColumn("rule", rule).withColumn("fixed", verdict), "judged")
    mined = mine(judged.select("path", "tokens"), labels)
    open_ = judged.where("fixed is null and url is not null").groupBy("url").agg(F.first("tokens").alias("tokens"))
    hit = matched(open_, mined).select(F.col("url").alias("u"))
    out = judged.join(hit, F.col("url") == F.col("u"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("u").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


ORACLE_SQL = rf"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, r, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{_UPPER}', '{_UPPER.lower()}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) AS x(rh, rp, rv)),
e AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS fixed FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r),
k AS (SELECT r, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(string_split(path, '/'), lambda x: 'path:' || regexp_replace(x, '\.\w+$', '')),
        list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'query:' || string_split(x, '=')[1])), lambda x: NOT regexp_matches(x, '^(path|query):[0-9]*$')))) END AS toks FROM h),
bad AS (SELECT doc_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT r, toks, bad FROM h JOIN k USING (r) JOIN bad ON doc_id = TRY_CAST(regexp_extract(path, '{DOCUMENT}', 1) AS BIGINT)),
f AS (SELECT count(*) AS n, count(*) FILTER (bad) AS n_bad FROM m),
items AS (SELECT x FROM (SELECT unnest(toks) AS x FROM m WHERE bad) GROUP BY x HAVING count(*) >= {MIN_PAGES}),
o AS (SELECT r, bad, list_filter(toks, lambda x: list_contains(every, x)) AS toks FROM m, (SELECT coalesce(list(x), []) AS every FROM items)),
sets AS (SELECT r, bad, list_filter(toks, lambda x, i: (s >> (i - 1)) & 1 = 1) AS a FROM o, unnest(range(1, 1 << len(toks))) AS u(s)),
tried AS (SELECT a, count(*) AS total, count(*) FILTER (bad) AS n_set FROM sets WHERE len(list_filter(a, lambda x: starts_with(x, 'host:'))) <= 1 GROUP BY a),
sure AS (SELECT a FROM tried, f WHERE n_bad >= {MIN_PAGES} AND n_set >= greatest({MIN_PAGES}, {SUPPORT} * n_bad) AND n_set >= {CONFIDENCE} * total AND n_set / total >= {LIFT} * n_bad / n),
least AS (SELECT a FROM sure WHERE NOT EXISTS (SELECT 1 FROM sure z WHERE len(z.a) < len(sure.a) AND list_has_all(sure.a, z.a))),
hit AS (SELECT DISTINCT r FROM k JOIN least ON list_has_all(toks, a))
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN r IN (SELECT r FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN e USING (r)
"""
