"""Quality rules (operator 10): base counts, and Jensen-Shannon divergence from language references. DataFrame functions only.

Verdict of the method, for texts of MIN_WORDS words at least: the text's distributions over character classes, and over
the common words of a language, are compared with references. A reference is the mean distribution of the documents of
a language (of MIN_WORDS words at least, with few symbols); its common words are the COMMON most frequent words of these
documents, of any length and script. It is left out if they are so rare that a clean text of MIN_WORDS words may well
hold none. A text is kept if the reference of any language accepts it, so a wrong or missing lang does no harm; a text that
holds no common word of any reference has no divergences. The divergence of common words is judged only if the text has
MIN_COMMON_WORDS of them; a text with fewer is judged by the share of its words that are common alone.

Three passes: one finds each language's CANDIDATES frequent words with a sketch of fixed size over all its words; one
measures every document and counts the candidates in it, and is written; the references (exact counts over all documents,
of which the COMMON largest are taken) and the verdicts come from that small table. Every language has a reference: up to
LANGUAGES of them stand in the plan, more are joined as a table.

Words in repeated 3-word windows are found by sorting the windows' 64-bit hashes within the row, whatever its length.
A null text counts as empty: n_words 0, base_failed. Repeated rows are judged alike, other columns are ignored. Of equally
frequent words the first in code point order is taken. The base rules decide alone for the documents of a language without
a reference, and for all if there is no reference. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, Scratch, table

MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
MARKS = "[.,;:!?\"'()\\[\\]{}]"
COMMON = 16
#: Words of a language whose counts are exact, and items that the sketch which finds them tracks.
CANDIDATES = 32
TRACKED = 8192
MIN_COMMON_WORDS = 12
#: References that are written into the plan as literals; more are joined as a table, with the same results.
LANGUAGES = 32
#: Largest accepted divergences (bits): of character classes, of common words.
MOST_CLASS = 0.06
MOST_COMMON = 0.5
#: Least accepted share of common words, as a part of the language's own share.
LEAST_COMMON = 0.22
_CLASSES = ("lower", "upper", "digit", "blank", "symbol", "mark", "other")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def split_words(text: Column) -> Column:
    """Through single-character replacements and a plain split, which need no regular expression."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _with_words(docs: DataFrame) -> DataFrame:
    """Adds ``_text``, ``_words``, n_words, word_chars and n_symbols."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("_words", split_words(F.col("_text")))
    chars = F.length(F.array_join("_words", "")).cast("long")
    return docs.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": chars, "n_symbols": _count(F.col("_text"), SYMBOLS)})


def _fit() -> Column:
    """Whether a text counts for its language's reference."""
    return (F.col("n_words") >= MIN_WORDS) & (F.col("n_symbols") * 50 < F.col("word_chars"))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds the columns of _COUNTS, ``_text`` and ``_words`` to docs(text)."""
    docs = _with_words(docs)
    w = F.col("_words")
    docs = docs.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    docs = docs.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # most texts repeat no window; only for the others are the windows sorted as (hash, place), where equal neighbours are repeats
    n = F.greatest(F.size(w) - 2, F.lit(0))
    windows = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(F.size(w), F.lit(1))).alias("c")), 1, n)
    docs = docs.withColumn("_hashes", F.transform(windows, lambda x: F.xxhash64(x)))
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    docs = docs.withColumn("_grams", F.when(some, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    g = F.col("_grams")
    again = F.filter(g, lambda x, i: (F.get(g, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(g, i - 1)["h"] == x["h"])))
    docs = docs.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    a = F.col("_again")
    # a window adds three words, or as many as lie beyond the window before it
    covered = F.aggregate(F.transform(a, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(a, i - 1)))), F.lit(0), lambda s, x: s + x)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_lines", "_hashes", "_grams", "_again")


def _classes(docs: DataFrame) -> DataFrame:
    """Adds ``_shares``: of characters by class, in the order of _CLASSES. ``other`` counts the bytes that text has beyond its characters."""
    t = F.col("_text")
    docs = docs.withColumns({"_upper": _count(t, "[A-Z]"), "_digit": _count(t, "[0-9]"), "_mark": _count(t, MARKS), "_length": F.length(t)})
    other = F.octet_length(t) - F.col("_length")
    known = [F.col("_upper"), F.col("_digit"), F.col("_length") - F.col("word_chars"), F.col("n_symbols"), F.col("_mark"), other]
    rest = F.col("_length")
    for c in known:
        rest = rest - c
    total = F.greatest(F.col("_length"), F.lit(1)).cast("double")
    return docs.withColumn("_shares", F.array(*[c.cast("double") / total for c in [F.greatest(rest, F.lit(0)), *known]])).drop("_upper", "_digit", "_mark", "_length")


def candidates(docs: DataFrame) -> DataFrame:
    """(lang, words): the CANDIDATES most frequent words of the fit documents of each language, from docs(text, lang)."""
    fit = _with_words(docs.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null"))
    # outer: no filter on the words is inferred and pushed down
    words = fit.select("lang", F.explode_outer(F.when(_fit(), F.col("_words"))).alias("w"))
    top = words.groupBy("lang").agg(F.expr(f"approx_top_k(w, {CANDIDATES}, {TRACKED})").alias("top"))
    return top.select("lang", F.filter(F.transform("top", lambda x: x["item"]), lambda w: w.isNotNull()).alias("words"))


def measured(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """A written table of ``keep``, the base counts, ``_row``, ``_lang``, ``_shares`` and ``_common``: the candidates in the text, as often as they stand in it."""
    scratch = Scratch(docs.sparkSession)
    base = _classes(base_counts(docs.withColumn("_lang", F.col("lang").cast("string"))))
    out = [*keep, *_COUNTS, "_lang", "_shares", "_row"]
    base = base.withColumn("_row", F.monotonically_increasing_id())
    langs = found.limit(LANGUAGES + 1).collect()
    if len(langs) <= LANGUAGES:
        words = sorted({w for r in langs for w in r["words"]})
        common = F.filter("_words", lambda w: w.isin(words)) if words else F.array().cast("array<string>")
        return scratch.keep(base.select(*out, common.alias("_common")), "measured")
    # written once: the row numbers must not change between the two reads
    base = scratch.keep(base.select(*out, "_words"), "words")
    wanted = found.select(F.explode("words").alias("w")).distinct()
    common = base.select("_row", F.explode("_words").alias("w")).join(wanted, "w").groupBy("_row", "w").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("_row").agg(F.flatten(F.collect_list(F.array_repeat("w", F.col("n").cast("int")))).alias("_common"))
    made = scratch.keep(base.drop("_words").join(common, "_row", "left").withColumn("_common", F.coalesce("_common", F.array().cast("array<string>"))), "measured")
    scratch.drop(base)
    return made


def references(base: DataFrame, found: DataFrame) -> DataFrame:
    """For each language that has one: lang, classes (shares), words, shares of these among the common words, and their share of all words."""
    fit = base.where(_fit() & F.col("_lang").isNotNull())
    means = fit.groupBy(F.col("_lang").alias("lang")).agg(F.sum("n_words").alias("total"), F.array(*[F.avg(F.col("_shares")[i]) for i in range(len(_CLASSES))]).alias("classes"))
    counts = fit.select(F.col("_lang").alias("lang"), F.explode("_common").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(found.select(F.col("lang"), F.explode("words").alias("w")), ["lang", "w"])  # a language's own candidates
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("k") <= COMMON)
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "w", "n"))).alias("top"), F.sum("n").alias("n"))
    shares = F.transform("top", lambda x: x["n"] / F.col("n"))
    made = means.join(top, "lang").select("lang", "classes", F.col("top.w").alias("words"), shares.alias("shares"), (F.col("n") / F.col("total")).alias("share"))
    # the shortest text must be expected to hold enough common words for one to be the least accepted share
    return Scratch(base.sparkSession).keep(made.where(F.col("share") * MIN_WORDS * LEAST_COMMON >= 1), "references")


def _divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon, in bits, of two share arrays of equal length."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda x, y: 0.5 * (part(x, (x + y) / 2) + part(y, (x + y) / 2)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def _total(found: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda s, x: s + x)


def _verdict(found: Column, total: Column, ref: Column) -> Column:
    """Of a text with these counts of a reference's common words: the reference's verdict, to be ordered; null if it has none of them.

    A reference that accepts the text goes before all others, so that further references never reject it."""
    enough = total >= MIN_COMMON_WORDS
    mine = F.transform(found, lambda c: c / total)
    common = F.coalesce(F.when(enough, _divergence(mine, ref["shares"])), F.lit(1.0))
    share = total / F.greatest(F.col("n_words"), F.lit(1)) / ref["share"]
    r = F.struct(share.alias("share"), common.alias("common"), _divergence(F.col("_shares"), ref["classes"]).alias("classes"), enough.alias("enough"))
    return F.when(total > 0, r)


def _ordered(r: Column) -> Column:
    good = (r["classes"] <= MOST_CLASS) & (r["share"] >= LEAST_COMMON) & (~r["enough"] | (r["common"] <= MOST_COMMON))
    return F.when(r.isNotNull(), F.struct(good.alias("good"), r.alias("r")))


def _literal(refs: list[dict]) -> Column:
    """References as one array of structs."""
    floats = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return F.array(*[F.struct(F.array(*map(F.lit, r["words"])).alias("words"), floats(r["shares"]).alias("shares"), floats(r["classes"]).alias("classes"), F.lit(float(r["share"])).alias("share")) for r in refs])


def _once(x: Column, f) -> Column:
    """f(x), with x computed once: a column that a lambda function uses would be copied into it, and computed for every element."""
    return F.transform(F.array(x), f)[0]


def _nearest_inline(base: DataFrame, refs: list[dict]) -> DataFrame:
    """Adds ``_best``, with the references as literals. Each step holds what the next one uses more than once."""
    common = F.col("_common")
    times = lambda d: F.map_from_arrays(d, F.transform(d, lambda w: F.size(common) - F.size(F.array_remove(common, w))))
    found = lambda m, r: F.transform(r["words"], lambda w: F.coalesce(F.element_at(m, w), F.lit(0)).cast("double"))
    x = _once(_once(F.array_distinct(common), times), lambda m: F.transform(_literal(refs), lambda r: F.struct(r.alias("ref"), found(m, r).alias("found"))))
    x = F.transform(x, lambda s: F.struct(s["ref"].alias("ref"), s["found"].alias("found"), _total(s["found"]).alias("total")))
    x = F.transform(x, lambda s: _verdict(s["found"], s["total"], s["ref"]))
    best = F.array_max(F.transform(x, _ordered))
    return base.withColumn("_best", best).withColumn("_own", F.col("_lang").isin([r["lang"] for r in refs]))


def _nearest_joined(base: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``_best`` by a join of each text's distinct common words with the references, whatever their number."""
    words = base.select("_row", F.explode("_common").alias("w")).groupBy("_row", "w").agg(F.count(F.lit(1)).alias("n"))
    places = refs.select("lang", F.posexplode("words").alias("k", "w"))
    pairs = words.join(places, "w").groupBy("_row", "lang").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    pairs = pairs.join(refs, "lang").join(base.select("_row", "n_words", "_shares"), "_row")
    found = F.transform("words", lambda w, k: F.coalesce(F.col("m")[k], F.lit(0)).cast("double"))
    ref = F.struct("shares", "classes", "share")
    pairs = pairs.withColumn("_f", found).withColumn("_s", _total(F.col("_f"))).withColumn("r", _verdict(F.col("_f"), F.col("_s"), ref))
    best = pairs.groupBy("_row").agg(F.max(_ordered(F.col("r"))).alias("_best"))
    own = refs.select(F.col("lang").alias("_lang"), F.lit(True).alias("_own"))
    return base.join(best, "_row", "left").join(own, "_lang", "left")


def verdicts(base: DataFrame, refs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the base counts, base_failed, class_divergence, common_divergence, common_share and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = base.withColumn("base_failed", failed)
    counts = [*_COUNTS, "base_failed"]
    some = refs.orderBy("lang").limit(LANGUAGES + 1).collect()
    if not some:
        none = F.lit(None).cast("double")
        return base.select(*keep, *counts, none.alias("class_divergence"), none.alias("common_divergence"), none.alias("common_share"), (~F.col("base_failed")).alias("kept"))
    base = _nearest_inline(base, [r.asDict() for r in some]) if len(some) <= LANGUAGES else _nearest_joined(base, refs)
    b = F.col("_best")["r"]
    # the base rules decide alone for a language without a reference
    good = F.coalesce(F.col("_best")["good"], F.lit(False)) | (F.col("_lang").isNotNull() & ~F.coalesce("_own", F.lit(False)))
    return base.select(*keep, *counts, b["classes"].alias("class_divergence"), F.when(b["enough"], b["common"]).alias("common_divergence"), F.coalesce(b["share"], F.lit(0.0)).alias("common_share"), (~F.col("base_failed") & good).alias("kept"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """verdicts() of docs(text, lang, and the columns ``keep``) by the references of their own languages."""
    found = Scratch(docs.sparkSession).keep(candidates(docs), "candidates")
    base = measured(docs, found, keep)
    return verdicts(base, references(base, found), keep)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return judged.select("doc_id", *_COUNTS, "base_failed", "kept")


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM grams),
again AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS v(j) WHERE k > 1 GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
b AS (SELECT doc_id, r, lang, w, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(text) AS chars, strlen(text) - length(text) AS other,
      len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[0-9]')) AS digit, len(regexp_extract_all(text, '{MARKS.replace("'", "''")}')) AS mark
      FROM t JOIN lines USING (r) LEFT JOIN again USING (r)),
c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, lang IS NOT NULL AND n_words >= {MIN_WORDS} AND n_symbols * 50 < word_chars AS fit,
      list_transform([greatest(chars - upper - digit - (chars - word_chars) - n_symbols - mark - other, 0), upper, digit, chars - word_chars, n_symbols, mark, other], lambda x: x / greatest(chars, 1)) AS shares FROM b),
counts AS (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM c WHERE fit) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS k, sum(n) OVER (PARTITION BY lang) AS total FROM counts) WHERE k <= {COMMON}),
refs AS (SELECT lang, sum(n) AS common, sum(n) / any_value(total) AS share FROM top GROUP BY lang HAVING sum(n) / any_value(total) * {MIN_WORDS} * {LEAST_COMMON} >= 1),
q AS (SELECT lang, x, n / common AS q FROM top JOIN refs USING (lang)),
class AS (SELECT lang, j, avg(shares[j]) AS q FROM c JOIN refs USING (lang), unnest(range(1, 8)) AS v(j) WHERE fit GROUP BY ALL),
jc AS (SELECT r, class.lang, sum(0.5 * (CASE WHEN shares[j] > 0 THEN shares[j] * log2(shares[j] / ((shares[j] + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((shares[j] + q) / 2)) ELSE 0 END)) AS d
       FROM c, class GROUP BY ALL),
own AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM c) GROUP BY ALL),
f AS (SELECT r, q.lang, x, q, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY r, q.lang) AS total FROM c CROSS JOIN q LEFT JOIN own USING (r, x)),
jw AS (SELECT r, lang, any_value(total) AS total, sum(0.5 * (CASE WHEN n > 0 THEN n / total * log2(n / total / ((n / total + q) / 2)) ELSE 0 END + q * log2(q / ((n / total + q) / 2)))) AS d
       FROM f WHERE total > 0 GROUP BY r, lang),
good AS (SELECT DISTINCT r FROM jw JOIN jc USING (r, lang) JOIN refs USING (lang) JOIN c USING (r)
         WHERE jc.d <= {MOST_CLASS} AND total / n_words / refs.share >= {LEAST_COMMON} AND (total < {MIN_COMMON_WORDS} OR jw.d <= {MOST_COMMON}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (r IN (SELECT r FROM good) OR (SELECT count(*) FROM refs) = 0 OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM refs))) AS kept
FROM c
"""
