"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

Every document gets a few whole-number measures. A sketch counts documents by measure and bucket, where a
bucket spans at most 1/32 of its value, so sketches merge by adding counts, in any order and with the same
outcome. A measure's fence is read off the sketch of a group: the median plus ``SPREAD`` times its distance to the first
quartile plus a least tolerance. Both quantiles lie among the good documents as long as less than half of the group is junk,
however extreme the junk is: with 45 % of it, the median is the good documents' 91st percentile. A source's limit is its fence, but at most
its language's limit plus ``MARGIN`` tolerances. So a source may hold even more junk, and is then judged by its language
and that margin, as long as less than half of the language is junk. Groups with fewer than ``LEAST_ROWS`` documents
get a mean of their own fence and the next wider limit, weighted by their number of documents; the sketches of
languages and of all rows are sums of the small ones.

Only DataFrame functions are used. Nothing but the sketches is shuffled: documents meet the limits in a
broadcast join as long as the counted number of limits is small.

Edge cases: a null or empty text has no words and fails the base rule; a null language or source is a
group like any other; repeated rows are judged alike; an empty table gives an empty result. Columns of the
input are kept, and the verdict's column is numbered if its name is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast, fresh, let
from tarnlake.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
# With so many documents a group's fence is its own; with fewer, the next wider limit counts for the missing ones.
LEAST_ROWS = 200
SPREAD = 3
# How many tolerances a source's limit may lie above its language's.
MARGIN = 3
# Measure: least tolerance above the median, in the measure's own unit.
TOLERANCES = {
    "symbols_per_1000_words": 150,
    "repeated_lines_per_1000": 300,
    "letters_per_100_words": 400,
}


def _words(text: Column) -> Column:
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    return F.array_remove(F.split(spaced, " "), "")


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more; windows are compared by 64-bit hashes."""

    def among(hashes: Column) -> Column:
        def starts(placed: Column) -> Column:
            n = F.size(placed)
            twice = F.filter(placed, lambda x, i: (
                ((i > 0) & (F.get(placed, i - 1)["h"] == x["h"]))
                | ((i < n - 1) & (F.get(placed, i + 1)["h"] == x["h"]))))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def covered(at: Column) -> Column:
            # A window covers its words up to the start of the next such window.
            gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(placed, starts), covered))

    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n > WINDOW, let(hashes, among)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def by_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    def by_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        let(_words(text), by_words).alias("words"),
        let(lines, by_lines).alias("lines"),
        (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
    )


def _judged(m: Column) -> Column:
    """The measures as one flat struct, with the base rule and the values that are compared with limits."""
    words, chars, repeats = m["words"]["n_words"], m["words"]["word_chars"], m["words"]["n_repeat_words"]
    lines, dup = m["lines"]["n_lines"], m["lines"]["n_dup_lines"]

    def share(part: Column, scale: int, whole: Column) -> Column:
        return F.floor(part * scale / F.greatest(whole, F.lit(1))).cast("long")

    return F.struct(
        words.alias("n_words"), chars.alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        dup.alias("n_dup_lines"), repeats.alias("n_repeat_words"),
        ((words < LEAST_WORDS) | (repeats * 100 > words * MOST_REPEATED_PERCENT)).alias("base_failed"),
        share(m["n_symbols"], 1000, words).alias("symbols_per_1000_words"),
        share(dup, 1000, lines).alias("repeated_lines_per_1000"),
        share(chars, 100, words).alias("letters_per_100_words"),
    )


def bucket(value: Column) -> Column:
    """Values below 64 are their own bucket; above, a bucket holds the values with equal top six bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.floor(value / F.pow(F.lit(2.0), shift)).cast("long") + shift * 32


def bucket_top(number: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0))
    return ((number - shift * 32 + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def sketch(judged: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Counts by group, measure and bucket of the measures in the struct column ``value``."""
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(F.col(value)[name]).alias("bucket")) for name in TOLERANCES]))
    return (judged.select(*groups, each.alias("at"))
            .groupBy(*groups, "at.measure", "at.bucket").agg(F.count("*").alias("n")))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of finer groups added up."""
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: ``rows``, and an array of the fences (``fence``) in the order of ``TOLERANCES``."""
    from pyspark.sql import Window

    one = Window.partitionBy(*groups, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(one.orderBy("bucket"))).withColumn("rows", F.sum("n").over(one))

    def quantile(percent: int) -> Column:
        return bucket_top(F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("bucket"))))

    slack = reduce(lambda c, kv: c.when(F.col("measure") == kv[0], kv[1]), TOLERANCES.items(), F)
    found = ranked.groupBy(*groups, "measure").agg(
        F.max("rows").alias("rows"), (quantile(50) + SPREAD * (quantile(50) - quantile(25))).alias("fence"))
    found = found.withColumn("fence", F.col("fence") + slack)
    # The name of a measure decides its place, so that the array is the same in every run.
    return found.groupBy(*groups).agg(
        F.max("rows").alias("rows"),
        *[F.max(F.when(F.col("measure") == name, F.col("fence"))).alias(name) for name in TOLERANCES],
    ).select(*groups, "rows", F.array(*TOLERANCES).alias("fence"))


def blended(rows: Column, fence: Column, wider: Column) -> Column:
    """A group's fences; one with few documents gets their mean with the wider limits, weighted by its number of them."""
    own = F.least(rows, F.lit(LEAST_ROWS)).cast("bigint")
    return F.zip_with(fence, wider, lambda a, b: F.floor((own * a + (LEAST_ROWS - own) * b) / LEAST_ROWS).cast("bigint"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          out: str = "quality", payload: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column of measures and verdict (``kept``).

    ``payload`` names the columns to carry (default: all). The measured rows are written once to the shared
    folder, as both the sketches and the verdicts read them.
    """
    names = docs.columns if payload is None else payload
    out = fresh(names, out)
    groups = [fresh([*names, out], "of_lang"), fresh([*names, out], "of_source")]
    # Two steps, so that the measures are computed once and not for every field of the struct.
    held = docs.select(
        *[docs[name] for name in names], docs[lang].alias(groups[0]), docs[source].alias(groups[1]),
        let(measures(docs[text]), _judged).alias(out))
    held = stored(held, "quality-measures")
    fine = stored(sketch(held, groups, out), "quality-sketches")
    of_group = fences(fine, groups)
    of_lang = fences(merge(fine, groups[:1]), groups[:1])
    of_all = fences(merge(fine, []), []).first()  # one row, if there are any
    widest = F.array(*map(F.lit, of_all["fence"] if of_all else [0] * len(TOLERANCES))).cast("array<bigint>")
    a, b = of_group.alias("a"), of_lang.withColumn("limit", blended(F.col("rows"), F.col("fence"), widest)).alias("b")
    margin = F.array(*[F.lit(MARGIN * slack) for slack in TOLERANCES.values()]).cast("array<bigint>")
    most = F.zip_with("b.limit", margin, lambda x, y: x + y)
    own = blended(F.col("a.rows"), F.col("a.fence"), F.col("b.limit"))
    chosen = (
        a.join(b, F.col(f"a.{groups[0]}").eqNullSafe(F.col(f"b.{groups[0]}")))
        .select(*[F.col(f"a.{g}").alias(g) for g in groups], F.zip_with(own, most, lambda x, y: F.least(x, y)).alias("limit")))
    chosen = stored(chosen, "quality-limits")
    small = bounded_broadcast(chosen, 200)
    joined = held.alias("d").join(
        small.alias("l"),
        F.col(f"d.{groups[0]}").eqNullSafe(F.col(f"l.{groups[0]}"))
        & F.col(f"d.{groups[1]}").eqNullSafe(F.col(f"l.{groups[1]}")), "left")
    verdict = F.col(f"d.{out}")
    within = reduce(lambda x, y: x & y, [
        verdict[name] <= F.col("l.limit")[k] for k, name in enumerate(TOLERANCES)])
    return joined.select(
        *[F.col(f"d.`{name}`") for name in names],
        verdict.withField("kept", ~verdict["base_failed"] & within).alias(out))


def keep_good(docs: DataFrame, **names) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    out = fresh(docs.columns, "quality")
    return judge(docs, out=out, **names).where(F.col(out)["kept"]).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Per document its counts and the verdict, without the text."""
    found = judge(docs, out="quality", payload=["doc_id"])
    return found.select("doc_id", *[F.col("quality")[name].alias(name) for name in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w0 AS (
  SELECT rid, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS w,
         generate_subscripts(string_split_regex(text, '[\x20\x09-\x0D]+'), 1) AS k FROM t
), w AS (
  SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY k) AS p FROM w0 WHERE w <> ''
), v AS (
  SELECT rid, p, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o
         || chr(10) || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM v WHERE g IS NOT NULL) WHERE c > 1
), repeated AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2, p + 3, p + 4]) AS q FROM twice) GROUP BY rid
), counted AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT t.rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN counted USING (rid) LEFT JOIN l USING (rid) LEFT JOIN repeated USING (rid)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         [n_symbols * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1),
          word_chars * 100 // greatest(n_words, 1)] AS vals FROM m
), e AS (
  SELECT lang, source, unnest([1, 2, 3]) AS k, unnest(vals) AS val FROM j
), f AS (
  SELECT lang, source, k, val, greatest(length(bin(val::BIGINT)) - 6, 0) AS s FROM e
), s3 AS (
  SELECT lang, source, k, (val::BIGINT >> s) + s * 32 AS b, count(*) AS n FROM f GROUP BY ALL
), s2 AS (SELECT lang, k, b, sum(n) AS n FROM s3 GROUP BY ALL),
s1 AS (SELECT k, b, sum(n) AS n FROM s3 GROUP BY ALL),
r AS (
  SELECT 3 AS level, lang, source, k, b, sum(n) OVER (PARTITION BY lang, source, k ORDER BY b) AS upto,
         sum(n) OVER (PARTITION BY lang, source, k) AS total FROM s3
  UNION ALL SELECT 2, lang, NULL, k, b, sum(n) OVER (PARTITION BY lang, k ORDER BY b), sum(n) OVER (PARTITION BY lang, k) FROM s2
  UNION ALL SELECT 1, NULL, NULL, k, b, sum(n) OVER (PARTITION BY k ORDER BY b), sum(n) OVER (PARTITION BY k) FROM s1
), q AS (
  SELECT level, lang, source, k, max(total) AS total, min(b) FILTER (WHERE upto * 100 >= total * 50) AS mid,
         min(b) FILTER (WHERE upto * 100 >= total * 25) AS low FROM r GROUP BY level, lang, source, k
), x AS (
  SELECT level, lang, source, k, total,
         ((mid - greatest(mid // 32 - 1, 0) * 32 + 1)::BIGINT << greatest(mid // 32 - 1, 0)::INT) - 1 AS mid,
         ((low - greatest(low // 32 - 1, 0) * 32 + 1)::BIGINT << greatest(low // 32 - 1, 0)::INT) - 1 AS low FROM q
), fences AS (
  SELECT level, lang, source, k, total::BIGINT AS total, least(total, 200)::BIGINT AS own,
         (mid + 3 * (mid - low) + [150, 300, 400][k])::BIGINT AS fence FROM x
), wide AS (
  SELECT b.lang, b.k, (b.own * b.fence + (200 - b.own) * c.fence) // 200 AS lim
  FROM (SELECT * FROM fences WHERE level = 2) b JOIN (SELECT * FROM fences WHERE level = 1) c ON b.k = c.k
), picked AS (
  SELECT a.lang, a.source, list(least((a.own * a.fence + (200 - a.own) * b.lim) // 200, b.lim + 3 * [150, 300, 400][a.k])
                                ORDER BY a.k) AS lim
  FROM (SELECT * FROM fences WHERE level = 3) a JOIN wide b ON a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k
  GROUP BY a.lang, a.source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND vals[1] <= lim[1] AND vals[2] <= lim[2] AND vals[3] <= lim[3] AS kept
FROM j LEFT JOIN picked ON j.lang IS NOT DISTINCT FROM picked.lang AND j.source IS NOT DISTINCT FROM picked.source
"""
