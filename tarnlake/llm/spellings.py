"""Spelling variants: words that differ by one code point, found by asymmetric chunks and grams.

Of two words at distance one, the shorter one (or, of two of one length, either) is cut into two disjoint chunks. One
edit spoils at most one of them; the other is found in the longer word as a positional gram, shifted by nothing if it lies
before the edit and by the one added code point if it lies behind. So chunks and grams are joined on length, place
and content, and the pairs that meet are verified by their edit distance. Of all positional grams of a word only those are
made that a chunk can meet, by its length and the shift within one. For words of one length the gram that may meet a
chunk lies at the chunk's own place, so one row serves as both.

A chunk that many words have in common would pair them all. Where the pairs of a chunk are many times its rows, the
part of the word that it leaves open is cut into two chunks again, one of which the edit leaves whole too: the
chunk is made longer by either, and both are tried. Such steps halve the open part, down to one code point, where only
as many words can meet as the alphabet has letters. So hot chunks are neither paired out nor cut off.

Words are counted on the map side in bounded tables and summed up by Spark. Every step's rows are written to the shared
folder.

Edge cases: null and empty texts have no words; rows without an id keep their runs as they are; repeated rows count
each; very long runs are words like any other; an empty table gives an empty result. Equal counts are
decided by code-point order. Only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast, map_arrow, slices
from tarnlake.session import stored

LEAST_LENGTH, LEAST_COUNT = 5, 3
# A form is at least so many times as frequent.
TIMES = 2
# Of every SPOILED-th run of a document, by its hash, one code point is deleted.
SPOILED = 97
# A chunk is paired out up to so many pairs a row, and made longer beyond.
PAIRS_PER_ROW = 8
# A task's table of counts is emptied at so many words or bytes.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> Counter:
    """The runs of letters of a text with their counts; only A-Z are lower-cased."""
    return Counter(_RUN.findall(text.encode().lower().decode()))


def spoiled(run: str, doc_crc: int) -> str:
    """The run, without one code point if its hash says so; ``doc_crc`` is the checksum of the text before it."""
    h = zlib.crc32(run.encode(), doc_crc)
    if h % SPOILED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` and ``n``, of the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, content in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not content:
                        continue
                    crc = None if doc is None else zlib.crc32(b"%d:" % doc)
                    for word, count in runs(content).items():
                        if crc is not None:
                            word = spoiled(word, crc)
                        if len(word) < LEAST_LENGTH:
                            continue
                        before = held.get(word)
                        if before is None:
                            held[word] = count
                            size += len(word)
                        else:
                            held[word] = before + count
                    if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    rows = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].alias("text"))
    counted = map_arrow(rows, run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(open_from: Column, open_to: Column, longer: Column, length: Column) -> Column:
    """A hash of all that is kept of a word: without the open part, and one code point more in the longer word."""
    kept = F.concat(
        F.substring(F.col("word"), F.lit(1), open_from),
        F.substring(F.col("word"), open_to + longer + 1, F.greatest(length - open_to, F.lit(0))))
    return F.xxhash64(length, open_from, open_to, kept)


def _rows(words: DataFrame) -> DataFrame:
    """word, n, ``longer`` (1 if it meets chunks of words that are shorter by one), their length, and the open part."""
    each = words.select("word", "n", F.char_length("word").alias("chars"), F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"))
    sized = each.select("word", "n", "longer", (F.col("chars") - F.col("longer")).alias("length")).where(F.col("length") > 0)
    whole = sized.select("*", F.lit(0).alias("open_from"), F.col("length").alias("open_to"))
    return _halved(whole)


def _halved(rows: DataFrame) -> DataFrame:
    """Either half of the open part is closed."""
    middle = F.floor((F.col("open_from") + F.col("open_to")) / 2).cast("int")
    halves = F.array(
        F.struct(middle.alias("open_from"), F.col("open_to").alias("open_to")),
        F.struct(F.col("open_from").alias("open_from"), middle.alias("open_to")))
    cut = rows.select("word", "n", "longer", "length", F.explode(halves).alias("open"))
    return cut.select(
        "word", "n", "longer", "length", "open.open_from", "open.open_to",
    ).withColumn("key", _key(F.col("open_from"), F.col("open_to"), F.col("longer"), F.col("length")))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``other`` and their counts ``n`` and ``other_n`` for all pairs at distance one, in both directions.

    ``words`` has distinct words and their counts.
    """
    rows, found = stored(_rows(words), "chunks"), []
    while True:
        chunks, grams = F.sum(1 - F.col("longer")).cast("double"), F.sum("longer").cast("double")
        pairs = chunks * (chunks - 1) / 2 + chunks * grams
        # A short open part can't be halved; only so many words differ in it as there are letters.
        may_grow = F.max(F.col("open_to") - F.col("open_from")) > 1
        groups = rows.groupBy("key").agg(
            ((pairs > PAIRS_PER_ROW * (chunks + grams)) & may_grow).alias("hot"), pairs.alias("pairs"),
        ).where(F.col("pairs") > 0).select("key", "hot")
        met = stored(rows.join(groups, "key"), "chunks-met")
        cool, hot = met.where(~F.col("hot")), met.where("hot")
        a, b = cool.where("longer = 0").alias("a"), cool.alias("b")
        distinct = (F.col("b.longer") == 1) | (F.col("a.word") < F.col("b.word"))
        near = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
        found.append(a.join(b, (F.col("a.key") == F.col("b.key")) & distinct).where(near).select(
            "a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")))
        if hot.isEmpty():
            break
        rows = stored(_halved(hot.drop("key", "hot")), "chunks")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    every = stored(every.distinct(), "near-words")
    return every.unionAll(every.select("other", "other_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain of forms; a chain doubles its count at each step, so it ends.

    Every round doubles the steps, so there are few.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = bounded_broadcast(at.select(F.col("word").alias("of"), F.col("root").alias("next")), 100)
        moved = at.join(onward, F.col("root") == F.col("of"), "left")
        after = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("of").isNotNull().alias("on")), "forms")
        at = after.drop("on")
        if after.where("on").isEmpty():
            return at


def variants(words: DataFrame) -> DataFrame:
    """Per word: count, near words, form with its count, and root."""
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "words-judged")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(stored(word_counts(docs), "words"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM r, crc
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, unnest(range(length(word))) AS k FROM w
), swapped AS (
  SELECT word, n, left(word, k) || '?' || substr(word, k + 2) AS same FROM cut
), shorter AS (
  SELECT DISTINCT cut.word AS a, w.word AS b FROM cut JOIN w ON left(cut.word, k) || substr(cut.word, k + 2) = w.word
), near AS (
  SELECT x.word, y.word AS other FROM swapped x JOIN swapped y ON x.same = y.same AND x.word <> y.word
  UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter
), best AS (
  SELECT w.word, any_value(w.n) AS n, count(o.word) AS n_near, arg_min(o.word, (-o.n, encode(o.word))) AS other, max(o.n) AS other_n
  FROM w LEFT JOIN near USING (word) LEFT JOIN w o ON o.word = near.other GROUP BY w.word
), judged AS (
  SELECT word, n, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM best
), chain AS (
  SELECT word, word AS upto FROM judged
  UNION ALL SELECT chain.word, j.form FROM chain JOIN judged j ON chain.upto = j.word WHERE j.form IS NOT NULL
), ends AS (
  SELECT chain.word, upto AS root FROM chain JOIN judged j ON chain.upto = j.word WHERE j.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""
