"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed table of the 128-bit hashes of line keys, sorted within its buckets. A batch of documents is
reduced to its keys, and these are merged with the runs: a sort-merge anti join, bucket by bucket and without a
shuffle of the runs, leaves the keys that no earlier batch had. They become a run of their own. Before the next batch,
two runs of one level are merged into a run of the next level, so a store of n batches keeps about log2(n) runs
and every key is rewritten as often. Batches come in ascending order of ids: a key that is in a run has its
line in an earlier document, and a new key keeps it in the batch's smallest id.

Only DataFrame functions are used. Keys are combined on the map side before they are shuffled, and the keys that
hold a large part of all lines (at most ``HOT_PARTS`` by definition) meet the lines in a broadcast join, the others in a
shuffled one. What a document loses is a list of its line numbers; texts are shuffled once.

Edge cases: a null or empty text is one empty line; lines end at ``\\n`` only; rows with equal ids are one document, so
they keep their common lines; rows without an id count as one document after all others; keys differ by
their 128-bit hash; a document that loses all lines has an empty text; an empty table gives an empty result. Other
columns are kept by ``drop_repeated_lines``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import fresh
from tarnlake.session import scratch_dir, session_conf, stored

LEAST_LENGTH = 10
BATCHES = 4
# Keys with at least this part of a batch's lines are hot, so there are at most so many of them.
HOT_PARTS = 10_000
# Runs of a level that are merged into one of the next.
FANOUT = 2

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]
_LAST = (1 << 63) - 1
# Buckets of one file are sorted, and a merge then reads them without another sort.
_SORTED_BUCKETS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z as a-z."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Lower-casing is the faster one and changes nothing else in a line of ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _id(doc: Column) -> Column:
    return F.coalesce(doc.cast("long"), F.lit(_LAST))


def keyed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc``, ``copy`` (a hash of the text), ``pos`` and the key's hashes of every line that may go."""
    rows = docs.select(_id(docs[doc_id]).alias("doc"), F.xxhash64(docs[text]).alias("copy"), F.posexplode(_lines(docs[text])))
    keys = rows.select("doc", "copy", "pos", line_key(F.col("col")).alias("key")).where(F.char_length("key") >= LEAST_LENGTH)
    return keys.select(
        "doc", "copy", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class LineRuns:
    """The line keys of all batches so far, as runs in levels; state lies in tables below the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = scratch_dir(spark, "line-runs")
        # Merges need no shuffle as long as all runs of a store have the same number of buckets.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _table(self, keys: DataFrame) -> str:
        """A bucketed table of ``keys``, which are distributed by their hashes already."""
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
         .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name))
        return name

    def _compact(self) -> None:
        """Merge two runs of a level into one of the next. Runs have no key in common, so a full join only interleaves."""
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) >= FANOUT:
                a, b = (self.levels[level].pop(0) for _ in range(FANOUT))
                merged = self.spark.table(a).join(self.spark.table(b).hint("merge"), _KEY, "full")
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._table(merged))
                self._drop([a, b])
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch whose ids follow all earlier ones; the keys of which lines go.

        ``lines`` has doc, h1 and h2, and is read twice. The result has a row per key: ``stays`` is the document that
        keeps its line, null if that is one of an earlier batch, and ``n`` the key's lines in this batch.
        """
        with session_conf(self.spark, _SORTED_BUCKETS | {"spark.sql.shuffle.partitions": str(self.buckets)}):
            self._compact()
            own = self._table(lines.groupBy(*_KEY).agg(
                F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")))
            unseen = self.spark.table(own)
            for run in (name for names in self.levels for name in names):
                unseen = unseen.join(self.spark.table(run).hint("merge"), _KEY, "left_anti")
            run = self._table(unseen.select(*_KEY))
            new = self.spark.table(run).withColumn("new", F.lit(True)).hint("merge")
            found = self.spark.table(own).join(new, _KEY, "left").where(F.col("new").isNull() | (F.col("first") < F.col("last")))
            doubled = stored(found.select(*_KEY, F.when(F.col("new"), F.col("first")).alias("stays"), "n"), "line-doubled")
            self._drop([own])
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        return doubled

    def close(self) -> None:
        """Forget the runs."""
        self._drop([name for names in self.levels for name in names])
        self.levels = []


def _dropped(lines: DataFrame, doubled: DataFrame) -> DataFrame:
    """The lines that go: their document keeps none, or is not the one that does."""
    total = lines.count()
    is_hot = F.col("n") * HOT_PARTS >= total
    hot = F.broadcast(doubled.where(is_hot).select(*_KEY, "stays"))
    few = lines.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti")
    met = lines.join(hot, _KEY).unionByName(few.join(doubled.where(~is_hot).select(*_KEY, "stays"), _KEY))
    return met.where(F.col("stays").isNull() | (F.col("doc") > F.col("stays"))).select("doc", "copy", "pos")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """``doc``, ``copy`` and ``gone``, the numbers of the lines that a document loses.

    The documents are dealt into ``batches`` ranges of ascending ids.
    """
    lines = keyed_lines(docs, text, doc_id)
    cuts = docs.agg(F.percentile_approx(_id(docs[doc_id]), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = sum(((F.col("doc") > cut).cast("int") for cut in sorted(set(cuts or []))), F.lit(0))
    path = scratch_dir(docs.sparkSession, "lines")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "doc long, copy long, pos int, h1 long, h2 long, batch int"
    lines = docs.sparkSession.read.schema(schema).parquet(path)
    runs = LineRuns(docs.sparkSession)
    gone = []
    for number in range(len(set(cuts or [])) + 1):
        part = lines.where(F.col("batch") == number).drop("batch")
        gone.append(_dropped(part, runs.add(part)))
    runs.close()
    every = gone[0]
    for more in gone[1:]:
        every = every.unionAll(more)
    # As many numbers as the document has lines, at most.
    return every.groupBy("doc", "copy").agg(F.collect_set("pos").alias("gone"))


def without_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES,
                     out: str = "lines") -> DataFrame:
    """``docs`` with a struct column: the text that stays (``kept``), ``n_lines`` and ``n_dropped``."""
    out = fresh(docs.columns, out)
    doc, copy, gone = (fresh([*docs.columns, out], name) for name in ("line_doc", "line_copy", "line_gone"))
    losses = repeated_lines(docs, text, doc_id, batches).toDF(doc, copy, gone)
    held = docs.withColumns({doc: _id(docs[doc_id]), copy: F.xxhash64(docs[text])}).join(losses, [doc, copy], "left")
    lines = _lines(F.col(f"`{text}`"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(
        F.array_join(F.transform(numbers, lambda k: F.get(lines, k)), "\n"))
    return held.select(*[F.col(f"`{name}`") for name in docs.columns], F.struct(
        kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_dropped")).alias(out))


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """``docs`` with the texts that stay; every key keeps its lines in the smallest id that holds it."""
    out = fresh(docs.columns, "lines")
    found = without_repeated(docs, text, doc_id, batches, out)
    return found.withColumn(text, F.col(out)["kept"]).select(*[F.col(f"`{name}`") for name in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Per document its lines, how many go, and a digest of the text that stays."""
    found = without_repeated(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("lines")["n_lines"].alias("n_lines"), F.col("lines")["n_dropped"].alias("n_dropped"),
        F.sha2(F.col("lines")["kept"].cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS p FROM t
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS stays FROM k WHERE length(key) >= 10 GROUP BY key
), j AS (
  SELECT k.*, coalesce(coalesce(doc_id, 9223372036854775807) > stays, false) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
