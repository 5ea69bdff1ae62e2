"""JSON message topics: reading, decoding, writing and generating them.

A topic comes from Kafka or, with the same ``value`` column, from a folder of text files with one
message per line. Everything after the source is the same for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.schemas import Topic

_CORRUPT = "_corrupt"
_TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def kafka_options(
    topic: Topic,
    servers: str,
    starting: str = "latest",
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options: topic, consumer group, start position and the size of a micro-batch.

    ``min_partitions`` splits large topic partitions over several tasks.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic.name,
        "kafka.group.id": topic.group_id,
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_kafka(spark: SparkSession, topic: Topic, servers: str, **options) -> DataFrame:
    """The messages of a topic as text; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**kafka_options(topic, servers, **options))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def read_folder(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages from text files that appear in a folder, as a stream."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Messages as columns of the schema, next to their text.

    A field that is missing is NULL, a nested object in a text column stays JSON text, and a
    message that is not JSON of this shape is marked corrupt.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(
        "value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    )
    return messages.select("value", parsed.alias("row")).select("value", "row.*")


def _usable(event_time: str):
    return F.col(_CORRUPT).isNull() & F.col(event_time).isNotNull()


def good_rows(decoded: DataFrame, event_time: str) -> DataFrame:
    """Rows that can take part in event time."""
    return decoded.where(_usable(event_time)).drop("value", _CORRUPT)


def dead_letters(decoded: DataFrame, event_time: str) -> DataFrame:
    """The texts of all other messages and why they were set aside."""
    return decoded.where(~_usable(event_time)).select(
        "value",
        F.when(F.col(_CORRUPT).isNotNull(), "malformed").otherwise("no event time").alias("reason"),
    )


def topic_rows(messages: DataFrame, topic: Topic) -> DataFrame:
    """Decoded rows of a topic with its watermark."""
    return with_watermark(good_rows(decode(messages, topic.schema), topic.event_time), topic)


def with_watermark(rows: DataFrame, topic: Topic) -> DataFrame:
    """The rows of a topic with its watermark; a date as event time counts as its midnight."""
    event_time = topic.event_time
    if isinstance(topic.schema[event_time].dataType, T.DateType):
        rows = rows.withColumn("sale_timestamp", F.col(event_time).cast("timestamp"))
        event_time = "sale_timestamp"
    return rows.withWatermark(event_time, topic.lateness)


def taken_in(spark: SparkSession, good: str, topic: Topic) -> DataFrame:
    """The rows that ``jobs.take_in`` found usable, as a stream with the topic's watermark.

    The job behind it has a checkpoint of its own and reads each file once.
    """
    return with_watermark(spark.readStream.schema(topic.schema).parquet(good), topic)


def without_repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a stream that may bring a message several times, each message once.

    Messages are the same if their keys are equal. ``rows`` has a watermark: what has been seen is kept in state until
    it has passed the message's time, so repeats up to its delay later are found, and state does not grow with the
    stream. The keys alone decide: a repeat may carry another time.
    """
    return rows.dropDuplicatesWithinWatermark(keys)


def encode(rows: DataFrame) -> DataFrame:
    """Rows as JSON messages; times keep their microseconds."""
    return rows.select(F.to_json(F.struct("*"), _TIME_FORMATS).alias("value"))


def write_kafka(rows: DataFrame, topic: str, servers: str, checkpoint: str):
    """Produce rows to a topic; needs the Kafka connector on the class path."""
    return (
        encode(rows).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )


def write_folder(rows: DataFrame, path: str) -> None:
    """Write rows as files of messages."""
    encode(rows).write.mode("append").text(path)


def write_slices(rows: DataFrame, slice_: Column, path: str, files: int) -> None:
    """Write rows in one pass, as ``files`` Parquet files for each slice, from 0, that a file stream reads in this order.

    File streams read by time of change, so the files of a slice get times after those of the slice before.
    """
    number = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
    placed = rows.withColumns({"_slice": slice_, "_file": number})
    placed.repartition("_slice", "_file").write.partitionBy("_slice", "_file").parquet(path)
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_slice=*/_file=*/*.parquet")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(where) or []:
        slice_of = int(status.getPath().getParent().getParent().getName().partition("=")[2])
        system.setTimes(status.getPath(), 1_000_000_000_000 + slice_of * 10_000, -1)


def click_messages(spark: SparkSession, count: int, start: str = "2024-01-01 00:00:00",
                   per_second: int = 1, pad_to: int = 0) -> DataFrame:
    """Generated click events at a fixed rate, optionally padded to a message size in bytes."""
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.expr(f"id * 1000000 DIV {per_second}")
    message = F.to_json(F.struct(
        (F.col("id") + 1).alias("user_id"),
        F.lit("click").alias("event_type"),
        F.timestamp_micros(micros).alias("event_time"),
        F.struct(F.lit("/home").alias("page"), F.lit("web").alias("source")).alias("properties"),
    ))
    if pad_to:
        # Longer messages stay as they are.
        missing = F.greatest(F.lit(pad_to) - F.octet_length(message), F.lit(0))
        message = F.concat(message, F.repeat(F.lit(" "), missing))
    return spark.range(count).select(message.alias("value"))


def word_messages(spark: SparkSession, words: list[str], rows_per_second: int = 4) -> DataFrame:
    """An endless stream of word messages at a fixed rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    choice = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("value") % len(words) + 1).cast("int"))
    return encode(ticks.select(
        choice.alias("word"), F.lit(1).cast("bigint").alias("count"), F.col("timestamp").alias("ts")
    ))
