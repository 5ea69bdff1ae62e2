"""Random forest training and scoring on a table of features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stands for a missing feature; far from any count or share.
MISSING = -1e9


def split_rows(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key.

    The split depends on the key alone: a task that is run again puts every row on the same side,
    which ``randomSplit`` promises only for an unchanged row order. The hash is one that any SQL
    engine has; rows without a key are trained on.
    """
    draw = F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), 1, 6)
    test = F.col(key).isNotNull() & (draw < F.lit(f"{int(test_share * 16**6):06x}"))
    return df.where(~test), df.where(test)


def train_forest(
    df: DataFrame,
    target: str,
    key: str,
    features: Sequence[str] | None = None,
    trees: int = 100,
    test_share: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Train on 80 %, score the rest: one row with both sizes, the share of right predictions, and how
    many rows had a missing feature.

    All columns but target and key are features unless they are named. A missing feature becomes
    ``MISSING``, which a tree can tell from all others; no row is left out but those without a
    target. Training reads its input several times: pass a stored table.
    """
    columns = list(features or [c for c in df.columns if c not in (target, key)])
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns])
    known = df.where(F.col(target).isNotNull()).withColumns(
        {"_target": F.col(target).cast("double"), "_lacking": F.coalesce(lacking, F.lit(True))})
    filled = known.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in columns})
    rows = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="error").transform(
        filled).select(key, "_features", "_target", "_lacking")
    train, test = split_rows(rows, key, test_share, seed)
    model = RandomForestClassifier(
        featuresCol="_features", labelCol="_target", numTrees=trees, seed=seed
    ).fit(train)
    right = (F.col("prediction") == F.col("_target")).cast("double")
    scored = model.transform(test).agg(F.count("*").alias("test_rows"), F.avg(right).alias("accuracy"))
    return scored.select(
        train.agg(F.count("*")).scalar().alias("train_rows"), "test_rows", "accuracy",
        rows.agg(F.count_if("_lacking")).scalar().alias("filled_rows"),
    )


def text_features(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Simple numeric features of whole texts next to their quality label."""
    words = F.split(F.lower("text"), r"\W+")
    features = documents.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("chars"),
        F.size(words).cast("double").alias("words"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"),
        (F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1)))
        .alias("digit_share"),
        (F.size(F.split("text", "\n"))).cast("double").alias("lines"),
    )
    return features.join(labels.select("doc_id", "quality"), "doc_id")
