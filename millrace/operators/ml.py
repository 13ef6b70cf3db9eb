"""Failure-risk model: sample, label, balance, split, random forest, evaluate,
save/load, score (M1-M11), all Spark ML.

Sampling and the train/test split use a seeded hash of each row's key, so they
are repeatable and independent of partitioning; the exact-n sample ranks by
that hash without pulling anything to the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import hash_unit, risk_band, safe_div
from millrace.operators import selection as S

# Model inputs and settings of the reference training run.
FEATURES = ["Temperature", "Vibration", "Power_Consumption"]
RISK_STATUSES = ["Error", "Warning"]
SAMPLE_ROWS = 250_000
SYNTHETIC_ROWS = 5_000
SYNTHETIC_MEANS_SDS = {"Temperature": (110.0, 10.0), "Vibration": (7.5, 1.0),
                       "Power_Consumption": (140.0, 15.0)}
NUM_TREES, MAX_DEPTH, SEED = 50, 10, 42
TEST_SHARE = 0.2


def _hash(df: DataFrame, cols: Sequence[str], seed: int) -> Column:
    """Hash uniform of a row's key; times enter as microseconds, so other engines can repeat it."""
    def plain(c: str) -> Column:
        timed = isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))
        return F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c)
    return hash_unit(F.lit(seed), *[plain(c) for c in cols])


def sample_n(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, repeatable (M1).

    The sample is the first ``n`` rows in the order of the seeded hash of the
    key and then of the hash of the whole row, so rows that share a key are told
    apart, and of rows that are equal in every column as many are taken as are
    still wanted. Neither the layout of the table nor the number of cores
    matters. The n-th row is found by counts per 16 bits of these hashes; the
    rows taken are then counted per distinct row, with partial counts first, so
    a key or a row that stands in most of the table is not gathered anywhere.
    """
    bits = F.floor(_hash(df, key_cols, seed) * float(1 << 32)).cast("long")
    whole = F.xxhash64(*df.columns)
    rows = df.withColumn("_bits", bits).withColumn("_row", whole).select(
        "*", F.shiftright("_bits", 16).alias("_d0"), F.col("_bits").bitwiseAND(F.lit(0xFFFF)).alias("_d1"),
        F.shiftright("_row", 48).alias("_d2")).drop("_bits")
    digits = ["_d0", "_d1", "_d2"]
    first = S.cut(rows.groupBy("_d0").agg(F.count(F.lit(1)).alias("_c")), ["_d0"], F.lit(n).cast("long"))
    taken = S.first_rows(rows, digits, first).groupBy(*df.columns, "_row", "_wanted").agg(F.count(F.lit(1)).alias("_c"))
    group = S.spread(F.col("_wanted").isNull(), "_row")
    earlier = Window.partitionBy(group).orderBy("_row", *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_wanted") - F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    take = taken.withColumn("_take", F.when(F.col("_wanted").isNull(), F.col("_c")).otherwise(F.least(F.col("_c"), left)))
    return S.copies(take.where(F.col("_take") > 0).select(*df.columns, "_take"), "_take")


def label(df: DataFrame, status_col: str = "Running_Status") -> DataFrame:
    """1 when the status is Error or Warning, else 0 (M2)."""
    return df.withColumn("label", F.col(status_col).isin(RISK_STATUSES).cast("int"))


def synthetic_failures(spark: SparkSession, n: int = SYNTHETIC_ROWS, seed: int = SEED) -> DataFrame:
    """Extreme high-temperature/vibration/power rows with label 1 (M4)."""
    base = spark.range(n)

    def normal(i: int):
        """Box-Muller on two hash uniforms of the row's number: the same on any number of cores."""
        u = 1.0 - hash_unit(F.col("id"), F.lit(seed), F.lit(2 * i))
        v = hash_unit(F.col("id"), F.lit(seed), F.lit(2 * i + 1))
        return F.sqrt(-2.0 * F.log(u)) * F.cos(v * 2.0 * 3.141592653589793)

    cols = [(F.lit(mu) + F.lit(sd) * normal(i)).alias(c)
            for i, (c, (mu, sd)) in enumerate(SYNTHETIC_MEANS_SDS.items())]
    return base.select(F.concat(F.lit("synthetic-"), F.col("id").cast("string")).alias("_key"),
                       *cols, F.lit(1).alias("label"))


def split(df: DataFrame, key_cols: Sequence[str], test_share: float = TEST_SHARE,
          seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Stable 80/20 split by hash bucket of the key (M5)."""
    u = _hash(df, key_cols, seed + 1)
    return df.where(u < 1 - test_share), df.where(u >= 1 - test_share)


def training_frame(readings: DataFrame, key_cols: Sequence[str], sample_rows: int = SAMPLE_ROWS,
                   synthetic_rows: int = SYNTHETIC_ROWS) -> DataFrame:
    """Sample + label + synthetic balance, features not null."""
    s = sample_n(readings, sample_rows, key_cols)
    real = label(s).select(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]).alias("_key"),
                           *[F.col(c).cast("double").alias(c) for c in FEATURES], "label")
    synth = synthetic_failures(readings.sparkSession, synthetic_rows)
    return real.unionByName(synth).dropna(subset=FEATURES)


def fit(train: DataFrame) -> PipelineModel:
    """VectorAssembler + RandomForest(50 trees, depth 10, seed 42) (M3, M6).

    ``maxMemoryInMB`` lets one pass over the data split more tree nodes and
    ``cacheNodeIds`` keeps each row's node position between passes; both
    change how the forest is trained, not the forest.
    """
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=NUM_TREES,
                               maxDepth=MAX_DEPTH, seed=SEED, maxMemoryInMB=1024, cacheNodeIds=True),
    ])
    return pipe.fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds Risk_Pct = P(class 1) x 100 and Risk_Band.

    A row with a missing feature stays, with a NULL risk and prediction.
    """
    whole = F.lit(True)
    for c in FEATURES:
        whole = whole & F.col(c).isNotNull()
    filled = df.withColumn("_whole", whole).withColumn("_given", F.struct(*FEATURES))
    for c in FEATURES:
        filled = filled.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    out = model.transform(filled)
    for c in FEATURES:
        out = out.withColumn(c, F.col("_given")[c])
    out = out.withColumn("prediction", F.when(F.col("_whole"), F.col("prediction")))
    risk = F.when(F.col("_whole"), vector_to_array("probability")[1] * 100.0)
    return (out.withColumn("Risk_Pct", risk).withColumn("Risk_Band", risk_band("Risk_Pct"))
               .drop("features", "rawPrediction", "probability", "_whole", "_given"))


def evaluate(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Accuracy and per-class precision / recall / F1 / support (M7).

    One aggregate of (label, prediction) counts -- at most classes^2 rows --
    spread into per-class contributions; accuracy is a window over the few
    class rows.
    """
    lab = F.col(label_col).cast("int")
    prd = F.col(pred_col).cast("int")
    counts = pred.groupBy(lab.alias("l"), prd.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero)
    parts = counts.select(F.inline(F.array(
        F.struct(F.col("l").alias("Class"), F.col("n").alias("s"), hit.alias("t"), zero.alias("q")),
        F.struct(F.col("p").alias("Class"), zero.alias("s"), zero.alias("t"), F.col("n").alias("q")))))
    per = parts.groupBy("Class").agg(F.sum("s").alias("Support"), F.sum("t").alias("tp"),
                                     F.sum("q").alias("predicted"))
    everything = Window.partitionBy()
    precision = F.coalesce(safe_div("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(safe_div("tp", "Support"), F.lit(0.0))
    out = per.select("Class", precision.alias("Precision"), recall.alias("Recall"), "Support",
                     safe_div(F.sum("tp").over(everything), F.sum("Support").over(everything)).alias("Accuracy"))
    f1 = F.coalesce(safe_div(2.0 * F.col("Precision") * F.col("Recall"),
                             F.col("Precision") + F.col("Recall")), F.lit(0.0))
    return out.withColumn("F1", f1)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The saved model, or None when there is none (scoring then reports no risk)."""
    try:
        return PipelineModel.load(path)
    except Exception:  # noqa: BLE001 - a missing or unreadable model means "no model"
        return None
