"""Tabular sources: descriptor CSVs, metric CSVs and Parquet stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("R2", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAE", T.DoubleType()),
    T.StructField("Pearson_r", T.DoubleType()),
    T.StructField("Spearman_rho", T.DoubleType()),
])


# One bit per type that holds a value; a value's types are the ones it can be widened to.
INT, LONG, DOUBLE, DATE, TIMESTAMP, BOOLEAN = (1 << k for k in range(6))
_LATTICE = ((INT, T.IntegerType()), (LONG, T.LongType()), (DOUBLE, T.DoubleType()), (DATE, T.DateType()),
            (TIMESTAMP, T.TimestampType()), (BOOLEAN, T.BooleanType()))


def _types_of(name: str) -> F.Column:
    """The types (as bits) that hold a text value: NULL for no value, 0 for text only."""
    c = F.col(name)
    stamp = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
    whole = (F.lit(DOUBLE) + F.when(c.try_cast("long").isNotNull(), LONG).otherwise(0) + F.when(c.try_cast("int").isNotNull(), INT).otherwise(0))
    return (F.when(c.isNull() | (F.length(c) == 0), F.lit(None).cast("int")).when(c.rlike(r"^[+-]?\d+$"), whole)
            .when(c.rlike(r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|-?Inf)$"), DOUBLE)
            .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), DATE + TIMESTAMP)
            .when(c.rlike(stamp) & c.try_cast("timestamp").isNotNull(), TIMESTAMP)
            .when(F.lower(c).isin("true", "false"), BOOLEAN).otherwise(0))


def infer_types(text: DataFrame) -> T.StructType:
    """Per text column the least type that holds all its values, by one aggregate over every row.

    Types form a lattice (int < long < double, date < timestamp, boolean; text holds all), so the types of a column are the
    bits that all its values share: partial results merge in any order, and a column without values stays text.
    """
    names = [f"c{i}" for i in range(len(text.columns))]
    found = text.toDF(*names).agg(*[F.bit_and(_types_of(c)).alias(c) for c in names]).first()
    least = lambda bits: next((t for bit, t in _LATTICE if (bits or 0) & bit), T.StringType())
    return T.StructType([T.StructField(c, least(found[n])) for c, n in zip(text.columns, names)])


def read_descriptor_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV of per-design descriptors.

    With a schema the read is typed and single-pass. Without one, every row is read once as text to find the
    columns' types (``infer_types``), whatever the file's length, so no value is lost.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema or infer_types(reader.csv(path))).csv(path)


def read_metrics_csv(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Metric table ``model,R2,RMSE,MAE,Pearson_r,Spearman_rho`` [+ extra columns]."""
    schema = METRICS_SCHEMA
    if extra is not None:
        schema = T.StructType(METRICS_SCHEMA.fields + extra.fields)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_store(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet store read with column projection (pruned at the scan)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
