"""CSV sources and sinks. Every sink writes a folder of part files, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import clock
from riskloom.session import freeze


CORRUPT = "_corrupt_record"


def infer_schema(
    spark: SparkSession, path: str, overrides: dict[str, str] | None = None, header: bool = True, share: float = 1.0
) -> T.StructType:
    """Column types of a CSV: those of `overrides`, the others inferred from this share of its lines.

    Times are taken as they stand, without a zone. An override of a column that is not there is an error.
    """
    reader = spark.read.option("header", header).option("inferSchema", True).option("samplingRatio", share)
    found = reader.csv(path).schema
    declared = {c: T._parse_datatype_string(kind) for c, kind in (overrides or {}).items()}
    if unknown := set(declared) - set(found.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")

    def kind(field: T.StructField) -> T.DataType:
        plain = T.TimestampNTZType() if isinstance(field.dataType, T.TimestampType) else field.dataType
        return declared.get(field.name, plain)

    return T.StructType([T.StructField(f.name, kind(f), True) for f in found])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """CSV with a declared schema; without one the types that `overrides` does not name are inferred by an extra pass."""
    if schema is None:
        schema = infer_schema(spark, path, overrides, header)
    return spark.read.option("header", header).schema(schema).option("enforceSchema", False).csv(path)


def ingest_csv(
    spark: SparkSession, path: str, overrides: dict[str, str] | None = None, share: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """A CSV with header as typed rows, and the lines that do not fit the types, as text.

    Types inferred from a sample may be too narrow for lines outside it, and an override for any. Such lines are
    kept apart, neither lost nor turned into NULLs. All is parsed once and stored with its types; both tables read that.
    """
    schema = infer_schema(spark, path, overrides, share=share)
    lines = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    reader = spark.read.schema(lines).option("header", True).option("enforceSchema", False)
    stored = freeze(reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path), "ingested")
    return stored.where(F.col(CORRUPT).isNull()).drop(CORRUPT), stored.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV with times to the microsecond."""
    times = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    writer = df.write.mode("overwrite").option("header", header)
    writer.option("timestampNTZFormat", times).option("timestampFormat", times).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_laid_out(
    df: DataFrame, name: str, by: str, order: list[str], buckets: int | None = None, path: str | None = None
) -> DataFrame:
    """A log as a table laid out by key and sorted, and the table read back.

    Rows of a key share a bucket and are sorted within it, so that later work per key begins without a shuffle: gaps,
    statistics per key and, for a table of both logs (`joins.timeline`), the link are found where the rows lie.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, *order)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def write_submission(df: DataFrame, path: str, columns: tuple[str, ...] = ("rowkey", "is_risk")) -> None:
    """Result file: key and label only, no header line."""
    write_csv(df.select(*columns), path, header=False)


def typed_trades(df: DataFrame) -> DataFrame:
    """Trades with their text time, which runs on past the seconds, as a time."""
    return df.withColumn("time", clock.parse("time"))
