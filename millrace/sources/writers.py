"""Writers and the format dispatch."""

from pyspark.sql import DataFrame, SparkSession


def export_to_csv(df: DataFrame, path, header=True, mode="overwrite", **options):
    df.write.mode(mode).option("header", header).options(**options).csv(path)


def export_to_parquet(df: DataFrame, path, compression="snappy", partition_by=(), mode="overwrite"):
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export_to_json(df: DataFrame, path, mode="overwrite"):
    """JSON lines, one record per row, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


_FORMATS = ("csv", "json", "parquet", "orc", "xml", "text")


def save_dataframe(df: DataFrame, path, file_format="parquet", mode="overwrite", **options):
    if file_format not in _FORMATS:
        raise ValueError(f"unknown format {file_format}")
    if file_format == "csv":
        options = {"header": True, **options}
    df.write.mode(mode).options(**options).format(file_format).save(path)


def load_dataframe(spark: SparkSession, path, file_format="parquet", schema=None, **options):
    if file_format not in _FORMATS:
        raise ValueError(f"unknown format {file_format}")
    if file_format == "csv":
        options = {"header": True, **({} if schema else {"inferSchema": True}), **options}
    reader = spark.read.options(**options).format(file_format)
    return (reader.schema(schema) if schema is not None else reader).load(path)
