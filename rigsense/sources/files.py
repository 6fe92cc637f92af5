"""CSV, Parquet and JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense.functions.exprs import parse_time, to_int, to_number


# Full precision; the default writes milliseconds only.
CSV_OPTIONS = {"header": True, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV with every column as text, plus ``_file`` and ``_pos`` giving file order.

    Text first, so that values which fail to parse can be counted. CSV has no row index; the
    running id is ordered within a file, which is all that keep-first and keep-last need.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return raw.withColumns({"_file": F.col("_metadata.file_path"), "_pos": F.monotonically_increasing_id()})


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to their types; values that do not parse become NULL."""
    parse = {
        "timestamp": lambda c: parse_time(F.col(c)), "double": lambda c: to_number(F.col(c)),
        "int": lambda c: to_int(F.col(c)), "boolean": lambda c: F.col(c).try_cast("boolean"),
        "string": lambda c: F.col(c),
    }
    return df.withColumns({c: parse[t](c) for c, t in types.items() if c in df.columns})


def files_size(df: DataFrame) -> DataFrame:
    """Total bytes of the files behind a file-based DataFrame, from their metadata."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
    return files.groupBy("p").agg(F.max("s").alias("s")).agg(F.sum("s").alias("n_bytes"))


def write_parquet_csv(df: DataFrame, path: str, csv: bool = True) -> dict[str, str]:
    """Parquet, and optionally a CSV export next to it; returns the folders."""
    written = {"parquet": f"{path}/parquet"}
    df.write.mode("overwrite").parquet(written["parquet"])
    if csv:
        written["csv"] = f"{path}/csv"
        back = df.sparkSession.read.schema(df.schema).parquet(written["parquet"])
        back.write.mode("overwrite").options(**CSV_OPTIONS).csv(written["csv"])
    return written


def write_json_report(report: DataFrame, path: str) -> str:
    """A small report as JSON lines."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_risk_outputs(risk: DataFrame, alerts: DataFrame, path: str) -> dict[str, str]:
    out = {"risk_predictions_csv": f"{path}/risk", "alerts_csv": f"{path}/alerts"}
    risk.write.mode("overwrite").options(**CSV_OPTIONS).csv(out["risk_predictions_csv"])
    alerts.write.mode("overwrite").options(**CSV_OPTIONS).csv(out["alerts_csv"])
    return out
