"""Writers and report renderings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that spark.checkpoint.dir names; only a session on one machine may do without."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """CSV with a header; ``single`` is for tables of report size."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_texts(docs: DataFrame, path: str, by: str = "folder", mode: str = "overwrite") -> None:
    """A tree of text files: a folder for each value of ``by``, in it one for each name, which holds the text (whole lines)."""
    docs.select(by, "name", F.coalesce("text", F.lit("")).alias("value")).write.mode(mode).partitionBy(by, "name").text(path)


def with_total_row(df: DataFrame, label: str, name: str, measures: Sequence[str], average: bool = False, decimals: int = 2) -> DataFrame:
    """df and a last row with the sums, or the rounded means, of ``measures``."""
    one = (lambda c: F.round(F.avg(c), decimals)) if average else F.sum
    return df.select(label, *measures).unionByName(df.agg(F.lit(name).alias(label), *[one(c).alias(c) for c in measures]))


def markdown(df: DataFrame, right: Sequence[str] = (), limit: int = 1000) -> str:
    """A Markdown table, made by the executors as lines; the columns in ``right`` are aligned right. Of a longer table than ``limit``
    rows the first are shown, and a last line says so."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    rows = [r[0] for r in df.select(line).limit(limit + 1).collect()]
    if len(rows) > limit:
        rows[limit:] = [f"\n(the first {limit} rows of more)"]
    head = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "|".join("---:" if c in right else "---" for c in df.columns) + "|"
    return "\n".join([head, rule, *rows])


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Report-sized tables as sheets of one file, where an Excel writer is installed."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name[:31], index=False)
