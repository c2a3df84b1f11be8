"""Files in and out: flow CSVs, JSON lines, context folders, manifests, graph tables, Markdown."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.operators.cleaning import normalised_names


def csv_files(folder: str) -> list[str]:
    """The CSV files of a folder by name; an error if there is no folder or no file."""
    root = Path(folder)
    if not root.is_dir():
        raise FileNotFoundError(f"no folder {folder}")
    found = sorted(str(p) for p in root.glob("*.csv"))
    if not found:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return found


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The raw column names of a CSV file."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    if first is None:
        return []
    row = spark.createDataFrame([(first[0].rstrip("\r"),)], "v string").select(F.schema_of_csv(F.lit(first[0].rstrip("\r")))).first()
    n = len(spark.createDataFrame([], row[0]).columns)
    parsed = spark.createDataFrame([(first[0].rstrip("\r"),)], "v string").select(F.from_csv("v", ", ".join(f"c{i} string" for i in range(n)), {"ignoreLeadingWhiteSpace": "false"}).alias("x")).select("x.*").first()
    return [x or "" for x in parsed]


def inspect_flows(spark: SparkSession, folder: str, label: str = "Label") -> DataFrame:
    """(file, rows, columns, repeated_columns, has_label) of every CSV file; rows are lines without the header."""
    files = csv_files(folder)
    heads = []
    for f in files:
        names = [n.strip().lstrip("\ufeff").strip() for n in csv_header(spark, f)]
        heads.append((Path(f).name, len(names), sorted({n for n in names if names.count(n) > 1}), label in names))
    dim = spark.createDataFrame(heads, "file string, columns int, repeated_columns array<string>, has_label boolean")
    counts = spark.read.text(files).where("trim(value) != ''").groupBy(F.col("_metadata.file_name").alias("_f")).agg((F.count("*") - 1).alias("rows"))
    counts = counts.select(F.url_decode("_f").alias("file"), "rows")
    return dim.join(counts, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "columns", "repeated_columns", "has_label")


def read_flows(spark: SparkSession, folder: str, label: str = "Label") -> DataFrame:
    """All flow files as texts with normalised names and ``source_file``.

    Every file must have the same stripped names in the same order, and the label; else a ValueError tells which
    does not.
    """
    files = csv_files(folder)
    heads = {f: [n.strip().lstrip("\ufeff").strip() for n in csv_header(spark, f)] for f in files}
    first = heads[files[0]]
    for f, names in heads.items():
        if names != first:
            raise ValueError(f"{Path(f).name} has other columns than {Path(files[0]).name}")
    if label not in first:
        raise ValueError(f"no column {label}")
    schema = StructType([StructField(n, StringType()) for n in normalised_names(first)])
    rows = spark.read.csv(files, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE")
    return rows.select(*[F.col("`" + c + "`") for c in rows.columns], F.url_decode("_metadata.file_name").alias("source_file"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each non-blank line; a line that is no JSON gives nulls."""
    if schema is None:
        return spark.read.json(path)
    return spark.read.text(path).where("trim(value) != ''").select(F.from_json("value", schema).alias("x")).select("x.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, keys in name order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_contexts(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("validation_summary.json",)) -> DataFrame:
    """(source_file, prediction, context_json) of a folder of JSON files; summaries and files without a prediction are left out."""
    raw = spark.read.option("wholetext", True).text(f"{folder}/*.json").select(F.url_decode("_metadata.file_name").alias("source_file"), F.col("value").alias("context_json"))
    named = raw.withColumn("prediction", F.get_json_object("context_json", "$.prediction"))
    return named.where(~F.col("source_file").isin(*skip) & F.col("prediction").isNotNull()).select("source_file", "prediction", "context_json")


def read_decisions(spark: SparkSession, path: str, key: str = "example_id") -> DataFrame:
    """A review CSV by key: values trimmed, rows without a key left out, the last row of a key wins."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = normalised_names(rows.columns)
    rows = rows.toDF(*names).select(*[F.trim(F.col("`" + c + "`")).alias(c) for c in names], F.monotonically_increasing_id().alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"))
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def write_manifest(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV with these columns in this order; missing ones are empty."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two Parquet tables, partitioned by label and type, so that a hop reads its edge type alone."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table; an error if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def first_existing(paths: list[str]) -> str | None:
    """The first of some fallback paths that exists."""
    return next((p for p in paths if Path(p).exists()), None)
