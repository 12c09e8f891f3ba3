"""Record tables: scans, slices, appends and slice replacement over Parquet folders partitioned by case."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table's rows; a table that does not exist yet is empty if its schema is given. Any other failure is raised: what
    can't be read must not count as empty, since replace_slice() writes over what it has read."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def case_slice(df: DataFrame, case_id: str, key: str = "case_id") -> DataFrame:
    """One case's rows. The comparison stays on the column itself, so files and partitions are pruned."""
    kind = dict(df.dtypes).get(key)
    return df.where(F.lit(False)) if kind is None else df.where(F.col(key) == F.lit(case_id).cast(kind))


def as_text(df: DataFrame) -> DataFrame:
    """Text columns without nulls, as form-like consumers want them."""
    return df.withColumns({f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in df.schema if isinstance(f.dataType, T.StringType)})


def append(df: DataFrame, path: str, by: list[str] = ("case_id",)) -> None:
    """Adds rows with ingest_id (one a call) and ingest_seq, by which "last" is decided where no other column does."""
    tagged = df.withColumns({"ingest_seq": F.monotonically_increasing_id(), "ingested_at": F.current_timestamp(), "ingest_id": F.lit(uuid.uuid4().hex)})
    tagged.write.mode("append").partitionBy(*by).parquet(path)


def replaced(df: DataFrame, case_id: str, rows: DataFrame, remove: Column | None = None, key: str = "case_id") -> DataFrame:
    """df without the case's rows that remove holds for (all of them if none is given), then rows."""
    own = F.col(key).cast("string") == F.lit(case_id)
    gone = own if remove is None else own & F.coalesce(remove, F.lit(False))
    return df.where(~F.coalesce(gone, F.lit(False))).unionByName(rows, allowMissingColumns=True)


def replace_slice(spark: SparkSession, path: str, case_id: str, rows: DataFrame, remove: Column | None = None, key: str = "case_id") -> None:
    """Writes a case's partition anew; other partitions are neither read nor written. Rows that stay keep all their columns,
    also those that the new rows lack. The new rows are materialised first, since they may come from the partition that is
    overwritten."""
    if exists(spark, path):
        # mergeSchema: files of different batches may have different columns
        stored = spark.read.option("mergeSchema", True).parquet(path)
        part = case_slice(stored.withColumn(key, F.col(key).cast(rows.schema[key].dataType)), case_id, key)
    else:
        part = spark.createDataFrame([], rows.schema)
    merged = replaced(part, case_id, rows, remove, key)
    staged = f"{path.rstrip('/')}_staged/{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    spark.read.schema(merged.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def page_sources(pages: DataFrame, case: str, documents: list | None = None) -> DataFrame:
    """Pages with text that an extraction reads, of the given documents or of all: keys, page_number (0 if unreadable), page_text
    without blanks around it, image path and type (image/png if none), and place, from 1, by document and page within a case.

    The list of documents is what a caller names, and it is pushed to the scan. Places are numbers, so that the order
    survives a shuffle; sort by case and place where rows have to leave in order.
    """
    wanted = pages if documents is None else pages.where(F.col("case_document_id").isin([str(d) for d in documents]))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in pages.columns else F.lit("")
    whole = F.regexp_replace(said("page_text"), r"^\s+|\s+$", "")
    rows = wanted.select(
        case, "page_id", "case_document_id", F.coalesce(F.col("page_number").try_cast("int"), F.lit(0)).alias("page_number"), whole.alias("page_text"),
        said("page_image_path").alias("page_image_path"), F.coalesce(F.nullif(said("page_image_mime_type"), F.lit("")), F.lit("image/png")).alias("page_image_mime_type"),
    ).where("page_text <> ''")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(case).orderBy("case_document_id", "page_number", "page_id")))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files as rows: path, sha256, size, content (read only where it is selected)."""
    df = spark.read.format("binaryFile").load(pattern)
    return df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def safe_name(x: Column) -> Column:
    """A file's base name with letters, digits, dots, underscores and hyphens only."""
    return F.regexp_replace(F.element_at(F.split(x, r"[/\\]"), -1), r"[^\p{L}\p{N}._-]", "_")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinities are null."""
    fixed = df.withColumns({f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    return fixed.select(F.to_json(F.struct("*")).alias("json"))


def markdown(parts: DataFrame, keys: list[str], order: str, title: str, body: str) -> DataFrame:
    """Sections as one Markdown text a key."""
    section = F.struct(F.col(order).alias("o"), F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body)).alias("t"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(section)), lambda x: x["t"]), "\n\n").alias("markdown"))


def case_data(tables: dict[str, DataFrame], case: str, cases: DataFrame | None = None) -> DataFrame:
    """All that is stored on each case, of every table: case, collection, record (JSON with all columns). With cases, of those only.

    Tables are read side by side and nothing is joined but the list of cases; write it partitioned by collection, or filter by case:
    the filter reaches each table's scan.
    """
    parts = []
    for name, df in tables.items():
        rows = df if cases is None else df.join(cases.select(case).distinct(), case, "left_semi")
        parts.append(rows.select(F.col(case), F.lit(name).alias("collection"), F.to_json(F.struct(*[c for c in df.columns if c != case])).alias("record")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
