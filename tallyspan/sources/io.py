"""Reading and writing: located tables, tolerant schemas, stamped outputs, manifest and privacy audit."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that must not leave a site.
IDENTIFIERS = ["patient_id", "hospitalization_id", "icu_admission_id", "icu_interval_id", "microbiology_row_id", "organism_id", "admission_dttm", "discharge_dttm", "icu_in_dttm", "icu_out_dttm", "icu_in_dttm_clipped", "icu_out_dttm_clipped", "order_dttm", "collect_dttm", "result_dttm", "first_culture_dttm"]


def snake_case(df: DataFrame) -> DataFrame:
    """Column names in lower case with single underscores."""
    names = [re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower())).strip("_") for c in df.columns]
    return df.toDF(*names)


def locate(spark: SparkSession, root: str, name: str, kind: str, prefix: str = "") -> str:
    """The one file or folder under root named [prefix]name.kind, case aside; raises unless there is exactly one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    wanted, found, todo = {f"{prefix}{name}.{kind}".lower(), f"{name}.{kind}".lower()}, [], [path]
    while todo:
        for status in fs.listStatus(todo.pop()):
            if status.getPath().getName().lower() in wanted:
                found.append(status.getPath().toString())
            elif status.isDirectory():
                todo.append(status.getPath())
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} tables named {name} ({kind}) under {root}")
    return found[0]


def read_table(spark: SparkSession, root: str, name: str, kind: str = "parquet", prefix: str = "", schema: T.StructType | None = None, infer: bool = True) -> DataFrame:
    """A located Parquet or CSV table with snake-case names. CSV columns are typed by a schema or by their values; blanks and `NA` are null."""
    path = locate(spark, root, name, kind, prefix)
    if kind == "csv":
        reader = spark.read.option("header", True).option("nullValue", "NA").option("emptyValue", None).option("inferSchema", infer)
        return snake_case(reader.schema(schema).csv(path) if schema else reader.csv(path))
    return snake_case(spark.read.parquet(path))


def optional_table(spark: SparkSession, root: str, name: str, schema: T.StructType, kind: str = "parquet", aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The table, its columns by their aliases, or an empty one of that schema where it is missing."""
    try:
        return conform(read_table(spark, root, name, kind), schema, aliases)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType, aliases: dict[str, list[str]] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """The columns of schema: the first alias that exists, a typed null where none does; required ones must exist."""
    out = []
    for f in schema.fields:
        found = next((c for c in [f.name, *(aliases or {}).get(f.name, [])] if c in df.columns), None)
        if found is None and f.name in required:
            raise ValueError(f"column {f.name} is missing")
        if found is None and aliases and f.name in aliases:
            warnings.warn(f"no column for {f.name}: nulls", stacklevel=2)
        out.append((F.col(found).try_cast(f.dataType) if found else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def write_aggregate(df: DataFrame, path: str, site: str, run: str, kind: str = "parquet", setting: str = "ICU") -> None:
    """An aggregate, stamped with its care setting, under site_name and run_ts. A run that is repeated replaces its own rows, and no others.

    Spark writes to a staging folder and moves the partitions of this site and run into place when all tasks are done.
    """
    stamped = df.withColumns({"care_setting": F.lit(setting), "site_name": F.lit(site), "run_ts": F.lit(run)})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("site_name", "run_ts").format(kind).save(path)


def write_private(df: DataFrame, path: str, run: str, enabled: bool = True) -> None:
    """Row-level output under its own root, off by a flag. A run that is repeated replaces its own rows."""
    if enabled:
        df.withColumn("run_ts", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").parquet(path)


def latest_run(df: DataFrame) -> DataFrame:
    """The rows of the newest run_ts; the partition filter prunes the others."""
    newest = df.agg(F.max("run_ts")).first()[0]
    return df.filter(F.col("run_ts") == newest)


def write_sorted(df: DataFrame, path: str, *order: Column, kind: str = "parquet", files: int | None = None) -> None:
    """df in the given order, over several files: rows are in order in each, and the files by their names."""
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("header", True).format(kind).save(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """The exports of all sites and runs under path; a column that some sites lack is null in their rows."""
    return spark.read.option("mergeSchema", True).parquet(path)


def dataset_of(path: Column, datasets: list[str]) -> Column:
    """Which of the datasets (paths under the root) a file belongs to; the longest counts where one lies in another."""
    out = F.lit(None).cast("string")
    for d in sorted(datasets, key=len):
        out = F.when(F.contains(path, F.lit(f"/{d}/")) | F.endswith(path, F.lit(f"/{d}")), d).otherwise(out)
    return out


def export_manifest(spark: SparkSession, root: str, datasets: dict[str, str], site: str, setting: str = "ICU") -> DataFrame:
    """For each dataset (path under root: csv or parquet): site_name, care_setting, dataset, size_bytes, rows, n_columns, columns (joined by `; `), created_at.

    Sizes and times come from the listing of all files in one pass, rows of all Parquet datasets from one scan
    that reads no column, thus their footers alone, and rows of all CSV datasets from one scan. created_at is the
    time of the newest file.
    """
    names, path = list(datasets), F.col("_metadata.file_path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = listed.select(dataset_of(F.col("path"), names).alias("dataset"), "length", "modificationTime")
    sizes = files.filter("dataset IS NOT NULL").groupBy("dataset").agg(F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("created_at"))
    rows, facts = None, []
    for kind in sorted(set(datasets.values())):
        own = [f"{root}/{d}" for d, k in datasets.items() if k == kind]
        reader = spark.read.option("recursiveFileLookup", True)
        found = reader.option("header", True).schema("_first string").csv(own) if kind == "csv" else reader.schema(T.StructType()).parquet(*own)
        counted = found.groupBy(dataset_of(path, names).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
        rows = counted if rows is None else rows.unionByName(counted)
    for d, kind in sorted(datasets.items()):
        columns = (spark.read.option("header", True).csv(f"{root}/{d}") if kind == "csv" else spark.read.parquet(f"{root}/{d}")).columns
        facts.append(F.struct(F.lit(d).alias("dataset"), F.lit(len(columns)).alias("n_columns"), F.lit("; ".join(columns)).alias("columns")))
    known = spark.range(1).select(F.inline(F.array(*facts)))
    out = known.join(sizes, "dataset", "left").join(rows, "dataset", "left")
    stamps = {"site_name": F.lit(site), "care_setting": F.lit(setting), "rows": F.coalesce("rows", F.lit(0))}
    return out.withColumns(stamps).select("site_name", "care_setting", "dataset", "size_bytes", "rows", "n_columns", "columns", "created_at")


def privacy_violations(manifest: DataFrame, identifiers: list[str] = IDENTIFIERS) -> DataFrame:
    """dataset, column of every listed name or name that ends in _datetime."""
    rows = manifest.select("dataset", F.explode(F.split("columns", "; ")).alias("column"))
    name = F.lower("column")
    return rows.filter(name.isin(identifiers) | name.rlike(r"(^|_)datetime$"))


def privacy_audit(manifest: DataFrame) -> None:
    """Raises if any dataset of the manifest has an identifier or an exact time."""
    bad = privacy_violations(manifest).limit(20).collect()
    if bad:
        raise PermissionError("; ".join(f"{r['dataset']}: {r['column']}" for r in bad))
