"""Scans, sinks, stored intermediate results and file inventories."""

from __future__ import annotations

import hashlib
import json
import uuid
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, MapType, NumericType, StructField, StructType

from pulseframe.functions.keyed import uniform
from pulseframe.session import settle

MIB = float(2**20)


def csv_to_parquet(spark: SparkSession, src: str, dst: str, schema: StructType | str | None = None) -> DataFrame:
    """Read CSV (gzip included) with a header and write it as parquet.

    A gzip file cannot be split, so its rows are spread over the cluster before writing. Give the
    schema for large files: inferring it reads them twice.
    """
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(src) if schema is not None else reader.option("inferSchema", True).csv(src)
    if src.endswith(".gz"):
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    rows.write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


def write_csv(df: DataFrame, path: str, compression: str = "none") -> str:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)
    return path


def training_scan(spark: SparkSession, path: str, labels: DataFrame | None = None, variables: list[str] | None = None) -> DataFrame:
    """Events with the four training columns only, of labeled stays and listed variables.

    The variable list reaches the parquet scan; the stays are a semi-join.
    """
    events = spark.read.parquet(path).select("stay_id", "minute", "variable", "value")
    if variables is not None:
        events = events.filter(F.col("variable").isin(variables))
    if labels is not None:
        events = events.join(labels.select("stay_id"), "stay_id", "left_semi")
    return events


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path (local, HDFS or object store) and the path on it."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def input_state(spark: SparkSession, paths: list[str]) -> list[tuple]:
    """Files, bytes and an order-free digest of the names, sizes and times of the data files below each path.

    Spark lists the files (in parallel where there are many) and one aggregate sums them up; no file
    is opened and only one row a path reaches the driver. Files that Spark's readers pass over
    (names starting with ``_`` or ``.``) don't count.
    """
    states = []
    for path in paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        facts = [F.col("path"), F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")]
        digest = F.md5(F.concat_ws("|", *facts))
        halves = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
        found = listed.agg(F.count(F.lit(1)), F.sum("length"), *halves).first()
        states.append((path, *found))
    return states


def table_key(spark: SparkSession, name: str, params: dict, inputs: list[str] = ()) -> str:
    """Name of a stored result: the parameters and the state of the input files decide it."""
    text = json.dumps([params, sorted(input_state(spark, inputs))], sort_keys=True, default=str)
    return f"{name}_{hashlib.md5(text.encode()).hexdigest()}"


def same_schema(a: StructType, b: StructType) -> bool:
    """Equal names, types and nullability, in any order."""
    def entries(s):
        return {(f.name, f.dataType.simpleString(), f.nullable) for f in s.fields}

    return entries(a) == entries(b)


#: Literals for the types that a cast from zero can't reach.
_BLANK = {
    "string": "''", "binary": "X''", "boolean": "false", "date": "DATE'1970-01-01'", "timestamp": "TIMESTAMP'1970-01-01 00:00:00'",
    "timestamp_ntz": "TIMESTAMP_NTZ'1970-01-01 00:00:00'",
}


def _blank(kind: DataType) -> Column | None:
    """Any value of a type that is known not to be null; None where there is no such literal."""
    if isinstance(kind, NumericType):
        return F.lit(Decimal(0) if isinstance(kind, DecimalType) else 0).cast(kind)
    if isinstance(kind, ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, StructType):
        parts = [_blank(f.dataType) for f in kind.fields]
        named = [p.alias(f.name) for p, f in zip(parts, kind.fields) if p is not None]
        return F.struct(*named) if named and len(named) == len(parts) else None
    return F.expr(_BLANK[kind.simpleString()]) if kind.simpleString() in _BLANK else None


def _as_nullable(kind: DataType) -> DataType:
    """The type as parquet files give it back: nullable at every depth."""
    if isinstance(kind, ArrayType):
        return ArrayType(_as_nullable(kind.elementType), True)
    if isinstance(kind, MapType):
        return MapType(_as_nullable(kind.keyType), _as_nullable(kind.valueType), True)
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _as_nullable(f.dataType), True) for f in kind.fields])
    return kind


def _restored(column: Column, kind: DataType, nullable: bool) -> Column:
    """The column with the nullability of a stored schema, at every depth (parquet reads all as nullable).

    The literals only tell Spark that a value is there: what was written as not null has none that
    they could replace. Columns without anything to restore stay plain, so filters reach the scan.
    """
    if kind != _as_nullable(kind):
        if isinstance(kind, ArrayType):
            column = F.transform(column, lambda x: _restored(x, kind.elementType, kind.containsNull))
        elif isinstance(kind, MapType):
            inner = F.transform_keys(column, lambda k, _: _restored(k, kind.keyType, False))
            column = F.transform_values(inner, lambda _, v: _restored(v, kind.valueType, kind.valueContainsNull))
        else:
            fields = [_restored(column.getField(f.name), f.dataType, f.nullable).alias(f.name) for f in kind.fields]
            whole = F.struct(*fields)
            return F.when(column.isNotNull(), whole) if nullable else whole
    blank = None if nullable else _blank(kind)
    return column if blank is None else F.coalesce(column, blank)


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """What is stored at ``path``: the folder of the rows and their schema; None before the first whole write."""
    system, done = _file_system(spark, f"{path}/manifest/_SUCCESS")
    if not system.exists(done):
        return None
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0])


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The table stored at ``path`` with the schema it was written with."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no whole table is stored at {path}")
    schema = StructType.fromJson(manifest["schema"])
    stored = spark.read.schema(schema).parquet(f"{path}/{manifest['rows']}")
    return stored.select(*[_restored(F.col(f"`{f.name}`"), f.dataType, f.nullable).alias(f.name) for f in schema.fields])


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Reuse the table stored at ``path`` if its schema matches, else write it; return the stored table.

    Written in two phases: the rows go to a folder of their own, then a manifest names that folder
    and the schema. A write that breaks off before the manifest is there leaves the earlier table in
    force, or none; it is never taken for a stored one. The rows of a replaced table are deleted
    after the manifest names the new ones.
    """
    spark = df.sparkSession
    earlier = _manifest(spark, path)
    if earlier and same_schema(StructType.fromJson(earlier["schema"]), df.schema):
        return read_stored(spark, path)
    rows = f"rows-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{rows}")
    text = json.dumps({"rows": rows, "schema": json.loads(df.schema.json())})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    if earlier:
        system, replaced = _file_system(spark, f"{path}/{earlier['rows']}")
        system.delete(replaced, True)
    return read_stored(spark, path)


def file_inventory(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows and MiB of each parquet table, and a ``Total`` row; no column is read."""
    def files(name, path):
        facts = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
        return spark.read.parquet(path).select(F.lit(name).alias("file"), *facts)

    every = reduce(DataFrame.unionByName, [files(n, p) for n, p in tables.items()])
    per_file = every.groupBy("file", "path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
    return per_file.rollup("file").agg(
        F.sum("rows").alias("rows"), (F.sum("bytes") / MIB).alias("size_mb")
    ).withColumn("file", F.coalesce("file", F.lit("Total")))


def write_splits(
    labels: DataFrame, demographics: DataFrame, events: DataFrame, label_splits: DataFrame, splits: DataFrame, path: str
) -> dict[str, str]:
    """Write labels, demographics and events partitioned by ``split``; returns the paths.

    Labels follow the labeled splits, the others the complete ones.
    """
    outputs = {
        "labels": labels.select("stay_id", "died").join(label_splits, "stay_id"),
        "demographics": demographics.join(splits, "stay_id"),
        "events": events.join(splits, "stay_id"),
    }
    paths = {}
    for name, df in outputs.items():
        paths[name] = f"{path}/{name}.parquet"
        df.write.mode("overwrite").partitionBy("split").parquet(paths[name])
    return paths


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.filter(F.col("split") == split).drop("split")


def sample_dataset(
    labels: DataFrame, events: DataFrame, demographics: DataFrame, fraction: float = 0.01, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A small consistent dataset: a sample of labels with their events and demographics."""
    chosen = settle(labels.filter(uniform(["stay_id"], seed, "fixture") < F.lit(float(fraction))))
    keys = chosen.select("stay_id")
    return chosen, events.join(keys, "stay_id", "left_semi"), demographics.join(keys, "stay_id", "left_semi")
