"""Collections, topics and indexes in Spark's catalog: tables, with their options as table properties."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(name: str) -> str:
    if not name or not name.replace("_", "").isalnum():
        raise ValueError(f"not a name: {name!r}")
    return name


def _files(spark: SparkSession, path: str):
    """A folder with its file system, by Hadoop's API, as it may be remote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, name: str) -> str:
    """The folder of a table's versions, each a folder of files; the table's location points to one of them."""
    return f"{spark.catalog.getDatabase(spark.catalog.currentDatabase()).locationUri.rstrip('/')}/{name}__versions"


def _location(spark: SparkSession, name: str) -> str:
    return spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first().data_type


def create_collection(df: DataFrame, name: str, options: dict[str, str] | None = None, kind: str = "collection") -> None:
    """A new table with the rows (and schema) of df. A table of that name raises ValueError."""
    spark = df.sparkSession
    if spark.catalog.tableExists(_name(name)):
        raise ValueError(f"{name} exists")
    df.write.format("parquet").option("path", f"{_versions(spark, name)}/{uuid.uuid4().hex}").saveAsTable(name)
    _set_property(spark, name, "option.__kind", kind)
    for key, value in (options or {}).items():
        _set_property(spark, name, f"option.{key}", value)


def drop_collection(spark: SparkSession, name: str) -> None:
    """Nothing happens if it isn't there."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")
    where, fs = _files(spark, _versions(spark, name))
    fs.delete(where, True)


def list_collections(spark: SparkSession, kind: str = "collection") -> list[str]:
    """Names of the tables of a kind: collection, topic, queues or keys. Tables made elsewhere are collections."""
    names = sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)
    return [n for n in names if _properties(spark, n).get("option.__kind", "collection") == kind]


def replace_rows(df: DataFrame, name: str) -> None:
    """Put df, which may read the table, in the table's place: a new version is written, then the table's location moves to it in one step.

    A crash before that step leaves the old version in place. The version before this one is kept for those who still read it, older ones go. One writer at a time.
    """
    spark = df.sparkSession
    have = {f.name: f.dataType for f in spark.table(_name(name)).schema}
    old, new = _location(spark, name), f"{_versions(spark, name)}/{uuid.uuid4().hex}"
    df.write.parquet(new)
    if any(f.name in have and have[f.name] != f.dataType for f in df.schema) or [c for c in df.columns if c in have] != list(have):
        # a changed type, a lost column or another order needs a new table; the files of both versions are there all the time
        properties = _properties(spark, name)
        spark.sql(f"DROP TABLE {name}")
        spark.catalog.createTable(name, path=new, source="parquet", schema=df.schema)
        for key, value in properties.items():
            _set_property(spark, name, key, value)
    else:
        for f in df.schema:
            if f.name not in have:
                spark.sql(f"ALTER TABLE {name} ADD COLUMNS (`{f.name}` {f.dataType.simpleString()})")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{new}'")
    spark.catalog.refreshTable(name)
    where, fs = _files(spark, _versions(spark, name))
    for version in fs.listStatus(where) if fs.exists(where) else []:
        if version.getPath().getName() not in (old.rsplit("/", 1)[-1], new.rsplit("/", 1)[-1]):
            fs.delete(version.getPath(), True)


def _set_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{key}' = '{text}')")


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {_name(name)}").where(F.col("key").rlike("^(option|index)[.]")).collect()
    return {r.key: r.value for r in rows if r.key != "option.path"}  # Spark's own, for a table at a path


def options(spark: SparkSession, name: str) -> dict[str, str]:
    return {k.removeprefix("option."): v for k, v in _properties(spark, name).items() if k.startswith("option.") and k != "option.__kind"}


def create_index(spark: SparkSession, collection: str, name: str, keys: dict[str, int], unique: bool = False, sparse: bool = False) -> None:
    """Record an index; one of that name is replaced. A unique one is checked by Collection on inserts. Scans prune by Parquet statistics instead."""
    _set_property(spark, _name(collection), f"index.{_name(name)}", json.dumps({"keys": keys, "unique": unique, "sparse": sparse}))


def drop_index(spark: SparkSession, collection: str, name: str) -> None:
    spark.sql(f"ALTER TABLE {_name(collection)} UNSET TBLPROPERTIES IF EXISTS ('index.{_name(name)}')")


def list_indexes(spark: SparkSession, collection: str) -> dict[str, dict]:
    found = {k.removeprefix("index."): json.loads(v) for k, v in _properties(spark, collection).items() if k.startswith("index.")}
    return dict(sorted(found.items()))
