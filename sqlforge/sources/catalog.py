"""S3: database catalogs from Parquet footers (one folder per database, one file set per table)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import materialize

log = logging.getLogger(__name__)

CATALOG_SCHEMA = T.StructType([
    T.StructField("db_ord", T.IntegerType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("table_ord", T.IntegerType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("col_ord", T.IntegerType()),
    T.StructField("col_name", T.StringType()),
    T.StructField("col_type", T.StringType()),
    T.StructField("is_pk", T.BooleanType()),
])
FK_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("fk_ord", T.IntegerType()),
    T.StructField("t1", T.StringType()),
    T.StructField("c1", T.StringType()),
    T.StructField("t2", T.StringType()),
    T.StructField("c2", T.StringType()),
])

# The driver tables grouped into three databases, tables in declaration order.
DRIVER_LAYOUT = [
    ("sales", ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]),
    ("clickstream", ["events"]),
    ("corpus", ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]),
]
DRIVER_PKS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
              "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
              "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
              "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}
DRIVER_FKS = [
    ("sales", "nation", "n_regionkey", "region", "r_regionkey"),
    ("sales", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("sales", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("sales", "orders", "o_custkey", "customer", "c_custkey"),
    ("sales", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("sales", "lineitem", "l_partkey", "part", "p_partkey"),
    ("sales", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("corpus", "labels", "doc_id", "documents", "doc_id"),
]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _table_rows(spark, db_ord, db_id, tables, pks):
    """Catalog rows of one database; an unreadable database gives no table rows."""
    rows = []
    try:
        for t_ord, (name, path) in enumerate(tables):
            schema = spark.read.parquet(path).schema  # footer only, no data read
            for c_ord, f in enumerate(schema.fields):
                rows.append((db_ord, db_id, t_ord, name, c_ord, f.name, f.dataType.simpleString(),
                             pks.get(name) == f.name))
    except Exception as e:  # unreadable: empty schema, run goes on
        log.warning("cannot read database %s: %s", db_id, str(e)[:200])
        return []
    return rows


def catalog_from_tables(spark: SparkSession, sf_dir: str, layout=DRIVER_LAYOUT,
                        pks=DRIVER_PKS) -> DataFrame:
    """Catalog of tables stored as ``<sf_dir>/<table>.parquet``, grouped by ``layout``."""
    rows = []
    for db_ord, (db_id, tables) in enumerate(layout):
        rows += _table_rows(spark, db_ord, db_id,
                            [(t, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables], pks)
    return _written(spark, rows)


def scan_catalog(spark: SparkSession, root: str, pks: dict | None = None) -> DataFrame:
    """S3: every ``<root>/<db_id>/<table>.parquet`` is a table of database ``db_id``.

    Databases and tables are listed in name order through the Hadoop file
    system. Only footers are read. A database whose files cannot be read keeps
    no table rows (it still appears in :func:`database_ids`).
    """
    root_p, fs = _fs(spark, root)
    rows = []
    dbs = sorted((s.getPath().getName(), s.getPath().toString())
                 for s in fs.listStatus(root_p) if s.isDirectory())
    for db_ord, (db_id, db_path) in enumerate(dbs):
        rows += _table_rows(spark, db_ord, db_id, tables_of(spark, db_path), pks or {})
    return _written(spark, rows)


def tables_of(spark: SparkSession, db_path: str) -> list[tuple[str, str]]:
    """(name, path) of the tables of one database folder, by name."""
    p, fs = _fs(spark, db_path)
    return sorted((s.getPath().getName()[: -len(".parquet")], s.getPath().toString())
                  for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def _written(spark: SparkSession, rows: list) -> DataFrame:
    """The catalog as a written table, whose size Spark knows when it plans joins."""
    return materialize(spark.createDataFrame(rows, CATALOG_SCHEMA).coalesce(1), "catalog")


def database_ids(spark: SparkSession, root: str) -> DataFrame:
    """All database folders below ``root`` with their order (readable or not)."""
    root_p, fs = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(root_p) if s.isDirectory())
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "db_ord int, db_id string")


def foreign_keys(spark: SparkSession, fks=DRIVER_FKS) -> DataFrame:
    rows, seen = [], {}
    for db_id, t1, c1, t2, c2 in fks:
        seen[db_id] = seen.get(db_id, -1) + 1
        rows.append((db_id, seen[db_id], t1, c1, t2, c2))
    return spark.createDataFrame(rows, FK_SCHEMA)
