"""Layers, tables and their upkeep.

A rebuilt table is a new folder of parquet files plus a view that points to
it.  Replacing the view is the only step readers can see, so a job never
overwrites what it or anyone else reads, and a failed job leaves no trace but
an unused folder.
"""

import json
import uuid
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail import schemas
from voltrail.functions.measures import join_keyed
from voltrail.session import checkpointed

# Layers and the bronze table.
LAYERS = {
    "bronze": "Raw telemetry as ingested",
    "silver": "Cleaned and enriched telemetry",
    "gold": "Aggregates and dashboard tables",
}
BRONZE_TABLE = "raw_vehicle_data"
LANDING = "landing"


def safe_table_name(name: str) -> str:
    """The name, if it holds only letters, digits, ``_``, ``.`` and ``-``."""
    if not name or not all(c.isalnum() or c in "_.-" for c in name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def is_safe_name(name: Column) -> Column:
    """``safe_table_name`` as a test on a column of names."""
    return F.coalesce(name.rlike("^[\\p{L}\\p{N}_.-]+$"), F.lit(False))


def quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in safe_table_name(name).split("."))


def init_layout(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the three databases and the landing folder below ``root``."""
    for layer, comment in LAYERS.items():
        spark.sql(
            f"CREATE DATABASE IF NOT EXISTS {layer} COMMENT '{comment}' LOCATION '{root}/{layer}'"
        )
    landing = f"{root}/{LANDING}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(landing)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return {**{layer: f"{root}/{layer}" for layer in LAYERS}, LANDING: landing}


def create_bronze(spark: SparkSession, table: str = f"bronze.{BRONZE_TABLE}") -> None:
    """The bronze table; ``_ingested_at`` defaults to the time of the insert."""

    def column(f: T.StructField) -> str:
        default = " DEFAULT current_timestamp()" if f.name == "_ingested_at" else ""
        comment = f.metadata.get("comment")
        note = f" COMMENT '{comment}'" if comment else ""
        return f"`{f.name}` {f.dataType.simpleString()}{default}{note}"

    columns = ", ".join(column(f) for f in schemas.BRONZE)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns}) "
        "USING parquet COMMENT 'Raw vehicle telemetry'"
    )


def read(spark: SparkSession, layer: str, name: str) -> DataFrame:
    return spark.table(quoted(f"{layer}.{name}"))


def write_version(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` to a new version folder and return its path.

    Partitioned output is rebalanced by the partition columns first: small
    partitions share a task and a large one is split over several.
    """
    path = f"{folder}/v-{uuid.uuid4().hex}"
    spread = df.hint("rebalance", *partition_by) if partition_by else df
    spread.write.partitionBy(*partition_by).parquet(path)
    return path


def rebuild(
    df: DataFrame, table: str, folder: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Replace ``table`` by the rows of ``df``, which may read ``table`` itself."""
    spark = df.sparkSession
    path = write_version(df, f"{folder}/{safe_table_name(table)}", partition_by)
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(table)} AS SELECT {columns} FROM parquet.`{path}`")
    return spark.table(quoted(table))


def folder_system(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``, oldest first."""
    hadoop, system = folder_system(spark, path)
    if not system.exists(hadoop):
        return []
    found = [s for s in system.listStatus(hadoop) if s.isDirectory()]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: s.getModificationTime())]


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files right below ``path``."""
    hadoop, system = folder_system(spark, path)
    if not system.exists(hadoop):
        return []
    return [s.getPath().getName() for s in system.listStatus(hadoop) if s.isFile()]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; it is an error if it is there already."""
    hadoop, system = folder_system(spark, path)
    out = system.create(hadoop, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    hadoop, system = folder_system(spark, path)
    source = system.open(hadoop)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove_folders(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        hadoop, system = folder_system(spark, f"{path}/{name}")
        system.delete(hadoop, True)


def prune_versions(spark: SparkSession, table: str, folder: str, keep: int = 2) -> list[str]:
    """Remove all but the ``keep`` newest versions of a rebuilt table.

    The newest is the one its view reads; keep more than one while readers of
    older ones may still run.
    """
    path = f"{folder}/{safe_table_name(table)}"
    old = [f for f in list_folders(spark, path) if f.startswith("v-")][: -max(keep, 1)]
    remove_folders(spark, path, old)
    return old


def truncate(spark: SparkSession, table: str, folder: str) -> DataFrame:
    """Replace ``table`` by no rows of the same schema."""
    return rebuild(spark.table(quoted(table)).limit(0), table, folder)


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that are missing, as NULL."""
    missing = {n: t for n, t in columns.items() if n not in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in missing.items()})


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Append rows whose schema may add or lack columns."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` taken from the matching row of ``source``.

    ``source`` must hold one row per key.  Rows without a match stay as they are.
    """
    incoming = source.select(
        *on, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_match")
    )
    joined = join_keyed(target, incoming, on, "left")
    return joined.select(
        *[
            F.when(F.col("_match"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


# --- tables stored by partition --------------------------------------------


#: File beside the partitions that keeps a table's schema, so that one without
#: rows can be read, and none has to be inferred.
SCHEMA_FILE = "_schema"
#: A table by date starts with one folder a date as long as it has no more than
#: ``FOLDERS`` of them, or one for every ``FOLDER_ROWS`` rows.  More dates than
#: that share folders: a span of days each.
FOLDERS, FOLDER_ROWS = 16, 1_000_000
EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Layout:
    """The folders of a table stored by ``by``: one a value, or one a span of
    ``width`` days, numbered from the epoch."""

    by: str
    width: int = 1

    @property
    def column(self) -> str:
        return self.by if self.width == 1 else f"{self.by}_span"

    def folder(self, value: Column) -> Column:
        if self.width == 1:
            return value
        return F.floor(F.unix_date(value) / self.width).cast("int")

    def folders(self, values: list) -> list:
        if self.width == 1:
            return values
        return sorted({v if v is None else (v - EPOCH).days // self.width for v in values}, key=_null_first)

    def holds(self, value: Column, values: list) -> Column:
        """True for what lies in a folder that one of ``values`` lies in."""
        return _among(self.folder(value), self.folders(values))


def _null_first(value):
    return value is not None, value


def _among(value: Column, values: list) -> Column:
    known = [v for v in values if v is not None]
    return value.isin(known) | value.isNull() if None in values else value.isin(known)


def width_of(df: DataFrame, day: Column) -> int:
    """The width of spans for a table of the rows of ``df`` by ``day``."""
    counted = df.groupBy(F.unix_date(day).alias("day")).count().filter("day IS NOT NULL").collect()  # a row per date
    most, width = max(FOLDERS, sum(r["count"] for r in counted) // FOLDER_ROWS), 1
    while len({r["day"] // width for r in counted}) > most:
        width *= 2
    return width


def store_by(df: DataFrame, path: str, by: str, width: int | None = None) -> DataFrame:
    """Write a table partitioned by ``by`` and read it.

    ``width`` is that of the spans of days that share a folder; not given, it
    is found by counting the rows of ``df`` per date first.
    """
    spark = df.sparkSession
    if width is None:
        width = width_of(df, F.col(by)) if isinstance(df.schema[by].dataType, T.DateType) else 1
    layout = Layout(by, width)
    _write_by(df, layout, path)
    fields = [*[f for f in df.schema.fields if f.name != by], df.schema[by]]
    if width > 1:
        fields.append(T.StructField(layout.column, T.IntegerType(), True, {"width": width}))
    write_text(spark, f"{path}/{SCHEMA_FILE}", T.StructType(fields).json())
    return stored_by(spark, path)


def _write_by(df: DataFrame, layout: Layout, path: str, overwrite: str = "static") -> None:
    placed = df if layout.width == 1 else df.withColumn(layout.column, layout.folder(F.col(layout.by)))
    spread = placed.hint("rebalance", layout.column)
    spread.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy(layout.column).parquet(path)


def _schema(spark: SparkSession, path: str) -> T.StructType | None:
    if SCHEMA_FILE not in list_files(spark, path):
        return None
    return T.StructType.fromJson(json.loads(read_text(spark, f"{path}/{SCHEMA_FILE}")))


def layout_of(spark: SparkSession, path: str, by: str) -> Layout:
    """How the table at ``path`` is cut into folders."""
    known = _schema(spark, path)
    return Layout(by, known.fields[-1].metadata.get("width", 1) if known else 1)


def stored_by(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``store_by``, or any other parquet folder."""
    known = _schema(spark, path)
    if known is None:
        return spark.read.parquet(path)
    table, last = spark.read.schema(known).parquet(path), known.fields[-1]
    return table.drop(last.name) if "width" in last.metadata else table


def stored_in(spark: SparkSession, path: str, by: str, folders: list) -> DataFrame:
    """All rows of some folders of a stored table; a scan lists only these."""
    known = _schema(spark, path)
    table = spark.read.parquet(path) if known is None else spark.read.schema(known).parquet(path)
    layout = layout_of(spark, path, by)
    rows = table.filter(_among(F.col(layout.column), folders))
    return rows if layout.width == 1 else rows.drop(layout.column)


def stored_beside(spark: SparkSession, path: str, by: str, values: list) -> DataFrame:
    """All rows of the folders that ``values`` lie in, whole: those that
    ``replace_partitions`` replaces for these values."""
    return stored_in(spark, path, by, layout_of(spark, path, by).folders(values))


def values_of(df: DataFrame, by: str) -> list:
    """The distinct values of a partition column: one per date at most."""
    return sorted((r[0] for r in df.select(by).distinct().collect()), key=_null_first)


def replace_partitions(rows: DataFrame, path: str, by: str, values: list) -> list[str]:
    """Put ``rows`` in place of the folders of some values; all other files
    stay as they are.

    ``rows`` are all rows of these folders, see ``stored_beside``.  They may
    read the table: they are written beside it before anything is replaced, and
    stay there if the job fails on the way, so it can be run again.  Folders
    that get no rows are removed.  A reader of them should not run at that
    moment.
    """
    spark = rows.sparkSession
    if not values:
        return []
    layout = layout_of(spark, path, by)
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    _write_by(rows, layout, stage)
    given = list_folders(spark, stage)
    if given:
        _write_by(spark.read.schema(rows.schema).parquet(stage), layout, path, "dynamic")
    names = [
        f"{layout.column}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for v in layout.folders(values)
    ]
    remove_folders(spark, path, [n for n in names if n not in given])
    above, _, name = stage.rpartition("/")
    remove_folders(spark, above, [name])
    return given


def upsert_stored(
    spark: SparkSession, path: str, source: DataFrame, on: list[str], columns: list[str], by: str
) -> list:
    """``upsert`` into a stored table; only folders that hold a match are read
    whole and rewritten.  Returns the values of ``by`` with a match.

    Where ``source`` has the partition column too, only values it names are
    searched; else a scan of the key columns finds them.
    """
    source = checkpointed(source)  # read several times below
    table = stored_by(spark, path)
    searched = table
    if by in source.columns:
        named = source.select(by).distinct()
        searched = _alike(stored_beside(spark, path, by, values_of(named, by)), named, [by], "left_semi")
    found = checkpointed(_alike(searched.select(*dict.fromkeys([*on, by])), source, on, "left_semi").select(by).distinct())
    values = values_of(found, by)
    if values:
        rows = stored_beside(spark, path, by, values)
        if layout_of(spark, path, by).width == 1:
            new = upsert(rows, source, on, columns)
        else:  # other values share the folders
            beside = _alike(rows, found, [by], "left_anti")
            new = upsert(_alike(rows, found, [by], "left_semi"), source, on, columns).unionByName(beside)
        replace_partitions(new, path, by, values)
    return values


def _alike(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join in which NULL keys match each other."""
    alike = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
    return left.alias("l").join(right.select(*on).alias("r"), reduce(lambda a, b: a & b, alike), how)


def partial_rows(df: DataFrame, columns=schemas.INSERT_COLUMNS) -> DataFrame:
    """Bronze rows that fill only the insert columns; the rest is NULL."""
    empty = df.sparkSession.createDataFrame([], schemas.BRONZE)
    keyed = [c for c in ("vehicle_id",) if c in df.columns]
    return empty.unionByName(df.select(*keyed, *columns), allowMissingColumns=True)


def append_partial(df: DataFrame, table: str, columns=schemas.INSERT_COLUMNS) -> None:
    """Insert the columns a device sends directly; table defaults fill the rest."""
    keyed = [c for c in ("vehicle_id",) if c in df.columns]
    names = ", ".join(f"`{c}`" for c in (*keyed, *columns))
    df.sparkSession.sql(
        f"INSERT INTO {quoted(table)} ({names}) SELECT {names} FROM {{rows}}", rows=df
    )


def merge_read(spark: SparkSession, *paths: str) -> DataFrame:
    """Read parquet folders whose schemas grew over time."""
    return spark.read.option("mergeSchema", True).parquet(*paths)
