"""Table sources: format routing, CSV, Parquet, JSON in three orientations, JDBC, Arrow IPC."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabguard.schema import c, melt_row, nan_to_null, string_columns

# Extension -> format, database schemes, compression suffixes.
EXTENSIONS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "feather": "feather", "ftr": "feather"}
DATABASES = ("sqlite", "postgresql", "mysql", "mssql", "oracle")
COMPRESSION = (".gz", ".zip", ".bz2", ".xz")
JDBC_SCHEME = {"mssql": "sqlserver", "oracle": "oracle:thin"}


def detect_format(source: str) -> str:
    """Database URL -> ``sql``; else by extension below any compression suffix; else ``csv``."""
    if "://" in source and urlsplit(source).scheme.split("+")[0] in DATABASES:
        return "sql"
    for suffix in reversed(PurePosixPath(source).suffixes):
        if suffix.lower() not in COMPRESSION:
            return EXTENSIONS.get(suffix.lower().lstrip("."), "csv")
    return "csv"


def load_table(spark: SparkSession, source: str, format: str | None = None, **options) -> DataFrame:
    """Load ``source`` by its format; extra options go to the reader. NaN becomes null."""
    kind = format or detect_format(source)
    readers = {"csv": load_csv, "parquet": load_parquet, "json": load_json, "sql": load_sql, "feather": load_feather}
    if kind not in readers:
        raise ValueError(f"unsupported format {kind!r}; one of {sorted(readers)}")
    return nan_to_null(readers[kind](spark, source, **options))


def load_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """UTF-8 CSV with a header, quotes doubled inside quotes. Pass ``schema`` for large inputs: inference costs one more scan.

    Values with line breaks need ``multiLine=True``, which reads each file in one task.
    """
    options = {"header": True, "encoding": "UTF-8", "escape": '"', "inferSchema": schema is None, **options}
    df = spark.read.csv(path, schema=schema, **options)
    if not df.columns or df.isEmpty():
        raise ValueError(f"CSV source is empty: {path}")
    return df


def load_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


def load_json(
    spark: SparkSession, path: str, orient: str = "records", schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """``records`` (array of objects, or ``lines=True``), ``columns`` or ``index`` documents."""
    if orient == "records":
        lines = options.pop("lines", False)
        reader = spark.read.options(**options)
        return reader.json(path, schema=schema, multiLine=not lines)
    if orient not in ("columns", "index"):
        raise ValueError(f"unknown orient {orient!r}")
    document = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"),
        F.explode(F.from_json("value", "map<string,string>")).alias("_outer", "_body"),
    )
    if orient == "columns":
        as_list = F.from_json("_body", "array<string>")
        as_map = F.from_json("_body", "map<string,string>")
        is_list = F.col("_body").startswith("[")
        entries = F.when(is_list, F.transform(as_list, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))))
        cells = document.select(
            "_file", F.col("_outer").alias("_column"),
            F.inline(F.coalesce(entries, F.map_entries(as_map))).alias("_row", "_value"),
        )
    else:
        cells = document.select(
            "_file", F.col("_outer").alias("_row"), F.explode(F.from_json("_body", "map<string,string>")).alias("_column", "_value")
        )
    names = [r[0] for r in cells.select("_column").distinct().orderBy("_column").collect()]
    wide = cells.groupBy("_file", "_row").agg(
        *[F.max(F.when(F.col("_column") == n, F.col("_value"))).alias(n) for n in names]
    ).drop("_file", "_row")
    return narrow_types(wide)


def narrow_types(df: DataFrame) -> DataFrame:
    """Turn string columns whose every non-null value is a number into long or double."""
    names = string_columns(df)
    if not names:
        return df
    fits = df.agg(
        *[F.count_if(c(n).isNotNull() & c(n).try_cast("bigint").isNull()).alias(f"l{i}") for i, n in enumerate(names)],
        *[F.count_if(c(n).isNotNull() & c(n).try_cast("double").isNull()).alias(f"d{i}") for i, n in enumerate(names)],
        *[F.count(c(n)).alias(f"n{i}") for i, n in enumerate(names)],
    ).first()
    kinds = {}
    for i, n in enumerate(names):
        if fits[f"n{i}"]:
            kinds[n] = "bigint" if fits[f"l{i}"] == 0 else "double" if fits[f"d{i}"] == 0 else "string"
    return df.select(*[c(n).cast(kinds[n]).alias(n) if n in kinds else c(n) for n in df.columns])


def jdbc_options(
    source: str,
    query: str | None = None,
    table: str | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> dict[str, str]:
    """Reader options of a database URL. ``query`` wins over ``table``; one of them is required.

    With ``partition_column`` and its bounds the table is read in parallel ranges.
    """
    if not query and not table:
        raise ValueError("either table or query must be given")
    url = source
    if not source.startswith("jdbc:"):
        scheme, rest = source.split("://", 1)
        scheme = scheme.split("+")[0]
        user = re.match(r"(?:([^:@/]+)(?::([^@/]*))?@)?(.*)", rest)
        target = user.group(3)
        url = f"jdbc:sqlite:{target.removeprefix('/')}" if scheme == "sqlite" else \
            f"jdbc:{JDBC_SCHEME.get(scheme, scheme)}://{target}"
    options = {"url": url}
    if not source.startswith("jdbc:") and user.group(1):
        options["user"] = user.group(1)
        if user.group(2):
            options["password"] = user.group(2)
    if partition_column:
        if None in (lower, upper, partitions):
            raise ValueError("partition_column needs lower, upper and partitions")
        options |= {
            "dbtable": f"({query}) AS q" if query else table,
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    return options


def load_sql(spark: SparkSession, source: str, **options) -> DataFrame:
    """Needs the JDBC driver of the database on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(source, **options)).load()


def load_feather(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (one file, a folder or a glob), one task per record batch.

    The first pass lists the batches of every file, so one large file still spreads out.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("path")
    first = files.orderBy("path").first()
    if first is None:
        raise ValueError(f"no files at {path}")
    with _open_ipc(first["path"]) as reader:
        schema = from_arrow_schema(reader.schema, prefer_timestamp_ntz=True)

    def batches(rows):
        for row in rows:
            out_path, out_index = [], []
            for p in row.column("path").to_pylist():
                with _open_ipc(p) as opened:
                    out_path += [p] * opened.num_record_batches
                    out_index += range(opened.num_record_batches)
            yield pa.RecordBatch.from_pydict({"path": out_path, "batch": pa.array(out_index, pa.int32())})

    def read(rows):
        for row in rows:
            for p, i in zip(row.column("path").to_pylist(), row.column("batch").to_pylist()):
                with _open_ipc(p) as opened:
                    yield opened.get_batch(i)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = files.mapInArrow(batches, "path string, batch int").repartition(parts, "path", "batch")
    return listed.mapInArrow(read, schema)


class _open_ipc:
    """Arrow IPC reader over any file system Arrow can address by URI."""

    def __init__(self, uri: str):
        self.uri = uri

    def __enter__(self):
        import pyarrow as pa
        from pyarrow import fs

        uri = re.sub(r"^file:/+", "/", self.uri)
        # Hadoop's names of S3 are Arrow's s3.
        uri = re.sub(r"^s3[an]:", "s3:", uri)
        system, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        return pa.ipc.open_file(self.file)

    def __exit__(self, *_):
        self.file.close()


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing values and the bytes its values take."""
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}

    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.sum(F.octet_length(c(field.name)).cast("long")), F.lit(0))
        return F.count(c(field.name)) * F.lit(fixed.get(field.dataType.simpleString(), 8))

    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        aggregates += [F.count(c(field.name)).alias(f"n{i}"), size(field).alias(f"s{i}")]
    return melt_row(
        df.agg(*aggregates),
        [
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "rows": F.col("rows"),
                "missing": F.col("rows") - F.col(f"n{i}"),
                "bytes": F.col(f"s{i}").cast("long"),
            }
            for i, f in enumerate(df.schema)
        ],
    )


def type_histogram(profile: DataFrame) -> DataFrame:
    """Columns, rows and bytes per type of a :func:`column_profile`."""
    return profile.groupBy("dtype").agg(
        F.count(F.lit(1)).alias("columns"), F.max("rows").alias("rows"), F.sum("bytes").alias("bytes")
    )


def preview(df: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    """The first ``rows`` rows by ``order`` (a distributed table has no order of its own)."""
    return df.orderBy(*[c(o) for o in order]).limit(rows)
