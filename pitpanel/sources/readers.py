"""Sources: relational, partitioned, contract-checked and provenance-tagged scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.functions import expr as X


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """Parquet scan; columns and predicate reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0,
              partitions: int = 1, **options: str) -> DataFrame:
    """Relational source; with a numeric column the read is split into parallel ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return r.load()


def read_years(spark: SparkSession, path: str, years: Sequence[int], schema: T.StructType | None = None, year: str = "year") -> DataFrame:
    """Year-partitioned table; the filter prunes partitions, a declared schema replaces inference."""
    r = spark.read.option("mergeSchema", schema is None)
    df = (r.schema(schema) if schema is not None else r).parquet(path)
    return df.filter(F.col(year).isin(*years))


def read_years_relaxed(spark: SparkSession, path: str, years: Sequence[int], year: str = "year") -> DataFrame:
    """Year folders that disagree on columns or types: each is read with its own schema, then missing columns are null and types widen."""
    return union_relaxed([spark.read.parquet(f"{path}/{year}={y}").withColumn(year, F.lit(y)) for y in years])


_WIDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def _supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDER and type(b) in _WIDER:
        return max(a, b, key=lambda t: _WIDER.index(type(t)))
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name over frames that disagree in columns or types: missing columns are null, types widen."""
    types: dict[str, T.DataType] = {}
    for f in frames:
        for x in f.schema.fields:
            types[x.name] = _supertype(types[x.name], x.dataType) if x.name in types else x.dataType
    out = None
    for f in frames:
        part = f.select(*[(F.col(n) if n in f.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
        out = part if out is None else out.unionByName(part)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def contract_report(df: DataFrame, required: Sequence[str], forbidden: Sequence[str], keys: Sequence[str], day: str | None = None,
                    expected_day: str | None = None, positive: Sequence[str] = ()) -> DataFrame:
    """(check, violations): column contract, null keys, duplicate keys, wrong date, values not positive."""
    static = [(f"missing_column:{c}", int(c not in df.columns)) for c in required] + [(f"forbidden_column:{c}", int(c in df.columns)) for c in forbidden]
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    checks = {"null_key": null_key, **{f"not_positive:{c}": ~F.coalesce(X.is_positive(F.col(c)), F.lit(False)) for c in positive}}
    if day:
        checks["wrong_day"] = ~F.coalesce(X.iso_day(F.col(day)) == F.lit(expected_day).cast("date"), F.lit(False))
    names = list(checks)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    one = per_key.agg(F.count_if(F.col("_n") > 1).alias("dup"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(names))])
    rows = [F.struct(F.lit("duplicate_key").alias("check"), F.col("dup").cast("long").alias("violations"))]
    rows += [F.struct(F.lit(n).alias("check"), F.col(f"c{i}").cast("long").alias("violations")) for i, n in enumerate(names)]
    rows += [F.struct(F.lit(n).alias("check"), F.lit(v).cast("long").alias("violations")) for n, v in static]
    return one.select(F.inline(F.array(*rows)))


def enforce(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks the contract."""
    return df.filter(F.when(~F.coalesce(condition, F.lit(False)), F.raise_error(F.lit(message))).otherwise(F.lit(True)))


def classify_source(path: Column) -> Column:
    """Provenance of a prediction file from its path; first match wins."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return (F.when(p.contains("fixture"), "FIXTURE").when(p.contains("forward_paper"), "FORWARD_PAPER")
            .when(p.rlike("validation|champion_challenger"), "RETROSPECTIVE_VALIDATION")
            .when(p.rlike("backtest|year_strategy"), "BACKTEST").otherwise("UNKNOWN"))


def discover_predictions(spark: SparkSession, glob: str) -> DataFrame:
    """All prediction files under a glob with their file path and provenance."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(glob)
    df = df.withColumn("source_path", F.col("_metadata.file_path"))
    return df.withColumn("source_type", classify_source(F.col("source_path")))


def inventory(tables: dict[str, DataFrame], day_columns: dict[str, str], flags: Sequence[str]) -> DataFrame:
    """Rows, column count, date range and presence flags of every table."""
    out = None
    for name, df in tables.items():
        day = day_columns.get(name)
        d = F.col(day).cast("date").cast("string") if day else F.lit(None).cast("string")
        part = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                      F.min(d).alias("first_day"), F.max(d).alias("last_day"),
                      *[F.lit(f in df.columns).alias(f"has_{f}") for f in flags])
        out = part if out is None else out.unionByName(part)
    return out
