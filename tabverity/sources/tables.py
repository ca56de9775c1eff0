"""Tables with roles: sources, column names, and what the columns are used for."""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
Source = str | Path | DataFrame


@dataclass(frozen=True)
class Roles:
    """What the columns of a data set are used for."""

    id: str | None = None
    target: str | None = None
    key_fields: tuple[str, ...] = ()
    sensitive_fields: tuple[str, ...] = ()
    aux: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())
    secret: str | None = None


@dataclass(frozen=True)
class Options:
    """Settings of metrics that have any. Attacks that aren't limited take every row."""

    distance_scaler: str = "minmax"
    singling_mode: str = "multivariate"
    singling_attacks: int = 6000
    singling_columns: int = 7
    linkability_neighbours: int = 500
    linkability_attacks: int | None = None
    inference_columns: tuple[str, ...] | None = None
    inference_attacks: int | None = None
    inference_model: bool = True

    def halved(self) -> Options:
        """For halves of tables: half as many attacks."""
        half = lambda n: None if n is None else max(n // 2, 1)
        return replace(self, singling_attacks=half(self.singling_attacks), linkability_attacks=half(self.linkability_attacks), inference_attacks=half(self.inference_attacks))


@dataclass(frozen=True)
class TableSet:
    """Real, synthetic (by model name) and control tables that are evaluated together.

    ``whole`` is the real table when ``real`` and the only synthetic one are its halves.
    """

    real: DataFrame
    synthetic: dict[str, DataFrame] = field(default_factory=dict)
    control: DataFrame | None = None
    roles: Roles = Roles()
    options: Options = Options()
    whole: DataFrame | None = None


def as_frame(spark: SparkSession, source: Source, schema: T.StructType | None = None) -> DataFrame:
    """A DataFrame as it is; a path read as Parquet or, by its suffix ``.csv``, as CSV with a header."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str | Path):
        raise TypeError(f"a table is a DataFrame or a path, not {type(source).__name__}")
    path = str(source)
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_models(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a folder, with the file's stem as ``model_name``."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/*.csv").withColumn("model_name", stem)


def write_models(rows: DataFrame, folder: str) -> None:
    """One sub-folder for each ``model_name``."""
    rows.write.mode("overwrite").partitionBy("model_name").parquet(folder)


def drop_id(df: DataFrame, id_column: str | None) -> DataFrame:
    if id_column is None:
        return df
    if id_column not in df.columns:
        log.warning("column %s is absent", id_column)
    return df.drop(id_column)


def clean_name(name: str) -> str:
    return re.sub(r"[-./]", "", name)


def clean_columns(df: DataFrame) -> DataFrame:
    """Names without the characters ``-``, ``.`` and ``/``; a collision is an error."""
    names = [clean_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"cleaned column names collide: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN and null are the same here."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def kinds(df: DataFrame, id_column: str | None = None) -> dict[str, str]:
    """Semantic kind of each column, by its type: id, numerical, boolean, datetime or categorical."""
    found = {}
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            raise TypeError(f"column {f.name} is nested; explode it first")
        kind = "numerical" if isinstance(f.dataType, T.NumericType) else "boolean" if isinstance(f.dataType, T.BooleanType) else "datetime" if isinstance(f.dataType, T.TimestampType | T.DateType) else "categorical"
        found[f.name] = "id" if f.name == id_column else kind
    return found


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself; an error if a column has nulls."""
    counts = df.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if bad := sorted(c for c, n in counts.items() if n):
        raise ValueError(f"columns with nulls: {bad}")
    return df


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, which a cluster sets.

    Where it is unset, a session that runs within one process has a folder of its own; any other one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        set_dir = context._jsc.sc().getCheckpointDir()
        if not set_dir.isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tabverity-')}")
            set_dir = context._jsc.sc().getCheckpointDir()
        root = set_dir.get()
    return root.rstrip("/")


def fingerprint(df: DataFrame) -> str:
    """Names, types and rows of a table as one text: rows in any order, repeated ones counted."""
    found = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")).alias("b")).first()
    return f"{df.schema.simpleString()}:{found['n']}:{found['a']}:{found['b']}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and not lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_mapping(mapping: DataFrame, path: str) -> None:
    """A value-to-code table (column, value, code), with its types, as JSON lines."""
    mapping.write.mode("overwrite").json(f"{path}/rows")
    schema = mapping.sparkSession.createDataFrame([(json.dumps(mapping.schema.jsonValue()),)], "schema string")
    schema.coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def load_mapping(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return spark.read.schema(schema).json(f"{path}/rows")
