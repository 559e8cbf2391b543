"""File readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyflow.schemas import CAMPAIGNS_RAW, EVENTS_RAW, MESSAGE, REVIEWS_RAW, USERS
from tallyflow.sources.quoted_csv import read_quoted_csv

# fixed values: texts that mean a missing value in the raw advertising files
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

QUOTING = {"header": "true", "quote": '"', "escape": '"'}


def missing_to_null(df: DataFrame) -> DataFrame:
    """NULL for every missing-value text and every not-a-number."""
    def clean(name: str, kind: str):
        c = F.col(name)
        if kind == "string":
            return F.when(~c.isin(MISSING), c)
        if kind in ("float", "double"):
            return F.when(~F.isnan(c), c)
        return c

    return df.select(*[clean(name, kind).alias(name) for name, kind in df.dtypes])


def _typed(raw: DataFrame, ddl: str) -> DataFrame:
    """Text columns cast to a schema by name; what does not parse is NULL."""
    wanted = StructType.fromDDL(ddl)
    text = missing_to_null(raw.select(*wanted.names))
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def _all_text(ddl: str) -> str:
    return ", ".join(f"{name} string" for name in StructType.fromDDL(ddl).names)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users CSV; the six columns count by position, whatever the header says."""
    return _typed(spark.read.options(**QUOTING).schema(_all_text(USERS)).csv(path), USERS)


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """Campaigns CSV; the nine columns count by position."""
    return _typed(spark.read.options(**QUOTING).schema(_all_text(CAMPAIGNS_RAW)).csv(path), CAMPAIGNS_RAW)


def read_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Events CSV; columns count by header name.

    ``limit`` loads that many rows only: any rows, not the first of a file, and
    they pass through one task, so it is for trials.
    """
    # without a schema the reader takes names from the header and keeps text; a file
    # whose header differs from the first one's fails instead of mixing columns up
    raw = spark.read.options(**QUOTING, enforceSchema="false").csv(path)
    return _typed(raw if limit is None else raw.limit(limit), EVENTS_RAW)


def read_reviews(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Review CSV or TSV, every column text.

    A quoted field may span lines; a file is read by many tasks all the same (see ``quoted_csv``). Where no
    field spans lines, ``multi_line=False`` reads it once instead of twice.
    """
    if multi_line:
        return read_quoted_csv(spark, path, REVIEWS_RAW, sep)
    return spark.read.options(**QUOTING, sep=sep).schema(REVIEWS_RAW).csv(path)


def stream_reviews(spark: SparkSession, folder: str, sep: str = ",", max_files: int | None = None,
                   multi_line: bool = True) -> DataFrame:
    """Review files arriving in a folder as a stream; undecodable bytes are replaced."""
    options = {**QUOTING, "sep": sep, "multiLine": str(multi_line).lower()}
    if max_files:
        options["maxFilesPerTrigger"] = str(max_files)
    return spark.readStream.options(**options).schema(REVIEWS_RAW).csv(folder)


def read_sse(spark: SparkSession, path: str, line_sep: str = "\n\n") -> DataFrame:
    """Captured server-sent-event text as chunks of whole events.

    Give ``line_sep="\\r\\n\\r\\n"`` for captures with such line ends, or the
    file cannot be split.
    """
    return spark.read.option("lineSep", line_sep).schema(MESSAGE).text(path)


def stream_sse(spark: SparkSession, folder: str, line_sep: str = "\n\n", max_files: int | None = None) -> DataFrame:
    """The same for captures that arrive in a folder, as a stream."""
    reader = spark.readStream.option("lineSep", line_sep).schema(MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(folder)


def read_partition(spark: SparkSession, path: str, **key: object) -> DataFrame:
    """The rows of one key of a keyed table; the filter prunes folders, files and row groups."""
    rows = spark.read.parquet(path)
    for name, value in key.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows
