"""Report folders: rows as JSON, with plain numbers and ISO times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DecimalType, TimestampNTZType, TimestampType

from tallyflow.functions.text import hex_bytes
from tallyflow.functions.times import iso


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text, binary ids as hex text."""
    def shown(field):
        c = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            return c.cast("double")
        if isinstance(field.dataType, DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            return iso(c.cast("timestamp"))
        if isinstance(field.dataType, BinaryType):
            return hex_bytes(c)
        return c

    return df.select(*[shown(f).alias(f.name) for f in df.schema.fields])


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """One JSON folder per report."""
    for name, df in reports.items():
        plain(df).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/{name}")
