"""What the operators share: words of a batch, stored tables, and what null and clashing columns mean."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import scratch_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: The C library's and Arrow's settings for Python workers: blocks from 4 MB on go back when they are freed.
WORKER_MEMORY = {
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started.

    A cluster has it installed or shipped with ``--py-files``; then the extra path is not there and does nothing.
    Workers are told to give large freed blocks back, as they live on from stage to stage.
    """
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read back: lineage ends here, and the size is known."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo; a null id counts as the empty text."""
    text = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(None)).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(modulus))


def needed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that further ones can neither clash nor travel."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut at ASCII white space (0x20, 0x09-0x0D), as (offsets, codes, words).

    ``words`` holds each distinct word once, ``codes`` the words of all texts in order, and
    ``codes[offsets[i]:offsets[i + 1]]`` those of text i. Null and blank texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        real = codes != empty
        before = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], before[offsets]
    return offsets, codes, words


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of up to ``limit`` bytes of text (one row if that is longer)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def lower_ascii(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


#: A to Z and their lower-case forms.
_LOWER = {c: c + 32 for c in range(65, 91)}
