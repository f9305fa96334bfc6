"""Helpers the corpus operators share: word rules, row keys, and text columns made in Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

word_pattern = re.compile(rb"[^\x20\x09-\x0D]+")

#: Names of the columns that tell rows apart in joins back to the documents.
KEY = ["__id", "__h1", "__h2"]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased. `lower` is the fast way where no other letter could change."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Add columns that identify a row by its id and its text.

    Rows equal in both get the same key, so an answer made from the text alone fits them all.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__id": F.col(id_col), "__h1": F.xxhash64(t), "__h2": F.hash(t)})


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on KEY, with NULL ids equal; the right side's key columns are dropped."""
    names = {k: f"{k}_r" for k in KEY}
    other = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, r in names.items():
        cond = cond & left[k].eqNullSafe(other[r])
    joined = left.join(other, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def as_bytes(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def with_text_columns(
    docs: DataFrame, text: str, fields: list[T.StructField],
    start: Callable[[], Callable[[list[bytes]], list[pa.Array]]], keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch.

    `start` runs once in each task and returns the function from the UTF-8 texts of a batch (NULL is
    empty) to one Arrow array per field. `keep` names the input columns to pass on (all by default);
    input columns named like a field are replaced.
    """
    new = {f.name for f in fields}
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text_in"))
    schema = T.StructType([source.schema[c] for c in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = as_bytes(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *compute(texts)], names=[*names, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)
