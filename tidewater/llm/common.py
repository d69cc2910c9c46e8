"""What the corpus operators share: texts of bounded slices, and one model at a time in a Python worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, shared_dir, written
from ..sources.tables import table

__all__ = ["broadcast_if_small", "dropped", "held", "kept_rows", "per_text", "pieces", "shared_dir", "table", "text_column", "written"]


#: A written table of at most so many bytes is broadcast to joins; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(table: DataFrame, row_bytes) -> DataFrame:
    """A written table, broadcast to joins if its rows' bytes sum to at most BROADCAST_BYTES."""
    total = table.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def text_column(df: DataFrame, name: str = "text"):
    """The text, an empty string for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows of an Arrow batch that a task takes at a time, so that memory follows these and not the batch.
ROWS_AT_ONCE = 256


_held: dict[str, object] = {}


def held(name: str, build: Callable):
    """A model or table that a Python worker keeps between tasks: one at a time, so that a stage frees what the one before held."""
    if name not in _held:
        _held.clear()
        _held[name] = build()
    return _held[name]


def pieces(batches, holds: str | None = None, rows: int = ROWS_AT_ONCE):
    """Arrow batches cut to so many rows, for a task that uses no other held thing than that."""
    if holds not in _held:
        _held.clear()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> None:
    """Arrow batches of at most 4 MB, unless the session sets a bound of its own: texts may be long, and each task holds a batch on both sides."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == "67108864b":  # the default
        conf.set(BATCH_BYTES, "4m")


def per_text(docs: DataFrame, columns: str, score, key: str = "doc_id", holds: str | None = None) -> DataFrame:
    """key and, from Arrow batches of whole texts (null: empty), the given columns, each a list or array of score(texts).

    Keys pass through as Arrow, so nulls and large ids stay exact.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(docs.select(key).dtypes)[key]
    schema = StructType.fromDDL(f"{key} {kind}, {columns}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in pieces(batches, holds):
            found = score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), *(pa.array(v, type=f.type) for v, f in zip(found, list(arrow)[1:], strict=True))], schema=arrow)

    small_batches(docs)
    return docs.select(key, text_column(docs).alias("text")).mapInArrow(run, schema)


def kept_rows(docs: DataFrame, keep, text: str = "text", holds: Callable[[], str] = lambda: None) -> DataFrame:
    """The rows whose whole text (null: empty) keep(texts) holds true for. Rows pass through as they are: nothing is joined or shuffled."""
    import numpy as np
    import pyarrow as pa

    at = docs.columns.index(text)

    def run(batches):
        for b in pieces(batches, holds()):
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(np.asarray(keep(texts), bool)))

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)
