"""Dense arrays of whole numbers with a scale, as npz archives: packed from cells, and read by window as rows.

An archive holds `values`, `scale_factor`, `add_offset` and `missing`. Archives come as a binary column, as
spark.read.format("binaryFile") gives them from any store; a task takes one after the other, and only the window's cells become rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = -(2**31)
ROWS = 65_536


def packed_arrays(cells: DataFrame, name: str, i: str, j: str, value: str, shape: tuple[int, int], scale: float, offset: float = 0.0) -> DataFrame:
    """name and content: an archive for each name of its cells, rounded half away from zero to whole numbers of the scale; cells that are not given are missing.

    An array's size is fixed by its shape, so what one task holds is bounded. Of a cell given twice the greatest value counts.
    """
    v = (F.col(value) - offset) / scale
    whole = F.round(v).cast("int")
    inside = F.col(i).between(0, shape[0] - 1) & F.col(j).between(0, shape[1] - 1)
    once = cells.where(inside).select(name, (F.col(i) * shape[1] + F.col(j)).cast("int").alias("_at"), whole.alias("_v")).dropna()
    lists = once.groupBy(name, "_at").agg(F.max("_v").alias("_v")).groupBy(name).agg(F.collect_list(F.struct("_at", "_v")).alias("_cells"))

    def pack(batches):
        for b in batches:
            out = []
            for own in b.column(1):
                flat = own.values.flatten()
                values = np.full(shape, MISSING, np.int32)
                values.ravel()[flat[0].to_numpy()] = flat[1].to_numpy()
                buffer = io.BytesIO()
                np.savez_compressed(buffer, values=values, scale_factor=scale, add_offset=offset, missing=MISSING)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[name, "content"])

    return lists.mapInArrow(pack, lists.select(name, F.lit(b"").alias("content")).schema)


def array_window(archives: DataFrame, name: str, rows: tuple[int, int] = (0, 2**31), columns: tuple[int, int] = (0, 2**31)) -> DataFrame:
    """name, i, j and value of the cells of rows[0] <= i < rows[1] and columns[0] <= j < columns[1] that are not missing."""
    keep = archives.select(name, "content")
    schema = keep.select(name, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("value")).schema

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                with np.load(io.BytesIO(b.column(1)[k].as_py())) as z:
                    part = z["values"][rows[0] : rows[1], columns[0] : columns[1]]
                    i, j = np.nonzero(part != z["missing"])
                    value = part[i, j] * float(z["scale_factor"]) + float(z["add_offset"])
                own = b.column(0).slice(k, 1)
                for a in range(0, len(i), ROWS):
                    some = slice(a, a + ROWS)
                    n = len(i[some])
                    names = own.take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([names, pa.array((i[some] + rows[0]).astype(np.int32)), pa.array((j[some] + columns[0]).astype(np.int32)), pa.array(value[some])], names=[name, "i", "j", "value"])

    return keep.mapInArrow(run, schema)
