"""Row-wise work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_texts(docs: DataFrame, work: Callable[[list[bytes]], list], schema: str, keep: tuple[str, ...] = ("doc_id",),
              text: str = "text") -> DataFrame:
    """`work` on the UTF-8 bytes of each batch of texts; a missing text is empty.

    `work` returns one Arrow array (or list) per column of `schema` that follows the
    `keep` columns.
    """
    names = [*keep, *[part.split()[0] for part in schema.split(", ")]]
    kept = docs.select(*keep)
    full = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], schema])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                made = work(batch.column(len(keep)).to_pylist())
                arrays = [pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x in made]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *arrays], names)

    filled = docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    return filled.mapInArrow(batches, full)
