"""Arrow batch helpers shared by the vectorised operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values in column hold about limit bytes (a longer value stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as it takes to differ from the others."""
    while name in {*taken}:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]],
    schema: str,
    limit: int = 1 << 20,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """Add columns computed from one text column, batch by batch.

    make() runs once per task and returns a function from a list of texts to named Arrow arrays, in the order of
    schema. keep names the columns passed through (all by default; the text itself only if it is among them). A kept
    column whose name clashes with a new one is replaced by it.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    text = column if column in kept else free_name("__text", kept)
    source = df.select(*(df[c] for c in kept), *([] if column in kept else [df[column].alias(text)]))
    out = StructType([*(source.schema[c] for c in kept), *new.fields])
    names = [*kept, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            for batch in slices(whole, text, limit):
                work = work or make()
                made = work(texts_of(batch.column(text)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(made[c] for c in new.names)], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return source.mapInArrow(run, out)
