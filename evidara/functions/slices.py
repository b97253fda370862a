"""Python functions of one value over Arrow batches, a slice of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rows that a worker holds as Python objects at a time; what it has made of them goes back before the next.
ROWS = 128


def in_slices(f: Callable, kind: pa.DataType, names: list[str] | None = None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """f of every value, as values of this kind; with names, f gives tuples of these fields."""

    def apply(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in values:
            for at in range(0, len(batch), ROWS):
                made = [f(v) for v in batch.slice(at, ROWS).to_pylist()]
                yield pa.array([dict(zip(names, m)) for m in made] if names else made, kind)

    return apply


def cut(whole, texts: Iterable[pa.Array], rows: int, characters: int) -> Iterator:
    """Slices of an array or batch, of so many rows and characters of its texts at most; a longer text is alone in one."""
    ends = np.cumsum(sum(pc.fill_null(pc.utf8_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
    at = 0
    while at < len(ends):
        to = np.searchsorted(ends, (ends[at - 1] if at else 0) + characters, "right")
        to = int(min(max(to, at + 1), at + rows, len(ends)))
        yield whole.slice(at, to - at)
        at = to


def sliced(f: Callable, kind: pa.DataType, schema: DataType, names: list[str] | None = None) -> Callable:
    """f as a function of a column; schema is the type of its results in Spark."""
    return F.arrow_udf(in_slices(f, kind, names), schema)
