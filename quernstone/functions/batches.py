"""Arrow batches some rows at a time, so that a worker holds a whole batch once, as Arrow has it, and few of its values as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def portions(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """The values of a column, ``rows`` at a time."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def by_portions(f: Callable[[list], list], kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``f`` over the values of a column, for ``arrow_udf``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            made = [pa.array(f(some), kind) for some in portions(b)]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    return run
