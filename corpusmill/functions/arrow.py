"""Row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.session import ship, spread


#: Rows whose texts are Python strings at once.
PART = 1024


def _parts(batches: Iterator[pa.RecordBatch], rows: int = PART) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def map_rows(df: DataFrame, columns: Sequence[str], fields: Sequence[tuple[str, T.DataType]], setup: Callable[[], Callable], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``df`` and ``fields``, computed batch by batch from ``columns``.

    ``setup()`` runs once in each task and gives the function that turns one row's values into a
    tuple, one value for each field. Rows of a scan with few splits are dealt to all cores.
    """
    ship(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    needed = list(dict.fromkeys([*keep, *columns]))
    df = spread(df.select(*needed))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    arrow = to_arrow_schema(schema)
    kinds, held, read = arrow.types[len(keep) :], [needed.index(c) for c in keep], [needed.index(c) for c in columns]

    def run(batches):
        f = setup()
        for batch in _parts(batches):
            made = list(zip(*(f(*row) for row in zip(*(batch.column(i).to_pylist() for i in read), strict=True)), strict=True)) or [()] * len(kinds)
            added = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in held), *added], names=arrow.names)

    return df.mapInArrow(run, schema)


def explode_rows(df: DataFrame, keep: str, columns: Sequence[str], fields: Sequence[tuple[str, T.DataType]], setup: Callable[[], Callable]) -> DataFrame:
    """Many rows for each row: ``keep`` and ``fields``. ``setup()`` gives the function from one row's values to a list of tuples."""
    ship(df.sparkSession)
    needed = list(dict.fromkeys([keep, *columns]))
    df = spread(df.select(*needed))
    schema = T.StructType([df.schema[keep], *(T.StructField(n, t) for n, t in fields)])
    arrow, read = to_arrow_schema(schema), [needed.index(c) for c in columns]

    def run(batches):
        f = setup()
        for batch in _parts(batches):
            ids, out = batch.column(0).to_pylist(), []
            for i, row in zip(ids, zip(*(batch.column(c).to_pylist() for c in read), strict=True), strict=True):
                out += [(i, *made) for made in f(*row)]
                if len(out) >= 20_000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], names=schema.names)
