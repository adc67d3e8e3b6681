"""Work on the rows of each page, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.session import dealt, ship_package

#: Rows that are worked on at once, or one page of more.
BATCH = 1 << 14


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, and where each group begins (and the end)."""

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            codes = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    held: list[pa.RecordBatch] = []
    rows, wanted = 0, BATCH
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        bounds = begins(t)
        last = int(bounds[-2])
        if last:
            yield t.slice(0, last), bounds[:-1]
        held = t.slice(last).to_batches()
        rows = t.num_rows - last
        wanted = max(BATCH, 2 * rows)  # a long page is looked at again only when it has doubled
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, begins(t)


def by_page(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], ddl: str, work: Callable[[list], list[tuple]]) -> DataFrame:
    """``keys`` and ``ddl``: the rows that ``work`` makes of each page from its ``columns`` (numbers as
    float64 arrays, others as lists). Pages are dealt and sorted, so a task walks from page to page
    without a call to Python for each."""
    ship_package(df.sparkSession)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [isinstance(kinds[c], T.NumericType) for c in columns]
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *T._parse_datatype_string(ddl).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(schema)][len(keys) :]
    names = schema.names

    def walked(batches):
        for t, bounds in whole_groups(batches, keys):
            given = [np.asarray(t.column(c), float) if n else t.column(c).to_pylist() for c, n in zip(columns, numeric, strict=True)]
            rows: list[tuple] = []
            owner: list[int] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                made = work([c[a:b] for c in given])
                rows += made
                owner += [a] * len(made)
            if rows:
                head = [t.column(k).combine_chunks().take(pa.array(owner)) for k in keys]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    own = dict.fromkeys([*keys, *columns])
    return dealt(df.select(*own), *keys).sortWithinPartitions(*keys).mapInArrow(walked, schema)
