"""What the operators share: reading tables, cutting lineage, adding Arrow-computed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.readers import spread
from corpusloom.sources.scratch import cut, scratch, shared_dir  # noqa: F401 - what the operators use

#: Rows that a worker turns into Python objects, and sends back, at a time: bounds its memory whatever the batch.
SLICE = 1024

_held: dict[object, object] = {}


def held(key: object, build: Callable[[], object]) -> object:
    """``build()``, kept in the worker process for its next tasks; one thing for all operators at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, through Spark's own reader only; a small one is dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Parts that a hot key is dealt into.
SALTS = 64


def salted_join(big: DataFrame, small: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (a row for each key) on ``key``, where one key may hold a large part of ``big``.

    Rows of ``big`` are dealt into ``SALTS`` parts of their key by the hash of ``by``. The parts that occur, at most SALTS
    for each key, fetch the key's row first; then the join is on key and part, so no task meets a whole hot key.
    """
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.select(key, "__salt").distinct().join(small, key)
    return salted.join(parts, [key, "__salt"], how).drop("__salt")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` but those called ``names`` in any case: what an operator writes replaces what was there."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with columns called like ``names`` renamed, and what gives each column its name again."""
    free = set(without(df, names))
    renamed = {c: c if c in free else f"__aside_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[quoted(c).alias(new) for c, new in renamed.items()]), {c: quoted(new).alias(c) for c, new in renamed.items()}


def append_arrow(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., list[pa.Array]]],
    fields: Sequence[tuple[str, T.DataType, pa.DataType]],
    keep: Sequence[str] | None = None,
    gather: int = 0,
) -> DataFrame:
    """Add columns that ``make()(input arrays)`` gives batch by batch; no shuffle, one Arrow pass.

    Outputs replace input columns of the same name. ``keep`` limits what is passed through. With ``gather``, work gets rows
    of about so many bytes at once instead of ``SLICE`` rows.
    """
    kept = [c for c in without(df, [f[0] for f in fields]) if keep is None or c in keep]
    given = [c for c in inputs if c not in kept]
    rows = df.select(*[quoted(c) for c in kept], *[quoted(c).alias(f"__in_{i}") for i, c in enumerate(given)])
    at = [kept.index(c) if c in kept else len(kept) + given.index(c) for c in inputs]
    names, kinds = [*kept, *[f[0] for f in fields]], [f[2] for f in fields]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _gathered(batches, gather) if gather else batches:
            step = batch.num_rows if gather else SLICE
            for i in range(0, batch.num_rows, step or 1):
                part = batch.slice(i, step)
                out = work(*[part.column(j) for j in at])
                cols = [a if isinstance(a, pa.Array) else pa.array(a, type=k) for a, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names=names)
        pa.default_memory_pool().release_unused()

    schema = T.StructType([*rows.schema.fields[:n], *[T.StructField(name, kind) for name, kind, _ in fields]])
    return rows.mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            held.append(part)
            n += part.nbytes
            if n >= size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def texts(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """The strings of a column, a few at a time, so that a batch is never held twice as Python objects."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()
