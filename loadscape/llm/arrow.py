"""Arrow batches of bounded size for operators on texts, and columns that bear any name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of a batch: texts may be very long, so batches are kept far below Spark's default number of rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def named(name: str) -> Column:
    """The column of that name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until ``docs`` has no column so called (in any case of letters)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def others(docs: DataFrame, new: Iterable[str]) -> list[str]:
    """The columns of ``docs`` that no column of ``new`` replaces."""
    taken = {c.lower() for c in new}
    return [c for c in docs.columns if c.lower() not in taken]


def map_batches(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH; the session's limits are lowered to those where they are above."""
    conf = rows.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key, None)
        try:
            small = now is not None and 0 < int(now) <= most
        except ValueError:
            small = False
        if not small:
            conf.set(key, str(most))
    return rows.mapInArrow(run, schema)


def _placed(docs: DataFrame, kept: list[str], inputs: dict[str, Column]) -> DataFrame:
    return docs.select(*[named(c).alias(f"_{i}") for i, c in enumerate(kept)], *[x.alias(k) for k, x in inputs.items()])


def with_made(docs: DataFrame, inputs: dict[str, Column], make: Callable[[], Callable[[pa.RecordBatch], list]], new: dict[str, str]) -> DataFrame:
    """``docs`` with the columns ``new`` (name: type), in place of any of these names.

    ``make`` is called once in each task; what it gives turns a batch of ``inputs`` into the new columns. The other
    columns go along by their place, so their names play no part.
    """
    kept = others(docs, new)
    rows = _placed(docs, kept, inputs)
    made = StructType.fromDDL(", ".join(f"new{i} {t}" for i, t in enumerate(new.values())))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema[: len(kept)]] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *work(batch)], names=schema.names)

    return map_batches(rows, run, schema).toDF(*kept, *new)


def kept_where(docs: DataFrame, inputs: dict[str, Column], make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``docs`` that are kept; ``make`` as in ``with_made``, for a list of whether to keep each row."""
    kept = docs.columns
    rows = _placed(docs, kept, inputs)
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema[: len(kept)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[: len(kept)], names=schema.names)
            yield own.filter(pa.array(work(batch), pa.bool_()))

    return map_batches(rows, run, schema).toDF(*kept)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Small batches of narrow columns put together to at least so many rows, for work that is vectorised over rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)
