"""What came before a row of the same key, without a key's rows meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.dedup import pinned


def previous(df: DataFrame, key: str, order: str, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: the value of ``column`` in the row before, of the same ``key`` in order of ``order``; null for a key's first row.

    ``key`` and ``order`` together are unique and not null. Rows are sorted by ranges of both, so a key with a third of
    all rows spans many tasks. A task carries the last row on; the first row of each range gets its value from the last
    row of the range ahead, of which there is one a task.
    """
    sorted_ = pinned(df.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_range", F.spark_partition_id()))
    latest = sorted_.groupBy("_range").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(column).alias("v")), F.struct(key, order)).alias("last"))
    ahead = {r["_range"]: r["last"] for r in latest.collect()}  # a row a task
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            keys, values = get(key).to_pylist(), get(column).to_pylist()
            if held is None:
                before = [r for r in ahead if r < get("_range")[0].as_py()]
                last = ahead[max(before)] if before else None
                held = (last["k"], last["v"]) if last is not None else (None, None)
            out = []
            for k, v in zip(keys, values, strict=True):
                out.append(held[1] if held[0] == k else None)
                held = (k, v)
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_range"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, get(column).type)], [*(n for n in batch.schema.names if n != "_range"), name])

    return sorted_.mapInArrow(run, f"{fields}, `{name}` {kinds[column]}")
