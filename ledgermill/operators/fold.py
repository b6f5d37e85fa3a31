"""Ordered folds: one state machine for each key, fed its rows in order as they stream through a task."""
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

FLUSH = 8192


def folded(rows: DataFrame, key: str, order, machine, schema: str) -> DataFrame:
    """What the machines of all keys put out, as rows of `schema`.

    `machine()` makes a machine; its apply(row) and close() yield tuples. A key's rows are sorted on disk and read
    as a stream, so a key holds its machine's state in memory and not its rows. A key is one task by its meaning.
    """
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def batch(out):
        columns = list(zip(*out)) or [[] for _ in shape]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)

    def run(batches):
        now, state, out = None, None, []
        for part in batches:
            for row in part.to_pylist():
                if state is None or row[key] != now:
                    if state is not None:
                        out.extend(state.close())
                    now, state = row[key], machine()
                out.extend(state.apply(row))
                if len(out) >= FLUSH:
                    yield batch(out)
                    out = []
        if state is not None:
            out.extend(state.close())
        yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
