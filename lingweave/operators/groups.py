"""User functions per group or batch without holding a group.

* :func:`apply_by_group`: results are sums. The function runs on the rows of a group that share an Arrow batch,
  and Spark adds up what it returns.
* :func:`fold_by_group`: results depend on the order of the rows. The rows are ranged by group and order, every task
  folds the stretches it holds, and the states of a group's stretches, one for a task at most, are joined in order.
* :func:`apply_by_batch`: a function over the rows of one batch, whose number is bounded.

So one group may hold a third of all rows and still spread over all tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lingweave.operators.indexing import range_partitions

Partial = Callable[[pd.DataFrame], dict[str, float]]


def apply_by_group(
    df: DataFrame, by: Sequence[str], partial: Partial, sums: dict[str, str], finish: dict[str, Column]
) -> DataFrame:
    """``by...`` and the ``finish`` columns.

    ``partial`` maps rows of one group to the values named in ``sums`` (name to
    Spark type); ``finish`` builds the result from the added-up values.
    """
    keys = list(by)
    schema = T.StructType([df.schema[k] for k in keys])
    for name, kind in sums.items():
        schema = schema.add(name, kind)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, group in frame.groupby(keys, dropna=False, sort=False):
                rows.append({**dict(zip(keys, key)), **partial(group)})
            yield pd.DataFrame(rows, columns=[*keys, *sums])

    added = df.mapInPandas(batches, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return added.select(*keys, *[c.alias(name) for name, c in finish.items()])


@dataclass(frozen=True)
class Fold:
    """A function over ordered rows in four parts.

    ``step`` takes a state and the next rows; ``join`` puts the states of two neighbouring stretches
    together, the earlier one first, and must be associative; ``finish`` gives the result by column.
    States are pickled. The memory of a task is one state and one Arrow batch.
    """

    start: Callable[[], Any]
    step: Callable[[Any, pd.DataFrame], Any]
    join: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict[str, Any]]


def fold_by_group(df: DataFrame, by: Sequence[str], order: Sequence[str], fold: Fold, result: dict[str, str]) -> DataFrame:
    """``by...`` and the ``result`` columns (name to Spark type) of a fold over each group.

    ``order`` must be total within a group; nulls come first. Null keys are groups of their own. The
    columns that are not needed should be left out before, since ranging reads its input twice.
    """
    keys = list(by)
    own = [df.schema[k] for k in keys]
    states = T.StructType([*own, *T.StructType.fromDDL("_part int, _state binary").fields])
    done = T.StructType([*own, *T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in result.items())).fields])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, state = TaskContext.get().partitionId(), None, None
        kinds = to_arrow_schema(states)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held, pa.array([part], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], schema=kinds)

        for rows, key, again in _runs(batches, keys):
            if not again:
                if held:
                    yield row()
                held, state = key, fold.start()
            state = fold.step(state, rows.to_pandas())
        if held:
            yield row()

    def joined(table: pa.Table) -> pa.Table:
        ordered = [pickle.loads(s) for s in table.sort_by("_part")["_state"].to_pylist()]
        made = fold.finish(reduce(fold.join, ordered))
        kinds = to_arrow_schema(done)
        values = [pa.array([made[name]], kinds.field(name).type) for name in result]
        return pa.table([*[table[k][:1].cast(kinds.field(k).type) for k in keys], *values], schema=kinds)

    columns = [*keys, *order]
    ranged = df.repartitionByRange(range_partitions(df), *columns).sortWithinPartitions(*columns)
    return ranged.mapInArrow(stretches, states).groupBy(*keys).applyInArrow(joined, done)


def apply_by_batch(
    df: DataFrame, batch: str, order: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType
) -> DataFrame:
    """Call ``function`` once with all rows of each batch, in order; it returns rows of ``schema``.

    Batches are ranged, so a batch is in one task; where an Arrow batch ends inside it, its parts are put
    together. The number of rows of a batch must be bounded, as :func:`lingweave.operators.indexing.with_batches` makes it.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def called() -> pa.RecordBatch:
            made = function(pa.Table.from_batches(held).to_pandas())
            return pa.RecordBatch.from_pandas(made, to_arrow_schema(kinds), preserve_index=False)

        for rows, _, again in _runs(batches, [batch]):
            if held and not again:
                yield called()
                held = []
            held.append(rows)
        if held:
            yield called()

    ranged = df.repartitionByRange(range_partitions(df), batch).sortWithinPartitions(batch, *order)
    return ranged.mapInArrow(run, kinds)


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], bool]]:
    """Rows with equal keys that stand together, their key, and whether they go on with the run before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            before, after = c[:-1], c[1:]
            differ = pc.fill_null(pc.not_equal(before, after), False)
            new |= pc.or_(differ, pc.not_equal(before.is_null(), after.is_null())).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = [c[start : start + 1] for c in columns]
            values = [k.to_pylist() for k in key]
            yield batch.slice(start, stop - start), key, values == last
            last = values
