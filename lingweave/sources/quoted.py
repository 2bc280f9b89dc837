"""Records with quoted line breaks, read from files that split between tasks.

Whether a line begins inside a quoted field depends on all lines before it, so a reader that knows only its own
range cannot tell. But a line turns "outside" and "inside" into one of the two each, and such steps can be put together:
one pass over the lines that hold a quote gives the step of every block of a file, running windows over the blocks give
the state at the start of each, and a second pass puts lines together to records, block by block in constant memory.
Only records over a border of blocks are in pieces, at most two a block; they are joined afterwards by their place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

OUTSIDE, INSIDE = 0, 1
PIECE = "file int, path string, block long, row long, head boolean, opens boolean, closes boolean, text string"


def after_line(line: str, state: int, separator: str = "\t") -> int:
    """The state after a line: a quote opens a field at its start only, two quotes inside are one character."""
    at, size = 0, len(line)
    while True:
        if state == OUTSIDE:
            if not line.startswith('"', at):
                at = line.find(separator, at) + 1
                if not at:
                    return OUTSIDE
                continue
            at += 1
        close = line.find('"', at)
        if close < 0:
            return INSIDE
        at = close + 1
        if line.startswith('"', at):
            at, state = at + 1, INSIDE
            continue
        # what follows a closing quote belongs to the field up to the separator
        state, at = OUTSIDE, line.find(separator, at) + 1
        if not at:
            return OUTSIDE


def _block_steps(separator: str):
    """The state after the lines of a block, for both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, states = None, [OUTSIDE, INSIDE]
        rows: list[tuple] = []
        for batch in batches:
            for file, path, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, path, block) != place:
                    if place:
                        rows.append((*place, *states))
                    place, states = (file, path, block), [OUTSIDE, INSIDE]
                states = [after_line(line, s, separator) for s in states]
        if place:
            rows.append((*place, *states))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "path", "block", "if_outside", "if_inside"])

    return run


def blocks_inside(lines: DataFrame, separator: str) -> DataFrame:
    """``file, path, block`` of the blocks that begin inside a quoted field."""
    quoted = lines.where(F.contains("value", F.lit('"'))).select("file", "path", "block", "value")
    every = lines.select("file", "path", "block").distinct()
    steps = quoted.mapInArrow(_block_steps(separator), "file int, path string, block long, if_outside int, if_inside int")
    steps = every.join(steps, ["file", "path", "block"], "left")
    fixed = F.col("if_outside") == F.col("if_inside")  # whatever was before
    turns = F.coalesce((F.col("if_outside") == INSIDE) & (F.col("if_inside") == OUTSIDE), F.lit(False)).cast("int")
    before = Window.partitionBy("file", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "path").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("turned", F.sum(turns).over(upto))
    # the last block with a fixed state, and the turns since then
    known = F.last(F.when(fixed, F.struct(F.col("if_outside").alias("state"), "turned")), ignorenulls=True).over(before)
    turned = F.coalesce(F.sum(turns).over(before), F.lit(0))
    state = (F.coalesce(known["state"], F.lit(OUTSIDE)) + turned - F.coalesce(known["turned"], F.lit(0))) % 2
    return counted.select("file", "path", "block", state.alias("state")).where(F.col("state") == INSIDE).drop("state")


def _pieces(separator: str):
    """Puts lines together; a piece is a record, or what of one lies in a block."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state, held = None, OUTSIDE, []
        meta: tuple = ()

        def row(closes: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, (*meta, closes, "\n".join(held))))], schema)

        schema = pa.schema([("file", pa.int32()), ("path", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("head", pa.bool_()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("text", pa.string())])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table["file"].to_pylist(), table["path"].to_pylist(), table["block"].to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                fresh = keys[start] != place
                if fresh:
                    if held:
                        yield row(False)
                    place, held = keys[start], []
                    state = INSIDE if part.column(5)[0].as_py() else OUTSIDE
                values, rows = part.column(3), part.column(4).to_numpy()
                lines = pc.replace_substring_regex(values, "\r$", "")
                quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
                begun = state
                after = np.full(len(lines), state, np.int8)
                for at in quoted.tolist():
                    state = after_line(lines[at].as_py(), state, separator)
                    after[at:] = state
                ends = np.flatnonzero(after == OUTSIDE)
                starts = np.concatenate([[0], ends + 1])
                first = 0  # of the records that begin here
                if held or begun == INSIDE:
                    if not held:
                        meta = (*place, int(rows[0]), False, False)
                    last = int(ends[0]) + 1 if len(ends) else len(lines)
                    held += lines.slice(0, last).to_pylist()
                    if len(ends):
                        yield row(True)
                        held, first = [], 1
                own_starts, own_ends = starts[first:-1] if len(ends) else np.zeros(0, np.int64), ends[first:]
                single = own_starts == own_ends
                whole = pc.take(lines, pa.array(own_ends)).to_pylist() if len(own_ends) else []
                for i in np.flatnonzero(~single).tolist():
                    whole[i] = "\n".join(lines.slice(int(own_starts[i]), int(own_ends[i] - own_starts[i]) + 1).to_pylist())
                n = len(own_ends)
                heads = np.zeros(n, bool)
                if n and fresh and place[2] == 0 and not first:
                    heads[0] = True
                if n:
                    same = pa.array(np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(k).take(same) for k in range(3)], pa.array(rows[own_starts]), pa.array(heads), *[pa.array(np.ones(n, bool))] * 2, pa.array(whole, pa.string())], schema=schema
                    )
                rest = int(starts[-1])
                if rest < len(lines) and (len(ends) or not (held or begun == INSIDE)):
                    held = lines.slice(rest).to_pylist()
                    meta = (*place, int(rows[rest]), bool(fresh and place[2] == 0 and rest == 0), True)
        if held:
            yield row(False)

    return run


def read_records(spark: SparkSession, files: Sequence[str], separator: str = "\t", header: bool = True) -> DataFrame:
    """``file, path, block, row, text``: the records of text files in listed order, with their quotes.

    Lines end with a line feed; a carriage return before it goes, and a break inside quotes is a line
    feed. Empty records and, with ``header``, the first record of every file are left out. A quote that is never closed
    makes the rest of its file one record.
    """
    parts = [
        spark.read.text(path).select(
            F.lit(i).alias("file"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
            F.monotonically_increasing_id().alias("row"),
        )
        for i, path in enumerate(files)
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    # one row for a block of a file at most, so small enough to send
    inside = F.broadcast(blocks_inside(lines, separator).withColumn("inside", F.lit(True)))
    marked = lines.join(inside, ["file", "path", "block"], "left").select("file", "path", "block", "value", "row", F.col("inside").isNotNull().alias("inside"))
    pieces = marked.mapInArrow(_pieces(separator), PIECE)
    whole = pieces.where("opens and closes")
    order = Window.partitionBy("file", "path").orderBy("block", "row")
    broken = pieces.where("not (opens and closes)")
    owner = F.last(F.when(F.col("opens"), F.struct("block", "row", "head")), ignorenulls=True).over(order)
    item = F.struct("block", "row", "text")
    joined = broken.withColumn("owner", owner).groupBy("file", "path", "owner").agg(F.sort_array(F.collect_list(item)).alias("items"))
    joined = joined.select("file", "path", "owner.block", "owner.row", "owner.head", F.array_join(F.transform("items", lambda s: s["text"]), "\n").alias("text"))
    records = whole.select("file", "path", "block", "row", "head", "text").unionByName(joined).where(F.col("text") != "")
    return (records.where("not head") if header else records).drop("head")
