"""Near copies: one-permutation hashing, banded buckets, star-shaped candidates, exact links.

Equal shingle sets form a class, so thousands of copies count as one member. Each class
gets one hash per bin in a single pass over its shingles; empty bins copy from a bin found
by a fixed random walk (optimal densification). Members of a bucket are linked to its
first member only, so candidates are at most as many as bucket entries. Buckets are dealt by
range of (bucket, class): a bucket that holds a third of all classes spreads over tasks.

The stars only say which classes can be linked at all. Inside a connected group of
candidates the links are confirmed on full sets by a breadth-first search that compares each
reached class with the classes not reached yet; no pair is ever a row, and no link between
members of a group is lost because they miss the star's centre. A group too large for one
task is searched in pairs of blocks, whose links are joined afterwards.

Cases: texts that are null or without words have an empty set, belong to no group and are
kept; a null ``doc_id`` is the smallest of a group only if no member has an id; rows that
repeat a ``doc_id`` stay separate rows; empty tables give no rows; input columns named like
an output are replaced. Rows are told apart by a number stored with them, never by
``doc_id``, which may be null or repeated: ids only name a group and rank its members, and
equal ids rank by set name, then by row number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lingweave.llm.text import WHITE, Hasher, add_columns, chunks, lower_table, word_table
from lingweave.session import stored

SHINGLE = 3
SIMILARITY = 85  # per cent of the union
BANDS, ROWS = 40, 6  # a pair at 0.85 shares no bucket with probability 6e-9, one at 0.80 with 5e-6
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 80  # near copies where nothing else is said
WALK = 256  # steps of the walk that fills an empty bin
GROUP_SHINGLES = 8 << 20  # shingles searched in one task; 64 MB of hashes

SIGNATURE = "n_shingles bigint, set_high bigint, set_low bigint, buckets array<bigint>"


def shingle_sets(chunk, hasher: Hasher, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and where each text's begin.

    A text of fewer words than a shingle is one shingle as a whole.
    """
    words = hasher.spans(chunk.data, chunk.starts, chunk.ends)
    bounds = chunk.bounds()
    windows = hasher.windows(words, size)
    sets = []
    for r in range(chunk.rows):
        first, last = bounds[r], bounds[r + 1]
        if last - first >= size:
            own = np.sort(windows[first : last - size + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif last > first:
            sets.append(hasher.windows(words[first:last], last - first))
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)])


def set_names(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of every set: two sums over independently mixed members."""
    both = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = hashes ^ np.uint64(salt)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        both.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return both[0], both[1]


def walk_table(bins: int) -> np.ndarray:
    """For every bin, the bins its walk visits; the same for all texts."""
    return np.random.default_rng(11).integers(0, bins, (WALK, bins))


def one_permutation(hashes: np.ndarray, bounds: np.ndarray, bins: int, walk: np.ndarray) -> np.ndarray:
    """Smallest hash of every bin and text, with empty bins filled; texts without shingles stay 0."""
    rows = len(bounds) - 1
    text = np.repeat(np.arange(rows), np.diff(bounds))
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = text * bins + bin_of
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
    table, filled = np.zeros(rows * bins, np.uint64), np.zeros(rows * bins, bool)
    table[cell[first]], filled[cell[first]] = hashes[first], True  # hashes are sorted within a text
    open_cells = np.flatnonzero(~filled & np.repeat(np.diff(bounds) > 0, bins))
    done = filled.copy()
    for step in range(WALK):
        if not len(open_cells):
            break
        source = open_cells - open_cells % bins + walk[step][open_cells % bins]
        found = filled[source]
        table[open_cells[found]] = table[source[found]]
        done[open_cells[found]] = True
        open_cells = open_cells[~found]
    if len(open_cells):  # next filled bin to the right, around the end
        for row in np.unique(open_cells // bins):
            have = np.flatnonzero(filled[row * bins : (row + 1) * bins])
            cells = open_cells[open_cells // bins == row]
            nearest = have[np.searchsorted(have, cells % bins) % len(have)]
            table[cells] = table[row * bins + nearest]
    return table.reshape(rows, bins)


def bucket_keys(table: np.ndarray, bands: int, rows: int, hasher: Hasher) -> np.ndarray:
    """One 64-bit key per band; the band number is part of it."""
    out = np.empty((len(table), bands), np.uint64)
    factors = np.random.default_rng(13).integers(1, 1 << 63, rows, np.uint64) | np.uint64(1)
    for b in range(bands):
        part = table[:, b * rows : (b + 1) * rows]
        key = (part * factors).sum(1, dtype=np.uint64) + np.uint64(b + 1)
        key ^= key >> np.uint64(31)
        out[:, b] = key * np.uint64(0x9FB21C651E98DF25) + np.uint64(b)
    return out.view(np.int64)


def signatures(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Add set size, 128-bit set name and bucket keys."""

    def make() -> Callable:
        hasher, walk = Hasher(), walk_table(bands * rows)
        table, lower = word_table(WHITE), lower_table()

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            sizes, high, low, keys = [], [], [], []
            for chunk in chunks(batch.column(batch.schema.get_field_index(text)), table, lower):
                hashes, bounds = shingle_sets(chunk, hasher, shingle)
                a, b = set_names(hashes, bounds)
                sizes.append(np.diff(bounds)), high.append(a), low.append(b)
                keys.append(bucket_keys(one_permutation(hashes, bounds, bands * rows, walk), bands, rows, hasher))
            join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
            sizes = join(sizes)
            keys = np.concatenate(keys)[sizes > 0].ravel() if keys else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)])
            return [
                pa.array(sizes),
                pa.array(join(high)),
                pa.array(join(low)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys)),
            ]

        return columns

    return add_columns(docs, SIGNATURE, make)


def stars(entries: DataFrame) -> DataFrame:
    """``node, centre`` edges from ``bucket, node`` entries: every member to the first of its bucket.

    Sorted ranges instead of groups: a large bucket is cut between tasks, and the first
    members of its parts are linked by one more small aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "node", "centre", "border"]
        last_bucket = centre = None
        for batch in batches:
            bucket, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(bucket):
                continue
            new = np.concatenate([[last_bucket is None or bucket[0] != last_bucket], bucket[1:] != bucket[:-1]])
            begins = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            centres = np.where(begins >= 0, node[np.maximum(begins, 0)], node[0] if centre is None else centre)
            border = np.zeros(len(node), bool)
            border[0] = last_bucket is None  # first bucket of the task
            keep = border | (centres != node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[keep]), pa.array(node[keep]), pa.array(centres[keep]), pa.array(border[keep])], names
            )
            last_bucket, centre = bucket[-1], centres[-1]
        if last_bucket is not None:
            # the last bucket of the task may go on in the next one
            yield pa.RecordBatch.from_arrays(
                [pa.array([last_bucket]), pa.array([centre]), pa.array([centre]), pa.array([True])], names
            )

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(parts, "bucket", "node").sortWithinPartitions("bucket", "node")
    found = stored(ranged.mapInArrow(run, "bucket bigint, node bigint, centre bigint, border boolean"), "near-stars")
    inner = found.where("node <> centre").select("node", "centre")
    border = found.where("border").select("bucket", "centre")
    first = border.groupBy("bucket").agg(F.min("centre").alias("first"))
    across = border.join(first, "bucket").where("centre <> first").select(F.col("centre").alias("node"), F.col("first").alias("centre"))
    return inner.unionByName(across).distinct()


def components(edges: DataFrame, name: str = "near-labels") -> DataFrame:
    """``node, label``: smallest node of the component of every node that has an edge.

    Every round maps each node to its smallest neighbour and keeps the edges between
    different images, so the graph shrinks until no edge is left; the smallest node of a
    component always stays. Only aggregates and equi-joins; each round is written to the
    shared folder.
    """
    edges = stored(edges.where("node <> centre").select("node", "centre"), f"{name}-edges")
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("centre").alias("node"), F.col("node").alias("centre")))
        step = stored(ends.groupBy("node").agg(F.least("node", F.min("centre")).alias("to")), f"{name}-step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = labels.join(step.withColumnRenamed("node", "label"), "label", "left")
            labels = stored(moved.select("node", F.coalesce("to", "label").alias("label")), name)
        images = edges.join(step, "node").select(F.col("to").alias("first"), F.col("centre").alias("node"))
        images = images.join(step, "node").select("first", "to").where("first <> to").distinct()
        edges = stored(images.select(F.col("first").alias("node"), F.col("to").alias("centre")), f"{name}-edges")
        if edges.isEmpty():
            return labels


def linked_groups(flat: np.ndarray, bounds: np.ndarray, similarity: int) -> np.ndarray:
    """Number of the linked group of every set, by exact breadth-first search.

    ``flat`` holds the members of all sets as small integers. A reached set is compared
    with the sets not reached yet whose size allows a link.
    """
    sizes = np.diff(bounds)
    by_size = np.argsort(sizes, kind="stable")
    group = np.full(len(sizes), -1)
    mark = np.zeros(int(flat.max(initial=0)) + 1, bool)

    def rest(of: np.ndarray):
        """Members of some sets, one after another."""
        size = sizes[of]
        begin = np.cumsum(size) - size
        return flat[np.arange(size.sum()) - np.repeat(begin - bounds[:-1][of], size)], np.concatenate([begin, [size.sum()]])

    waiting = by_size  # not reached yet, by size
    members, edges = rest(waiting)
    number = 0
    while len(waiting):
        queue = [waiting[0]]
        group[queue[0]] = number
        waiting, members, edges = waiting[1:], members[edges[1] :], edges[1:] - edges[1]
        while queue and len(waiting):
            at = queue.pop()
            low, high = (
                np.searchsorted(sizes[waiting], -(-sizes[at] * similarity // 100), "left"),
                np.searchsorted(sizes[waiting], sizes[at] * 100 // similarity, "right"),
            )
            if low >= high:
                continue
            own = flat[bounds[at] : bounds[at + 1]]
            mark[own] = True
            total = np.concatenate([[0], np.cumsum(mark[members[edges[low] : edges[high]]])])
            mark[own] = False
            cut = edges[low : high + 1] - edges[low]
            common = total[cut[1:]] - total[cut[:-1]]
            hit = 100 * common >= similarity * (sizes[at] + sizes[waiting[low:high]] - common)
            if hit.any():
                reached = low + np.flatnonzero(hit)
                group[waiting[reached]] = number
                queue += waiting[reached].tolist()
                waiting = np.delete(waiting, reached)
                members, edges = rest(waiting)
        number += 1
    return group


def _search(shingle: int, similarity: int):
    """Confirms the links of all candidate groups of one task's table."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hasher = Hasher()
        hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in table.to_batches():
            for chunk in chunks(batch.column("text"), word_table(WHITE), lower_table()):
                part, bounds = shingle_sets(chunk, hasher, shingle)
                hashes.append(part), sizes.append(np.diff(bounds))
        hashes, bounds = np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        high, low, label = (table[c].to_numpy() for c in ("set_high", "set_low", "label"))
        own = np.argsort(label, kind="stable")
        cuts = np.flatnonzero(np.diff(label[own], prepend=np.nan, append=np.nan) != 0) if len(own) else np.zeros(0, np.int64)
        rows, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            members = own[a:b]
            if len(members) < 2:
                continue
            flat = np.concatenate([hashes[bounds[m] : bounds[m + 1]] for m in members])
            edges = np.concatenate([[0], np.cumsum(bounds[members + 1] - bounds[members])])
            group = linked_groups(np.unique(flat, return_inverse=True)[1], edges, similarity)
            order = np.argsort(group, kind="stable")
            heads = order[np.searchsorted(group[order], np.arange(group.max() + 1))]
            joined = np.flatnonzero(heads[group] != np.arange(len(members)))
            rows.append(members[joined]), roots.append(members[heads[group[joined]]])
        rows, roots = np.concatenate(rows), np.concatenate(roots)
        return pa.table({"high": high[rows], "low": low[rows], "root_high": high[roots], "root_low": low[roots]})

    return run


def confirmed(texts: DataFrame, classes: DataFrame, labels: DataFrame, shingle: int, similarity: int, limit: int) -> DataFrame:
    """``high, low, root_high, root_low``: links of set names that connect every linked group.

    ``texts`` are ``row, text``; a class brings the text of its one row ``first.row``.
    """
    members = stored(classes.join(labels.withColumnRenamed("node", "set_high"), "set_high"), "near-members")
    sizes = members.groupBy("label").agg(F.sum("n_shingles").alias("size"))
    # a group is cut into blocks, and every pair of blocks is searched; nearly all groups are one block
    blocks = sizes.select("label", "size", F.greatest(F.lit(1), F.ceil(F.col("size") * 2 / limit)).cast("int").alias("blocks"))
    blocks = stored(blocks.withColumn("blocks", F.when(F.col("size") <= limit, 1).otherwise(F.col("blocks"))), "near-blocks")
    total = blocks.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    tasks = int(total // (limit // 8)) + 1
    block = F.pmod(F.xxhash64("set_low"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(blocks.select("label", "blocks"), "label").withColumn("_block", block).withColumn("_other", other)
    # a block meets itself in the pairs with others
    dealt = dealt.where((F.col("blocks") == 1) | (F.col("_block") != F.col("_other")))
    pair = F.struct(F.least("_block", "_other").alias("a"), F.greatest("_block", "_other").alias("b"))
    small = F.pmod(F.xxhash64("label"), F.lit(tasks))
    dealt = dealt.withColumn("_task", F.when(F.col("blocks") == 1, small).otherwise(F.lit(-1).cast("long"))).withColumn(
        "_pair", F.when(F.col("blocks") == 1, F.lit("")).otherwise(F.concat_ws(":", "label", pair["a"], pair["b"]))
    )
    rows = dealt.withColumn("row", F.col("first.row")).join(texts, "row").select("_task", "_pair", "label", "set_high", "set_low", "text")
    found = rows.groupBy("_task", "_pair").applyInArrow(
        _search(shingle, similarity), "high bigint, low bigint, root_high bigint, root_low bigint"
    )
    return stored(found, "near-links")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``component_id`` is the smallest id reachable over links of sets whose intersection is
    at least ``similarity`` per cent of their union.
    """
    numbered = _numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "row")
    found, _ = _grouped(numbered, shingle, similarity, bands, rows, group_shingles)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, stored, since a number must not change between two reads."""
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "near-rows")


def _grouped(
    numbered: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS, group_shingles: int = GROUP_SHINGLES
) -> tuple[DataFrame, DataFrame]:
    """Every one of ``row, doc_id, text`` with its group, and ``row`` of the one row of every group.

    Rows without words are no group; one of those equal in id and text stays.
    """
    blank = F.when(F.col("n_shingles") == 0, F.col("text")).alias("blank")
    signed = signatures(numbered.select("row", "doc_id", "text"), "text", shingle, bands, rows)
    signed = stored(signed.select("row", "doc_id", "n_shingles", "set_high", "set_low", "buckets", blank), "near-signed")
    names = ["set_high", "set_low"]
    # the smallest id, a null one last
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = stored(
        signed.where("n_shingles > 0")
        .groupBy(*names)
        .agg(F.min(rank).alias("first"), F.max("n_shingles").alias("n_shingles"), F.first("buckets").alias("buckets")),
        "near-classes",
    )
    entries = classes.select(F.explode("buckets").alias("bucket"), F.col("set_high").alias("node"))
    labels = components(stars(entries))
    small = classes.drop("buckets")
    links = confirmed(numbered.select("row", "text"), small, labels, shingle, similarity, group_shingles)
    first = small.join(class_roots(links), names, "left").select(
        *names,
        "first",
        F.coalesce("root_high", "set_high").alias("root_high"),
        F.coalesce("root_low", "set_low").alias("root_low"),
    )
    best = F.struct("first.no_id", "first.doc_id", *names, "first.row")
    smallest = stored(first.groupBy("root_high", "root_low").agg(F.min(best).alias("best")), "near-best")
    of_class = first.join(smallest, ["root_high", "root_low"]).select(*names, "best")
    found = signed.drop("buckets", "blank").join(of_class, names, "left")
    grouped = F.col("n_shingles") > 0
    component = F.when(grouped, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    # flags go by id; a null id equals none, so of rows without ids the chosen one is kept
    kept = ~grouped | F.coalesce(F.col("doc_id") == component, F.col("row") == F.col("best.row"))
    found = found.select("row", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
    blanks = signed.where("n_shingles = 0").groupBy("doc_id", "blank").agg(F.min("row").alias("row"))
    return found, smallest.select("best.row").unionByName(blanks.select("row"))


def class_roots(links: DataFrame) -> DataFrame:
    """``set_high, set_low, root_high, root_low`` of linked classes.

    Groups searched whole give one root each. Where blocks of a large group were searched
    in pairs, a class has several roots, and the links are joined into components.
    """
    names = [F.col("high").alias("set_high"), F.col("low").alias("set_low"), "root_high", "root_low"]
    counts = links.groupBy("high", "low").agg(F.count("*").alias("n"))
    chained = links.select("high", "low").join(links.select(F.col("root_high").alias("high"), F.col("root_low").alias("low")), ["high", "low"], "left_semi")
    if counts.where("n > 1").isEmpty() and chained.isEmpty():
        return links.select(*names)
    name = lambda a, b: F.concat_ws(":", a, b)
    edges = links.select(name("high", "low").alias("node"), name("root_high", "root_low").alias("centre"))
    labels = components(edges.distinct(), "near-roots")
    part = lambda c, i: F.split(c, ":")[i].cast("long")
    return labels.where("node <> label").select(
        part("node", 0).alias("set_high"), part("node", 1).alias("set_low"), part("label", 0).alias("root_high"), part("label", 1).alias("root_low")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of every group: that with the smallest id; rows without words once for an id and text."""
    numbered = _numbered(docs, "_near_row")
    named = numbered.select(F.col("_near_row").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    _, chosen = _grouped(named, **settings)
    return numbered.join(chosen.withColumnRenamed("row", "_near_row"), "_near_row", "left_semi").drop("_near_row")
