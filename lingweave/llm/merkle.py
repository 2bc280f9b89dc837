"""A dataset manifest: rows as leaves of a Merkle tree, proofs by descent of a content-addressed DAG.

Leaves of a part (a language) stand in order of their keys. Every ``fan_out`` consecutive nodes become the
digest of their digests (the last run may be shorter, even one) until one node, the part's root, remains; the
roots of the parts, in order of the parts, become the root of the dataset in the same way.

The tree is stored as records digest -> children. The records below one node, ``digits`` levels deep, form a
*segment*, one row of the store that is found by the digest at its top. So a tree of any size is a few rounds
of segments; a segment is built in one task from at most ``fan_out ** digits`` nodes, whatever the sizes of
the parts, and no other order or window puts a part into one task. A proof descends from the root: a request
is the rank of a leaf, its digits in base ``fan_out`` select one child per level, and the children that were not
selected are collected. Requests of leaves below a common node travel as one until the segment of the leaves, so
a round above the leaves has one request per segment. Reversed, the collected steps are the proof, leaf first.

Only keys, digests and what ``carry`` names are shuffled, never texts.

Cases: a null value is ``-`` in a leaf and a null part is a part of its own, before the others; null keys come
first; rows equal in part and keys stand by their digests, so repeated rows are leaves of their own and the
tree depends on the rows alone; a lone leaf is the root of its part, a lone part that of the dataset; an empty
table has no root, no leaves and no proofs; columns that are not named are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lingweave.operators.indexing import row_index
from lingweave.session import stored

FAN_OUT = 2
DIGITS = 10  # levels of a segment: at most 1,024 nodes with two children each
SENT_PARTS = 100_000  # parts whose sizes are sent to every task; more are joined by shuffle

STEP = "array<struct<before:string,after:string>>"
SEGMENT = "_of string, _seg bigint, _n bigint, _digest string, _levels int, _records array<struct<digest:binary,children:array<binary>>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and its text; null is ``-``."""

    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def part_key(part: Column) -> Column:
    """A name for every part, null included, whose byte order is that of the parts, null first."""
    return F.coalesce(F.concat(F.lit("1"), part.cast("string")), F.lit("0"))


@dataclass
class Manifest:
    """The stored tree: ranked leaves and, per round from the leaves up, segments; ``top`` are those above the parts."""

    leaves: DataFrame  # _of, _rank, _leaf and the carried columns
    rounds: list[DataFrame]
    parts: DataFrame  # _of, _rank (place among the parts), _digest (root of the part), _rounds
    top: list[DataFrame]
    fan_out: int
    width: int

    def root(self) -> DataFrame:
        """One row ``_digest``, or none for an empty table."""
        return self.top[-1].select("_digest")


def build(rows: DataFrame, part: str, keys: Sequence[str], leaf: Column, carry: Mapping[str, Column] = {}, fan_out: int = FAN_OUT, digits: int = DIGITS) -> Manifest:
    """Store the manifest of a table; ``carry`` are columns that :func:`proofs` gives back with the leaves."""
    if fan_out < 2 or digits < 1:
        raise ValueError("a node has two children at least, a segment one level")
    own = [F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]
    order = [f"_key{i}" for i in range(len(keys))]
    # stored first, since ranging reads its input twice and would hash every text again
    slim = rows.select(part_key(F.col(f"`{part}`")).alias("_of"), *own, leaf.alias("_leaf"), *[c.alias(n) for n, c in carry.items()])
    slim = stored(slim, "merkle-leaves")
    ranked = row_index(slim, [*order, "_leaf"], ["_of"], "_rank", keep=["_of", "_leaf", *carry])
    leaves = stored(ranked, "merkle-ranked")
    width = fan_out**digits
    rounds = _grow(leaves.select("_of", "_rank", F.col("_leaf").alias("_digest")), fan_out, width)
    tops = [r.where("_n <= 1").select("_of", "_digest", F.lit(i + 1).alias("_rounds")) for i, r in enumerate(rounds)]
    found = tops[0]
    for other in tops[1:]:
        found = found.unionByName(other)
    parts = stored(row_index(stored(found, "merkle-roots"), ["_of"], name="_rank"), "merkle-parts")
    top = _grow(parts.select(F.lit("").alias("_of"), "_rank", "_digest"), fan_out, width)
    return Manifest(leaves, rounds, parts, top, fan_out, width)


def _grow(nodes: DataFrame, fan_out: int, width: int) -> list[DataFrame]:
    """Segments per round until every part has one node; ``nodes`` are ``_of, _rank, _digest``."""
    rounds = []
    sizes = stored(nodes.groupBy("_of").agg(F.count("*").alias("_n")), "merkle-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= SENT_PARTS else sizes
    nodes = nodes.join(sizes, "_of")
    while True:
        cut = nodes.withColumn("_seg", F.floor(F.col("_rank") / width))
        rounds.append(stored(cut.groupBy("_of", "_seg").applyInArrow(_segment(fan_out, width), SEGMENT), "merkle-segments"))
        rest = rounds[-1].where("_n > 1")
        if rest.isEmpty():
            return rounds
        nodes = rest.select("_of", F.col("_seg").alias("_rank"), "_digest", "_n")


def _segment(fan_out: int, width: int):
    """Builds one segment from its nodes; ``_n`` becomes the number of segments of the part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        nodes, n = table["_digest"].to_pylist(), table["_n"][0].as_py()
        levels, left = 0, min(n, width)
        while left > 1:
            levels, left = levels + 1, -(-left // fan_out)
        records = []
        for _ in range(levels):
            runs = [nodes[i : i + fan_out] for i in range(0, len(nodes), fan_out)]
            nodes = [sha256("".join(r).encode()).hexdigest() for r in runs]
            records += [{"digest": bytes.fromhex(d), "children": [bytes.fromhex(c) for c in r]} for d, r in zip(nodes, runs)]
        made = {
            "_of": table["_of"][:1],
            "_seg": table["_seg"][:1],
            "_n": pa.array([-(-n // width)], pa.int64()),
            "_digest": pa.array(nodes, pa.string()),
            "_levels": pa.array([levels], pa.int32()),
            "_records": pa.array([records], pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))),
        }
        return pa.table(made)

    return run


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``_of, _rank, leaf, subroot, root, path`` and the carried columns of the requested leaves.

    ``requests`` are rows ``_of, _rank`` (repeats count once); without them all leaves are asked
    for. ``path`` holds per level, from the leaf up, the digests before and after the node in its run.
    """
    leaves = manifest.leaves.drop("_leaf")
    if requests is not None:
        leaves = leaves.join(requests.select("_of", "_rank").distinct(), ["_of", "_rank"], "left_semi")
    carried = [c for c in leaves.columns if c not in ("_of", "_rank")]
    asked = leaves.select("_of").distinct().join(manifest.parts, "_of")
    root = manifest.top[-1].select("_of", "_seg", "_digest", F.array().cast(STEP).alias("_path"), F.col("_digest").alias("root"))
    wanted = asked.select(F.lit("").alias("_of"), "_rank", F.col("_of").alias("_name"), "_rounds")
    at = _descend(manifest, manifest.top, root, wanted, ["_name", "_rounds"])
    starts = at.select(F.col("_name").alias("_of"), F.lit(0).cast("long").alias("_seg"), "_digest", "_path", "root", F.col("_digest").alias("subroot"), "_rounds")
    starts = stored(starts, "merkle-starts")
    found = _descend(manifest, manifest.rounds, starts, leaves, carried)
    return found.select("_of", "_rank", F.col("_digest").alias("leaf"), "subroot", "root", F.reverse("_path").alias("path"), *carried)


def _descend(manifest: Manifest, rounds: list[DataFrame], starts: DataFrame, wanted: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Follow the digits of every wanted rank from the start of its part down to the nodes of the first round.

    ``starts`` are ``_of, _seg, _digest, _path`` and what goes along; with ``_rounds`` a part starts
    at its own round, else at the last.
    """
    width, along = manifest.width, [c for c in starts.columns if c not in ("_of", "_seg", "_digest", "_path", "_rounds")]
    at = None
    for k in reversed(range(len(rounds))):
        begin = starts.where(F.col("_rounds") == k + 1) if "_rounds" in starts.columns else starts.where(F.lit(k == len(rounds) - 1))
        begin = begin.drop("_rounds")
        at = begin if at is None else at.select(begin.columns).unionByName(begin)
        place = F.floor(F.col("_rank") / width**k)
        needed = wanted.select("_of", place.alias("_child"), *(carried if k == 0 else []))
        if k:
            needed = needed.distinct()
        item = F.struct((F.col("_child") % width).cast("int").alias("place"), *(carried if k == 0 else []))
        grouped = needed.withColumn("_seg", F.floor(F.col("_child") / width)).groupBy("_of", "_seg").agg(F.collect_list(item).alias("_items"))
        # equal subtrees have one record
        store = rounds[k].select("_digest", "_levels", "_records").dropDuplicates(["_digest"])
        joined = at.join(grouped, ["_of", "_seg"]).join(store, "_digest")
        flat = joined.mapInArrow(_walk(manifest.fan_out), _walked(joined, along))
        child = (F.col("_seg") * width + F.col("_item.place")).alias("_seg" if k else "_rank")
        at = flat.select("_of", child, "_digest", "_path", *along, *([f"_item.{c}" for c in carried] if k == 0 else []))
    return at


def _walked(joined: DataFrame, along: Sequence[str]) -> str:
    item = joined.schema["_items"].dataType.elementType.simpleString()
    return ", ".join(["_of string", "_seg bigint", "_digest string", f"_path {STEP}", *[f"{c} string" for c in along], f"_item {item}"])


def _walk(fan_out: int):
    """Expands every segment into its wanted nodes, each with the steps down to it added to the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [n for n in batch.schema.names if n not in ("_digest", "_path", "_items", "_levels", "_records")]
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                get = lambda name: one.column(one.schema.get_field_index(name))  # noqa: B023, E731
                items = get("_items").flatten()
                places = items.field("place").to_numpy()
                flat = get("_records").flatten()
                names = [d.hex() for d in flat.field("digest").to_pylist()]
                children = dict(zip(names, flat.field("children").to_pylist()))
                above = [(s["before"], s["after"]) for s in get("_path")[0].as_py()]
                digests, paths = _down(get("_digest")[0].as_py(), children, get("_levels")[0].as_py(), places, fan_out, above)
                sizes = np.array([len(p) for p in paths], np.int64)
                steps = [s for p in paths for s in p]
                struct = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["before", "after"])
                path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), struct)
                again = pa.array(np.zeros(len(places), np.int64))
                columns = {n: get(n).take(again) for n in others} | {"_digest": pa.array(digests, pa.string()), "_path": path, "_item": items}
                order = ["_of", "_seg", "_digest", "_path", *[n for n in others if n not in ("_of", "_seg")], "_item"]
                yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)

    return run


def _down(top: str, children: Mapping[str, list[bytes]], levels: int, places: np.ndarray, fan_out: int, above: list[tuple[str, str]]) -> tuple[list[str], list[list[tuple[str, str]]]]:
    """Digest and path of the nodes at some places; steps that several share are taken once."""
    seen = {0: (top, above)}
    for depth in range(1, levels + 1):
        below = {}
        for at in sorted(set((places // fan_out ** (levels - depth)).tolist())):
            digest, path = seen[at // fan_out]
            run, digit = [c.hex() for c in children[digest]], at % fan_out
            below[at] = run[digit], [*path, ("".join(run[:digit]), "".join(run[digit + 1 :]))]
        seen = below
    found = [seen[p] for p in places.tolist()]
    return [f[0] for f in found], [f[1] for f in found]


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, leaf first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)
