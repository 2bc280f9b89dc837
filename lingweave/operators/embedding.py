"""Greedy embedding match of token sequences (precision, recall, F1 per row).

Each token takes its best cosine on the other side, as in Zhang et al. 2020, but
over a table of token vectors instead of a contextual model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lingweave.session import small_batches, stored

# A vector table above this size is joined to the rows instead of sent to tasks.
BROADCAST_VECTOR_BYTES = 512 << 20
BLOCK = 4096
TILE = 4096  # distinct ids of a side that one group of the join holds

PRF_TYPE = "struct<precision: double, recall: double, f1: double>"


def _best(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine of every row of ``a`` in ``b`` and of ``b`` in ``a``, block by block."""
    best_a = np.full(len(a), -np.inf)
    best_b = np.full(len(b), -np.inf)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            cosine = a[i : i + BLOCK] @ b[j : j + BLOCK].T
            np.maximum(best_a[i : i + BLOCK], cosine.max(axis=1), out=best_a[i : i + BLOCK])
            np.maximum(best_b[j : j + BLOCK], cosine.max(axis=0), out=best_b[j : j + BLOCK])
    return best_a, best_b


def _best_known(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_best`, for unit vectors with their ids in order: an id on both sides has its best cosine with itself.

    So only the ids that one side lacks are compared with the whole other side.
    """
    own_a, own_b = (np.einsum("ij,ij->i", x, x) for x in (a, b))
    if not (np.isfinite(own_a).all() and np.isfinite(own_b).all()):
        return _best(a, b)
    rest_a, rest_b = (np.flatnonzero(~np.isin(x, y, assume_unique=True)) for x, y in ((a_ids, b_ids), (b_ids, a_ids)))
    own_a[rest_a] = _best(a[rest_a], b)[0]
    own_b[rest_b] = _best(b[rest_b], a)[0]
    return own_a, own_b


def _score(hyp: np.ndarray, ref: np.ndarray, vectors: np.ndarray) -> tuple[float, float, float]:
    """Match distinct tokens only and weigh them by their count; ids are places in ``vectors``."""
    if not len(hyp) or not len(ref):
        return 0.0, 0.0, 0.0
    hyp_ids, hyp_n = np.unique(hyp, return_counts=True)
    ref_ids, ref_n = np.unique(ref, return_counts=True)
    best_hyp, best_ref = _best_known(_unit(vectors[hyp_ids].astype(np.float64)), _unit(vectors[ref_ids].astype(np.float64)), hyp_ids, ref_ids)
    p = float(best_hyp @ hyp_n / hyp_n.sum())
    r = float(best_ref @ ref_n / ref_n.sum())
    return p, r, (2 * p * r / (p + r) if p + r else 0.0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def vector_bytes(vectors: DataFrame) -> int:
    """Size of a vector table as 8-byte numbers, counted by Spark."""
    return int(vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)) * 8).first()[0])


def with_embedding_prf(
    df: DataFrame, hyp_ids: str, ref_ids: str, vectors: DataFrame, limit: int = BROADCAST_VECTOR_BYTES, tile: int = TILE
) -> DataFrame:
    """Add ``precision, recall, f1``; ids are ``vec_id`` values of ``vectors(vec_id, embedding)``.

    Ids without a vector do not count. The vectors belong to a vocabulary, so they do not
    grow with the corpus. A table up to ``limit`` bytes goes to the tasks, a larger one is
    joined, with equal scores.
    """
    small_batches(df.sparkSession)
    if vector_bytes(vectors) <= limit:
        scored = df.withColumn("_prf", embedding_prf(F.col(hyp_ids), F.col(ref_ids), vectors))
        return scored.select(*df.columns, "_prf.*")
    # rows need not be unique: each gets a number, which must not change between the two reads
    numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "embedding-rows")
    scores = embedding_prf_by_join(numbered, "_row", hyp_ids, ref_ids, vectors, tile)
    return numbered.join(scores, "_row", "left").drop("_row").fillna(0.0, ["precision", "recall", "f1"])


def embedding_prf(hyp_ids: Column, ref_ids: Column, vectors: DataFrame) -> Column:
    """Struct of scores with the whole vector table in every task; check its size first."""
    rows = vectors.select("vec_id", "embedding").toArrow().sort_by("vec_id").combine_chunks()
    ids = rows["vec_id"].to_numpy()
    flat = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, flat.reshape(len(ids), -1)))

    @F.arrow_udf(PRF_TYPE)
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids, flat = shared.value

        def places(wanted: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
            return at[ids[at] == wanted] if len(ids) else at[:0]

        for hyp, ref in batches:
            rows = [_score(places(h), places(r), flat) for h, r in zip(_lists(hyp), _lists(ref))]
            p, r, f = (pa.array([row[k] for row in rows], pa.float64()) for k in range(3))
            yield pa.StructArray.from_arrays([p, r, f], ["precision", "recall", "f1"])

    return score(hyp_ids, ref_ids)


def _lists(lists: pa.Array) -> list[np.ndarray]:
    values = lists.values.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def embedding_prf_by_join(
    df: DataFrame, row: str, hyp_ids: str, ref_ids: str, vectors: DataFrame, tile: int = TILE
) -> DataFrame:
    """Same scores for vector tables and rows of any size: ``row, precision, recall, f1``.

    Distinct ids of each row are joined with the vectors; AQE splits hot ids in the join. A row with
    more than ``tile`` distinct ids on a side is dealt by hash into tiles, and every pair of a hypothesis
    and a reference tile is a group of its own, so a task holds about two tiles of vectors however
    long the row is. The best cosines of a token over all tiles are combined by a partial maximum. Rows that
    fit one tile are summed up in their group and send two numbers on. ``row`` is unique; rows
    without a known id on either side are left out.
    """
    tiles = [F.greatest(F.lit(1), F.ceil(F.size(F.array_distinct(c)) / tile)).cast("int") for c in (hyp_ids, ref_ids)]
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col(hyp_ids).alias("ids")),
        F.struct(F.lit(1).alias("side"), F.col(ref_ids).alias("ids")),
    )
    counted = df.select(row, tiles[0].alias("hyp_tiles"), tiles[1].alias("ref_tiles"), F.explode(sides).alias("_s"))
    long = counted.select(row, "hyp_tiles", "ref_tiles", "_s.side", F.explode("_s.ids").alias("vec_id"))
    weights = long.groupBy(row, "vec_id").agg(
        F.max("hyp_tiles").alias("hyp_tiles"),
        F.max("ref_tiles").alias("ref_tiles"),
        F.count_if(F.col("side") == 0).alias("hyp_n"),
        F.count_if(F.col("side") == 1).alias("ref_n"),
    )
    own = [F.pmod(F.xxhash64(F.col("vec_id").cast("long")), F.col(t)).cast("int") for t in ("hyp_tiles", "ref_tiles")]
    place = lambda i, j: F.struct(i.alias("hyp_tile"), j.alias("ref_tile"))
    along = [
        F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(t) - 1), f)).otherwise(F.array().cast("array<struct<hyp_tile: int, ref_tile: int>>"))
        for n, t, f in (("hyp_n", "ref_tiles", lambda k: place(own[0], k)), ("ref_n", "hyp_tiles", lambda k: place(k, own[1])))
    ]
    found = weights.join(vectors.select("vec_id", "embedding"), "vec_id")
    placed = found.select("*", F.explode(F.array_union(*along)).alias("_p")).select(
        row, "vec_id", "embedding", "_p.*",
        (F.col("hyp_tiles") * F.col("ref_tiles") == 1).alias("whole"),
        F.when(F.col("_p.hyp_tile") == own[0], F.col("hyp_n")).otherwise(0).alias("hyp_n"),
        F.when(F.col("_p.ref_tile") == own[1], F.col("ref_n")).otherwise(0).alias("ref_n"),
    )
    fields = [("side", T.IntegerType()), ("vec_id", T.LongType()), ("n", T.LongType()), ("best", T.DoubleType())]
    schema = T.StructType([df.schema[row], *[T.StructField(c, t) for c, t in fields]])

    def best_of_tiles(pdf):
        unit = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        parts = [pdf["hyp_n"].to_numpy(), pdf["ref_n"].to_numpy()]
        at = [np.flatnonzero(n) for n in parts]
        if not len(at[0]) or not len(at[1]):
            return pd.DataFrame({c: [] for c in schema.names})
        best = _best(unit[at[0]], unit[at[1]])
        out = []
        for side in (0, 1):
            n, ids = parts[side][at[side]], pd.array(pdf["vec_id"].to_numpy()[at[side]], dtype="Int64")
            found = best[side]
            if pdf["whole"].iloc[0]:
                n, ids, found = [n.sum()], pd.array([None], dtype="Int64"), [found @ n / n.sum()]
            out.append(pd.DataFrame({"side": side, "vec_id": ids, "n": n, "best": found}))
        done = pd.concat(out, ignore_index=True)
        done.insert(0, row, pd.Series([pdf[row].iloc[0]] * len(done), dtype=pdf[row].dtype))
        return done

    partial = placed.groupBy(row, "hyp_tile", "ref_tile").applyInPandas(best_of_tiles, schema)
    best = partial.groupBy(row, "side", "vec_id").agg(F.max("n").alias("n"), F.max("best").alias("best"))
    mean = lambda side: F.sum(F.when(F.col("side") == side, F.col("best") * F.col("n"))) / F.sum(F.when(F.col("side") == side, F.col("n")))
    scores = best.groupBy(row).agg(mean(0).alias("precision"), mean(1).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f1", F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0))
