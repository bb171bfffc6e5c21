"""Near-duplicate embeddings: tiles of vectors compared along principal axes, with suffix norms as bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, lookup, written

#: Vectors in a tile, about; a pair of tiles takes some 4 * TILE^2 * 8 bytes.
TILE = 768
#: Dimensions added before the bound is tested again.
BLOCK = 8
#: Rounding slack of the bounds; the links themselves are tested without it.
SLACK = 1e-7


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raw])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _axes(vectors: DataFrame, dims: list[int]) -> dict[int, np.ndarray]:
    """Principal axes, largest spread first, from the second moments of all unit vectors of each length."""
    out = {}
    for d in dims:

        def moments(batches: Iterator[pa.RecordBatch], d: int = d) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, d))
            for b in batches:
                if b.num_rows:
                    x = _unit(b.column(0).to_pylist())
                    total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["cell", "v"])

        cells = vectors.where(F.col("dim") == d).select("vector").mapInArrow(moments, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
        total = np.zeros(d * d)
        for r in cells.collect():
            total[r.cell] = r.v
        out[d] = np.linalg.eigh(total.reshape(d, d))[1][:, ::-1].copy()
    return out


def _linked(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with cosine of at least `least`; ra and rb are their rotated unit forms."""
    d = ra.shape[1]
    # norms of what is left after each block
    ta, tb = (np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0)) for x in (ra, rb))
    at = min(BLOCK, d)
    sums = ra[:, :at] @ rb[:, :at].T
    if at < d:
        live = sums + ta[:, at][:, None] * tb[:, at][None, :] >= least - SLACK
    else:
        live = sums >= least - SLACK
    i, j = np.nonzero(live)
    s = sums[i, j]
    while at < d and len(i):
        end = min(at + BLOCK, d)
        s = s + np.einsum("ij,ij->i", ra[i, at:end], rb[j, at:end])
        keep = s + (ta[i, end] * tb[j, end] if end < d else 0) >= least - SLACK
        i, j, s, at = i[keep], j[keep], s[keep], end
    dots = np.einsum("ij,ij->i", a[i], b[j])
    ok = dots / (np.linalg.norm(a[i], axis=1) * np.linalg.norm(b[j], axis=1)) >= least
    return i[ok], j[ok]


def _forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same ids as the pairs (x, y) do: at most one less than there are ids."""
    up: dict[int, int] = {}
    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        p, q = a, b
        while up.get(p, p) != p:
            up[p] = up.get(up[p], up[p])
            p = up[p]
        while up.get(q, q) != q:
            up[q] = up.get(up[q], up[q])
            q = up[q]
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def embedding_near_duplicates(rows: DataFrame, least: float = 0.98, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in double precision is at
    least `least`.  Equal vectors of a label are one class with a weight.  Classes lie in cells as wide as linked unit vectors can
    differ along the first two principal axes, so links only join cells that touch; cells are dealt by hash into tiles, and
    pairs of tiles are compared in parallel.  A pair of tiles returns, for each row, the weight of its links and a forest that spans
    them, never the links themselves.

    Null, empty and zero vectors and those with null or non-finite components have no link, and neither has a null vec_id, whose
    component is null; repeated vec_ids count as one vector each, in one component.
    """
    spark = rows.sparkSession
    fine = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> double(x) + 0D)").alias("embedding"), "label")
    base = written(base.withColumn("ok", F.coalesce(fine, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), "vectors")
    grouped = base.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, "<f8") for v in b.column("embedding").to_pylist()]
            # scaled by a power of two: products neither overflow nor vanish, and no bit of the cosine changes
            raw = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in raw]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("id"), b.column("weight"), pa.array([len(v) for v in raw], pa.int32()), pa.array([v.tobytes() for v in raw], pa.binary())], names=["label", "id", "weight", "dim", "vector"])

    kind = base.schema["label"].dataType.simpleString()
    classes = written(grouped.select("label", "embedding", "id", "weight"), "classes")
    packed = classes.mapInArrow(pack, f"label {kind}, id long, weight long, dim int, vector binary")
    packed = written(packed, "packed")
    dims = sorted(r.dim for r in packed.select("dim").distinct().collect())
    axes = spark.sparkContext.broadcast(_axes(packed, dims))
    wide = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = np.array(b.column("dim").to_pylist(), np.int64)
            at = np.zeros((b.num_rows, 2), np.int64)
            raw = b.column("vector").to_pylist()
            for d in np.unique(dim):
                mine = np.flatnonzero(dim == d)
                at[mine, : min(2, d)] = np.floor(_unit([raw[k] for k in mine]) @ axes.value[int(d)][:, :2] / wide)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32())], names=[*b.schema.names, "p", "q"])

    dealt = packed.mapInArrow(cells, f"label {kind}, id long, weight long, dim int, vector binary, p int, q int")
    dealt = written(dealt, "cells")
    cell = ["label", "dim", "p", "q"]
    tiles = written(dealt.groupBy(*cell).agg(F.count("*").alias("members")).withColumn("tiles", F.ceil(F.col("members") / tile)), "tiles")
    # neighbours: each pair of cells once, and each pair of tiles once
    near = tiles.withColumn("step", F.explode(F.expr("array((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))")))
    near = near.select("label", "dim", "p", "q", F.col("tiles").alias("ta"), (F.col("p") + F.col("step.col1")).alias("p2"), (F.col("q") + F.col("step.col2")).alias("q2"))
    other = tiles.select("label", "dim", F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("tiles").alias("tb"))
    near = near.join(other, ["label", "dim", "p2", "q2"])
    pairs = near.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("ta") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("tb") - 1))).where("p <> p2 OR q <> q2 OR x <= y")
    pairs = written(pairs.select("label", "dim", "p", "q", "x", "p2", "q2", "y"), "tile_pairs")

    def bundle(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        return pd.DataFrame({"label": [r["label"]], "dim": [r["dim"]], "p": [r["p"]], "q": [r["q"]], "x": [r["x"]], "ids": [group["id"].to_numpy("<i8").tobytes()], "weights": [group["weight"].to_numpy("<i8").tobytes()], "vectors": [b"".join(group["vector"])]})

    in_tile = dealt.join(tiles.select(*cell, "tiles"), cell).withColumn("x", F.expr("pmod(xxhash64(id), tiles)"))
    bundles = written(in_tile.groupBy(*cell, "x").applyInPandas(bundle, f"label {kind}, dim int, p int, q int, x long, ids binary, weights binary, vectors binary"), "bundles")
    left = pairs.join(bundles, [*cell, "x"])
    right = bundles.select("label", "dim", F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("x").alias("y"), *(F.col(c).alias(c + "2") for c in ("ids", "weights", "vectors")))
    tasks = left.join(right, ["label", "dim", "p2", "q2", "y"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d = r["dim"]
                same = (r["p"], r["q"], r["x"]) == (r["p2"], r["q2"], r["y"])
                (ia, wa, va), (ib, wb, vb) = ((np.frombuffer(r["ids" + s], "<i8"), np.frombuffer(r["weights" + s], "<i8"), np.frombuffer(r["vectors" + s], "<f8").reshape(-1, d)) for s in ("", "2"))
                ra, rb = ((v / np.linalg.norm(v, axis=1)[:, None]) @ axes.value[d] for v in (va, vb))
                i, j = _linked(va, vb, ra, rb, least)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                na = np.bincount(i, wb[j], len(ia)).astype(np.int64)
                nb = np.bincount(j, wa[i], len(ib)).astype(np.int64)
                ids, n = np.concatenate([ia[na > 0], ib[nb > 0]]), np.concatenate([na[na > 0], nb[nb > 0]])
                edges = _forest(ia[i], ib[j])
                yield pa.RecordBatch.from_arrays([pa.array([*ids, *(a for a, _ in edges)], pa.int64()), pa.array([*n, *[None] * len(edges)], pa.int64()), pa.array([*[None] * len(ids), *(e for _, e in edges)], pa.int64())], names=["id", "n", "other"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    found = written(tasks.mapInArrow(compare, "id long, n long, other long"), "found")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    linked = found.where("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("linked"))
    # several classes may have the smallest id of repeated rows; links are counted by id
    components = connected_components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), Scratch(spark))
    named = classes.join(linked, "id", "left").join(components, "id", "left")
    named = named.select("label", "embedding", "weight", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    part = lookup(base.where("ok").select("vec_id", "label", "embedding"), named, ["label", "embedding"], "weight", base.count())
    out = part.select("vec_id", "n_links", "component_id").unionByName(base.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
