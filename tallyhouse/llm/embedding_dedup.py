"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are folded. k-means, fitted on a bounded sample, gives cells; each vector is at home in the cell of its
nearest centroid, and a guest of each further cell whose bisecting plane is near. Of two unit vectors with different homes
c and d, the distances from that plane add up to no more than the length of their difference, sqrt(2 - 2 * cosine). So
one of two linked vectors lies within half of the threshold's length of the plane, visits the other's cell and meets it
there: no link is lost at a cell's edge. Within a cell, blocks of homes meet blocks of visitors, each pair of blocks in
its own group of bounded size. A block pair returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import durable
from tallyhouse.llm.components import components
from tallyhouse.llm.vectors import as_bytes, matrix, sample, unit

#: Vectors for each cell on average, cells at most, and vectors of a block.
CELL, CELLS, BLOCK = 8192, 1024, 2048


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids of unit vectors; the first are spread by farthest-first steps."""
    if not len(points):
        return points
    centers = [points[0]]
    best = points @ points[0]
    while len(centers) < min(k, len(points)):
        far = int(best.argmin())
        if best[far] > 1 - 1e-9:
            break
        centers.append(points[far])
        best = np.maximum(best, points @ points[far])
    c = np.array(centers)
    for _ in range(rounds):
        home = (points @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, points)
        ok = np.abs(sums).max(axis=1) > 1e-9
        c[ok] = unit(sums[ok])
    return c


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in zip(rows.tolist(), cols.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors of one label (not null) and one length are linked if their cosine is at least the threshold. n_links:
    other vectors linked directly; component_id: the least vec_id that links reach, itself included; kept: it is that
    one. Vectors that are null, zero, empty or hold null or non-finite components link with nothing. A row without vec_id
    links with nothing, has no component_id and is kept. Rows of one vec_id count as one vector if equal.
    """
    base = durable(as_bytes(vectors, id_col, vector_col, label_col))
    usable = base.where("key is not null and label is not null and vec_id is not null")
    reps = durable(usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    n = reps.count()
    some = sample(reps.select(F.col("rep").alias("vec_id"), "v"))
    centers = spherical_kmeans(unit(some), max(1, min(CELLS, -(-n // CELL)))) if len(some) else some
    # The slack covers the rounding of dot products.
    half = math.sqrt(max(0.0, 2 - 2 * threshold) + 1e-12) / 2 + 1e-9
    apart = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0)) if len(centers) else None

    def visits(batches):
        """Home cell, and all cells visited with it; vectors of an unusual length are all of one cell, -1."""
        import pyarrow as pa

        for b in batches:
            v = b.column(3).to_pylist()
            usual = [i for i, x in enumerate(v) if len(centers) and len(x) == 8 * centers.shape[1]]
            home = np.full(len(v), -1)
            cells: list[list[int]] = [[-1]] * len(v)
            if usual:
                dots = unit(matrix(v[i] for i in usual)) @ centers.T
                own = dots.argmax(axis=1)
                home[usual] = own
                near = dots.max(axis=1)[:, None] - dots <= half * apart[own] + 1e-9
                for i, row in zip(usual, near):
                    cells[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["rep", "label", "copies", "v", "home", "cells"])

    visitors = reps.select("rep", "label", "copies", "v").mapInArrow(visits, "rep long, label string, copies long, v binary, home int, cells array<int>")
    visitors = durable(visitors.select("*", F.explode("cells").alias("cell"), F.length("v").alias("dim")))
    # Blocks by a hash of the id: as many as a cell's rows ask for. The counts have one row for each label, length and cell.
    cell = ["label", "dim", "cell"]
    sizes = visitors.groupBy(*cell).agg((F.floor(F.sum((F.col("home") == F.col("cell")).cast("int")) / BLOCK) + 1).alias("hb"), (F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("vb"))
    placed = visitors.join(sizes, cell)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 0, F.col("hb")).otherwise(F.col("vb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("vb")).otherwise(F.col("hb")) - 1))
    both = placed.where("home = cell").withColumn("side", F.lit(0)).unionByName(placed.withColumn("side", F.lit(1)))
    both = both.withColumn("own", own).withColumn("other", other)
    both = both.select(*cell, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("h"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("w"), "side", "rep", "copies", "v", "home", F.when(F.col("side") == 0, F.col("cells")).alias("cells"))

    def compare(pdf):
        import pandas as pd

        here, there = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if here.empty or there.empty:
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="Int64")})
        a, b = unit(matrix(there.v)), unit(matrix(here.v))
        rows, cols = np.nonzero(a @ b.T >= threshold)
        ids_a, ids_b, copies = there.rep.to_numpy(), here.rep.to_numpy(), here.copies.to_numpy()
        other = ids_a[rows] != ids_b[cols]
        rows, cols = rows[other], cols[other]
        links = np.bincount(rows, weights=copies[cols], minlength=len(ids_a)).astype(np.int64)
        # A visitor counts what it meets. A home that doesn't visit the visitor's own cell counts here too, as they meet once.
        from_cell, cell = there.home.to_numpy(), int(pdf.cell.iloc[0])
        calls = np.zeros((len(here), len(centers) + 1), bool)
        for i, visited in enumerate(here.cells):
            calls[i, visited] = True
        once = (from_cell[rows] != cell) & ~calls[cols, from_cell[rows]]
        back = np.bincount(cols[once], weights=there.copies.to_numpy()[rows[once]], minlength=len(ids_b)).astype(np.int64)
        place = {x: i for i, x in enumerate(dict.fromkeys([*ids_a.tolist(), *ids_b.tolist()]))}
        index = list(place)
        to_a, to_b = np.array([place[x] for x in ids_a.tolist()]), np.array([place[x] for x in ids_b.tolist()])
        edges = _forest(to_a[rows], to_b[cols], len(index))
        some, met = np.flatnonzero(links), np.flatnonzero(back)
        return pd.DataFrame(
            {
                "rep": np.concatenate([ids_a[some], ids_b[met], np.array([index[x] for x, _ in edges], np.int64)]),
                "links": np.concatenate([links[some], back[met], np.zeros(len(edges), np.int64)]),
                "to": pd.array([None] * (len(some) + len(met)) + [index[y] for _, y in edges], dtype="Int64"),
            }
        )

    found = durable(both.groupBy(*cell, "h", "w").applyInPandas(compare, "rep long, links long, to long"))
    links = found.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    out = base.select("vec_id", "label", "key").join(reps.select("label", "key", "rep", "copies"), ["label", "key"], "left")
    out = out.withColumn("rep", F.when(F.col("vec_id").isNotNull(), F.col("rep"))).join(links, "rep", "left").join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    component = F.coalesce("component_id", "rep", "vec_id")
    n_links = F.when(F.col("rep").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
