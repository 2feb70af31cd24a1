"""Near-duplicate embeddings by product quantisation, with exact reranking.

Vectors are scaled to length 1. A coarse k-means splits them into inverted lists, and the residual to its list's
centroid is coded by the nearest codeword in each subspace. Centroids and codewords are fitted on at most
MAX_TRAIN vectors, those with the smallest hash (a documented bound); every vector is indexed and every vector is a query.

Nothing is lost on the way, as both filters follow from the triangle inequality. With eps the distance that belongs to the least
cosine:

* probes: the lists of two vectors are parted by the plane halfway between their centroids. The two lie on its two sides, and their
  distances to it add up to eps at most, so one of them lies within eps / 2. A query therefore probes, besides its own list, lists
  whose plane is within eps / 2; a link that only one end can see is counted for both ends there. That is half the margin that a
  search from one side needs, and a fifth of the work;
* table look-ups: the asymmetric distance of query and code differs from the true one by no more than the code's own error,
  which is stored, so a code farther than eps plus this error is out. Tables hold 16-bit integers, rounded down.

What is left is compared in double precision. Equal vectors are one row with a multiplicity from the start. A list's rows are
dealt into blocks, queries go to all blocks of the lists they probe, and a block returns, for each of its rows, a count
of links and one link of a spanning forest: never pairs, however large a group is.

Without structure in the data a part of all lists has to be probed, and that part shrinks slowly as lists get finer (a fifth at
100 lists, a seventh at 226, in 64 dimensions), so work grows faster than the table. `margin` under 1 scales the half width: at 0.5 a link is lost
only if more than half of its length points along one plane's normal (four standard deviations in 64 dimensions).

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components link with
nothing and stay; a null vec_id has no component and stays; rows that share a vec_id count as vectors each, but don't link with each other unless they are equal; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keep
from .components import components

COSINE = 0.95
MAX_TRAIN = 20_000
LEAST_LISTS, MOST_LISTS, SUBSPACES, CODES = 16, 2048, 8, 32
#: Rows of an inverted list in one block and queries that meet it in one task, about; and queries that are compared at once.
BLOCK_ROWS, QUERY_ROWS, CHUNK = 2048, 32_768, 512


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest row of c, for a few thousand rows of x at a time."""
    half = (c**2).sum(1)
    return np.concatenate([np.argmin(half - 2 * x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


@dataclass
class Quantiser:
    centroids: np.ndarray
    words: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 7) -> Quantiser:
        """x: vectors of length 1."""
        rng = np.random.default_rng(seed)
        c = _kmeans(x, max(1, min(lists, len(x) // 8)), rng)
        rest = x - c[_nearest(x, c)]
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
        return cls(c, [_kmeans(rest[:, a:b], codes, rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return np.maximum(0, (x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T)

    @cached_property
    def between(self) -> np.ndarray:
        """Distances between centroids."""
        return np.sqrt(self.gaps(self.centroids))

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to centroids `at`, and the errors they leave."""
        rest = x - self.centroids[at]
        codes = np.empty((len(x), len(self.words)), dtype=np.uint8)
        error = np.zeros(len(x))
        for s, (w, a, b) in enumerate(zip(self.words, self.cuts, self.cuts[1:], strict=False)):
            d = (w**2).sum(1) - 2 * rest[:, a:b] @ w.T
            codes[:, s] = np.argmin(d, axis=1)
            error += ((rest[:, a:b] - w[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For queries x in list `at`: squared distances of each subspace's residual to each codeword."""
        rest = x - self.centroids[at]
        return [np.maximum(0, ((rest[:, a:b]) ** 2).sum(1)[:, None] + (w**2).sum(1) - 2 * rest[:, a:b] @ w.T) for w, a, b in zip(self.words, self.cuts, self.cuts[1:], strict=False)]

    def probes(self, d: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Lists whose plane to the own one lies within `reach`, and the own one: a mask of queries by lists. d: gaps()."""
        row = np.arange(len(d))
        with np.errstate(divide="ignore", invalid="ignore"):
            behind = (d - d[row, own][:, None]) / (2 * self.between[own])
        behind[row, own] = 0
        return behind <= reach + 1e-9


def _valid(v: Column, length: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce((F.size(v) == length) & ok, F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; large or tiny components don't overflow."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _join(up: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of all nodes after the trees of u[i] and v[i] have been joined. up: roots before; a root is the least node of its tree."""
    u, v = up[u], up[v]
    while (differ := u != v).any():
        u, v = u[differ], v[differ]
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (up[up] != up).any():
            up = up[up]
        u, v = up[u], up[v]
    return up


def _search(q: Quantiser, at: int, rows: pa.Table, ask: pa.Table, eps: float, cosine: float) -> pa.Table:
    """Links of queries `ask` and a block's `rows`: (id, links, root), root being a node of the same tree of links."""
    ids, asking = rows["id"].to_numpy(), ask["id"].to_numpy()
    y, mult = unit(_matrix(rows["v"])), rows["n"].to_numpy()
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
    probed = rows["probes"].combine_chunks()
    sees = np.zeros((len(ids), len(q.centroids)), dtype=bool)
    sees[np.repeat(np.arange(len(ids)), np.diff(probed.offsets.to_numpy())), probed.flatten().to_numpy()] = True
    reach = (eps + rows["error"].to_numpy() + 1e-6) ** 2
    cap = 65535 // codes.shape[1]
    scale = cap / reach.max()
    limit = np.floor(reach * scale).astype(np.uint16)[:, None]
    nodes, place = np.unique(np.concatenate([ids, asking]), return_inverse=True)
    mine, theirs = place[: len(ids)], place[len(ids) :]
    up = np.arange(len(nodes))
    links, back = np.zeros(len(asking), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    homes, weight = ask["home"].to_numpy(), ask["n"].to_numpy()
    for i in range(0, len(asking), CHUNK):
        x = unit(_matrix(ask["v"].slice(i, CHUNK)))
        far = np.zeros((len(ids), len(x)), dtype=np.uint16)
        for s, t in enumerate(q.tables(x, at)):
            far += np.minimum(np.floor(t * scale), cap).astype(np.uint16).T[codes[:, s]]
        b, a = np.nonzero(far <= limit)
        other = theirs[i + a] != mine[b]
        a, b = a[other], b[other]
        near = np.concatenate([np.einsum("ij,ij->i", x[a[j : j + 65536]], y[b[j : j + 65536]]) for j in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine
        a, b = a[near], b[near]
        links[i : i + len(x)] += np.bincount(a, mult[b], len(x)).astype(np.int64)
        blind = ~sees[b, homes[i + a]]  # the other end doesn't ask the query's list
        back += np.bincount(b[blind], weight[i + a[blind]], len(ids)).astype(np.int64)
        up = _join(up, theirs[i + a], mine[b])
    out = [np.concatenate(c) for c in ((asking, ids), (links, back), (nodes[up[theirs]], nodes[up[mine]]))]
    some = (out[1] > 0) | (out[2] != out[0])
    return pa.table({k: pa.array(c[some], pa.int64()) for k, c in zip(("id", "links", "root"), out, strict=True)})


def links(embeddings: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", max_train: int = MAX_TRAIN, margin: float = 1.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    kind = "float" if embeddings.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    src = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    top = src.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    src = src.withColumn("ok", _valid(F.col("v"), F.lit(top.k if top else 0)))
    good = src.where("ok and vec_id is not null")
    reps = keep(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vectors")
    out_null = src.where("not ok or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = reps.orderBy(F.xxhash64("v"), "id").limit(max_train).select("v").toArrow()
    if not len(sample):
        return out_null
    q = Quantiser.fit(unit(_matrix(sample["v"])), int(min(MOST_LISTS, max(LEAST_LISTS, math.sqrt(reps.count()) / 2))))

    def place(batches):
        for b in batches:
            if not len(b):
                continue
            x = unit(_matrix(b.column("v")))
            gaps = q.gaps(x)
            home = np.argmin(gaps, axis=1)
            codes, error = q.encode(x, home)
            mask = q.probes(gaps, home, margin * eps / 2)
            probes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(mask.sum(1))]), pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), b.column("v"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes], names=["id", "n", "v", "home", "codes", "error", "probes"])

    placed = keep(reps.select("id", "n", "v").mapInArrow(place, f"id bigint, n bigint, v array<{kind}>, home int, codes binary, error double, probes array<int>"), "placed")
    sizes = placed.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))  # at most MOST_LISTS rows
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    sizes = F.broadcast(keep(sizes.join(asked, "list"), "lists"))
    # a block meets a part of its list's queries in one task: index rows go to all parts, queries to all blocks
    block, part = (F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int") for salt, n in ((3, "blocks"), (5, "parts")))
    index = placed.withColumn("list", F.col("home")).join(sizes, "list").select("list", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "n", "v", "home", "codes", "error", "probes")
    ask = placed.select("id", "n", "v", "home", F.explode("probes").alias("list")).join(sizes, "list")
    ask = ask.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), "id", "n", "v", "home")

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        is_row = table["codes"].is_valid()
        rows, asks = table.filter(is_row), table.filter(pa.compute.invert(is_row))
        if not len(rows) or not len(asks):
            return pa.table({k: pa.array([], pa.int64()) for k in ("id", "links", "root")})
        return _search(q, key[0].as_py(), rows, asks, eps, cosine)

    found = keep(index.unionByName(ask, allowMissingColumns=True).groupBy("list", "block", "part").applyInArrow(search, "id bigint, links bigint, root bigint"), "links")
    comp = components(found.where("id <> root"), "id", "root")
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = reps.join(count, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = good.select("vec_id", "v").join(of, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(out_null)
