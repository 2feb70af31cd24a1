"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

Darts fall on the plane of each shingle's weight and rank as a Poisson process: a hash of (shingle, cell) tells how many lie in a
cell of the plane, and hashes of (shingle, cell, number) tell where. A text is hit by the darts below its shingles' weights.
Each dart belongs to one coordinate of the signature, and the dart of least rank wins it, so two texts agree in a coordinate with
the probability of their weighted Jaccard similarity. Only as many darts are thrown as coordinates need, about K ln K.

Signatures are cut into bands; texts that share a band are candidates. The exact similarity decides about links:

1. Texts of equal words are one class from the start, whose least id stands for it.
2. Star rounds compare each candidate with one hub of its bands, and components join what is linked.
3. In bands that still hold several components, all pairs across components are compared, in blocks: the members of the
   largest component are dealt out once, the others (strays) go to all blocks. No pair is written; a block gives a forest of links.

So links are lost only by bands (at similarity 0.8, with a probability of 2e-4 for a single pair), and no group, of copies or of
near copies, comes together in one task.

Defined cases: a null text is an empty one; texts without words are one class; texts of less than five words are one
shingle; rows with one doc_id are one document, which is near to whatever any of its texts is near to; rows without a doc_id link
with nothing and stay; an empty table gives an empty result; extra columns are ignored (`documents_kept` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles, sieve
from .base import keep
from .components import components

BANDS, ROWS = 28, 6
SIMILARITY = 0.8
#: Texts that are hashed at once; rows of a block of comparisons, and shingles of one, about.
GROUP, BLOCK_ROWS, BLOCK_SHINGLES = 256, 256, 500_000
#: The first cell of ranks is [0, 2**-FIRST); each further one doubles the range.
FIRST = 6

_CDF: dict[float, np.ndarray] = {}


def _poisson(area: float) -> np.ndarray:
    """Cumulated Poisson probabilities of an area."""
    if area not in _CDF:
        top = int(area + 12 * math.sqrt(area) + 24)
        k = np.arange(top + 1)
        logs = k * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, top + 1)))])
        _CDF[area] = np.cumsum(np.exp(logs))
    return _CDF[area]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash: an (n, k) array of dart hashes. owner, h, weight: the weighted elements of n texts; an owner without elements gets zeros."""
    rank, best = np.full(n * k, np.inf), np.zeros(n * k, dtype=np.uint64)
    total = np.bincount(owner, weight, n)
    have = total > 0
    last = np.full(n, -1)
    need = k * (math.log(k) + 1)
    last[have] = np.maximum(0, np.ceil(np.log2(need / total[have])).astype(np.int64) + FIRST)
    cell = 0
    while (last >= cell).any():
        todo = (last >= cell)[owner]
        low, width = (0.0, 2.0**-FIRST) if not cell else (2.0 ** (cell - 1 - FIRST),) * 2
        o, x, w = owner[todo], h[todo], weight[todo]
        v = 0
        while len(o):
            w_low, w_width = (0.0, 1.0) if not v else (2.0 ** (v - 1),) * 2
            with np.errstate(over="ignore"):
                base = shingles.mix(x + np.uint64((cell * 64 + v + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
                count = np.searchsorted(_poisson(width * w_width), _unit(base), side="right")
                owners, at = np.repeat(o, count), np.repeat(base, count)
                number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                dart = shingles.mix(at + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(shingles.GOLDEN))
            if v or not (w >= 1).all():  # whole cells hold all their darts
                inside = w_low + w_width * _unit(shingles.mix(dart ^ np.uint64(0xA0761D6478BD642F))) < np.repeat(w, count)
                owners, dart = owners[inside], dart[inside]
            where = low + width * _unit(dart)
            slot = owners * k + (shingles.mix(dart ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(rank, slot, where)
            won = rank[slot] == where
            best[slot[won]] = dart[won]
            more = w > w_low + w_width
            o, x, w, v = o[more], x[more], w[more], v + 1
        ends = np.flatnonzero(last == cell)
        last[ends[np.isinf(rank.reshape(n, k)[ends]).any(axis=1)]] += 1  # one more cell doubles the range of ranks
        cell += 1
    return best.reshape(n, k)


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys of a signature's bands."""
    with np.errstate(over="ignore"):
        keys = (sig.reshape(len(sig), bands, rows) * shingles.seeds(rows, 1)).sum(axis=2, dtype=np.uint64) + shingles.seeds(bands, 2)
        return shingles.mix(keys).view(np.int64)


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, GROUP):
            part = b.slice(i, GROUP)
            words = [shingles.words_of(t) for t in part.column(1).to_pylist()]
            o, h, w = shingles.weighted(*shingles.shingles(words))
            keys = bands_of(signatures(o, h, w.astype(np.float64), len(words), BANDS * ROWS))
            bands = [keys[j] if ws else [] for j, ws in enumerate(words)]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "digest": pa.array([shingles.digest(x) for x in words], pa.binary()), "n": pa.array([max(len(x) - shingles.WIDTH + 1, min(1, len(x))) for x in words], pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hub, is_hub, text) → (id, hub, is_hub, els)."""
    for b in batches:
        for i in range(0, b.num_rows, GROUP):
            part = b.slice(i, GROUP)
            o, x = shingles.numbered(*shingles.shingles([shingles.words_of(t) for t in part.column(3).to_pylist()]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(o, minlength=part.num_rows))])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))], names=["id", "hub", "is_hub", "els"])


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links across components inside one block: each row against all, by marking its elements. Only links that join something are given."""
    pdf = pdf.sort_values("id").reset_index(drop=True)
    ids, sets = pdf["id"].tolist(), pdf["els"].tolist()
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    known, code = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(ids)), size)
    trees = Forest(len(ids))
    part: dict[int, int] = {}
    for i, c in enumerate(pdf["comp"]):
        trees.join(part.setdefault(c, i), i)
    out, comp, asks = [], pdf["comp"].to_numpy(), pdf["stray"].to_numpy()
    for i in np.flatnonzero(asks):
        mark = np.zeros(len(known), dtype=bool)
        mark[code[first[i] : first[i] + size[i]]] = True
        both = np.bincount(owner[mark[code]], minlength=len(ids))
        near = (both >= SIMILARITY * (size + size[i] - both) - 1e-9) & (comp != comp[i])
        out += [(ids[i], ids[j]) for j in np.flatnonzero(near) if trees.join(int(i), int(j))]
    return pd.DataFrame(out, columns=["a", "b"])


def _similar(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= F.lit(SIMILARITY) * (F.size(a) + F.size(b) - both) - 1e-9


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, kept): the near-duplicate class of each document, named by its least doc_id, which is the one that stays. One row for each doc_id, and for each row without."""
    return _classes(docs, id_col, text_col).select("doc_id", "component_id", "kept")


def _classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """classes(), and the number of rows of each document."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    rows = keep(src.mapInArrow(_hash_texts, f"doc_id {id_type}, digest binary, n bigint, bands array<bigint>"), "bands", texts=True)
    ids = rows.where("doc_id is not null").select("doc_id", "digest")
    # A digest stands for equal words and is named by its least doc_id; a document of several texts has several.
    reps = keep(rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    named = ids.join(reps.select("digest", "id").hint("merge"), "digest").select("doc_id", "id")
    of = keep(named.groupBy("doc_id").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n_rows")), "documents")
    several = of.where("id <> last").select("doc_id")
    twins = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b")) if several.limit(1).count() else None
    member = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    # Joins whose sides grow with the corpus are sort-merge joins at every size.
    member = keep(member.join(shared.hint("merge"), "band"), "members")
    # Round one: each candidate against the least id of all its bands. The hub is known before texts move, so they move once, and
    # sets of elements once.
    first = member.join(member.groupBy("band").agg(F.min("id").alias("hub")).hint("merge"), "band").groupBy("id").agg(F.min("hub").alias("hub"))
    hubs = first.where("hub <> id").select(F.col("hub").alias("__hub")).distinct()
    cand = keep(first.join(hubs, F.col("id") == F.col("__hub"), "left").select("id", "hub", F.col("__hub").isNotNull().alias("is_hub")), "candidates")
    # Texts of other documents stay where they are: only those that can be candidates are dealt by id.
    may, _ = sieve.split(src, "doc_id", cand, "id")
    texts = may.join(cand.hint("merge"), F.col("doc_id") == F.col("id")).groupBy("id", "text").agg(F.first("hub").alias("hub"), F.first("is_hub").alias("is_hub")).select("id", "hub", "is_hub", "text")
    els = keep(texts.mapInArrow(_elements, f"id {id_type}, hub {id_type}, is_hub boolean, els array<bigint>"), "elements", texts=True)
    of_hub = els.where("is_hub").select(F.col("id").alias("__hub"), F.col("els").alias("y"))
    links = els.where("hub <> id").join(of_hub.hint("merge"), F.col("hub") == F.col("__hub")).where(_similar(F.col("els"), F.col("y"))).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    edges = keep(links.union(twins) if twins else links, "links")
    found = keep(components(edges), "found")
    # Round two: members of bands with several components against the largest id of the band that is in another one.
    now = member.join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
    last_ids = now.groupBy("band").agg(F.max(F.struct("id", "comp")).alias("h"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "h")
    pairs = keep(now.join(last_ids, "band").where("comp <> h.comp").groupBy("id").agg(F.max("h.id").alias("hub")), "pairs")
    sets = els.select("id", "els")
    links = pairs.join(sets.withColumnRenamed("els", "x"), "id").join(sets.select(F.col("id").alias("hub"), F.col("els").alias("y")), "hub").where(_similar(F.col("x"), F.col("y"))).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    edges = keep(edges.union(links), "links")
    found = keep(components(edges), "found")

    now = member.join(found.hint("merge"), F.col("id") == F.col("node"), "left").select("band", "id", "n", F.coalesce("component", "id").alias("comp"))
    sums = now.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("els"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sign"))
    open_ = sums.groupBy("band").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k"), F.sum("els").alias("els"), F.sum("sign").alias("sign")).where("comps > 1")
    # bands with the same members are compared once
    open_ = open_.groupBy("k", "sign").agg(F.min("band").alias("band"), F.first("top").alias("top"), F.first("els").alias("els"))
    chunks = lambda k: F.ceil(F.greatest(k / BLOCK_ROWS, F.col("els") * k / F.col("k") / BLOCK_SHINGLES)).cast("int")
    open_ = open_.select("band", F.col("top.comp").alias("top"), F.greatest(F.lit(1), chunks(F.col("top.k"))).alias("bigs"), F.greatest(F.lit(1), chunks(F.col("k") - F.col("top.k"))).alias("strays"))
    at = now.join(open_, "band").withColumn("stray", F.col("comp") != F.col("top"))
    chunk = F.pmod(F.xxhash64("id"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("bigs"))).cast("int")
    # a block holds one chunk of the largest component, or none (-1), and one or two chunks of strays
    one = lambda x, y, z: F.struct(F.lit(x).cast("int").alias("big") if isinstance(x, int) else x.alias("big"), y.alias("s"), z.alias("t"))
    to_bigs = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda g: one(g, chunk, chunk))
    to_strays = F.filter(F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda c: one(-1, F.least(c, chunk), F.greatest(c, chunk))), lambda b: b["s"] < b["t"])
    from_big = F.transform(F.sequence(F.lit(0), F.col("strays") - 1), lambda c: one(chunk, c, c))
    blocks = at.withColumn("at", F.explode(F.when(F.col("stray"), F.concat(to_bigs, to_strays)).otherwise(from_big))).select("band", "at.*", "id", "comp", "stray")
    last = blocks.join(els.select("id", "els").hint("merge"), "id").groupBy("band", "big", "s", "t").applyInPandas(_compare, f"a {id_type}, b {id_type}")
    final = components(edges.union(last))
    out = of.join(final, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "id").alias("component_id"), "n_rows").withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast(id_type).alias("component_id"), F.lit(1).cast("bigint").alias("n_rows"), F.lit(True).alias("kept")))


def documents_kept(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the least doc_id, with all columns; of rows that share this doc_id, one. Rows without a doc_id stay."""
    # Texts move only where a document may go or have several rows.
    found = keep(_classes(docs).where("doc_id is not null and (not kept or n_rows > 1)").select(F.col("doc_id").alias("__id"), "kept"), "doubtful")
    may, stay = sieve.split(docs, "doc_id", found, "__id")
    may = may.join(found.where("not kept").hint("merge"), F.col("doc_id") == F.col("__id"), "left_anti")
    return stay.unionByName(may.dropDuplicates(["doc_id"]) if found.where("kept").limit(1).count() else may)
