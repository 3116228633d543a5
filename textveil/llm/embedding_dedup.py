"""Embedding near-deduplication with HNSW graphs, one per shard.

Vectors link when their labels (and lengths) are equal and their cosine, in double
precision, is at least `least`. Equal vectors are one, weighted by their number.
The vectors of a label are dealt by hash into shards of about `shard_rows`. Each
shard builds a hierarchical navigable small-world graph over leaders: a vector within
RADIUS of a leader joins it, others become leaders themselves, so a large group of
near copies is a few nodes. The leaders of a shard query the shard itself and every later one of their
label (what they find counts for both, so links are mutual and each pair of shards meets once)
for the leaders within the link angle plus two radii; the beam goes on while hits
come, and is doubled until an audit of AUDIT queries against brute force misses no
leader (at the last, the whole shard is read). All members of the leaders found are
verified by cosine in blocks, of vectors scaled by powers of two (norms of any size); per vector only the number of links and per linked
vector its group's least vector leave the task. Components join these groups.

Defined results: null, empty, zero or partly null or non-finite vectors and null
labels link with nothing (n_links 0, their own component, kept); rows that repeat a
vec_id with equal vectors are links of each other, as any equal vectors; a null
vec_id has a null component; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import scratch
from textveil.llm.components import components

LEAST = 0.98
SHARD_ROWS = 6_000
RADIUS = 0.15  # radians
LINKS = 8  # of a node on upper layers; twice as many on the lowest
BUILD_BEAM = 40
BEAM = 24
AUDIT = 32
ROWS = 512


class Graph:
    """Hierarchical navigable small world over unit rows, added one by one."""

    def __init__(self, size: int, width: int, seed: int = 3):
        self.x = np.zeros((size, width), np.float32)
        self.near = [np.full((size, 2 * LINKS), -1, np.int32)]  # by layer
        self.used = [np.zeros(size, np.int32)]
        self.n, self.top, self.entry = 0, 0, -1
        self.seen, self.stamp = np.zeros(size, np.int64), 0
        self.rng = np.random.default_rng(seed)

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], beam: int, layer: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """The beam's best, and all hits (>= floor) that it comes by, best first."""
        self.stamp += 1
        near, used, x, seen, stamp = self.near[layer], self.used[layer], self.x, self.seen, self.stamp
        seen[[i for _, i in start]] = stamp
        todo = [(-s, i) for s, i in start]
        heapq.heapify(todo)
        best = list(start)
        heapq.heapify(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= beam and -s < best[0][0] and -s < floor:
                break
            ids = near[i, : used[i]]
            ids = ids[seen[ids] != stamp]
            if not len(ids):
                continue
            seen[ids] = stamp
            for t, j in zip((x[ids] @ q).tolist(), ids.tolist(), strict=True):
                if len(best) < beam or t > best[0][0] or t >= floor:
                    heapq.heappush(todo, (-t, j))
                    heapq.heappush(best, (t, j))
                    if len(best) > beam and best[0][0] < floor:
                        heapq.heappop(best)
        return sorted(best, reverse=True)

    def _down(self, q: np.ndarray, layer: int) -> list[tuple[float, int]]:
        at = [(float(self.x[self.entry] @ q), self.entry)]
        for upper in range(self.top, layer, -1):
            at = self._layer(q, at, 1, upper)[:1]
        return at

    def _select(self, found: list[tuple[float, int]], many: int) -> list[int]:
        """The nearest that no chosen one is nearer to than the new node."""
        ids = [i for _, i in found]
        between = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(chosen) == many:
                break
            if not chosen or between[k, chosen].max() < s:
                chosen.append(k)
        for k in range(len(ids)):  # fill up with the nearest others
            if len(chosen) >= min(many, len(ids)):
                break
            if k not in chosen:
                chosen.append(k)
        return [ids[k] for k in chosen]

    def place(self, q: np.ndarray, join: float) -> int:
        """The nearest node, if its cosine is at least join, or else a new one: one search serves both."""
        if self.entry < 0:
            return self._new(q, [])
        found = self._layer(q, self._down(q, 0), BUILD_BEAM, 0)
        return found[0][1] if found[0][0] >= join else self._new(q, found)

    def _new(self, q: np.ndarray, found: list[tuple[float, int]]) -> int:
        """Insert q; found: its neighbours on the lowest layer."""
        node, level = self.n, int(-np.log(self.rng.random() + 1e-12) / np.log(LINKS))
        self.x[node] = q
        self.n += 1
        while len(self.near) <= level:
            self.near.append(np.full((len(self.x), LINKS), -1, np.int32))
            self.used.append(np.zeros(len(self.x), np.int32))
        if self.entry < 0:
            self.entry, self.top = node, level
            return node
        self._link(node, found, 0)
        top = min(level, self.top)
        at = self._down(q, top) if top else []
        for layer in range(top, 0, -1):
            at = self._layer(q, at, BUILD_BEAM, layer)
            self._link(node, at, layer)
        if level > self.top:
            self.entry, self.top = node, level
        return node

    def _link(self, node: int, found: list[tuple[float, int]], layer: int) -> None:
        """Links of a layer between a new node and those chosen from found, both ways."""
        near, used = self.near[layer], self.used[layer]
        for other in self._select(found, LINKS):
            near[node, used[node]] = other
            used[node] += 1
            if used[other] < near.shape[1]:
                near[other, used[other]] = node
                used[other] += 1
            else:
                ids = [*near[other].tolist(), node]
                ranked = sorted(zip((self.x[ids] @ self.x[other]).tolist(), ids, strict=True), reverse=True)
                kept = self._select(ranked, near.shape[1])
                near[other, : len(kept)] = kept
                used[other] = len(kept)

    def within(self, q: np.ndarray, floor: float, beam: int) -> list[int]:
        return [i for s, i in self._layer(q, self._down(q, 0), beam, 0, floor) if s >= floor]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no norm overflows or vanishes; cosines are the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def build(pdf: pd.DataFrame) -> bytes:
    """A shard: its vectors, their leaders and the graph over these."""
    pdf = pdf.sort_values("rep")
    x = scaled(np.stack(pdf["embedding"].to_numpy()).astype(float))
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, leader = Graph(len(x), x.shape[1]), np.zeros(len(x), np.int64)
    join = np.cos(RADIUS)
    for i in range(len(x)):
        leader[i] = graph.place(unit[i], join)
    n = graph.n
    graph.x, graph.seen = graph.x[:n], graph.seen[:n]
    graph.near, graph.used = [a[:n] for a in graph.near], [a[:n] for a in graph.used]
    order = np.argsort(leader, kind="stable")
    return pickle.dumps({
        "rep": pdf["rep"].to_numpy()[order], "n": pdf["n"].to_numpy()[order], "x": x[order],
        "starts": np.searchsorted(leader[order], np.arange(n + 1)), "graph": graph,
    })


def _groups(found: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Connected (rows, columns) of a boolean matrix."""
    left, out = found.any(axis=1), []
    while left.any():
        rows = np.zeros(len(found), bool)
        rows[np.argmax(left)] = True
        while True:
            columns = found[rows].any(axis=0)
            more = found[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        out.append((np.flatnonzero(rows), np.flatnonzero(columns)))
        left &= ~rows
    return out


def compare(one: dict, other: dict, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted links of each of one's vectors into the other shard, and of the other's into one
    (none if they are the same), and (vec, least vec of its group)."""
    graph, mine = other["graph"], one["graph"]
    floor = float(np.cos(min(np.pi, np.arccos(least) + 2 * RADIUS))) - 1e-4
    beam, audit = BEAM, np.linspace(0, mine.n - 1, min(AUDIT, mine.n)).astype(int)
    while beam < graph.n:
        truth = mine.x[audit] @ graph.x.T >= floor
        if all(set(np.flatnonzero(t)) <= set(graph.within(mine.x[a], floor, beam)) for a, t in zip(audit, truth, strict=True)):
            break
        beam *= 2
    links, back = np.zeros(len(one["rep"]), np.int64), np.zeros(len(other["rep"]), np.int64)
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    norm = np.linalg.norm(other["x"], axis=1)
    for k in range(mine.n):
        near = graph.within(mine.x[k], floor, beam) if beam < graph.n else np.flatnonzero(graph.x @ mine.x[k] >= floor).tolist()
        if not near:
            continue
        columns = np.concatenate([np.arange(other["starts"][i], other["starts"][i + 1]) for i in sorted(near)])
        first, past = one["starts"][k], one["starts"][k + 1]
        if same and past - first == 1 and len(columns) == 1:
            continue
        there, weight = other["x"][columns], other["n"][columns]
        for a in range(first, past, ROWS):
            b = min(past, a + ROWS)
            here = one["x"][a:b]
            cosine = (here @ there.T) / (np.linalg.norm(here, axis=1)[:, None] * norm[columns])
            hit = cosine >= least
            if same:
                hit &= np.arange(a, b)[:, None] != columns
            links[a:b] = hit @ weight
            if not same:
                back[columns] += one["n"][a:b] @ hit
            for rows, cols in _groups(hit):
                members = [*one["rep"][rows + a].tolist(), *other["rep"][columns[cols]].tolist()]
                low = min(map(root, members))
                for m in members:
                    parent[root(m)] = low
    return links, back, [(v, root(v)) for v in list(parent) if root(v) != v]


def near_vectors(rows: DataFrame, least: float = LEAST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id) of every row (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.expr("size(embedding) > 0 AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity')) AND exists(embedding, v -> v <> 0)")
    usable = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound)
    usable = usable.withColumn("dims", F.size("embedding"))
    reps = usable.groupBy("label", "dims", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = scratch.table(reps, "vectors")
    many = reps.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = reps.join(many, ["label", "dims"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    kind = rows.schema["label"].dataType.simpleString()

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "dims": [key[1]], "shard": [key[2]], "blob": [build(pdf)]})

    shards = dealt.groupBy("label", "dims", "shard").applyInPandas(make, f"label {kind}, dims int, shard int, blob binary")
    shards = scratch.table(shards, "shards")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, other = pickle.loads(pdf["blob"].iloc[0]), pickle.loads(pdf["blob2"].iloc[0])
        links, back, edges = compare(one, other, key[2] == key[3], least)
        vec = np.concatenate([one["rep"], other["rep"]])
        found = pd.DataFrame({"u": vec, "v": vec, "links": np.concatenate([links, back])})
        return pd.concat([found[found["links"] > 0], pd.DataFrame(edges, columns=["u", "v"]).assign(links=0).astype("int64")])

    pairs = shards.join(shards.select("label", "dims", F.col("shard").alias("shard2"), F.col("blob").alias("blob2")), ["label", "dims"]).filter("shard <= shard2")
    found = scratch.table(pairs.groupBy("label", "dims", "shard", "shard2").applyInPandas(run, "u long, v long, links long"), "links")
    links = found.groupBy("u").agg(F.sum("links").alias("links")).select(F.col("u").alias("rep"), "links")
    joined = components(found.filter("u <> v").select("u", "v")).withColumnRenamed("node", "rep")
    known = reps.join(links, "rep", "left").join(joined, "rep", "left")
    known = known.select(*(F.col(c).alias(f"k_{c}") for c in ("label", "embedding")), "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    on = (usable["label"] == known["k_label"]) & (usable["embedding"] == known["k_embedding"])
    linked = usable.join(known, on).select("vec_id", (F.col("links") + F.col("n") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    usable_too = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & sound
    rest = rows.filter(~F.coalesce(usable_too, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, vec_id) AS component_id,
       coalesce(c.component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.node LEFT JOIN n ON vec_id = n.a
"""
