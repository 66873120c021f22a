"""Near-duplicate vectors by range search in a robust-pruned graph.

Vectors are compared only within their label (and length).  Equal vectors are one node, whatever the number of copies.

1. Cluster: a label with more than ``SHARD`` nodes is split by k-means, fitted on a bounded sample of its nodes (about
   ``SAMPLE``, by hash), into at most ``BRANCH`` shards; shards that are still larger are split again, and so on, so neither
   the number of centres nor a shard grows with the label.  Where k-means would leave one child most of a shard, the shard is cut
   into equal parts along the direction in which it is widest, so shards always shrink.  A node has one home.  Besides it lies in at
   most ``overlap - 1`` further shards: one that another centre leads to, hardly farther than its own (``CLOSE``), where a shard
   is split again (once a node), and the rest among the siblings of its home.  So the shards hold at most ``overlap`` times the
   nodes; that is checked.  What ``LEVELS`` splits leave too large is dealt by hash.
2. Build: in every shard, each node's neighbours by similarity are pruned robustly (a neighbour is dropped if one
   already kept is nearer to it, by ``ALPHA``, than the node is), to at most ``DEGREE``, plus links back.
3. Union: a node's adjacency lists from all its shards are united into one flat graph.
4. Search: every node is a query in its home shard.  The search goes greedily, ``beam`` wide, from the shard's medoid, and from
   the query's own node, along the united lists to the nearest nodes, and from every node within the range on through all
   its neighbours until no new node turns up.  Where it has met nodes that lie in further shards too, it goes on there in the
   next round, from the medoid and one of these; rounds end when no query has an unseen shard to go to.  A node is counted
   where it is at home, so never twice.
5. Verify: what the search meets is compared exactly, in double precision.
6. Audit: the links of a sample of ``AUDIT`` nodes are compared with brute force, once over all links and once for nodes
   with few; below ``RECALL`` the search is repeated with farther overlap and a wider beam, and after ``TRIES`` every query is
   compared with all shards of its label (without overlap), in blocks, which is exact.  The result says the recall that was measured.

A task holds one shard and a block of at most ``SHARD`` queries, and the similarities between them.  It returns a number per
query and, of the links, only a forest that joins what they join, so a dense group of thousands doesn't become all
its pairs.

Edge cases: null vectors, zero vectors, those with a null or non-finite component and those with a null label link with
nothing; vectors of another length than most of their label's link only among themselves; a null vec_id takes part but
names no component; a cosine equal to the limit links; repeated rows are returned as often as they occur; an empty table
gives an empty result; more columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scope
from .components import components

COSINE, SHARD, SAMPLE, BRANCH, LEVELS, MOST, OVERLAP, CLOSE, BEAM, DEGREE, ALPHA = 0.93, 1024, 4096, 64, 12, 0.5, 3, 0.2, 16, 24, 1.2
RECALL, AUDIT, FEW, TRIES = 0.98, 1000, 8, 3
#: Shards that a table sent to all tasks may list.
FEW_SHARDS = 200_000


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows with their node, the nodes): ``vec_id, node``; ``node, group, v, n, least`` (n: copies, least: smallest vec_id)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are equal
    clean = F.transform(v, lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.when(F.coalesce(fine, F.lit(False)), clean).alias("v"))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.concat_ws("-", F.lower(F.hex(F.xxhash64("label", "v"))), F.lower(F.hex(F.xxhash64(F.lit(1), "v", "label"))))))
    if dict(vectors.dtypes)["embedding"] == "array<float>":  # half the size on the way; tasks compute in double precision
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "node"), nodes.select("node", F.concat_ws("|", "label", F.size("v")).alias("group"), "v", "n", "least")


def _unit(v) -> np.ndarray:
    x = np.stack([np.asarray(a, np.float64) for a in v])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _centres(frame: pd.DataFrame, shard: int) -> pd.DataFrame:
    """How one shard is split, by its sample: centres by cosine, or one direction and where to cut it; the same whatever the order of the rows."""
    frame = frame.sort_values("node")
    x, k = _unit(frame["v"]), int(min(BRANCH, -(-2 * frame["total"].iloc[0] // shard), len(frame)))
    c, cuts = x[np.linspace(0, len(x) - 1, k).astype(int)], []
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    if k > 1 and np.bincount((x @ c.T).argmax(axis=1)).max() > MOST * len(x):
        c = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:1]
        cuts = np.quantile(x @ c[0], np.arange(1, k) / k).tolist()
    return pd.DataFrame({"group": frame["group"].iloc[0], "shard": frame["shard"].iloc[0], "centres": [list(c)], "cuts": [cuts]})


def _nearest(x: np.ndarray, centres: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest children of each vector, at most three, and how much farther than the first each is, as an angle)."""
    if len(cuts):
        at = x @ centres[0]
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        own = np.searchsorted(cuts, at)
        away = np.maximum(np.maximum(edges[:-1] - at[:, None], at[:, None] - edges[1:]), 0.0)
        away[np.arange(len(x)), own] = -1.0  # at a cut, the child that it belongs to comes first
    else:
        away = np.arccos(np.clip(x @ centres.T, -1, 1))
    best = np.argsort(away, axis=1, kind="stable")[:, :3]
    away = np.maximum(np.take_along_axis(away, best, axis=1), 0.0)
    return best, away - away[:, :1]


PLACED = "node string, group string, shard string, v {}, n long, home boolean"


def assign(nodes: DataFrame, overlap: int = OVERLAP, shard: int = SHARD, close: float = CLOSE) -> DataFrame:
    """``node, group, shard, v, n, home`` for each node and each of its shards: at most ``overlap`` rows a node, exactly one of them at home."""
    # left: how many further shards a node at home may still go to.
    placed = PLACED.format(nodes.schema["v"].dataType.simpleString())
    done, rest = None, nodes.select("node", "group", F.lit("").alias("shard"), "v", "n", F.lit(True).alias("home"), F.lit(overlap - 1).alias("left"))
    for level in range(LEVELS + 1):
        sizes = cut(rest.groupBy("group", "shard").agg(F.count_if("home").alias("total")).filter(F.col("total") > shard))
        fine = rest.join(sizes, ["group", "shard"], "left_anti").drop("left")
        done = fine if done is None else done.unionByName(fine)
        if sizes.isEmpty():
            return done
        rest = rest.join(sizes, ["group", "shard"])
        if level == LEVELS:
            part = F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / shard)).cast("string")
            return done.unionByName(rest.withColumn("shard", F.concat_ws("#", "shard", part)).drop("total", "left"))
        salt = F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("total") / SAMPLE))
        sample = rest.filter(F.col("home") & (salt == 0)).select("node", "group", "shard", "v", "total")
        def children(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for _, g in f.groupby(["group", "shard"], sort=False):
                    best, more = _nearest(_unit(g["v"]), np.stack([np.asarray(c) for c in g["centres"].iloc[0]]), np.asarray(g["cuts"].iloc[0], float))
                    names = [[f"{s}.{j}" for j in js] for s, js in zip(g["shard"], best, strict=True)]
                    yield g[["node", "group", "v", "n", "home", "left"]].assign(shard=[n[0] for n in names], others=[n[1:] for n in names], more=list(more[:, 1:]))

        with scope():
            centres = cut(sample.groupBy("group", "shard").applyInPandas(lambda f: _centres(f, shard), "group string, shard string, centres array<array<double>>, cuts array<double>"))
            # At most BRANCH vectors for each shard that is split, joined by shard; adaptive execution splits a large one.
            split = cut(rest.drop("total").join(centres, ["group", "shard"]).mapInPandas(children, f"{placed}, left int, others array<string>, more array<double>"))
            large = split.groupBy("group", "shard").agg(F.count_if("home").alias("total")).filter(F.col("total") > shard).select("group", "shard", F.lit(True).alias("large"))
            split = split.join(large, ["group", "shard"], "left").withColumn("large", F.coalesce("large", F.lit(False)))
            # Further shards: where the home is split again, one and only for a node that has none yet; else as many as are left.
            near = F.filter(F.arrays_zip("others", "more"), lambda o: o["more"] <= F.when(F.col("large"), close / 2).otherwise(close))
            most = F.when(~F.col("home"), 0).when(F.col("large"), F.when(F.col("left") == overlap - 1, F.least(F.lit(1), "left")).otherwise(0)).otherwise(F.col("left"))
            split = split.withColumn("near", F.transform(F.slice(near, F.lit(1), most), lambda o: o["others"]))
            own = split.withColumn("left", F.col("left") - F.size("near")).select("node", "group", "shard", "v", "n", "home", "left")
            further = split.select("node", "group", F.explode("near").alias("shard"), "v", "n", F.lit(False).alias("home"), F.lit(0).alias("left"))
            rest = cut(own.unionByName(further), keep=True)
    raise AssertionError


def robust_prune(sims: np.ndarray, i: int, order: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of ``i`` out of ``order`` (nearest first); angles' chords are the distances."""
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    far = 1 - sims[i, order]
    for at, j in enumerate(order):
        if alive[at]:
            kept.append(int(j))
            if len(kept) == degree:
                break
            alive &= alpha * alpha * (1 - sims[j, order]) > far
    return kept


def _build(f: pd.DataFrame) -> pd.DataFrame:
    """The pruned graph of one shard: ``node, near`` (neighbours, by 64-bit hashes of their names: one too many by chance does no harm)."""
    f = f.sort_values("node")
    x, names, keys = _unit(f["v"]), f["node"].to_numpy(), f["key"].tolist()
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near: list[set] = []
    width = min(len(x) - 1, 4 * DEGREE)
    for i in range(len(x)):
        order = np.argpartition(-sims[i], width - 1)[:width] if width else np.zeros(0, int)
        near.append(set(robust_prune(sims, i, order[np.argsort(-sims[i, order], kind="stable")])))
    medoid = int((x @ x.mean(axis=0)).argmax())
    for i in range(len(x)):  # links back, and from the medoid to a spread of nodes, so that all are reached
        for j in list(near[i]):
            near[j].add(i)
    near[medoid].update(range(0, len(x), max(1, len(x) // 64)))
    return pd.DataFrame({"node": names, "near": [[keys[j] for j in sorted(s) if j != i] for i, s in enumerate(near)]})


def _range_search(sims: np.ndarray, heads: np.ndarray, near: np.ndarray, medoid: int, entry: np.ndarray, cosine: float, beam: int) -> np.ndarray:
    """Which nodes each query meets.  sims: queries x nodes; heads, near: where each node's neighbours begin, and these; entry: a node to start from besides."""
    seen, fresh = np.zeros(sims.shape, bool), np.zeros(sims.shape, bool)
    for start in (medoid, entry):
        seen[np.arange(len(sims)), start] = fresh[np.arange(len(sims)), start] = True
    now = np.arange(len(sims))
    width = min(beam, sims.shape[1])
    while len(now):
        score = np.where(seen[now], sims[now], -2.0)
        least = -np.partition(-score, width - 1, axis=1)[:, width - 1]
        go = fresh[now] & (score >= np.minimum(least, cosine)[:, None])
        some = go.any(axis=1)
        now, go = now[some], go[some]
        q, node = np.nonzero(go)
        q = now[q]
        fresh[q, node] = False
        size = heads[node + 1] - heads[node]
        to = near[np.repeat(heads[node] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        q = np.repeat(q, size)
        new = ~seen[q, to]
        seen[q[new], to[new]] = fresh[q[new], to[new]] = True
    return seen


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and the smallest name that each reaches through ``near`` (left x right), where they differ."""
    names, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    label, i, j = np.arange(len(names)), *np.nonzero(near)
    i, j = at[: len(left)][i], at[len(left) :][j]
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


FOUND = "kind string, a string, b string, links long, entry string"


def _search(f: pd.DataFrame, cosine: float, beam: int | None) -> pd.DataFrame:
    """Search one shard for a block of queries.  Rows: ``count`` (links of a), ``link`` (a and b), ``go`` (a is to visit b).

    f: nodes (``near``, ``shards``, ``home``) and queries (``query``).  A query without a vector is one of the nodes, and has that one's.  No beam: all nodes are met.
    """
    queries, nodes = f[f["query"]], f[~f["query"]]
    if not len(queries) or not len(nodes):
        return pd.DataFrame({"kind": [], "a": [], "b": [], "links": [], "entry": []}).astype({"links": "int64"})
    here, names, asked = f["shard"].iloc[0], nodes["node"].to_numpy(str), queries["node"].to_numpy(str)
    x, at = _unit(nodes["v"]), {n: i for i, n in enumerate(names)}
    own = nodes["v"].to_numpy()
    sims = _unit([own[at[n]] if v is None else v for n, v in zip(asked, queries["v"], strict=True)]) @ x.T
    met = sims >= cosine
    if beam is not None:
        by_key = {k: i for i, k in enumerate(nodes["key"].tolist())}
        lists = [[by_key[m] for m in ms if m in by_key] for ms in nodes["near"]]
        heads = np.concatenate(([0], np.cumsum([len(m) for m in lists])))
        medoid = int((x @ x.mean(axis=0)).argmax())
        entry = np.array([at.get(e, medoid) for e in queries["entry"]])
        met &= _range_search(sims, heads, np.array([m for ms in lists for m in ms], int), medoid, entry, cosine, beam)
    met &= asked[:, None] != names[None, :]
    home = nodes["home"].to_numpy(bool)
    a, b = _forest(met, asked, names)
    out = [pd.DataFrame({"kind": "count", "a": asked.astype(object), "b": None, "links": met @ (home * nodes["n"].to_numpy()), "entry": None}), pd.DataFrame({"kind": "link", "a": a, "b": b, "links": 0, "entry": None})]
    if beam is not None:
        others = sorted({s for ss in nodes["shards"] for s in ss} - {here})
        member = [set(ss) for ss in nodes["shards"]]
        for s in others:
            there = met[:, lies] if (lies := np.flatnonzero([s in ss for ss in member])).size else met[:, :0]
            q = np.flatnonzero(there.any(axis=1))
            out.append(pd.DataFrame({"kind": "go", "a": asked[q], "b": s, "links": 0, "entry": names[lies[there[q].argmax(axis=1)]]}))
    # As plain Python texts, whatever the frames have made of them.
    return pd.DataFrame({c: np.concatenate([f[c].to_numpy(object) for f in out]) for c in ("kind", "a", "b", "links", "entry")})


def search(nodes: DataFrame, cosine: float, overlap: int, beam: int | None, shard: int = SHARD, close: float = CLOSE) -> DataFrame:
    """Rows of ``FOUND``, of kind ``count`` and ``link``.  No beam: every query is compared with all shards of its group, and no node lies in two."""
    with scope():
        overlap = 1 if beam is None else overlap
        key = ["group", "shard"]
        with scope():  # the nodes in their shards go when all that is made of them is written
            with scope():
                placed = cut(assign(nodes, overlap, shard, close), keep=True)
            if placed.count() > overlap * nodes.count():
                raise AssertionError("more copies of nodes than the overlap allows")
            if beam is None:
                members = cut(placed.withColumns({"near": F.array().cast("array<long>"), "shards": F.array().cast("array<string>")}), keep=True)
                asked = placed.filter("home").select(F.col("node").alias("a"), "group", F.col("node").alias("entry")).join(placed.select(*key).distinct().withColumnRenamed("shard", "b"), "group")
            else:
                graph = placed.withColumn("key", F.xxhash64("node")).groupBy(*key).applyInPandas(_build, "node string, near array<long>")
                united = cut(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
                lies = placed.groupBy("node").agg(F.collect_set("shard").alias("shards"))  # at most overlap
                members = cut(placed.join(united.join(lies, "node"), "node"), keep=True)
                asked = placed.filter("home").select(F.col("node").alias("a"), "group", F.col("shard").alias("b"), F.col("node").alias("entry"))
            visits, found = cut(asked, keep=True), None
        seen = visits.select("a", "b")
        vector = nodes.schema["v"].dataType.simpleString()
        while True:
            # A row for each shard that is visited, so hundreds of times fewer than nodes; as a table that joins don't deal vectors for.
            blocks = cut(visits.groupBy("group", "b").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks")).withColumnRenamed("b", "shard"))
            blocks = F.broadcast(blocks) if blocks.count() <= FEW_SHARDS else blocks
            own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
            queries = visits.select(F.col("a").alias("node"), "group", F.col("b").alias("shard"), "entry").join(blocks, key)
            # At first queries are at home, where their vectors are.
            at_home = found is None and beam is not None
            queries = queries.withColumn("v", F.lit(None).cast(vector)) if at_home else queries.join(nodes.select("node", "v"), "node")
            queries = queries.select("node", "entry", *key, "v", F.lit(0).cast("long").alias("n"), F.lit(False).alias("home"), F.lit(None).cast("array<long>").alias("near"), F.lit(None).cast("array<string>").alias("shards"), F.xxhash64("node").alias("key"), own.alias("block"), F.lit(True).alias("query"))
            nodes_here = members.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            nodes_here = nodes_here.select("node", F.lit(None).cast("string").alias("entry"), *key, "v", "n", "home", "near", "shards", F.xxhash64("node").alias("key"), "block", F.lit(False).alias("query"))
            rows = queries.unionByName(nodes_here).groupBy(*key, "block").applyInPandas(lambda f: _search(f, cosine, beam), FOUND)
            rows = cut(rows, keep=True)
            if found is None:
                found = rows
                joined = None if beam is None else cut(components(rows.filter("kind = 'link'"), "a", "b"))
            else:  # what was joined by the first round needs no link any more
                ends = rows.filter("kind = 'link'").select("a", "b")
                for side in ("a", "b"):
                    ends = ends.join(joined.withColumnsRenamed({"node": side, "root": f"{side}_root"}), side, "left").withColumn(side, F.coalesce(f"{side}_root", side))
                ends = ends.filter("a != b").select(F.lit("link").alias("kind"), "a", "b", F.lit(0).cast("long").alias("links"), F.lit(None).cast("string").alias("entry")).distinct()
                found = found.unionByName(rows.filter("kind != 'link'")).unionByName(cut(ends, keep=True))
            if beam is None:
                break
            go = rows.filter("kind = 'go'").groupBy("a", "b").agg(F.min("entry").alias("entry")).join(nodes.select(F.col("node").alias("a"), "group"), "a").join(seen, ["a", "b"], "left_anti")
            fresh = cut(go.select("a", "group", "b", "entry"))
            if fresh.isEmpty():
                break
            visits, seen = fresh, seen.unionByName(fresh.select("a", "b"))
        return found.filter("kind != 'go'")


def audit(nodes: DataFrame, found: DataFrame, cosine: float = COSINE, queries: int = AUDIT, few: int = FEW) -> float:
    """The share of the links of a sample of nodes (at most ``queries``) that the search has found: the lesser of that of all links and that of nodes with at most ``few``."""
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(queries).select("node", "group", "v").toPandas()
    if not len(some):
        return 1.0
    groups, names = some["group"].to_numpy(), some["node"].to_numpy()
    x = {g: _unit(rows["v"]) for g, rows in some.groupby("group")}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            total = np.zeros(len(names), np.int64)
            for g, rows in f.groupby("group"):
                if g in x:
                    mine = np.flatnonzero(groups == g)
                    hit = x[g] @ _unit(rows["v"]).T >= cosine
                    hit &= names[mine][:, None] != rows["node"].to_numpy()[None, :]
                    total[mine] += hit @ rows["n"].to_numpy()
            yield pd.DataFrame({"a": names, "truth": total})

    truth = nodes.select("node", "group", "v", "n").mapInPandas(count, "a string, truth long").groupBy("a").agg(F.sum("truth").alias("truth"))
    got = found.filter("kind = 'count'").groupBy("a").agg(F.sum("links").alias("links"))
    both = truth.join(got, "a", "left").select("truth", F.least("truth", F.coalesce("links", F.lit(0))).alias("links"))
    sparse = F.when(F.col("truth") <= few, F.col("truth")), F.when(F.col("truth") <= few, F.col("links"))
    r = both.agg(F.sum("truth"), F.sum("links"), *map(F.sum, sparse)).first()
    return min(r[1] / r[0] if r[0] else 1.0, r[3] / r[2] if r[2] else 1.0)


def link(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audited_recall`` for every row of ``vectors`` (vec_id, embedding, label)."""
    rows, nodes = nodes_of(vectors)
    nodes = cut(nodes)
    with scope():
        close, beam = CLOSE, BEAM
        for attempt in range(TRIES + 1):
            found = search(nodes, cosine, OVERLAP, beam if attempt < TRIES else None, shard, close)
            recall = audit(nodes, found, cosine)
            if recall >= RECALL:
                break
            close, beam = close * 2, beam * 2
        counts = found.filter("kind = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        # A component's root carries its smallest vec_id.
        name = F.struct(F.col("least").isNull().alias("none"), "least", "node")
        end = lambda side: nodes.select(F.col("node").alias(side), name.alias(f"{side}_node"))
        links = found.filter("kind = 'link'").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b")
        joined = components(links, "a_node", "b_node").select("node.node", F.col("root.least").alias("component_id"))
        named = nodes.select("node", "n", "least").join(counts, "node", "left").join(joined, "node", "left")
        named = cut(named.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), keep=True)
    out = rows.join(named, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audited_recall": F.lit(float(recall))})
