"""Near-duplicate embeddings: a neighbour graph refined by NN-descent, its recall audited, its threshold edges kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, dropped, floats, runs, tidy
from territoria.llm.components import connected_components
from territoria.llm.minhash import compared, in_blocks

#: Neighbours kept for each vector while the graph is refined; random trees it starts from; vectors in a leaf.
NEIGHBOURS, TREES, LEAF = 10, 6, 128
#: Rounds of refinement at most, and the share of changed lists at which they end.
ROUNDS, SETTLED = 4, 0.02
#: Vectors (about) whose links are found by brute force to audit the graph; the recall below which trees are added; and
#: the attempts after which all vectors of a label are compared with each other instead.
AUDITED, RECALL, AUDITS = 256, 0.98, 3
#: Hashes are compared with shares of so many.
HASHES = 1 << 50
#: Vectors of one component that are compared with another block of it in a task.
BLOCK = 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(embedding: str = "embedding"):
    """Vectors that can have links: some component, none null or non-finite, not all zero."""
    e = f"`{embedding}`"
    return F.expr(f"size({e}) > 0 and forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({e}, x -> x <> 0)")


def _codes(trees: list[int], bits: int):
    """The signs of random projections of each vector, a code of `bits` bits for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            codes = np.zeros((len(vectors), len(trees)), np.int64)
            for d in {len(x) for x in vectors}:
                at = [k for k, x in enumerate(vectors) if len(x) == d]
                v = np.array([vectors[k] for k in at], np.float64)
                for j, tree in enumerate(trees):
                    planes = np.random.default_rng([tree, d]).standard_normal((d, bits))
                    codes[at, j] = ((v @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "codes"])

    return run


def _nearest(keys: list[str], k: int, outside: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest of each vector within its group (of other components, where `outside`), as a row per vector."""
    found: list[tuple[int, list[int], list[float]]] = []

    def listed() -> pa.RecordBatch:
        ids, near, cosine = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosine, pa.list_(pa.float64()))], ["id", "near", "cosine"])

    for group in runs(batches, keys):
        ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        v = _unit(floats(group.column("vector"))[first])
        s = v @ v.T
        np.fill_diagonal(s, -2)
        if outside:
            of = group.column("component").to_numpy()[first]
            other = of[:, None] != of[None, :]
            met = np.flatnonzero(other.any(axis=1))
            s = np.where(other, s, -2)
            for i in met.tolist():
                n = min(k, int(other[i].sum()))
                near = np.argpartition(-s[i], n - 1)[:n]
                found.append((int(ids[i]), ids[near].tolist(), s[i, near].tolist()))
            if len(found) > 5000:
                yield listed()
                found.clear()
            continue
        n = min(k, len(ids) - 1)
        near = np.argpartition(-s, n - 1, axis=1)[:, :n]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids[near].tolist(), pa.list_(pa.int64())), pa.array(np.take_along_axis(s, near, axis=1).tolist(), pa.list_(pa.float64()))], ["id", "near", "cosine"])
    if found:
        yield listed()


def _merged(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of all lists that a vector has; changed counts those that its list (`old`) lacked."""
    for group in runs(batches, ["id"]):
        near = group.column("near").combine_chunks().flatten().to_numpy()
        cosine = group.column("cosine").combine_chunks().flatten().to_numpy()
        order = np.lexsort((near, -cosine))
        near, cosine = near[order], cosine[order]
        kept = np.sort(np.unique(near, return_index=True)[1])[:k]
        was = {x for row, old in zip(group.column("near").to_pylist(), group.column("old").to_pylist(), strict=True) if old for x in row}
        yield pa.RecordBatch.from_arrays([pa.array([group.column("id")[0].as_py()], pa.int64()), pa.array([near[kept].tolist()], pa.list_(pa.int64())), pa.array([cosine[kept].tolist()], pa.list_(pa.float64())), pa.array([len(set(near[kept].tolist()) - was)], pa.int64())], ["id", "near", "cosine", "changed"])


LISTS = "id long, near array<bigint>, cosine array<double>"


def _split(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows with a part number, so that a group's parts have about `size` rows each."""
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    return rows.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("id", *keys), F.ceil(F.col("_n") / size))).drop("_n")


def _searched(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Lists of the nearest within each group of keys (parts of it, where it is large)."""
    keys = [*keys, "part"]
    outside = [c for c in rows.columns if c == "component"]
    ready = rows.select(*(F.col(x).cast("long").alias(x) for x in keys), "id", "vector", *outside).repartition(*keys).sortWithinPartitions(*keys)
    return ready.mapInArrow(partial(_nearest, keys, k, bool(outside)), LISTS)


def _best(lists: DataFrame, k: int) -> DataFrame:
    return cut(lists.repartition("id").sortWithinPartitions("id").mapInArrow(partial(_merged, k), LISTS + ", changed long"))


def _planted(vectors: DataFrame, trees: list[int], k: int) -> DataFrame:
    """First lists: the nearest within leaves of random trees, as deep as each label's vectors need. Where vectors have a
    component, only those of other components are listed, here and in _descended."""
    sizes = vectors.groupBy("space").agg(F.count("*").alias("_n"))
    outside = [c for c in vectors.columns if c == "component"]
    slim = vectors.select("id", "space", "vector", *outside)
    coded = slim.mapInArrow(_codes(trees, 24), ", ".join(f"{n} {t}" for n, t in slim.dtypes) + ", codes array<bigint>")
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("_n") / LEAF)), F.lit(0)), F.lit(24)).cast("int")
    leaves = coded.join(cut(sizes), "space").withColumn("depth", depth).select(*slim.columns, "depth", F.posexplode("codes").alias("tree", "code"))
    leaves = cut(leaves.select(*slim.columns, "tree", F.expr("code & (shiftleft(1L, depth) - 1)").alias("leaf")))
    out = _searched(_split(leaves, ["space", "tree", "leaf"], 2 * LEAF), ["space", "tree", "leaf"], k)
    return out


def _descended(graph: DataFrame, vectors: DataFrame, k: int, beside: DataFrame | None = None) -> DataFrame:
    """One round: the neighbours of each vector (in `beside` too), and the vectors that it is a neighbour of, meet, and
    each finds its nearest among them. Vectors with many such relations are dealt into parts."""
    lists = graph.select("id", "near") if beside is None else graph.select("id", "near").unionByName(beside.select("id", "near"))
    edges = lists.select(F.col("id").alias("v"), F.explode("near").alias("u"))
    both = edges.select(F.col("v").alias("center"), F.col("u").alias("id")).unionByName(edges.select(F.col("u").alias("center"), F.col("v").alias("id"))).unionByName(lists.select(F.col("id").alias("center"), "id")).distinct()
    met = cut(both)
    out = _searched(_split(met, ["center"], 8 * k).join(vectors.select("id", "vector", *(c for c in vectors.columns if c == "component")), "id"), ["center"], k)
    dropped_later = graph.select("id", "near", "cosine", F.lit(True).alias("old"))
    best = _best(out.withColumn("old", F.lit(False)).unionByName(dropped_later), k)
    dropped(met)
    return best


def _cosines(left: pa.Table, right: pa.Table | None, least: float) -> np.ndarray:
    a = _unit(floats(left.column("vector")))
    s = a @ (a if right is None else _unit(floats(right.column("vector")))).T
    if right is None:
        np.fill_diagonal(s, -2)
    return s >= least


def _sampled(vectors: DataFrame) -> DataFrame:
    """About AUDITED vectors by hash, as many of each label as of any other."""
    sizes = cut(vectors.groupBy("space").agg(F.count("*").alias("_n")))
    share = AUDITED / F.lit(max(sizes.count(), 1)) / F.col("_n")
    return vectors.join(sizes, "space").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HASHES)) < share * HASHES).select("id", "space", "vector")


def _audit(vectors: DataFrame, found: DataFrame, least: float) -> float:
    """The mean, over a bounded sample's vectors that have links, of the share of their links that found has: each
    counts once, however many links it has. Half of the sample is from all vectors and half from those outside large
    components; it is compared with all vectors."""
    sample = list({r["id"]: r for part in (vectors, _light(vectors, found)) for r in _sampled(part).collect()}.values())
    if not sample:
        return 1.0
    by_space: dict[int, list] = {}
    for r in sample:
        by_space.setdefault(r["space"], []).append(r)
    asked = {s: (np.array([r["id"] for r in rows]), _unit(np.array([r["vector"] for r in rows]))) for s, rows in by_space.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            spaces, ids, w = (batch.column(c).to_numpy() for c in ("space", "id", "w"))
            rows = batch.column("vector").to_pylist()
            for s in set(spaces.tolist()) & asked.keys():
                at = np.flatnonzero(spaces == s)
                q, v = asked[s]
                hit = (v @ _unit(np.array([rows[k] for k in at])).T >= least) & (q[:, None] != ids[at][None, :])
                for k, x in zip(q.tolist(), (hit * w[at]).sum(axis=1).tolist(), strict=True):
                    total[k] = total.get(k, 0) + x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "exact"])

    exact = vectors.select("id", "space", "w", "vector").mapInArrow(run, "id long, exact long").groupBy("id").agg(F.sum("exact").alias("exact"))
    share = F.least(F.coalesce("n_links", F.lit(0)) / F.col("exact"), F.lit(1.0))
    mean = F.broadcast(exact.where("exact > 0")).join(found.select("id", "n_links"), "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if mean is None else float(mean)


def _light(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Vectors outside components that fill a leaf."""
    large = groups.groupBy("component").count().where(F.col("count") > 2 * LEAF).select("component")
    return vectors.join(groups.join(large, "component").select("id"), "id", "left_anti")


def _edges(lists: DataFrame, least: float) -> DataFrame:
    return lists.select("id", F.explode(F.arrays_zip("near", "cosine")).alias("e")).where(F.col("e.cosine") >= least - 1e-6).select(F.col("id").alias("src"), F.col("e.near").alias("dst"))


def _settled(graph: DataFrame, vectors: DataFrame, k: int, beside: DataFrame | None = None) -> DataFrame:
    """graph after rounds of refinement, until few lists change."""
    size = graph.count()
    for _ in range(ROUNDS):
        after = _descended(graph, vectors, k, beside)
        dropped(graph)
        graph = after
        changed = graph.agg(F.sum("changed")).first()[0] or 0
        if changed <= SETTLED * k * max(size, 1):
            break
    return graph


def _joined(graph: DataFrame, vectors: DataFrame, least: float, k: int, trees: int) -> DataFrame:
    """(id, component) by the graph's threshold edges and by those that its saturated lists hide: a list that is full of
    links may hold members of one component only, while the vector has links to another. A pair can only be missing
    from both lists where both are saturated, so these vectors search for the nearest outside their component, and again
    those whose new list is saturated too, until none is."""
    edges, lists = _edges(graph, least), graph
    while True:
        groups = cut(connected_components(edges))
        full = lists.where((F.size("near") >= k) & (F.element_at("cosine", -1) >= least - 1e-6)).select("id")
        full = cut(vectors.select("id", "space", "vector").join(full, "id").join(groups, "id"))
        several = full.groupBy("space").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("space")
        full = cut(full.join(several, "space", "left_semi"))
        if full.isEmpty():
            return groups
        lists = _best(_planted(full, list(range(trees)), k).withColumn("old", F.lit(False)), k)
        lists = _settled(lists, full, k, graph.join(full.select("id"), "id", "left_semi"))
        edges = edges.unionByName(_edges(lists, least))


def _linked(groups: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(id, n_links, component) from components (id, component) that threshold edges join. Each is compared as a whole,
    in pairs of blocks, in double precision; links are counted there and never listed."""
    rows = vectors.join(groups, "id").select("component", "id", "w", "vector")
    found = cut(compared(in_blocks(rows, "component", BLOCK), ["vector"], partial(_cosines, least=least)))
    joined = connected_components(found.select(F.col("id").alias("src"), F.col("parent").alias("dst")))
    return cut(found.groupBy("id").agg(F.sum("links").alias("n_links")).join(joined, "id"))


def _found(vectors: DataFrame, least: float, neighbours: int, trees: int) -> DataFrame:
    """(id, n_links, component) of the vectors (id, space, w, vector) that have links, by a graph whose recall is audited."""
    slim = vectors.select("id", "space", "vector")
    graph = _best(_planted(slim, list(range(trees)), neighbours).withColumn("old", F.lit(False)), neighbours)
    planted = trees
    for attempt in range(AUDITS):
        graph = _settled(graph, vectors, neighbours)
        if attempt == 0:
            # Leaves that a large component fills are dealt into parts by hash, so all others get trees without it.
            groups = cut(connected_components(_edges(graph, least)))
            if not groups.groupBy("component").count().where(F.col("count") > 2 * LEAF).isEmpty():
                more = _planted(_light(slim, groups), list(range(trees)), neighbours).withColumn("old", F.lit(False))
                graph = _best(graph.select("id", "near", "cosine", F.lit(True).alias("old")).unionByName(more), neighbours)
                graph = _settled(graph, vectors, neighbours)
        found = _linked(_joined(graph, vectors, least, neighbours, planted), vectors, least)
        if _audit(vectors, found, least) >= RECALL:
            return found
        more = _planted(slim, list(range(planted, planted + 2 * trees)), neighbours)
        more = more.unionByName(_planted(_light(slim, found), list(range(planted, planted + 2 * trees)), neighbours)).withColumn("old", F.lit(False))
        planted += 2 * trees
        graph = _best(graph.select("id", "near", "cosine", F.lit(True).alias("old")).unionByName(more), neighbours)
    return _linked(vectors.select("id", F.col("space").alias("component")), vectors, least)


@tidy
def near_vectors(embeddings: DataFrame, least: float = 0.98, neighbours: int = NEIGHBOURS, trees: int = TREES) -> DataFrame:
    """Links between vectors of equal, known label and equal length whose cosine, in double precision, is `least` or more.

    Returns a row per row of embeddings (vec_id long, embedding array of floats or doubles, label; other columns are
    ignored): vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that links lead to, itself
    included), kept (vec_id is component_id). Vectors that are null, empty, zero or hold null or non-finite numbers, and
    those with a null label or vec_id, are linked with nothing. Equal vectors of a label are one vector of the graph,
    with their number as its weight; they count as equal when two 64-bit hashes of them are. A cosine of exactly `least`
    is a link. Rows that repeat a vec_id are rows like others. An empty table gives no rows.

    The graph starts from random trees and is refined by NN-descent until lists settle. Vectors with saturated lists
    search outside their components too; components are compared as wholes. A sample is audited by brute force after
    every attempt; where recall is short, more trees are added, and after AUDITS attempts the vectors of each label are
    compared block by block, without a graph, so that a result is never short.
    """
    spark = embeddings.sparkSession
    batches_held(spark)
    as_is = dict(embeddings.dtypes)["embedding"] in ("array<float>", "array<double>")
    rows = embeddings.select("vec_id", "label", (F.col("embedding") if as_is else F.col("embedding").cast("array<double>")).alias("embedding"))
    rows = rows.withColumn("ok", F.coalesce(valid() & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding", "label")))
    equal = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("embedding").alias("vector"))
    equal = equal.withColumn("rank", F.row_number().over(_by_id()))  # a repeated vec_id with another vector gets an id of its own
    vectors = cut(equal.select("k1", "k2", F.col("id").alias("vec"), F.when(F.col("rank") == 1, F.col("id")).otherwise(-F.shiftrightunsigned(F.col("k1"), 2) - 2).alias("id"), "w", F.xxhash64("label", F.size("vector")).alias("space"), "vector"))
    found = _found(vectors, least, neighbours, trees)
    named = vectors.select("k1", "k2", "id", "vec", "w").join(found, "id", "left")
    least_id = cut(named.where("component is not null").groupBy("component").agg(F.min("vec").alias("component_id")))
    named = cut(named.join(least_id, "component", "left").where("w > 1 or n_links is not null").select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "vec").alias("component_id")))
    out = rows.drop("embedding", "label").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("k1", "k2")
