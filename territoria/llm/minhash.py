"""Links between similar texts by MinHash banding, verified on whole shingle sets, and counted without listing pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, giving_back, likely_in, mixed, whole_groups
from territoria.llm.components import connected_components, roots

U = np.uint64
#: Bytes (of words) or characters that are hashed at once, and texts of a block that are compared with another block.
PART, BLOCK = 1 << 18, 128
#: Members of a bucket that are compared in one task; and of those whose pairs are listed and compared with many others'.
BUCKET, SMALL = 256, 16
#: Pairs, and (about) characters of their texts, that are compared at once. Numbers of pairs and texts take 12 bits of a
#: sorted key, and their shingles' hashes the others.
PAIRS, PAIRED = 1 << 12, 1 << 21
#: Characters (about) of a block of texts: a task that compares two blocks holds some hundred bytes for each.
ROOM = 1 << 19


@dataclass(frozen=True)
class Plan:
    """What is compared: "words" or "chars" shingles of `width`; the bands and their rows; the least similarity."""

    unit: str
    width: int
    bands: int
    rows: int
    least: float

    def recall(self, similarity: float) -> float:
        return 1 - (1 - similarity**self.rows) ** self.bands


def planned(unit: str, width: int, least: float, recall: float, rows: int) -> Plan:
    """The fewest bands of so many rows that find pairs at the least similarity with the recall wanted."""
    bands = 1
    while 1 - (1 - least**rows) ** bands < recall:
        bands += 1
    return Plan(unit, width, bands, rows, least)


BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.cumprod(out)


def _sized(n: int) -> int:
    return 1 << max(n, PART).bit_length()


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word (run of anything but ASCII white space), and the text that it is in. Hashes come from
    differences of one running polynomial, brought back to power 0."""
    raw = [x.encode() for x in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, blank]))
    starts, ends = edge[::2], edge[1::2]
    n = _sized(len(data))
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * _powers(BASE, n)[: len(data)])])
    h = (total[ends] - total[starts]) * _powers(UNBASE, n)[starts]
    at = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return mixed(h), np.searchsorted(at, starts, "right") - 1


def _grams(units: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of `width` units of one owner; an owner with fewer has one run of all its units."""
    if not len(units):
        return units.astype(U), owner
    weights = _powers(0xD6E8FEB86659FD93, 64)[1 : width + 1]
    n = max(len(units) - width + 1, 0)
    whole = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    h = np.zeros(n, U)
    term = np.empty(n, U)
    for k in range(width):
        np.multiply(units[k : k + n], weights[k], out=term)
        h += term
    h, own = h[whole], owner[:n][whole]
    count = np.bincount(owner)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), U)
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += units[first[has] + k] * weights[k]
        extra += count[short].astype(U) * U(0x632BE59BD9B4E019)
        h, own = np.concatenate([h, extra]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return mixed(h), own


def shingles(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of texts, and the index of each one's text, ascending."""
    if plan.unit == "words":
        return _grams(*_word_hashes(texts), plan.width)
    units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return _grams(units.astype(U) + U(1), np.repeat(np.arange(len(texts)), [len(x) for x in texts]), plan.width)


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about PART characters, with the index of each run's first."""
    first, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > PART:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(x)
    if texts:
        yield first, texts[first:]


@cache
def _factors(n: int) -> np.ndarray:
    """Odd numbers: multiplying by one permutes the 32-bit hashes."""
    return np.random.default_rng(20240229).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether there is any shingle) of each text."""
    n = plan.bands * plan.rows
    a = _factors(n)
    out, there = np.zeros((len(texts), n), np.uint32), np.zeros(len(texts), bool)
    for first, some in parts(texts):
        h, own = shingles(some, plan)
        if not len(h):
            continue
        x = (h >> U(32)).astype(np.uint32)
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        who = own[start] + first
        there[who] = True
        buffer = np.empty_like(x)
        for k in range(n):
            np.multiply(x, a[k], out=buffer)
            out[who, k] = np.minimum.reduceat(buffer, start)
    return out, there


def band_hashes(signature: np.ndarray, plan: Plan) -> np.ndarray:
    rows = signature.astype(U).reshape(len(signature), plan.bands, plan.rows)
    h = np.broadcast_to(np.arange(1, plan.bands + 1, dtype=U), rows.shape[:2])
    for k in range(plan.rows):
        h = mixed(h * U(0x9FB21C651E98DF25) + rows[:, :, k])
    return h.view(np.int64)


def lists(matrix: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """A matrix as Arrow lists, empty where there is nothing."""
    if there is not None:
        sizes = np.where(there, matrix.shape[1], 0)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(matrix[there].ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def banded(items: DataFrame, plan: Plan) -> DataFrame:
    """items with bands (array of longs, empty for texts without a shingle) instead of text."""
    batches_held(items.sparkSession)
    kept = [c for c in items.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, there = signatures(batch.column("text").to_pylist(), plan)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists(band_hashes(s, plan), there)], [*kept, "bands"])

    return items.mapInArrow(giving_back(run), ", ".join(f"{n} {t}" for n, t in items.dtypes if n != "text") + ", bands array<long>")


def shared_buckets(bands: DataFrame) -> DataFrame:
    """(bucket, n, id) for the members of buckets with two or more, a bucket for each set of members only: bands that
    hold the same set, as those of near copies do, count once. Larger buckets have smaller numbers, so that most pairs of
    a group first meet in one of them. From (id, bands)."""
    rows = bands.select("id", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("lo")).where("n > 1")
    once = cut(full.groupBy("n", "x", "lo").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    found = likely_in(rows, once, F.col("bucket"), F.col("bucket")).join(once, "bucket")
    numbered = F.expr(f"shiftleft(cast(31 - least(31, floor(log2(n))) as bigint), 57) | (bucket & {(1 << 57) - 1}L)")
    return cut(found.select(numbered.alias("bucket"), "n", "id"))


def in_blocks(members: DataFrame, group: str, size: int, text: str | None = None) -> DataFrame:
    """A row of members for each pair of blocks that its group has it compared in: a group of up to `size` rows, and
    ROOM characters of `text`, is one block; a larger one is dealt into blocks of about that by hash, and each pair of
    blocks is a task's work. Columns: g, bi, bj, side (0 in the first block, 1 in the second), then those of members."""
    blocks = F.ceil(F.count("*") / size)
    if text:
        blocks = F.greatest(blocks, F.ceil(F.sum(F.length(text)) / ROOM))
    sizes = cut(members.groupBy(group).agg(blocks.alias("blocks")))
    dealt = members.join(sizes, group).withColumn("b", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rest = [c for c in members.columns if c != group]
    return pairs.select(F.col(group).alias("g"), F.least("b", "other").alias("bi"), F.greatest("b", "other").alias("bj"), (F.col("b") > F.col("other")).cast("long").alias("side"), *rest)


def compared(blocks: DataFrame, payload: list[str], linked: Callable[[pa.Table, pa.Table | None], np.ndarray], paired: Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(g, id, links, parent) for members that have a link in a pair of blocks: links is the weight w of what they are
    linked with there, parent the smallest id that links there lead to. linked(left, right or None) is a matrix of
    booleans over rows with the columns g and payload; paired(rows, i, j), a vector over pairs of rows, serves groups of
    up to SMALL, many at once, where it is given. Pairs never leave the task; there are no more rows than members of blocks."""
    batches_held(blocks.sparkSession)
    names, columns = ["g", "id", "links", "parent"], ["g", *payload]

    def told(rows: pa.Table, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit], pa.int64()) for x in (rows.column("g").to_numpy(), rows.column("id").to_numpy(), links, root)], names)

    def in_pairs(rows: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        pairs = [[starts[sizes == n][:, None] + x[None, :] for x in np.triu_indices(n, 1)] for n in np.unique(sizes).tolist()]
        i, j = (np.concatenate([x.ravel() for x in side]) for side in zip(*pairs, strict=True))
        ids, w = rows.column("id").to_numpy(), rows.column("w").to_numpy()
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        hit = paired(rows.select(columns), i, j)
        i, j = i[hit], j[hit]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        return told(rows, links, ids[roots(len(ids), i, j)])  # rows of a group lie in the order of their ids

    def in_matrix(group: pa.Table) -> pa.RecordBatch | None:
        ids, w, side = (group.column(c).to_numpy() for c in ("id", "w", "side"))
        within = group.column("bi")[0].as_py() == group.column("bj")[0].as_py()
        a = np.arange(len(ids)) if within else np.flatnonzero(side == 0)
        b = a if within else np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return None
        data = group.select(columns)
        m = linked(data, None) if within else linked(data.take(pa.array(a)), data.take(pa.array(b)))
        links = np.zeros(len(ids), np.int64)
        i, j = np.nonzero(m)
        np.add.at(links, a[i], w[b[j]])
        if not within:
            np.add.at(links, b[j], w[a[i]])
        order = np.argsort(ids, kind="stable")  # so that the smallest index is the smallest id
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))
        return told(group, links, ids[order][roots(len(ids), place[a[i]], place[b[j]])[place]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches, ["g", "bi", "bj"]):
            starts, sizes = edges[:-1], np.diff(edges)
            within = (rows.column("bi").to_numpy() == rows.column("bj").to_numpy())[starts]
            small = within & (sizes <= SMALL) & (sizes > 1) & (paired is not None)
            if small.any():
                yield in_pairs(rows, starts[small], sizes[small])
            for k in np.flatnonzero(~small & (sizes > 1)).tolist():
                out = in_matrix(rows.slice(edges[k], sizes[k]).combine_chunks())
                if out is not None:
                    yield out

    ready = blocks.select("g", "bi", "bj", "side", "id", "w", *payload).repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj", "id")
    return ready.mapInArrow(giving_back(run), "g long, id long, links long, parent long")


def _own(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows in a row, and the row of each."""
    lists_ = rows.column("own").combine_chunks()
    return lists_.flatten().to_numpy(), np.repeat(np.arange(len(lists_)), lists_.value_lengths().to_numpy())


def first_met(left: pa.Table, right: pa.Table | None) -> np.ndarray:
    """Which rows share no smaller bucket (column own, sorted) than the one they are compared in (g): of all buckets that
    a pair shares, one tells it so, and the pair counts there only."""
    g, n = left.column("g")[0].as_py(), left.num_rows
    m = n if right is None else right.num_rows
    what, who = _own(left if right is None else pa.concat_tables([left, right]))
    what, who = what[what < g], who[what < g]
    if not len(what):
        return np.ones((n, m), bool)
    order = np.argsort(what, kind="stable")
    what, who = what[order], who[order]
    same = what[1:] == what[:-1]
    held = np.r_[False, same] | np.r_[same, False]
    if not held.any():
        return np.ones((n, m), bool)
    what, who = what[held], who[held]
    column = np.cumsum(np.r_[False, what[1:] != what[:-1]])
    bits = np.zeros((n if right is None else n + m, int(column[-1]) + 1), np.float32)
    bits[who, column] = 1
    return bits[:n] @ (bits if right is None else bits[n:]).T == 0


def first_met_pairs(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As first_met, for pairs (i, j) of rows of many groups."""
    g = rows.column("g").to_numpy()
    what, who = _own(rows)
    size = np.bincount(who, minlength=len(g))
    _, rank = np.unique(what, return_inverse=True)
    met = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        own, pair = _listed(np.cumsum(size) - size, size, [i[k : k + (1 << 16)], j[k : k + (1 << 16)]])
        small = what[own] < g[i[k + pair]]
        key = np.sort(pair[small] * len(what) + rank[own[small]])
        met[k + key[1:][key[1:] == key[:-1]] // max(len(what), 1)] = False  # both sides have it
    return met


def _listed(first: np.ndarray, size: np.ndarray, sides: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places first[x] to first[x] + size[x] for the x of all sides in a row, and each one's index in its side."""
    x = np.concatenate(sides)
    n = size[x]
    places = np.arange(n.sum()) + np.repeat(first[x] - np.cumsum(n) + n, n)
    return places, np.repeat(np.concatenate([np.arange(len(side)) for side in sides]), n)


#: Bits of a shingle's hash in a sorted key: the upper ones are a number below PAIRS.
_BITS = U(64 - PAIRS.bit_length() + 1)


def _sets(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles (the upper bits of their hashes) of each text in a row, each one's text, and the sizes of
    these sets. One key of 64 bits stands for text and hash, as sorting two columns takes several times as long."""
    hashes, owners = [], []
    for k in range(0, len(texts), PAIRS):
        for first, some in parts(texts[k : k + PAIRS]):
            h, own = shingles(some, plan)
            key = np.sort(own.astype(U) << _BITS | h >> (U(64) - _BITS))
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            hashes.append(key & (U(1) << _BITS) - U(1))
            owners.append((key >> _BITS).astype(np.int64) + first + k)
    h, own = np.concatenate(hashes), np.concatenate(owners)
    return h, own, np.bincount(own, minlength=len(texts))


def similar_pairs(texts: list[str], i: np.ndarray, j: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether texts i and j, PAIRS pairs at most, have the least Jaccard similarity."""
    held, at = np.unique(np.r_[i, j], return_inverse=True)
    h, _, size = _sets([texts[k] for k in held.tolist()], plan)
    a, b = at[: len(i)], at[len(i) :]
    own, pair = _listed(np.cumsum(size) - size, size, [a, b])
    key = np.sort(pair.astype(U) << _BITS | h[own])
    common = np.bincount((key[1:][key[1:] == key[:-1]] >> _BITS).astype(np.int64), minlength=len(i))
    return (common > 0) & (common >= plan.least * (size[a] + size[b] - common) - 1e-9)


def similar(left: list[str], right: list[str] | None, plan: Plan) -> np.ndarray:
    """Which texts have the least Jaccard similarity of whole shingle sets; the diagonal counts not."""
    texts = left + (right or [])
    n = len(left)
    h, own, size = _sets(texts, plan)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    held = count[column] > 1
    column, own = np.unique(column[held], return_inverse=True)[1], own[held]
    common = np.zeros((n, n if right is None else len(texts) - n))
    columns = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    step = max(1024, (1 << 22) // max(len(texts), 1))
    for k in range(0, columns, step):
        lo, hi = np.searchsorted(column, [k, k + step])
        bits = np.zeros((len(texts), min(step, columns - k)), np.float32)
        bits[own[lo:hi], column[lo:hi] - k] = 1
        common += bits[:n] @ (bits if right is None else bits[n:]).T
    of, to = size[:n].astype(float), (size if right is None else size[n:]).astype(float)
    out = (common > 0) & (common >= plan.least * (of[:, None] + to[None, :] - common) - 1e-9)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _low(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(rows.num_rows, -1)


def _near_pairs(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    low = _low(rows)
    hit = np.concatenate([(low[i[k : k + PAIRS]] == low[j[k : k + PAIRS]]).sum(axis=1) >= NEAR * low.shape[1] for k in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
    hit[hit] = first_met_pairs(rows, i[hit], j[hit])
    return hit


def _near(left: pa.Table, right: pa.Table | None) -> np.ndarray:
    """Which low bytes of signatures agree so often that the texts may be similar, of pairs that count in this bucket."""
    a = _low(left)
    b = a if right is None else _low(right)
    out = np.empty((len(a), len(b)), bool)
    for k in range(0, len(a), 64):
        part = a[k : k + 64]
        same = np.zeros((len(part), len(b)), np.int16)
        for j in range(a.shape[1]):
            same += part[:, j, None] == b[None, :, j]
        out[k : k + 64] = same >= NEAR * a.shape[1]
    if right is None:
        np.fill_diagonal(out, False)
    return out & first_met(left, right) if out.any() else out


def _linked(left: pa.Table, right: pa.Table | None, plan: Plan) -> np.ndarray:
    hit = similar(left.column("text").to_pylist(), None if right is None else right.column("text").to_pylist(), plan)
    return hit & first_met(left, right) if hit.any() else hit


def _linked_pairs(rows: pa.Table, i: np.ndarray, j: np.ndarray, plan: Plan) -> np.ndarray:
    """A pair's texts are compared only where it counts."""
    hit = first_met_pairs(rows, i, j)
    met, texts = np.flatnonzero(hit), rows.column("text").to_pylist()
    size = np.array([len(x) for x in texts])
    before = np.cumsum((size[i] + size[j])[met])
    while len(met):
        n = max(1, min(PAIRS, int(np.searchsorted(before, before[0] + PAIRED))))
        hit[met[:n]] = similar_pairs(texts, i[met[:n]], j[met[:n]], plan)
        met, before = met[n:], before[n:]
    return hit


#: Share of equal signature bytes from which texts are compared on whole sets. At a similarity of 0.8 and 50 bytes this
#: is over five standard deviations below what is expected.
NEAR = 0.5


def with_signature(items: DataFrame, plan: Plan) -> DataFrame:
    batches_held(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, _ = signatures(batch.column("text").to_pylist(), plan)
            low = (s & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in low], pa.binary())], [*batch.schema.names, "low"])

    return items.mapInArrow(giving_back(run), ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", low binary")


def links(bands: DataFrame, texts: Callable[[DataFrame], DataFrame], plan: Plan) -> DataFrame:
    """(id, n_links, component) for ids that are linked with another: n_links is the weight of all they are linked
    with, component the smallest id that links lead to.

    bands: (id, bands). texts(ids) gives (id, w, text) for a table of ids. Members of each shared bucket are compared by
    their signatures, in pairs of blocks; those that may be similar to another meet again in the bucket with their texts,
    and are compared on whole shingle sets. A pair that shares several buckets counts in the smallest one only, so links
    add up, and only links that are verified join components. Neither pairs nor a bucket as a whole are ever in one
    place; intermediate tables are written to the shared folder.
    """
    buckets = shared_buckets(bands)
    own = cut(buckets.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("own")))  # a bucket for each band at most
    known = cut(with_signature(texts(own.select("id")), plan))
    sketches = known.select("id", "low").join(own, "id")
    members = buckets.select("bucket", "id").join(sketches, "id").withColumn("w", F.lit(1).cast("long"))
    near = cut(compared(in_blocks(members, "bucket", BUCKET), ["low", "own"], _near, _near_pairs).select(F.col("g").alias("bucket"), "id").distinct())
    rows = near.join(known.drop("low"), "id").join(own, "id")
    found = cut(compared(in_blocks(rows, "bucket", BLOCK, "text"), ["text", "own"], partial(_linked, plan=plan), partial(_linked_pairs, plan=plan)).select("id", "links", "parent"))
    joined = connected_components(found.select(F.col("id").alias("src"), F.col("parent").alias("dst")))
    return cut(found.groupBy("id").agg(F.sum("links").alias("n_links")).join(joined, "id"))
