"""Passages that stand in more than one place, by suffix arrays that are sorted in two stages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, likely_in, mixed, tidy

U = np.uint64
#: Bytes of a string that may not stand twice.
LENGTH = 200
#: Bytes of the strings (anchors) by which windows of LENGTH bytes are dealt; where the windows of one anchor are too many
#: for a task, they are dealt again by the next, longer one, and in the end by themselves.
ANCHORS = (32, 140, 180, 200)
#: Bytes that a suffix array has at least, where there are so many; that one anchor adds at most, but for the last kind; bytes
#: of texts that are searched for anchors at once; windows of a segment.
ROOM, LARGE, PART, PIECE = 1 << 20, 1 << 21, 1 << 20, 4096
#: Bits of the table that drops most segments whose anchor is nowhere else, before they are shuffled.
BITS = 1 << 26

_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.cumprod(out)


def _slid(x: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The least or largest of each `width` neighbours."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = better(x[:-step], x[step:])
        span += step
    return x


def anchors(data: np.ndarray, width: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the `width` bytes from each position on; and for each start of `length` bytes the least hash in them:
    equal windows have equal ones, wherever they stand, and neighbouring windows mostly share one."""
    n = 1 << max(len(data), PART + LENGTH).bit_length()
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, n)[: len(data)])])
    hashes = mixed((total[width:] - total[:-width]) * _powers(pow(_BASE, -1, 1 << 64), n)[: len(data) - width + 1])
    return hashes, _slid(hashes, length - width + 1, np.minimum)


def _parts(rows: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, ends, indices, first byte's offset) of texts in a row, about PART bytes at once; a longer text comes in
    slices that overlap by what a window needs."""
    held, size = [], 0
    for k, data in rows:
        if len(data) < LENGTH:
            continue
        if held and size + len(data) > PART:
            yield _joined(held)
            held, size = [], 0
        if len(data) > PART + LENGTH - 1:
            for at in range(0, len(data) - LENGTH + 1, PART):
                yield (*_joined([(k, data[at : at + PART + LENGTH - 1])])[:3], at)
            continue
        held.append((k, data))
        size += len(data)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    return np.frombuffer(b"".join(x for _, x in held), np.uint8), np.cumsum([len(x) for _, x in held]), np.array([k for k, _ in held]), 0


def _segments(ends: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor) of the runs of windows that share an anchor."""
    starts = np.r_[0, ends[:-1]]
    owner = np.repeat(np.arange(len(ends)), ends - starts)[: len(least)]
    valid = np.arange(len(least)) + LENGTH <= ends[owner]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    count = np.add.reduceat(valid.astype(np.int64), first) if len(first) else first
    pieces = -(-count // PIECE)
    if len(first) and pieces.max() > 1:
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count, first = np.minimum(PIECE, np.repeat(count, pieces) - piece * PIECE), np.repeat(first, pieces) + piece * PIECE
    return owner[first], first, count, least[first]


def _doubled(first: np.ndarray, count: np.ndarray, key: np.ndarray, hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a segment holds its anchor in two places, as it does where one of its windows repeats another."""
    span = len(hashes) - len(least) + 1
    pad = np.zeros(span - 1, U)
    at = np.flatnonzero(_slid(np.concatenate([pad, least, pad]), span, np.maximum) == hashes)  # places of any anchor
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, first + count + span - 1)
    size = hi - lo
    seg = np.repeat(np.arange(len(first)), size)
    place = at[np.arange(len(seg)) + np.repeat(lo - (np.cumsum(size) - size), size)]
    return np.bincount(seg[hashes[place] == key[seg]], minlength=len(first)) > 1


def _anchored(width: int):
    """(key, a, n) for each text (or slice of a long one) and anchor: how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            for data, ends, index, at in _parts(list(enumerate(batch.column("data").to_pylist()))):
                hashes, least = anchors(data, width)
                owner, first, count, key = _segments(ends, least)
                times = 1 + _doubled(first, count, key, hashes, least)
                order = np.lexsort((key, owner))
                owner, key, times = owner[order], key[order].view(np.int64), times[order]
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, int)
                n = np.add.reduceat(times, new) if len(key) else new
                of = a[index[owner[new]]] + at // PART  # slices of a text count as texts of their own
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(of, pa.int64()), pa.array(n, pa.int64())], ["key", "a", "n"])

    return run


def _cut_out(width: int):
    """(a, b, s, key, seg, w): the distinct segments of texts (or slices of long ones), the bytes s that they begin at, and
    how often they stand there in all copies. Text that repeats itself has the same segments again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w = (batch.column(c).to_numpy() for c in ("a", "b", "w"))
            for data, ends, index, at in _parts(list(enumerate(batch.column("data").to_pylist()))):
                owner, first, count, key = _segments(ends, anchors(data, width)[1])
                raw = data.tobytes()
                seg = [raw[x : x + n + LENGTH - 1] for x, n in zip(first.tolist(), count.tolist(), strict=True)]
                place = first - np.r_[0, ends[:-1]][owner] + at
                number: dict[tuple[int, bytes], int] = {}
                group = np.array([number.setdefault(x, len(number)) for x in zip(owner.tolist(), seg, strict=True)], np.int64)
                order = np.argsort(group, kind="stable")
                times = np.bincount(group)
                edge = np.r_[0, np.cumsum(times)]
                one = order[edge[:-1]]
                row = index[owner[one]]
                places = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(place[order], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a[row], b[row])), places, pa.array(key[one].view(np.int64)), pa.array([x for _, x in number], pa.binary()), pa.array(w[row] * times, pa.int64())], ["a", "b", "s", "key", "seg", "w"])

    return run


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end, for positions up to depth beyond it."""
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(t) + depth].copy().view(">u8").ravel().astype(U)


def _direct(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes from them on, by refining groups of ties eight bytes at a time."""
    key = words[pos]
    order = np.argsort(key)
    pos, key = pos[order], key[order]
    at, group = np.arange(len(pos)), np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(pos) else pos
    for d in range(8, depth, 8):
        size = np.bincount(group) if len(group) else group
        tied = (size > 1)[group] if len(group) else np.zeros(0, bool)
        at, group = at[tied], group[tied]
        if not len(at):
            break
        edge = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        key = words[pos[at] + d]
        odd = np.logical_or.reduceat(key != key[first][group], first)[group]
        if odd.any():
            where = np.flatnonzero(odd)
            order = where[np.lexsort((key[where], group[where]))]
            pos[at[where]] = pos[at[order]]
            key[where] = key[order]
            group = np.cumsum(edge | np.r_[True, key[1:] != key[:-1]]) - 1
    return pos


def suffix_array(t: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """The starts of all suffixes of t in the order of their first `depth` bytes (or more).

    Two stages. A suffix that is smaller than its successor is sorted directly. Any other one is its first byte before a
    smaller suffix, so scanning the array from its begin finds them in order: what precedes the suffix scanned, if it is
    of that kind, takes the next free place of its first byte's bucket. In a bucket those come first. The scan goes by
    buckets, and in one by rounds, as suffixes of a run of one byte induce each other.
    """
    n = len(t)
    words = _words(t, depth) if words is None else words
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = np.r_[t[1:][change] > t[:-1][change], False]
    smaller = rises[np.searchsorted(change, np.arange(n))]  # than the successor: as the next change of bytes says
    size, direct = np.bincount(t, minlength=256), np.bincount(t[smaller], minlength=256)
    begin = np.cumsum(size) - size
    free = begin.copy()
    out = np.empty(n, np.int64)
    pos = _direct(words, np.flatnonzero(smaller), depth)
    byte = t[pos]
    out[np.arange(len(pos)) + (begin + size - direct - (np.cumsum(direct) - direct))[byte]] = pos

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        byte = t[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        count = np.bincount(byte, minlength=256)
        out[np.arange(len(before)) + (free - (np.cumsum(count) - count))[byte]] = before
        np.add(free, count, out=free)

    if n:
        induce(np.array([n]))
    for c in np.flatnonzero(size):
        done = begin[c]
        while done < free[c]:
            done, scanned = free[c], out[done : free[c]]
            induce(scanned)
        induce(out[begin[c] + size[c] - direct[c] : begin[c] + size[c]])
    return out


def common_prefixes(words: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """How many bytes, up to depth, the suffixes at left and right have in common."""
    out, open_ = np.full(len(left), depth), np.arange(len(left))
    for d in range(0, depth, 8):
        x = words[left[open_] + d] ^ words[right[open_] + d]
        ended = x != 0
        first = (x[ended][:, None] >> (U(56) - U(8) * np.arange(8, dtype=U)) != 0).argmax(axis=1)
        out[open_[ended]] = np.minimum(depth, d + first)
        open_ = open_[~ended]
        if not len(open_):
            break
    return out


def repeated_windows(t: np.ndarray, valid: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which valid starts have the same `length` bytes from them on as another valid start."""
    words = _words(t, length)
    order = suffix_array(t, length, words)
    order = order[valid[order]]
    again = np.zeros(len(t), bool)
    same = common_prefixes(words, order[:-1], order[1:], length) >= length
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by key in tables of about ROOM bytes that hold keys whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            if size > ROOM:
                last, key = held[-1].column("key")[-1].as_py(), part.column("key").to_numpy()
                other = np.flatnonzero(key != last)
                if len(other):
                    if other[0]:
                        held.append(part.slice(0, int(other[0])))
                    yield pa.Table.from_batches(held)
                    held, size, part = [], 0, part.slice(int(other[0]))
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, runs): the runs (lo, hi) of windows of a segment that stand elsewhere too, if there are any. A segment that
    is there more than once is in the suffix array twice."""
    for block in _blocks(batches):
        segs, twice = block.column("seg").to_pylist(), block.column("m").to_numpy() > 1
        size = np.array([len(x) for x in segs])
        raw = b"".join(segs) + b"".join(x for x, more in zip(segs, twice.tolist(), strict=True) if more)
        sizes = np.concatenate([size, size[twice]])
        end = np.cumsum(sizes)
        valid = np.arange(len(raw)) + LENGTH <= np.repeat(end, sizes)
        again = repeated_windows(np.frombuffer(raw, np.uint8), valid)[: int(size.sum())]
        edge = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
        lo, hi = edge[::2], edge[1::2]  # a run never leaves its segment: the last windows' starts aren't valid
        row = np.searchsorted(end[: len(segs)], lo, "right")
        base = (end[: len(segs)] - size)[row]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        runs = pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], ["lo", "hi"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), runs)
        yield pa.RecordBatch.from_arrays([*(pa.array(block.column(c).to_numpy()[row[first]]) for c in ("a", "b")), lists], ["a", "b", "runs"])


def _marks(column: str) -> list:
    """Two 64-bit hashes that stand for a text or segment."""
    return [F.xxhash64(column).alias("a"), F.xxhash64(F.lit(7), column).alias("b")]


#: Touching runs of a short list, as one.
MERGED = """aggregate(runs, array(runs[0]), (out, r) -> if(r.lo <= element_at(out, -1).hi,
  concat(slice(out, 1, size(out) - 1), array(named_struct('lo', element_at(out, -1).lo, 'hi', greatest(element_at(out, -1).hi, r.hi)))), concat(out, array(r))))"""


def repeats(texts: DataFrame, level: int = 0) -> DataFrame:
    """(a, b, runs): for texts (a, b, data, w) with any, the runs of windows, by first bytes lo to hi - 1, that stand
    elsewhere in the texts too; runs may overlap. a and b are hashes of data, w says how often the text is there; rows that
    repeat count each.

    Equal windows have the same anchor, so texts are cut into segments of windows with one anchor, segments whose anchor
    is nowhere else are dropped, equal ones are collapsed, and the others of each anchor meet in one suffix array, many
    anchors in each. Anchors with too many different segments go through the same with a longer anchor.
    """
    batches_held(texts.sparkSession)
    width = ANCHORS[level]
    keys = texts.select("a", "data").mapInArrow(_anchored(width), "key long, a long, n long")
    again = cut(keys.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.max("n").alias("n")).where("x <> y or n > 1").select("key"))
    segs = texts.select("a", "b", "data", "w").mapInArrow(_cut_out(width), "a long, b long, s array<long>, key long, seg binary, w long")
    segs = cut(likely_in(segs, again, F.col("key"), F.col("key"), BITS).select("a", "b", "s", "key", "seg", "w"))
    distinct = cut(segs.groupBy("key", "seg").agg(F.sum("w").alias("m")).select("key", "m", "seg", *_marks("seg")))
    room = distinct.groupBy("key").agg(F.sum(F.length("seg") * F.least("m", F.lit(2))).alias("size"))
    last = level + 1 == len(ANCHORS)
    room = cut(room.select("key", (F.lit(not last) & (F.col("size") > LARGE)).alias("large")))
    rows = cut(distinct.join(room, "key"))
    own = rows.where("not large").select("key", "m", "seg", "a", "b").repartition("key").sortWithinPartitions("key")
    found = own.mapInArrow(_searched, "a long, b long, runs array<struct<lo: long, hi: long>>")
    large = rows.where("large")
    if not last and not large.isEmpty():
        deeper = repeats(large.select("a", "b", F.col("seg").alias("data"), F.col("m").alias("w")), level + 1)
        found = found.unionByName(deeper.select("a", "b", F.expr(MERGED).alias("runs")))
    found = cut(found)
    # a segment's own runs, moved to all places where the segment stands in each text
    places = segs.select("a", "b", "s", *(c.alias(f"seg_{k}") for k, c in zip("ab", (F.xxhash64("seg"), F.xxhash64(F.lit(7), "seg")), strict=True)))
    places = likely_in(places, found, F.col("seg_a"), F.col("a"), BITS).distinct()
    moved = places.join(found.select(F.col("a").alias("seg_a"), F.col("b").alias("seg_b"), "runs"), ["seg_a", "seg_b"])
    moved = moved.select("a", "b", F.expr("flatten(transform(s, p -> transform(runs, r -> named_struct('lo', r.lo + p, 'hi', r.hi + p))))").alias("runs"))
    copies = texts.select("a", "b", F.octet_length("data").cast("long").alias("size"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("size").alias("size"))
    whole = copies.where(f"w > 1 and size >= {LENGTH}").select("a", "b", F.expr(f"array(named_struct('lo', 0L, 'hi', size - {LENGTH - 1}))").alias("runs"))
    return moved.unionByName(whole).groupBy("a", "b").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))


def _kept(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for data, runs in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                out, last, parts = [], 0, []
                for x in runs or []:
                    lo, hi = x["lo"], x["hi"] + LENGTH - 1
                    if out and lo <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], hi)
                    else:
                        out.append({"start": lo, "end": hi})
                for x in out:
                    parts.append(data[last : x["start"]])
                    last = x["end"]
                spans.append(out)
                kept.append(b"".join([*parts, data[last:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], [*columns, "spans", "kept"])

    return run


@tidy
def without_repeats(docs: DataFrame) -> DataFrame:
    """Documents without each byte that is part of a string of LENGTH bytes that stands in another place too, in the same
    document or any other: (doc_id, n_bytes, spans, kept), a row per row of docs (doc_id, text; other columns are ignored).

    Texts are their bytes in UTF-8, strings never cross documents, those that overlap count, and all are judged on the
    input: of copies none stays. spans are the removed runs as (start, end) in bytes, in order; kept is what is left, as
    bytes, for a run may begin within a character. A null text counts as empty; one below LENGTH bytes stays as it is;
    repeated rows are documents of their own, so each repeats the other; ties can't be; an empty table gives no rows.
    """
    rows = documents_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    rows = rows.select("doc_id", "data", F.octet_length("data").cast("long").alias("n_bytes"), *_marks("data"))
    found = repeats(rows.select("a", "b", "data", F.lit(1).cast("long").alias("w")))
    gone = cut(found)
    columns = ["doc_id", "n_bytes"]
    # only texts that may lose something are shuffled and go to Python
    near = likely_in(rows, gone, F.col("a"), F.col("a"), BITS, marked=True)
    joined = near.where("likely").select(*columns, "data", "a", "b").join(gone, ["a", "b"], "left").select(*columns, "data", "runs")
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    rest = near.where("not likely").select(*columns, F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.col("data").alias("kept"))
    return joined.mapInArrow(_kept(columns), schema).unionByName(rest)


#: By brute force: every window in hexadecimal, in pieces so that no function walks a long text again for each window.
ORACLE = f"""
with docs as (select row_number() over () id, doc_id, hex(encode(coalesce(text, ''))) h from documents),
pieces as (select id, k * 500 base, substr(h, 1000 * k + 1, 1000 + 2 * {LENGTH}) piece, length(h) // 2 - k * 500 n from (select id, h, unnest(range(0, length(h) // 1000 + 1)) k from docs)),
windows as (select id, base + i pos, md5_number(substr(piece, 2 * i + 1, 2 * {LENGTH})) w from (select id, base, piece, unnest(range(0, least(500, n - {LENGTH} + 1))) i from pieces where n >= {LENGTH})),
again as (select id, pos from windows where w in (select w from windows group by w having count(*) > 1)),
edges as (select id, pos, coalesce(pos > lag(pos) over (partition by id order by pos) + {LENGTH}, true) begins from again),
spans as (select id, min(pos) lo, max(pos) + {LENGTH} hi from (select id, pos, sum(begins::int) over (partition by id order by pos) g from edges) group by id, g),
removed as (select id, sum(hi - lo)::bigint n_removed, count(*) n_spans from spans group by id),
cuts as (select id, lo, hi, coalesce(lag(hi) over (partition by id order by lo), 0) since, lead(lo) over (partition by id order by lo) is null ends from spans),
kept as (select c.id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)) || case when ends then substr(h, 2 * hi + 1) else '' end, '' order by lo) k from cuts c join docs d on c.id = d.id group by c.id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from docs left join removed using (id) left join kept using (id)
"""
