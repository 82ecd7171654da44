"""Vector bin packing of documents into token sequences by the dot-product heuristic."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, cached_property
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, giving_back, runs, tidy

#: Limits of a sequence: tokens, segments (pieces), and tokens that bear loss; and the id after each document. Of plain
#: documents each token may be a piece, and nearly all bear loss, so there neither other limit ends a sequence before the
#: first does; of conversations both are true limits, and the answers bear loss.
TOKENS, SEGMENTS, LOSS, END = 4096, 4096, 4096, 2
#: Roles whose turns bear loss, and the examples and loss-bearing tokens of a sequence of conversations.
ANSWERS, EXAMPLES, ANSWER_TOKENS = ("assistant",), 64, 2048
#: Pieces that are packed together in one task, more if they fill fewer than so many sequences. Groups are dealt by hash,
#: so their number grows with the data.
GROUP, FILLED = 2048, 64
#: Encoded words that a worker remembers, some 200 bytes each.
REMEMBERED = 250_000

#: Letters for which splitting and lower case are known, by tests, to be the tokenizer's own: Latin ones, and what goes
#: with them. Texts with any other go to it whole. And its way of splitting lower-case text into words (a fixed value).
OTHER = re.compile("[^\x00-\x7f\xa0-\u012f\u0131-\u0148\u014a-\u01c4\u01c6\u01c7\u01c9\u01ca\u01cc-\u01ef\u01f1\u01f3-\u024f\u2010-\u2027\u20ac\U0001f600-\U0001f64f]")
#: The first of these letters and digits decides, so the most frequent kind comes first. Some lower-case forms of the
#: letters tested lie beyond them.
_KIND = {c: unicodedata.category(c)[0] for k in range(0x250) for c in chr(k) + chr(k).lower()}
_LETTERS, _DIGITS = ("".join(c for c, kind in _KIND.items() if kind == x) for x in "LN")
WORDS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
#: Signs that only Python takes for white space.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Shown(dict):
    """The characters that stand for the bytes of a character in the vocabulary, by code point."""

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, c: int) -> str:
        self[c] = shown = self.level.pre_tokenize_str(chr(c))[0][0]
        return shown


class Bare:
    """The tokenizer's model without what goes before it: encodes lower-case words with a space between them, which is all
    that the normalizer and the splitting would leave of them."""

    def __init__(self, tokenizer):
        model = tokenizer.model
        model._resize_cache(0)  # words come once, so its own memory only costs time
        self.tokenize, self.shown, self.ids = model.tokenize, Shown(), []

    def encode(self, text: str, add_special_tokens: bool = False) -> Bare:
        # printable ASCII stands for itself
        self.ids = [t.id for word in text.split(" ") for t in self.tokenize(word if word.isascii() and word.isprintable() else word.translate(self.shown))]
        return self


class Words:
    """Little-endian 32-bit ids of words, as the tokenizer encodes them; words don't affect each other. Words that are
    new are encoded together, in a row: the last token of a word is known by its ending."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, own = path, Tokenizer.from_file(path)
        self.tokenizer = Bare(own)
        vocabulary = own.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.once: set[str] = set()

    @cached_property
    def whole(self):
        """The tokenizer as it is, with a memory of its own."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def alone(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        self.once -= words
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:  # what is at hand stays, and what was used again if that is not too much
            stay = self.known.keys() - self.once
            self.known = {w: self.known[w] for w in (stay | words if len(stay) < REMEMBERED - len(words) else words) if w in self.known}
            self.once = set(self.known)
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
            else:  # some word isn't one to the tokenizer
                self.known.update((w, self.alone(w)) for w in part)
        self.once.update(new)


@cache
def _words(path: str) -> Words:
    return Words(path)


def encoded(texts: list[str], words: Words) -> list[bytes]:
    """The ids of whole texts, equal to the tokenizer's own: it lower-cases composed text and encodes word by word.
    Texts that may hold its special tokens, or letters beyond those tested, go to it whole."""
    whole, split = {}, []
    for k, text in enumerate(texts):
        if "<|" in text or any(c in text for c in ODD_SPACE) or not text.isascii() and OTHER.search(text):
            whole[k] = words.alone(text)
            split.append([])
            continue
        if not text.isascii() and not is_normalized("NFC", text):
            text = normalize("NFC", text)
        split.append(WORDS.findall(text.lower()))
    words.learn(set().union(*split))
    get = words.known.__getitem__
    return [whole[k] if k in whole else b"".join(map(get, x)) for k, x in enumerate(split)]


def _pieces(path: str, limit: int, end: int):
    last = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded([x or "" for x in part.column("text").to_pylist()], words), strict=True):
                    ids += last
                    n = len(ids) // 4
                    out += [(doc, a, min(limit, n - a), zlib.crc32(ids[4 * a : 4 * (a + limit)]), n) for a in range(0, n, limit)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, tokenizer: str, limit: int = TOKENS, end: int = END) -> DataFrame:
    """Each row of docs (doc_id, text) in pieces of `limit` tokens and a rest: doc_id, start, length, ids_crc32,
    doc_tokens. Token ids stay on the task that makes them."""
    batches_held(docs.sparkSession)
    return documents_of(docs, "doc_id", "text").mapInArrow(giving_back(_pieces(tokenizer, limit, end)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def packed_group(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item (rows of demand: one number for each limit). A bin is filled by the item, of those that
    fit, whose demand has the largest dot product with the room left, both as parts of the limits; ties go to the
    first. A new bin opens when nothing fits. Items with equal demands are one kind, so a step takes time in the kinds."""
    if (demand > limits).any():
        raise ValueError("an item is over a limit")
    kinds, kind = np.unique(demand, axis=0, return_inverse=True) if len(demand) else (demand, np.zeros(0, int))
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    count = np.bincount(kind, minlength=len(kinds))
    head, end = np.cumsum(count) - count, np.cumsum(count)  # each kind's items are order[head:end], the first first
    bins, size = np.full(len(demand), -1), [np.ascontiguousarray(c) for c in (kinds / limits).T]
    room, now, left = [1.0 + 1e-12] * len(size), 0, len(demand)
    value, fits = np.empty(len(kinds)), np.empty(len(kinds), bool)
    while left:
        np.less_equal(size[0], room[0], out=fits)
        np.multiply(size[0], room[0], out=value)  # infinite for what is used up, which doesn't fit
        for c, r in zip(size[1:], room[1:], strict=True):
            fits &= c <= r
            value += c * r
        value[~fits] = -1.0
        k = int(value.argmax())
        if not fits[k]:
            now, room = now + 1, [1.0 + 1e-12] * len(size)
            continue
        ties = np.flatnonzero(value == value[k])
        if len(ties) > 1:
            k = int(ties[order[head[ties]].argmin()])
        bins[order[head[k]]] = now
        head[k] += 1
        left -= 1
        room = [r - float(c[k]) for c, r in zip(size, room, strict=True)]
        if head[k] == end[k]:
            size[0][k] = np.inf
            head[k] -= 1  # a place to look at for ties, which it can't be part of
    return bins


def _packed(limits: np.ndarray, names: list[str], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["pack"]):
            demand = np.stack([group.column(c).to_numpy().astype(float) for c in names], axis=1)
            bins = packed_group(demand, limits)
            order = np.argsort(bins, kind="stable")
            length = demand[order, 0].astype(np.int64)
            b = bins[order]
            before = np.cumsum(length) - length
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            offset = before - np.repeat(before[first], np.diff(np.r_[first, len(b)]))
            table = group.select(carried).take(pa.array(order)).combine_chunks().to_batches()[0]
            sequence = group.column("pack")[0].as_py() * (1 << 32) + b.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*carried, "sequence_id", "offset"])

    return run


def packed(items: DataFrame, limits: dict[str, int], key: list[str], group: int = GROUP) -> DataFrame:
    """items with sequence_id and offset: items share a sequence so that the sums of the columns in `limits` (longs, the
    first is the length) stay within its limits. Items of exactly the first limit, or above no limit alone, each fit.
    Items are dealt into groups of about `group` by the hash of their key (longs), and each group is packed by itself;
    so a group has a few sequences that aren't full; it holds enough items for FILLED full ones at least. An item over a
    limit raises an error."""
    names = list(limits)
    items = cut(items)
    there = items.agg(F.count("*").alias("n"), *(F.sum(n).alias(f"s_{n}") for n in names)).first()
    filled = max((there[f"s_{n}"] or 0) // most for n, most in limits.items())
    groups = max(1, min(-(-there["n"] // group), filled // FILLED))
    carried = items.columns
    dealt = items.withColumn("pack", F.pmod(F.xxhash64(*key), F.lit(groups))).repartition("pack").sortWithinPartitions("pack", *key)
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    return dealt.mapInArrow(giving_back(_packed(np.array([limits[n] for n in names], float), names, carried)), schema)


@tidy
def packed_documents(docs: DataFrame, tokenizer: str, limit: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end: int = END) -> DataFrame:
    """Documents (doc_id, text) as sequences of at most `limit` tokens, `segments` pieces and `loss` loss-bearing tokens
    (all but the first of a document, which nothing predicts).

    A document is cut into pieces of `limit` tokens, each a full sequence, and a rest, which is packed with others.
    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset. A null or
    empty text is one piece of the end id alone. Rows that repeat a doc_id are documents of their own; ties in the packing
    go to the smaller doc_id and start, those with equal ones are alike; other columns are ignored; an empty table gives
    no rows.
    """
    made = pieces(docs, tokenizer, limit, end).withColumn("loss_tokens", F.col("length") - (F.col("start") == 0).cast("long")).withColumn("segments", F.lit(1).cast("long"))
    out = packed(made, {"length": limit, "segments": segments, "loss_tokens": loss}, ["doc_id", "start"])
    return out.drop("segments")


def _counted_turns(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            n = [len(x) // 4 + 1 for k in range(0, batch.num_rows, 256) for x in encoded([t or "" for t in batch.column("text").slice(k, 256).to_pylist()], words)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role")] + [pa.array(n, pa.int64())], ["conv_id", "turn", "role", "n"])

    return run


@tidy
def packed_conversations(conversations: DataFrame, tokenizer: str, limit: int = TOKENS, segments: int = EXAMPLES, loss: int = ANSWER_TOKENS, answers: tuple[str, ...] = ANSWERS) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as sequences of at most `limit` tokens, `segments` examples and `loss`
    tokens of answers, all three at once.

    A conversation is its turns in order, each with an end id. One of more than `limit` or `loss` tokens is cut so that
    each piece fits alone. Returns a row per piece: conv_id, start, length, loss_tokens, sequence_id, offset. A null text
    counts as empty, a null role bears no loss, rows with a null conv_id are one conversation. Turns that repeat are turns
    of their own, in the order of their role and length; other columns are ignored; an empty table gives no rows.
    """
    batches_held(conversations.sparkSession)
    turns = documents_of(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    counted = turns.mapInArrow(giving_back(_counted_turns(tokenizer)), "conv_id long, turn long, role string, n long")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    size = min(limit, loss)
    cuts = placed.withColumn("piece", F.explode(F.expr(f"sequence(at div {size}, (at + n - 1) div {size})")))
    part = F.least(F.col("at") + F.col("n"), (F.col("piece") + 1) * size) - F.greatest(F.col("at"), F.col("piece") * size)
    bears = F.coalesce(F.col("role").isin(*answers), F.lit(False))
    items = cuts.withColumn("part", part).groupBy("conv_id", (F.col("piece") * size).alias("start")).agg(F.sum("part").alias("length"), F.sum(F.when(bears, F.col("part")).otherwise(0)).alias("loss_tokens"))
    out = packed(items.withColumn("segments", F.lit(1).cast("long")), {"length": limit, "segments": segments, "loss_tokens": loss}, ["conv_id", "start"])
    return out.drop("segments")
