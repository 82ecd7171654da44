"""Two tokenizers' tokens of the same texts, aligned by the bytes where both end a token."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, tidy

#: Words that a worker remembers, by number and by characters.
REMEMBERED, CHARACTERS = 400_000, 1 << 25
#: Links that are expanded at once; different pairs that a task counts before it sends them; parts of a pair's first sum.
EXPANDED, GATHERED, SALTS = 1 << 21, 1 << 21, 16
#: Pairs that are sent to every worker with their counts, the most frequent ones; all others are joined.
FREQUENT = 1 << 18

#: White space but for five signs of ASCII, and the sign by which tokenizer B writes a space. Texts with any go to both
#: tokenizers whole; in others no token of either reaches from a character to white space after it.
ODD = re.compile("[\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
WORDS = re.compile("[ \t\n\v\f]*[^ \t\n\v\f]+|[ \t\n\v\f]+$")
#: What a vocabulary must not hold if texts are to be encoded word by word.
REACHING = re.compile("[^\u2581 \t\n\v\f][\u2581 \t\n\v\f]|[\u2581 ][\t\n\v\f]")


def _bytes_of_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1 ... (counts[0] of them), then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def summed(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


class _Numbers(dict):
    """Gives each new word the next number."""

    def __init__(self, waiting: list[str]):
        self.waiting = waiting

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.waiting)
        self.waiting.append(word)
        return number


class Tokenizers:
    """Both tokenizers, and the bytes of each id. Words that were encoded before are numbered; their tokens stand in a row."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = _bytes_of_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for word, k in vocabulary.items():
            self.a_bytes[k] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("\u2581", " ").encode() for p in pieces]
        self.space = pieces.index("\u2581")
        self.by_words = not any(map(REACHING.search, pieces))
        self.sizes = [np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes)]
        self.forget()

    def forget(self) -> None:
        self.waiting: list[str] = []  # words and whole texts, by number; emptied of those that are encoded
        self.known, self.encoded = _Numbers(self.waiting), 0
        self.characters = 0
        self.ids, self.ends, self.good = [array("q"), array("q")], [array("q", [0]), array("q", [0])], bytearray()

    def encode(self) -> None:
        """Encodes the words that are waiting. B adds a space before what it gets: a word that begins with one gives it up
        for that, and of any other, which begins with other white space, the space is a token of its own and is dropped."""
        for k in range(self.encoded, len(self.waiting), 4096):
            words = self.waiting[k : k + 4096]
            by_a = [x.ids for x in self.a.encode_batch_fast(words, add_special_tokens=False)]
            by_b = self.b.encode([x[1:] if x[0] == " " else x for x in words], num_threads=1)
            for word, a, b in zip(words, by_a, by_b, strict=True):
                b, data = [self.space] if word == " " else b if word[0] == " " else b[1:], word.encode()
                self.good.append(b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b)))
                for ids, ends, x in zip(self.ids, self.ends, (a, b), strict=True):
                    ids.extend(x)
                    ends.append(len(ids))
                self.characters += len(word)
            self.waiting[k : k + 4096] = [""] * len(words)
        self.encoded = len(self.waiting)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's ids of a space and each text, in a row, and how many each text has: none where bytes differ."""
        if self.encoded > REMEMBERED or self.characters > CHARACTERS:
            self.forget()
        numbers, count, known = array("q"), np.zeros(len(texts), np.int64), self.known.__getitem__
        for k, text in enumerate(texts):
            if text:
                text = " " + text
                before = len(numbers)
                if self.by_words and not (ODD.search(text) if not text.isascii() or not text.isprintable() else None):
                    numbers.extend(map(known, WORDS.findall(text)))
                else:
                    numbers.append(len(self.waiting))
                    self.waiting.append(text)
                count[k] = len(numbers) - before
        self.encode()
        numbers = np.frombuffer(numbers, np.int64)
        owner = np.repeat(np.arange(len(texts)), count)
        bad = np.zeros(len(texts), bool)
        bad[owner[np.frombuffer(bytes(self.good), np.uint8)[numbers] == 0]] = True
        numbers, owner = numbers[~bad[owner]], owner[~bad[owner]]
        out = []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
            size = ends[numbers + 1] - ends[numbers]
            out += [ids[ragged(ends[numbers], size)], summed(owner, size, len(texts))]
        return out[0], out[2], out[1], out[3]


@cache
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _collapsed(key: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and how often, or with what weight in sum, each is there."""
    if weight is None or len(weight) and weight.max() == 1:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(first) else np.zeros(0, np.int64)


def linked_pairs(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, group_doc: np.ndarray, kinds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the different pairs of ids that groups link in each document; a pair is the number
    a * kinds[1] + b. Equal ids of a group are one row each before links are expanded, some at a time."""
    groups = len(group_doc)
    a_key, a_times = _collapsed(a_group * kinds[0] + a, None)
    b_key, b_times = _collapsed(b_group * kinds[1] + b, None)
    g, b_many = a_key // kinds[0], np.bincount(b_key // kinds[1], minlength=groups)
    b_first = np.cumsum(b_many) - b_many
    size = b_many[g]
    row = group_doc[g] * kinds[0] + a_key % kinds[0]
    ends, at, keys, times = np.cumsum(size), 0, [], []
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
        part = slice(at, to)
        other = ragged(b_first[g[part]], size[part])
        one = np.repeat(np.arange(at, to), size[part])
        key, n = _collapsed(row[one] * kinds[1] + b_key[other] % kinds[1], a_times[one] * b_times[other])
        keys.append(key)
        times.append(n)
        at = to
        if sum(map(len, keys)) > 4 * EXPANDED and len(keys) > 1:
            key, n = _collapsed(np.concatenate(keys), np.concatenate(times))
            keys, times = [key], [n]
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, n = _collapsed(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0])
    pairs = kinds[0] * kinds[1]
    return key // pairs, key % pairs, n


def written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3` of all groups as bytes, with a last sign after each group, and where each group begins."""
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    group = np.concatenate([a_group, b_group])
    order = np.argsort(group, kind="stable")  # a group's A tokens come before its B tokens
    ids, group, by_b = np.concatenate([a, b])[order], group[order], (order >= len(a))
    same = np.r_[(group[1:] == group[:-1]), False]
    sign = np.where(~same, ord(";"), np.where(by_b == np.r_[by_b[1:], True], ord(","), ord("|"))).astype(np.uint8)
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = sign
    rest = ids
    for k in range(int(digits.max()) if len(digits) else 0):
        has = digits > k
        out[ends[has] - 2 - k] = 48 + rest[has] % 10
        rest = rest // 10
    first = np.searchsorted(group, np.arange(groups))
    return out, (ends - digits - 1)[first], ends


def aligned(texts: list[str | None], tokenizers: Tokenizers) -> tuple[dict[str, np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text the numbers of A tokens, B tokens, groups and links; its groups in writing; and the pairs of all."""
    docs = len(texts)
    a, b, n_a, n_b = tokenizers.tokens(texts)
    a_end, b_end = (np.cumsum(s[x]) for s, x in zip(tokenizers.sizes, (a, b), strict=True))
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)  # a text's end is one, so groups never cross texts
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    in_a, in_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    group_doc = np.repeat(np.arange(docs), n_a)[np.cumsum(in_a) - in_a] if len(cuts) else np.zeros(0, np.int64)
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_doc, minlength=docs), "n_links": summed(group_doc, in_a * in_b, docs)}
    text, begin, ends = written(a, b, a_group, b_group)
    raw = text.tobytes()
    edge = np.r_[begin, len(raw)]
    last = np.cumsum(counts["n_groups"])
    groups = [raw[edge[x] : edge[y] - 1].decode() if y > x else "" for x, y in zip((last - counts["n_groups"]).tolist(), last.tolist(), strict=True)]
    return counts, groups, linked_pairs(a, b, a_group, b_group, group_doc, tuple(len(x) for x in tokenizers.sizes))


#: Columns of what is known of a document without the others.
_OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _encoded(a_path: str, b_path: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(a_path, b_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, groups, (doc, pair, times) = aligned(part.column("text").to_pylist(), tokenizers)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                pair, times = pair.astype("<i8"), times.astype("<i8")
                lists = [pa.array([x[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary()) for x in (pair, times)]
                shown = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[c], pa.int64()) for c in _OWN[1:]), pa.array(shown), *([pa.array(groups)] if whole else []), *lists], [*_OWN, "groups_sha256", *(["groups"] if whole else []), "pairs", "times"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many of a task's documents each pair is."""
    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        got = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), "<i8")
        pair, n = _collapsed(np.concatenate([pair, got]), np.concatenate([n, np.ones(len(got), np.int64)]))
        if len(pair) > GATHERED:
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
            pair, n = pair[:0], n[:0]
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])


def _weighed(frequent, kept: list[str]):
    """Adds a document's links of frequent pairs up, and lists its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = frequent.value
        for batch in batches:
            raw = batch.column("pairs").to_pylist()
            pair, times = np.frombuffer(b"".join(raw), "<i8"), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i8")
            owner = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            at, hit = at[known], owner[known]
            sums = [summed(hit, times[known] * x[at], len(raw)) for x in (best, counts)]
            size = np.bincount(owner[~known], minlength=len(raw))
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            others = [pa.ListArray.from_arrays(offsets, pa.array(x[~known], pa.int64())) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x) for x in sums), *others], [*kept, "n_best", "count_sum", "pairs", "times"])

    return run


@tidy
def alignment(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, groups: bool = False) -> DataFrame:
    """Documents (doc_id, text; other columns are ignored) by two tokenizers: a byte-level one (a file of `tokenizers`) and
    one of pieces (a file of `sentencepiece`) with fallback to bytes.

    A row per row: doc_id; n_a, n_b, the tokens of a space and the text; n_groups, the runs between byte offsets where
    tokens of both end; n_links, the pairs of an A and a B token in one group; n_best, the links whose pair of ids is in as
    many documents as any pair of that A id; count_sum, the documents that hold a link's pair, added up over all links;
    groups_sha256 of the groups in writing, `a1,a2|b1;a3|b2,b3`, which `groups` adds as a column. Null and empty texts, and
    those whose bytes the tokens of either don't give back, have no tokens. Special tokens in a text are plain text. Rows
    that repeat are documents each; ties for the best pair all count; an empty table gives no rows.

    A text is encoded once, word by word; only its different pairs and their numbers are written. Pairs are counted in two
    stages, salted first. The most frequent pairs, at most `frequent`, go to every worker; a document's others are joined
    with their counts, and these are in few documents each.
    """
    spark = docs.sparkSession
    batches_held(spark)
    tokenizers = _tokenizers(a_path, b_path)
    kinds = len(tokenizers.sizes[1])
    shown = ["groups_sha256", *(["groups"] if groups else [])]
    schema = ", ".join([f"{c} long" for c in _OWN] + [f"{c} string" for c in shown] + ["pairs binary", "times binary"])
    own = cut(documents_of(docs, "doc_id", "text").mapInArrow(_encoded(a_path, b_path, groups), schema).withColumn("rid", F.monotonically_increasing_id()))
    sent = own.select("pairs").mapInArrow(_counted, "pair long, n long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    counts = cut(sent.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {kinds}")))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # a row for each id of A
    counts = cut(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))
    level = F.floor(F.log2("n") * 8).cast("int")
    edge, total = 1 << 30, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 8 rows for each power of two
        total += row["count"]
        if total > frequent:
            break
        edge = row["level"]
    common = sorted(tuple(x) for x in counts.where(level >= edge).collect())  # at most `frequent` rows
    table = spark.sparkContext.broadcast([np.array([x[k] for x in common], np.int64) for k in range(3)])
    kept = ["rid", *_OWN, *shown]
    kinds_of = ", ".join(f"{c} {t}" for c, t in own.select(*kept).dtypes)
    weighed = cut(own.mapInArrow(_weighed(table, kept), f"{kinds_of}, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rare = weighed.where(F.size("pairs") > 0).select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(level < edge), "pair").groupBy("rid").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = weighed.drop("pairs", "times").join(rare, "rid", "left")
    add = lambda c, more: (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)
    return out.select(*_OWN, add("n_best", "more_best"), add("count_sum", "more_sum"), *shown)
