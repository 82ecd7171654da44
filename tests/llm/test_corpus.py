"""Alignment of tokenizers, repeats by suffix arrays and divergence of sources against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_links import ODD, clashing
from territoria.llm import alignment, divergence, queries, suffixes

DIR = "/root/testdata/sf0.001"
PATHS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


# alignment


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(*PATHS)


def both(text, t):
    """The tokens of the whole text by either tokenizer, none where bytes differ."""
    if not text:
        return [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    data = (" " + text).encode()
    return (a, b) if b"".join(t.a_bytes[k] for k in a) == data == b"".join(t.b_bytes[k] for k in b) else ([], [])


def grouped(text, t):
    a, b = both(text, t)
    ends = [np.cumsum([len(of[k]) for k in x]).tolist() for of, x in ((t.a_bytes, a), (t.b_bytes, b))]
    out, since = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([k for k, e in zip(x, es, strict=True) if since < e <= cut] for x, es in zip((a, b), ends, strict=True)))
        since = cut
    return a, b, out


STRANGE = ["a  b\n\n  c", "x\x00y", "\n\t a", " lead", "trail  ", "one ", "\t", "<|endoftext|> <s> </s> x", "ﬁ é é", "a▁b", "a b c", "你好 世界\n再见", "\U0001f642\U0001f642 x", "l'été d'\x85", "don't 123 4,5", "  ", "aaaa" * 50, "'s 's", "a\r\n b", "　x", "}\r\n", "\x1c x\x1f", "=" * 3000]


def test_words_give_the_tokens_of_whole_texts(tokenizers):
    r = random.Random(4)
    parts = [" ", "\n", "\t", "a", "b", "the", " of", "é", "1", "2", "'s", ".", "!", "ß", "你", "\x1f", "\v", "\f", "\r", "ing", "  ", "\x00", "<s>", " "]
    texts = STRANGE + ["".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for again in range(2):
        a, b, n_a, n_b = tokenizers.tokens(texts)
        at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        for k, text in enumerate(texts):
            assert (a[at_a[k] : at_a[k] + n_a[k]].tolist(), b[at_b[k] : at_b[k] + n_b[k]].tolist()) == both(text, tokenizers), text
        if not again:
            tokenizers.forget()
    assert tokenizers.by_words


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment(spark, tokenizers, frequent):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, DIR, "documents").limit(60).collect()] + list(enumerate(STRANGE, 10_000)) + [(i, t if i != 905 else "x " * 500) for i, t in ODD]
    out = alignment.alignment(clashing(spark, rows), *PATHS, frequent=frequent, groups=True)
    got = sorted(out.collect(), key=str)
    every = [(i, *grouped(t, tokenizers)) for i, t in rows]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for _, _, _, groups in every]
    count = Counter(p for one in linked for p in one)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    wanted = []
    for (i, a, b, groups), links in zip(every, linked, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        wanted.append((i, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert out.columns == columns
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted(x for x in wanted if x[0] is not None)
    assert sorted(tuple(r)[1:] for r in got if r["doc_id"] is None) == sorted(x[1:] for x in wanted if x[0] is None)


def test_alignment_of_an_empty_table(spark):
    assert alignment.alignment(clashing(spark, ODD).limit(0), *PATHS).count() == 0
    nothing = alignment.alignment(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string"), *PATHS).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 4), min_size=1, max_size=9)), min_size=1, max_size=6), st.integers(1, 7))
def test_pairs_of_groups_are_counted_in_parts(groups, room):
    a, b = (np.array([k for g in groups for k in g[s]]) for s in (0, 1))
    a_group, b_group = (np.repeat(np.arange(len(groups)), [len(g[s]) for g in groups]) for s in (0, 1))
    owner = np.arange(len(groups)) // 2
    was, alignment.EXPANDED = alignment.EXPANDED, room
    try:
        doc, pair, n = alignment.linked_pairs(a, b, a_group, b_group, owner, (4, 5))
    finally:
        alignment.EXPANDED = was
    wanted = Counter((int(owner[k]), x * 5 + y) for k, g in enumerate(groups) for x in g[0] for y in g[1])
    assert dict(zip(zip(doc.tolist(), pair.tolist(), strict=True), n.tolist(), strict=True)) == wanted


# repeats


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.integers(1, 4), st.integers(3, 12))
def test_suffixes_are_in_order_and_repeats_are_found(part, times, length):
    t = (bytes(b % 4 if times > 2 else b for b in part) * times).replace(b"\0", b"\1")
    order = suffixes.suffix_array(np.frombuffer(t, np.uint8), length).tolist()
    assert sorted(order) == list(range(len(t)))
    assert [t[k : k + length] for k in order] == sorted(t[k : k + length] for k in range(len(t)))
    valid = np.arange(len(t)) + length <= len(t)
    seen = Counter(t[k : k + length] for k in range(len(t) - length + 1))
    assert suffixes.repeated_windows(np.frombuffer(t, np.uint8), valid, length).tolist() == [bool(v) and seen[t[k : k + length]] > 1 for k, v in enumerate(valid)]


def test_common_prefixes():
    t = b"abcdefghijkl" * 40 + b"abcdefgx" + b"abcdefghijkl" * 30
    words = suffixes._words(np.frombuffer(t, np.uint8), 200)
    left, right = np.array([0, 0, 1, 480, 12]), np.array([12, 480, 2, 0, 489])
    wanted = [min(200, next((k for k in range(200) if t[i + k : i + k + 1] != t[j + k : j + k + 1]), 200)) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
    assert suffixes.common_prefixes(words, left, right).tolist() == wanted


def repeats_by_hand(texts):
    """(n_bytes, spans, kept) of each text."""
    data, seen = [(t or "").encode() for t in texts], Counter()
    for d in data:
        seen.update(d[k : k + 200] for k in range(len(d) - 199))
    out = []
    for d in data:
        spans = []
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 200
                else:
                    spans.append([k, k + 200])
        edges = [0, *(x for s in spans for x in s), len(d)]
        out.append((len(d), [tuple(s) for s in spans], b"".join(d[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
    return out


def copied(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(4000)]
    made = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [made(k) for k in (30, 40, 41, 42, 60, 200)]
    texts = []
    for k in range(n):
        parts = [made(r.randrange(60)) for _ in range(3)]
        texts.append(r.choice(shared).join(parts) if k % 3 else " ".join(parts))
        if k % 10 == 0:
            texts.append(texts[-1])
    return [*texts, "ab" * 700, "z" * 199, "z" * 200, "q" * 201, "Sich " * 90, "tail " + "Sich " * 60, shared[5][7:], shared[4][:199], "=" * 9000, "=" * 5000 + made(50)]


def check_repeats(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.without_repeats(clashing(spark, rows)).collect()}
    for k, wanted in enumerate(repeats_by_hand(texts)):
        assert got[k] == wanted, (k, texts[k][:80])
    assert len(got) == len(rows)


def test_repeats(spark):
    check_repeats(spark, copied(1))


def test_many_windows_of_one_anchor(spark, monkeypatch):
    """Segments of one anchor that don't fit a task are dealt by longer ones, and in the end by whole windows."""
    r = random.Random(9)
    phrase = "a phrase of over thirty-two bytes, that is here and there and nowhere else"
    texts = [f"{' '.join(str(r.randrange(10**9)) for _ in range(30))} {phrase} {r.randrange(10**9)} {'and on and on it goes ' * (k % 4)}{' '.join(str(r.randrange(10**9)) for _ in range(30))}" for k in range(60)]
    texts += [texts[0][40:] + "x", texts[7][:-30], texts[7][100:]]
    monkeypatch.setattr(suffixes, "LARGE", 3000)
    levels, real = [], suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda t, level=0: levels.append(level) or real(t, level))
    check_repeats(spark, texts + copied(2, 20))
    assert levels == [0, 1, 2, 3]


def test_a_text_longer_than_a_slice(spark, monkeypatch):
    r = random.Random(3)
    long = " ".join(str(r.randrange(10**6)) for _ in range(180_000))  # over a million bytes
    at = suffixes.PART - 300
    texts = [long, "x" + long[at : at + 700], long[-250:], long[500_000:500_900] + long[at + 100 : at + 400]]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[1] == [(1, 701)] and got[2] == [(0, 250)] and got[3] == [(0, 900), (900, 1200)] or got[3] == [(0, 1200)]
    assert got[0] == [(500_000, 500_900), (at, at + 700), (len(long) - 250, len(long))]


def test_text_that_repeats_itself_is_dealt_once():
    """A row for each distinct segment of a text, however often it stands there, at all lengths of anchors."""
    line = bytes(np.random.default_rng(5).integers(97, 123, 100, dtype=np.uint8))
    texts, copies = [line * 40, b"x" * 150 + line * 3 + b"y" * 150], [1, 2]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([9, 10]), pa.array(texts, pa.binary()), pa.array(copies)], ["a", "b", "data", "w"])
    for width in suffixes.ANCHORS:
        rows = pa.Table.from_batches(suffixes._cut_out(width)(iter([batch]))).to_pylist()
        assert len({(r["a"], r["seg"]) for r in rows}) == len(rows)
        for a, text, n in zip((7, 8), texts, copies, strict=True):
            own = [r for r in rows if r["a"] == a]
            assert all(text[s : s + len(r["seg"])] == r["seg"] for r in own for s in r["s"]) and all(r["w"] == n * len(r["s"]) for r in own)
            assert sorted(s + k for r in own for s in r["s"] for k in range(len(r["seg"]) - suffixes.LENGTH + 1)) == list(range(len(text) - suffixes.LENGTH + 1))
    assert sum(r["a"] == 7 for r in rows) == 100  # windows of 200 bytes: 3,801, of which 100 differ


def test_repeats_odd_rows(spark):
    got = Counter((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffixes.without_repeats(clashing(spark, ODD)).collect())
    assert got[(905, 100_000, 0)] == 2 and got[(None, 0, 0)] == 1 and got[(None, 7, 7)] == 1 and got[(900, 0, 0)] == 1 and sum(got.values()) == len(ODD)
    assert suffixes.without_repeats(clashing(spark, ODD).limit(0)).count() == 0


# divergence


def divergence_by_hand(rows, least, top):
    """(lang, source, part, item, value, rank) from (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r, ts in zip(rows, terms, strict=True) if r[0] == lang for t in set(ts))
        kept = [t for t, n in docs.items() if n >= least]
        counts = defaultdict(Counter)
        for r, ts in zip(rows, terms, strict=True):
            if r[0] == lang:
                counts[r[1]].update(t for t in ts if docs[t] >= least)
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        gap = lambda x, y: (x - y) ** 2 // (x + y)
        q, of = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        for s, c in counts.items():
            found = {"pair": [(sum(gap(of[s][t], of[o][t]) for t in kept), o) for o in counts if o != s], "term": [(gap(of[s][t], q[t]), t) for t in kept if c[t] and of[s][t] > q[t]]}
            for part, items in found.items():
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("terms,sources", [(512, 64), (5, 3)])
def test_divergence(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    r = random.Random(6)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Été", "éTé", "\U0001f642", "Ａ", "don't", "x1y_z"]
    rows = [(r.choice(["en", "de", None]), f"s{r.randrange(11)}", " ".join(r.choices(words, k=r.randrange(40)))) for _ in range(400)]
    rows += [("en", "none", None), ("en", None, ""), ("fr", "only", "not enough of it"), ("fr", "two", "1 2 3"), ("es", "alone", "uno")] + [("en", "hot", "wa WB wc")] * 200
    docs = spark.createDataFrame([(*x, "n", 1) for x in rows], "lang string, source string, text string, term string, n long").repartition(7)
    got = sorted(tuple(x) for x in divergence.divergence(docs, 10, 4).collect())
    assert got == divergence_by_hand(rows, 10, 4) and {x[2] for x in got} == {"pair", "term"}
    assert ("fr", "only", "pair", "two", 0, 1) in got and not any(x[0] == "es" for x in got)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_frequencies_of_large_counts_are_exact():
    count, total = np.array([0, 2, 10**13 + 7, 4 * 10**14]), np.array([5, 2, 3 * 10**13 + 1, 9 * 10**14 + 11])
    assert divergence.parts_of_whole(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]


def test_a_long_text_is_split_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "PART", 7)
    text = "One, twoé THREE four5five " * 9
    assert Counter(x for part in divergence._terms(text.encode()) for x in part) == Counter(b.encode() for b in "one twoé three four five".split() * 9)


def test_operators_leave_no_table_that_their_result_does_not_read(spark):
    from territoria.llm import common, exact_dedup, line_dedup, mixing, ngram_join, packing, pii, toxicity, vector_links
    from pathlib import Path

    folder = Path(common.shared_folder(spark).removeprefix("file://")) / "territoria"
    there = lambda: {x.name for x in folder.iterdir()} if folder.exists() else set()
    docs = clashing(spark, [(k, f"line {k % 3} of some words\nanother line {k}") for k in range(40)] + ODD)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    vectors = spark.createDataFrame([(k, k % 2, [1.0, float(k)]) for k in range(6)], "vec_id long, label int, embedding array<float>")
    ops = [lambda: mixing.mixed_sources(docs), lambda: mixing.repeated(docs), lambda: line_dedup.line_components(docs), lambda: line_dedup.without_repeated_lines(docs), lambda: pii.personal_data(docs), lambda: exact_dedup.exact_duplicates(docs), lambda: ngram_join.ngram_links(docs), lambda: ngram_join.representatives(docs), lambda: packing.packed_documents(docs, queries.tokenizer()), lambda: alignment.alignment(docs, *PATHS), lambda: suffixes.without_repeats(docs), lambda: divergence.divergence(docs, 1), lambda: vector_links.near_vectors(vectors, least=0.98)]
    for op in ops:
        before = there()
        out = op()
        left = there() - before
        assert left <= common._read_by(out)
        out.count()  # all that it reads is there
        for part in [out]:
            common.dropped(part)
        assert not {x for x in there() - before if any((folder / x).glob("part-*"))}
    before = there()
    toxicity.train(docs, labels)
    assert there() == before


def test_ids_of_any_integer_type(spark):
    """All operators on documents with 32-bit ids, and pages with such."""
    from territoria.llm import exact_dedup, html_extract, line_dedup, mixing, ngram_join, packing, pii, sharding, toxicity, vector_links

    docs = clashing(spark, [(k, f"line {k % 3}\nanother line") for k in range(6)]).withColumn("doc_id", F.col("doc_id").cast("int"))
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    for out in (mixing.mixed_sources(docs), mixing.repeated(docs), toxicity.toxicity(docs, model), toxicity.clean_documents(docs, model), sharding.placed(docs, ["a", "b"]), line_dedup.line_components(docs), line_dedup.without_repeated_lines(docs), pii.personal_data(docs), exact_dedup.exact_duplicates(docs), ngram_join.ngram_links(docs), ngram_join.representatives(docs), packing.packed_documents(docs, queries.tokenizer()), alignment.alignment(docs, *PATHS), suffixes.without_repeats(docs), divergence.divergence(docs, 1)):
        assert out.count() >= 0 and out.columns
    assert html_extract.extracted_text(spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id int, url string, html string")).first()["text"] == "x"
    vectors = spark.createDataFrame([(k, k % 2, [1.0, float(k)]) for k in range(6)], "vec_id int, label int, embedding array<float>")
    assert vector_links.near_vectors(vectors, least=0.98).count() == 6
