"""Operators on pairs against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from territoria.llm import exact_dedup, line_dedup, ngram_join, vector_links
from territoria.llm.components import connected_components
from territoria.llm.exact_dedup import chunk_hash, combined

CLASH = "doc_id long, text string, source string, n_chars long, h1 string, t string, row string, w string, id string, size string, gone string"


def clashing(spark, rows):
    """Documents (doc_id, text) with other columns, whose names operators might use."""
    return spark.createDataFrame([(i, t, "s", len(t or ""), *(f"{c}{i}" for c in ("h1", "t", "row", "w", "id", "size", "gone"))) for i, t in rows], CLASH)


def near_copies(seed, n=12):
    r = random.Random(seed)
    rows, words = [], [f"w{k}" for k in range(3000)]
    for k in range(n):
        base = [r.choice(words) for _ in range(r.choice([3, 30, 120, 400]))]
        for j in range(r.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(j):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k * 10 + j, " ".join(copy)))
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "x " * 50_000), (905, "x " * 50_000), (None, "one two"), (None, None), (906, "é" * 3 + " ü\n\nline"), (907, "one")]


def components(nodes, pairs):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_ngram_links(spark):
    rows = near_copies(1, 24) + [r for r in ODD if r[0] is not None]
    got = sorted((r["doc_id"], r["class_id"], r["class_size"], r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.ngram_links(clashing(spark, rows)).collect())
    sets, texts = [grams(t) for _, t in rows], [" ".join((t or "").lower().split()) for _, t in rows]
    linked = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    ids = [i for i, _ in rows]
    top = components(set(ids), [(ids[a], ids[b]) for a in linked for b in linked[a]])
    same = defaultdict(list)
    for k, t in enumerate(texts):
        same[t if t else k].append(ids[k])
    wanted = sorted((ids[k], min(same[texts[k] or k]), len(same[texts[k] or k]), len(linked[k]), top[ids[k]], ids[k] == top[ids[k]]) for k in range(len(rows)))
    assert got == wanted
    assert sum(x[3] > 0 for x in wanted) > 15


def test_representatives_keep_columns_and_clean_rows(spark):
    docs = clashing(spark, near_copies(2) + ODD)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert all(r["h1"] == f"h1{r['doc_id']}" and r["row"] == f"row{r['doc_id']}" for r in out)
    ids = [r["doc_id"] for r in out]
    assert {900, 901, 902, 903, 905, 906, 907, None} <= set(ids) and 904 not in ids and ids.count(905) == 1
    assert ngram_join.representatives(docs.limit(0)).count() == 0 and ngram_join.ngram_links(docs.limit(0)).count() == 0


def test_a_large_group_of_copies(spark):
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(base[:199] + [f"end{k % 300}"])) for k in range(900)]
    got = ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 900 and {r["n_links"] for r in got} == {899} and {r["component_id"] for r in got} == {0} and {r["class_size"] for r in got} == {3}


def test_lines(spark):
    r = random.Random(3)
    shared = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([5, 40, 90]))).strip() for _ in range(30)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(6):
            x = list(r.choice(shared)) if r.random() < 0.5 else [r.choice("ijklmnop") for _ in range(50)]
            if len(x) > 30 and r.random() < 0.4:
                x[r.randrange(len(x))] = "z"
            lines.append("".join(x))
        rows.append((k, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "UPPER short"), (904, " upper SHORT ")]
    got = {(x["doc_id"], x["line_no"]): x for x in line_dedup.line_components(clashing(spark, rows)).collect()}
    lines = {(i, n): x.strip(" ").lower() for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))}
    assert set(got) == set(lines)
    sets = {k: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for k, x in lines.items()}
    pairs = [(a, b) for a in lines for b in lines if a < b and lines[a] and lines[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    top = components(set(lines), pairs)
    found = {k: (x["component_doc"], x["component_line"]) for k, x in got.items()}
    assert all(top[k] == top[f] for k, f in found.items())  # nothing is joined that brute force keeps apart
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.98 * len(pairs) and len(pairs) > 100
    assert all(got[k]["kept"] for k, x in lines.items() if not x) and not got[904, 0]["kept"]


def test_lines_are_made_once(spark):
    """Lower case by whole texts gives each line what it has alone, and what reads lines doesn't make them again."""
    texts = ["ΑΣ\nΑΣΑ \n Σ\nΟΔΟΣ'\nΑ", "İI\r\nÉtÉ\u2028Σ\n\t x \n", "", "  ", "\n\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lines = line_dedup.lines_of(docs).where("norm <> ''").withColumn("h1", F.xxhash64("norm"))
    alone = spark.createDataFrame([(i, n, x) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))], "doc_id int, line_no int, line string")
    wanted = alone.select("doc_id", "line_no", F.lower(F.trim("line")).alias("norm")).where("norm <> ''")
    assert sorted((r["doc_id"], r["line_no"], r["norm"]) for r in lines.collect()) == sorted(tuple(r) for r in wanted.collect())
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_documents_without_repeated_lines(spark):
    rows = [(1, "a first line that is long enough\nown one"), (2, "A first line that is long enough\nown two\n\n"), (3, "a first line that is long enough"), (4, None), (5, ""), (6, "own six"), (6, "own six"), (7, "xyz\nxyz")]
    docs = clashing(spark, rows)
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"], r["t"]) for r in out.collect()), key=str)
    assert got == [(1, rows[0][1], len(rows[0][1]), "t1"), (2, "own two\n\n", 9, "t2"), (4, None, 0, "t4"), (5, "", 0, "t5"), (6, "own six", 7, "t6"), (6, "own six", 7, "t6"), (7, "xyz", 3, "t7")]
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0 and line_dedup.line_components(docs.limit(0)).count() == 0


def test_fingerprints_compose():
    r = random.Random(4)
    for _ in range(50):
        x = bytes(r.randrange(256) for _ in range(r.randrange(1, 300)))
        k = r.randrange(len(x) + 1)
        assert combined(chunk_hash(x[:k]), chunk_hash(x[k:]), len(x) - k) == chunk_hash(x)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_exact_duplicates(spark, chunk):
    rows = [(i, t) for i, t in ODD if i is not None] + [(1, "same text"), (2, "same text"), (3, "same texT"), (3, "same text"), (4, "y" * 200_000), (5, "y" * 200_000), (6, "y" * 199_999 + "z"), (7, "\0"), (8, "")]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(clashing(spark, rows if chunk > 7 else [x for x in rows if len(x[1] or "") < 1000]), chunk).drop("n_bytes").collect())
    import hashlib

    rows = rows if chunk > 7 else [x for x in rows if len(x[1] or "") < 1000]
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    assert got == sorted((i, max(same[t or ""]), len(same[t or ""]), i == max(same[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_equal_fingerprints_of_unequal_texts_are_told_apart(spark, monkeypatch):
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, c: real(d, c).withColumn("f1", F.lit(1).cast("long")).withColumn("f2", F.lit(1).cast("long")))
    rows = [(1, "aaa"), (2, "aab"), (3, "aaa"), (4, "baa"), (5, "aab"), (None, "baa")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(1, 3, 2), (3, 3, 2), (2, 5, 2), (5, 5, 2), (4, 4, 2), (None, 4, 2)}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = rng.standard_normal(16)
        for j in range(1 + k % 4):
            rows.append((k * 10 + j, (base + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 3))
    v = rows[5][1]
    rows += [(1000, v, rows[5][2]), (1001, [2 * x for x in v], rows[5][2]), (1002, v, None), (1003, None, 1), (1004, [0.0] * 16, 1), (1005, [float("nan"), *v[1:]], rows[5][2]), (1006, [None, *v[1:]], rows[5][2]), (1007, [float("inf"), *v[1:]], 1), (1008, [], 1), (1009, v[:8], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_links.near_vectors(spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, label int, component string")).collect()}
    good = [(i, np.array(e, float), c) for i, e, c in rows if c is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    pairs = [(i, j) for i, a, c in good for j, b, d in good if i != j and c == d and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    top, n = components({x[0] for x in rows}, pairs), defaultdict(int)
    for i, _ in pairs:
        n[i] += 1
    assert got == {i: (n[i], top[i], top[i] == i) for i, _, _ in rows} and len(pairs) > 20
    assert vector_links.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7)]
    got = {(x["id"], x["component"]) for x in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == set(components(nodes, [p for p in pairs if p[0] != p[1]]).items())


def test_touching_groups_of_vectors(spark):
    """Two groups of 50 whose lists hold members of their own group only, though thousands of links join the groups."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, side = unit(rng.standard_normal(64)), rng.standard_normal(64)
    side = unit(side - (side @ a) * a)
    b = 0.987 * a + np.sqrt(1 - 0.987**2) * side
    v = unit(np.concatenate([c + np.sqrt(0.006 / 64) * rng.standard_normal((50, 64)) for c in (a, b)])).astype(np.float32)
    u = unit(v.astype(np.float64))
    s = u @ u.T
    np.fill_diagonal(s, -2)
    nearest = np.argsort(-s, axis=1)[:, : vector_links.NEIGHBOURS]
    assert (nearest[:50] < 50).all() and (nearest[50:] >= 50).all() and (s[:50, 50:] >= 0.98).sum() > 1000
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_links.near_vectors(spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {k: (int(n), 0) for k, n in enumerate((s >= 0.98).sum(axis=1))}


def test_audit_counts_vectors_not_links(spark):
    """A group with most of the links is found whole, all pairs are missed: the audit must see it."""
    rng = np.random.default_rng(6)
    hot = np.eye(16)[0] + 0.001 * rng.standard_normal((600, 16))
    pairs = np.repeat(rng.standard_normal((100, 16)), 2, axis=0)
    rows = [(k, 7, 1, x.tolist()) for k, x in enumerate(np.concatenate([hot, pairs + 0.001 * rng.standard_normal(pairs.shape)]))]
    vectors = spark.createDataFrame(rows, "id long, space long, w long, vector array<float>")
    found = spark.createDataFrame([(k, 599, 0) for k in range(600)], "id long, n_links long, component long")
    assert vector_links._audit(vectors, found, 0.98) < 0.9


def exact_links(v, least):
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s >= least


@pytest.mark.parametrize("short", [False, True])
def test_a_large_label_of_vectors(spark, monkeypatch, short):
    """More vectors than leaves hold, so trees, descent and audit all work; and again with a graph that finds nothing,
    which the audit must see and the comparison of all must make good."""
    rng = np.random.default_rng(9)
    n = 700 if short else 3000
    centers = rng.standard_normal((n // 4, 24))
    v = (centers[rng.integers(0, len(centers), n)] + 0.1 * rng.standard_normal((n, 24))).astype(np.float32)
    if short:
        nothing = spark.createDataFrame([], "id long, component long")
        monkeypatch.setattr(vector_links, "_joined", lambda *a: nothing)
        monkeypatch.setattr(vector_links, "AUDITS", 1)
    hit = exact_links(v, 0.98)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_links.near_vectors(spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()}
    top = components(range(n), np.argwhere(hit).tolist())
    wanted = {k: (int(hit[k].sum()), top[k]) for k in range(n)}
    assert hit.sum() > n / 2
    if short:
        assert got == wanted
    else:
        assert sum(got[k] == wanted[k] for k in wanted) >= 0.99 * n and all(got[k][0] <= wanted[k][0] for k in wanted)


def test_vectors_at_the_threshold_in_doubles(spark):
    """A cosine of the threshold itself is a link, one that only double precision tells from it is none."""
    turned = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(1, [1.0, 0.0], 1), (2, turned(0.98 - 1e-10), 1), (3, [5.0, 0.0], 2), (4, [0.98 * 50, 50 * (1 - 0.98**2) ** 0.5 - 1e-9], 2), (5, [3.0, 4.0], 3), (6, [3.0, 4.0], 3), (6, [4.0, 3.0], 3)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_links.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 0, 6), (6, 1, 5)]


def test_similarity_of_exactly_the_threshold(spark):
    """Texts of 44 words have 40 shingles; with the last 4 of 9 times that replaced, pairs share 32 of 40 shingles."""
    rows, wanted = [], set()
    for k in range(150):
        base = [f"a{k}w{j}" for j in range(40)]  # 36 shingles
        rows += [(4 * k, " ".join(base)), (4 * k + 1, " ".join([*base[:36], *(f"b{k}w{j}" for j in range(4))])), (4 * k + 2, " ".join([*base[:35], *(f"c{k}w{j}" for j in range(5))]))]
        for a, b in ((0, 1), (0, 2), (1, 2)):
            x, y = grams(rows[3 * k + a][1]), grams(rows[3 * k + b][1])
            if len(x & y) >= 0.8 * len(x | y):
                wanted.add((4 * k + a, 4 * k + b))
    exact = [(10_000 + k, " ".join(f"e{k}w{j}" for j in (*range(36), *range(100 + 50 * s, 104 + 50 * s)))) for k in range(100) for s in (0,)]
    exact += [(20_000 + k, " ".join(f"e{k}w{j}" for j in range(40))) for k in range(100)]  # 32 of 40 shingles: 0.8
    shared = [len(grams(a[1]) & grams(b[1])) / len(grams(a[1]) | grams(b[1])) for a, b in zip(exact[:100], exact[100:], strict=True)]
    assert set(shared) == {0.8}
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.ngram_links(spark.createDataFrame(rows + exact, "doc_id long, text string")).collect()}
    assert sum(got[20_000 + k] == (1, 10_000 + k) for k in range(100)) >= 99
    n = defaultdict(int)
    for a, b in wanted:
        n[a] += 1
        n[b] += 1
    assert all(got[i][0] <= n[i] for i, _ in rows) and sum(got[i][0] for i, _ in rows) >= 0.999 * 2 * len(wanted)


def test_chains_are_joined_by_verified_links_only(spark):
    """Neighbours in a chain are similar, its ends aren't: links count neighbours, the component is the whole chain."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(120)]
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in ngram_join.ngram_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [grams(t) for _, t in rows]
    wanted = [sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(120)) for a in range(120)]
    assert sum(got[k][0] for k in range(120)) >= 0.99 * sum(wanted) and all(got[k][0] <= wanted[k] for k in range(120)) and {c for _, c in got.values()} == {0}


def test_very_many_dropped_lines_take_linear_time(spark):
    import time

    def took(n):
        text = "\n".join(("alpha beta gamma delta epsilon zeta", f"a line of its own, number {k} of them")[k % 50 == 0] for k in range(n))
        docs = spark.createDataFrame([(1, text), (2, "alpha beta gamma delta epsilon zeta\nsomething else altogether, and more")], "doc_id long, text string")
        began = time.time()
        out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(docs).collect()}
        assert out[2] == "something else altogether, and more" and out[1].count("alpha") == 1
        return time.time() - began

    took(1000)
    assert took(300_000) < 60
