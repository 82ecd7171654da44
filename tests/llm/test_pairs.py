"""Pairs of small groups, compared many at once, against sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from territoria.llm import common, line_dedup, minhash, ngram_join


def texts_of(plan, r):
    out, blank = [], " " if plan.unit == "words" else ""
    for _ in range(60):
        base = [r.choice("abcdefgh") + ("" if plan.unit == "chars" else str(r.randrange(90))) for _ in range(r.choice([1, 3, 9, 40, 300]))]
        for changes in (0, 1, 2):
            copy = list(base)
            for _ in range(changes):
                copy[r.randrange(len(copy))] = "x"
            out.append(blank.join(copy))
    return out


@pytest.mark.parametrize("plan", [line_dedup.PLAN, ngram_join.PLAN])
def test_pairs_are_compared_where_they_first_meet(plan, monkeypatch):
    r = random.Random(3)
    texts = texts_of(plan, r)
    monkeypatch.setattr(minhash, "PAIRED", 5000)  # several steps
    i, j = (np.arange(0, len(texts), 3), np.arange(1, len(texts), 3))
    i, j = np.concatenate([i, i]), np.concatenate([j, j + 1])
    own = [sorted(r.sample(range(6), 3)) for _ in texts]
    rows = pa.table({"g": pa.array([3] * len(texts)), "own": pa.array(own, pa.list_(pa.int64())), "text": texts})
    sets = [set(minhash.shingles([x], plan)[0].tolist()) for x in texts]
    met = [all(x >= 3 for x in set(own[a]) & set(own[b])) for a, b in zip(i, j, strict=True)]
    near = [len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)]
    seen, compare = [], minhash.similar_pairs
    monkeypatch.setattr(minhash, "similar_pairs", lambda texts, i, j, plan: seen.append(len(i)) or compare(texts, i, j, plan))
    assert minhash._linked_pairs(rows, i, j, plan).tolist() == [a and b for a, b in zip(met, near, strict=True)]
    assert sum(seen) == sum(met) < len(i) and len(seen) > 1 and 0 < sum(near) < len(near)


@pytest.mark.parametrize("size", [1, 3, 7, 600])
def test_groups_come_whole(size):
    r = random.Random(4)
    keys = sorted((r.randrange(9), r.randrange(9)) for _ in range(500))
    table = pa.table({"a": [x for x, _ in keys], "b": [x for _, x in keys]})
    seen = []
    for part, edges in common.whole_groups(iter(table.to_batches(size)), ["a", "b"]):
        seen += [part.slice(x, y - x).to_pylist() for x, y in zip(edges, edges[1:], strict=False)]
    assert [(g[0]["a"], g[0]["b"]) for g in seen] == sorted(set(keys)) and all(x == g[0] for g in seen for x in g) and sum(map(len, seen)) == 500


def test_groups_of_several_sizes_are_linked_alike(spark, monkeypatch):
    """Small groups, in pairs, have the links that the same groups have as matrices."""
    r = random.Random(5)
    rows, n = [], 0
    for g in range(60):
        base = "".join(r.choice("abcdefgh ") for _ in range(80))
        for _ in range(r.choice([1, 2, 3, 5, 9, 16, 17])):
            text = base if r.random() < 0.3 else base[:30] + r.choice("xyz") * r.choice([1, 9, 40]) + base[30:]
            rows.append((g, 0, 0, 0, n, r.choice([1, 4]), text, [g]))
            n += 1
    blocks = spark.createDataFrame(rows, "g long, bi long, bj long, side long, id long, w long, text string, own array<long>")
    linked = lambda left, right: minhash._linked(left, right, line_dedup.PLAN)
    paired = lambda rows, i, j: minhash._linked_pairs(rows, i, j, line_dedup.PLAN)
    found = lambda: sorted(map(tuple, minhash.compared(blocks, ["text", "own"], linked, paired).collect()))
    now = found()
    sets = [set(minhash.shingles([x[6]], line_dedup.PLAN)[0].tolist()) for x in rows]
    links = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] != b[4] and len(sets[a[4]] & sets[b[4]]) >= 0.8 * len(sets[a[4]] | sets[b[4]]):
                links[a[4]] = links.get(a[4], 0) + b[5]
    assert {x[1]: x[2] for x in now} == links and now
