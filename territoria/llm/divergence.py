"""How far the sources of a language are from each other, and by which words, from exact counts of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from territoria.llm.common import batches_held, cut, documents_of, runs, tidy

#: A term is kept by a language where it stands in at least so many of its documents; terms are listed to this rank.
DOCUMENTS, TOP = 10, 10
#: About so many terms, and sources of one side, are a tile; and the numbers that a tile's broadcast makes at once.
TERMS, SOURCES, NUMBERS = 512, 64, 1 << 19
#: Parts of a whole (10^9 is all) that frequencies are counted in.
WHOLE = 1_000_000_000
#: Counts that a task gathers before it sends them, and bytes of a text that are split at once.
GATHERED, PART = 300_000, 1 << 20

#: Letters of ASCII in lower case and all bytes beyond ASCII stay; any other byte ends a term.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed over as many rows as are gathered; the empty term stands for the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        keys = [(lang, source, len(n)) for (lang, source), (n, _) in held.items()]
        lengths = [k[2] for k in keys]
        repeated = [pa.array(np.repeat(np.array([k[j] for k in keys], object), lengths), pa.string()) for j in (0, 1)]
        terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
        counts = [pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()), pa.array([d[t] for n, d in held.values() for t in n], pa.int64())]
        return pa.RecordBatch.from_arrays([*repeated, terms, *counts], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            of: Counter = Counter()
            for words in _terms(text):
                of.update(words)
            n, docs = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before = len(n)
            n.update(of)
            docs.update(of.keys())
            size += len(n) - before + 1
            if size > GATHERED:
                yield sent()
                held, size = {}, 0
    if held:
        yield sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often each term stands in the documents of a group, and in how many of them.
    Each group has a row with the empty term, n 0."""
    batches_held(docs.sparkSession)
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    texts = documents_of(docs, "lang", "source", "text").select(*blank, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def parts_of_whole(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total) for counts up to totals below 10^15: long division by three digits at a time,
    since the product may exceed 64 bits."""
    total = np.maximum(total, 1)
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    d = p - q
    return d * d // (p + q)


def _best(found: list[tuple[int, str]], top: int) -> list[tuple[int, str]]:
    return sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top]


def _summed(top: int):
    """Tiles of (sources, terms) to partial sums over pairs of sources and to the best terms of each source; both are
    gathered over the tiles of a pair of source blocks that one task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, heaps, sides = None, None, {}, None

        def sent() -> pa.RecordBatch:
            left, right = sides
            i, j = (x.ravel() for x in np.indices(sums.shape))
            if now[1] == now[2]:
                i, j = i[i != j], j[i != j]
            value = sums[i, j]
            rows = [(a, b, v) for a, b, v in zip(i.tolist(), j.tolist(), value.tolist(), strict=True)]
            out = [("pair", left[a], right[b], v) for a, b, v in rows]
            if now[1] != now[2]:
                out += [("pair", right[b], left[a], v) for a, b, v in rows]
            out += [("term", left[a], item, v) for a, best in heaps.items() for v, item in best]
            part, source, item, value = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([now[0]] * len(out), pa.int64()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["part", "lid", "source", "item", "value"])

        for tile in runs(batches, ["lid", "gi", "gj", "tb"]):
            lid, gi, gj, tb = (tile.column(c)[0].as_py() for c in ("lid", "gi", "gj", "tb"))
            mark = tile.filter(pc.is_null(tile.column("term"))).sort_by([("side", "ascending"), ("source", "ascending")])
            names = [mark.filter(pc.equal(mark.column("side"), s)).column("source") for s in (0, 1)]
            if gi == gj:
                names[1] = names[0]
            if not len(names[0]) or not len(names[1]):
                continue
            if now != (lid, gi, gj):
                if now:
                    yield sent()
                now, heaps = (lid, gi, gj), {}
                sides = [x.to_pylist() for x in names]
                sums = np.zeros((len(sides[0]), len(sides[1])), np.int64)
            entries = tile.filter(pc.is_valid(tile.column("term")))
            coded = entries.column("term").combine_chunks().dictionary_encode()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            term, items = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            side, n, nl = (entries.column(c).to_numpy() for c in ("side", "n", "nl"))
            total, v = ({s: mark.filter(pc.equal(mark.column("side"), s)).column(c).to_numpy() for s in (0, 1)} for c in ("n", "v"))
            p, none = [], []
            for s in (0, 1) if gi != gj else (0,):
                row = pc.index_in(entries.column("source"), value_set=names[s].combine_chunks()).to_numpy(zero_copy_only=False)
                own = side == s
                count = np.zeros((len(names[s]), len(items)), np.int64)
                count[row[own].astype(np.int64), term[own]] = n[own]
                p.append(parts_of_whole(count + 2, total[s][:, None]))
                none.append(parts_of_whole(np.full(len(names[s]), 2), total[s]))
                if s == 0 and gi == gj and len(items):
                    every = np.zeros(len(items), np.int64)
                    every[term] = nl
                    q = parts_of_whole(every + 2, mark.column("nl").to_numpy()[:1])
                    value = np.where((count > 0) & (p[0] > q), gap(p[0], q), -1)
                    for k in range(len(value)):
                        good = np.flatnonzero(value[k] >= 0)
                        if len(good) > top:
                            good = good[value[k][good] >= np.partition(value[k][good], -top)[-top]]
                        heaps[k] = _best(heaps.get(k, []) + [(int(value[k, t]), items[t]) for t in good], top)
            a, b = p[0], p[-1]
            zero = gap(none[0][:, None], none[-1][None, :])
            step = max(1, NUMBERS // (len(a) * len(b)))
            for k in range(0, len(items), step):
                sums += gap(a[:, None, k : k + step], b[None, :, k : k + step]).sum(axis=2)
            # terms that stand in no source of either block have one value, counted here instead of in each tile
            sums += zero * ((int(v[0][0]) if tb == 0 else 0) - len(items))
        if now:
            yield sent()

    return run


@tidy
def divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """How the sources of each language differ (columns lang, source, text; others are ignored): lang, source, part, item,
    value, rank.

    Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII; a language keeps those in at least
    `least` of its documents. Frequencies are smoothed and counted in whole parts of 10^9, and the gap of two is
    floor((p - q)^2 / (p + q)). Part "pair" has each other source of the language with the sum of gaps over all kept terms,
    part "term" the `top` terms that are more frequent in the source than in the language. Ranks go by value, then by the
    item's UTF-8 bytes. Null lang, source and text count as empty, and a group whose documents have no term takes part
    like any other; rows that repeat count each; a language that keeps no term has pairs of value 0; a language of one
    source has no pairs; an empty table gives no rows.

    Counts are dealt as tiles: a hash block of terms for a pair of hash blocks of sources, so neither a frequent term, a
    large source nor a language with many terms or sources is one task's work. What tasks send is a row for each pair of
    sources (once for all of a task's tiles) and `top` rows for each source.
    """
    counts = cut(term_counts(docs))
    terms = counts.where("term <> ''")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("nl")).where(F.col("docs") >= least).drop("docs"))
    entries = cut(terms.drop("docs").join(kept, ["lang", "term"]))
    groups = counts.where("term = ''").select("lang", "source")
    words = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("nl").alias("all"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("s")).join(words, "lang", "left").na.fill(0, ["v", "all"])
    blocks = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("long")
    langs = cut(langs.select("lang", "v", "all", blocks("v", TERMS).alias("tbs"), blocks("s", SOURCES).alias("gbs"), F.monotonically_increasing_id().alias("lid")))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    mark = groups.join(sums, ["lang", "source"], "left").join(langs, "lang")
    mark = mark.select("lid", "gbs", "source", F.lit(None).cast("string").alias("term"), (F.coalesce("n", F.lit(0)) + 2 * F.col("v")).alias("n"), (F.col("all") + 2 * F.col("v")).alias("nl"), "v", F.explode(F.expr("sequence(0L, tbs - 1)")).alias("tb"))
    rows = entries.join(langs.select("lang", "lid", "tbs", "gbs"), "lang")
    rows = rows.select("lid", "gbs", "source", "term", "n", "nl", F.lit(0).cast("long").alias("v"), F.pmod(F.xxhash64("term", F.lit(3)), F.col("tbs")).alias("tb"))
    tiles = mark.unionByName(rows).withColumn("b", F.pmod(F.xxhash64("source"), F.col("gbs"))).withColumn("other", F.explode(F.expr("sequence(0L, gbs - 1)")))
    tiles = tiles.select("lid", F.least("b", "other").alias("gi"), F.greatest("b", "other").alias("gj"), "tb", (F.col("b") > F.col("other")).cast("long").alias("side"), "source", "term", "n", "nl", "v")
    tiles = tiles.repartition("lid", "gi", "gj", "tb").sortWithinPartitions("lid", "gi", "gj", "tb")
    found = tiles.mapInArrow(_summed(top), "part string, lid long, source string, item string, value long")
    found = found.groupBy("lid", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lid", "source", "part").orderBy(F.desc("value"), "item")
    ranked = found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.join(langs.select("lid", "lang"), "lid").select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""
with docs as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
words as (select lang, source, id, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from docs),
kept as (select lang, term, count(*) nl from words group by all having count(distinct id) >= {DOCUMENTS}),
langs as (select lang, count(*) v, sum(nl) nl from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select w.lang, w.source, w.term, count(*) n from words w join kept k using (lang, term) group by all),
totals as (select g.lang, g.source, coalesce(sum(n), 0) + 2 * coalesce(any_value(l.v), 0) d from groups g left join counts c using (lang, source) left join langs l on l.lang = g.lang group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + {WHOLE}::hugeint * (coalesce(c.n, 0) + 2) // g.d as p, 1 + {WHOLE}::hugeint * (k.nl + 2) // (l.nl + 2 * l.v) as q
  from totals g join kept k using (lang) join langs l using (lang) left join counts c using (lang, source, term)),
sums as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b using (lang, term) where a.source <> b.source group by all),
found as (select x.lang, x.source, 'pair' part, y.source item, coalesce(value, 0)::bigint as value from groups x join groups y on x.lang = y.lang and x.source <> y.source left join sums s on s.lang = x.lang and s.source = x.source and s.item = y.source
  union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from found qualify part = 'pair' or rank <= {TOP}
"""
