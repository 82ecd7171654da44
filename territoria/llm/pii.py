"""Personal data: base patterns as seeds, and bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import cut, documents_of, tidy

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns (fixed values). Groups are possessive where that changes no match, and a pattern starts only where
#: a run of its characters does, or where the last match ended: so long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these can't hold a span of the kind, and are not searched for it.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Kinds that the method may add: the base ones, and secrets, which have seeds by shape but no base pattern.
EVERY_KIND = (*KINDS, "secret")
SECRET = r"\A(?=[0-9]*[a-f])(?=[a-f]*[0-9])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})\z"
#: What may be an identifier: a phone number or a card number with its blanks, or a token that holds a digit or an at sign.
CANDIDATE = r"\+[0-9][\x20().0-9-]+[0-9]|(?<![\p{L}\p{N}._%+@-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\p{L}\p{N}@])|(?:\G|(?<![\p{L}\p{N}._%+@-]))[\p{L}._%+-]*+[0-9@](?:[\p{L}\p{N}._%+@-]*[\p{L}\p{N}])?"
#: Distinct seeds that a pattern needs; the part of its patterns' belief that an unseen instance gives back; confidence
#: from which patterns and instances count; change of scores at which they have settled.
SUPPORT, DAMPING, CONFIDENT, SETTLED = 5, 0.8, 0.7, 0.01
#: Elements of an array that are added up in one go: sums over long arrays then cost the square of this only.
STEP = 256
#: Characters of a cell of the text by which spans of one place find each other.
CELL = 64

PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _held(value: str, name: str, body: str) -> str:
    """body, in SQL, where `name` is the value, worked out once however often body has it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _valid(kind: str, hit: str) -> str:
    """Whether a match of the base pattern is a span of the kind, in SQL."""
    if kind == "ip":
        return f"rlike({hit}, {_raw(rf'\A{PART}(?:\.{PART}){{3}}\z')})"
    if kind == "phone":
        return f"length(regexp_replace({hit}, '[^0-9]', '')) between 10 and 15"
    if kind == "card":
        digit = "cast(substring(d, -i, 1) as int)"
        worth = f"case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end"
        return _held(f"regexp_replace({hit}, '[^0-9]', '')", "d", f"case when length(d) between 14 and 19 then aggregate(sequence(1, length(d)), 0, (a, i) -> a + {worth}) % 10 = 0 else false end")
    return "true"


def _summed(xs: str) -> str:
    """The sum of numbers (at), and the sums before each (out), in SQL."""
    return f"aggregate({xs}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x, 'out', concat(a.out, array(a.at))))"


def _starts(lengths: str) -> str:
    """The sums of the numbers before each element, in SQL. Steps of STEP elements are summed by themselves and then
    shifted, so no array is copied once for each of its elements."""
    steps = f"transform(case when size(xs) > 0 then sequence(1, size(xs), {STEP}) else cast(array() as array<int>) end, k -> {_summed(f'slice(xs, k, {STEP})')})"
    shifted = f"flatten(zip_with(steps, {_summed('transform(steps, s -> s.at)')}.out, (s, b) -> transform(s.out, x -> x + b)))"
    return _held(_held(lengths, "xs", steps), "steps", shifted)


def spans(text: str, pattern: str) -> Column:
    """All matches in a column as structs (start, end, hit, before, after), in code points: the lengths of what is
    between them, added up. before and after are what lies between a match and its neighbours."""
    between = "zip_with(z.gaps, z.hits, (g, h) -> length(g) + coalesce(length(h), 0))"
    found = "transform(sequence(0, size(z.hits) - 1), k -> named_struct('at', firsts[k], 'hit', z.hits[k], 'before', z.gaps[k], 'after', z.gaps[k + 1]))"
    span = "x -> named_struct('start', x.at + length(x.before), 'end', x.at + length(x.before) + length(x.hit), 'hit', x.hit, 'before', x.before, 'after', x.after)"
    placed = _held(_starts(between), "firsts", f"transform({found}, {span})")
    made = f"case when size(z.hits) > 0 then {placed} else cast(array() as {SPAN}) end"
    return F.expr(_held(f"named_struct('gaps', split({text}, {_raw(pattern)}, -1), 'hits', regexp_extract_all({text}, {_raw(pattern)}, 0))", "z", made))


def _words(text: str) -> str:
    """The words of a piece of text in lower case, digits as 0, in SQL."""
    return f"filter(split(regexp_replace(lower({text}), {_raw(r'\p{N}')}, '0'), ' '), w -> w <> '')"


def _patterns() -> str:
    """The lexical patterns around a candidate s, in SQL: one to three words before it, the word after it, and one on
    both sides. Where a neighbouring candidate (last, following) is nearer, it is one of the words."""
    blank = lambda x: f"translate({x}, '\\n\\t\\r\\u000b\\u000c', '     ')"
    left = _words(f"substring_index(concat(coalesce(y.last, ''), {blank('y.s.before')}), ' ', -5)")
    right = _words(f"substring_index(ltrim(concat({blank('y.s.after')}, coalesce(y.following, ''))), ' ', 1)")
    tail = lambda n: f"case when size(p.l) >= {n} then concat(array_join(slice(p.l, -{n}, {n}), ' '), ' _') end"
    one = "get(p.r, 0)"  # at the end of the text there is no word, and no pattern of it
    made = f"filter(array({tail(1)}, {tail(2)}, {tail(3)}, concat('_ ', {one}), concat({tail(1)}, ' ', {one})), q -> q is not null)"
    return _held(f"named_struct('l', {left}, 'r', {right})", "p", made)


def _kind(hit: str) -> str:
    """The kind of a candidate that is a base span or a secret as a whole, a seed, in SQL."""
    whole = " ".join(f"when rlike({hit}, {_raw(rf'\A(?:{PATTERNS[k]})\z')}) and {_valid(k, hit)} then '{k}'" for k in KINDS)
    return f"case when rlike({hit}, {_raw(SECRET)}) then 'secret' {whole} end"


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, seen): the base spans of each text (start, place, kind, end), and all that may be identifiers
    (start, end, token, seed, patterns); seed is the kind of one that is known. h tells rows of one doc_id apart."""
    rows = documents_of(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, none = F.col("text"), F.expr(f"cast(array() as {SPAN})")
    for kind in KINDS:
        may = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
        rows = rows.withColumn(kind, F.when(may, spans("text", PATTERNS[kind])).otherwise(none))
    rows = rows.withColumn("all", F.when(text.rlike("[0-9@]"), spans("text", CANDIDATE)).otherwise(none))
    named = (f"transform(filter({k}, s -> {_valid(k, 's.hit')}), s -> named_struct('start', s.start, 'place', {n}, 'kind', '{k}', 'end', s.end))" for n, k in enumerate(KINDS))
    beside = "transform(xs, (s, k) -> named_struct('s', s, 'last', case when k > 0 then xs[k - 1].hit end, 'following', get(xs, k + 1).hit))"
    one = f"y -> named_struct('start', y.s.start, 'end', y.s.end, 'token', lower(y.s.hit), 'seed', {_kind('y.s.hit')}, 'patterns', {_patterns()})"
    seen = _held("all", "xs", f"transform({beside}, {one})")
    return rows.select("doc_id", F.xxhash64("text").alias("h"), F.expr(f"array_sort(concat({', '.join(named)}))").alias("base"), F.expr(seen).alias("seen"))


def _scored(edges: DataFrame, known: DataFrame, support: int, settled: float) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, p) and (token, kind, s) from the graph of patterns and instances (pattern, token). known: (token,
    kind, s), what is believed of some instances and stays; others start at nothing. A pattern with `support` known
    instances of a kind is worth the mean of all its instances, one that is none of the kind added; an unseen instance
    gives back the noisy-or of its patterns, damped, so many unseen ones keep a pattern down. Scores are worked out again
    and again until none moves by more than `settled`; by the damping that is a matter of some rounds."""
    seeded = cut(edges.join(known, "token"))
    worthy = cut(seeded.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum("s").alias("sure")).where(F.col("seeds") >= support))
    sizes = edges.join(worthy.select("pattern").distinct(), "pattern").groupBy("pattern").agg(F.count("*").alias("n"))
    base = cut(worthy.join(sizes, "pattern"))
    open_ = cut(edges.join(known.select("token").distinct(), "token", "left_anti").join(base.select("pattern", "kind"), "pattern"))
    patterns = cut(base.select("pattern", "kind", (F.col("sure") / (F.col("n") + 1)).alias("p")))
    while True:
        tokens = cut(open_.join(patterns, ["pattern", "kind"]).groupBy("token", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.least("p", F.lit(0.999)))))).alias("s")))
        back = open_.join(tokens, ["token", "kind"]).groupBy("pattern", "kind").agg((F.sum("s") * DAMPING).alias("back"))
        after = cut(base.join(back, ["pattern", "kind"], "left").join(patterns, ["pattern", "kind"]).select("pattern", "kind", ((F.col("sure") + F.coalesce("back", F.lit(0.0))) / (F.col("n") + 1)).alias("now"), "p"))
        moved = after.agg(F.max(F.abs(F.col("now") - F.col("p")))).first()[0]
        patterns = after.select("pattern", "kind", F.col("now").alias("p"))
        if moved is None or moved <= settled:
            return patterns, tokens


def discovered(found: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, settled: float = SETTLED) -> DataFrame:
    """(doc_id, h, start, end, kind, pattern, confidence): candidates that stand in patterns of which seeds are known.

    Seeds, the base spans and tokens of a secret's shape, induce patterns; the graph of patterns and instances is scored
    (see _scored); instances that confident patterns hold and that are confident themselves become seeds, which induce
    patterns of their own, until there are no new ones. A secret's shape alone is no finding: it counts as one where a
    confident pattern holds it."""
    seen = found.select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*").select("doc_id", "h", "start", "end", "token", "seed", F.explode("patterns").alias("pattern"))
    every = cut(seen.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    edges = every.select("pattern", "token")
    known = cut(every.where("seed is not null").groupBy("token").agg(F.max("seed").alias("kind")).withColumn("s", F.lit(1.0)))
    while True:
        patterns, tokens = _scored(edges, known, support, settled)
        good = cut(patterns.where(F.col("p") >= confident))
        sure = tokens.where(F.col("s") >= confident).groupBy("token").agg(F.max(F.struct("s", "kind")).alias("m")).select("token", "m.kind", "m.s")
        new = cut(sure.join(known, "token", "left_anti").join(edges.join(good, "pattern").select("token", "kind").distinct(), ["token", "kind"], "left_semi"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new.select("token", "kind", "s")))
    of_kind = cut(edges.join(good, "pattern").join(known, ["token", "kind"]).groupBy("token", "pattern").agg(F.max(F.struct(F.least("s", "p").alias("confidence"), "kind")).alias("m")))
    hits = seen.where(F.col("seed").isNull() | (F.col("seed") == "secret")).join(of_kind, ["token", "pattern"])
    return hits.groupBy("doc_id", "h", "start", "end").agg(F.max(F.struct("m.confidence", "m.kind", "pattern")).alias("x")).select("doc_id", "h", "start", "end", "x.kind", "x.pattern", "x.confidence")


def _apart(extra: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of extra that overlap no base span of their text: spans are compared only in the cells both touch."""
    cells = lambda df: df.withColumn("cell", F.explode(F.expr(f"sequence(start div {CELL}, (end - 1) div {CELL})")))
    base = cells(found.select("doc_id", "h", F.explode("base").alias("s")).select("doc_id", "h", F.col("s.start").alias("start"), F.col("s.end").alias("end")))
    hit = cells(extra).alias("x").join(base.alias("b"), F.expr("x.doc_id <=> b.doc_id and x.h = b.h and x.cell = b.cell and b.start < x.end and x.start < b.end"))
    return extra.alias("e").join(cut(hit.select("x.doc_id", "x.h", "x.start", "x.end").distinct()).alias("o"), F.expr("e.doc_id <=> o.doc_id and e.h = o.h and e.start = o.start and e.end = o.end"), "left_anti")


@tidy
def personal_data(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, settled: float = SETTLED) -> DataFrame:
    """Personal data of whole texts.

    Returns a row per row of docs (doc_id, text; other columns are ignored): doc_id, base (spans of the base patterns:
    start, place, kind, end; code points, end exclusive), extra (those that patterns add, alike: of the base kinds, or
    secrets, in last place), spans (both, in order). A null text counts as empty; texts without personal data have empty
    arrays. Rows that repeat a doc_id and its text have equal spans, and count once as evidence; an empty table gives no
    rows. Of kinds equally likely the last by name counts. Patterns hold counts only while they are scored, so a very
    common one is no burden, and texts cost time in proportion to their length.
    """
    found = cut(found_in(docs))
    place = F.element_at(F.create_map(*(F.lit(x) for n, k in enumerate(EVERY_KIND) for x in (k, n))), F.col("kind"))
    extra = _apart(cut(discovered(found, support, confident, settled)), found).withColumn("place", place)
    extra = cut(extra.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end"))).alias("extra")))
    rows = found.alias("f").join(extra.alias("x"), F.expr("f.doc_id <=> x.doc_id and f.h = x.h"), "left")
    return rows.select("f.doc_id", "f.base", F.coalesce("x.extra", F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")).alias("extra")).withColumn("spans", F.array_sort(F.concat("base", "extra")))


def joined(column: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
