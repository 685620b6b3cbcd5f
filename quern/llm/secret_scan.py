"""Secret scans in DataFrame and SQL functions only.

Three patterns give the base spans. A battery of randomness tests adds further ones: every
maximal run of 20 or more token characters that no base span contains is a candidate. Its encoding is
inferred, and chi-squared uniformity over that alphabet, a runs test and serial correlation
are combined to one statistic h (``quern.llm.randomness``), by which

* a run that uniform symbols would hardly give is no secret, and
* a run that text-like symbols of its encoding and length might give is none either: the p-values
  under that hypothesis, read from simulations, go through Benjamini-Hochberg at rate
  ``FALSE_DISCOVERIES``, by encoding and length class, over all candidates of the corpus. Only
  long or many-symbol runs can have small ones, which makes the decision length-aware.

What leaves the executors is a histogram of h by class, of fixed size whatever the number of
candidates. All work on a row is linear in its length but for logarithms, and for a copy of one
number per 64 matches for each 64 matches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm import randomness
from quern.llm._spark import checkpointed

#: Base patterns and the least length of the second group or of the match. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
#: Runs of 16 or more, and of 32 or more: a maximal run is matched whole or not at all.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Letters that must occur for ``ASSIGN`` to match at all.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: maximal runs.
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Share of false discoveries, and of random runs that the first condition may lose.
FALSE_DISCOVERIES, LOST = 0.05, 1e-3
#: Bins of the histogram per unit of h, and the last one, which holds all that is beyond.
BINS, LAST_BIN = 10, 1000
#: Elements of an array whose prefixes are taken at once; code points of a block of text.
CHUNK, BLOCK = 64, 4096


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefixes(values: str, zero: str, op: str) -> str:
    """SQL for what comes before each element of an array of longs: ``op``, of ``{a}`` and x, over all earlier ones.

    Prefixes are taken within chunks, then over the chunks' totals, as SQL can only extend an array by copying it.
    """
    chunks = f"transform(sequence(0, greatest(size(v) - 1, 0) div {CHUNK}), j -> slice(v, j * {CHUNK} + 1, {CHUNK}))"
    grow = f"concat(s, array({op.format(a='element_at(s, -1)')}))"
    inner = f"transform({chunks}, c -> aggregate(c, array({zero}), (s, x) -> {grow}))"
    totals = f"aggregate(transform(i, t -> element_at(t, -1)), array({zero}), (s, x) -> {grow})"
    joined = f"flatten(zip_with(i, slice(t, 1, size(i)), (c, a) -> transform(slice(c, 1, size(c) - 1), x -> {op.format(a='a')})))"
    return _let("v", values, _let("i", inner, _let("t", totals, joined)))


def _located(kind: int, name: str, least: int) -> Column:
    """Spans in code points from the matches ``name_m`` and the text between them, ``name_g``; ``name_k`` has ``least`` characters at least."""
    lengths = f"zip_with(slice({name}_g, 1, size({name}_m)), {name}_m, (g, m) -> named_struct('g', cast(length(g) as bigint), 'm', length(m)))"
    at = _prefixes("transform(l, x -> x.g + x.m)", "0L", "{a} + x")
    spans = f"zip_with(l, {at}, (x, p) -> named_struct('start', cast(p + x.g as int), 'kind', {kind}, 'end', cast(p + x.g + x.m as int)))"
    kept = f"transform(filter(zip_with({spans}, {name}_k, (x, k) -> named_struct('x', x, 'n', length(k))), y -> y.n >= {least}), y -> y.x)"
    return F.expr(_let("l", lengths, kept))


def _inside(kinds: tuple[str, ...]) -> str:
    """SQL: a span of one of the sorted arrays contains the run ``c``, found by bisection."""
    steps = "array(" + ", ".join(str(1 << b) for b in range(29, -1, -1)) + ")"
    tests = []
    for a in kinds:
        last = f"aggregate({steps}, 0, (lo, s) -> if(lo + s <= size({a}) and get({a}, lo + s - 1).start <= c.start, lo + s, lo))"
        tests.append(f"(size({a}) > 0 and coalesce(get({a}, {last} - 1).end >= c.end, false))")
    return " or ".join(tests)


def _tail(z: str) -> str:
    """SQL for the upper tail of the normal distribution at z >= 0, as ``randomness.normal_tail``."""
    poly = "0D"
    for c in reversed(randomness.HASTINGS):
        poly = f"t * ({c}D + {poly})"
    return _let("t", f"1 / (1 + 0.2316419D * {z})", f"greatest(exp(-0.5D * {z} * {z}) * 0.3989422804014327D * ({poly}), 1e-300D)")


def _h(token: str) -> str:
    """SQL for a token's class and bin of h, as ``randomness.combined``."""
    kinds = randomness.ENCODINGS
    enc = "CASE " + " ".join(f"WHEN {token} rlike {_quoted(p)} THEN {i}" for i, (_, p, _) in enumerate(kinds) if p) + f" ELSE {len(kinds) - 1} END"
    alphabet = "get(array(" + ", ".join(_quoted(a) for _, _, a in kinds) + "), e)"
    codes = f"filter(transform(filter(split({token}, ''), x -> x <> ''), x -> instr(abc, x) - 1), x -> x >= 0)"
    squares = f"aggregate(transform(split(abc, ''), x -> length({token}) - length(replace({token}, x, ''))), 0D, (s, x) -> s + cast(x as double) * x)"
    pairs = "zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> {})"
    facts = (
        f"named_struct('k', length(abc), 'n', cast(size(v) as double), 'squares', {squares}, 'mean', aggregate(v, 0D, (s, x) -> s + x) / size(v), "
        "'high', cast(size(filter(v, x -> 2 * x >= length(abc))) as double), "
        f"'runs', 1D + size(filter({pairs.format('(2 * x >= length(abc)) <> (2 * y >= length(abc))')}, x -> x)))"
    )
    more = (
        "named_struct('z1', (f.k * f.squares / f.n - f.n - (f.k - 1)) / sqrt(2 * (f.k - 1) * (f.n - 1) / f.n), "
        "'expected', 2 * f.high * (f.n - f.high) / f.n + 1, 'square', aggregate(v, 0D, (s, x) -> s + (x - f.mean) * (x - f.mean)), "
        f"'cross', aggregate({pairs.format('(x - f.mean) * (y - f.mean)')}, 0D, (s, x) -> s + x))"
    )
    far = f"{randomness.FAR}D"
    z2 = f"least(abs(f.runs - g.expected) / sqrt(greatest((g.expected - 1) * (g.expected - 2) / (f.n - 1), 1e-9D)), {far})"
    z3 = f"if(g.square > 0, least(abs(g.cross / g.square + 1 / f.n) * sqrt(f.n), {far}), {far})"
    one, two, three = randomness.WEIGHTS
    h = (
        f"-{one} * ln(if(z.z1 >= 0, {_tail('z.z1')}, 1 - {_tail('(-z.z1)')})) - {two} * ln(least(1D, 2 * {_tail('z.z2')})) - {three} * ln(least(1D, 2 * {_tail('z.z3')}))"
    )
    h = _let("f", facts, _let("g", more, _let("z", f"named_struct('z1', least(g.z1, {far}), 'z2', {z2}, 'z3', {z3})", h)))
    least = "array(" + ", ".join(map(str, randomness.lengths())) + ")"
    body = (
        f"named_struct('class', e * 64 + greatest(size(filter({least}, x -> x <= size(v))) - 1, 0), "
        f"'bin', if(size(v) < {randomness.LEAST}, {LAST_BIN}, cast(least(floor({BINS} * {h}), {LAST_BIN}) as int)))"
    )
    return _let("e", enc, _let("abc", alphabet, _let("v", codes, body)))


def scanned(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Base spans and candidates of every row, as arrays, beside its ``key`` (doc_id); one pass, no shuffle.

    Documents are first tested for each pattern, so texts without any are searched once only.
    """
    text = docs.select((F.col("doc_id") if key is None else key).alias("row"), F.coalesce("text", F.lit("")).alias("t"))
    lower = F.lower("t")
    maybe = lower.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        maybe = maybe | lower.contains(word)
    found = {"a": (ASSIGN, 2, maybe), "k": (ACCESS, 0, F.col("t").contains("AKIA")), "h": (HEX, 0, F.col("t").rlike(HEX)), "r": (CANDIDATE, 0, F.col("t").rlike(CANDIDATE))}
    pieces = ["row"]
    for name, (pattern, group, test) in found.items():
        every = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
        none = F.array().cast("array<string>")
        pieces += [
            F.when(test, every).otherwise(none).alias(f"{name}_m"),
            F.when(test, F.split("t", pattern, -1)).otherwise(none).alias(f"{name}_g"),
            F.when(test, F.regexp_extract_all("t", F.lit(pattern), F.lit(group)) if group else every).otherwise(none).alias(f"{name}_k"),
        ]
    located = text.select(*pieces).select(
        "row", _located(0, "a", ASSIGN_LENGTH).alias("assign"), _located(1, "k", 0).alias("access"), _located(2, "h", 0).alias("hex"), _located(3, "r", 0).alias("runs"), F.col("r_m").alias("tokens")
    )
    fresh = f"filter(zip_with(runs, tokens, (s, m) -> named_struct('start', s.start, 'end', s.end, 'token', m)), c -> not ({_inside(('b0', 'b1', 'b2'))}))"
    for name, column in (("b0", "assign"), ("b1", "access"), ("b2", "hex")):
        fresh = _let(name, column, fresh)
    some = located.select("row", "assign", "access", "hex", F.when(F.size("runs") > 0, F.expr(fresh)).otherwise(F.expr("filter(array(named_struct('start', 0, 'end', 0, 'token', '')), c -> false)")).alias("runs"))
    tested = F.expr(f"transform(transform(runs, r -> named_struct('start', r.start, 'end', r.end, 'h', {_h('r.token')})), r -> named_struct('start', r.start, 'end', r.end, 'class', r.h.class, 'bin', r.h.bin))")
    return some.select(
        "row", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"), tested.alias("runs"),
    )


def discovered(bins: dict[int, int], kind: int) -> int:
    """The last bin of a class whose runs are secrets, -1 for none, from the candidates by bin of h.

    Benjamini-Hochberg on the text-like hypothesis, h taken as the bin's upper end, and no
    further than random runs reach.
    """
    encoding, n = kind // 64, randomness.lengths()[kind % 64]
    order = sorted(bins)
    total, so_far, last = sum(bins.values()), 0, -1
    for b, p in zip(order, randomness.text_p(encoding, n, (np.array(order) + 1) / BINS).tolist()):
        so_far += bins[b]
        if p * total <= FALSE_DISCOVERIES * so_far:
            last = b
    return min(last, int(randomness.random_limit(encoding, n, LOST) * BINS), LAST_BIN - 1)


def thresholds(found: DataFrame) -> dict[int, int]:
    """The last bin that is a discovery, by class.

    The histogram has at most encodings x length classes x bins rows; so does what returns.
    """
    counted: dict[int, dict[int, int]] = {}
    # the outer explode, as the other one filters by the runs first and so computes them twice
    for r in found.select(F.explode_outer("runs").alias("r")).groupBy("r.class", "r.bin").agg(F.count("r").alias("n")).collect():
        if r["n"]:
            counted.setdefault(r["class"], {})[r["bin"]] = r["n"]
    return {kind: last for kind, bins in counted.items() if (last := discovered(bins, kind)) >= 0}


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (arrays of struct<start, kind, end>) of every document.

    ``kind`` indexes ``KINDS``; positions are code points, ends exclusive, order by start, then
    kind. A null or empty text has none.
    """
    found = checkpointed(scanned(docs))
    return found.select(F.col("row").alias("doc_id"), "n_assign", "n_access", "n_hex", "base", _all_spans(thresholds(found)).alias("spans"))


def _all_spans(last: dict[int, int]) -> Column:
    """Base spans and the candidates that are discoveries, in order."""
    pairs = [x for c, b in sorted(last.items()) for x in (F.lit(c), F.lit(b))]
    chosen = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
    added = F.transform(
        F.filter("runs", lambda r: r["bin"] <= F.coalesce(F.try_element_at(chosen, r["class"]), F.lit(-1))),
        lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")),
    )
    return F.array_sort(F.concat("base", added))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _cut(start: str, stop: str) -> str:
    """SQL for a part of the text that ``blocks`` holds in blocks of ``BLOCK`` code points."""
    last = f"(({stop} - 1) div {BLOCK})"
    several = (
        f"concat(substring(get(blocks, cast({start} div {BLOCK} as int)), cast({start} % {BLOCK} + 1 as int), {BLOCK}), "
        f"array_join(slice(blocks, cast({start} div {BLOCK} + 2 as int), cast({last} - {start} div {BLOCK} - 1 as int)), ''), "
        f"substring(get(blocks, cast({last} as int)), 1, cast(({stop} - 1) % {BLOCK} + 1 as int)))"
    )
    one = f"substring(get(blocks, cast({start} div {BLOCK} as int)), cast({start} % {BLOCK} + 1 as int), cast({stop} - {start} as int))"
    return f"if({stop} <= {start}, '', if({start} div {BLOCK} = {last}, {one}, {several}))"


def redacted(docs: DataFrame, mark: str) -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; overlapping spans get one mark.

    All columns stay as they are, and so do rows without spans, a null text too. The texts are
    scanned twice, for the thresholds and for the spans, which spares a shuffle of the texts.
    """
    last = thresholds(scanned(docs))
    found = scanned(docs, F.struct(*docs.columns)).select("row", _all_spans(last).alias("found"))
    text = F.col("row.text")
    # what lies between the furthest end so far and the next start is kept
    ends = _prefixes("transform(spans, s -> cast(s.end as bigint))", "0L", "greatest({a}, x)")
    between = f"filter(zip_with(spans, {ends}, (s, p) -> named_struct('from', p, 'to', cast(s.start as bigint))), g -> g.to >= g.from)"
    final = _let("e", "array_max(transform(spans, s -> cast(s.end as bigint)))", _let("n", "cast(length(row.text) as bigint)", _cut("e", "n")))
    joined = f"concat(array_join(transform({between}, g -> {_cut('g.from', 'g.to')}), {_quoted(mark)}), {_quoted(mark)}, {final})"
    # bound by name, so that lambdas don't compute them anew for each element
    pieces = F.expr(_let("spans", "found", _let("blocks", f"regexp_extract_all(row.text, '(?s).{{1,{BLOCK}}}', 0)", joined)))
    clean = F.when(F.size("found") > 0, pieces).otherwise(text)
    return found.select(*((clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    return secret_spans(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
