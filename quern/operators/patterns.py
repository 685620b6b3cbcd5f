"""Row patterns: matches of a regular pattern over the ordered rows of each key, or of all rows.

A pattern is built of names of row conditions: ``sequence(some("view"), "click", "purchase")``. It becomes an automaton
without empty steps, one state for each name in the pattern. What a range of rows does to the automaton is, for each pair of
states, whether one leads to the other, so ranges are walked at the same time and put together afterwards.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quern.sources.shared import checkpoint_folder

#: Most names in a pattern, and most conditions.
MAX_STATES = 60


class Pattern(NamedTuple):
    """Names in order; whether no row at all fits; the states that may come first and last; which may follow which."""

    names: tuple[str, ...]
    empty: bool
    first: frozenset[int]
    last: frozenset[int]
    follow: frozenset[tuple[int, int]]


def _pattern(part: Pattern | str) -> Pattern:
    one = frozenset([0])
    return Pattern((part,), False, one, one, frozenset()) if isinstance(part, str) else part


def _moved(part: Pattern | str, by: int) -> Pattern:
    p = _pattern(part)
    states = lambda x: frozenset(s + by for s in x)
    return Pattern(p.names, p.empty, states(p.first), states(p.last), frozenset((a + by, b + by) for a, b in p.follow))


def sequence(*parts: Pattern | str) -> Pattern:
    """The parts, one after the other."""
    whole = Pattern((), True, frozenset(), frozenset(), frozenset())
    for part in parts:
        p = _moved(part, len(whole.names))
        joints = frozenset((a, b) for a in whole.last for b in p.first)
        first = whole.first | p.first if whole.empty else whole.first
        last = whole.last | p.last if p.empty else p.last
        whole = Pattern(whole.names + p.names, whole.empty and p.empty, first, last, whole.follow | p.follow | joints)
    return whole


def either(*parts: Pattern | str) -> Pattern:
    """One of the parts."""
    whole = Pattern((), False, frozenset(), frozenset(), frozenset())
    for part in parts:
        p = _moved(part, len(whole.names))
        whole = Pattern(whole.names + p.names, whole.empty or p.empty, whole.first | p.first, whole.last | p.last, whole.follow | p.follow)
    return whole


def some(part: Pattern | str) -> Pattern:
    """The part, once or more."""
    p = _pattern(part)
    return p._replace(follow=p.follow | {(a, b) for a in p.last for b in p.first})


def maybe(part: Pattern | str) -> Pattern:
    """The part or nothing."""
    return _pattern(part)._replace(empty=True)


def repeated(part: Pattern | str) -> Pattern:
    """The part, any number of times."""
    return maybe(some(part))


def match_rows(
    df: DataFrame, order: Sequence[str], pattern: Pattern | str, conditions: dict[str, Column], by: Sequence[str] = (),
    at_start: dict[str, str] | None = None, n_rows: str = "n_rows", longest: bool = True, within: tuple[str, int] | None = None, ranges: int | None = None,
) -> DataFrame:
    """The rows that end a match, each with its longest (or shortest) match: ``n_rows``, and columns of the row where it starts.

    A match is a run of consecutive rows, in ``order`` (ascending, null first) within a value of ``by`` or over all rows, whose
    conditions spell the pattern. A row may fulfil several conditions; a condition that is null is not fulfilled. ``within``, a
    column of whole numbers and a limit, keeps matches whose last value exceeds their first by at most the limit (a null is
    in no match's first or last row); of these the longest or shortest counts. Matches that end at different rows may
    share rows. ``at_start`` maps new columns to columns taken from the first row. Rows of equal ``order`` come in any
    order, so it should tell rows apart. A null in ``by`` is a value like any other.

    Rows are shuffled once, into ``ranges`` ranges of key and order (by default the session's shuffle partitions), and
    written to the checkpoint folder, as both passes must see the same ranges; so a hot key, or all rows without
    a key, are the work of many tasks. The first pass reads only keys and conditions. A state holds one possible start,
    or for the longest match within a limit all that the limit still allows; a range hands on its states, one row a
    range reaches the driver.
    """
    at_start, by, spark = at_start or {}, list(by), df.sparkSession
    p = _pattern(pattern)
    if p.empty or not p.names:
        raise ValueError("the pattern fits no row at all, so every place would be a match")
    if len(p.names) > MAX_STATES or len(conditions) > MAX_STATES:
        raise ValueError(f"more than {MAX_STATES} names")
    if missing := set(p.names) - set(conditions):
        raise ValueError(f"no condition for {sorted(missing)}")
    if within and not isinstance(df.schema[within[0]].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError(f"{within[0]} is no column of whole numbers")
    checkpoint_folder(spark)
    names = list(conditions)
    met = sum((F.when(conditions[c], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(names)), F.lit(0).cast("long"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(c) for c in (*by, *order)]
    dealt = df.withColumn("_met", met).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    dealt = dealt.checkpoint()

    time, limit = within or (None, 0)
    kept = list(dict.fromkeys([*at_start.values(), *([time] if time else [])]))
    bit = {s: 1 << names.index(c) for s, c in enumerate(p.names)}
    before = {s: [a for a, b in sorted(p.follow) if b == s] for s in bit}
    opening = sum({bit[s] for s in p.first})

    def column(batch: pa.RecordBatch, name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(column(batch, c)[row].as_py() for c in by)

    def trimmed(starts: set[int]) -> list[int]:
        """Of possible starts those worth keeping, in order."""
        if not starts or (longest and time):
            return sorted(starts)
        return [min(starts) if longest else max(starts)]

    def advance(batch: pa.RecordBatch, state: dict | None, matched: list | None) -> dict:
        """The state after a batch; ``matched`` collects (row in the batch, first row's place, its values)."""
        size = batch.num_rows
        fresh = np.zeros(size, bool)
        for c in by:
            own = column(batch, c)
            null, values = own.is_null().to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
            fresh[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (values[1:] != values[:-1]))
        last = key(batch, size - 1)
        if state is None:
            one = key(batch, 0)
            state = {"first": one, "key": one, "single": True, "n": 0, "starts": {}, "values": {}, "reach": {s: 1 << s for s in bit}}
        fresh[0] = state["key"] != key(batch, 0)
        single = state["single"] and not fresh.any()
        held, reach, starts, values = state["n"], state["reach"], state["starts"], state["values"]
        times = column(batch, time).to_pylist() if time else None
        own = [column(batch, c) for c in kept]

        def values_of(place: int) -> tuple:
            return values[place] if place < held else tuple(c[place - held].as_py() for c in own)

        def time_of(place: int) -> int:
            return values[place][kept.index(time)] if place < held else times[place - held]

        mets = column(batch, "_met").to_numpy(zero_copy_only=False).tolist()
        anew = fresh.tolist()
        for i in range(size):
            if anew[i]:
                starts, reach = {}, {}
            m = mets[i]
            if not starts and not reach and not m & opening:
                continue
            now = times[i] if time else None
            led, through = {}, {}
            for s, b in bit.items():
                if not m & b:
                    continue
                found: set[int] = set()
                mask = 0
                for a in before[s]:
                    if a in starts:
                        found.update(starts[a])
                    mask |= reach.get(a, 0)
                if s in p.first and (not time or now is not None):
                    found.add(held + i)
                if time and now is not None:
                    found = {x for x in found if now - time_of(x) <= limit}
                if found:
                    led[s] = trimmed(found)
                if mask:
                    through[s] = mask
            starts, reach = led, through
            if matched is not None and (not time or now is not None):
                ends = trimmed({x for s in p.last if s in starts for x in starts[s]})
                if ends:
                    matched.append((i, ends[0], values_of(ends[0])))
        alive = {x for own_starts in starts.values() for x in own_starts}
        return {"first": state["first"], "key": last, "single": single, "n": held + size, "starts": starts, "values": {x: values_of(x) for x in alive}, "reach": reach}

    def summary(batches):
        state, place = None, None
        for batch in batches:
            if batch.num_rows:
                place = column(batch, "_range")[0].as_py()
                state = advance(batch, state, None)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], ["_range", "state"])

    needed = list(dict.fromkeys([*by, *kept, "_met", "_range"]))
    ends = {r["_range"]: pickle.loads(r["state"]) for r in dealt.select(*needed).mapInArrow(summary, "_range int, state binary").collect()}
    carried: dict[int, dict | None] = {}
    carry, done = None, 0
    for place in sorted(ends):
        end = ends[place]
        carried[place] = {"n": done} if carry is None else {**carry, "n": done}
        starts = {s: {x + done for x in own} for s, own in end["starts"].items()}
        values = {x + done: v for x, v in end["values"].items()}
        if carry is not None and end["single"] and carry["key"] == end["first"]:
            for s, mask in end["reach"].items():
                for a, own in carry["starts"].items():
                    if mask >> a & 1:
                        starts.setdefault(s, set()).update(own)
                        values |= {x: carry["values"][x] for x in own}
        elif carry is not None and carry["key"] != end["first"]:
            carried[place] = {"n": done}
        done += end["n"]
        starts = {s: trimmed(own) for s, own in starts.items()}
        carry = {"key": end["key"], "starts": starts, "values": values}
    sent = spark.sparkContext.broadcast(carried)

    columns = df.columns
    new = [T.StructField(n_rows, T.LongType()), *(T.StructField(c, df.schema[source].dataType) for c, source in at_start.items())]
    schema = T.StructType([*df.schema.fields, *new])

    def finish(batches):
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                state = {"first": None, "key": key(batch, 0), "single": False, "starts": {}, "values": {}, "reach": {}} | sent.value[column(batch, "_range")[0].as_py()]
            matched: list = []
            held = state["n"]
            state = advance(batch, state, matched)
            if matched:
                rows = batch.take(pa.array([i for i, _, _ in matched], pa.int64()))
                lengths = pa.array([held + i - x + 1 for i, x, _ in matched], pa.int64())
                first = [pa.array([v[kept.index(source)] for _, _, v in matched], column(batch, source).type) for source in at_start.values()]
                yield pa.RecordBatch.from_arrays([*(column(rows, c) for c in columns), lengths, *first], [f.name for f in schema.fields])

    return dealt.mapInArrow(finish, schema)
