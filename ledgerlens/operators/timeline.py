"""Trailing-window features as one event timeline per entity.

All trailing windows of an entity share one timeline: every distinct (key,
time) is a *point* that enters every window at its time and leaves a window of
``w`` seconds right after ``time + w``; a value counts as distinct from the
start of a run of occurrences no further apart than ``w`` until ``w`` after the
run's last one.  A running sum over the timeline, read at the query times,
gives all sums and distinct counts of all windows at once, O(n log n) where
range frames take O(n x frame).

The events are written once and read back.  Of a value's occurrences in one
stretch of at most a chunk only the first and last can begin or end a run, so
they are aggregated to these first.

Running sums are prefix sums over a hierarchy of time chunks: inside a chunk, over
the chunks of a span, over the spans of a key.  No window partition holds more
than one key's events of one chunk, chunks of one span, or spans, or one row for
each stretch of a value, so a key with a third of all rows is spread over many
tasks.

The result has one row for each (key, time), not for each transaction: it is
joined back on both, so transactions that repeat an id, or share key and time,
never multiply.  NULL keys form one group of their own; rows without a time get
NULL features.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Length of a chunk in seconds, and chunks in a span.
CHUNK_SECONDS, SPAN_CHUNKS = 300, 288
MICROS = 1_000_000


@dataclass(frozen=True)
class Trail:
    """One trailing window [t - seconds, t]: output name -> measure for sums,
    output name -> column for distinct counts, the name under which the
    earliest time in the window is wanted, if any, and the ``entity`` whose
    rows alone it is about, where a timeline holds several."""
    seconds: int
    sums: dict[str, str] = field(default_factory=dict)
    distincts: dict[str, str] = field(default_factory=dict)
    first: str | None = None
    entity: str | None = None

    def names(self) -> list[str]:
        return [*self.sums, *self.distincts, *([self.first] if self.first else [])]


def timeline_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))


def points(df: DataFrame, key: str, measures: dict[str, Column], ts: str = "event_time") -> DataFrame:
    """(_k, _t, measures): the sums of every key and time."""
    t = F.unix_micros(F.col(ts))
    return (df.where(F.col(ts).isNotNull()).select(timeline_key(key).alias("_k"), t.alias("_t"), *[e.alias(n) for n, e in measures.items()])
              .groupBy("_k", "_t").agg(*[F.sum(n).alias(n) for n in measures]))


def occurrences(df: DataFrame, key: str, value: str, ts: str = "event_time") -> DataFrame:
    """(_k, _v, _t): the times of every value of a key, repeats included."""
    return (df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
              .select(timeline_key(key).alias("_k"), F.col(value).cast("string").alias("_v"), F.unix_micros(F.col(ts)).alias("_t")))


def _chunk(t: Column | str) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(CHUNK_SECONDS * MICROS)).cast("long")


def cells(df: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """One row a group and stretch of so many seconds that holds times: its first
    and last time (``_lo``, ``_hi``), and the last time before and the first
    after it in the group (``_before``, ``_after``; NULL at the ends)."""
    stretch = F.floor(F.col("_t") / F.lit(seconds * MICROS)).cast("long").alias("_c")
    over = Window.partitionBy(*keys).orderBy("_c")
    return (df.groupBy(*keys, stretch).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
              .select(*keys, "_lo", "_hi", F.lag("_hi").over(over).alias("_before"), F.lead("_lo").over(over).alias("_after")))


def running(events: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Query events (``_q``) with the sums of all deltas of their keys up to
    their (time, order), equal ones included.  The events are read three times:
    hand over a written table."""
    ev = events.withColumn("_c", _chunk("_t")).withColumn("_s", F.floor(F.col("_c") / SPAN_CHUNKS).cast("long"))
    inside = Window.partitionBy(*keys, "_s", "_c").orderBy("_t", "_o")  # equal (time, order) are peers
    whole = ev.groupBy(*keys, "_s", "_c").agg(*[F.sum(n).alias(n) for n in names])

    def earlier(group: list[str], order: str):
        return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    chunks = whole.select(*keys, "_s", "_c", *[F.sum(n).over(earlier([*keys, "_s"], "_c")).alias("_c_" + n) for n in names])
    spans = whole.groupBy(*keys, "_s").agg(*[F.sum(n).alias(n) for n in names])
    spans = spans.select(*keys, "_s", *[F.sum(n).over(earlier(keys, "_s")).alias("_s_" + n) for n in names])
    zero = F.lit(0)
    q = (ev.select(*keys, "_s", "_c", "_t", "_q", *[F.sum(n).over(inside).alias(n) for n in names]).where("_q")
           .join(chunks.join(spans, [*keys, "_s"]), [*keys, "_s", "_c"]))
    return q.select(*keys, "_t", *[(F.col(n) + F.coalesce(F.col("_c_" + n), zero) + F.coalesce(F.col("_s_" + n), zero)).alias(n)
                                  for n in names])


def sweep(pts: DataFrame, occ: dict[str, DataFrame], trails: list[Trail], use: list[Column] | None = None,
          stay: list[Column] | None = None, query: Column | None = None, keys: list[str] | None = None,
          keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """(keys, _t, features): one row for every point where ``query`` holds (all).

    ``use`` says for each trail which points count at all, ``stay`` which never
    leave: partial sums that lie in the window of every query.  ``keys`` are
    ``_k``, or ``entity`` and ``_k`` where the timeline holds several entities.
    ``keep`` writes the events and reads them back: points and occurrences are
    computed once, whatever reads the events."""
    keys = keys or ["_k"]
    use = use or [F.lit(True)] * len(trails)
    stay = stay or [F.lit(False)] * len(trails)
    measured = {m for tr in trails for m in tr.sums.values()}
    types = {f.name: f.dataType.simpleString() for f in pts.schema.fields if f.name in measured}
    for tr in trails:
        types |= {out: types[m] for out, m in tr.sums.items()} | {out: "bigint" for out in tr.distincts}
        types |= {tr.first: "bigint"} if tr.first else {}
    names = [n for tr in trails for n in tr.names()]

    def of(tr):
        return F.lit(True) if tr.entity is None else F.col("entity") == tr.entity

    def event(t, order, q, deltas):
        return F.struct(t.cast("long").alias("_t"), F.lit(order).alias("_o"), q.alias("_q"),
                        *[F.coalesce(deltas.get(n, F.lit(0)), F.lit(0)).cast(types[n]).alias(n) for n in names])

    def events(df, each):
        return df.select(*keys, F.inline(F.array(*each))).where("_t is not null")

    t, lo, hi, before, after = (F.col(c) for c in ("_t", "_lo", "_hi", "_before", "_after"))
    firsts = [tr for tr in trails if tr.first]
    rows = pts
    if firsts:
        rows = pts.withColumn("_next", F.lead("_t").over(Window.partitionBy(*keys, _chunk("_t")).orderBy("_t")))
    enter, leave = {}, []
    for tr, counts, stays in zip(trails, use, stay):
        goes = counts & of(tr) & ~stays
        enter |= {n: F.when(counts & of(tr), F.col(m)) for n, m in tr.sums.items()}
        out = {n: F.when(goes, -F.col(m)) for n, m in tr.sums.items()}
        if tr.first:  # a time that leaves hands over to the next
            goes = goes | F.col("_next").isNotNull()
            out[tr.first] = F.col("_next") - t
        if out:
            leave.append(F.when(goes, event(t + tr.seconds * MICROS, 2, F.lit(False), out)))
    q = F.lit(True) if query is None else query
    parts = [events(rows, [event(t, 0, q, enter), *leave])]
    if firsts:  # the first time of the key enters; the last time of a chunk hands over to the next chunk's first
        steps = [F.when(before.isNull(), event(lo, 0, F.lit(False), {tr.first: lo for tr in firsts}))]
        steps += [F.when(after.isNotNull(), event(hi + tr.seconds * MICROS, 2, F.lit(False), {tr.first: after - hi})) for tr in firsts]
        parts.append(events(cells(pts, keys, CHUNK_SECONDS), steps))
    for value, times in occ.items():
        counted = [(tr, n) for tr in trails for n, v in tr.distincts.items() if v == value]
        if not counted:
            continue
        steps = []
        for tr, n in counted:
            w = tr.seconds * MICROS
            steps += [F.when(of(tr) & (before.isNull() | (before + w < lo)), event(lo, 0, F.lit(False), {n: F.lit(1)})),
                      F.when(of(tr) & (after.isNull() | (after > hi + w)), event(hi + w, 2, F.lit(False), {n: F.lit(-1)}))]
        # times of one stretch no longer than any window are one run: its ends are enough
        near = cells(times, [*keys, "_v"], max(1, min([CHUNK_SECONDS, *[tr.seconds for tr, _ in counted]])))
        parts.append(events(near, steps))
    return running(keep(reduce(DataFrame.unionByName, parts)), names, keys)


def attach(df: DataFrame, key: str, features: DataFrame, ts: str = "event_time") -> DataFrame:
    """``df`` with the features of its key and time."""
    return (df.withColumn("_k", timeline_key(key)).withColumn("_t", F.unix_micros(F.col(ts)))
              .join(features, ["_k", "_t"], "left").drop("_k", "_t"))


def trailing(df: DataFrame, key: str, trails: list[Trail], measures: dict[str, Column] | None = None,
             ts: str = "event_time") -> DataFrame:
    """``df`` with the features of the trails; rows at the same time count."""
    columns = {v for tr in trails for v in tr.distincts.values()}
    pts = points(df, key, measures or {"_n": F.lit(1)}, ts)
    return attach(df, key, sweep(pts, {v: occurrences(df, key, v, ts) for v in sorted(columns)}, trails), ts)
