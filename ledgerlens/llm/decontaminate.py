"""Benchmark decontamination by Wu-Manber search over words.

A test item's windows (ten words in a row; all words of a shorter item) are
the patterns.  Patterns of one length are searched together: a shift table
over blocks of two words tells how far the search may move on when the block
at its end stands in no pattern or only further left; a block that ends a
pattern leads to the bucket of those patterns, which are compared word by
word.  Texts are read once, in place, in Arrow batches; most positions are
skipped.

The item table is the stated search set.  It goes to the tasks in slices of
about ``SLICE_BYTES`` of text (one item is never cut), by hash of its id and
text, one pass over the documents for each slice; results of a document are
joined in its row, never shuffled.  A slice's rows are broadcast and every
worker builds its searcher of them.  Each pass but the last writes the
documents with its finds to the shared folder, so the driver and a worker hold
one slice at a time; disk grows by the documents with every further pass.

Cases: null texts and texts without words have no words and no hits; null item
texts and items without words occur nowhere; items with a null id are searched
like others, and only their id is left out of ``items``; repeated items count
each id once; overlapping occurrences cover a word once; a text of any length
is searched whole, in one task; further columns of the documents, whatever
their names, stay inside ``key``; an empty table on either side gives rows
without hits or no rows.
"""
from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed value: what a word is, in UTF-8 bytes after lower-casing A-Z.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
WINDOW = 10
#: Bytes of item texts that are searched in one pass; a searcher takes about a
#: hundred times as much memory.
SLICE_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    return WORDS(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Patterns:
    """Shift table and buckets of all patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                key = block if self.block == 2 else block[0]
                self.shift[key] = min(self.shift.get(key, length), length - end)
            self.bucket[key].append((pattern, items))
        self.default = length - self.block + 1

    def search(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence, from left to right."""
        at, end, n, default = self.length, self.length, len(text), self.default
        shift, two = self.shift.get, self.block == 2
        while end <= n:
            key = (text[end - 2], text[end - 1]) if two else text[end - 1]
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - at
            for pattern, items in self.bucket[key]:
                if text[start] == pattern[0] and tuple(text[start:end]) == pattern:
                    yield start, items
            end += 1


class Searcher:
    """All patterns of a slice of items, one table for each pattern length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        by_length: dict = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            own = words(text)
            n = min(window, len(own))
            for pattern in {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else ():
                by_length[n][pattern].append(item)
        self.tables = [Patterns(n, found) for n, found in sorted(by_length.items())]

    def __call__(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered word spans (merged, ascending) and items that occur."""
        spans, items = [], set()
        for table in self.tables:
            for start, found in table.search(text):
                spans.append((start, start + table.length))
                items.update(found)
        items.discard(None)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


#: The slice a worker has at hand and its searcher.
_at_hand: dict = {}


def searcher_of(rows: Broadcast, window: int) -> Searcher:
    """One searcher a worker, so its tasks share it; that of an earlier slice
    goes first."""
    if _at_hand.get("rows") is not rows or _at_hand["window"] != window:
        _at_hand.clear()
        _at_hand.update(searcher=Searcher(rows.value, window), rows=rows, window=window)
    return _at_hand["searcher"]


def pass_over(rows: Broadcast, window: int, text_at: int = 1):
    """One pass: rows (key, text, n_words, spans, items) with a slice's finds added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = searcher_of(rows, window)
        for batch in batches:
            counts, spans, items = [], [], []
            texts = batch.column(text_at)
            old_spans, old_items = (batch.column(i).to_pylist() for i in (3, 4))
            for i in range(len(texts)):
                own = words(texts[i].as_py())
                here, found = searcher(own)
                if old_spans[i]:
                    here = merged(here + [(s["start"], s["end"]) for s in old_spans[i]])
                counts.append(len(own))
                spans.append([{"start": a, "end": b} for a, b in here])
                items.append(sorted(found.union(old_items[i] or ())))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(counts, pa.int64()), pa.array(spans, kind),
                 pa.array(items, pa.list_(pa.string()))], names=["key", "text", "n_words", "spans", "items"])
    return run


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
         text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, text, n_words, spans, items) for every row of ``docs``: key is a
    struct of its other columns, spans are covered word ranges, items the
    sorted ids (as strings) of test items that occur."""
    named = items.select(F.col(f"`{item_id}`").cast("string").alias("item"),
                         F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = int(total // slice_bytes) + 1
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    out = docs.select(key.alias("key"), F.col(f"`{text}`").cast("string").alias("text"),
                      F.lit(0).cast("bigint").alias("n_words"),
                      F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))
    schema = out.schema
    for k in range(slices):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k) if slices > 1 else named
        rows = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])
        out = out.mapInArrow(pass_over(rows, window), schema)
        if k < slices - 1:
            out = written(out, "searched")
            rows.destroy()
    return out
