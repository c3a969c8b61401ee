"""Removal of repeated byte strings by column-wise suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller id is removed.  Work goes in passes over the
blocks, none of which gathers the text:

1. ``pack``: documents become blocks of some megabytes, written once as a
   table bucketed by block, so that later passes join with it in place.
2. ``key_rows``: each string of ``length`` bytes has a minimizer, the smallest
   hash of its 24-byte grams, which is the same wherever the string stands.
   Neighbouring strings share it, so a run of them is one short fragment.  A
   block sends its distinct minimizers (32 bits of each, in order, as steps);
   ``shared`` finds those that stand more than once in the collection.
3. ``entry_rows``: of shared minimizers, blocks send a hash of each distinct
   fragment and the smallest document id that holds it.  Where a minimizer has
   one fragment in the whole collection, ``judged`` answers at once: nothing
   else can hold its strings.  Most of an exact copy ends here.
4. ``fragment_rows``: blocks send the fragments of the others, dealt by
   minimizer.  A minimizer with many (a line that stands in many contexts) is
   dealt by the strings themselves, so no task gets a hot one whole.  A block has
   one row a cell, so cells grow in size before their number makes rows of
   single fragments (``cells_for``).
   ``answers``: a task sorts the suffixes of its fragments, some thousands at a
   time, column by column
   (``build``): each round inserts one more symbol of every fragment into the
   collection's Burrows-Wheeler transform and common prefixes, both rewritten
   from front to back.  Rows whose common prefix has ``length`` symbols are
   the same string; the smallest document of each is compared with the
   fragment's own, and one bit a string goes back to the block, where
   ``removal`` takes the covered bytes out.

The construction's "files" are arrays rewritten sequentially in the memory of
a task: a task's fragments are bounded (``CELL`` times ``FRAGMENTS`` on average,
``FRAGMENTS`` or so in one construction; equal ones arrive once from each
block), and tasks must not use machine-local folders.

Disk: the blocks stay until the end, everything else in turn.  Numbers and
fragments travel packed (``tight``), fragments once; a step's shuffle files go
as soon as its result is written (``step``).

Cases: null and empty texts have no bytes; a null document id counts as larger
than every other; rows with equal ids are not smaller than each other; texts
shorter than ``length`` lose nothing; a text is packed whole however long; an
empty table gives an empty table.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, trim, written

LENGTH = 50
GRAM = 24
#: Strings in one fragment at most.
RUN = 32
#: Bytes of a block, distinct minimizers in a task, fragments in one
#: construction, and fragments of one minimizer from which on it is dealt by its strings.
BLOCK, KEYS, FRAGMENTS, HOT = 2 << 20, 1 << 19, 1 << 12, 2048
#: Cells of one construction each up to this number, then cells of up to ``CELL`` constructions.
SMALL_CELLS, CELL = 512, 32
#: Start positions whose hashes are taken at once.
SPAN = 1 << 18
LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- packing

def tight(*arrays: np.ndarray) -> bytes:
    """The arrays in few bytes: bytes of the same weight side by side, compressed."""
    raw = b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
                   for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def loose(packed: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays that ``tight`` packed."""
    raw = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        n = int.from_bytes(raw[at:at + 8], "little")
        body = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 8)
        out.append(np.ascontiguousarray(body.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 8 + n * kind.itemsize
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences between neighbours, with the first value; ``np.cumsum`` undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


# ---------------------------------------------------------------- blocks

def pack(limit: int):
    """Body of the packing tasks: rows (id, bytes, meta) to block rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def close():
            nonlocal held, size, seq
            rows = pa.Table.from_batches(held).combine_chunks()
            body = rows.column(1).chunk(0)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64()),
                 pa.array([b"".join(body.to_pylist())], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), pc.binary_length(body)),
                 pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), rows.column(0).chunk(0)),
                 pa.ListArray.from_arrays(pa.array([0, len(body)], pa.int32()), rows.column(2).chunk(0))],
                names=["block", "body", "lengths", "ids", "meta"])
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                if size and size + n > limit:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield close()
                    start = i
                size += n
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield close()
        trim()
    return run


# ---------------------------------------------------------------- minimizers

def hashes(b: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the gram at every position of ``b``."""
    p = 0x9E3779B97F4A7C15
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    power, width, eight = p, 1, None
    while width < 16:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), 2 * width
        if width == 8:
            eight, eight_power = h, power
    h = h[:len(b) - GRAM + 1] * np.uint64(eight_power) + eight[16:16 + len(b) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    n, m, w = len(h) - width + 1, h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[width - w:width - w + n]) if w < width else m[:n]


def runs(body: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, minimizer) of the fragments of a block."""
    ends = np.cumsum(lengths)
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]]
    for lo in range(0, max(0, len(body) - length + 1), SPAN):
        hi = min(lo + SPAN, len(body) - length + 1)
        key = smallest(hashes(body[lo:hi + length - 1]), length - GRAM + 1)
        inside = np.ones(hi - lo + 2, dtype=bool)  # strings that lie in one document, with an edge on both sides
        inside[0] = inside[-1] = False
        first, last = np.searchsorted(ends, (lo, hi + length))
        for end, own in zip(ends[first:last + 1].tolist(), lengths[first:last + 1].tolist()):
            inside[max(0, max(end - own, end - length + 1) - lo) + 1:max(0, min(end, hi) - lo) + 1] = False
        turn = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(inside[1:-1] & (turn | ~inside[:-2]))
        stop = np.flatnonzero(inside[1:-1] & (np.append(turn[1:], True) | ~inside[2:]))
        count = stop - start + 1
        pieces = (count + RUN - 1) // RUN
        if len(count) and pieces.max() > 1:
            step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, count = np.repeat(start, pieces) + RUN * step, np.minimum(np.repeat(count, pieces) - RUN * step, RUN)
        out[0].append(start + lo)
        out[1].append(count)
        out[2].append(key[start])
    return tuple(np.concatenate(x) for x in out)


def minimizers(flat: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """The minimizer of each fragment, from its first string."""
    out, starts = [], np.cumsum(lengths) - lengths
    for lo in range(0, len(lengths), 1024):
        own = starts[lo:lo + 1024]
        end = int(own[-1] + lengths[lo:lo + 1024][-1])
        out.append(smallest(hashes(flat[own[0]:end]), length - GRAM + 1)[own - own[0]])
    return np.concatenate(out)


def spread(keys: np.ndarray) -> np.ndarray:
    """Other numbers for the minimizers, one to one: those are small, as the
    least of many, and would crowd the first buckets."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal parts of the range of the keys, in order."""
    n, half = np.uint64(buckets), np.uint64(32)
    return ((keys >> half) * n + (((keys & np.uint64(0xFFFFFFFF)) * n) >> half)) >> half


def in_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of each key's place in its bucket, in order."""
    return ((keys * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)


def block_keys(body: np.ndarray, lengths: np.ndarray, length: int, buckets: int):
    """Runs of a block and its distinct minimizers in order of bucket."""
    start, count, key = runs(body, lengths, length)
    key = spread(key)
    keys, back, times = np.unique(key, return_inverse=True, return_counts=True)  # ascending, so by bucket
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    return start, count, key, keys, back, times, cuts


def key_rows(length: int, buckets: int):
    """Blocks to (bucket, block, keys): distinct minimizers and how often each
    stands there, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, lengths in zip(*(batch.column(i) for i in range(3))):
                raw = np.frombuffer(body.as_buffer(), dtype=np.uint8)
                *_, keys, _, times, cuts = block_keys(raw, lengths.values.to_numpy(), length, buckets)
                low, times = in_bucket(keys, buckets), np.minimum(times, 255).astype(np.uint8)
                own = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), block.as_py(), np.int64)),
                     pa.array([tight(steps(low[cuts[k]:cuts[k + 1]]), times[cuts[k]:cuts[k + 1]]) for k in own], pa.binary())],
                    names=["bucket", "block", "keys"])
        trim()
    return run


def shared(hot: int):
    """One bucket: which of each block's minimizers stand more than once (1),
    and which of them more than ``hot`` times (2)."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts, times = zip(*(loose(x, np.uint32, np.uint8) for x in rows.column("keys").to_pylist()))
        parts = [np.cumsum(p, dtype=np.uint32) for p in parts]
        keys, back = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(times), minlength=len(keys))
        code = (total > 1).astype(np.uint8) + (total > hot)
        ends = np.cumsum([len(p) for p in parts])
        codes = [code[b] for b in np.split(back, ends[:-1])]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"),
                         "many": pa.array([int((c > 1).sum()) * RUN for c in codes], pa.int64()),
                         "codes": pa.array([c.tobytes() for c in codes], pa.binary())})
    return run


# ---------------------------------------------------------------- fragments

FRAGMENT_ROWS = "block bigint, cell bigint, n int, body binary"


def cells_for(fragments: int) -> int:
    """Cells that so many fragments are dealt to."""
    one = fragments // FRAGMENTS + 1
    return min(one, max(SMALL_CELLS, one // CELL))


def distinct(raw: bytes, start: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int):
    """Number of each fragment's text, the texts, an occurrence and the
    smallest document of each."""
    number: dict[bytes, int] = {}
    entry = np.array([number.setdefault(raw[a:a + n + length - 1], len(number))
                      for a, n in zip(start.tolist(), count.tolist())], dtype=np.int64)
    least = np.full(len(number), LAST, dtype=np.int64)
    np.minimum.at(least, entry, doc)
    some = np.zeros(len(number), dtype=np.int64)
    some[entry] = np.arange(len(entry))
    return entry, list(number), some, least


class Block:
    """A block with the codes of its minimizers: its shared fragments."""

    def __init__(self, blocks: pa.Table, codes: list[tuple[int, bytes]], length: int, buckets: int):
        self.raw = blocks.column("body")[0].as_py()
        lengths = blocks.column("lengths")[0].values.to_numpy()
        ids = np.array([LAST if i is None else i for i in blocks.column("ids")[0].as_py()], dtype=np.int64)
        start, count, mini, keys, back, _, cuts = block_keys(np.frombuffer(self.raw, np.uint8), lengths, length, buckets)
        code = np.zeros(len(keys), dtype=np.uint8)
        for k, c in codes:
            code[cuts[k]:cuts[k + 1]] = np.frombuffer(c, np.uint8)
        code = code[back]
        ends = np.cumsum(lengths)
        few, many = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        self.start, self.count, self.mini = start[few], count[few], mini[few]
        self.doc = ids[np.searchsorted(ends, self.start, side="right")]
        self.entry, self.texts, self.some, self.least = distinct(self.raw, self.start, self.count, self.doc, length)
        # entries by bucket: the order in which they are sent and answered
        bucket = bucket_of(self.mini[self.some], buckets).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        # each string of a hot minimizer
        first = np.cumsum(count[many]) - count[many]
        self.hot = np.repeat(start[many] - first, count[many]) + np.arange(int(count[many].sum()))
        self.hot_doc = ids[np.searchsorted(ends, self.hot, side="right")]


def entry_rows(length: int, buckets: int):
    """Blocks with their codes to (bucket, block, entries): minimizer, hash and
    smallest document of each distinct fragment, packed."""
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, codes: pa.Table) -> pa.Table:
        from xxhash import xxh64_intdigest
        trim()
        out = [[], [], []]
        if blocks.num_rows:
            own = Block(blocks, list(zip(codes.column("bucket").to_pylist(), codes.column("codes").to_pylist())), length, buckets)
            hashed = np.array([xxh64_intdigest(t) for t in own.texts], dtype=np.uint64)
            entry = [a[own.order] for a in (in_bucket(own.mini[own.some], buckets), hashed, own.least)]
            used = np.flatnonzero(np.diff(own.cuts))
            out = [used.tolist(), [key[0].as_py()] * len(used),
                   [tight(*(a[own.cuts[k]:own.cuts[k + 1]] for a in entry)) for k in used]]
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "block": pa.array(out[1], pa.int64()),
                         "entries": pa.array(out[2], pa.binary())})
    return run


def judged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One bucket: 2 for a fragment whose minimizer has others, else 1 if a
    smaller document holds the same one, else 0."""
    parts = [loose(x, np.uint32, np.uint64, np.int64) for x in rows.column("entries").to_pylist()]
    own, hashed, doc = (np.concatenate(x) for x in zip(*parts))
    keys, back = np.unique(own, return_inverse=True)
    low, high = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(keys), np.uint64)
    least = np.full(len(keys), LAST, np.int64)
    np.minimum.at(low, back, hashed)
    np.maximum.at(high, back, hashed)
    np.minimum.at(least, back, doc)
    code = np.where((low != high)[back], 2, least[back] < doc).astype(np.uint8)
    codes = np.split(code, np.cumsum([len(x[0]) for x in parts])[:-1])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"),
                     "found": pa.array([int((c == 2).sum()) for c in codes], pa.int64()),
                     "codes": pa.array([c.tobytes() for c in codes], pa.binary())})


def fragment_rows(length: int, buckets: int, cells: int):
    """Blocks with both kinds of codes to rows of fragments for each cell (their
    lengths, smallest documents and bytes), and one row, in a cell of its own
    below 0, with the fragments whose answer is open (start, number of strings
    and place among the answered bits) and the ranges already known to go."""
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, codes: pa.Table) -> pa.Table:
        names = ["block", "cell", "n", "body"]
        trim()
        out: dict[str, list] = {c: [] for c in names}
        block = key[0].as_py()
        if blocks.num_rows:
            both = list(zip(*(codes.column(c).to_pylist() for c in ("kind", "bucket", "codes"))))
            own = Block(blocks, [(b, c) for k, b, c in both if k == 0], length, buckets)
            code = np.zeros(len(own.texts), dtype=np.uint8)
            for k, b, c in both:
                if k == 1:
                    code[own.order[own.cuts[b]:own.cuts[b + 1]]] = np.frombuffer(c, np.uint8)
            later = (own.doc > own.least[own.entry]) | (code[own.entry] == 1)
            hot_entry, hot_texts, _, hot_least = distinct(own.raw, own.hot, np.ones(len(own.hot), np.int64), own.hot_doc, length)
            hot_later = own.hot_doc > hot_least[hot_entry]
            sure = merged_ranges(np.concatenate([own.start[later], own.hot[hot_later]]),
                                 np.concatenate([(own.start + own.count)[later], own.hot[hot_later] + 1]) + length - 1)
            # fragments to sort: those with others beside them, and hot strings
            sort = np.flatnonzero(code == 2)
            texts = [own.texts[i] for i in sort.tolist()] + hot_texts
            least = np.concatenate([own.least[sort], hot_least])
            cell = np.concatenate([
                ((own.mini[own.some[sort]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(cells),
                np.array([string_cell(t, cells) for t in hot_texts], dtype=np.uint64)]).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            # bits come back cell by cell in this order, a fragment's one after the other
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            bits = sizes[order] - length + 1
            place = np.zeros(len(texts), dtype=np.int64)
            place[order] = np.cumsum(bits) - bits
            for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else ():
                out["block"].append(block)
                out["cell"].append(int(cell[part[0]]))
                out["n"].append(len(part))
                out["body"].append(tight(sizes[part].astype(np.uint8), least[part],
                                         np.frombuffer(b"".join([texts[i] for i in part]), np.uint8)))
            where = np.zeros(len(own.texts), dtype=np.int64)
            where[sort] = place[:len(sort)]
            open_ = np.flatnonzero((code[own.entry] == 2) & ~later)
            hot_open = np.flatnonzero(~hot_later)
            pending = [np.concatenate([own.start[open_], own.hot[hot_open]]),
                       np.concatenate([own.count[open_], np.ones(len(hot_open), np.int64)]),
                       np.concatenate([where[own.entry[open_]], place[len(sort) + hot_entry[hot_open]]])]
            out["block"].append(block)
            out["cell"].append(-1 - block)
            out["n"].append(len(pending[0]))
            out["body"].append(tight(steps(pending[0]), *pending[1:], *map(steps, sure.astype(np.int64))))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.table({c: pa.array(out[c], k) for c, k in zip(names, kinds)})
    return run


def merged_ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of ranges, as rows of starts and ends in ascending order."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, np.int64)
    return np.stack([start[new], end[np.append(new[1:], len(end)) - 1]]) if len(start) else np.zeros((2, 0), np.int64)


def string_cell(text: bytes, cells: int) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(text) % cells


# ---------------------------------------------------------------- suffix sorting

def build(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (0 where a string begins, else the number from
    1 of the symbol before among those that occur) and common prefixes of all suffixes of the strings; the
    first rows are the empty suffixes, one a string.

    Round t inserts the suffixes of t symbols.  A row's image is the row of
    the suffix one symbol longer: rows by symbol, ties in row order.  Old rows
    keep their order, so both arrays are rewritten in one sweep; only a new
    row and the row after it get a new common prefix, one more than the least
    between the rows they are images of."""
    m = len(lengths)
    ends = np.cumsum(lengths)
    seen = np.flatnonzero(np.bincount(flat, minlength=256))
    kind = np.uint8 if len(seen) < 256 else np.uint16
    code = np.zeros(256, dtype=kind)
    code[seen] = np.arange(1, len(seen) + 1)
    symbols = code[flat]
    bwt = np.where(lengths > 0, symbols[np.maximum(ends - 1, 0)], 0).astype(kind)
    lcp = np.zeros(m, dtype=np.uint8)
    at = np.arange(m)  # row of each active string's longest suffix so far
    active = np.flatnonzero(lengths >= 1)
    at, t = at[active], 0
    while len(active):
        t += 1
        order = np.argsort(bwt, kind="stable")
        order = order[int(np.count_nonzero(bwt == 0)):]  # order[i] has its image in row m + i
        who = np.full(len(bwt), -1, dtype=np.int32)
        who[at] = active
        who = who[order]
        rows = np.flatnonzero(who >= 0)
        active, rows = who[rows], rows + m  # in order of their new rows
        n = m + len(order)
        # new rows and those after them get a new common prefix, from the back
        ask = np.stack([rows, rows + 1], axis=1).reshape(-1)
        ask = ask[np.append(ask[1:] != ask[:-1], ask[-1] < n)][::-1]
        here = order[ask - m]
        before = order[np.maximum(ask - m - 1, 0)]
        same = np.flatnonzero((ask > m) & (bwt[before] == bwt[here]))
        pairs = np.empty(2 * len(same), dtype=np.int64)
        pairs[0::2] = before[same] + 1
        pairs[1::2] = here[same] + 1
        values = np.zeros(len(ask), dtype=np.uint8)
        if len(pairs):
            values[same] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[0::2] + 1
        old = np.ones(n, dtype=bool)
        old[rows] = False
        after = np.empty(n, dtype=np.uint8)
        after[old] = lcp
        after[ask] = values
        symbol = np.empty(n, dtype=kind)
        symbol[old] = bwt
        more = lengths[active] > t
        symbol[rows] = np.where(more, symbols[np.maximum(ends[active] - t - 1, 0)], 0)
        bwt, lcp, active, at = symbol, after, active[more], rows[more]
    return bwt, lcp


def least_documents(flat: np.ndarray, lengths: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every string of ``length`` symbols of the fragments, in order: the
    smallest document of all fragments that hold it."""
    bwt, lcp = build(flat, lengths)
    m = len(lengths)
    group = np.cumsum(lcp < length)  # rows of one group begin with the same string
    order = np.argsort(bwt, kind="stable")
    image = np.zeros(len(bwt), dtype=np.int64)
    image[order] = np.arange(len(order)) + m - int(np.count_nonzero(bwt == 0))
    row, active = np.arange(m), np.arange(m)
    strings = lengths - length + 1
    base = np.cumsum(strings) - strings
    where = np.zeros(int(strings.sum()), dtype=np.int64)
    for t in range(1, int(lengths.max()) + 1):
        active = active[lengths[active] >= t]
        row[active] = image[row[active]]
        if t >= length:  # the suffix of t symbols starts at lengths - t
            where[base[active] + lengths[active] - t] = group[row[active]]
    owner = np.repeat(docs, strings)
    by = np.lexsort((owner, where))
    first = np.append(True, where[by][1:] != where[by][:-1])
    least = np.empty(len(where), dtype=np.int64)
    least[by] = owner[by][first][np.cumsum(first) - 1]
    return least


def portions(mini: np.ndarray, single: np.ndarray, size: int) -> list[np.ndarray]:
    """Fragments in portions of about ``size``; those of one minimizer stay
    together, if not all are single strings, which differ from each other."""
    order = np.argsort(mini, kind="stable")
    turn = np.append(True, mini[order][1:] != mini[order][:-1])
    alone = np.logical_and.reduceat(single[order], np.flatnonzero(turn))[np.cumsum(turn) - 1]
    allowed = np.flatnonzero(turn | alone)
    at = np.searchsorted(allowed, np.arange(size, len(order), size))
    return np.split(order, np.unique(allowed[at[at < len(allowed)]]))


def answers(length: int):
    """One cell: for each block's fragments, one bit a string: a document
    smaller than the fragment's own smallest holds it.  Rows of cells below 0
    pass through."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows
        trim()
        number: dict[bytes, int] = {}
        entry, sizes, docs = [], [], []
        for packed in rows.column("body").to_pylist():
            own, doc, body = loose(packed, np.uint8, np.int64, np.uint8)
            body, a = body.tobytes(), 0
            sizes.append(own.astype(np.int64))
            docs.append(doc)
            for n in own.tolist():
                entry.append(number.setdefault(body[a:a + n], len(number)))
                a += n
        entry = np.array(entry, dtype=np.int64)
        least = np.full(len(number), LAST, dtype=np.int64)
        np.minimum.at(least, entry, np.concatenate(docs))
        lengths = np.array([len(t) for t in number], dtype=np.int64)
        texts, strings = list(number), lengths - length + 1
        base = np.cumsum(strings) - strings
        found = np.repeat(least, strings)
        # the only fragment of its minimizer holds its strings alone
        flat = np.frombuffer(b"".join(texts), np.uint8)
        mini = minimizers(flat, lengths, length)
        _, back, times = np.unique(mini, return_inverse=True, return_counts=True)
        sort = np.flatnonzero(times[back] > 1)
        for part in portions(mini[sort], strings[sort] == 1, FRAGMENTS) if len(sort) else ():
            part = sort[part]
            n = strings[part]
            at = np.repeat(base[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found[at] = least_documents(np.frombuffer(b"".join([texts[i] for i in part.tolist()]), np.uint8),
                                        lengths[part], least[part], length)
        out, a = [], 0
        for own, doc in zip(sizes, docs):
            mine = entry[a:a + len(own)]
            a += len(own)
            n = strings[mine]
            first = np.cumsum(n) - n
            at = np.repeat(base[mine] - first, n) + np.arange(int(n.sum()))
            out.append(np.packbits(found[at] < np.repeat(doc, n), bitorder="little").tobytes())
        return pa.table({"block": rows.column("block"), "cell": rows.column("cell"),
                         "n": pa.array([int((x - length + 1).sum()) for x in sizes], pa.int32()),
                         "body": pa.array(out, pa.binary())})
    return run


# ---------------------------------------------------------------- removal

def removal(length: int, meta: pa.DataType, whole_characters: bool = False):
    """Blocks with their fragments' places and answers to documents."""
    names = ["meta", "n_bytes", "kept", "spans"]
    kinds = [meta, pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(key, blocks: pa.Table, found: pa.Table) -> pa.Table:
        trim()
        if not blocks.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(names, kinds)})
        raw = blocks.column("body")[0].as_py()
        lengths = blocks.column("lengths")[0].values.to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("cell", "n", "body"))), key=lambda r: r[0])
        if rows:
            start, count, place, *sure = loose(rows[0][2], *[np.int64] * 5)
            start, sure = np.cumsum(start), [np.cumsum(x) for x in sure]
            bits = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(
                np.frombuffer(b, np.uint8), bitorder="little", count=n) for _, n, b in rows[1:])])
            first = np.cumsum(count) - count
            step = np.arange(int(count.sum())) - np.repeat(first, count)
            gone = (np.repeat(start, count) + step)[bits[np.repeat(place, count) + step] > 0]
            np.add.at(edge, np.concatenate([gone, sure[0]]), 1)
            np.add.at(edge, np.concatenate([gone + length, sure[1]]), -1)
        covered = np.cumsum(edge[:-1]) > 0
        body = np.frombuffer(raw, np.uint8)
        if whole_characters and len(body):
            lead = np.flatnonzero((body & 0xC0) != 0x80)
            covered = np.repeat(np.logical_and.reduceat(covered, lead), np.diff(np.append(lead, len(body))))
        kept, spans = [], []
        for a, b in zip((ends - lengths).tolist(), ends.tolist()):
            own = covered[a:b]
            if not own.any():
                kept.append(raw[a:b])
                spans.append([])
                continue
            kept.append(body[a:b][~own].tobytes())
            turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": x, "end": y} for x, y in zip(turn[0::2].tolist(), turn[1::2].tolist())])
        return pa.table({"meta": blocks.column("meta")[0].values, "n_bytes": pa.array(lengths),
                         "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kinds[3])})
    return run


#: Spark removes the shuffle files of a query with its end if this is set, else whenever the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries begun inside leave no shuffle files."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back; its shuffle files are gone then."""
    with shuffles_removed(df.sparkSession):
        return written(df, name)


def dedup(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", block: int = BLOCK,
          whole_characters: bool = False, hot: int = HOT) -> DataFrame:
    """Every row's other columns (struct ``meta``), ``n_bytes``, ``kept`` (the
    bytes that stay) and ``spans`` (removed byte ranges, ascending).  With
    ``whole_characters`` a character goes only if all its bytes do."""
    spark: SparkSession = df.sparkSession
    if not GRAM < length < 256 - RUN:
        raise ValueError(f"length must lie between {GRAM + 1} and {255 - RUN}")
    meta = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body"), meta.alias("meta"))
    kind = rows.schema["meta"].dataType
    packed = rows.mapInArrow(pack(block), f"block bigint, body binary, lengths array<int>, ids array<bigint>, meta array<{kind.simpleString()}>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    packed.write.option("path", scratch(spark, "suffix-blocks")).option("compression", "zstd").bucketBy(parts, "block").saveAsTable(name)
    blocks = spark.table(name)
    size = blocks.select(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = int(size / 14 / KEYS) + 1

    keys = blocks.select("block", "body", "lengths").mapInArrow(
        key_rows(length, buckets), "bucket int, block bigint, keys binary")
    codes = step(keys.groupBy("bucket").applyInArrow(shared(hot), "block bigint, bucket int, many bigint, codes binary"), "suffix-codes")
    by_block = blocks.select("block", "body", "lengths", "ids").groupBy("block")
    entries = by_block.cogroup(codes.groupBy("block")).applyInArrow(
        entry_rows(length, buckets), "bucket int, block bigint, entries binary")
    verdicts = step(entries.groupBy("bucket").applyInArrow(judged, "block bigint, bucket int, found bigint, codes binary"),
                    "suffix-verdicts")
    found = (verdicts.agg(F.sum("found")).first()[0] or 0) + (codes.agg(F.sum("many")).first()[0] or 0)

    told = codes.drop("many").withColumn("kind", F.lit(0)).unionByName(verdicts.drop("found").withColumn("kind", F.lit(1)))
    fragments = by_block.cogroup(told.groupBy("block")).applyInArrow(
        fragment_rows(length, buckets, cells_for(found)), FRAGMENT_ROWS)
    back = step(fragments.groupBy("cell").applyInArrow(answers(length), FRAGMENT_ROWS), "suffix-answers")
    from pyspark.sql.pandas.types import to_arrow_type
    out = blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        removal(length, to_arrow_type(kind), whole_characters),
        f"meta {kind.simpleString()}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return out
