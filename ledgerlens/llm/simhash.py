"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints: 64-bit majority of the XXH64 hashes of a text's word shingles.
Linking works on distinct fingerprints, so any number of equal texts is one
node.  A fingerprint is cut into ``bits + 1`` blocks; two that differ in at
most ``bits`` bits agree in a whole block, and, by the same argument on the
remaining bits, in one block of the rest.  Each (block, rest block) pair is a
join key.  Rows of a key meet sorted in a task, which compares them in numpy
(XOR and bit count) and sends on a spanning forest of the links found, never
the pairs.  A key with more than ``TILE`` fingerprints is dealt as pairs of
tiles, each a bounded comparison of its own, so none is dropped.  Components
come from alternating large-star and small-star rounds over the forest, each
written to the shared checkpoint folder.

Cases: null and empty texts have fingerprint zero and link like any other;
null document ids take part and never become a component id (a component of
such rows alone has a null id); repeated rows get the same component; a text
of any length is read whole, its shingles hashed in parts; an empty table
gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, trim, written

SEED = 42
#: Fingerprints of one key that one task compares at once.
TILE = 1024
#: Hashes whose bits are counted at once.
HASHES = 1 << 14


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned fingerprint: bits set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = (ends - [len(w) + 1 for w in words])[:len(words) - k + 1].tolist()
    ends = (ends[k - 1:] - 1).tolist()
    n, counts = len(starts), np.zeros(64, dtype=np.int64)
    for i in range(0, n, HASHES):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:i + HASHES], ends[i:i + HASHES])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprint_udf(shingle: int):
    """Arrow function string -> fingerprint as a signed long."""
    def work(texts):
        return pa.array(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))
    body = over_texts(lambda: work)

    def run(batches):
        yield from body(batches)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")


def with_fingerprints(df: DataFrame, shingle: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of ``text``; a column named ``out`` is replaced."""
    return df.withColumn(out, fingerprint_udf(shingle)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def parts(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` cut into n runs of about equal length."""
    size = [len(bits) // n + (i < len(bits) % n) for i in range(n)]
    return [bits[sum(size[:i]):sum(size[:i + 1])] for i in range(n)]


def taken(fp: F.Column, bits: list[int]) -> F.Column:
    """The given bits (ascending, in at most two runs) as a number."""
    out, at, i = F.lit(0).cast("bigint"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - i + 1
        mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bits[i]).bitwiseAND(mask), at))
        at, i = at + width, j + 1
    return out


def keys(fp: F.Column, max_bits: int) -> F.Column:
    """array<struct<tag,value>> of the (block, rest block) keys."""
    out, whole = [], list(range(64))
    for i, block in enumerate(parts(whole, max_bits + 1)):
        rest = [b for b in whole if b not in block]
        for j, inner in enumerate(parts(rest, max_bits + 1)):
            value = F.shiftleft(taken(fp, block), len(inner)).bitwiseOR(taken(fp, inner))
            out.append(F.struct(F.lit(i * (max_bits + 1) + j).alias("tag"), value.alias("value")))
    return F.array(*out)


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest of its component) within one group."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        step = np.where(near, label[None, :], len(fps)).min(axis=1)
        step = step[step]
        if (step == label).all():
            break
        label = step
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def compare(max_bits: int):
    """Body of the comparing tasks: rows (tag, value, cell, fp) sorted by the
    first three to links (a, b)."""
    def links(group: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, len(group)))
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):  # small groups: neighbours at each distance
            if d >= len(fps):
                break
            at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
            at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= max_bits]
            yield fps[at + d], fps[at]
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            yield forest(fps[s:s + n], max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last group, which the next batch may continue

        def found(rows: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            got = list(links(np.cumsum(new), np.ascontiguousarray(rows[:, 3]).view(np.uint64)))
            both = [np.concatenate([g[i] for g in got]).view(np.int64) if got else np.zeros(0, np.int64) for i in (0, 1)]
            keep = both[0] != both[1]
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in both], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            if held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield found(np.concatenate(held))
                held = []
            open_ = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            cut = len(rows) - int(np.argmin(open_[::-1])) if not open_.all() else 0
            if cut:
                yield found(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield found(np.concatenate(held))
        trim()
    return run


def links(fps: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all of ``fps`` (one distinct column fp) which
    differ in at most ``max_bits`` bits: a spanning forest of each key's."""
    keyed = fps.select("fp", F.explode(keys(F.col("fp"), max_bits)).alias("k")).select("k.tag", "k.value", "fp")
    sizes = keyed.groupBy("tag", "value").count().where("count > 1")
    tiles = F.ceil(F.col("count") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = (keyed.join(sizes, ["tag", "value"])
             .withColumn("tiles", tiles).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumn("cell", F.least("own", "other") * F.col("tiles") + F.greatest("own", "other")))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.select("tag", "value", "cell", "fp").repartition(n, "tag", "value", "cell")
            .sortWithinPartitions("tag", "value", "cell", "fp")
            .mapInArrow(compare(max_bits), "a bigint, b bigint").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node connected to each node of ``edges``
    (columns a, b).  Every round is a written table in the shared folder."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        # large star: bigger neighbours of a node move to its smallest
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: smaller neighbours of a node, and itself, move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = written(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def group(df: DataFrame, max_bits: int = 3, key: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``df`` with ``root`` (a name of its component) and ``component_id``."""
    nodes = df.groupBy(F.col(f"`{fp}`").alias("_fp")).agg(F.min(F.col(f"`{key}`")).alias("_least"))
    found = components(links(nodes.select(F.col("_fp").alias("fp")), max_bits))
    rooted = nodes.join(found, nodes["_fp"] == found["node"], "left").select(
        "_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    places = rooted.select("_fp", "_root").join(named, "_root")
    rest = [c for c in df.columns if c not in ("root", "component_id")]
    out = df.select(*[F.col(f"`{c}`") for c in rest]).join(places, F.col(f"`{fp}`") == F.col("_fp"), "left")
    return out.select(*[F.col(f"`{c}`") for c in rest], F.col("_root").alias("root"), F.col("_component").alias("component_id"))


