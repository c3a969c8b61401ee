"""Token ids in files of directly addressable codes.

Ids are cut into 8-bit chunks.  Level 0 holds the lowest chunk of every id and
a bitmap that tells which ids go on; level 1 holds the next chunk of those
only, and so on.  A rank directory (number of set bits before every 512th
position) turns a position at one level into its position at the next, so any
id is read with one look at each level and no block is decoded.

Files: ``write`` sorts the texts by document id with a range shuffle (texts
of one id by their hash, so one id may lie in several tasks); each task
encodes its sorted texts and writes segments, one row of a Parquet file each,
as Parquet is what Spark can write to every store.  A segment holds the codes of whole documents (``blob``), their ids (``doc_ids``), its place
(``part``, ``seg``) and the number of tokens before it in its part
(``before``).  ``read`` adds the number of tokens in earlier parts (one number
a part) and addresses each document in its segment.

Cases: null and empty texts are documents of the end id alone; null document
ids sort first; repeated ids and rows are documents of their own, ordered by
a hash of the text, then the text; a text of any length is one document in one
segment; further columns, whatever their names, take no part; an empty table
gives files without segments and reads back empty.
"""
from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_groups, lists, trim

MAGIC = b"DAC1"
BITS = 8  # of a chunk
EVERY = 512  # positions between entries of a rank directory
#: Strings a worker remembers from task to task (beyond, those of the texts at
#: hand), words joined to one, and characters of a long text taken at once.
REMEMBERED, JOINED, LONG = 400_000, 1_000, 1 << 20
#: Tokens after which a segment is closed.
SEGMENT_TOKENS = 1 << 20
#: Marks a run of which stands apart when it follows a letter or digit and ends
#: the word (neither the quote nor the marks of special strings).
STOPS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIMPLE = f"^[A-Za-z]+[{re.escape(STOPS)}]*$"
SEGMENTS = "part int, seg int, before bigint, n_tokens bigint, doc_ids array<bigint>, blob binary"


class Codes:
    """Directly addressable codes of a sequence of unsigned 32-bit numbers."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ends: np.ndarray):
        self.levels, self.ends = levels, ends  # (chunks, bitmap, directory) a level; end of each document

    @classmethod
    def of(cls, values: np.ndarray, ends: np.ndarray) -> Codes:
        levels, rest = [], values.astype(np.uint32)
        while True:
            more = rest >= (1 << BITS)
            bitmap = np.packbits(more, bitorder="little")
            steps = np.add.reduceat(more, np.arange(0, len(more), EVERY), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            levels.append((rest.astype(np.uint8), bitmap, (np.cumsum(steps) - steps).astype("<u4")))
            if not more.any():
                return cls(levels, ends.astype("<u8"))
            rest = rest[more] >> BITS

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<IB", len(self.ends), len(self.levels)), self.ends.tobytes()]
        for chunks, bitmap, directory in self.levels:
            out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Codes:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_docs, n_levels = struct.unpack_from("<IB", raw, 4)
        at = 9
        ends = np.frombuffer(raw, "<u8", n_docs, at)
        at += ends.nbytes
        levels = []
        for _ in range(n_levels):
            n, = struct.unpack_from("<Q", raw, at)
            at += 8
            level = []
            for kind, count in (("u1", n), ("u1", (n + 7) // 8), ("<u4", (n + EVERY - 1) // EVERY)):
                level.append(np.frombuffer(raw, kind, count, at))
                at += level[-1].nbytes
            levels.append(tuple(level))
        return cls(levels, ends)

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before position ``i``."""
        chunks, bitmap, directory = self.levels[level]
        if i >= len(chunks):
            block = len(directory) - 1
        else:
            block = i // EVERY
        if block < 0:
            return 0
        bits = np.unpackbits(bitmap[block * EVERY // 8:(i + 7) // 8], bitorder="little")
        return int(directory[block]) + int(bits[:i - block * EVERY].sum())

    def __getitem__(self, i: int) -> int:
        """One id by its position: one chunk of each level that it has."""
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids at positions start to end: a slice of each level."""
        out = np.zeros(end - start, dtype=np.uint32)
        where = None
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if end <= start:
                break
            here = chunks[start:end].astype(np.uint32) << np.uint32(BITS * level)
            if where is None:
                out |= here
            else:
                out[where] |= here
            lead = start & 7
            more = np.unpackbits(bitmap[start >> 3:(end + 7) >> 3], bitorder="little")[lead:lead + end - start].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            start = self.rank(level, start)
            end = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class Ids:
    """Ids of texts with a .json file of the tokenizers library whose pieces
    never span white space; a string that repeats is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.settled = Tokenizer(self.tokenizer.model)  # for words that the normaliser leaves as they are
        self.settled.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.plain = Tokenizer(self.tokenizer.model)  # for those of ASCII letters, which stay whole and as they are
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # strings that the library finds in the raw text, before it folds case
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        pieces = self.tokenizer.get_vocab()
        self.finishes = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.finishes[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        # a word must give the same ids alone and between others
        probe = ["naïve", "Zoë's", "x1.", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|EndOfText|>b.", "end!!", "Zoë$$$", "a.)", "_b-c_",
                 "\u095f?", "\u09dd:", "q\u095d."]
        self.apart = (self.encode(" ".join(probe)) == b"".join(self.encode(p) for p in probe)
                      and self.encode("azAZ naive") == self.encode("azaz naive")
                      and not any(t.isalpha() for t in self.added)
                      and self.plain.encode("azaz naive").ids == self.tokenizer.encode("azaz naive", add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known = self.known
        plain = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
        self.together(self.plain, plain)
        words = [w for w in words if w not in known]
        low = [self.folded(w) if w.isascii() and not w.islower() else w for w in words]
        # a letter that normalising takes apart may leave a mark that joins the stop
        stems = [w.rstrip(STOPS) if w[-1] in STOPS and (w.isascii() or is_normalized("NFC", w)) else w for w in low]
        stems = [s if s[-1:].lower().isalnum() else w for s, w in zip(stems, low)]
        ends = [w[len(s):] for w, s in zip(low, stems)]
        new = list({*stems, *ends} - known.keys())
        letters = [w for w in new if w.isalpha()]
        self.together(self.plain, [w for w in letters if w.isascii()])
        self.together(self.settled, [w for w in letters if not w.isascii() and w == w.lower() and is_normalized("NFC", w)])
        rest = [w for w in new if w not in known]
        for w, enc in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            known[w] = np.array(enc.ids, dtype="<u4").tobytes()
        for w, s, e in zip(words, stems, ends):
            if w is not s:
                known[w] = known[s] + known[e]

    def folded(self, word: str) -> str:
        """An ASCII word in lower case; one that holds an added token, in any
        case, stays as it is."""
        low = word.lower()
        return word if any(t in low for t in self.added) else low

    def together(self, tokenizer, words: list[str]) -> None:
        """Words of letters as a few long strings: the pieces that finish a
        word tell them apart."""
        known = self.known
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for part, enc in zip(parts, tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(enc.ids, dtype="<u4")
            at = np.flatnonzero(self.finishes[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                raw, start = ids.tobytes(), 0
                for w, end in zip(part, (4 * at).tolist()):
                    known[w] = raw[start:end]
                    start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        if not self.apart:
            return [self.encode(t) for t in texts]
        if len(texts) == 1 and len(texts[0]) > LONG:
            return [b"".join([self.of_words([part])[0] for part in stretches(texts[0])])]
        return self.of_words(texts)

    def of_words(self, texts: list[str]) -> list[bytes]:
        """Each distinct word is looked up once (one of ASCII letters in lower
        case and without its stops); the ids of all places are then gathered
        from those of the distinct ones."""
        if not texts:
            return []
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        simple = pc.match_substring_regex(words.dictionary, SIMPLE)
        low = pc.if_else(simple, pc.ascii_lower(words.dictionary), words.dictionary)
        stems = pc.if_else(simple, pc.ascii_rtrim(low, STOPS), low)
        stops = pc.if_else(simple, pc.ascii_ltrim(low, LETTERS), "")
        units = pa.concat_arrays([stems, stops.cast(stems.type)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:  # the common words are among these
            self.known = {"": b""} | {w: self.known[w] for w in distinct if w in self.known}
        new = [w for w in distinct if w not in self.known]
        if new:
            self.learn(new)
        pieces = list(map(self.known.__getitem__, distinct))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        at = units.indices.to_numpy().reshape(2, -1)[:, words.indices.to_numpy()].T.ravel()  # stem, stops, stem, ...
        first, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(pieces), "<u4")[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        raw, places = ids.tobytes(), (4 * ends[2 * cut.offsets.to_numpy()]).tolist()
        return [raw[lo:hi] for lo, hi in zip(places, places[1:])]


def stretches(text: str) -> Iterator[str]:
    """A long text cut at white space, which no piece spans."""
    white, start = re.compile("[ \n]"), 0
    while (found := white.search(text, start + LONG)) is not None:
        yield text[start:found.start()]
        start = found.end()
    yield text[start:]


@lru_cache(maxsize=1)
def encoder(path: str) -> Ids:
    """One encoder a worker, so its tasks share the words it remembers."""
    return Ids(path)


def segments(tokenizer: str, end_id: int | None, segment_tokens: int = SEGMENT_TOKENS):
    """Body of the writing tasks: sorted (id, text) batches to segment rows."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        docs: list = []
        held: list[bytes] = []
        size = seg = before = 0

        def close():
            nonlocal docs, held, size, seg, before
            lengths = np.array([len(x) // 4 for x in held], dtype=np.int64)
            blob = Codes.of(np.frombuffer(b"".join(held), "<u4"), np.cumsum(lengths)).to_bytes()
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                names=["part", "seg", "before", "n_tokens", "doc_ids", "blob"])
            docs, held, before, seg, size = [], [], before + size, seg + 1, 0
            return row

        for batch in batches:
            ids, row = batch.column(0).to_pylist(), 0
            for texts in byte_groups(batch.column(1)):
                for raw in encode([x or "" for x in texts.to_pylist()]):
                    docs.append(ids[row])
                    held.append(raw + tail)
                    size += len(held[-1]) // 4
                    row += 1
                    if size >= segment_tokens:
                        yield close()
        if docs:
            yield close()
        del held
        trim()
    return run


def write(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id",
          text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the token ids of all texts, in ascending order of ``key``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]  # many texts of one id are spread over tasks; the sample holds no texts
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(segments(tokenizer, end_id, segment_tokens), SEGMENTS).write.parquet(path)


def places(spark: SparkSession, path: str) -> DataFrame:
    """All segments with ``start``, the number of tokens before each.  Only one
    number for each writing task is summed up in order and broadcast."""
    held = spark.read.schema(SEGMENTS).parquet(path)
    totals = held.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    return held.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("before"))


def read(spark: SparkSession, path: str, digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """(doc_id, start, ids): every document's ids, addressed in its segment.
    With ``digest``, a number made of a document's ids, (doc_id, start,
    n_tokens, digest): the ids then need not leave the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                codes = Codes.from_bytes(blob)
                at = [0, *codes.ends.tolist()]
                for lo in range(0, len(docs), 256):
                    hi = min(len(docs), lo + 256)
                    parts = [codes.document(k) for k in range(lo, hi)]
                    lengths = [len(p) for p in parts]
                    if digest is None:
                        found = {"ids": lists(np.concatenate(parts).astype(np.int32), lengths, pa.int32())}
                    else:
                        found = {"n_tokens": pa.array(lengths, pa.int64()),
                                 "digest": pa.array([digest(p) for p in parts], pa.int64())}
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(docs[lo:hi], pa.int64()),
                         "start": pa.array([start + x for x in at[lo:hi]], pa.int64())} | found)
        trim()
    out = "ids array<int>" if digest is None else "n_tokens bigint, digest bigint"
    return places(spark, path).select("start", "doc_ids", "blob").mapInArrow(run, f"doc_id bigint, start bigint, {out}")


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian words."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
