"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut at places no vocabulary piece spans (before a run of spaces,
around characters that stand in no longer piece), and each distinct unit of a
group of texts is encoded once.  All units lie in flat numpy arrays: a symbol
id and the rank of the pair it starts.  A round takes each unit's smallest
pair rank (``minimum.reduceat``), merges its leftmost occurrences in all
units at once, compacts the arrays and looks up only the pairs next to a
merge; a unit leaves when no pair of it is in the vocabulary.

Merging every occurrence of a rank at once equals one-at-a-time merging only
if no new pair can rank before it.  Ranks for which the vocabulary has such a
pair are found when it is loaded; they merge one leftmost occurrence a round.

Cases: null and empty texts give no ids and decode to ''; characters outside
the vocabulary become byte pieces; texts of any length are taken whole; equal
rows give equal results; an empty table gives an empty table.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, over_texts, trim

SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
#: Distinct units a worker remembers; beyond, those of the texts at hand.
REMEMBERED = 250_000
#: Texts decoded at once.
ROWS = 512


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        sp = SentencePieceProcessor(model_file=path)
        proto.ParseFromString(sp.serialized_model_proto())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.escape_whitespaces \
                or norm.remove_extra_whitespaces or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("needs a BPE model with byte pieces and no text normalisation")
        kinds = [p.type for p in proto.pieces]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.size = len(kinds)
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.id_byte = {i: b for b, i in enumerate(self.byte_id)}
        self.special = {i for i, k in enumerate(kinds) if k in (2, 3)}
        self.last_special = max(self.special)
        self.unknown = proto.trainer_spec.unk_surface
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.char_id = {c: i for c, i in normal.items() if len(c) == 1}
        scores = np.array([p.score for p in proto.pieces], dtype=np.float64)
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        def symbol(s):
            return normal.get(s) if len(s) > 1 else self.symbol(s)

        keys, ids, late = [], [], set()
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                for part in (left, right):
                    if part is not None and part < self.size and len(self.pieces[part]) > 1 and rank[part] >= rank[i]:
                        late.add(int(rank[part]))
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    ids.append(i)
        self.rank = np.append(rank, NO_PAIR).astype(np.int32)
        self.fill(np.array(keys, dtype=np.int64), np.array(ids, dtype=np.int32))
        self.char_symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for c, i in self.char_id.items():
            self.char_symbol[ord(c)] = i
        self.one_at_a_time = np.zeros(int(rank.max()) + 2, dtype=bool)
        self.one_at_a_time[list(late)] = True
        # places where a text may be cut: no piece has them inside
        long = [p for p in normal if len(p) > 1]
        space = not any(a != SPACE and b == SPACE for p in long for a, b in zip(p, p[1:]))
        line = not any("\n" in p for p in long)
        self.units = re.compile(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if space and line
                                else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if space else "(?s).+").findall
        self.plain_cut = space and line and self.prefix
        self.surface = [b"" if i in self.special and i != 0 else self.unknown.encode() if i == 0
                        else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def cut(self, text: str) -> list[str]:
        """Units whose encodings, one after the other, are the text's."""
        if not text:
            return []
        if self.plain_cut and text[0] != " " and "  " not in text and SPACE not in text:
            # the same units by one replace and split: a word stands for itself
            # with the space before it, "\nword" for itself without one
            return text.replace("\n", " \n").split(" ")
        units = self.units((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        return [u[1:] if u[0] == SPACE else u for u in units] if self.plain_cut else units

    def symbol(self, char: str) -> int:
        """Id of a character; those outside the vocabulary follow after it."""
        return self.char_id.get(char, self.size + ord(char))

    def fill(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Hash table of the pairs, a sixteenth full, with linear probing."""
        self.bits = max(8, int(16 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << self.bits, self.size, dtype=np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[free]  # of keys that meet, the last stays
            mine = self.slot_key[at] == keys
            self.slot_id[at[mine]] = ids[mine]
            keys, ids, at = keys[~mine], ids[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair merges to; ``size`` where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        at = self.slot(keys)
        there = self.slot_key[at]
        out = np.where(there == keys, self.slot_id[at], np.int32(self.size))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.slot_key[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.slot_id[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_rounds(v: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all units (flat) and their number in each unit."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    sym = v.char_symbol[codes]
    unit = np.repeat(np.arange(len(units), dtype=np.int32), [len(u) for u in units])
    last = np.append(unit[1:] != unit[:-1], True)
    pair = np.full(len(sym), v.size, dtype=np.int32)
    inner = np.flatnonzero(~last)
    pair[inner] = v.pairs(sym[inner], sym[inner + 1])
    done_unit, done_sym = [], []
    while len(sym):
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        rank = v.rank[pair]
        least = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(sym)))
        ended = least == NO_PAIR
        if ended.any():  # these units are final
            gone = np.repeat(ended, lengths)
            done_unit.append(unit[gone])
            done_sym.append(sym[gone])
            stay = ~gone
            sym, unit, pair, rank = sym[stay], unit[stay], pair[stay], rank[stay]
            least, lengths = least[~ended], lengths[~ended]
            if not len(sym):
                break
        of = np.repeat(least, lengths)
        at = np.flatnonzero(rank == of)
        head = np.append(True, unit[at[1:]] != unit[at[:-1]])
        # leftmost occurrences: of those that overlap in a row, every other one
        run = np.append(True, np.diff(at) != 1)
        first = at[run][np.cumsum(run) - 1]
        take = ((at - first) & 1 == 0) & (head | ~v.one_at_a_time[of[at]])
        at = at[take]
        sym[at] = pair[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        changed = np.zeros(len(sym) + 1, dtype=bool)
        changed[at] = True
        sym, unit, pair = sym[keep], unit[keep], pair[keep]
        changed = changed[:-1][keep]
        changed[:-1] |= changed[1:]
        look = np.flatnonzero(changed)
        ends = np.append(unit[1:] != unit[:-1], True)[look]
        pair[look[ends]] = v.size
        look = look[~ends]
        pair[look] = v.pairs(sym[look], sym[look + 1])
    if not done_unit:
        return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
    of, flat = np.concatenate(done_unit), np.concatenate(done_sym)
    return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(units))


class Encoder:
    """Encodes groups of texts; remembers the units it has merged."""

    def __init__(self, path: str):
        self.v = load(path)
        self.known: dict[str, bytes] = {}

    def learn(self, units: list[str]) -> None:
        v = self.v
        flat, counts = merge_rounds(v, [u if u[:1] == "\n" else SPACE + u for u in units] if v.plain_cut else units)
        odd = np.flatnonzero(flat >= v.size)
        if len(odd):  # characters outside the vocabulary: their bytes
            raw = [chr(c).encode("utf-8", "replace") for c in (flat[odd] - v.size).tolist()]
            width = np.ones(len(flat), dtype=np.int64)
            width[odd] = [len(r) for r in raw]
            of = np.repeat(np.arange(len(units)), counts)
            counts = np.bincount(of, weights=width, minlength=len(units)).astype(np.int64)
            foreign = np.repeat(flat >= v.size, width)
            flat = np.repeat(flat, width)
            flat[foreign] = np.array(v.byte_id, dtype=np.int32)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        raw = flat.astype("<i4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        start = 0
        for u, end in zip(units, ends):
            self.known[u] = raw[start:end]
            start = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32 bytes."""
        v = self.v
        cut = [v.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            here = set().union(*cut)  # the common units are among these
            self.known = {u: self.known[u] for u in here if u in self.known}
        new = list(set().union(*cut) - self.known.keys()) if cut else []
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in cut]


class Decoder:
    """Text of a list of ids: spaces restored, one leading space taken off,
    byte pieces joined to characters (bytes that form none: U+FFFD each)."""

    def __init__(self, path: str):
        self.v = v = load(path)
        # byte pieces stand as themselves; control pieces give nothing
        self.plain = [bytes([v.id_byte[i]]) if i in v.id_byte else s for i, s in enumerate(v.surface)]

    def __call__(self, ids: np.ndarray) -> str:
        v = self.v
        if len(ids) == 0:
            return ""
        listed = ids.tolist()
        if ids.min() <= v.last_special:
            return self.mend(listed)
        raw = b"".join([self.plain[i] for i in listed])
        if v.prefix and v.pieces[listed[0]].startswith(SPACE) and listed[0] not in v.id_byte:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return self.mend(listed)

    def mend(self, ids: list[int]) -> str:
        """Runs of byte pieces that are not whole characters."""
        v, out, held, stripped = self.v, [], bytearray(), not self.v.prefix

        def flush():
            i = 0
            while i < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[i:i + n]).decode("utf-8"))
                        i += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or i + n >= len(held):
                            out.append("�")
                            i += 1
                            break
            held.clear()

        for i in ids:
            if i in v.id_byte:
                held.append(v.id_byte[i])
                stripped = True
                continue
            flush()
            piece = v.surface[i].decode()
            if i in v.special and i != 0:
                continue
            if not stripped and i != 0 and piece.startswith(" "):
                piece = piece[1:]
            stripped = True
            out.append(piece)
        flush()
        return "".join(out)


def encode_udf(path: str):
    """Arrow function string -> array<int> of piece ids."""
    def make():
        encode = Encoder(path)

        def work(texts):
            found = encode(texts)
            return lists(np.frombuffer(b"".join(found), dtype=np.int32), [len(x) // 4 for x in found], pa.int32())
        return work
    body = over_texts(make)

    def run(batches):
        yield from body(batches)
    from collections.abc import Iterator
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")


def decode_udf(path: str):
    """Arrow function array<int> of piece ids -> string."""
    from collections.abc import Iterator

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = Decoder(path)
        for col in batches:
            offsets, flat, parts = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False), []
            for lo in range(0, len(col), ROWS):
                at = offsets[lo:lo + ROWS + 1].tolist()
                parts.append(pa.array([decode(flat[a:b]) for a, b in zip(at, at[1:])], type=pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        trim()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the piece ids of ``text``; a column named ``out`` is replaced."""
    return df.withColumn(out, encode_udf(model)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` (null: ''); a column named ``out`` is replaced."""
    return df.withColumn(out, decode_udf(model)(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))))
