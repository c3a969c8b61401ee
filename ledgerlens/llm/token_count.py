"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts reach the tokenizer in groups of about equal bytes.  Each text is split
at safe boundaries - between a word and the white space before the next one,
or between a letter or digit and a stop, where byte-level pre-tokenization
always starts a new piece - so a long text is many short strings, and a string that repeats within a worker is encoded
once.  Texts that hold special strings are first split around these, as the
library does.

Cases: null and empty texts count 0; a text without a boundary is one string;
equal rows give equal counts; an empty table gives an empty table.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts

#: White space as the pre-tokenizer's pattern counts it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Marks that stand apart when they follow a letter or digit.
STOPS = ".,;:!?"
#: Strings a worker remembers; it forgets them all beyond this many.
REMEMBERED = 600_000
#: Strings handed to the library at once, and words joined to one string.
BATCH, JOINED = 20_000, 1_000
#: Fixed value: how a byte-level vocabulary writes a space.
SPACED = "\u0120"


class Counter:
    """Counts tokens of groups of texts with a byte-level BPE .json file."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path) as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        plain = [t for t in spec["added_tokens"] if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.safe = (spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"]
                     and not pre["add_prefix_space"] and len(plain) == len(spec["added_tokens"]))
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.around = re.compile("|".join(re.escape(s) for s in self.special)).split if self.special else None
        self.units = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        pieces = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.begins[[i for p, i in pieces.items() if p[0] == SPACED]] = True
        self.rare = [*WHITE.replace(" ", "").replace("\n", ""), "\0"]
        self.plain_not = {"", "\0", *WHITE}
        self.known: dict[str, int] = {}
        self.bare: dict[str, int] = {"": 0}

    def cut(self, text: str) -> list[str]:
        """Strings whose token counts add up to the text's."""
        if not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in WHITE
                or text[-1:] in WHITE or any(c in text for c in self.rare)):
            # single spaces and line ends only: the same cuts by replace and
            # split; a string stands for itself with the space before it
            units = text.replace("\n", " \n").split(" ")
            units[0] = "\0" + units[0]
            return units
        return [u[1:] if u[0] == " " and u[1:2] not in self.plain_not else "\0" + u for u in self.units(text)]

    def encode(self, units: list[str]) -> None:
        """Counts of new strings; a stop after a letter or digit counts apart."""
        whole = [u if u[:1] == "\n" else u[1:] if u[:1] == "\0" else " " + u for u in units]
        apart = [u[-1] if u[-1] in STOPS and u[-2:-1].isalnum() else "" for u in whole]
        bare = [u[:len(u) - len(a)] for u, a in zip(whole, apart)]
        count = self.bare
        every = list({*bare, *apart} - count.keys())
        words = [u for u in every if u[0] == " " and u[1:].isalpha()]
        for i in range(0, len(words), BATCH):
            self.together(words[i:i + BATCH])
        every = [u for u in every if u not in count]
        for i in range(0, len(every), BATCH):
            part = every[i:i + BATCH]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            count.update(zip(part, map(len, found)))
        for u, b, a in zip(units, bare, apart):
            self.known[u] = count[b] + count[a]

    def together(self, words: list[str]) -> None:
        """Words of letters, each after a space, as a few long strings: the
        pieces that begin with a space tell them apart."""
        parts = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts],
                                                                       add_special_tokens=False)):
            starts = np.flatnonzero(self.begins[np.array(found.ids, dtype=np.int64)])
            if len(starts) == len(part) and starts[0] == 0:
                self.bare.update(zip(part, np.diff(starts, append=len(found.ids)).tolist()))

    def __call__(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for t in texts:
            more = 0
            if not self.safe:
                units = ["\0" + t] if t else []
            elif self.special and any(s in t for s in self.special):
                parts = self.around(t)
                units, more = [u for p in parts for u in self.cut(p)], len(parts) - 1
            else:
                units = self.cut(t)
            cut.append(units)
            extra.append(more)
        if len(self.known) > REMEMBERED:
            self.known, self.bare = {}, {"": 0}
        new = list(set().union(*cut) - self.known.keys()) if cut else []
        if new:
            self.encode(new)
        get = self.known.__getitem__
        return [sum(map(get, units)) + more for units, more in zip(cut, extra)]


def count_udf(path: str):
    """Arrow function string -> number of tokens."""
    def make():
        count = Counter(path)
        return lambda texts: pa.array(count(texts), type=pa.int64())
    body = over_texts(make)

    def run(batches):
        yield from body(batches)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "bigint")


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of ``text``; a column named ``out`` is replaced."""
    return df.withColumn(out, count_udf(tokenizer)(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
