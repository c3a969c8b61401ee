"""CRC-32 of many byte spans at once from a table of position contributions.

CRC-32 is linear: the register after a message is the register that the start
value leaves after that many zero bytes, xor what each byte adds by its value
and its distance from the end.  A table holds these additions for distances
below ``BLOCK``; ``bitwise_xor.reduceat`` folds them over spans.  Longer spans
are cut in blocks from the end, a block a round for all spans; in very long ones
neighbouring blocks are joined pair by pair with a table that moves a register
over the zero bytes between them.
"""
from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 64
#: Bytes of spans whose additions are looked up together.
SLAB = 1 << 20
#: Spans of more blocks are folded one at a time, pair by pair.
ROUNDS = 64
#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = np.uint32(0xEDB88320)
ONES = np.uint32(0xFFFFFFFF)


def one_zero_byte(reg: np.ndarray) -> np.ndarray:
    """Registers moved over one zero byte."""
    for _ in range(8):
        reg = (reg >> np.uint32(1)) ^ (POLYNOMIAL * (reg & np.uint32(1)))
    return reg


@cache
def additions() -> np.ndarray:
    """Flat table: entry 256 * distance + byte."""
    rows = [one_zero_byte(np.arange(256, dtype=np.uint32))]
    for _ in range(BLOCK - 1):
        rows.append(one_zero_byte(rows[-1]))
    return np.concatenate(rows)


@cache
def starts() -> np.ndarray:
    """The start value after 0 to BLOCK zero bytes."""
    regs = [np.array([ONES])]
    for _ in range(BLOCK):
        regs.append(one_zero_byte(regs[-1]))
    return np.concatenate(regs)


def moved(reg: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Registers moved by a table (4, 256) of what each of their bytes becomes."""
    return (over[0][reg & np.uint32(255)] ^ over[1][(reg >> np.uint32(8)) & np.uint32(255)]
            ^ over[2][(reg >> np.uint32(16)) & np.uint32(255)] ^ over[3][reg >> np.uint32(24)])


@cache
def over_blocks(doublings: int) -> np.ndarray:
    """Table that moves registers over BLOCK * 2^doublings zero bytes."""
    if doublings:
        half = over_blocks(doublings - 1)
        return moved(half, half)
    reg = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(BLOCK):
        reg = one_zero_byte(reg)
    return reg


def long_span(part: np.ndarray) -> np.uint32:
    """CRC-32 of one span of any length."""
    head = len(part) % BLOCK
    reg = starts()[head] ^ (np.bitwise_xor.reduce(additions()[256 * np.arange(head - 1, -1, -1) + part[:head]]) if head else np.uint32(0))
    at = 256 * np.arange(BLOCK - 1, -1, -1)
    for lo in range(head, len(part), SLAB):
        blocks = np.bitwise_xor.reduce(additions()[at + part[lo:lo + SLAB].reshape(-1, BLOCK)], axis=1)
        # full halves fold pair by pair; the register enters the first block
        n, step = len(blocks), 0
        while n:
            if n >> step & 1:
                size = 1 << step
                own = blocks[:size]
                for level in range(step):
                    own = moved(own[0::2], over_blocks(level)) ^ own[1::2]
                reg = moved(np.array([reg]), over_blocks(step))[0] ^ own[0]
                blocks, n = blocks[size:], n - size
            step += 1
    return reg ^ ONES


def folded(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What the bytes of spans of at most BLOCK bytes add (0 if empty)."""
    out = np.zeros(len(start), dtype=np.uint32)
    some = np.flatnonzero(size)
    held = np.cumsum(size[some])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(held, (held[lo - 1] if lo else 0) + SLAB, side="right")))
        own = some[lo:hi]
        last = np.cumsum(size[own])
        at = np.arange(last[-1])
        first = last - size[own]
        distance = np.repeat(last - 1, size[own]) - at
        place = at + np.repeat(start[own] - first, size[own])
        out[own] = np.bitwise_xor.reduceat(additions()[256 * distance + data[place]], first)
        lo = hi
    return out


def of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 (uint32) of data[start:end] of every span; spans may overlap and
    be empty.  All spans take their first bytes, then a block a round."""
    length = end - start
    huge = length > ROUNDS * BLOCK
    head = np.where(length <= BLOCK, length, length % BLOCK)
    head[huge] = 0
    blocks = (length - head) // BLOCK
    blocks[huge] = 0
    reg = starts()[head] ^ folded(data, start, head)
    for r in range(int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > r)
        reg[own] = moved(reg[own], over_blocks(0)) ^ folded(data, start[own] + head[own] + r * BLOCK, np.full(len(own), BLOCK))
    reg ^= ONES
    for i in np.flatnonzero(huge):
        reg[i] = long_span(data[start[i]:end[i]])
    return reg
