"""BLAKE3 (hash mode, 32 bytes), written from the published specification."""

from __future__ import annotations

import struct

#: Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, MASK = 64, 1024, 0xFFFFFFFF
COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15))
DIAGONALS = ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple[int, ...], words: tuple[int, ...], counter: int, size: int, flags: int) -> list[int]:
    v = [*cv, *IV[:4], counter & MASK, counter >> 32, size, flags]
    m = list(words)
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(COLUMNS + DIAGONALS):
            for x, down, up in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & MASK
                t = v[d] ^ v[a]
                v[d] = (t >> down | t << (32 - down)) & MASK
                v[c] = (v[c] + v[d]) & MASK
                t = v[b] ^ v[c]
                v[b] = (t >> up | t << (32 - up)) & MASK
        if turn < 6:
            m = [m[i] for i in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _words(block: bytes) -> tuple[int, ...]:
    return struct.unpack("<16I", block.ljust(BLOCK, b"\0"))


def _chunk(data: bytes, counter: int) -> tuple:
    """What the last compression of a chunk needs."""
    cv, blocks = IV, max(1, -(-len(data) // BLOCK))
    for i in range(blocks):
        block = data[i * BLOCK : (i + 1) * BLOCK]
        node = (cv, _words(block), counter, len(block), (CHUNK_START if i == 0 else 0) | (CHUNK_END if i == blocks - 1 else 0))
        if i < blocks - 1:
            cv = tuple(_compress(*node))
    return node


def _tree(data: bytes, counter: int) -> tuple:
    if len(data) <= CHUNK:
        return _chunk(data, counter)
    # the left part has the largest power of two of chunks that leaves something on the right
    left = CHUNK << ((len(data) - 1) // CHUNK).bit_length() - 1
    halves = (_compress(*_tree(data[:left], counter)), _compress(*_tree(data[left:], counter + left // CHUNK)))
    return (IV, tuple(halves[0] + halves[1]), 0, BLOCK, PARENT)


def blake3_hex(data: bytes) -> str:
    cv, words, counter, size, flags = _tree(data, 0)
    return struct.pack("<8I", *_compress(cv, words, counter, size, flags | ROOT)).hex()
