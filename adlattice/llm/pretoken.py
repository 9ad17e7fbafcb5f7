"""Splitting by the pattern of the public rank files, for whole chunks at once.

The pattern, ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, cuts text into runs of one
kind (letters, numbers, other, white space). A plain space before a run belongs to it, the rest of the white space
stands alone, and an apostrophe that is a run of its own takes its ending along.
"""

from __future__ import annotations

import functools

import numpy as np

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
#: The endings of the pattern.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _points() -> str:
    return "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))


def _matched_by_tiktoken(pattern: str) -> str:
    import tiktoken

    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return plain.decode(plain.encode_ordinary(_points()))


def _matched_by_tokenizers(pattern: str) -> str:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return "".join(piece for piece, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(_points()))


@functools.lru_cache(maxsize=2)
def kinds(library: str) -> np.ndarray:
    """The kind of every code point, as the named library ("tiktoken" or "tokenizers") sees it.

    The libraries know different versions of Unicode, so each is asked itself.
    """
    matched = {"tiktoken": _matched_by_tiktoken, "tokenizers": _matched_by_tokenizers}[library]
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        table[np.frombuffer(matched(pattern).encode("utf-32-le"), np.uint32)] = kind
    return table


def byte_kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kind of every byte; the bytes of a character share its kind."""
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        point = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def split(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Start of every pre-token of a chunk, in order; a token ends where the next one starts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = byte_kinds(data, table)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    edge[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= edge[:n]
    starts = change.copy()
    # The last white space of a run that something follows: a plain space opens the next token, any other stands alone.
    run = np.flatnonzero(change & (kind != BLANK) & ~edge[:n])
    run = run[kind[run - 1] == BLANK]
    back = run - 1
    while True:  # to the first byte of that character
        inner = (data[back] & 0xC0) == 0x80
        if not inner.any():
            break
        back[inner] -= 1
    starts[back] = True
    starts[run[data[back] == 32]] = False
    # Endings: an apostrophe that is a whole run, not opened by a space, before fitting letters of the same text.
    quote = np.flatnonzero((data == 39) & starts)
    quote = quote[quote + 1 < n]
    quote = quote[change[quote + 1] & (kind[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        text_end = off[np.searchsorted(off, quote, "right")]
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        one, two = padded[quote + 1], padded[quote + 2]
        single = np.isin(one, [ord(e) for e in ENDINGS if len(e) == 1])
        double = np.zeros(len(quote), bool)
        for e in ENDINGS:
            if len(e) == 2:
                double |= (one == ord(e[0])) & (two == ord(e[1])) & (quote + 2 < text_end)
        took = np.where(single, 1, np.where(double, 2, 0))
        quote, took, text_end = quote[took > 0], took[took > 0], text_end[took > 0]
        starts[quote + 1] = False
        after = quote + 1 + took
        inside = after < text_end
        starts[after[inside]] = True
    return np.flatnonzero(starts)
