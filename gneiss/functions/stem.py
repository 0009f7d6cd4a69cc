"""Porter's stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980) over arrays of tokens.

Words of fewer than three characters and those with anything but a-z stay as they are, as in full-text indexes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import text as X

# The suffixes of the published steps 2, 3 and 4.
STEP2 = dict(
    x.split(":")
    for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log bli:ble"
    ).split()
)
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_PLAIN = re.compile(r"[a-z]{3,}\Z")


def _shape(w: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            return head + table[suffix] if _measure(head) > 0 else w
    return w


@lru_cache(maxsize=1 << 17)
def stem(w: str) -> str:
    if not _PLAIN.match(w):
        return w
    # 1a: plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past and progressive forms
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            head = w.removesuffix(suffix)
            if head != w and "v" in _shape(head):
                if head.endswith(("at", "bl", "iz")):
                    head += "e"
                elif len(head) > 1 and head[-1] == head[-2] and _shape(head)[-1] == "c" and head[-1] not in "lsz":
                    head = head[:-1]
                elif _measure(head) == 1 and _short_end(head):
                    head += "e"
                w = head
                break
    # 1c: a final y
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    # 5: a final e, a double l
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(tokens: Column) -> Column:
    """Each token of an array by its stem; Arrow batches, every distinct token of a batch is stemmed once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        known = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        n = [0, *(len(x) if x is not None else 0 for x in lists)]
        ends = pa.array([sum_ for sum_ in _running(n)], pa.int32())
        return pa.ListArray.from_arrays(ends, known.take(flat.indices))

    return run(tokens)


def _running(n: list[int]):
    total = 0
    for x in n:
        total += x
        yield total


def tokens(c: Column) -> Column:
    return stems(X.tokens(c))


def search_terms(c: Column, most: int = 16) -> Column:
    return stems(X.search_terms(c, most))
