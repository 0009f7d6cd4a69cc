"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words; decoding joins binary pieces."""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm._store import discard, materialise, table, tune

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most frequent words of the corpus whose ids are folded once and sent to every task: this bounds what goes through the driver.
FREQUENT = 1 << 19
#: Of those, the ones that a worker keeps in a dictionary; the others are found in arrays.
HOT = 1 << 16
#: Marks a place among the ids for those of a word that has none yet.
HOLE = 1 << 31
#: Distinct words that a task sums up before it sends its counts.
COUNTED = 1 << 18
#: Bytes of a word that the fold takes; its work grows with the square of a word's length, so longer ones are merged by a heap.
FOLD_BYTES, FREQUENT_BYTES = 256, 64
#: Between the entries of a literal.
SEPARATOR = ","


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary: piece to rank, which is its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Lookup:
    """A map from strings to their numbers as a literal of the plan: a perfect hash whose hits are compared with the key.

    A key's slot is the top of its hash, changed by what its bucket (the low end of the hash) holds; the slot names the only key that may
    stand there.  ``literal`` is one struct; bind it once (``bound``) and give the bound one to ``number``.
    """

    def __init__(self, keys: Sequence[str | None]):
        self.bits, self.low = max(4, len(keys).bit_length() + 1), max(2, len(keys).bit_length() - 1)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            if k is not None:
                h = xxhash.xxh64_intdigest(k.encode(), 42)
                buckets.setdefault(h & ((1 << self.low) - 1), []).append((h >> (64 - self.bits), i))
        slots, change = [-1] * (1 << self.bits), [0] * (1 << self.low)
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            tops = [h for h, _ in own]
            if len(set(tops)) < len(tops):
                raise ValueError("two keys have one hash")
            change[b] = next(d for d in range(1 << self.bits) if all(slots[h ^ d] < 0 for h in tops))
            for h, i in own:
                slots[h ^ change[b]] = i
        listed = {"key": ["" if k is None else k for k in keys], "slot": slots, "change": change}
        # split() and cast() of a string are computed once, by the optimizer; an array of so many literals would be parsed one by one
        self.literal = F.struct(*((x if isinstance(v[0], str) else x.cast("array<int>")).alias(n) for n, v in listed.items() for x in [F.split(F.lit(SEPARATOR.join(map(str, v))), F.lit(SEPARATOR))]))

    def number(self, of: Column, key: Column) -> Column:
        """The number of key, or null."""
        h = F.xxhash64(key)
        slot = F.shiftrightunsigned(h, 64 - self.bits).bitwiseXOR(F.get(of.change, h.bitwiseAND((1 << self.low) - 1).cast("int")).cast("long"))
        return F.get(F.filter(F.array(F.get(of.slot, slot.cast("int"))), lambda i: F.get(of.key, i).eqNullSafe(key)), F.lit(0))


def bound(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """body of value, which is computed once; kind is the type of the result.

    An element of transform() would do as well, but for each row it asks the type and nullability of the whole body anew.
    """
    none = F.array().cast(kind) if kind.startswith("array") else F.lit(0).cast(kind)
    return F.aggregate(F.array(value), none, lambda _, x: body(x))


class Pairs:
    """The pairs of pieces that the vocabulary joins, as a literal of the plan: a perfect hash from two ids to the id of the joined piece.

    What stands in a key's slot is the key and the joined id; exclusive or with the key leaves the id, or a number over all ids if the
    slot is another key's.  ``literal`` is one struct; bind it once (``bound``) and give the bound one to ``fold``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        end = max(ranks.values()) + 1  # stands before the first piece and after the last
        self.end, self.width = end, end.bit_length()
        self.none, self.at = 1 << self.width, 61 - self.width
        joined = {a << self.width | b: r for w, r in ranks.items() for i in range(1, len(w)) if (a := ranks.get(w[:i])) is not None and (b := ranks.get(w[i:])) is not None}
        self.bits, self.low = max(4, len(joined).bit_length() + 1), max(2, len(joined).bit_length() - 2)
        while (built := self._slots(joined)) is None:
            self.bits += 1
        slots, change = built
        single = [ranks[bytes([i])] for i in range(256)]
        listed = {"slot": (slots, "array<bigint>"), "change": (change, "array<int>"), "byte": (single, "array<bigint>")}
        self.literal = F.struct(*(F.split(F.lit(SEPARATOR.join(map(str, v))), F.lit(SEPARATOR)).cast(t).alias(n) for n, (v, t) in listed.items()))

    def _slots(self, joined: dict[int, int]) -> tuple[list[int], list[int]] | None:
        buckets: dict[int, list[tuple[int, int]]] = {}
        for k in joined:
            h = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)
            buckets.setdefault(h & ((1 << self.low) - 1), []).append((h >> (64 - self.bits), k))
        taken, change = [-1] * (1 << self.bits), [0] * (1 << self.low)
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            tops = [h for h, _ in own]
            d = None if len(set(tops)) < len(tops) else next((d for d in range(1 << self.bits) if all(taken[h ^ d] < 0 for h in tops)), None)
            if d is None:
                return None
            change[b] = d
            for h, k in own:
                taken[h ^ d] = k << self.width | joined[k]
        return [1 << 62 if x < 0 else x for x in taken], change

    def _rank(self, of: Column, a: Column, b: Column) -> Column:
        """The id of a and b joined, or none."""

        def found(k: Column, h: Column) -> Column:
            slot = F.shiftrightunsigned(h, 64 - self.bits).cast("int").bitwiseXOR(F.get(of.change, h.bitwiseAND(_long((1 << self.low) - 1)).cast("int")))
            return F.least(F.get(of.slot, slot).bitwiseXOR(F.shiftleft(k, self.width)), _long(self.none))

        return bound(F.shiftleft(a, self.width).bitwiseOR(b), lambda k: bound(F.xxhash64(k), lambda h: found(k, h), "long"), "long")

    def fold(self, of: Column, word: Column) -> Column:
        """Ids of one word: the adjacent pair of lowest rank, the first of equals, is merged until none is left.

        The state is one number for each piece: the rank of the piece joined to the next, the piece's place and its id, from high bits to
        low, so the least one is the next to merge.
        """
        at, piece, low = self.at, _long((1 << self.width) - 1), _long((1 << self.at) - 1)
        place, many, few = _long((1 << self.at) - (1 << self.width)), "array<bigint>", "array<int>"

        def step(s: Column) -> Column:
            def merge(m: Column) -> Column:
                def put(i: Column) -> Column:
                    new, left = F.shiftright(m, at), F.get(s, i - 2)
                    before = F.shiftleft(self._rank(of, left.bitwiseAND(piece), new), at).bitwiseOR(left.bitwiseAND(low))
                    here = F.shiftleft(self._rank(of, new, F.get(s, i + 1).bitwiseAND(piece)), at).bitwiseOR(m.bitwiseAND(place)).bitwiseOR(new)
                    return F.flatten(F.array(F.slice(s, F.lit(1), i - 2), F.array(before, here), F.slice(s, i + 2, F.size(s))))

                # array_position() leaves its loop by an exception, which takes longer
                return bound(F.size(F.filter(s, lambda x: x.bitwiseAND(place) <= m.bitwiseAND(place))), put, many)

            return bound(F.array_min(s), lambda m: F.when(m >= _long(self.none << at), s).otherwise(merge(m)), many)

        def start(ids: Column) -> Column:
            return F.transform(ids, lambda x, i: F.shiftleft(self._rank(of, x, F.get(ids, i + 1)), at).bitwiseOR(F.shiftleft(i.cast("long"), self.width)).bitwiseOR(x))

        single = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(of.byte, F.ascii(c)))
        ids = F.concat(F.array(_long(self.end)), single, F.array(_long(self.end)))
        merged = bound(ids, lambda ids: F.aggregate(F.sequence(F.lit(4), F.size(ids)), start(ids), lambda s, _: step(s)), many)
        out = bound(merged, lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), lambda x: x.bitwiseAND(piece).cast("int")), few)
        return F.when(word == "", F.array().cast(few)).otherwise(out)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word, in time proportional to its length and the logarithm of it."""
    return [ranks[word]] if word in ranks else _merged(word, ranks)


def _merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, to = heapq.heappop(heap)
        j = end[i]
        if gone[i] or j >= n or end[j] != to:
            continue
        gone[j], end[i] = True, to
        if to < n:
            left[to] = i
            if (r := ranks.get(word[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (k := left[i]) >= 0 and (r := ranks.get(word[k:to])) is not None:
            heapq.heappush(heap, (r, k, to))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def _ranges(found: Iterable[int]) -> str:
    out: list[list[int]] = []
    for c in sorted(found):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def pattern() -> tuple[str, str, int]:
    """The pattern of the vocabulary's words, the same with its classes mended, and the first character for which they differ.

    ``regex`` and the library have different Unicode versions.  The library is asked for the class of every character: one that follows
    a letter without a cut is a letter, and so on.
    """
    import public_tokenizers
    import regex
    import tiktoken

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]

    def follows(lead: str) -> set[int]:
        own = {bytes([i]): i for i in range(256)} | {lead.encode() + bytes([i]): 256 + i for i in range(256)}
        asked = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
        return {c for c in points if asked.encode_ordinary(lead + chr(c))[0] >= 256}

    letters, numbers = follows("a"), follows("1")
    blanks = set(points) - letters - numbers - follows(".")
    plain = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    mended, first, every = "(?V1)" + plain.replace(r"\P{White_Space}", r"[^\p{White_Space}]"), 0x110000, "".join(map(chr, points))
    for name, want in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\p{White_Space}", blanks)):
        have = set(map(ord, "".join(regex.findall(f"{name}+", every))))
        own = f"[[{name}--[{_ranges(have - want)}]]{_ranges(want - have)}]" if have - want else f"[{name}{_ranges(want - have)}]"
        mended, first = mended.replace(name, own), min(have ^ want, default=first) if have ^ want and min(have ^ want) < first else first
    return plain, mended, first


@cache
def _finder(words: tuple[str, str, int]) -> Callable[[str], list[str]]:
    """The words of a text.

    The standard library's expressions take about half of the time of ``regex`` and have no classes of characters, so texts of the first
    256 characters are matched by lists of those.
    """
    import re

    import public_tokenizers
    import regex

    plain, mended, first = words
    usual, exact, rare = regex.compile(plain).findall, regex.compile(mended).findall, re.compile(f"[\\U{min(first, 0x10FFFF):08x}-\\U0010ffff]").search

    def wide(t: str) -> list[str]:
        return exact(t) if rare(t) else usual(t)

    letters, numbers, blanks = (_ranges(c for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    own = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    for k, have in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{blanks}]"), (r"\S", f"[^{blanks}]")):
        own = own.replace(k, have)
    if first < 256 or "\\p" in own:
        return wide
    latin = re.compile(own).findall

    def find(t: str) -> list[str]:
        if not t.isascii():
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                return wide(t)
        return latin(t)

    return find


@cache
def _unreached(path: str) -> frozenset[bytes]:
    """Pieces that merges don't make of their bytes; only a whole word is such a one."""
    ranks = ranks_of(path)
    return frozenset(w for w, r in ranks.items() if _merged(w, ranks) != [r])


class Encoder:
    """The vocabulary: its path for the tasks, and its pairs as a literal of a plan."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.path, self.pattern = _path(vocabulary), pattern()
        self.pairs = Pairs(ranks_of(self.path))
        odd = {ranks_of(self.path)[w]: w for w in _unreached(self.path)}
        self.whole = Lookup([odd[i].hex().upper() if i in odd else None for i in range(max(odd) + 1)]) if odd else None

    def fold(self, words: Column) -> Column:
        """Ids of each word of an array."""
        kind = "array<array<int>>"
        if self.whole is None:
            return bound(self.pairs.literal, lambda of: F.transform(words, lambda w: self.pairs.fold(of, w)), kind)

        def one(of: Column, listed: Column, w: Column) -> Column:
            number = self.whole.number(listed, F.hex(F.encode(w, "UTF-8")))
            return bound(F.coalesce(number, F.lit(-1)), lambda i: F.when(i >= 0, F.array(i)).otherwise(self.pairs.fold(of, w)), "array<int>")

        return bound(self.pairs.literal, lambda of: bound(self.whole.literal, lambda listed: F.transform(words, lambda w: one(of, listed, w)), kind), kind)


@cache
def _pieces(path: str) -> list[bytes]:
    by_id = {v: k for k, v in ranks_of(path).items()}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


class _Known(dict):
    """The most frequent words and their ids (little-endian) for a worker: the first HOT of them as a dictionary, all as arrays by hash.

    A word that the dictionary lacks gets a hole with its number in ``cold``, which is emptied after each batch.
    """

    def __init__(self, sent: bytes):
        got = pa.ipc.open_stream(sent).read_all().combine_chunks()
        self.words, ids = got["w"].combine_chunks(), got["ids"].combine_chunks()
        self.words, ids = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (self.words, ids))
        self.ends, self.ids = _ends(ids), ids.values.to_numpy(zero_copy_only=False).view("<u4")
        self.order = np.argsort(got["h"].to_numpy())
        self.hashes = got["h"].to_numpy()[self.order]
        n, data = got["n"].to_numpy(), self.ids.tobytes()
        hot = np.argpartition(-n, HOT)[:HOT] if len(n) > HOT else np.arange(len(n))
        a, b = 4 * self.ends[hot].astype("int64"), 4 * self.ends[hot + 1].astype("int64")
        super().__init__(zip(self.words.take(pa.array(hot)).to_pylist(), (data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)), strict=True))
        self.cold: dict[str, int] = {}

    def __missing__(self, word: str) -> bytes:
        return (HOLE | self.cold.setdefault(word, len(self.cold))).to_bytes(4, "little")

    def look_up(self, words: list[str]) -> np.ndarray:
        """The number of each word among the arrays, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        h = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)
        at = self.order[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)]
        same = pc.equal(self.words.take(pa.array(at)), pa.array(words, pa.string())).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


_known: dict[str, _Known] = {}


def _frequent(name: str, sent: Broadcast) -> _Known:
    """What is known of the frequent words, kept by a worker until another corpus's is asked for."""
    if name not in _known:
        _known.clear()
        _known[name] = _Known(sent.value)
    return _known[name]


def _ends(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)


def _filled(codes: np.ndarray, ends: np.ndarray, holes: np.ndarray, which: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes, cut into rows at ends, with values[starts[k] : starts[k + 1]] for each k of which in the places holes; and the new ends."""
    n = np.ones(len(codes), np.int64)
    own = (starts[which + 1] - starts[which]).astype(np.int64)
    n[holes] = own
    to = np.r_[0, np.cumsum(n)]
    out = np.repeat(codes, n)
    within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    out[np.repeat(to[holes], own) + within] = values[np.repeat(starts[which].astype(np.int64), own) + within]
    return out, to[ends]


def _binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def _coded(texts: list[str | None], known: _Known, find: Callable[[str], list[str]], ranks: dict[bytes, int]) -> tuple[pa.Array, pa.Array]:
    """Of each text its ids, with holes for words that are not known, and these words; a hole has the number of its word."""
    rows = [b"".join(map(known.__getitem__, find(t or ""))) for t in texts]
    cold = list(known.cold)
    known.cold.clear()
    codes, ends = np.frombuffer(b"".join(rows), "<u4"), np.r_[0, np.cumsum([len(r) // 4 for r in rows], dtype=np.int64)]
    # the ids of cold words: those of the arrays, those of long words, and a hole for each of the others
    values, found, rest = [], known.look_up(cold), []
    for w, k in zip(cold, found.tolist(), strict=True):
        if k >= 0:
            values.append(known.ids[known.ends[k] : known.ends[k + 1]])
        elif len(w.encode()) > FOLD_BYTES:
            values.append(np.array(merged_by_heap(w.encode(), ranks), "<u4"))
        else:
            values.append(np.array([HOLE | len(rest)], "<u4"))
            rest.append(w)
    starts = np.r_[0, np.cumsum([len(v) for v in values], dtype=np.int64)]
    holes = np.flatnonzero(codes >= HOLE)
    codes, ends = _filled(codes, ends, holes, (codes[holes] ^ HOLE).astype(np.int64), starts, np.concatenate([np.zeros(0, "<u4"), *values]))
    # each text numbers its own words
    holes = np.flatnonzero(codes >= HOLE)
    text = np.searchsorted(ends, holes, "right") - 1
    pairs, at = np.unique(text * max(len(rest), 1) + (codes[holes] ^ HOLE), return_inverse=True)
    of, word = np.divmod(pairs, max(len(rest), 1))
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    codes[holes] = HOLE | (at - first[text])
    return _binary(codes, ends), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(rest, pa.string()).take(pa.array(word.astype(np.int64))))


def _uncoded(codes: pa.Array, folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch of texts, one after the other, and where each text's end."""
    ends = _ends(codes).astype(np.int64)
    ids = np.frombuffer(codes.buffers()[2] or b"", "<u4", ends[-1] // 4)[ends[0] // 4 :]
    ends = (ends - ends[0]) // 4
    holes = np.flatnonzero(ids >= HOLE)
    first, inner = _ends(folded), folded.values
    which = first[np.searchsorted(ends, holes, "right") - 1] + (ids[holes] ^ HOLE).astype(np.int64)
    return _filled(ids, ends, holes, which, _ends(inner), inner.values.to_numpy(zero_copy_only=False).astype("<u4"))


def word_counts(docs: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """(w, n): the words of all texts; each task sums up its own before the exchange, in runs of bounded memory."""

    words = encoder.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        find = _finder(words)

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["w", "n"])
            sums.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                sums.update(find(t or ""))
                if len(sums) > COUNTED:
                    yield out()
        yield out()

    return docs.select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, encoder: Encoder, text: str = "text", most: int = FREQUENT) -> Broadcast:
    """The most frequent words of all texts with their ids, at most ``most``; the fold runs once for each of them."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, encoder, text).where((F.col("n") > 1) & (F.octet_length("w") <= FREQUENT_BYTES)), "words")
    # the least count whose words, with all of larger counts, are no more than most; there are few different counts
    least, have = 2, 0
    for n, words in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):
        have += words
        if have > most:
            least = n + 1
            break
    best = counts.where(F.col("n") >= least).repartition(4 * spark.sparkContext.defaultParallelism)
    got = best.select("w", "n", F.xxhash64("w").alias("h"), encoder.fold(F.array("w"))[0].alias("ids")).toArrow()
    discard(counts)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as stream:
        stream.write_table(got)
    del got  # the driver holds few copies at once
    data = sink.getvalue().to_pybytes()
    del sink, stream
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, encoder: Encoder, text: str = "text", into: str = "ids", most: int = FREQUENT) -> DataFrame:
    """docs with the ids of the whole text, as the library gives them without special tokens.

    The most frequent words of the corpus are folded once; of the others each text's distinct ones are, and those over FOLD_BYTES are
    merged by a heap, so words of any length are encoded exactly.  A null or empty text has no ids.  Equal texts and repeated rows have
    equal ids.  An empty table gives an empty one.  A column named as ``into`` is replaced; no other column is touched, whatever its name.
    """
    return _encoded(docs, encoder, text, into, most, docs.drop(into).columns, False)


def _encoded(docs: DataFrame, encoder: Encoder, text: str, into: str, most: int, keep: list[str], packed: bool) -> DataFrame:
    """The columns ``keep`` of docs, and the ids; packed ones are unsigned 32-bit integers, little-endian, one after the other."""
    sent, path, words, name = frequent(docs, encoder, text, most), encoder.path, encoder.pattern, uuid.uuid4().hex
    code, rest, done = f"__code_{name}", f"__rest_{name}", f"__done_{name}"
    kept = [docs.schema[c] for c in keep]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find, ranks = _frequent(name, sent), _finder(words), ranks_of(path)
        for x in batches:
            own = _coded(x.column(text).to_pylist(), known, find, ranks)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in keep), *own], [*keep, code, rest])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, ends = _uncoded(x.column(code), x.column(done))
            own = _binary(ids, ends) if packed else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in keep), own], [*keep, into])

    first = docs.mapInArrow(coded, T.StructType([*kept, T.StructField(code, T.BinaryType()), T.StructField(rest, T.ArrayType(T.StringType()))]))
    folded = first.select(*(F.col(f"`{c}`") for c in keep), code, encoder.fold(F.col(rest)).alias(done))
    return folded.mapInArrow(filled, T.StructType([*kept, T.StructField(into, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))]))


def _rows(ids: pa.Array) -> Iterator[np.ndarray]:
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    values = ids.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def decode(ids: Column, encoder: Encoder) -> Column:
    """The bytes that ids (an array, or packed) stand for: their pieces one after the other; an id that the vocabulary lacks stands for nothing."""
    path = encoder.path

    @F.arrow_udf("binary")
    def pieces(batch: pa.Array) -> pa.Array:
        known = _pieces(path)
        rows = [np.frombuffer(x, "<u4") for x in batch.to_pylist()] if pa.types.is_binary(batch.type) else _rows(batch)
        return pa.array([b"".join(map(known.__getitem__, x[(x >= 0) & (x < len(known))].tolist())) for x in rows], pa.binary())

    return pieces(ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to; a null text is an empty one."""
    tune(spark)
    encoder = Encoder()
    out = _encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), encoder, "text", "ids", FREQUENT, ["doc_id"], True)
    n = F.shiftright(F.octet_length("ids"), 2).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), encoder), 256).alias("decoded_sha256"))
