"""Token ids in a binary format of bit planes.

A file is a byte string: a header, blocks, and an index.  A block holds up to BLOCK ids as 32-bit little-endian numbers,
transposed to 4 byte planes (or 32 bit planes) of which each is compressed with zstandard; the index has, per block, the offset,
the number of ids and the size of each plane, and the documents' ids and token counts.  Any block can be read alone.  Files
are rows of a Parquet table in the shared folder, so Spark commits them as a whole and only once; export() copies them out.

    header: magic "GNBP", version, planes, block size, documents, ids, ids of its part before it
    index:  per block offset, ids and plane sizes; zstd(doc ids), zstd(known-id flags), zstd(token counts), and their sizes
    footer: offset of the index, magic
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm._store import materialise, table, tune
from gneiss.llm._words import blocks, mix

TOKENIZER, END, BLOCK, FILE_IDS, PART_ROWS = "byte_bpe_50k.json", 2, 1 << 16, 1 << 21, 8_000
_MAGIC, _HEAD, _FOOT = b"GNBP", struct.Struct("<4sHHIQQQ"), struct.Struct("<Q4s")
MEMO, SHORT = 900_000, 24  # units a worker remembers (beyond that it keeps the frequent ones), and their longest in bytes
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_VISIBLE = np.array([0x21 <= b <= 0x7E or b >= 0x80 for b in range(256)])
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() and b != 0x27 for b in range(256)])
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: The printable character that stands for each byte in a byte-level vocabulary.
_SHOWN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SHOWN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: White space beyond ASCII, by its first byte in UTF-8.
_WIDE_BLANKS = [(lead, {c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"}) for lead in (0xC2, 0xE1, 0xE2, 0xE3)]


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The byte planes, or bit planes, of 32-bit ids; the highest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1].T
    if bits:
        raw = np.packbits(np.unpackbits(np.ascontiguousarray(raw), axis=1).reshape(4, -1, 8).transpose(0, 2, 1).reshape(32, -1), axis=1)
    return [np.ascontiguousarray(r).tobytes() for r in raw]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 32:
        flat = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(32, -1), axis=1)[:, :n]
        parts = list(np.packbits(flat.reshape(4, 8, n).transpose(0, 2, 1).reshape(4, -1), axis=1))
    raw = np.stack([np.frombuffer(p, np.uint8) for p in parts])[::-1].T
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(ids: np.ndarray, docs: list[int | None], counts: np.ndarray, before: int, block: int = BLOCK, bits: bool = False) -> bytes:
    """One file of whole documents."""
    z = zstandard.ZstdCompressor(level=1).compress
    n_planes = 32 if bits else 4
    out, index = [_HEAD.pack(_MAGIC, 1, n_planes, block, len(docs), len(ids), before)], []
    at = len(out[0])
    for i in range(0, len(ids), block):
        part = [z(p) for p in planes(ids[i : i + block], bits)]
        index.append(struct.pack(f"<QI{n_planes}I", at, min(block, len(ids) - i), *map(len, part)))
        out += part
        at += sum(map(len, part))
    tail = [z(np.array([d or 0 for d in docs], "<i8").tobytes()), z(bytes(d is not None for d in docs)), z(counts.astype("<u4").tobytes())]
    out += [*index, *tail, struct.pack("<3I", *map(len, tail)), _FOOT.pack(at, _MAGIC)]
    return b"".join(out)


class File:
    """Reads a packed file; blocks are decoded as they are asked for."""

    def __init__(self, data: bytes):
        self.data = data
        magic, version, self.n_planes, self.block, n_docs, self.n_ids, self.before = _HEAD.unpack_from(data)
        at, end = _FOOT.unpack_from(data, len(data) - _FOOT.size)
        if magic != _MAGIC or end != _MAGIC or version != 1:
            raise ValueError("not a bit-plane file of version 1")
        row = struct.Struct(f"<QI{self.n_planes}I")
        n_blocks = -(-self.n_ids // self.block)
        self.index = [row.unpack_from(data, at + i * row.size) for i in range(n_blocks)]
        sizes = struct.unpack_from("<3I", data, len(data) - _FOOT.size - 12)
        p, parts = at + n_blocks * row.size, []
        for n in sizes:
            parts.append(self._z(data[p : p + n]))
            p += n
        known = np.frombuffer(parts[1], np.uint8)
        self.docs = [int(d) if k else None for d, k in zip(np.frombuffer(parts[0], "<i8"), known, strict=True)]
        self.counts = np.frombuffer(parts[2], "<u4").astype(np.int64)
        assert len(self.docs) == n_docs

    @staticmethod
    def _z(b: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(b)

    def read_block(self, i: int) -> np.ndarray:
        at, n, *sizes = self.index[i]
        parts = []
        for s in sizes:
            parts.append(self._z(self.data[at : at + s]))
            at += s
        return from_planes(parts, n)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read_block(i) for i in range(len(self.index))]) if self.index else np.zeros(0, "<u4")


class Encoder:
    """Whole texts to ids with the tokenizers library.

    Texts are cut into units of bytes at places that no match of the byte-level pattern spans: before a single plain blank or line feed
    between two visible characters, and between a letter and an ASCII mark other than the apostrophe.  A unit goes to the library the first
    time it is met; its ids are then found by its bytes, which three 64-bit numbers and the length hold in full up to SHORT bytes.
    Longer units are only remembered within a block.  A text that holds a special token's string is one unit, and so is every text if
    the vocabulary's pattern is another one.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tok = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        pre = json.loads(self.tok.to_str())
        self.cuts = pre["normalizer"] is None and pre["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._set(np.zeros((4, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _set(self, keys: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray, hits: np.ndarray) -> None:
        """Remember these units alone: their bytes as four numbers, and where their ids stand in flat."""
        self.keys, self.start, self.size, self.flat, self.hits = keys, start, size, flat, hits
        bits = max(16, int(4 * keys.shape[1]).bit_length())
        self.slots = np.full(1 << bits, -1, np.int32)
        self._place(np.arange(keys.shape[1]))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys[0] ^ mix(keys[1] ^ mix(keys[2] ^ keys[3] * np.uint64(0x9E3779B97F4A7C15))))
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _place(self, new: np.ndarray) -> None:
        """Enter units into the table of slots, by open addressing."""
        at, mask = self._hash(self.keys[:, new]), len(self.slots) - 1
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]  # of several units one stays
            left = self.slots[at] != new
            new, at = new[left], (at[left] + 1) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 for one that is not known."""
        out, mask = np.full(keys.shape[1], -1, np.int64), len(self.slots) - 1
        todo, at = np.arange(keys.shape[1]), self._hash(keys)
        while len(todo):
            unit = self.slots[at].astype(np.int64)
            some = unit >= 0
            todo, at, unit = todo[some], at[some], unit[some]
            same = np.ones(len(todo), bool)
            for k in range(4):
                same &= self.keys[k][unit] == keys[k][todo]
            out[todo[same]] = unit[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        return out

    def _shrink(self) -> None:
        """Forget the units that were met only once or twice, or all if most were met more often."""
        kept = np.flatnonzero(self.hits > 2)
        if len(kept) > MEMO // 2:
            kept = kept[:0]
        size = self.size[kept]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[kept] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._set(self.keys[:, kept], ends - size, size, flat, self.hits[kept] // 2)

    def _ids_of(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of each unit, end to end, and how many each has.

        A blank and letters, or letters alone, are one match of the pattern: they go to the library's model at once, others through its whole encoding."""
        got: list[list[int]] = []
        other: list[int] = []
        cut, shown, blank = self.tok.model.tokenize, _SHOWN, _SHOWN[0x20]
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            unit = data[a:b]
            word = unit[1:] if unit[:1] == b" " else unit
            if self.cuts and word.isalpha():
                got.append([t.id for t in cut(blank + word.decode() if word is not unit else word.decode())])
            elif self.cuts and _LATIN(word):
                got.append([t.id for t in cut(unit.decode("latin-1").translate(shown))])
            else:
                got.append([])
                other.append(i)
        if other:
            for i, e in zip(other, self.tok.encode_batch_fast([data[start[i] : end[i]].decode() for i in other], add_special_tokens=False), strict=True):
                got[i] = e.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _learn(self, data: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        flat, size = self._ids_of(data, start, end)
        n = self.keys.shape[1]
        first = len(self.flat) + np.cumsum(size) - size
        keys, first, size, flat, hits = np.concatenate([self.keys, keys], 1), np.r_[self.start, first], np.r_[self.size, size], np.r_[self.flat, flat], np.r_[self.hits, np.zeros(len(size), np.int64)]
        if 3 * keys.shape[1] > len(self.slots):
            self._set(keys, first, size, flat, hits)
            return
        self.keys, self.start, self.size, self.flat, self.hits = keys, first, size, flat, hits
        self._place(np.arange(n, keys.shape[1]))

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the units of a block of texts begin, in ascending order."""
        n = len(data)
        begins = np.zeros(n + 1, bool)
        if self.cuts and n > 2:
            seen = _VISIBLE[data]
            for lead in _WIDE_BLANKS:  # none of the corpus may hold them, so first look for the lead byte
                for at in np.flatnonzero(data[:-1] == lead[0]).tolist() if lead[0] in data else ():
                    size = 2 if lead[0] == 0xC2 else 3
                    if bytes(data[at : at + size]) in lead[1]:
                        seen[at : at + size] = False
            gap = (data[1:-1] == 0x20) | (data[1:-1] == 0x0A)
            begins[1 : n - 1] = gap & seen[:-2] & seen[2:]
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            mark = _MARK[data]
            begins[1:n] |= (letter[:-1] & mark[1:]) | (mark[:-1] & _LETTER[data[1:]])
            raw = data.tobytes() if any(self.special) else b""
            for s in filter(None, self.special):
                at = raw.find(s)
                while at >= 0:
                    k = int(np.searchsorted(offsets, at, side="right"))
                    begins[offsets[k - 1] : offsets[k]] = False
                    at = raw.find(s, int(offsets[k]))
        begins[offsets] = True
        return np.flatnonzero(begins[:n])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has; null is empty."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in blocks(texts, 1 << 20):
            got, size = self._block(data, offsets)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.keys.shape[1] > MEMO:
            self._shrink()
        start = self._units(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.r_[start[1:], len(data)]
        n, raw = end - start, data.tobytes()
        wide = np.ndarray(len(data) + 16, "<u8", raw + bytes(24), strides=(1,)).copy()
        short = n <= SHORT
        at, length = start[short], n[short]
        keys = np.empty((4, len(at)), np.uint64)
        for k in range(3):
            keys[k] = wide[np.minimum(at + 8 * k, len(data) + 8)] & _LOW_BYTES[np.clip(length - 8 * k, 0, 8)]
        keys[3] = length
        unit = self._find(keys)
        fresh = np.flatnonzero(unit < 0)
        if len(fresh):
            order = fresh[np.lexsort(keys[:, fresh])]
            first = order[np.r_[True, (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)]]
            first = np.sort(first)
            self._learn(raw, keys[:, first], at[first], at[first] + length[first])
            unit[fresh] = self._find(keys[:, fresh])
        self.hits += np.bincount(unit, minlength=len(self.hits))
        where, size, flat = np.empty(len(start), np.int64), np.empty(len(start), np.int64), self.flat
        where[short], size[short] = self.start[unit], self.size[unit]
        if not short.all():
            far = np.flatnonzero(~short)
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(raw[a:b], len(seen)) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
            head = np.zeros(len(seen), np.int64)
            head[which[::-1]] = far[::-1]
            more, more_size = self._ids_of(raw, start[head], end[head])
            size[far] = more_size[which]
            where[far] = (len(flat) + np.cumsum(more_size) - more_size)[which]
            flat = np.r_[flat, more]
        ends = np.cumsum(size)
        ids = flat[np.repeat(where - (ends - size), size) + np.arange(int(ends[-1]))]
        return ids, np.diff(np.r_[0, ends][np.searchsorted(start, offsets)])


@cache
def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def write(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, bits: bool = False, file_ids: int = FILE_IDS, part_rows: int = PART_ROWS) -> DataFrame:
    """Write the ids of docs (doc_id, text) in ascending order of doc_id; gives the table of files (part, file, n_docs, n_ids, data).

    Null ids come first and ties go by text; a null text is empty and has the end id alone.  Texts are exchanged once, by ranges of ids.
    A file holds whole documents and is closed once it has file_ids ids.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), _encoder(_path(tokenizer))
        held: list[np.ndarray] = []
        ids, counts, n, before, file = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            data = pack(np.concatenate(held), ids, np.concatenate(counts), before, bits=bits)
            cols = [pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "file", "n_docs", "n_ids", "data"])

        for batch in batches:
            doc = batch.column(0).to_pylist()
            for i in range(0, len(doc), 1024):
                got, size = enc.encode(batch.column(1).slice(i, 1024))
                held.append(np.insert(got, np.cumsum(size), end))
                ids += doc[i : i + 1024]
                counts.append(size + 1)
                n += len(got) + len(size)
                if n >= file_ids:
                    yield close()
                    before, file = before + n, file + 1
                    held, ids, counts, n = [], [], [], 0
        if ids:
            yield close()

    rows = docs.select("doc_id", "text")
    parts = max(1, -(-docs.count() // part_rows))
    sorted_ = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return materialise(sorted_.mapInArrow(run, "part int, file int, n_docs long, n_ids long, data binary"), "token-files")


def read(files: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<int>) of each document, decoded from the files alone; start counts the ids of all before it.
    Without ids, their crc32 (unsigned, of 32-bit little-endian numbers) takes their place."""
    before, at = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row per range of documents
        before[r["part"]], at = at, at + r["n"]
    last = "ids" if ids else "ids_crc32"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = File(data.as_py())
                ends = np.cumsum(f.counts)
                start, flat = ends - f.counts, f.ids()
                for i in range(0, len(f.docs), 256):
                    s = slice(i, i + 256)
                    if ids:
                        values = pa.array(flat[start[s][0] : ends[s][-1]].view(np.int32))
                        got = pa.ListArray.from_arrays(pa.array(np.r_[start[s], ends[s][-1]] - start[s][0], pa.int32()), values)
                    else:
                        got = pa.array([zlib.crc32(flat[x:y]) for x, y in zip(start[s], ends[s], strict=True)], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(f.docs[s], pa.int64()), pa.array(start[s] + f.before + before[part]), pa.array(f.counts[s]), got], names=["doc_id", "start", "n_tokens", last])

    return files.select("part", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids array<int>' if ids else 'ids_crc32 long'}")


def export(files: DataFrame, folder: str) -> int:
    """Copy the files to a local folder, one after the other; returns how many."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in files.orderBy("part", "file").toLocalIterator():
        with open(os.path.join(folder, f"ids-{r['part']:05d}-{r['file']:04d}.gnbp"), "wb") as f:
            f.write(r["data"])
        n += 1
    return n


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ids of every document stand in the files, how many they are, and their crc32, all from the files."""
    return read(write(table(spark, sf_dir, "documents")), ids=False)
