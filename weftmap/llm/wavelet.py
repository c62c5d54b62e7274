"""Token ids as wavelet matrices: a file for each shard, read without unpacking it.

Texts are tokenised by the ``tokenizers`` library. Its pre-tokeniser never joins
across some places (before white space, before the last of a run of it that does
not end the text, between letters, digits and symbols), so texts are cut there and each different piece goes through the library once for
a worker; pieces are told apart by 64-bit hashes. A text that holds an added token
of the tokeniser (``<|endoftext|>``) is one piece, so the library finds the token
and gives its id, as it does by default. An end id follows each text.

A shard holds the ids of consecutive rows in order of doc_id: the bit planes of
a wavelet matrix, cut into blocks that are compressed (zstd) one by one, their rank directories,
and ids and lengths of its documents. Access, rank, count, select and occurrences
open the blocks that they meet and no others; reading a shard from end to end opens
each block once. Every shard is one file: a Parquet file of one row, whose binary
column holds it, so Spark's committers write it to any store, a task that is lost is
written again, and ``open_file`` reads a file on its own.

Defined results: a null text is empty (the end id alone); rows of one doc_id are
ordered by their text's hash; rows with a null doc_id come first; ids may be of any
type that can be sorted; an empty table makes no shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import wordhash as H
from .common import batches, shared_dir, text_bytes
from .hashindex import HashIndex, Rows

END = 0
#: Tokens after which a shard is closed.
SHARD = 1 << 21
#: Different pieces that a worker keeps; beyond it starts anew.
KEPT = 1 << 21
RANK_STEP = 512
#: Bytes of a plane that are compressed together; a multiple of a rank step.
BLOCK = 1 << 13
#: Blocks that an open plane keeps.
OPEN_BLOCKS = 64
MAGIC = b"WMX2"
_CODEC = pa.Codec("zstd", 1)

_LETTER, _DIGIT, _OTHER, _QUOTE, _SPACE, _WHITE, _ELSE = range(1, 8)
_CLASS = np.full(256, _ELSE, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("A") : ord("Z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("'")] = _QUOTE
_CLASS[0x20] = _SPACE
_CLASS[0x09:0x0E] = _WHITE
_CUT = np.zeros((8, 8), bool)  # between a class and the next
for _a in (_LETTER, _DIGIT, _OTHER):
    for _b in (_LETTER, _DIGIT, _OTHER):
        _CUT[_a, _b] = _a != _b
for _a in (_LETTER, _DIGIT, _OTHER, _QUOTE):
    _CUT[_a, [_SPACE, _WHITE]] = True
    _CUT[_WHITE, _a] = True


def pieces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin: no token of the pre-tokeniser reaches over such a place."""
    n = len(raw)
    kind = _CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # U+00C0 to U+017F, all letters but two
    lead = lead[lead + 1 < n]
    after = raw[lead + 1]
    lead = lead[~((raw[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)))]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    cut = np.zeros(n, bool)
    cut[1:] = _CUT[kind[:-1], kind[1:]]
    starts = at[:-1]
    first = np.zeros(n, bool)
    first[starts[starts < n]] = True
    if n > 2:
        # white space of several bytes may stand before the one that a word follows
        cut[2:] &= ~((kind[:-2] == _ELSE) & (kind[1:-1] == _WHITE) & ~first[1:-1])
        # of several white-space characters before a word the last one is not the others' token
        white = (kind == _SPACE) | (kind == _WHITE)
        word = (kind <= _QUOTE) & ~first
        cut[1:-1] |= white[:-2] & white[1:-1] & word[2:]
    cut |= first
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, with the pieces seen so far.

    With ``added`` the tokeniser's added tokens get their ids, else special ones are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.clear()

    def clear(self) -> None:
        self.index, self.rows = HashIndex(18), Rows(np.uint32)

    def _join(self, start: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The starts of pieces without those inside texts that hold an added token."""
        data, whole = raw.tobytes(), set()
        for token in self.added:
            found = data.find(token)
            while found >= 0:
                k = int(np.searchsorted(at, found, "right")) - 1
                whole.add(k)
                found = data.find(token, int(at[k + 1]))  # the next text
        if not whole:
            return start
        inside = np.zeros(len(at) - 1, bool)
        inside[list(whole)] = True
        text = np.searchsorted(at, start, "right") - 1
        return start[~inside[text] | (start == at[text])]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        start = pieces(raw, at)
        if self.added:
            start = self._join(start, raw, at)
        end = np.append(start[1:], len(raw))
        h = H.mix(H._ranges(H._TABLE[raw], H._BASE, start, end))
        row = self.index.find(h)
        if (row < 0).any():
            if len(self.index) > KEPT:
                self.clear()
                row[:] = -1
            new, first = np.unique(h[row < 0], return_index=True)
            first = np.flatnonzero(row < 0)[first]
            data = raw.tobytes()
            texts = [data[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.index.add(new, np.arange(self.rows.n, self.rows.n + len(new), dtype=np.int32))
            self.rows.append(np.array([len(x) for x in ids], np.int64), np.array([y for x in ids for y in x], np.uint32))
            row = self.index.find(h)
        ids, n = self.rows.take(row)
        done = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(done[np.searchsorted(start, at)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder; workers are reused, so pieces are kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


_ROW = RANK_STEP // 8
#: For each place in a rank step, the bits before it.
_BEFORE = np.packbits(np.arange(RANK_STEP)[None, :] < np.arange(RANK_STEP)[:, None], axis=1, bitorder="little")


class Plane:
    """Bits, packed, in blocks that are compressed unless that makes them longer."""

    def __init__(self, size: int, ends: np.ndarray, data: bytes | memoryview):
        self.size, self.ends, self.data = size, ends, data
        self.kept: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, packed: np.ndarray) -> Plane:
        parts = []
        for a in range(0, len(packed), BLOCK):
            raw = packed[a : a + BLOCK].tobytes()
            small = _CODEC.compress(raw, asbytes=True)
            parts.append(small if len(small) < len(raw) else raw)
        return cls(len(packed), np.cumsum([len(x) for x in parts], dtype=np.uint32), b"".join(parts))

    def block(self, k: int) -> np.ndarray:
        """The bytes of a block."""
        a, b = int(self.ends[k - 1]) if k else 0, int(self.ends[k])
        data = self.data[a:b]
        whole = min(BLOCK, self.size - k * BLOCK)
        return np.frombuffer(data if b - a == whole else _CODEC.decompress(data, whole), np.uint8)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The bytes of some rank steps."""
        own = at * _ROW // BLOCK
        out = np.zeros((len(at), _ROW), np.uint8)
        for k in np.unique(own).tolist():
            full = self.kept.get(k)
            if full is None:
                full = np.zeros(BLOCK, np.uint8)
                got = self.block(k)
                full[: len(got)] = got
                full = full.reshape(-1, _ROW)
                if len(self.kept) >= OPEN_BLOCKS:
                    self.kept.clear()
                self.kept[k] = full
            mine = own == k
            out[mine] = full[at[mine] - k * (BLOCK // _ROW)]
        return out

    def whole(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.ends))]) if len(self.ends) else np.empty(0, np.uint8)


class WaveletMatrix:
    """A sequence of ids with access, rank, count, select and occurrences.

    Plane k has bit (bits - 1 - k) of each id, in the order that the planes
    above leave: stably parted, zeros first.
    """

    def __init__(self, n: int, planes: list[Plane], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids)
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            bit = (now >> now.dtype.type(k)) & now.dtype.type(1)
            one = bit.astype(bool)
            plane = np.packbits(one, bitorder="little")
            planes.append(Plane.of(plane))
            left = np.compress(~one, now)  # much faster than an index of booleans
            zeros.append(len(left))
            ranks.append(cls._ranks(cls._ones_a_step(plane)))
            now = np.concatenate([left, np.compress(one, now)])
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _ones_a_step(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) // _ROW) * _ROW, np.uint8)
        padded[: len(plane)] = plane
        return np.bitwise_count(padded.view(np.uint64)).reshape(-1, _ROW // 8).sum(1, dtype=np.uint16)

    @staticmethod
    def _ranks(ones: np.ndarray) -> np.ndarray:
        """Ones before every RANK_STEP bits."""
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<QI", self.n, len(self.planes))]
        for plane, zero, rank in zip(self.planes, self.zeros, self.ranks, strict=True):
            steps = zlib.compress(np.diff(rank).astype("<u2").tobytes(), 1)
            parts += [struct.pack("<QIII", zero, len(steps), len(plane.ends), len(plane.data)), steps, plane.ends.astype("<u4").tobytes(), bytes(plane.data)]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        """Opens a matrix; the planes stay as they are until they are asked for."""
        n, bits = struct.unpack_from("<QI", data)
        view = memoryview(data)
        at, planes, zeros, ranks = 12, [], [], []
        for _ in range(bits):
            zero, steps, blocks, size = struct.unpack_from("<QIII", data, at)
            at += 20
            ranks.append(cls._ranks(np.frombuffer(zlib.decompress(view[at : at + steps]), "<u2")))
            ends = np.frombuffer(data, "<u4", blocks, at + steps)
            at += steps + 4 * blocks
            planes.append(Plane(-(-n // 8), ends, view[at : at + size]))
            at += size
            zeros.append(zero)
        return cls(n, planes, zeros, ranks)

    def _look(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits at places i of plane k (0 beyond the end), and ones before them."""
        bit, ones = np.zeros(len(i), np.uint8), self.ranks[k][i // RANK_STEP].astype(np.int64)
        inside = np.flatnonzero(i < self.n)
        for a in range(0, len(inside), 1 << 14):
            some = inside[a : a + (1 << 14)]
            step, place = i[some] // RANK_STEP, i[some] % RANK_STEP
            own, back = np.unique(step, return_inverse=True)
            rows = self.planes[k].rows(own)[back]
            ones[some] += np.bitwise_count(rows & _BEFORE[place]).sum(1, dtype=np.int64)
            bit[some] = rows[np.arange(len(some)), place >> 3] >> (place & 7).astype(np.uint8) & 1
        past = np.flatnonzero(i >= self.n)
        if len(past) and self.n % RANK_STEP:
            ones[past] = int(self.ranks[k][-1])
        return bit, ones

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        i = np.asarray(at, np.int64).copy()
        out = np.zeros(len(i), np.uint32)
        for k in range(len(self.planes)):
            bit, ones = self._look(k, i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the last plane's order has the occurrences of ``token`` in lo..hi - 1."""
        bits = len(self.planes)
        if token >> bits:
            return 0, 0
        for k in range(bits):
            a, b = self._look(k, np.array([lo, hi]))[1]
            one = token >> (bits - 1 - k) & 1
            lo, hi = (self.zeros[k] + int(a), self.zeros[k] + int(b)) if one else (lo - int(a), hi - int(b))
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place i."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        lo, hi = self._range(token, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """All places of ``token`` in lo..hi - 1, in order."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        places = np.arange(a, b, dtype=np.int64)
        bits = len(self.planes)
        for k in range(bits - 1, -1, -1):
            one = token >> (bits - 1 - k) & 1
            places = self._select(k, places - self.zeros[k] if one else places, one)
        return places

    def select(self, token: int, j: int) -> int:
        """The place of the j-th occurrence (from 0), -1 if there is none."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            return -1
        place = np.array([a + j], np.int64)
        bits = len(self.planes)
        for k in range(bits - 1, -1, -1):
            one = token >> (bits - 1 - k) & 1
            place = self._select(k, place - self.zeros[k] if one else place, one)
        return int(place[0])

    def _select(self, k: int, j: np.ndarray, one: int) -> np.ndarray:
        """Places of the j-th ones (or zeros) of plane k, by the directory and then within a block."""
        if not len(j):
            return j
        ranks = self.ranks[k].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * RANK_STEP - ranks
        block = np.searchsorted(before, j, "right") - 1
        own, back = np.unique(block, return_inverse=True)
        out = np.empty(len(j), np.int64)
        for lo in range(0, len(own), 4096):
            some = own[lo : lo + 4096]
            bits = np.unpackbits(self.planes[k].rows(some), axis=1, bitorder="little") == one
            total = np.cumsum(bits, axis=1, dtype=np.int32)
            mine = np.flatnonzero((back >= lo) & (back < lo + 4096))
            for row in np.unique(back[mine]):
                at = mine[back[mine] == row]
                out[at] = own[row] * RANK_STEP + np.searchsorted(total[row - lo], j[at] - before[own[row]] + 1)
        return out

    def to_ids(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        now = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k].whole(), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~one)] = now[: self.zeros[k]]  # much faster than an index of booleans
            before[np.flatnonzero(one)] = now[self.zeros[k] :] | now.dtype.type(1 << (bits - 1 - k))
            now = before
        return now


def pack_shard(ids: np.ndarray, docs: pa.Array, lengths: np.ndarray) -> bytes:
    """A shard's file: the documents (deflated), then the matrix."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([docs, pa.array(lengths, pa.uint32())], ["doc_id", "n_tokens"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    head = zlib.compress(sink.getvalue(), 1)
    return MAGIC + struct.pack("<I", len(head)) + head + WaveletMatrix.build(ids).to_bytes()


def open_shard(data: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the matrix."""
    if data[:4] != MAGIC:
        raise ValueError("not a shard file")
    (size,) = struct.unpack_from("<I", data, 4)
    head = pa.ipc.open_stream(zlib.decompress(data[8 : 8 + size])).read_all().combine_chunks()
    return as_one(head.column(0)), as_one(head.column(1)).to_numpy(), WaveletMatrix.from_bytes(data[8 + size :])


def as_one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def open_file(path: str) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """``open_shard`` for one of the table's files."""
    return open_shard(pq.read_table(path, columns=["file"], partitioning=None).column("file")[0].as_py())


def write_shards(path: str, end: int, most: int):
    """Sorted partition of (doc_id, text) -> (part, k, n_docs, n_tokens, file)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, k = encoder(path), TaskContext.get().partitionId(), 0
        ids, docs, lengths, held = [], [], [], 0  # docs: arrays of ids

        def close() -> pa.RecordBatch:
            whole, n = np.concatenate(ids), np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(n)], pa.int64()), pa.array([len(whole)], pa.int64()), pa.array([pack_shard(whole, pa.concat_arrays(docs), n)], pa.binary())],
                ["part", "k", "n_docs", "n_tokens", "file"],
            )

        for rows, texts in batches(it, most=1 << 20):
            got, n = code.encode(*text_bytes(texts))
            whole = np.full(len(got) + len(n), end, np.uint16 if code.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
            inside = np.ones(len(whole), bool)
            inside[np.cumsum(n + 1) - 1] = False
            whole[np.flatnonzero(inside)] = got
            ids.append(whole)
            lengths.append(n + 1)
            docs.append(rows.column(0))
            held += len(whole)
            if held >= most:
                yield close()
                k += 1
                ids, docs, lengths, held = [], [], [], 0
        if docs:
            yield close()

    return run


def encode_shards(docs: DataFrame, path: str, end: int = END, most: int = SHARD) -> DataFrame:
    """The shard table (part, k, n_docs, n_tokens, file), a file for each row, written to the shared folder; (part, k) is in order of doc_id."""
    spark = docs.sparkSession
    own = docs.select("doc_id", "text").withColumn("wm_th", F.xxhash64("text"))
    dealt = own.repartitionByRange(F.col("doc_id").asc_nulls_first(), "wm_th").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "wm_th")
    made = dealt.select("doc_id", "text").mapInArrow(write_shards(path, end, most), "part int, k int, n_docs long, n_tokens long, file binary")
    at = f"{shared_dir(spark)}/weftmap/shards-{uuid.uuid4().hex}"
    made.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(at)
    return spark.read.schema(made.schema).parquet(at)


def read_shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, k, file) -> (part, k, doc_id, at, n_tokens, ids_crc32), from the files alone; at is the place in the shard."""
    for batch in it:
        for part, k, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs, lengths, matrix = open_shard(file.as_buffer().to_pybytes())
            data = memoryview(matrix.to_ids().astype("<u4", copy=False)).cast("B")
            ends = np.cumsum(lengths.astype(np.int64))
            starts = ends - lengths
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, k, np.int32)), docs, pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                ["part", "k", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def shard_digests(shards: DataFrame, kind: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back; ``kind`` is the type of the ids.

    Running totals are made within each part and over the parts, whose number is that of the partitions written; files are not shuffled.
    """
    sizes = shards.select("part", "k", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("first"))
    bases = sizes.withColumn("base", before(Window.partitionBy("part").orderBy("k"))).join(parts, "part").select("part", "k", (F.col("first") + F.col("base")).alias("base"))
    read = shards.select("part", "k", "file").mapInArrow(read_shards, f"part int, k int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return read.join(bases, ["part", "k"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
