"""Token ids in binary files: bit-plane shuffling with a chunk index.

Documents are range-partitioned by id and encoded with the tokenizers library where they land, so every task writes one
file of the ids of a range, in order.  A file holds blocks of ``BLOCK`` ids; a block is transposed into byte planes
(or bit planes) and each plane compressed with zstandard, all-zero planes taking no bytes.  Behind the blocks stand the
documents (ids, lengths) and the chunk index (place, size and planes of each block), found through a fixed-size end.
Spark writes the table of files (``index``) with its own commit: a lost or repeated task leaves a file that no row names,
and such files are removed after the write.

Encoding goes through the library for every distinct chunk of a text (a run without white space with the space before
it, or a run of white space), which a byte-level tokenizer without normaliser never merges across.  Chunks are found and
told apart in arrays of a slice's bytes, without a Python string each, and a worker keeps a bounded number of short ones.
Texts that hold an added token, and other tokenizers, are encoded whole.

Nulls and edge cases: a null or empty text has no ids but the end id; null document ids come first; rows with one id
follow each other, each with its own start; texts are never cut off (long ones are encoded piece by piece, parted where
the tokenizer parts them); an empty table gives an empty index; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import integral, plain, slices
from weftline.llm.words import mix

#: Ids in a block.
BLOCK = 1 << 16
#: Text bytes that go into one file.
FILE_BYTES = 32 << 20
LEVEL = 3
#: Text bytes that are encoded at a time.
ENCODE_BYTES = 2 << 20
#: Chunks that an encoder keeps (a call's own may come on top), and 8-byte numbers that hold one of them.
CACHE, LANES = 1_000_000, 4
EXACT = 8 * LANES
#: Longer texts are encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 20
MAGIC = b"WFTPLANE"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_END = struct.Struct("<QQQQB7x8s")
#: Unicode's White_Space, as the split pattern of byte-level tokenizers means it.
_WIDE = "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = "\t-\r \x85\xa0" + _WIDE
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that follow a lead byte in a longer white space character.
_LONG_SPACES = {lead: [x[1:] for x in (c.encode() for c in "\x85\xa0" + _WIDE) if x[0] == lead] for lead in (0xC2, 0xE1, 0xE2, 0xE3)}
_CUT = re.compile(f"(?<=[^{_SPACE}])(?= [^{_SPACE}])")


# --- planes -----------------------------------------------------------------------------------------------------------


def shuffled(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of one block of 32-bit ids: four of bytes, or 32 of bits, lowest first; an all-zero plane is empty."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block's planes."""
    bits = len(planes) == 32
    width = -(-n // 8) if bits else n
    rows = np.zeros((len(planes), width), np.uint8)
    for k, p in enumerate(planes):
        if p:
            rows[k] = np.frombuffer(p, np.uint8)
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
    else:
        rows = rows.T
    return np.ascontiguousarray(rows).view("<u4").ravel()


class PlaneWriter:
    """Appends documents' ids to a file object; blocks are written as they fill."""

    def __init__(self, out, block: int = BLOCK, bits: bool = False, level: int = LEVEL):
        import zstandard

        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = out.write(MAGIC)
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.chunks: list[tuple[int, ...]] = []
        self.doc_ids, self.valid, self.sizes = [], [], []

    def add(self, doc_id: int | None, data: list[bytes]) -> None:
        """data: the document's ids as little-endian 32-bit bytes, in parts."""
        size = 0
        for part in data:
            size += len(part) // 4
            self.held.append(part)
        self.n_held += size
        self.n_ids += size
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.sizes.append(size)
        if self.n_held >= self.block:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        full = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, full, self.block):
            part = ids[at : min(at + self.block, full)]
            planes = [self.pack(p) if p else b"" for p in shuffled(part, self.bits)]
            self.chunks.append((self.at, len(part), *map(len, planes)))
            self.at += self.out.write(b"".join(planes))
        self.held, self.n_held = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self.flush(last=True)
        places = []
        for array in (np.array(self.doc_ids, "<i8"), np.array(self.valid, np.uint8), np.array(self.sizes, "<i8"), np.array(self.chunks, "<i8")):
            places.append(self.at)
            self.at += self.out.write(self.pack(array.tobytes()))
        self.out.write(_END.pack(*places, 32 if self.bits else 4, MAGIC))


@dataclass
class PlaneFile:
    """An open file: its documents and chunk index."""

    source: object
    doc_ids: np.ndarray
    valid: np.ndarray
    sizes: np.ndarray
    chunks: np.ndarray

    @classmethod
    def open(cls, source) -> PlaneFile:
        import zstandard

        end = source.size() if callable(source.size) else source.size
        source.seek(end - _END.size)
        *places, n_planes, magic = _END.unpack(source.read(_END.size))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        unpack = zstandard.ZstdDecompressor().decompress
        arrays = []
        for kind, at, to in zip(("<i8", np.uint8, "<i8", "<i8"), places, [*places[1:], end - _END.size], strict=True):
            source.seek(at)
            arrays.append(np.frombuffer(unpack(source.read(to - at)), kind))
        return cls(source, arrays[0], arrays[1].astype(bool), arrays[2], arrays[3].reshape(-1, 2 + n_planes))

    def block(self, k: int) -> np.ndarray:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        at, n, *sizes = self.chunks[k].tolist()
        self.source.seek(at)
        data, planes, place = self.source.read(sum(sizes)), [], 0
        for size in sizes:
            planes.append(unpack(data[place : place + size]) if size else b"")
            place += size
        return unshuffled(planes, n)

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file; only the blocks that hold them are read."""
        ends = np.cumsum(self.chunks[:, 1])
        hi = min(hi, int(ends[-1]) if len(ends) else 0)
        if lo >= hi:
            return np.empty(0, np.uint32)
        first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi - 1, "right"))
        start = int(ends[first] - self.chunks[first, 1])
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[lo - start : hi - start]

    def documents(self) -> Iterator[list[np.ndarray]]:
        """Each document's ids as the parts that lie in one block each; one block is held at a time."""
        k, held, at = 0, np.empty(0, np.uint32), 0
        for size in self.sizes.tolist():
            parts = []
            while size:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                parts.append(held[at : at + size])
                at += len(parts[-1])
                size -= len(parts[-1])
            yield parts


# --- encoding ---------------------------------------------------------------------------------------------------------


def _lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each span's first ``EXACT`` bytes as ``LANES`` numbers, and its size."""
    padded = np.concatenate([data, np.zeros(EXACT + 8, np.uint8)])
    eight = np.ndarray((len(data) + EXACT,), "<u8", padded, strides=(1,))
    out = np.zeros((len(starts), LANES + 1), np.uint64)
    for j in range(LANES):
        of = np.flatnonzero(sizes > 8 * j) if j else slice(None)
        left = np.minimum(sizes[of] - 8 * j, 8)
        out[of, j] = eight[starts[of] + 8 * j] & _MASK[left]
    out[:, LANES] = sizes
    return out


def _lane_hash(lanes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lanes), np.uint64)
    for j in range(lanes.shape[1]):
        of = np.flatnonzero(lanes[:, j]) if 0 < j < lanes.shape[1] - 1 else slice(None)
        out[of] = mix((out[of] + lanes[of, j]) * _ODD)
    return out


def chunk_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, chunk starts, ``rows``) of texts without nulls: the chunks tile the bytes, and row r has chunks ``rows[r]:rows[r+1]``."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE_BYTE[data]
    tail = np.zeros(len(data), np.uint8)  # at the last byte of a longer space: how many bytes come before it
    for lead, rest in _LONG_SPACES.items():
        n = len(rest[0])
        at = np.flatnonzero(data[: max(len(data) - n, 0)] == lead)
        at = at[np.any([np.all([data[at + j + 1] == b for j, b in enumerate(r)], axis=0) for r in rest], axis=0)]
        for j in range(n + 1):
            space[at + j] = True
        tail[at + n] = n
    head = np.zeros(len(data), bool)
    head[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    after = np.zeros(len(data), bool)
    after[1:] = space[:-1]
    start = head | (space & ~after)
    word = np.flatnonzero(~space & after & ~head)
    last = word - 1 - tail[word - 1]  # the last of a run of spaces parts from it; a blank goes with the word
    start[last] = True
    start[word[data[last] != 0x20]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.searchsorted(starts, offsets)


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``at[k]`` to ``at[k] + n[k]`` of all k, one after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - ends + n, n)


class Known:
    """Chunks of at most ``EXACT`` bytes as arrays: their bytes and size as ``LANES + 1`` numbers, found by a hash of these, and their ids in one pool."""

    def __init__(self):
        self.hashes, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.lanes, self.at, self.n, self.pool = np.empty((0, LANES + 1), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def find(self, hashes: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 if there is none, -2 if another chunk has its hash."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[place] == hashes, self.entry[place], -1)
        hit = np.flatnonzero(out >= 0)
        out[hit[(self.lanes[out[hit]] != lanes[hit]).any(1)]] = -2
        return out

    def add(self, hashes: np.ndarray, lanes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """New chunks, by ascending hash; returns their entries."""
        n = np.array([len(x) // 4 for x in ids], np.int64)
        entries = len(self.n) + np.arange(len(n))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.entry = np.insert(self.hashes, place, hashes), np.insert(self.entry, place, entries)
        self.lanes = np.concatenate([self.lanes, lanes])
        self.at = np.append(self.at, len(self.pool) + np.cumsum(n) - n)
        self.n = np.append(self.n, n)
        self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        return entries

    def keep(self, entries: np.ndarray) -> None:
        """Drops all other chunks; ``entries`` by ascending hash."""
        n = self.n[entries]
        self.hashes = self.hashes[np.isin(self.entry, entries)]
        self.pool = self.pool[_spread(self.at[entries], n)]
        self.lanes, self.at, self.n, self.entry = self.lanes[entries], np.cumsum(n) - n, n, np.arange(len(n))


class Encoder:
    """Ids of texts as bytes, by the tokenizers library."""

    def __init__(self, spec: str, end_id: int | None, cache: int = CACHE):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        split = parsed.get("pre_tokenizer") or {}
        self.parted = parsed["model"]["type"] == "BPE" and not parsed.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.added = [t["content"] for t in parsed.get("added_tokens", [])]
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.most, self.known = cache, Known()
        line = self._ids(["\n"])[0]
        self.line = int(np.frombuffer(line, "<u4")[0]) if self.parted and len(line) == 4 else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[str], together: int = 64) -> list[bytes]:
        """Ids of each chunk; chunks without white space inside share a call, parted by a line end, which never merges with them."""
        if self.line is None:
            return self._ids(chunks)
        joined = [k for k, c in enumerate(chunks) if not c.isspace()]
        out = [b""] * len(chunks)
        groups = [joined[a : a + together] for a in range(0, len(joined), together)]
        for group, data in zip(groups, self._ids(["\n".join([chunks[k] for k in g]) for g in groups]), strict=True):
            ids = np.frombuffer(data, "<u4")
            cuts = np.flatnonzero(ids == self.line)
            if len(cuts) != len(group) - 1:
                parts = self._ids([chunks[k] for k in group])
            else:
                parts = [data[4 * a : 4 * b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
            for k, part in zip(group, parts, strict=True):
                out[k] = part
        rest = [k for k, c in enumerate(chunks) if c.isspace()]
        for k, part in zip(rest, self._ids([chunks[k] for k in rest]), strict=True):
            out[k] = part
        return out

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS and (cut := _CUT.search(text, at + PIECE_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _chunked(self, texts: pa.Array) -> list[bytes]:
        data, starts, rows = chunk_bounds(texts)
        sizes = np.diff(np.append(starts, len(data)))
        raw = data.tobytes()
        text_of = lambda k: raw[starts[k] : starts[k] + sizes[k]].decode()
        lanes = _lanes(data, starts, sizes)
        hashes = _lane_hash(lanes)
        by = np.argsort(hashes)
        new = np.append(True, hashes[by][1:] != hashes[by][:-1])[: len(by)]
        first = by[new]  # of each distinct hash, by ascending hash, a chunk
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        # longer chunks, and those whose hash another one has, are told apart as strings
        odd = (sizes > EXACT) | (lanes != lanes[first][which]).any(1)
        entry = self.known.find(hashes[first], lanes[first])
        odd |= (entry == -2)[which]
        entry[sizes[first] > EXACT] = -2
        if len(self.known.n) + (entry == -1).sum() > self.most:
            used = entry >= 0
            self.known.keep(entry[used])
            entry[used] = np.arange(used.sum())
        if (fresh := entry == -1).any():
            entry[fresh] = self.known.add(hashes[first[fresh]], lanes[first[fresh]], self._chunk_ids([text_of(k) for k in first[fresh].tolist()]))
        pool, entry, at, n = self.known.pool, entry[which], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[~odd], n[~odd] = self.known.at[entry[~odd]], self.known.n[entry[~odd]]
        if len(places := np.flatnonzero(odd)):
            chunks = [text_of(k) for k in places.tolist()]
            distinct = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
            ids = self._chunk_ids(list(distinct))
            long = np.array([len(x) // 4 for x in ids], np.int64)
            of = np.array([distinct[c] for c in chunks], np.int64)
            at[places], n[places] = (len(pool) + np.cumsum(long) - long)[of], long[of]
            pool = np.append(pool, np.frombuffer(b"".join(ids), "<u4"))
        out = pool[_spread(at, n)]
        cuts = np.append(0, np.cumsum(n))[rows].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def __call__(self, texts: list[str] | pa.Array) -> list[list[bytes]]:
        """For each text its ids and the end id, in parts."""
        texts = plain(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        out: list[list[bytes]] = [[] for _ in range(len(texts))]
        whole = np.zeros(len(texts), bool) if self.parted else np.ones(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        size = pc.binary_length(texts).to_numpy()
        alone = np.flatnonzero((whole | (size > PIECE_CHARS)) & (size > 0))
        for k in alone.tolist():
            text = texts[k].as_py()
            out[k] = [self._ids([text])[0]] if whole[k] else [self._chunked(pa.array([part], pa.string()))[0] for part in self._parts(text)]
        short = np.setdiff1d(np.flatnonzero(size > 0), alone)
        if len(short):
            for k, ids in zip(short.tolist(), self._chunked(texts if len(short) == len(texts) else texts.take(pa.array(short))), strict=True):
                out[k] = [ids]
        for parts in out:
            parts.append(self.end)
        return out


_ENCODERS: dict[tuple[int, int | None], Encoder] = {}


def _encoder(spec: str, end_id: int | None) -> Encoder:
    """The worker process's encoder, which keeps what it has encoded from task to task."""
    key = (hash(spec), end_id)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, end_id)
    return _ENCODERS[key]


# --- Spark ------------------------------------------------------------------------------------------------------------


def filesystem(path: str):
    """(file system, path in it) of a folder's URI or local path, as pyarrow knows it (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_ids(docs: DataFrame, path: str, to: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of ``docs`` in ascending id order into the folder ``to`` and returns its table of files: part, file, n_docs, n_tokens.

    path: a tokenizers JSON file, read by the driver.  end_id: appended to each document (None: nothing)."""
    spark = docs.sparkSession
    integral(docs, id_col)
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(-(-total // file_bytes)) or 1
    # rows that share an id are dealt out by text, then by place; among themselves they have no order to keep
    placed = source.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k"))
    ordered = placed.repartitionByRange(parts, "doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "k").select("doc_id", "text")
    folder = filesystem(to)[1]
    filesystem(to)[0].create_dir(folder, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(to)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:07d}-{uuid.uuid4().hex}.planes"
        encoder, n_docs = _encoder(sent.value, end_id), 0
        with files.open_output_stream(f"{where}/{name}") as out:
            writer = PlaneWriter(out, block, bits)
            for batch in batches:
                texts, ids = plain(batch.column("text")), batch.column("doc_id").to_pylist()
                for lo, hi in slices(texts, ENCODE_BYTES):
                    for doc_id, data in zip(ids[lo:hi], encoder(texts.slice(lo, hi - lo)), strict=True):
                        writer.add(doc_id, data)
                n_docs += len(ids)
            writer.close()
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["part", "file", "n_docs", "n_tokens"])

    written = ordered.mapInArrow(write, "part bigint, file string, n_docs bigint, n_tokens bigint")
    written.write.mode("overwrite").parquet(f"{to}/index")
    sent.destroy()
    index = spark.read.parquet(f"{to}/index")
    named = {r[0] for r in index.select("file").toLocalIterator()}
    files = filesystem(to)[0]
    from pyarrow import fs

    for info in files.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".planes") and info.base_name not in named:  # of empty ranges and of tasks that were run again
            files.delete_file(info.path)
    return index


def _located(spark: SparkSession, path: str) -> DataFrame:
    """(file, start) with one file a partition; there is a row per file, so their order is one small sort."""
    index = spark.read.parquet(f"{path}/index")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = index.withColumn("start", before).select("part", "file", "start")
    return located.repartitionByRange(max(1, index.count()), "part").select("file", "start")


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of a folder that ``write_ids`` wrote: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), and with ``ids`` the ids themselves."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = filesystem(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with files.open_input_file(f"{where}/{name}") as source:
                    opened = PlaneFile.open(source)
                    starts = start + np.cumsum(opened.sizes) - opened.sizes
                    at, crcs, held, size = 0, [], [], 0
                    n = len(opened.sizes)
                    for k, parts in enumerate(opened.documents(), 1):
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.data, crc)
                        crcs.append(crc)
                        if ids:
                            held.append(np.concatenate([*parts, np.empty(0, np.uint32)]))
                            size += len(held[-1])
                        if k == n or len(crcs) >= 10_000 or size >= 1 << 20:
                            columns = [pa.array(opened.doc_ids[at:k], pa.int64(), mask=~opened.valid[at:k]), pa.array(starts[at:k], pa.int64()), pa.array(opened.sizes[at:k], pa.int64()), pa.array(crcs, pa.int64())]
                            if ids:
                                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(opened.sizes[at:k])), pa.int32()), pa.array(np.concatenate(held).astype(np.int32))))
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                            at, crcs, held, size = k, [], [], 0

    return _located(spark, path).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def read_span(spark: SparkSession, path: str, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of the whole folder, counted from 0, as a trainer reads a window: only the blocks that hold them are read."""
    located = _located(spark, path).join(spark.read.parquet(f"{path}/index"), "file").where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo))
    files, where = filesystem(path)
    out = []
    for name, start in located.select("file", "start").orderBy("start").collect():
        with files.open_input_file(f"{where}/{name}") as source:
            out.append(PlaneFile.open(source).span(max(lo - start, 0), hi - start))
    return np.concatenate([*out, np.empty(0, np.uint32)])


def token_files(docs: DataFrame, path: str, to: str, end_id: int | None = 2, **options) -> DataFrame:
    """Writes the ids of ``docs`` to ``to`` and reads them back: doc_id, start, n_tokens, ids_crc32."""
    write_ids(docs, path, to, end_id, **options)
    return read_ids(docs.sparkSession, to, ids=False)

