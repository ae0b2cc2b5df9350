"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (a chunk starts at a run of word marks) are laid out as one text.  Its positions are
sorted as a suffix array by prefix doubling, as deep as the longest piece; every vocabulary piece finds its range of
occurrences by binary search; the occurrences become edges (position, length, piece), sorted by position.

Relaxation: the model's own rule.  For a BPE model that is the order of merge scores, not the best sum: starting from
single characters, two neighbours may join along an edge, and in each round every chunk joins its best-scored, leftmost
edge.  (The path of best summed score differs from what a BPE model means, so it isn't used; models of other types are
refused.)  Characters without a piece fall back to their bytes.

Nulls and edge cases: a null text counts as empty, and an empty text has no ids; the mark U+2581 inside a text decodes
as a space, as in the library; texts are never cut; repeated rows are encoded each; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import mapped, plain, slices, spare

MARK = "▁"
#: Chunks that an encoder keeps: some 200 bytes each.
CACHE = 200_000
#: Chunks up to so many characters merge in arrays; longer ones one by one with a heap.
ARRAY_CHARS = 48
_NONE = np.int64(1) << 40


@dataclass
class Pieces:
    """A BPE vocabulary: pieces of two or more characters as packed code rows, single characters, bytes, ranks."""

    texts: list[str]
    codes: dict[int, int]
    packed: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    rank: np.ndarray
    single: dict[str, int]
    bytes_: list[int]
    unknown: int
    depth: int
    whole: bool
    control: set[int] = field(default_factory=set)


def load(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    probe = sp.encode("x", out_type=str)
    if not probe or not probe[0].startswith(MARK) or sp.encode("x   ﬁ ", out_type=str) and sp.decode(sp.encode("x   ﬁ ")) != "x   ﬁ ":
        raise ValueError("only models with a dummy prefix and the identity normaliser are supported")
    texts, single, many, bytes_, control = [sp.id_to_piece(i) for i in range(n)], {}, [], [-1] * 256, set()
    for i, text in enumerate(texts):
        if sp.is_byte(i):
            bytes_[int(text[3:5], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            control.add(i)
        elif len(text) == 1:
            single[text] = i
        else:
            many.append(i)
    if any(len(texts[i]) >= 64 for i in many):
        raise ValueError("pieces of 64 characters or more are not supported")
    depth = 4
    while depth < max((len(texts[i]) for i in many), default=2):
        depth *= 2
    codes = {ord(c): k for k, c in enumerate(sorted({c for i in many for c in texts[i]}), 1)}
    if len(codes) > 65_000:
        raise ValueError("too many distinct characters")
    packed = np.zeros((len(many), depth), np.uint64)
    for k, i in enumerate(many):
        packed[k, : len(texts[i])] = [codes[ord(c)] for c in texts[i]]
    scores = np.array([sp.get_score(i) for i in range(n)])
    if (scores != np.rint(scores)).any():
        raise ValueError("only BPE models, whose scores are merge ranks, are supported")
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # equal scores: the leftmost joins first
    whole = any(MARK in texts[i].lstrip(MARK) for i in many)
    return Pieces(texts, codes, _pack(packed), np.array([len(texts[i]) for i in many], np.int64), np.array(many, np.int64), rank, single, bytes_, sp.unk_id(), depth, whole, control)


def _pack(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as rows of four codes to a 64-bit number."""
    c = codes.reshape(len(codes), -1, 4)
    return (c[..., 0] << np.uint64(48)) | (c[..., 1] << np.uint64(32)) | (c[..., 2] << np.uint64(16)) | c[..., 3]


def suffix_array(c: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of codes ``c`` (0 parts chunks) in order of the next ``depth`` codes, and four packed codes from each position on."""
    n = len(c)
    padded = np.concatenate([c, np.zeros(depth, np.uint64)])
    four = (padded[:n] << np.uint64(48)) | (padded[1 : n + 1] << np.uint64(32)) | (padded[2 : n + 2] << np.uint64(16)) | padded[3 : n + 3]
    key, width = four, 4
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order, np.concatenate([four, np.zeros(depth, np.uint64)])
        ranked = key[order]
        rank = np.zeros(n + depth, np.uint64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])).astype(np.uint64) + np.uint64(1)
        key = (rank[:n] << np.uint64(32)) | rank[width : n + width]
        width *= 2


def _bound(order: np.ndarray, four: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each row of ``target``: how many suffixes sort before it."""
    lo, hi = np.zeros(len(target), np.int64), np.full(len(target), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        at = order[mid]
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for level in range(target.shape[1]):
            have, want = four[at + 4 * level], target[open_, level]
            less |= same & (have < want)
            same &= have == want
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    return lo


def edges(c: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the pieces: keys (position * 64 + length), ascending, and their piece ids."""
    order, four = suffix_array(c, p.depth)
    shift = (np.arange(p.depth)[None, :] >= p.lengths[:, None]).reshape(len(p.lengths), -1, 4)
    fill = _pack(np.where(shift, np.uint64(0xFFFF), np.uint64(0)).reshape(len(p.lengths), -1))
    lo, hi = _bound(order, four, p.packed), _bound(order, four, p.packed | fill)
    times = np.maximum(hi - lo, 0)
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
    keys = order[at] * 64 + np.repeat(p.lengths, times)
    by = np.argsort(keys)
    return keys[by], np.repeat(p.ids, times)[by]


class Encoder:
    """Encodes texts, with a bounded cache of chunks."""

    def __init__(self, p: Pieces, cache: int = CACHE):
        self.p, self.most, self.known = p, cache, {}
        lone = "" if "\n" in {chr(c) for c in p.codes} else "\n"  # such a character never joins: it parts chunks too
        self.chunks = (lambda t: [t]) if p.whole else re.compile(f"{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" + f"|{lone}" * bool(lone)).findall

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        parted = [self.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*parted).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known = {c: self.known[c] for c in set().union(*parted) if c in self.known}
        if new := list(new):
            self.known.update(zip(new, self.encode_chunks(new), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, chunks)), np.int32) for chunks in parted]

    def char_ids(self, c: str) -> list[int]:
        if c in self.p.single:
            return [self.p.single[c]]
        ids = [self.p.bytes_[b] for b in c.encode()]
        return ids if min(ids) >= 0 else [self.p.unknown]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        p = self.p
        raw = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in chunks], np.int64)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        distinct, which = np.unique(raw, return_inverse=True)
        c = np.array([p.codes.get(int(x), 0) for x in distinct], np.uint64)[which]
        c[first + sizes] = 0  # a NUL inside a chunk has no code either
        keys, ids = edges(c, p)
        keys, ids = np.append(keys, np.int64(1) << 62), np.append(ids, 0)
        short = sizes <= ARRAY_CHARS
        start, length = self._merge_arrays(first[short], sizes[short], keys, ids)
        for k in np.flatnonzero(~short).tolist():
            s, n = self._merge_heap(int(first[k]), int(sizes[k]), keys, ids)
            start, length = np.concatenate([start, s]), np.concatenate([length, n])
        by = np.argsort(start)
        start, length = start[by], length[by]
        out = ids[np.minimum(np.searchsorted(keys, start * 64 + length), len(ids) - 1)].astype(np.int32)
        lone = length == 1
        table = [self.char_ids(chr(int(x))) for x in distinct]
        one = np.array([t[0] for t in table], np.int32)
        out[lone] = one[which[start[lone]]]
        many = np.array([len(t) > 1 for t in table], bool)
        cut = np.searchsorted(start, first)
        spread = np.flatnonzero(lone & many[which[start]])
        if len(spread):
            extra = [table[which[start[k]]][1:] for k in spread.tolist()]
            counts = np.ones(len(out), np.int64)
            counts[spread] += [len(x) for x in extra]
            new_at = np.cumsum(counts) - counts
            wide = np.empty(int(counts.sum()), np.int32)
            wide[new_at] = out
            for k, x in zip(spread.tolist(), extra, strict=True):
                wide[new_at[k] + 1 : new_at[k] + 1 + len(x)] = x
            cut, out = np.append(new_at, len(wide))[cut], wide
        cut = np.append(cut, len(out))
        data = out.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _lookup(self, start: np.ndarray, length: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        want = start * 64 + length
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where((keys[at] == want) & (length < 64), self.p.rank[ids[at]], _NONE)

    def _merge_arrays(self, first: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_s, done_l = [], []
        total = int(sizes.sum())
        head = np.cumsum(sizes) - sizes
        start = np.arange(total) - np.repeat(head, sizes) + np.repeat(first, sizes)
        length = np.ones(total, np.int64)
        rank = np.full(total, _NONE, np.int64)  # of the pair that begins at each symbol
        inner = np.ones(total, bool)
        inner[head + sizes - 1] = False
        rank[inner] = self._lookup(start[inner], np.full(int(inner.sum()), 2), keys, ids)
        while total:
            least = np.minimum.reduceat(rank, head)
            alive = least < _NONE
            live = np.repeat(alive, sizes)
            done_s.append(start[~live])
            done_l.append(length[~live])
            start, length, rank, sizes, least = start[live], length[live], rank[live], sizes[alive], least[alive]
            total = len(start)
            if not total:
                break
            head = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            owner = np.searchsorted(head, hit, "right") - 1
            place = hit[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each chunk
            length[place] += length[place + 1]
            keep = np.ones(total, bool)
            keep[place + 1] = False
            moved = np.cumsum(keep) - 1
            start, length, rank = start[keep], length[keep], rank[keep]
            sizes = sizes - 1
            head = np.cumsum(sizes) - sizes
            total = len(start)
            last = np.zeros(total + 1, bool)
            last[head + sizes - 1] = True
            is_head = np.zeros(total, bool)
            is_head[head] = True
            place = moved[place]
            left = place[~is_head[place]] - 1
            for at in (place, left):
                rank[at] = _NONE
                at = at[~last[at]]
                rank[at] = self._lookup(start[at], length[at] + length[at + 1], keys, ids)
        return np.concatenate([*done_s, np.empty(0, np.int64)]), np.concatenate([*done_l, np.empty(0, np.int64)])

    def _merge_heap(self, first: int, size: int, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(keys, first * 64), np.searchsorted(keys, (first + size) * 64)
        edge = dict(zip((keys[lo:hi] - first * 64).tolist(), self.p.rank[ids[lo:hi]].tolist(), strict=True))
        length, after, before = [1] * size, list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, 2) for i in range(size - 1) if (r := edge.get(i * 64 + 2)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, n = heapq.heappop(heap)
            j = after[i]
            if not length[i] or j >= size or length[i] + length[j] != n:
                continue
            length[i], length[j] = n, 0
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (m := n + length[k]) < 64 and (r := edge.get(i * 64 + m)) is not None:
                    heapq.heappush(heap, (r, i, m))
            h = before[i]
            if h >= 0 and (m := length[h] + n) < 64 and (r := edge.get(h * 64 + m)) is not None:
                heapq.heappush(heap, (r, h, m))
        n = np.array(length, np.int64)
        at = np.flatnonzero(n)
        return at + first, n[at]


def decode(ids, p: Pieces) -> str:
    """The text of piece ids: marks become spaces, byte pieces their bytes, the dummy prefix goes."""
    of_byte = {i: b for b, i in enumerate(p.bytes_)}
    out, held = [], bytearray()
    for i in map(int, ids):
        if i in of_byte:
            held.append(of_byte[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held.clear()
        if i not in p.control:
            out.append(p.texts[i])
        elif i == p.unknown:
            out.append(" ⁇ ")
    out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


class Decoder:
    """Decodes many id arrays at once through one byte table."""

    def __init__(self, p: Pieces):
        texts = [(" ⁇ " if i == p.unknown else "") if i in p.control else t.replace(MARK, " ") for i, t in enumerate(p.texts)]
        self.table = [t.encode() for t in texts]
        for b, i in enumerate(p.bytes_):
            if i >= 0:
                self.table[i] = bytes([b])

    def __call__(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.table.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """The rows of ``docs`` with piece_ids (keep_ids), n_pieces, piece_sha256 (of the little-endian 32-bit ids), round_trip; where ``docs`` has such a column, the new one's name ends in an underscore."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    added = [("piece_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] * keep_ids + [("n_pieces", T.LongType(), pa.int64()), ("piece_sha256", T.StringType(), pa.string()), ("round_trip", T.BooleanType(), pa.bool_())]
    names = docs.columns
    at = names.index(text_col)
    as_ = spare(names, *[n for n, _, _ in added])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's own: a worker lives on into other stages, which need the memory of the kept chunks
        encoder, decoder = Encoder(sent.value), Decoder(sent.value)
        for batch in batches:
            texts = plain(batch.column(at))
            for lo, hi in slices(texts, 2 << 20):
                part = texts.slice(lo, hi - lo).to_pylist()
                ids = encoder(part)
                new = {"n_pieces": [len(x) for x in ids], "piece_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids], "round_trip": [decoder(x) == t for x, t in zip(ids, part, strict=True)]}
                columns = [pa.array(new[n], kind) if n in new else pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new["n_pieces"])), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32())) for n, _, kind in added]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *columns], [*names, *as_])

    return mapped(docs, encode, T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, (_, t, _) in zip(as_, added, strict=True)]]))


def decoded(rows: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """The rows with ``text_col`` made from ``ids_col`` (null ids: null text)."""
    sent = rows.sparkSession.sparkContext.broadcast(load(path))

    @F.pandas_udf("string")
    def text(ids):
        decoder = Decoder(sent.value)
        return ids.map(lambda x: None if x is None else decoder(np.asarray(x, np.int64)))

    return rows.withColumn(text_col, text(F.col(ids_col)))
