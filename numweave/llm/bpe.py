"""Byte-level BPE: encoding with cached pair merging, decoding by offsets.

``encode`` maps texts to token ids and the byte offset of every token;
``decode`` maps ids back to bytes. Pre-tokenisation is vectorised
(``pretok``); each distinct slice is merged once per worker and kept in a
cache of bounded size.

Null texts encode like empty ones: no ids. Rows are independent of each
other, so repeated rows give repeated results; extra columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretok

CHUNK_CHARS = 1 << 20          # code points handled at once by the vectorised steps
CACHE_SLICES = 1 << 18         # distinct slices a worker remembers
LONG_SLICE = 64                # longer slices are merged one by one


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)    # masks for the first k of 8 bytes
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)        # odd multipliers of the mixing step


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of 'base64 rank' lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys left * 2^32 + right, id of the joined token) over all pairs
    of tokens whose bytes together are a token, and the id of each byte."""
    ranks = load_ranks(path)
    key, to = [], []
    for t, r in ranks.items():
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i]), ranks.get(t[i:])
            if a is not None and b is not None:
                key.append(a << 32 | b)
                to.append(r)
    key, to = np.array(key, np.int64), np.array(to, np.int64)
    order = np.argsort(key)
    return key[order], to[order], np.array([ranks[bytes([c])] for c in range(256)], np.int64)


def merge_all(pieces: list[bytes], path: str) -> list[list[int]]:
    """Ids of many slices. In each round every unfinished slice joins its
    adjacent pair of lowest rank (the leftmost on ties), all slices at once."""
    ranks = load_ranks(path)
    out: list = [None] * len(pieces)
    todo = []
    for i, p in enumerate(pieces):
        r = ranks.get(p)
        if r is not None:
            out[i] = (r,)
        elif len(p) > LONG_SLICE:
            out[i] = _merge_long(p, ranks)
        else:
            todo.append(i)
    if not todo:
        return out
    keys, to, of_byte = _pairs(path)
    none = np.int64(1) << 40

    def rank_of(left, right):
        k = left << 32 | right
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return np.where(keys[at] == k, to[at], none)

    todo = np.array(todo)
    size = np.fromiter((len(pieces[i]) for i in todo), np.int64, len(todo))
    tok = of_byte[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
    start = np.cumsum(size) - size
    rank = np.full(len(tok), none)                  # of the pair that begins here
    rank[:-1] = rank_of(tok[:-1], tok[1:])
    rank[start + size - 1] = none
    while len(todo):
        low = np.minimum.reduceat(rank, start)
        over = low == none
        if over.any():
            for i, a, n in zip(todo[over].tolist(), start[over].tolist(), size[over].tolist()):
                out[i] = tok[a:a + n].tolist()
            keep = np.repeat(~over, size)
            tok, rank = tok[keep], rank[keep]
            todo, size, low = todo[~over], size[~over], low[~over]
            start = np.cumsum(size) - size
            if not len(todo):
                break
        hit = np.flatnonzero(rank == np.repeat(low, size))
        hit = hit[np.searchsorted(hit, start)]      # leftmost in each slice
        tok[hit] = rank[hit]
        keep = np.ones(len(tok), bool)
        keep[hit + 1] = False
        tok, rank = tok[keep], rank[keep]
        hit -= np.arange(len(hit))                  # one position was removed in each earlier slice
        size = size - 1
        start = np.cumsum(size) - size
        ends = hit == start + size - 1
        rank[hit] = np.where(ends, none, rank_of(tok[hit], tok[np.minimum(hit + 1, len(tok) - 1)]))
        left = hit[hit > start]
        rank[left - 1] = rank_of(tok[left - 1], tok[left])
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same order of merges for one slice, with a heap over linked parts:
    n log n, for slices without a break such as long runs of letters."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))                     # end[i]: where the part that begins at i stops
    prev = list(range(-1, n - 1))
    alive = [True] * n
    get = ranks.get
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = get(piece[i:end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class SliceCache:
    """Ids of distinct slices, kept flat: slice -> number, number -> ids.

    ``resolve`` gives ids for slices not seen before: (number of ids per slice,
    the ids of all in order). The cache starts anew
    once it holds CACHE_SLICES slices, so its memory is bounded.
    """

    def __init__(self, resolve):
        self.resolve = resolve
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)     # ids[first[k] : first[k + 1]] belong to slice k

    def lookup(self, raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices raw[cut[i] : cut[i + 1]] in order, number of ids
        per slice). Equal slices are found by sorting, so Python sees each
        distinct slice of the chunk once."""
        if len(self.number) > CACHE_SLICES:
            self.clear()
        if len(cut) < 2:
            return self.ids[:0], np.zeros(0, np.int64)
        group, sample = distinct_slices(raw, cut)
        number = self.number
        pieces = [raw[a:b] for a, b in zip(cut[sample].tolist(), cut[sample + 1].tolist())]
        numbers = list(map(number.get, pieces))
        at = [i for i, k in enumerate(numbers) if k is None]
        if at:
            new = [pieces[i] for i in at]                # no two alike
            sizes, found = self.resolve(new)
            k = len(number)
            self._reserve(k + len(new) + 1, int(self.first[k] + sizes.sum()))
            self.first[k + 1:k + 1 + len(new)] = self.first[k] + np.cumsum(sizes)
            self.ids[self.first[k]:self.first[k + len(new)]] = np.fromiter(found, np.uint32, int(sizes.sum()))
            number.update(zip(new, range(k, k + len(new))))
            for j, i in enumerate(at, k):
                numbers[i] = j
        which = np.array(numbers, np.int64)[group]
        begin = self.first[which]
        count = self.first[which + 1] - begin
        return self.ids[ranges(begin, count)], count

    def _reserve(self, slices: int, ids: int):
        if slices > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(slices, np.int64)])
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(ids, np.uint32)])


def distinct_slices(raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number of each slice, one slice per group): slices in a group
    are equal byte for byte. Slices of up to 16 bytes are compared as two
    integers and a length, longer ones as Python objects."""
    begin, size = cut[:-1], np.diff(cut)
    group = np.empty(len(size), np.int64)
    short = np.flatnonzero(size <= 16)
    sample = np.zeros(0, np.int64)
    if len(short):
        data = np.frombuffer(raw + bytes(16), np.uint8)
        window = np.lib.stride_tricks.sliding_window_view(data, 16)[begin[short]]
        words = np.ascontiguousarray(window).view(np.uint64).reshape(-1, 2)
        n = size[short]
        lo = words[:, 0] & _LOW_BYTES[np.minimum(n, 8)]
        hi = words[:, 1] & _LOW_BYTES[np.maximum(n - 8, 0)]
        mixed = (lo ^ hi * _ODD[0] ^ n.astype(np.uint64)) * _ODD[1]
        mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)                   # any slice of a group may stand for it, so the sort need not be stable
        new = np.ones(len(order), bool)
        new[1:] = mixed[order[1:]] != mixed[order[:-1]]
        first = order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        same = (lo == lo[first][inverse]) & (hi == hi[first][inverse]) & (n == n[first][inverse])
        group[short] = inverse
        sample = short[first]
        short = short[~same]                        # mixed alike but differ: left to the exact way below
    rest = np.concatenate([np.flatnonzero(size > 16), short])
    if len(rest):
        at: dict[bytes, int] = {}
        more = []
        for i, a, b in zip(rest.tolist(), cut[rest].tolist(), cut[rest + 1].tolist()):
            k = at.setdefault(raw[a:b], len(sample) + len(at))
            if k == len(sample) + len(more):
                more.append(i)
            group[i] = k
        sample = np.concatenate([sample, np.array(more, np.int64)])
    return group, sample


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (count[0] of them), begin[1], ..."""
    total = int(count.sum())
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return shift + np.arange(total)


@lru_cache(2)
def _merging_cache(path: str) -> SliceCache:
    def resolve(pieces):
        found = merge_all(pieces, path)
        return np.fromiter(map(len, found), np.int64, len(found)), chain.from_iterable(found)

    return SliceCache(resolve)


@lru_cache(2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in one array, with start and length by id."""
    ranks = load_ranks(path)
    n = max(ranks.values()) + 1
    size = np.zeros(n, np.int64)
    for t, i in ranks.items():
        size[i] = len(t)
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint8)
    for t, i in ranks.items():
        flat[start[i]:start[i] + len(t)] = np.frombuffer(t, np.uint8)
    return flat, start, size


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """Consecutive groups of texts of about ``limit`` code points; a longer
    text is a group of its own."""
    group, chars = [], 0
    for t in texts:
        if group and chars + len(t) > limit:
            yield group
            group, chars = [], 0
        group.append(t)
        chars += len(t)
    if group:
        yield group


def encode_texts(texts: list[str], cache: SliceCache) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a chunk in order, number of ids per text)."""
    raw, cut, slices = pretok.boundaries(texts)
    ids, per_slice = cache.lookup(raw, cut)
    upto = np.concatenate([[0], np.cumsum(per_slice)])
    return ids, np.diff(upto[np.concatenate([[0], np.cumsum(slices)])])


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids array<int>, offsets array<int>.

    offsets[i] is the first byte of token i in the UTF-8 text; a last entry
    holds the length, so token i covers offsets[i] .. offsets[i + 1].
    """

    def run(batches):
        cache = _merging_cache(ranks_path)
        _, _, size = _vocabulary(ranks_path)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row = 0
            for group in chunks(texts):
                ids, per_text = encode_texts(group, cache)
                upto = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
                length = np.cumsum(size[ids])                       # bytes up to and with each token
                length = np.concatenate([[0], length])
                # per text: n + 1 offsets that begin at 0
                picks = ranges(upto[:-1].astype(np.int64), per_text + 1)
                offs = length[picks] - np.repeat(length[upto[:-1]], per_text + 1)
                yield pa.RecordBatch.from_arrays([
                    keys.slice(row, len(group)),
                    pa.ListArray.from_arrays(pa.array(upto), pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array((upto + np.arange(len(upto))).astype(np.int32)),
                                             pa.array(offs.astype(np.int32))),
                ], names=["key", "ids", "offsets"])
                row += len(group)

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, ids array<int>, offsets array<int>")
            .withColumnRenamed("key", key))


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id") -> DataFrame:
    """The bytes of every row of ``encode``: all its columns plus
    decoded binary. The offsets say where each token's bytes go."""

    def run(batches):
        flat, start, size = _vocabulary(ranks_path)
        for batch in batches:
            ids, offs = batch.column(1), batch.column(2)
            n = np.diff(ids.offsets.to_numpy())
            vals = ids.flatten().to_numpy()
            marks = offs.flatten().to_numpy()
            ends = np.cumsum(n + 1)
            total = marks[ends - 1].astype(np.int64) if len(n) else np.zeros(0, np.int64)
            begin = np.ones(len(marks), bool)
            begin[ends - 1] = False
            parts, lo = [], 0
            for hi in _cuts(n):                                     # bounded pieces of the batch
                a, b = int(n[:lo].sum()), int(n[:hi].sum())
                v = vals[a:b]
                parts.append(flat[ranges(start[v], size[v])])
                lo = hi
            blob = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            where = np.concatenate([[0], np.cumsum(total)])
            if where[-1] != len(blob):
                raise ValueError("offsets do not cover the decoded bytes")
            buf = blob.tobytes()
            out = [buf[x:y] for x, y in zip(where.tolist(), where.tolist()[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, offs, pa.array(out, pa.binary())], names=["key", "ids", "offsets", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return (encoded.select(encoded[key].alias("key"), "ids", "offsets")
            .mapInArrow(run, f"key {kind}, ids array<int>, offsets array<int>, decoded binary")
            .withColumnRenamed("key", key))


def _cuts(n: np.ndarray, limit: int = 1 << 20):
    """Row numbers at which about ``limit`` tokens are complete."""
    upto = np.cumsum(n)
    at, last = [], 0
    for i, u in enumerate(upto.tolist()):
        if u - last >= limit:
            at.append(i + 1)
            last = u
    if not at or at[-1] != len(n):
        at.append(len(n))
    return at
