"""Byte-level BPE by a rank file: encoding without a regex, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geonear.llm.common import slices_of, texts_of, with_fields
from geonear.llm.pretokens import byte_slices

CHUNK = 1 << 20  # bytes of text, or of ids, that a worker handles at a time
CACHED = 400_000  # slices whose ids a Python worker remembers
LONG = 64  # bytes from which a slice is merged with a heap


@lru_cache(maxsize=2)
def read_ranks(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """The rank file both ways round."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return ranks, {i: b for b, i in ranks.items()}


def decode_ids(vocabulary: dict[int, bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(vocabulary.__getitem__, ids.tolist()))


class RankCoder:
    """Encodes slices by ``ranks``: bytes to id, the smaller id merging first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        # Every pair of ids that makes a token together, as left << 32 | right.
        pairs = [
            (ranks[b[:i]] << 32 | ranks[b[i:]], rank)
            for b, rank in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks
        ]
        self.merged = dict(pairs)
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self._keys, self._ranks = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], 0)
        get = self.merged.get
        self._byte_ranks = np.array(
            [get(a << 32 | b, 1 << 62) for a in self.byte_ids for b in self.byte_ids], np.int64)
        self._cache: dict[bytes, bytes] = {b: i.to_bytes(4, "little") for b, i in ranks.items()}
        self._fixed = len(self._cache)

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> RankCoder:
        return cls(read_ranks(path)[0])

    def merge_one(self, piece: bytes) -> bytes:
        """Ids of one slice in time ``n log n``: smallest rank first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.merged.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := left[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short slices, one merge in each per round."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.array(self.byte_ids, np.int64)[data]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        worst = np.int64(1 << 62)
        # Rank of each id with the next of its slice; after a merge only its two sides change.
        rank = np.full(len(ids), worst)
        rank[:-1] = self._byte_ranks[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[:-1][owner[:-1] != owner[1:]] = worst
        done_ids, done_owner = [], []
        while len(ids):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            # Rank and place in one number: the smallest is the leftmost of the best.
            best = np.minimum.reduceat(np.where(rank < worst, rank << 36 | np.arange(len(ids)), worst), heads)
            live = best < worst
            stay = np.repeat(live, np.diff(np.append(heads, len(ids))))
            done_ids.append(ids[~stay])
            done_owner.append(owner[~stay])
            place = best[live] & ((1 << 36) - 1)
            ids[place] = best[live] >> 36
            stay[place + 1] = False
            at = (np.cumsum(stay) - 1)[place]
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            rank[at] = worst
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[at + 1 < len(ids)]
            at = at[owner[at] == owner[at + 1]]
            key = ids[at] << 32 | ids[at + 1]
            found = np.searchsorted(self._keys, key)
            rank[at] = np.where(self._keys[found] == key, self._ranks[found], worst)
        order_owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        order = np.argsort(order_owner, kind="stable")  # a slice ends whole in one round
        flat = flat[order].astype("<u4")
        ends = np.cumsum(np.bincount(order_owner, minlength=len(pieces))) * 4
        data, begin, out = flat.tobytes(), 0, []
        for end in ends.tolist():
            out.append(data[begin:end])
            begin = end
        return out

    def ids_of(self, slices: list[bytes]) -> list[bytes]:
        """Ids of every slice, as little-endian 32-bit numbers."""
        cache = self._cache
        values = list(map(cache.get, slices))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            new = list({slices[i] for i in missing})
            if len(cache) + len(new) > self._fixed + CACHED:
                cache = self._cache = {b: i.to_bytes(4, "little") for b, i in self.ranks.items()}
            short = [s for s in new if len(s) < LONG]
            cache.update(zip(short, self.merge_many(short)))
            cache.update((s, self.merge_one(s)) for s in new if len(s) >= LONG)
            for i in missing:
                values[i] = cache[slices[i]]
        return values


def bpe_encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and the offsets of its slices, all as binary columns.

    ``ids`` holds little-endian unsigned 32-bit token ids; ``slice_bytes`` the
    first byte of each pre-token in the text's UTF-8, and ``slice_ids`` the
    number of ids before it, in the same format, so that any slice can be
    decoded by itself. Columns of these names are replaced, others kept. A
    null text counts as empty and has no ids. ``ranks_path`` is the place of
    a public rank file on every executor.
    """
    base = docs.drop("ids", "slice_bytes", "slice_ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = RankCoder.load(ranks_path)
        for batch in slices_of(batches, text_col, CHUNK):
            columns: tuple[list, list, list] = ([], [], [])
            slices, first, offset = byte_slices(texts_of(batch, text_col))
            values = coder.ids_of(slices)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
            before = np.cumsum(sizes) - sizes
            bounds = first.tolist()
            for i, j in zip(bounds, bounds[1:]):
                columns[0].append(b"".join(values[i:j]))
                columns[1].append(offset[i:j].astype("<u4").tobytes())
                columns[2].append((before[i:j] - (before[i] if i < j else 0)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, pa.binary()) for c in columns)],
                names=[*batch.schema.names, "ids", "slice_bytes", "slice_ids"])

    kind = T.BinaryType()
    return base.mapInArrow(encode, with_fields(base, ids=kind, slice_bytes=kind, slice_ids=kind))


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; null ids decode to no bytes."""
    base = encoded.drop(out_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = read_ranks(ranks_path)[1]
        for batch in slices_of(batches, ids_col, CHUNK):
            found = [decode_ids(vocabulary, np.frombuffer(v or b"", "<u4")) for v in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out_col])

    return base.mapInArrow(decode, with_fields(base, **{out_col: T.BinaryType()}))
