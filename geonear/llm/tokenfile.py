"""Token-id files compressed by Re-Pair grammars, with random access.

A token file is a Parquet folder whose rows are blocks. A block holds the ids
of consecutive documents of one shard as the symbols of a grammar: numbers
below ``first_rule`` are token ids, ``first_rule + i`` stands for the pair
``rules[i]``. Rules never join two documents, so each is a slice of the
symbols. The numbers are little-endian and unsigned, of 32 bits unless said
otherwise.

======================  =====================================================
``shard, block``        place of the block; documents ascend over both
``base``                ids of the shard before this block
``n_ids``               ids of this block
``documents``           document ids, in order
``symbol_ends``         symbols up to the end of each document
``id_ends``             ids up to the end of each document
``first_rule``          smallest symbol that isn't a token id
``rules``               left and right symbol of each rule
``lengths``             ids that each rule expands to
``symbols``             the text of the grammar, in ``width`` bytes each
======================  =====================================================
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.bytebpe import CHUNK
from geonear.llm.common import runs, texts_of
from geonear.llm.pretokens import slice_bounds

BLOCK_IDS = 1 << 20  # ids of a block; only a document above it makes a larger one
PAIRS_PER_ROUND = 8192
MIN_COUNT = 16  # occurrences that make a pair worth a rule of 12 bytes, at 2 bytes a symbol saved
CACHED = 800_000  # slices whose ids a Python worker remembers
JOINED = 256  # words that the tokenizer is asked for in one text
_HASHED = 17  # bits of the table in which pairs are counted first


def _ends_as(values, dtype="<u4") -> bytes:
    return np.asarray(values, dtype).tobytes()


# --- the grammar ---------------------------------------------------------------


def _bucket(key: np.ndarray) -> np.ndarray:
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed >>= np.uint64(64 - _HASHED)
    return mixed.view(np.int64)


def _frequent_pairs(key: np.ndarray, last: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` frequent keys that occur ``least`` times, sorted, no two in one bucket.

    ``last`` marks keys that don't count. Then the places where one of those
    keys stands, and its number. Only if no key is that frequent, none is given.
    """
    bucket = _bucket(key)
    bucket[last] = 1 << _HASHED
    held = np.bincount(bucket, minlength=(1 << _HASHED) + 1)
    held[-1] = 0
    # No key is more frequent than its bucket: the fullest buckets are looked at first.
    full = held[held >= least]
    bounds = [least]
    if len(full) > most:
        bounds.insert(0, max(least, int(np.partition(full, len(full) - most)[len(full) - most])))
    for bound in bounds:
        near = np.flatnonzero((held >= bound)[bucket])
        asked = key[near]
        ordered = np.sort(asked)
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(near) else near
        found, count = ordered[head], np.diff(np.append(head, len(ordered)))
        found, count = found[count >= least], count[count >= least]
        if len(found):
            break
    found = found[np.lexsort((found, -count))][:most]
    # The most frequent of a bucket stays; the others' turn comes in a later round.
    chosen = np.sort(found[np.sort(np.unique(_bucket(found), return_index=True)[1])])
    number = np.zeros((1 << _HASHED) + 1, np.int64)
    number[_bucket(chosen)] = np.arange(len(chosen))
    if not len(chosen):
        return chosen, near[:0], near[:0]
    rank = number[bucket[near]]
    hit = chosen[rank] == asked
    return chosen, near[hit], rank[hit]


def repair(ids: np.ndarray, ends: np.ndarray, first_rule: int, rounds: int | None = None,
           pairs_per_round: int = PAIRS_PER_ROUND, min_count: int = MIN_COUNT):
    """``symbols, ends, rules, lengths`` of a grammar for ``ids``.

    ``ends`` are the documents' ends. Each round gives the most frequent
    adjacent pairs a symbol each and replaces their occurrences from left to
    right; later rounds pair those symbols in turn, until no pair occurs
    ``min_count`` times or the given number of rounds is over. A round's rules
    together expand to at most ``2 / min_count`` of all ids.
    """
    symbols = ids.astype(np.int64)
    last = np.zeros(len(symbols), bool)  # of its document
    filled = np.diff(np.concatenate([[0], ends])) > 0
    last[ends[filled] - 1] = True
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    while len(symbols) > 1 and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        key = symbols[:-1] << 32
        key |= symbols[1:]
        chosen, at, rank = _frequent_pairs(key, last[:-1], pairs_per_round, min_count)
        if not len(chosen):
            break
        # In a row of overlapping occurrences every other one is replaced, from the left.
        head = np.append(True, np.diff(at) != 1)
        order = np.arange(len(at))
        odd = (order - np.maximum.accumulate(np.where(head, order, 0))) & 1 == 1
        at, rank = at[~odd], rank[~odd]
        size = np.concatenate([np.ones(first_rule, np.int64), lengths])
        pair = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)
        symbols[at] = first_rule + len(rules) + rank
        last[at] = last[at + 1]
        rules, lengths = np.concatenate([rules, pair]), np.concatenate([lengths, size[pair].sum(axis=1)])
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
    new_ends = np.zeros(len(ends), np.int64)
    new_ends[filled] = np.flatnonzero(last) + 1
    return symbols, np.maximum.accumulate(new_ends) if len(ends) else new_ends, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The token ids of some symbols: every rule gives way to its pair until none is left."""
    symbols = symbols.astype(np.int64)
    while len(at := np.flatnonzero(symbols >= first_rule)):
        room = np.ones(len(symbols), np.int64)
        room[at] = 2
        place = np.cumsum(room) - room
        pair = rules[symbols[at] - first_rule]
        out = np.repeat(symbols, room)
        out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def _gather(values: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The lists ``index``, end to end, of lists laid end to end in ``values``, of ``size`` items each."""
    each = size[index]
    ends = np.cumsum(each)
    at = np.repeat((np.cumsum(size) - size)[index] - ends + each, each)
    at += np.arange(len(at))
    return values[at]


class Block:
    """One block of a token file."""

    def __init__(self, row: dict):
        self.row = row
        self.first_rule = row["first_rule"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
        self.symbol_ends = np.frombuffer(row["symbol_ends"], "<u4").astype(np.int64)
        self.id_ends = np.frombuffer(row["id_ends"], "<u4").astype(np.int64)

    def ids(self) -> np.ndarray:
        """All ids of the block. Every rule is expanded once, and its ids are copied to where it stands."""
        known = np.arange(self.first_rule)
        size = np.concatenate([np.ones(self.first_rule, np.int64), self.lengths])
        every = np.concatenate([known, expand(self.first_rule + np.arange(len(self.rules)), self.rules, self.first_rule)])
        return _gather(every, size, self.symbols)

    def document(self, i: int) -> np.ndarray:
        """Ids of the block's ``i``-th document; no other is expanded."""
        begin = self.symbol_ends[i - 1] if i else 0
        return expand(self.symbols[begin:self.symbol_ends[i]], self.rules, self.first_rule)

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the block, by the rules' lengths."""
        size = np.concatenate([np.ones(self.first_rule, np.int64), self.lengths])[self.symbols]
        reach = np.cumsum(size)
        a = int(np.searchsorted(reach, begin, "right"))
        b = int(np.searchsorted(reach, end, "left")) + 1
        before = int(reach[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.first_rule)[begin - before:end - before]


# --- writing and reading ---------------------------------------------------------


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    return found, {}


@lru_cache(maxsize=1)
def _added_tokens(path: str) -> list[str]:
    """Strings that the library looks for in a whole text before it cuts pre-tokens."""
    return [t.content for t in _tokenizer(path)[0].get_added_tokens_decoder().values()]


@lru_cache(maxsize=1)
def _token_bytes(path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary writes every byte as one character."""
    vocabulary = _tokenizer(path)[0].get_vocab()
    size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, i in vocabulary.items():
        size[i] = len(token)
    return size


def _is_word(piece: str) -> bool:
    # Another one may follow it in a text: the blank begins a pre-token of its own.
    return piece[:1] == " " and piece[1:].isalpha()


def _encode_slices(slices: list[bytes], path: str) -> dict[bytes, bytes]:
    """The library's ids of each pre-token, as 32-bit numbers.

    Words are asked for many at a time, in one text, and told apart by their
    bytes; should a word not end with a token, all are asked for one by one.
    """
    tokenizer = _tokenizer(path)[0]

    def ask(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    pieces = [s.decode("utf-8", "surrogatepass") for s in slices]
    words = [i for i, p in enumerate(pieces) if _is_word(p)]
    known: dict[bytes, bytes] = {}
    if words:
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        ids = np.concatenate(ask(["".join(pieces[i] for i in g) for g in groups]))
        reach = np.cumsum(_token_bytes(path)[ids])
        ends = np.cumsum(np.fromiter((len(slices[i]) for i in words), np.int64, len(words)))
        at = np.searchsorted(reach, ends)
        if at[-1] == len(reach) - 1 and np.array_equal(reach[at], ends):
            data, bounds = ids.tobytes(), [0, *((at + 1) * 4).tolist()]
            known = {slices[i]: data[a:b] for i, a, b in zip(words, bounds, bounds[1:])}
    rest = [i for i, s in enumerate(slices) if s not in known]
    known.update((slices[i], found.tobytes()) for i, found in zip(rest, ask([pieces[i] for i in rest])))
    return known


def encode_texts(texts: list[str], tokenizer_path: str) -> list[bytes]:
    """The library's ids of each text, as 32-bit numbers, without special tokens.

    A byte-level tokenizer encodes each pre-token by itself, so the library is
    asked once per distinct pre-token. A text with the string of an added token
    is given to it as a whole.
    """
    tokenizer, cache = _tokenizer(tokenizer_path)
    added = _added_tokens(tokenizer_path)
    whole = [i for i, t in enumerate(texts) if any(a in t for a in added)]
    if whole:
        texts = list(texts)
        asked = {i: texts[i] for i in whole}
        for i in whole:
            texts[i] = ""
    out: list[bytes] = []
    for a, b in runs(map(len, texts), CHUNK):
        data, begin, first, _ = slice_bounds(texts[a:b])
        slices = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype("<i8")), pa.py_buffer(data)])
        slices = slices.dictionary_encode()
        index, (_, at, held) = slices.indices.to_numpy(), slices.dictionary.buffers()
        at, held = np.frombuffer(at, "<i8", len(slices.dictionary) + 1).tolist(), held.to_pybytes() if held else b""
        distinct = [held[i:j] for i, j in zip(at, at[1:])]
        values = list(map(cache.get, distinct))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            if len(cache) + len(missing) > CACHED:
                cache.clear()
            found = _encode_slices([distinct[i] for i in missing], tokenizer_path)
            cache.update(found)
            for i in missing:
                values[i] = found[distinct[i]]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = _gather(np.frombuffer(b"".join(values), "<u4"), size, index).tobytes()
        bounds = (np.concatenate([[0], np.cumsum(size[index])])[first] * 4).tolist()
        out += [ids[i:j] for i, j in zip(bounds, bounds[1:])]
    for i in whole:
        out[i] = np.array(tokenizer.encode(asked[i], add_special_tokens=False).ids, "<u4").tobytes()
    return out


def _block_schema(id_type: T.DataType) -> T.StructType:
    binary = T.BinaryType()
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("base", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("documents", T.ArrayType(id_type)), T.StructField("symbol_ends", binary),
        T.StructField("id_ends", binary), T.StructField("first_rule", T.LongType()),
        T.StructField("rules", binary), T.StructField("lengths", binary),
        T.StructField("symbols", binary), T.StructField("width", T.IntegerType()),
    ])


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2,
                     id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
                     compress=repair) -> None:
    """Encode all texts and write them to ``path`` in ascending order of their ids.

    Every document ends in ``end_id``; null and empty texts have that id only.
    Null ids come first, rows of one id stay next to each other in any order.
    Rows are range-partitioned by id, one shard per partition; a task holds a
    batch of rows and one block at a time. A retried task writes the same
    shard again, and only committed files count.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _block_schema(rows.schema["doc_id"].dataType)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_rule = max(_tokenizer(tokenizer_path)[0].get_vocab_size(), end_id + 1)
        shard, number, base, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, parts = [], []

        def block() -> pa.RecordBatch:
            id_ends = np.cumsum([len(p) // 4 for p in parts])
            ids = np.frombuffer(b"".join(parts), "<u4")
            symbols, ends, rules, lengths = compress(ids, id_ends, first_rule)
            width = 2 if first_rule + len(rules) <= 1 << 16 else 4
            row = [shard, number, base, len(ids), keys, _ends_as(ends), _ends_as(id_ends), first_rule,
                   _ends_as(rules.reshape(-1)), _ends_as(lengths), _ends_as(symbols, f"<u{width}"), width]
            fields = [(f.name, kinds.get(f.name, pa.binary())) for f in schema.fields]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, fields)],
                                              names=[n for n, _ in fields])

        for batch in batches:
            kinds = {"shard": pa.int32(), "block": pa.int32(), "width": pa.int32(), "base": pa.int64(),
                     "n_ids": pa.int64(), "first_rule": pa.int64(),
                     "documents": pa.list_(batch.schema.field("doc_id").type)}
            texts = texts_of(batch, "text")
            ids = batch.column("doc_id").to_pylist()
            for a, b in runs(map(len, texts), CHUNK):
                for key, value in zip(ids[a:b], encode_texts(texts[a:b], tokenizer_path)):
                    size = len(value) // 4 + 1
                    if held and held + size > block_ids:
                        yield block()
                        number, base, held, keys, parts = number + 1, base + held, 0, [], []
                    keys.append(key)
                    parts.append(value + end)
                    held += size
        if held:
            yield block()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(write, schema).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a token file."""
    return spark.read.parquet(path)


def token_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the blocks.

    ``start`` is the number of ids of all documents before it. Only one sum
    per shard reaches the driver, at most as many as the writer had tasks.
    """
    spark = blocks.sparkSession
    sums = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    before = np.cumsum([0] + [n for _, n in sums])[:-1].tolist() if sums else []
    sent = spark.sparkContext.broadcast({shard: n for (shard, _), n in zip(sums, before)})
    id_type = blocks.schema["documents"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in names if n != "documents"}
                held = Block(row)
                data, ends = held.ids().astype("<u4").tobytes(), held.id_ends
                begins = np.concatenate([[0], ends[:-1]])
                start = sent.value[row["shard"]] + row["base"] + begins
                bounds = list(zip((begins * 4).tolist(), (ends * 4).tolist()))
                for a, b in runs((y - x for x, y in bounds), 1 << 24):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("documents")[i].values.slice(a, b - a), pa.array(start[a:b]),
                         pa.array([data[x:y] for x, y in bounds[a:b]], pa.binary())],
                        names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(read, schema)

