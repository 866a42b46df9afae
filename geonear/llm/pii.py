"""Personal data: fixed patterns, and a trained character tagger beside them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.charcrf import KINDS, PAD, STEP, WINDOW, Tagger, single, symbols_of, train
from geonear.llm.codepoints import codes_of
from geonear.llm.common import runs, texts_of, with_fields

TRAIN_WINDOWS = 384  # labelled windows that the tagger is fitted on
MIN_SCORE = 0.5  # least posterior of a tagged span
CHUNK = 1 << 20  # code points looked at together

#: The base patterns, written so that no text makes them slow.
#: An address is looked for from its @, the numbers from their first digit.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d // 5 + d * 2 % 10 for d in map(int, even))) % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in _LOCAL_SET:
            first -= 1
        match = _DOMAIN.match(text, at + 1) if first < at else None
        if match:
            yield first, match.end()
            end = match.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; leftmost, never overlapping in a kind."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the tagger's windows ------------------------------------------------------------


def _wanted(codes: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a digit or an @.

    A span is only accepted with one of these inside it (:func:`plausible`),
    so the other windows cannot add any.
    """
    at = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64)) // STEP
    return np.unique(np.concatenate([at, at[at > 0] - 1]))


def _windows(symbols: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    padded = np.concatenate([symbols, np.full(WINDOW, PAD)])
    return padded[numbers[:, None] * STEP + np.arange(WINDOW)]


def _tags(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text) + WINDOW, np.int64)
    for kind, a, b in reversed(spans):  # an earlier kind wins where two overlap
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def labelled_windows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``symbols, tags, key`` of every window with a digit or an @, labelled by the patterns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch, "text"):
                codes = codes_of(text)
                numbers = _wanted(codes)
                if not len(numbers):
                    continue
                x = _windows(symbols_of(codes), numbers).astype(np.uint8)
                y = _tags(text, base_spans(text))[numbers[:, None] * STEP + np.arange(WINDOW)].astype(np.uint8)
                # A window that begins inside a span learns nothing from its cut-off start.
                for a, b in zip(x[(y[:, 0] == 0) | (y[:, 0] % 2 == 1)], y[(y[:, 0] == 0) | (y[:, 0] % 2 == 1)]):
                    data = a.tobytes()
                    rows.append((data, b.tobytes(), xxhash.xxh64_intdigest(data) >> 1))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()))],
                names=["symbols", "tags", "key"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "symbols binary, tags binary, key long")


def fit_tagger(docs: DataFrame, text_col: str = "text", windows: int = TRAIN_WINDOWS, **options) -> Tagger:
    """A tagger trained on at most ``windows`` labelled windows, those of the smallest hashes.

    Some spans are varied (an @ between blanks, a phone number with 00 for its
    plus), so that the tagger knows forms that the patterns do not.
    """
    rows = labelled_windows(docs, text_col).orderBy("key", "tags").limit(windows).collect()
    x = np.array([np.frombuffer(r["symbols"], np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    y = np.array([np.frombuffer(r["tags"], np.uint8) for r in rows], np.int64).reshape(-1, WINDOW)
    x, y = (np.concatenate([a, b]) for a, b in zip((x, y), _varied(x, y)))
    return single(train(x, y, **options))


def _varied(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    email, phone = 2 + 2 * KINDS.index("email"), 1 + 2 * KINDS.index("phone")
    outs: tuple[list, list] = ([], [])
    for i in range(0, len(x), 3):
        a, b = x[i].tolist(), y[i].tolist()
        changed = False
        for p in range(WINDOW - 1, -1, -1):
            if a[p] == ord("@") and b[p] == email:
                a[p:p + 1], b[p:p + 1], changed = [32, 64, 32], [email] * 3, True
            elif a[p] == ord("+") and b[p] == phone:
                a[p:p + 1], b[p:p + 1], changed = [48, 48], [phone, phone + 1], True
        if changed:
            outs[0].append(a[:WINDOW])
            outs[1].append(b[:WINDOW])
    return tuple(np.array(o, np.int64).reshape(-1, WINDOW) for o in outs)


def plausible(kind: str, found: str) -> bool:
    """Whether a tagged span can be what its kind says; every kind needs a digit or an @."""
    digits = _digits(found)
    if kind == "email":
        name, _, host = found.partition("@")
        return bool(name.strip()) and "." in host.strip().strip(".") and len(found.split()) <= 3
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def reconcile(text: str, pieces: list[tuple[int, int, int, float]], base: list[Span],
              min_score: float = MIN_SCORE) -> list[Span]:
    """Added spans of a whole text from its windows' pieces ``(kind, start, end, score)``.

    Pieces of one kind that overlap or touch are views of one span; it reaches
    over all of them with the best score. Of spans that overlap, the surest
    stays, then the leftmost; none may touch a base span.
    """
    merged: list[list] = []
    for kind, a, b, score in sorted(pieces):
        if merged and merged[-1][0] == kind and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
            merged[-1][3] = max(merged[-1][3], score)
        else:
            merged.append([kind, a, b, score])
    taken = [(a, b) for _, a, b in base]
    out: list[Span] = []
    for kind, a, b, score in sorted(merged, key=lambda m: (-m[3], m[1])):
        found = text[a:b]
        a, b = a + len(found) - len(found.lstrip(" ,;:(\n\t")), b - len(found) + len(found.rstrip(" .,;:\n\t"))
        if score < min_score or a >= b or any(a < y and x < b for x, y in taken):
            continue
        if plausible(KINDS[kind], text[a:b]):
            out.append((KINDS[kind], a, b))
            taken.append((a, b))
    return out


def all_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """Spans of whole texts by kind, then start; the flag marks those of the patterns."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if tagger is not None:
        windows, owners, numbers = [], [], []
        for i, text in enumerate(texts):
            codes = codes_of(text)
            own = _wanted(codes)
            if len(own):
                windows.append(_windows(symbols_of(codes), own))
                owners.append(np.full(len(own), i))
                numbers.append(own)
        pieces: dict[int, list] = {}
        if windows:
            x, owner, number = (np.concatenate(c) for c in (windows, owners, numbers))
            for i in range(0, len(x), 1024):
                tags, sure = tagger.decode(x[i:i + 1024])
                for row, col in zip(*np.nonzero(tags % 2 == 1)):
                    end = col + 1
                    while end < WINDOW and tags[row, end] == tags[row, col] + 1:
                        end += 1
                    at, text = int(number[i + row]) * STEP, int(owner[i + row])
                    pieces.setdefault(text, []).append((
                        int(tags[row, col]) // 2, at + int(col), min(at + int(end), len(texts[text])),
                        float(sure[row, col:end].min())))
        for i, found in pieces.items():
            added[i] = reconcile(texts[i], found, base[i])
    order = {k: i for i, k in enumerate(KINDS)}
    return [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=lambda s: (order[s[0]], s[1], s[2]))
            for b, a in zip(base, added)]


SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("base", pa.bool_())]))


def find_pii(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """``docs`` with all spans of personal data: ``array<struct<kind, start, end, base>>``.

    Offsets count code points, ends are exclusive. ``base`` marks what the
    fixed patterns find; the tagger adds spans outside of these. A null text
    counts as empty. Rows and other columns stay; ``out_col`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    base = docs.drop(out_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text_col)
            found = []
            for a, b in runs(map(len, texts), CHUNK):
                found += [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans]
                          for spans in all_spans(texts[a:b], sent.value)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, _ARROW_SPAN)], names=[*batch.schema.names, out_col])

    return base.mapInArrow(find, with_fields(base, **{out_col: SPAN}))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span given way to its kind; spans that overlap make one."""
    out, end, kind = [], 0, ""
    begin = None
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin is not None and a < reach:
            reach = max(reach, b)
            continue
        if begin is not None:
            out += [text[end:begin], f"<{kind.upper()}>"]
            end = reach
        begin, reach, kind = a, b, k
    if begin is not None:
        out += [text[end:begin], f"<{kind.upper()}>"]
        end = reach
    return "".join(out) + text[end:]


def redact_pii(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``.

    A null text stays null; ``n_chars`` follows the text where there is one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            out: list[str | None] = []
            for a, b in runs((len(t or "") for t in texts), CHUNK):
                part = [t or "" for t in texts[a:b]]
                out += [None if t is None else redacted(t, [s[:3] for s in spans])
                        for t, spans in zip(texts[a:b], all_spans(part, sent.value))]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns[text_col] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    done = docs.mapInArrow(redact, with_fields(docs))
    if size_col in docs.columns:
        done = done.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return done
