"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geonear.llm.codepoints import codes_of, folded_letters
from geonear.llm.common import OWN, runs, texts_of, with_fields

UNKNOWN = "und"
ORDERS = (1, 2, 3)  # lengths of the n-grams
BUCKETS = 1 << 16
SMOOTHING = 0.5
CHUNK = 1 << 20  # code points scored at a time


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of several texts: ``buckets, owner offsets, letters per text``.

    Case is folded and every run of other characters counts as one blank, as
    do both ends of a text, so n-grams never reach from one text into another.
    ``buckets`` holds the texts' n-grams in order; those of text ``i`` lie
    between ``offsets[i]`` and ``offsets[i + 1]``.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    folded = folded_letters()[codes_of(" ".join(texts) + " ")]
    owner = np.repeat(np.arange(len(texts)), sizes)
    blank = folded == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a letter stays
    folded, owner, blank = folded[keep], owner[keep], blank[keep]
    letters = np.bincount(owner[~blank], minlength=len(texts))
    # Each text now ends in a blank; the blank before it is its neighbour's, or missing.
    h = folded.astype(np.uint64)
    x = h.copy()
    parts, owners = [], []
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            before = np.full(len(h), 32, np.uint64)
            before[n - 1:] = h[: len(h) - n + 1]
            inside = np.zeros(len(h), bool)
            inside[n - 1:] = owner[: len(h) - n + 1] == owner[n - 1:]
            x = x * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, before, np.uint64(32))
        if n in ORDERS:
            mixed = (x ^ np.uint64(n << 40)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            own = (mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - 16)).astype(np.int64)
            parts.append(own)
            owners.append(owner)
    # One column per order: a text's n-grams stay together without a sort.
    buckets = np.stack(parts, axis=1).reshape(-1)
    counts = np.bincount(owner, minlength=len(texts)) * len(parts)
    return buckets, np.concatenate([[0], np.cumsum(counts)]), letters


@dataclass
class LanguageModel:
    """``log_likelihood`` is ``BUCKETS x languages``; its size does not depend on the corpus."""

    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior."""
        names: list[str] = []
        scores: list[np.ndarray] = []
        for a, b in runs(map(len, texts), CHUNK):
            buckets, offsets, letters = ngram_buckets(texts[a:b])
            if not self.languages:
                names += [UNKNOWN] * (b - a)
                scores.append(np.zeros(b - a))
                continue
            # Sums of the rows a text names: its sparse count vector times the matrix.
            total = np.tile(self.log_prior, (b - a, 1))
            full = np.flatnonzero(np.diff(offsets))
            if len(full):
                for j in range(len(self.languages)):
                    column = np.ascontiguousarray(self.log_likelihood[:, j])
                    total[full, j] += np.add.reduceat(column[buckets].astype(np.float64), offsets[full])
            best = total.argmax(axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            score = 1.0 / odds.sum(axis=1)
            known = letters > 0
            names += [self.languages[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), known.tolist())]
            scores.append(np.where(known, score, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def ngram_counts(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``label, bucket, n`` over all rows with a label; bucket -1 counts the rows.

    Each task sends at most one row per label and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            texts = texts_of(batch, "text")
            for label in set(labels.tolist()):
                own = [texts[i] for i in np.flatnonzero(labels == label)]
                seen = held.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                seen[-1] += len(own)
                for a, b in runs(map(len, own), CHUNK):
                    seen[:-1] += np.bincount(ngram_buckets(own[a:b])[0], minlength=BUCKETS)
        for label, seen in held.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at)),
                 pa.array(seen[at])], names=["label", "bucket", "n"])

    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return (
        rows.where("label is not null").mapInArrow(count, "label string, bucket long, n long")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    )


def fit_languages(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """The model of all rows of ``docs`` with a label.

    The counts are summed in Spark; at most ``BUCKETS + 1`` numbers per
    language reach the driver. Without labelled rows the model knows no
    language and answers ``und``.
    """
    found = ngram_counts(docs, text_col, label_col).toPandas()
    languages = sorted(found["label"].unique().tolist())
    counts = np.zeros((BUCKETS, len(languages)))
    rows = np.zeros(len(languages))
    for j, name in enumerate(languages):
        own = found[found["label"] == name]
        at, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[at[at >= 0], j] = n[at >= 0]
        rows[j] = n[at < 0].sum()
    smooth = counts + SMOOTHING
    with np.errstate(divide="ignore"):
        return LanguageModel(languages, np.log(rows / max(rows.sum(), 1)),
                             np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32))


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text",
                  pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior (0 to 1) added.

    Columns of those names are replaced. A null text, or one without any
    letter, is ``und`` with score 0. Labels, sources and ids play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(pred_col, score_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = sent.value.predict(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, pred_col, score_col])

    return base.mapInArrow(score, with_fields(base, **{pred_col: T.StringType(), score_col: T.DoubleType()}))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text",
                    min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is found, unchanged.

    Texts that are null or hold no letter go, as do those whose posterior is
    below ``min_score``.
    """
    pred, score = f"{OWN}pred", f"{OWN}score"
    tagged = with_language(docs, model, text_col, pred, score)
    return tagged.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
