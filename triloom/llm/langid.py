"""Language identification with language-bitmask n-gram filters.

Training finds, for each language, the byte n-grams that many of its documents hold. ``LanguageFilters`` stores
all languages in one bit-sliced Bloom filter: cell i is a bit mask with a bit for each language (of as many words as they need), an n-gram addresses
``PROBES`` cells, and the AND of their masks is the set of languages that hold the n-gram. A text's score for a
language is the population count of that language's bit over all its n-grams, corrected for the filter's false
positives: (hits - n * p) / (n - n * p), where p is the chance that an absent n-gram seems present.

Defined results: a text that is null or without a letter is ``und`` with score 0; a text with letters but no
known n-gram gets the language with the most training documents, with score 0. Ties go to the language that sorts first.
An empty table gives an empty result. Training needs at least one row with text and language, else all is ``und``.
Only the named columns are read. ``lettered`` adds the score over the n-grams that hold a letter, or a letter and no
digit (the better of both), so that numbers and tokens do not count against a text's language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

PROBES = 3
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_bytes(raw: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text is part of a letter."""
    out = _LETTER[raw]
    for width, low, high, bits in ((2, 0xC0, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0xF8, 7)):
        lead = np.flatnonzero((raw >= low) & (raw < high))
        if not len(lead):
            continue
        code = raw[lead].astype(np.int64) & bits
        for k in range(1, width):
            code = code << 6 | raw[lead + k] & 63
        lead = lead[_alphabetic()[code]]
        for k in range(width):
            out[lead + k] = True
    return out


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of n bytes inside a text (ASCII lower case, each white space byte as a space), and their bounds by text."""
    raw, at = scan.buffers(texts)
    raw = np.where(scan.IS_SPACE[raw], np.uint8(32), scan.LOWER[raw])
    size = np.diff(at)
    count = np.maximum(size - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    keys = raw[: len(raw) - n + 1].astype(np.uint64)
    for k in range(1, n):
        keys |= raw[k : len(raw) - n + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    return keys[_inside(at, len(keys), n)], bounds


def _inside(at: np.ndarray, total: int, n: int) -> np.ndarray:
    inside = np.ones(total, bool)
    for edge in at[1:-1]:
        inside[max(0, edge - n + 1) : edge] = False
    return inside


def lettered_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each run of ``grams`` holds a letter, and whether it holds a letter and no digit."""
    raw, at = scan.buffers(texts)
    if len(raw) < n:
        return np.zeros(0, bool), np.zeros(0, bool)
    letter, digit = (np.concatenate([[0], np.cumsum(t)]) for t in (letter_bytes(raw), _DIGIT[raw]))
    inside = _inside(at, len(raw) - n + 1, n)
    has = (letter[n:] > letter[:-n])[inside]
    return has, has & (digit[n:] == digit[:-n])[inside]


@dataclass
class LanguageFilters:
    languages: list[str]
    n: int
    cells: np.ndarray  # one row of mask words for each cell, a bit for each language
    chance: np.ndarray  # false-positive rate of each language
    fallback: str

    @staticmethod
    def build(languages: list[str], n: int, keys: np.ndarray, known: list[np.ndarray], fallback: str) -> LanguageFilters:
        """``known`` lists the languages of each key by number."""
        size = 1 << max(10, int(max(1, len(keys)) * 12 - 1).bit_length())
        kind = np.dtype(np.uint8 if len(languages) <= 8 else np.uint64)
        wide = max(1, -(-len(languages) // (8 * kind.itemsize)))
        masks = np.zeros((len(keys), wide), kind)
        which, lang = np.repeat(np.arange(len(keys)), [len(k) for k in known]), np.concatenate([*known, np.zeros(0, np.int64)]).astype(np.int64)
        word, bit = np.divmod(lang, 8 * kind.itemsize)
        np.bitwise_or.at(masks, (which, word), np.left_shift(kind.type(1), bit.astype(kind)))
        out = LanguageFilters(languages, n, np.zeros((size, wide), kind), np.zeros(len(languages)), fallback)
        for cell in out._cells(keys):
            np.bitwise_or.at(out.cells, cell, masks)
        for k in range(len(languages)):
            out.chance[k] = out._bit(out.cells, k).mean() ** PROBES
        return out

    def _cells(self, keys: np.ndarray):
        h = scan.mix(keys)
        lo, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(PROBES):
            yield ((lo + np.uint64(k) * step) & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def _bit(self, mask: np.ndarray, language: int) -> np.ndarray:
        """Whether each mask has the language's bit, as 0 or 1."""
        kind = mask.dtype.type
        word, bit = divmod(language, 8 * mask.dtype.itemsize)
        return (mask[:, word] >> kind(bit)) & kind(1)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram."""
        cells = self.cells if self.cells.shape[1] > 1 else self.cells[:, 0]
        first, *rest = self._cells(keys)
        mask = cells[first]
        for cell in rest:
            mask &= cells[cell]
        return mask.reshape(len(keys), -1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        keys, bounds = grams(texts, self.n)
        return self._shares(self.lookup(keys), bounds)

    def _shares(self, mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)[:, None]
        hits = np.zeros((len(bounds) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0], np.cumsum(self._bit(mask, k), dtype=np.int64)])
            hits[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        return np.clip((hits - n * self.chance) / np.maximum(n * (1 - self.chance), 1e-9), 0, 1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        return self._named(texts, self.scores(texts))

    def predict_lettered(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As ``predict``, and the score over lettered n-grams and the number of n-grams with a letter."""
        keys, bounds = grams(texts, self.n)
        mask = self.lookup(keys)
        best, counts = np.zeros(len(texts)), []
        for pick in lettered_grams(texts, self.n):
            inner = np.concatenate([[0], np.cumsum(pick)])[bounds]
            counts.append(np.diff(inner))
            if self.languages:
                best = np.maximum(best, self._shares(mask[pick], inner).max(axis=1))
        return *self._named(texts, self._shares(mask, bounds)), best, counts[0]

    def _named(self, texts: pa.Array, score: np.ndarray) -> tuple[list[str], np.ndarray]:
        raw, at = scan.buffers(texts)
        ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
        lettered = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(at) > 0)):
            lettered[i] = any(map(str.isalpha, texts[i].as_py() or ""))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        top = np.where(lettered, score.max(axis=1), 0.0)
        names = [UNKNOWN if not ok else self.languages[b] if s > 0 else self.fallback for ok, b, s in zip(lettered, best, top, strict=True)]
        return names, top


def _counted(n: int):
    def run(batches):
        for batch in batches:
            for lo, hi in scan.slices(batch.column(1), 2_000_000):
                keys, bounds = grams(batch.column(1).slice(lo, hi - lo), n)
                by: dict[int, list[np.ndarray]] = {}
                for k, lang in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    by.setdefault(lang, []).append(np.unique(keys[bounds[k] : bounds[k + 1]]))
                for lang, found in by.items():
                    key, count = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang, np.int32)), pa.array(key.view(np.int64)), pa.array(count, pa.int64())], names=["number", "gram", "docs"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 4, sample_per_language: int = 4000, least_rate: float = 0.004, share: float = 0.2, most_languages: int = 1024) -> LanguageFilters:
    """Learn the filters from labelled rows.

    At most about ``sample_per_language`` documents of each language are read, chosen by a hash of the id, and of more than
    ``most_languages`` labels only the commonest (the bounds of the fitting sample). An n-gram enters a language's filter if at
    least ``least_rate`` of the language's documents hold it and that rate is at least ``share`` of its highest rate in any language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageFilters([], n, np.zeros((1024, 1), np.uint8), np.zeros(0), UNKNOWN)
    scale = 1 << 20
    known = spark.createDataFrame([(lang, k, int(scale * min(1.0, sample_per_language / totals[lang]))) for k, lang in enumerate(languages)], "lang string, number int, most long")
    sample = rows.join(F.broadcast(known), "lang").where(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.col("most"))
    sizes = spark.createDataFrame([(r["number"], r["count"]) for r in sample.groupBy("number").count().collect()], "number int, size long")
    counts = sample.select("number", "text").mapInArrow(_counted(n), "number int, gram long, docs long").groupBy("gram", "number").agg(F.sum("docs").alias("docs"))
    rates = counts.join(F.broadcast(sizes), "number").withColumn("rate", F.col("docs") / F.col("size")).where(F.col("rate") >= least_rate)
    held = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("number", "rate")).alias("held"))
    kept = held.select("gram", F.transform(F.filter("held", lambda h: h["rate"] >= share * F.col("top")), lambda h: h["number"]).alias("known")).toArrow()
    fallback = max(languages, key=lambda x: (totals[x], x))
    return LanguageFilters.build(languages, n, kept["gram"].to_numpy().view(np.uint64), [np.array(k) for k in kept["known"].to_pylist()], fallback)


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", keep: list[str] | None = None, lettered: bool = False) -> DataFrame:
    """``keep`` columns (default: all but the text) and lang_pred, score for each row; with ``lettered`` also letter_score, letter_grams."""
    columns = keep if keep is not None else [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = {"lang_pred": "string", "score": "double"} | ({"letter_score": "double", "letter_grams": "long"} if lettered else {})

    def run(batches):
        predict = shared.value.predict_lettered if lettered else shared.value.predict
        for batch in batches:
            for lo, hi in scan.slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(lo, hi - lo)
                found = predict(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, found)], names=[*fields, *kinds])

    given = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)], F.col(text_col).cast("string").alias("_text"))
    fields = given.columns[:-1]
    found = T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in kinds.items()))
    out = given.mapInArrow(run, T.StructType([given.schema[f] for f in fields] + found.fields))
    return out.select(*[F.col(f).alias(c) for f, c in zip(fields, columns, strict=True)], *kinds)
