"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template words. Numbers, names and units turn into typed placeholders whose surface
forms are the window's slots; any other word is lower-cased and freed of punctuation at its ends. Windows of
``window`` template words of the benchmark and of the documents are hash-joined, so a question with other numbers
or names still meets its template. Matches of an item in a document are lined up by diagonal (document position less
item position); a diagonal counts only if its slots are consistent: equal values in the item have equal values in the
document. A document holds an item if the item's windows on consistent diagonals reach the lesser of
``coverage`` of all its windows and ``long_run`` windows.

The scan of the documents drops windows that cannot match by a bitmap of 2**24 bits over the benchmark's window
hashes. Its size is fixed, whatever the benchmark's; all that passes is joined, so the bitmap decides nothing.

Windows that many items share (a common preamble) do not multiply documents by items: a document that holds ``m`` of an
item's n windows holds one of any n - m + 1 of them, so candidates come from the item's n - m + 1 windows that the fewest
items share, and only candidates are lined up over all windows. Nothing is lost by that.

Defined results: null, empty and wordless texts match nothing. An item of fewer words than a window is one window, which is
looked for inside documents too if it has ``least_literals`` ordinary words; with fewer it only matches a document of just
these words. Windows with fewer than ``least_literals`` ordinary words are not used, unless the item has no others. Repeated
rows give repeated matches counted once by id; rows without id count as one document (or item) without id. Empty tables give no
rows. Only the named columns are read. Intermediate tables are deleted, but for the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .runtime import Scratch, materialise

WINDOW = 6
MAP_BITS = 24

# Words that are numbers, and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons pound pounds lb lbs ounce ounces ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees percent % $ € £ km/h mph hz khz mhz ghz w kw kwh v a j kj".split()

_NUMBER, _NAME, _UNIT = (np.uint64(scan.text_hash(x)) for x in ("\0number", "\0name", "\0unit"))
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "!\"'()*+,-./:;<=>?@[\\]^_`{|}~#&"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/%$"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


def _members(words: list[str]) -> np.ndarray:
    return np.sort(np.array([scan.text_hash(w) for w in words], np.uint64))


_NUMBER_HASHES, _UNIT_HASHES = _members(NUMBER_WORDS), _members(UNITS)


def _within(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(members, values), len(members) - 1)
    return members[at] == values


def template_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template hash and surface hash of each word that has more than punctuation, and the first word of each text."""
    raw, at = scan.buffers(texts)
    starts, ends, first = scan.ranges(raw, at)
    lower = scan.LOWER[raw]
    left, right = starts.copy(), ends.copy()
    while (more := (left < right) & _EDGE[raw[np.minimum(left, max(0, len(raw) - 1))]]).any() if len(raw) else False:
        left += more
    while (more := (left < right) & _EDGE[raw[np.maximum(right - 1, 0)]]).any() if len(raw) else False:
        right -= more
    surface = scan.range_hash(scan.prefix(lower), left, right)
    digits, numeric = (np.concatenate([[0], np.cumsum(t[raw], dtype=np.int64)]) for t in (_DIGIT, _NUMERIC))
    number = (digits[right] > digits[left]) & (numeric[right] - numeric[left] == right - left)
    bits = np.zeros(1 << 12, bool)
    bits[(np.concatenate([_NUMBER_HASHES, _UNIT_HASHES]) & np.uint64(4095)).astype(np.int64)] = True
    some = np.flatnonzero(bits[(surface & np.uint64(4095)).astype(np.int64)])
    number[some] |= _within(surface[some], _NUMBER_HASHES)
    unit = np.zeros(len(surface), bool)
    unit[some] = _within(surface[some], _UNIT_HASHES)
    name = np.zeros(len(surface), bool)
    if len(starts):
        head = raw[np.minimum(left, len(raw) - 1)]
        after = np.zeros(len(starts), bool)
        after[1:] = ~_STOP[raw[ends[:-1] - 1]] & (raw[np.minimum(ends[:-1], len(raw) - 1)] != 10)
        after[first[:-1][np.diff(first) > 0]] = False
        accented = (head == 0xC3) & (raw[np.minimum(left + 1, len(raw) - 1)] <= 0x9E)
        name = after & (_UPPER[head] | accented)
    word = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], surface)
    keep = left < right
    kept = np.concatenate([[0], np.cumsum(keep)])
    return word[keep], surface[keep], kept[first]


def _windows(texts: pa.Array, width: int):
    """Per slice: rows from..to, hash, position and text of each window, then template and surface words with the window's first word."""
    for lo, hi in scan.slices(texts):
        word, surface, first = template_words(texts.slice(lo, hi - lo))
        hashes, bounds = scan.shingle_hashes(word, first, width)
        n = np.diff(bounds)
        row = np.repeat(np.arange(hi - lo), n)
        position = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
        begin = position + np.repeat(first[:-1], n)
        stop = np.minimum(begin + width, np.repeat(first[1:], n))
        slot = (word == _NUMBER) | (word == _NAME) | (word == _UNIT)
        yield lo + row, hashes, position, begin, stop, slot, surface, n


def _slot_lists(pick: np.ndarray, begin: np.ndarray, stop: np.ndarray, slot: np.ndarray, surface: np.ndarray) -> pa.Array:
    where = np.flatnonzero(slot)
    low, high = np.searchsorted(where, begin[pick]), np.searchsorted(where, stop[pick])
    values = surface.view(np.int64)[where[scan.ragged(low, high - low)]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(high - low)]), pa.int32()), pa.array(values))


def _benchmark_windows(width: int, least: int):
    def run(batches):
        for batch in batches:
            for row, hashes, position, begin, stop, slot, surface, _ in _windows(batch.column(1), width):
                total = np.concatenate([[0], np.cumsum(slot)])
                literal = (stop - begin) - (total[stop] - total[begin])
                good = literal >= least
                rows = np.unique(row)
                lacking = rows[~np.isin(rows, row[good])]
                pick = np.flatnonzero(good | np.isin(row, lacking))
                windows = np.bincount(row[pick], minlength=int(row.max()) + 1 if len(row) else 0)
                inner = (stop - begin == width) | good
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[pick])), pa.array(hashes[pick].view(np.int64)), pa.array(position[pick]), pa.array(windows[row[pick]]), pa.array((stop - begin)[pick]), pa.array(inner[pick]), _slot_lists(pick, begin, stop, slot, surface)],
                    names=["item_id", "h", "item_pos", "n_windows", "width", "inner", "item_slots"],
                )

    return run


def _document_windows(widths: list[int], bitmap):
    """Windows of documents that may be in the benchmark: of the usual width (a shorter text whole), and those of its short items' widths."""

    def run(batches):
        seen = bitmap.value
        for batch in batches:
            for width in widths:
                for row, hashes, position, begin, stop, slot, surface, _ in _windows(batch.column(1), width):
                    bit = (hashes & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                    hit = ((seen[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                    pick = np.flatnonzero(hit & ((width == widths[0]) | (stop - begin == width)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[pick])), pa.array(hashes[pick].view(np.int64)), pa.array(position[pick]), pa.array((stop - begin)[pick]), pa.array(np.full(len(pick), width == widths[0])), _slot_lists(pick, begin, stop, slot, surface)],
                        names=["doc_id", "h", "doc_pos", "width", "usual", "doc_slots"],
                    )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.4, long_run: int = 14, least_literals: int = 3) -> DataFrame:
    """doc_id, item_id, n_windows, matched, coverage, verbatim of each benchmark item that a document holds."""
    spark, scratch = docs.sparkSession, Scratch()
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    wanted = scratch.keep(items.mapInArrow(_benchmark_windows(window, least_literals), "item_id long, h long, item_pos long, n_windows long, width long, inner boolean, item_slots array<long>"), "benchmark-windows")
    bits = wanted.selectExpr(f"shiftright(h & {(1 << MAP_BITS) - 1}L, 3) AS byte", "shiftleft(1, CAST(h & 7 AS INT)) AS bits")
    bytes_set = bits.groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    bitmap[bytes_set["byte"].to_numpy()] = bytes_set["bits"].to_numpy().astype(np.uint8)
    short = sorted(r["width"] for r in wanted.where(F.col("inner") & (F.col("width") < window)).select("width").distinct().collect())  # fewer than ``window``
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_document_windows([window, *short], spark.sparkContext.broadcast(bitmap)), "doc_id long, h long, doc_pos long, width long, usual boolean, doc_slots array<long>")
    hits = scratch.keep(found, "document-windows")

    need = F.least(F.ceil(F.col("n_windows") * coverage), F.lit(long_run))
    sharers = wanted.groupBy("h").agg(F.count_distinct("item_id").alias("sharers"))
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("sharers", "h", "item_pos"))
    telling = wanted.join(sharers, "h").withColumn("place", rarest).where(F.col("place") <= F.col("n_windows") - need + 1)
    candidates = scratch.keep(hits.select("doc_id", "h").distinct().join(telling.select("item_id", "h").distinct(), "h").select("doc_id", "item_id").distinct(), "candidates")

    d, c, w = hits.alias("d"), candidates.alias("c"), wanted.alias("w")
    met = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).join(w, F.col("w.item_id").eqNullSafe(F.col("c.item_id")) & (F.col("w.h") == F.col("d.h")) & (F.col("w.width") == F.col("d.width")) & (F.col("w.inner") | F.col("d.usual")))
    met = met.select("d.doc_id", "w.item_id", "n_windows", "item_pos", "item_slots", "doc_slots", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"))
    pairs = F.flatten(F.collect_set(F.arrays_zip("item_slots", "doc_slots")))
    lined = met.groupBy("doc_id", "item_id", "n_windows", "diagonal").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(pairs).alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item_slots"])))
    same = F.forall("slots", lambda s: s["item_slots"].eqNullSafe(s["doc_slots"]))
    held = lined.where(consistent).groupBy("doc_id", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.bool_and(same).alias("verbatim"))
    out = held.where(F.col("matched") >= need).select("doc_id", "item_id", "n_windows", "matched", (F.col("matched") / F.col("n_windows")).alias("coverage"), "verbatim")
    result = materialise(out, "leaks")
    scratch.clear()
    return result
