"""Token ids in grammar-compressed shards: Re-Pair with rules and expansion lengths for random access.

``write`` sorts documents by id over all tasks, encodes them, and cuts the token sequence into shards of about
``SHARD_TOKENS`` ids, whole documents each. A shard is compressed by repeated pair replacement: of the pairs within a
power of two of the most frequent each occurrence that no more frequent pair overlaps becomes a nonterminal, and so on
until no pair occurs ``LEAST_PAIRS`` times, which is where a replacement stops paying for its rule (two symbols and a
length, 8 bytes against 2 a replacement), or until 16-bit symbols are used up: one more rule would double every symbol.
No pair spans two documents, so a document is a run of symbols and can be decoded alone.

File format: a Parquet table with a row for each shard. ``rules`` holds two symbols for each nonterminal, the first of which is
``base``; a rule uses only ids and earlier nonterminals. ``lengths`` holds how many ids each nonterminal expands to. ``symbols``
is the compressed sequence. For document k of the shard, ``doc_ids[k]`` is its id and ``ends[k]`` the position after its
last symbol. Symbols and rules are little-endian unsigned 16-bit where ``width`` is 2, else 32-bit; lengths and
ends are unsigned 32-bit, ids signed 64-bit. ``part`` and ``seq`` order the shards.

Encoding goes through a table of distinct chunks between ASCII white space, where the tokenizer's file says that it drops
white space and folds case (``NORMALIZER``, ``SPLITTER``); any other tokenizer encodes whole texts. Each worker empties the table
at ``MOST`` chunks, but for those of the texts at hand. Chunks of plain characters are cut into words, digits and runs of marks, which the tokenizer's model
encodes one by one; others, and texts with a special token's opening, go to the whole tokenizer.

Defined results: a null text is empty and has the end id only; repeated rows follow each other, ordered by a hash of the
text; a null id sorts first. An empty table has no shard. Only the named columns are read.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan
from .runtime import new_path

END_ID = 1
SHARD_TOKENS = 1_500_000
LEAST_PAIRS = 5
MOST = 500_000
SLICE_BYTES = 6_000_000

_SHARD = "part int, seq int, tokens long, base int, width int, rules binary, lengths binary, symbols binary, doc_ids binary, ends binary, null_ids binary"
_WORD = "^[a-zß-öø-ÿ]+$"
#: Printable characters without the apostrophe, which opens contractions; they fall into words, digits and runs of marks.
_EASY, _PIECES = "^[!-&(-~ß-öø-ÿ]+$", re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

# The steps of a tokenizer file under which chunks between white space can be encoded alone, in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_MIXED = ["ab.", "é,", "a1b22", "x-y_z", "(word)", "\"quoted\"", "3.14%", "a.b@c.de", "###", "--a--", "über/straße?!", "1,000", "$5", "[x]{y}", "a=b;c:d"]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Encoder:
    """A worker's tokenizer and its table of distinct chunks."""

    path: str
    most: int = MOST
    table: dict[str, int] = field(default_factory=dict)
    words: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.chunked = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER and all("<|" in t["content"] for t in spec["added_tokens"])
        self.simple = self.chunked and self._simple()
        self.end = {m: self._library([m])[0] for m in ".,"}
        self._clear()

    def _simple(self) -> bool:
        """Whether plain words may go to the model directly: held against the whole tokenizer on each letter and pair of letters."""
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
        probe = letters + [a + b for a in letters for b in letters] + [a + b for a in marks for b in ["", *marks, "..."]] + [*"0123456789", "straße", "façade", "thisisalongword"]
        try:
            return self._library(probe) == [self._word(w) for w in probe] and all(
                ids == [x for piece in _PIECES(chunk) for x in self._word(piece)] for chunk, ids in zip(_MIXED, self._library(_MIXED), strict=True)
            )
        except Exception:  # a model without such words: the tokenizer itself serves
            return False

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelt)]

    def _clear(self) -> None:
        self.table.clear()
        self.words.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used, self.start, self.size = 0, np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        coded: list[list[int] | None] = [None] * len(chunks)
        given = pa.array(chunks, pa.large_string())
        bare = pc.replace_substring_regex(given, "[.,]$", "")
        plain = np.asarray(pc.match_substring_regex(bare, _WORD)) if self.simple else np.zeros(len(chunks), bool)
        marked = np.asarray(pc.not_equal(bare, given))
        known, tokens, letters, end = self.words, self.model.tokenize, self.letters, self.end
        picked = np.flatnonzero(plain).tolist()
        for k, word, has_mark in zip(picked, bare.filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist(), marked[plain].tolist(), strict=True):
            ids = known.get(word)
            if ids is None:
                ids = known[word] = [t.id for t in tokens(word if word.isascii() else word.encode().decode("latin-1").translate(letters))]
            coded[k] = ids + end[chunks[k][-1]] if has_mark else ids
        easy = ~plain & np.asarray(pc.match_substring_regex(given, _EASY)) if self.simple else plain
        for k in np.flatnonzero(easy).tolist():
            out: list[int] = []
            for piece in _PIECES(chunks[k]):
                ids = known.get(piece)
                if ids is None:
                    ids = known[piece] = self._word(piece)
                out += ids
            coded[k] = out
        odd = np.flatnonzero(~plain & ~easy).tolist()
        for k, ids in zip(odd, self._library([chunks[k] for k in odd]), strict=True):
            coded[k] = ids
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        self._add(chunks, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes)

    def _add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, total = len(self.table), len(ids)
        for name, need in (("ids", self.used + total), ("start", at + len(chunks)), ("size", at + len(chunks))):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.ids[self.used : self.used + total] = ids
        self.start[at : at + len(chunks)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[at : at + len(chunks)] = sizes
        self.used += total
        self.table.update(zip(chunks, range(at, at + len(chunks)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and the bounds by text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.chunked:
            parts = [np.array([*ids, END_ID], np.uint32) for ids in self._library(texts.to_pylist())]
            return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        raw, at = scan.buffers(texts)
        special = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|").fill_null(False)))
        lower = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(scan.LOWER[raw])])
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.table.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(found < 0)
        if len(self.table) + len(unknown) > self.most and self.table:
            # what these texts know already is carried over: encoding it again costs more than all else here
            known = np.flatnonzero(found >= 0)
            sizes = self.size[found[known]]
            ids = self.ids[scan.ragged(self.start[found[known]], sizes)]
            self._clear()
            self._add([distinct[k] for k in known.tolist()], ids, sizes)
            found[known] = np.arange(len(known))
        at = len(self.table)
        self._learn([distinct[k] for k in unknown.tolist()])
        found[unknown] = at + np.arange(len(unknown))
        entry = found[coded.indices.to_numpy()]
        sizes = self.size[entry]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        ids = self.ids[scan.ragged(self.start[entry], sizes)]
        ids = np.insert(ids, bounds[1:], END_ID)
        bounds = bounds + np.arange(len(bounds))
        if len(special):
            parts = np.split(ids, bounds[1:-1])
            for k in special:
                parts[k] = np.array([*self._library([texts[int(k)].as_py()])[0], END_ID], np.uint32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each is."""
    if key.dtype == np.uint32 and len(key) < 1 << 32:  # numbers that hold their place sort faster than places do
        packed = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
        order, ranked = packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.uint32)
    else:
        order = np.argsort(key)
        ranked = key[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(ranked), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], which


def compress(ids: np.ndarray, bounds: np.ndarray, base: int, least: int = LEAST_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the documents' ends in them, rules (n, 2) and expansion lengths of the nonterminals base, base + 1, ...

    Places of pairs wait in levels by the power of two below their pair's count, counted with some others by a hash, so never
    too low. A round takes the highest level: pairs whose true count is that high are replaced, the others wait lower. A pair's
    count can only grow by new symbols, so after a round only the places around them are counted anew. Replaced places are
    skipped by links to the next and the last symbol. It ends when no pair occurs ``least`` times, or no id is left.
    """
    n = len(ids)
    # a pair is one number: of 32 bits where symbols have 16
    kind, half, odd_factor = (np.uint32, 16, 0x9E3779B1) if base < 1 << 16 else (np.uint64, 32, 0x9E3779B97F4A7C15)
    seq = ids.astype(kind)
    last = np.zeros(n, bool)
    last[bounds[1:] - 1] = True
    after, before, alive = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.ones(n, bool)
    level, waiting = np.zeros(n, np.int8), defaultdict(list)
    rules, lengths = [], np.zeros(0, np.int64)
    room = (1 << 16) - base if base < 1 << 16 else 1 << 20

    def key_of(at: np.ndarray) -> np.ndarray:
        return (seq[at] << kind(half)) | seq[after[at]]

    def wait(at: np.ndarray) -> None:
        slots = min(20, max(10, int(len(at)).bit_length()))
        slot = ((key_of(at) * kind(odd_factor)) >> kind(2 * half - slots)).astype(np.int32)
        held = np.bincount(slot, minlength=1 << slots)
        file(at, np.where(held >= least, np.frexp(held)[1], 0).astype(np.int8)[slot])

    def file(at: np.ndarray, to: np.ndarray) -> None:
        level[at] = to
        some = to > 0
        at, to = at[some], to[some]
        order = np.argsort(to, kind="stable")
        ends = np.cumsum(np.bincount(to, minlength=1))
        for k in range(1, len(ends)):
            if ends[k] > ends[k - 1]:
                waiting[k].append(at[order[ends[k - 1] : ends[k]]])

    wait(np.flatnonzero(~last).astype(np.int32))
    while waiting and room > 0:
        top = max(waiting)
        at = np.concatenate(waiting.pop(top))
        at = np.sort(at[alive[at] & (level[at] == top) & ~last[at]])
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        if not len(at):
            continue
        pairs, which = _grouped(key_of(at))
        # in a run of one symbol every other occurrence counts
        odd = np.zeros(len(at), bool)
        follows = np.flatnonzero((after[at[:-1]] == at[1:]) & (which[1:] == which[:-1])) + 1
        if len(follows):
            index = np.arange(len(at))
            head = index.copy()
            head[follows] = 0
            odd = (index - np.maximum.accumulate(head)) % 2 == 1
        count = np.bincount(which[~odd], minlength=len(pairs))
        cutoff = max(least, 1 << (top - 1))
        high = count >= cutoff
        if not high.all():
            later = ~high[which]
            file(at[later], np.where(count >= least, np.minimum(np.frexp(count)[1], top - 1), 0).astype(np.int8)[which[later]])
            at, which, odd = at[~later], which[~later], odd[~later]
            if not len(at):
                continue
        # of occurrences that share a symbol the more frequent pair's stays: the most frequent pair of all keeps all its own
        rank = np.empty(len(pairs), np.int32)
        rank[np.lexsort((pairs, count))] = np.arange(len(pairs))
        mine = np.where(odd, -1, rank[which])
        near = after[at[:-1]] == at[1:]
        lose = odd.copy()
        lose[:-1] |= near & (mine[1:] > mine[:-1])
        lose[1:] |= near & (mine[:-1] > mine[1:])
        won = np.bincount(which[~lose], minlength=len(pairs))
        worth = np.flatnonzero(won >= max(least, cutoff // 2))
        worth = worth[np.argsort(-won[worth], kind="stable")][:room]
        number = np.full(len(pairs), -1)
        number[worth] = base + len(lengths) + np.arange(len(worth))
        taken = ~lose & (number[which] >= 0)
        place = at[taken]
        left, right = (x.astype(np.int64) for x in (pairs[worth] >> kind(half), pairs[worth] & kind((1 << half) - 1)))
        known = np.concatenate([lengths, [1]])
        grown = sum(known[np.where(x >= base, x - base, len(lengths))] for x in (left, right))
        rules.append(np.stack([left, right], axis=1))
        lengths = np.concatenate([lengths, grown])
        room -= len(worth)
        gone = after[place]
        seq[place], last[place], alive[gone] = number[which[taken]].astype(kind), last[gone], False
        after[place] = after[gone]
        inner = after[place] < n
        before[after[place][inner]] = place[inner]
        back = before[place]
        touched = np.sort(np.concatenate([at[~taken], place, back[back >= 0]]))
        touched = touched[np.concatenate([[True], touched[1:] != touched[:-1]])]
        wait(touched[alive[touched] & ~last[touched]])
    return seq[alive].astype(np.int64), np.flatnonzero(last[alive]) + 1, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all nonterminals one after the other, and where each begins."""
    start = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.zeros(int(start[-1]), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        at = start[k]
        for s in (a, b):
            if s < base:
                flat[at] = s
                at += 1
            else:
                n = lengths[s - base]
                flat[at : at + n] = flat[start[s - base] : start[s - base] + n]
                at += n
    return flat, start


def expand(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of symbols, and how many each gives."""
    rule = symbols >= base
    size = np.ones(len(symbols), np.int64)
    size[rule] = lengths[symbols[rule] - base]
    place = len(flat) + np.arange(len(symbols))
    place[rule] = start[symbols[rule] - base]
    return np.concatenate([flat, symbols])[scan.ragged(place, size)], size


@dataclass
class Shard:
    """A shard row, opened for decoding."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    doc_ids: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(row: dict) -> Shard:
        kind = "<u2" if row["width"] == 2 else "<u4"
        get = lambda name, t: np.frombuffer(row[name], t).astype(np.int64)
        return Shard(row["base"], get("rules", kind).reshape(-1, 2), get("lengths", "<u4"), get("symbols", kind), get("doc_ids", "<i8"), get("ends", "<u4"))

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole shard, and the documents' ends in them."""
        flat, start = expansions(self.rules, self.lengths, self.base)
        ids, size = expand(self.symbols, flat, start, self.lengths, self.base)
        return ids, np.concatenate([[0], np.cumsum(size)])[self.ends]

    def ids(self, doc: int, begin: int = 0, count: int | None = None) -> list[int]:
        """Ids begin .. begin + count of the shard's document number ``doc``; whole symbols outside are skipped by their lengths."""
        stack = self.symbols[self.ends[doc - 1] if doc else 0 : self.ends[doc]].tolist()[::-1]
        out, left = [], begin
        while stack and (count is None or len(out) < count):
            s = stack.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if left >= n:
                left -= n
            elif s < self.base:
                out.append(s)
            else:
                stack.extend(self.rules[s - self.base][::-1].tolist())
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _shard(part: int, seq: int, base: int, docs: list, ids: list, sizes: list) -> pa.RecordBatch:
    flat, bounds = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    symbols, ends, rules, lengths = compress(flat, bounds, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    names = pa.concat_arrays(docs)
    values = [part, seq, len(flat), base, width, rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes(), names.fill_null(0).to_numpy().astype("<i8").tobytes(), ends.astype("<u4").tobytes(), np.packbits(names.is_null().to_numpy(zero_copy_only=False)).tobytes()]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in _SHARD.split(", ")])


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Shards of all documents in ascending order of their ids, under ``path``."""

    def run(batches):
        from pyspark import TaskContext

        gc.disable()  # tables of small lists without cycles: collections would only walk over them
        coder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        base = coder.tokenizer.get_vocab_size()
        names, ids, sizes, held = [], [], [], 0
        for batch in batches:
            for lo, hi in scan.slices(batch.column(1), SLICE_BYTES):
                found, bounds = coder.encode(batch.column(1).slice(lo, hi - lo))
                begin = 0
                while begin < hi - lo:
                    stop = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + shard_tokens - held, side="right")) - 1)
                    stop = min(stop, hi - lo)
                    names.append(batch.column(0).slice(lo + begin, stop - begin))
                    ids.append(found[bounds[begin] : bounds[stop]])
                    sizes.append(np.diff(bounds[begin : stop + 1]))
                    held += int(bounds[stop] - bounds[begin])
                    begin = stop
                    if held >= shard_tokens or begin < hi - lo:
                        yield _shard(part, seq, base, names, ids, sizes)
                        names, ids, sizes, held, seq = [], [], [], 0, seq + 1
        if names:
            yield _shard(part, seq, base, names, ids, sizes)

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = given.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, _SHARD).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards under ``path``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row)
                ids, ends = shard.all_ids()
                raw, begins = ids.astype("<u4"), np.concatenate([[0], ends[:-1]])
                null = np.unpackbits(np.frombuffer(row["null_ids"], np.uint8))[: len(ends)].astype(bool)
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(shard.doc_ids, mask=null), pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(_SHARD).parquet(path)
    # shards before a shard: those of its part, and the sums of earlier parts, of which there are as many as writing tasks
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("part_start"))
    starts = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inner_start")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("inner_start")).alias("base_start"))
    found = shards.mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("base_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write(docs, path, tokenizer)
    return read(spark, path)
