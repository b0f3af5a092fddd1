"""SentencePiece encoding and decoding through a distinct-chunk table.

Where a model's pieces cannot cross a white space marker from the left (no piece has the marker behind another
character), a text's segmentation is the concatenation of its marked words' segmentations. Each Python worker keeps a
table of the distinct chunks that it has met, encodes and decodes each once with the library, and joins ids by position.
The table is emptied when it holds ``MOST`` chunks, so its memory is bounded whatever the corpus.

The models this serves: a byte-pair model with dummy prefix, identity normalisation and kept white space, as
``eligible`` verifies on the model; else, and for texts with repeated, leading or trailing spaces or the marker
itself as a character, the library encodes and decodes the whole text.

Defined results: null is the empty text, whose ids are the begin and end ids. Repeated rows are handled each for itself; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

MOST = 300_000
SLICE_BYTES = 6_000_000
MARK = "▁"


def eligible(processor) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(processor.serialized_model_proto())
    spec = model.normalizer_spec
    plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not spec.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
    return plain and model.trainer_spec.model_type == pb.TrainerSpec.BPE and all(p.type in (1, 2, 3, 6) and MARK not in p.piece.lstrip(MARK) for p in model.pieces)


@dataclass
class Pieces:
    """A worker's model and its table of distinct chunks."""

    path: str
    most: int = MOST
    table: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.chunked = eligible(self.model)
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.ids = np.zeros(1 << 16, np.uint16 if self.model.get_piece_size() <= 1 << 16 else np.uint32)
        self.used = 0
        self.start, self.size, self.same = (np.zeros(1 << 14, t) for t in (np.int64, np.int32, bool))
        self.changed: dict[int, str] = {}

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if len(old) < need:
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _learn(self, chunks: list[str]) -> None:
        coded = self.model.encode(chunks, num_threads=1)
        back = self.model.decode(coded, num_threads=1)
        at = len(self.table)
        for name in ("start", "size", "same"):
            self._room(name, at + len(chunks))
        sizes = np.fromiter(map(len, coded), np.int32, len(coded))
        total = int(sizes.sum())
        self._room("ids", self.used + total)
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in coded for i in ids), self.ids.dtype, total)
        self.start[at : at + len(chunks)] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.size[at : at + len(chunks)] = sizes
        self.used += total
        for k, (chunk, text) in enumerate(zip(chunks, back, strict=True), at):
            self.table[chunk] = k
            self.same[k] = chunk == text
            if chunk != text:
                self.changed[k] = text

    def _entries(self, distinct: list[str]) -> np.ndarray:
        get = self.table.get
        new = [c for c in distinct if get(c) is None]
        if len(self.table) + len(new) > self.most and self.table:
            self._clear()
            new = distinct
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        return np.fromiter(map(self.table.__getitem__, distinct), np.int64, len(distinct))

    def rows(self, texts: pa.Array):
        """For each text: its ids, begin and end included, and the text that the ids decode to."""
        texts = texts.cast(pa.large_string()).fill_null("")
        flat = None
        if self.chunked:
            odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.equal(texts, ""))))
            flat = pc.split_pattern(texts, " ")
            coded = flat.flatten().dictionary_encode()
            entry = self._entries(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            at = flat.offsets.to_numpy()
            ids = self.ids[scan.ragged(self.start[entry], self.size[entry].astype(np.int64))]
            bounds = np.concatenate([[0], np.cumsum(self.size[entry])])[at]
            good = np.concatenate([[0], np.cumsum(~self.same[entry])])[at]
            odd = odd.to_pylist()
        for k in range(len(texts)):
            if flat is None or odd[k]:
                text = texts[k].as_py()
                out = self.model.encode(text)
                yield np.array([self.begin, *out, self.end], np.uint32), self.model.decode(out)
            else:
                out = np.empty(bounds[k + 1] - bounds[k] + 2, np.uint32)
                out[0], out[-1] = self.begin, self.end
                out[1:-1] = ids[bounds[k] : bounds[k + 1]]
                if good[k] == good[k + 1]:
                    yield out, texts[k].as_py()
                else:
                    words = texts[k].as_py().split(" ")
                    yield out, " ".join(self.changed.get(int(e), w) for e, w in zip(entry[at[k] : at[k + 1]], words, strict=True))


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row and, unless ``with_ids`` is false, ids and decoded."""

    def run(batches):
        pieces = loaded(model_path)
        for batch in batches:
            for lo, hi in scan.slices(batch.column(1), SLICE_BYTES):
                out = {k: [] for k in ("n", "a", "b", "ids", "text")}
                for ids, text in pieces.rows(batch.column(1).slice(lo, hi - lo)):
                    out["n"].append(len(ids))
                    out["a"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out["b"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(ids.view(np.int32))
                        out["text"].append(text)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())]
                if with_ids:
                    columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
