"""SentencePiece encoding and decoding through a table of distinct chunks.

Method. White space becomes a marker, and no piece of the vocabulary holds a marker behind another
sign. So no piece crosses from a sign to a marker, and a text may be cut there: into marked words,
each with the markers before it. A worker segments each distinct marked word once and keeps its ids
and its decoded text in a table; a text's ids are those of its chunks, put together by position.
Texts stay where they are, nothing is shuffled, and the table is bounded: past its bound it starts
anew. Where a vocabulary or its normalisation doesn't allow the cut, the chunk is the whole text.

Texts: null counts as empty; an empty text has no ids. Very long texts and words are taken whole.
Rows may repeat, keys may be null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from structpeak.llm.textbuf import blocks, column_bytes, spans

MARK = "▁"
#: A marked word with the markers before it.
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*")
#: Distinct chunks, and characters of them, kept per worker; beyond it the table starts anew.
CACHE_CHUNKS, CACHE_CHARACTERS = 400_000, 16_000_000
#: Signs that the usual normalisations change: full width, ligature, combining, blank-like, capital.
PROBE = "Ａ ﬁ é   \t　 Ä ① ß "


class Chunks(dict):
    """The table's row of every chunk; one that is asked for the first time gets the next row."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = row = len(self)
        self.new.append(chunk)
        return row


class PieceEncoder:
    """One model file and the chunks seen so far, with their decoded texts if so asked."""

    def __init__(self, path: str, decodes: bool = True):
        self.decodes = decodes
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces) and self.model.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
        self.blank = [self.model.piece_to_id(MARK)]
        token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length = np.array([len(t) for t in token], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known = Chunks()
        self.characters = 0
        self.ids = np.zeros(0, np.int32)
        self.cut = np.zeros(1, np.int64)
        self.back: list[str] = []

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(" " + text) if self.cuts else [" " + text]

    def _learn(self) -> None:
        """Segments the new chunks; the model adds the first marker again."""
        new, self.known.new = self.known.new, []
        found = [ids or self.blank for ids in self.model.encode([c[1:] for c in new], num_threads=1)]
        self.characters += sum(map(len, new))
        self.cut = np.concatenate((self.cut, self.cut[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(found), np.int32)))
        if self.decodes:
            self.back += [" " + b for b in self.model.decode(found, num_threads=1)]

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The table's row of every chunk of every text, and the borders of each text's chunks."""
        if len(self.known) > CACHE_CHUNKS or self.characters > CACHE_CHARACTERS:
            self._reset()
        parts = [self.chunks(t) for t in texts]
        cut = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, cut[-1])
        if self.known.new:
            self._learn()
        return rows, cut

    def ids_of(self, slot: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the borders of each text's ids, from the rows of their chunks."""
        count = self.cut[slot + 1] - self.cut[slot]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.ids[np.repeat(self.cut[slot], count) + spans(count)], total[cut]

    def texts_of(self, slot: np.ndarray, cut: np.ndarray) -> list[str]:
        """Decoded texts, from the rows of their chunks; the first marker of a text is no blank."""
        rows = list(map(self.back.__getitem__, slot.tolist()))
        return ["".join(rows[a:b])[1:] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file."""
    return PieceEncoder(path)


def text_list(data: np.ndarray, borders: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (text rebuilt from the ids) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path)
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                slot, own = coder.slots(text_list(part, local))
                ids, cut = coder.ids_of(slot, own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)), pa.array(coder.texts_of(slot, own), pa.string()),
                ], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def decode_documents(coded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``decoded`` from any ids the model knows, control ids and single bytes included; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_encoder(path).model
        for batch in batches:
            rows = [r or [] for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(rows, num_threads=1) if rows else [], pa.string())], ["key", "decoded"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(coded[key].alias("key"), coded[ids].cast("array<int>").alias("ids")).mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)
