"""SentencePiece encoding and decoding with a table of distinct marked words.

A byte-pair piece model writes every space as a marker and joins neighbouring symbols.  Where no piece
holds a marker behind another character, no join crosses from a word to the marker that follows it,
so a text falls into *marked words* (one or more markers, then anything but markers) that are segmented
independently of each other.  Each distinct marked word is given to the library once per block of
texts, and the ids of a text are those of its marked words in the order of their positions.

The table lives in the worker process: texts are not shuffled, nothing is broadcast, and no text waits
for another.  Between blocks it keeps frequent words; its size is bounded (``entries``).  A model for
which the property does not hold (another normaliser or algorithm, pieces across markers) is asked for
whole texts instead; the result is the library's own in both cases.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import give_back, slices

MARKER = "▁"
_RUN = re.compile(r" +[^ ]*")
_SLICE = 1_000_000      # characters that are worked on together


def marked_words(text: str) -> list[str]:
    """The marked words of a text that is not empty, each without its first marker; markers are spaces.

    The library puts one marker before a text, so every marked word starts with one.
    """
    text = text.replace(MARKER, " ")
    if text[0] == " " or "  " in text:
        return [w[1:] for w in _RUN.findall(" " + text)]
    return text.split(" ")


def separable(model) -> bool:
    """Whether marked words are segmented independently: byte-pair joins of the text as it is written,
    one marker put before it, and no piece with a marker behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(model.serialized_model_proto())
    norm, train = m.normalizer_spec, m.trainer_spec
    plain = {pb.ModelProto.SentencePiece.NORMAL, pb.ModelProto.SentencePiece.BYTE, pb.ModelProto.SentencePiece.UNKNOWN,
             pb.ModelProto.SentencePiece.CONTROL}
    return (train.model_type == pb.TrainerSpec.BPE and not train.treat_whitespace_as_suffix
            and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces
            and all(p.type in plain and MARKER not in p.piece.lstrip(MARKER) for p in m.pieces))


class Pieces:
    """``encode_all(texts)`` -> little-endian unsigned 32-bit ids as bytes, ``decode(ids)`` -> text.

    At most ``entries`` words of at most ``longest`` characters stay in the table between blocks.
    """

    def __init__(self, path: str, entries: int = 300_000, longest: int = 64):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separable = separable(self.model)
        self._entries, self._longest = entries, longest
        # a lone marker has no text of its own: it is what a trailing space adds
        self._lone = self._raw(self.model.encode("a ", num_threads=1)[len(self.model.encode("a", num_threads=1)):])
        self._table: dict[str, bytes] = {"": self._lone}
        self.decimals = [str(i) for i in range(self.model.get_piece_size())]

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if not self.separable:
            return [self._raw(self.model.encode(t, num_threads=1)) if t else b"" for t in texts]
        words = [marked_words(t) if t else [] for t in texts]
        distinct = set().union(*words)
        table = self._table
        new = list(distinct.difference(table))
        if len(table) + len(new) > self._entries:       # words of this block stay, among them the frequent ones
            table = self._table = {w: table[w] for w in distinct.intersection(table)} | {"": self._lone}
        found, raw = table, self._raw
        table.update(zip(new, map(raw, self.model.encode(new, num_threads=1) if new else [])))
        out = [b"".join(map(found.__getitem__, w)) for w in words]
        if len(table) > self._entries:
            self._table = {"": self._lone}
        else:
            for w in new:
                if len(w) > self._longest:
                    del table[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text that the library's ``decode`` gives for the ids."""
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())

    def written(self, ids: bytes) -> str:
        """The ids as decimal numbers, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def pieces(path: str) -> Pieces:
    """The worker process's model, loaded once and kept with its table for all tasks."""
    kept = sys.__dict__.setdefault("_behaviorkit_pieces", {})
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def ids_of(text: Column, model: str) -> Column:
    """Binary column of the ids of a text column, see :func:`encode`."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = pieces(model)
        for texts in batches:
            texts = texts.where(texts.notna(), "")
            yield pd.Series([ids for part in slices(texts, _SLICE) for ids in table.encode_all(part)], dtype=object)
            del texts
        give_back()

    return run(text)


def text_of(ids: Column, model: str) -> Column:
    """String column of the texts of a column of ids; null ids give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = pieces(model)
        for b in batches:
            yield pd.Series([None if i is None else table.decode(i) for i in b], dtype=object)

    return run(ids)


def digests_of(ids: Column, model: str) -> Column:
    """Struct ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8)."""
    from hashlib import sha256

    def both(table: Pieces, raw: bytes) -> tuple[str, str]:
        return (sha256(table.written(raw).encode()).hexdigest(), sha256(table.decode(raw).encode("utf-8", "surrogatepass")).hexdigest())

    @F.pandas_udf("ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = pieces(model)
        for b in batches:
            yield pd.DataFrame([both(table, raw) for raw in b], columns=["ids_sha256", "decoded_sha256"])
        give_back()

    return run(ids)


def encode(docs: DataFrame, model: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` plus the ids of its whole texts as binary (little-endian unsigned 32-bit), without begin or end ids.

    ``model`` is the place of a piece model on every executor.  A null or empty text has no id (empty
    binary); rows, null keys, repeated rows and further columns stay as they are; an empty table gives an
    empty one.  A very long text is a block of its own: memory grows with the longest text, and a
    marked word of any length is given to the library whole.
    """
    return docs.withColumn(name, ids_of(F.col(text), model))


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` plus the texts that the library's ``decode`` gives for its ids (null ids: null, no id: empty)."""
    return encoded.withColumn(name, text_of(F.col(ids), model))


def round_trip_digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` per row: its text encoded, the ids decoded again."""
    coded = encode(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), model, "_text", "_ids")
    coded = coded.select("_key", "_ids", digests_of(F.col("_ids"), model).alias("_d"))
    return coded.select(F.col("_key").alias(key), F.floor(F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
                        "_d.ids_sha256", "_d.decoded_sha256")
