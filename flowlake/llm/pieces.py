"""Operator 6: SentencePiece encoding and decoding through a table of distinct chunks.

The library marks white space with U+2581. When no piece of the model has a marker after another
character, no merge crosses from a word into the next marker, so a text falls into chunks (markers
and the word after them) that can be segmented alone. Each distinct chunk is segmented once, by the
library, and its ids are joined back in the order of the chunks. A model without that property, or
one that rewrites characters, is used on whole texts instead.

The table of a Python worker holds ``TABLE_CHUNKS`` entries at most and starts anew beyond that.

Defined cases: a null text counts as empty and has the end id only; texts of any length and without
white space are encoded whole; repeated rows and ids are separate rows; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table, text_or_empty, texts_of

MARK = "▁"
TABLE_CHUNKS = 500_000
CHUNK = re.compile(r" *[^ ]+| +")
IRREGULAR = re.compile(r"  |^ | $")
PROBE = "ﬁ ①  Å　\t\n x "


class ChunkTable:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        self.by_chunk = not crossing and self.model.decode(self.model.encode(PROBE)) == PROBE
        self.mark_id = self.model.piece_to_id(MARK)
        self.end_id = self.model.eos_id()
        self.ids: dict[str, list[int]] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first marker: the library puts that marker before any text it encodes."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not IRREGULAR.search(text):
            return text.split(" ")
        return [c[1:] for c in CHUNK.findall(" " + text)]

    def learn(self, chunks: list[str]) -> None:
        if "" in chunks:  # a marker alone
            self.ids[""] = [self.mark_id]
            chunks = [c for c in chunks if c]
        self.ids.update(zip(chunks, self.model.encode(chunks, num_threads=1), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.by_chunk:
            return [[*ids, self.end_id] for ids in self.model.encode(texts, num_threads=1)]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids.clear()
        split = [self.chunks(t) for t in texts]
        self.learn([c for c in set().union(*split) if c not in self.ids])
        end = (self.end_id,)
        return [[*chain.from_iterable(map(self.ids.__getitem__, chunks)), *end] for chunks in split]


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id) and the text decoded from them."""
    return _mapped(docs, model, "doc_id bigint, ids array<int>, decoded string", lambda doc_ids, ids, texts: [
        doc_ids, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())
    ])


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, without moving either."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, model, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda doc_ids, ids, texts: [
        doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(" ".join(map(str, x))) for x in ids]), pa.array([sha(x) for x in texts])
    ])


def _mapped(docs: DataFrame, model: str | None, schema: str, columns) -> DataFrame:
    model = model or default_model()
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = chunk_table(model)
        ids = pieces.encode(texts_of(batch))
        return pa.RecordBatch.from_arrays(columns(batch.column("doc_id"), ids, [pieces.model.decode(x) for x in ids]), names=names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map_batches(batches, work)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(mapped, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
