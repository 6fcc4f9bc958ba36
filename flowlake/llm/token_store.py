"""Operator 1: token ids in directly addressable codes.

Ids are cut into 8-bit chunks. Level 0 has the low chunk of every id, and a bitmap that says which
ids continue; level 1 has the next chunk of those, and so on. A rank directory (ones before each
512-bit block) turns a position of one level into its position on the next, so any id is read with
one look at each level and no block is decoded.

A store is a Parquet folder. A row is a segment: whole documents in ascending ``doc_id`` order, their
ids and lengths, and the binary codes of about ``SEGMENT_TOKENS`` ids. ``part`` and ``segment`` give
the order of segments. The writer sorts by range partitions, encodes in Arrow batches, and leaves
committing to Spark, so a lost executor costs a task.

The tokenizer encodes distinct words, not texts: byte-level pre-tokenisation never crosses a single
space between two other characters, so a text is the concatenation of its words' codes. A worker
keeps the words it met in a table of bounded size. A text that holds the content of an added token
(as ``<|endoftext|>``) is encoded whole, for the tokenizer looks for those before it looks for words;
as is its default, such content becomes the added token's id.

Defined cases: a null text counts as empty and has the end id only; null ids come first; repeated
rows and ids are kept, ordered by a hash of the text; an empty table makes a store without
segments; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, table, text_or_empty, texts_of

END_ID = 2
SEGMENT_TOKENS = 1 << 20
CHUNK_BITS, RANK_BITS = 8, 512
MAGIC = b"DAC1"
TABLE_WORDS = 1_000_000
SEGMENT_SCHEMA = "part int, segment int, before bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<int>, codes binary"

WORD_STARTS = re.compile(r"(?<=\S)(?= \S)")


# ---- codes ---------------------------------------------------------------------------------------


def pack_ids(ids: np.ndarray) -> bytes:
    """The codes of ``ids``: magic, number of levels, then per level its length, chunks, bitmap, ranks."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        high = rest >> CHUNK_BITS
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(rest) // RANK_BITS) or 1, dtype="<u4")
        ones = np.add.reduceat(more.astype(np.int64), np.arange(0, len(rest), RANK_BITS)) if len(rest) else np.zeros(0, np.int64)
        blocks[1:] = np.cumsum(ones)[:-1]
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + blocks.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)
        rest = high[more]


class Codes:
    """A view of packed codes: ``codes[i]`` reads one id, ``all()`` reads all of them."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("these are no directly addressable codes")
        self.levels, at = [], 5
        for _ in range(data[4]):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = data[at : at + -(-n // 8)]
            at += -(-n // 8)
            blocks = -(-n // RANK_BITS) or 1
            ranks = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        found = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            found |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = int.from_bytes(bits[block * RANK_BITS // 8 : (i >> 3) + 1], "little")
            before &= (1 << (i - block * RANK_BITS)) - 1
            i = int(ranks[block]) + before.bit_count()
        return found

    def all(self) -> np.ndarray:
        found = None
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if found is not None:
                more = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: len(chunks)].astype(bool)
                own[more] |= found << CHUNK_BITS
            found = own
        return found


# ---- encoding ------------------------------------------------------------------------------------


class WordEncoder:
    """Encodes texts by distinct words; ``encode`` gives each text's ids as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = added
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.inner: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str], at_once: int = 64) -> None:
        """Words that follow a space. Many are encoded in one text and told apart by their bytes."""
        lots = [words[lo : lo + at_once] for lo in range(0, len(words), at_once)]
        for some, found in zip(lots, self.ids([" " + " ".join(some) for some in lots]), strict=True):
            ids = np.frombuffer(found, "<u4")
            ends = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum([len(w.encode()) + 1 for w in some])
            cut = np.searchsorted(ends, wanted) + 1
            if not np.array_equal(ends[cut - 1], wanted):
                raise ValueError("the tokenizer joins words across a space")
            data, start = ids.tobytes(), 0
            for word, stop in zip(some, (4 * cut).tolist(), strict=True):
                self.inner[word] = data[start:stop]
                start = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > TABLE_WORDS:
            self.inner.clear()
        if len(self.whole) > TABLE_WORDS // 10:
            self.whole.clear()
        split, alone, entire = [], set(), []
        cut = [text.split(" ") for text in texts]
        new = set().union(*cut) - self.inner.keys()
        spaced = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        new -= spaced
        for text, parts in zip(texts, cut, strict=True):
            if any(a in text for a in self.added):
                entire.append(text)
                split.append(None)
                continue
            tail = []
            if not spaced.isdisjoint(parts):  # white space beside white space, or at an end
                parts = WORD_STARTS.split(text)
                tail = [parts.pop()] if len(parts) > 1 and parts[-1][-1].isspace() else []
                parts[1:] = [p[1:] for p in parts[1:]]
                new.update(p for p in parts[1:] if p not in self.inner)
                alone.update(tail)
            alone.add(parts[0])
            split.append((parts[0], parts[1:], tail))
        self.learn(list(new))
        alone = [x for x in alone if x not in self.whole]
        self.whole.update(zip(alone, self.ids(alone), strict=True))
        inner, whole, entire = self.inner.__getitem__, self.whole.__getitem__, iter(self.ids(entire))
        return [next(entire) if s is None else b"".join([whole(s[0]), *map(inner, s[1]), *map(whole, s[2])]) for s in split]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- store ---------------------------------------------------------------------------------------


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode every text, append ``end_id``, and write the ids of all documents in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_uid", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_uid")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, before, held = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids, lengths, pieces = [], [], []
        encoder = word_encoder(tokenizer)

        def flush() -> pa.RecordBatch:
            codes = pack_ids(np.frombuffer(b"".join(pieces), "<u4"))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([codes], pa.binary()),
            ], names=["part", "segment", "before", "n_tokens", "doc_ids", "lengths", "codes"])

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch)), strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                pieces += (ids, end)
                held += lengths[-1]
                if held >= segment_tokens:
                    yield flush()
                    segment, before, held = segment + 1, before + held, 0
                    doc_ids, lengths, pieces = [], [], []
        if doc_ids:
            yield flush()

    rows.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def part_starts(store: DataFrame) -> DataFrame:
    """Ids before each part: one number per written file, so it is small whatever the corpus."""
    sums = sorted(tuple(r) for r in store.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for part, n in sums:
        starts.append((part, at))
        at += n
    return store.sparkSession.createDataFrame(starts, "part int, part_start bigint")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    store = read_store(spark, path)
    placed = store.join(F.broadcast(part_starts(store)), "part")
    placed = placed.select((F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "lengths", "codes")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, codes = (batch.column(k)[i].as_py() for k in range(4))
                data = memoryview(Codes(codes).all().astype("<u4").tobytes())
                ends = np.cumsum(np.array(lengths, dtype=np.int64))
                begins = ends - lengths
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The id at each global ``position`` of a query set, by the rank directories alone.

    Positions meet their segment on cells of ``SEGMENT_TOKENS`` ids; those outside the store have no row.
    """
    store = read_store(spark, path)
    starts = F.col("part_start") + F.col("before")
    where = store.select("part", "segment", "before", "n_tokens").join(F.broadcast(part_starts(store)), "part").withColumn("start", starts)
    cell = lambda c: F.floor(c / SEGMENT_TOKENS).cast("long")
    where = where.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("n_tokens") - 1))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", cell(F.col("position")))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    hits = asked.join(where, "cell").filter(inside).groupBy("part", "segment", "start").agg(F.collect_list("position").alias("positions"))
    rows = hits.join(store.select("part", "segment", "codes"), ["part", "segment"]).select("start", "positions", "codes")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, asked, codes = (batch.column(k)[i].as_py() for k in range(3))
                view = Codes(codes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(asked, pa.int64()), pa.array([view[p - start] for p in asked], pa.int32()),
                ], names=["position", "token"])

    return rows.mapInArrow(look, "position bigint, token int")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return document_digests(spark, path)
