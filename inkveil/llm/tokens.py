"""Token ids of a corpus in directly addressable codes.

The ids of a segment are split into 8-bit chunk levels.  Level 0 holds the low chunk of every id, level k the next chunk
of those ids that have one; a continuation bitmap at each level says which do, and a rank directory counts its ones per
512 bits, so token i is reached by one rank per level and nothing is decoded.

File format: a Parquet table with a row per segment of whole documents in ascending doc_id order (range, seq, doc_ids,
lengths, payload).  Payload: ``DAC1``, number of levels (u32), then per level count (u64), chunks, bitmap (bits in
little order, padded to bytes) and rank directory (u32 each), all little-endian.

Nulls and odd input: a null text is empty and has the end id alone; null doc_ids come first; repeated rows are encoded
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm import ranges
from inkveil.llm.common import LOWER, UPPER, python_tasks
from inkveil.sources.session import shared_dir

MAGIC = b"DAC1"
BLOCK_BITS = 512
#: Tokens after which a segment ends, at the end of a document.
SEGMENT = 1_000_000
SEGMENTS = "range int, seq int, doc_ids array<long>, lengths array<long>, payload binary"


# --- the code ---


def encode_codes(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (BLOCK_BITS // 8)) * (BLOCK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.reshape(-1, BLOCK_BITS // 8)).sum(1, dtype=np.uint32)
        rank = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append(np.uint64(len(rest)).tobytes() + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return MAGIC + np.uint32(len(levels)).tobytes() + b"".join(levels)


class Codes:
    """Read access to one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment")
        self.payload, at = payload, 8
        self.levels = []
        for _ in range(int.from_bytes(payload[4:8], "little")):
            n = int.from_bytes(payload[at : at + 8], "little")
            chunks, bits = at + 8, at + 8 + n
            ranks = bits + -(-n // 8)
            at = ranks + 4 * -(-n // BLOCK_BITS)
            self.levels.append((n, chunks, bits, ranks))

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        p, value, shift = self.payload, 0, 0
        for _, chunks, bits, ranks in self.levels:
            value |= p[chunks + i] << shift
            if not p[bits + i // 8] >> i % 8 & 1:
                break
            block = i // BLOCK_BITS
            start = bits + block * (BLOCK_BITS // 8)
            rank = int.from_bytes(p[ranks + 4 * block : ranks + 4 * block + 4], "little")
            inside = int.from_bytes(p[start : bits + i // 8 + 1], "little") & ((1 << i % BLOCK_BITS) - 1)
            i, shift = rank + inside.bit_count(), shift + 8
        return value

    def all(self) -> np.ndarray:
        values = np.zeros(len(self), np.uint32)
        where = np.arange(len(self))
        for k, (n, chunks, bits, _) in enumerate(self.levels):
            values[where] |= np.frombuffer(self.payload, np.uint8, n, chunks).astype(np.uint32) << np.uint32(8 * k)
            flags = np.frombuffer(self.payload, np.uint8, -(-n // 8), bits)
            where = where[np.unpackbits(flags, count=n, bitorder="little").astype(bool)]
        return values


# --- the tokenizer ---


class Encoder:
    """Ids of whole texts; the ids of pieces seen before are remembered.

    White space never reaches a token, so the pieces between spaces and line ends are encoded one by one, A-Z
    lower-cased as the tokenizer does (unless a text may hold a special token, whose letters count, or a combining
    mark, which the tokenizer composes before it lower-cases).  A piece of Latin
    letters is one word to the tokenizer, so unknown words go to it in one line and are told apart by their word ends;
    any other piece goes to it alone.
    """

    LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]?)")
    LOWER = bytes.maketrans(UPPER.encode() + b"\n", LOWER.encode() + b" ")
    SPACE = bytes.maketrans(b"\n", b" ")
    #: Special tokens, and first bytes of the combining marks U+0300 to U+036F.
    CASED = re.compile(rb"<\||[\xcc\xcd]")
    #: Pieces held before the memory starts anew; it changes speed only.
    HELD = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.signs = {c.encode(): self.alone([c])[0] for c in ".,;:!?"}
        self.pieces: dict[bytes, bytes] = {b"": b""}

    def alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, pieces: set[bytes]) -> None:
        fresh, signed, odd, held = [], [], [], self.pieces
        for piece in pieces:
            if m := self.LETTERS.fullmatch(piece):
                word, sign = m.groups()
                if sign:
                    signed.append((piece, word, sign))
                    if word not in held and word not in pieces:
                        fresh.append(word)
                else:
                    fresh.append(word)
            else:
                odd.append(piece)
        fresh = list(set(fresh))
        for at in range(0, len(fresh), 5000):
            part = fresh[at : at + 5000]
            line = self.alone([b" ".join(part).decode()])[0]
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(line, np.uint32)]) + 1) * 4).tolist()
            if len(cuts) == len(part):
                held.update(zip(part, (line[a:b] for a, b in zip([0, *cuts], cuts))))
            else:  # a tokenizer without word ends
                held.update(zip(part, self.alone([p.decode() for p in part])))
        for piece, word, sign in signed:
            held[piece] = held[word] + self.signs[sign]
        for at in range(0, len(odd), 1000):
            part = odd[at : at + 1000]
            held.update(zip(part, self.alone([p.decode("utf-8", "surrogatepass") for p in part])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > self.HELD:
            self.pieces = {b"": b""}
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        split = [t.translate(self.SPACE if self.CASED.search(t) else self.LOWER).split(b" ") for t in raw]
        unknown = set().union(*split).difference(self.pieces)
        if unknown:
            self.learn(unknown)
        ids = self.pieces.__getitem__
        return [np.frombuffer(b"".join(map(ids, ws)), np.uint32) for ws in split]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it remembers outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    return Encoder(path)


# --- write and read ---


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Encode ``docs(doc_id, text)`` and write the segments to ``path``.

    Texts move once, to ranges of doc_id of about equal bytes.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    key = ranges.sortable("doc_id")
    bounds = ranges.splitters(docs.select(key.alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, segment, end = encoder(tokenizer), None, np.array([end_id], np.uint32)
        for part in parts:
            for r, doc, ids in zip(part["range"], part["doc_id"], coder.encode(list(part["text"]))):
                if segment is not None and (segment.range != r or segment.tokens >= SEGMENT):
                    yield segment.rows()
                    segment = _Segment(r, segment.seq + 1 if segment.range == r else 0)
                segment = segment or _Segment(r, 0)
                segment.add(None if pd.isna(doc) else int(doc), np.concatenate((ids, end)))
        if segment is not None:
            yield segment.rows()

    rows = docs.select("doc_id", "text", ranges.range_of(key, bounds).cast("int").alias("range"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(n, len(bounds) // 4), "range").sortWithinPartitions("range", "doc_id")
    rows.mapInPandas(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


class _Segment:
    def __init__(self, number: int, seq: int):
        self.range, self.seq, self.tokens = number, seq, 0
        self.docs: list = []
        self.lengths: list[int] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.ids.append(ids)
        self.tokens += len(ids)

    def rows(self) -> pd.DataFrame:
        payload = encode_codes(np.concatenate(self.ids))
        return pd.DataFrame({"range": [self.range], "seq": [self.seq], "doc_ids": [self.docs], "lengths": [self.lengths], "payload": [payload]})


def read_tokens(spark, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # segments are some megabytes each
    stored = spark.read.schema(SEGMENTS).parquet(path)

    def documents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                ids = Codes(row.payload).all().astype("<u4")
                lengths = np.array(row.lengths, np.int64)
                starts = np.cumsum(lengths) - lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())]
                yield pd.DataFrame({
                    "range": np.int32(row.range), "seq": np.int32(row.seq), "doc_id": pd.array(list(row.doc_ids), "Int64"),
                    "at": starts, "n_tokens": lengths, "ids_crc32": np.array(crc, np.int64),
                })

    read = stored.mapInPandas(documents, "range int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    places = ranges.before(stored.select(F.col("range").alias("r"), "seq", size.alias("n")), {"start": "n"}, ["seq"])
    places = places.select(F.col("r").alias("range"), "seq", F.col("start").alias("segment_start"))
    return read.join(places, ["range", "seq"]).select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_dir(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
