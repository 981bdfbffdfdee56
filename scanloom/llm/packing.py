"""Cost-balanced packing into training sequences (operator 8).

A document costs LINEAR * n + QUADRATIC * n * n for n tokens: its share of the
linear layers and of attention within itself. Documents, longest first, go to the
sequence of the lowest cost so far that still has room for them. Pieces of a full
sequence are cut off long documents beforehand; a document that fits nowhere is
cut over the sequences with the most room. A batch of documents gets as many
sequences as its tokens need, so that it wastes less than one sequence.

Each task packs its own rows in batches of up to BATCH_TOKENS tokens, so nothing is
shuffled and memory is bounded by a batch and one document. A null or empty text
is the end-of-document token alone. Repeated ids and rows are packed like any
other; other input columns are ignored; an empty table gives no rows. Very long
texts are tokenised whole, piece by piece, cut where the tokenizer's pattern
always ends a match.

Tokens are those of the byte-level BPE file, taken from the rank file of the same
vocabulary by the faster library; tests hold them against the first library. The
string of the file's added token is that token wherever it occurs, as there.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, quoted

SEQUENCE_TOKENS = 2048
END_TOKEN = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens that a task packs at a time.
BATCH_TOKENS = 4_000_000
#: Characters that are tokenised at a time.
CHUNK_CHARS = 1 << 16
# The vocabulary's added token and its id.
ADDED, ADDED_ID = "<|endoftext|>", 50256
SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

_encoders: dict = {}


def encoder(path: str | None = None):
    """The encoding of a rank file (default: byte_bpe_50k), kept per worker."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of about size characters. White space after another character always
    starts a new match of the tokenizer's pattern, so cutting there changes no token."""
    at, cut = 0, re.compile(r"(?<=\S)\s")
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def tokens(text: str | None, bpe) -> np.ndarray:
    """The ids of a whole text and the end token, little-endian unsigned 32-bit."""
    ids = []
    for i, between in enumerate((text or "").split(ADDED)):
        if i:
            ids.append(np.asarray([ADDED_ID], dtype="<u4"))
        ids += [np.asarray(bpe.encode_ordinary(part), dtype="<u4") for part in chunks(between)]
    return np.concatenate([*ids, np.asarray([END_TOKEN], dtype="<u4")])


def pack(lengths: list[int], capacity: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    placed: list[tuple[int, int, int, int, int]] = []
    pieces: list[tuple[int, int, int]] = []  # longest first
    whole = 0
    for doc, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            placed.append((doc, start, capacity, whole, 0))
            whole += 1
        if rest := length % capacity:
            pieces.append((-rest, doc, length - rest))
    heapq.heapify(pieces)
    count = -(-sum(-size for size, _, _ in pieces) // capacity)
    used, cost = [0] * count, [0.0] * count
    fits = capacity  # the length that is being placed; it never grows
    by_cost = [(0.0, s) for s in range(count)]  # sequences with room for that length
    by_room: list[list[int]] = [[] for _ in range(capacity)]  # those with less
    while pieces:
        size, doc, start = heapq.heappop(pieces)
        size = -size
        while fits > size:
            fits -= 1
            for s in by_room[fits]:
                heapq.heappush(by_cost, (cost[s], s))
            by_room[fits].clear()
        if by_cost:
            s = heapq.heappop(by_cost)[1]
        else:  # fits nowhere whole: fill the largest room, and place what is left later
            room = next(r for r in range(size - 1, 0, -1) if by_room[r])
            s = by_room[room].pop()
            heapq.heappush(pieces, (room - size, doc, start + room))
            size = room
        placed.append((doc, start, size, whole + s, used[s]))
        used[s] += size
        cost[s] += LINEAR * size + QUADRATIC * size * size
        room = capacity - used[s]
        if room >= fits:
            heapq.heappush(by_cost, (cost[s], s))
        elif room:
            by_room[room].append(s)
    return placed


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, of the input's type, and SCHEMA. Sequence ids are the partition's number times
    2**32 plus a count, so a task that runs again gives the same."""

    narrow = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    id_type = to_arrow_type(narrow.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, next_sequence = encoder(vocabulary), TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence, held
            pieces = pack([len(t) for t in texts], capacity)
            rows = [
                (ids[d], start, size, zlib.crc32(texts[d][start : start + size].tobytes()), len(texts[d]), next_sequence + s, offset)
                for d, start, size, s, offset in pieces
            ]
            next_sequence += 1 + max((s for *_, s, _ in pieces), default=-1)
            ids.clear(), texts.clear()
            held = 0
            names = ["doc_id", *(field.split()[0] for field in SCHEMA.split(", "))]
            first, *rest = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(first, id_type), *(pa.array(c, pa.int64()) for c in rest)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(tokens(text.as_py(), bpe))
                held += len(texts[-1])
                if held >= BATCH_TOKENS:
                    yield flush()
        if texts:
            yield flush()

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, {SCHEMA}")


def op8_cost_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir, "doc_id", "text"))


#: SQL has no tokenizer; the query is tested by an exact round trip.
ORACLE = None
