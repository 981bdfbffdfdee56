"""N-gram language model in an Elias-Fano trie (operator 5).

The model interpolates absolutely discounted trigrams, bigrams and unigrams:

    p(w | u v) = max(c(uvw) - D, 0) / c(uv) + g(uv) * p(w | v),  and so on down to
    p(w)       = max(c(w) - D, 0) / N + D * V / N / (V + 1),

where g gives each context's free mass to the shorter one. All bigrams and trigrams
are held, also those that occur once (MIN_COUNT). The first two terms of a level and g are quantised to 256 steps of
their logarithm, rounded down, so that no distribution sums to over 1.

The trie has three levels, each cut into shards of bounded size that are
memory-mapped: words by hash; for each word its successors; for each bigram its
successors. A level has the sorted contexts, monotone pointers to where their
children start, the children, and the cumulated counts, all as Elias-Fano
sequences. A trigram's last word is stored as its place among the successors of
the middle word, which is a bigram on its own, and is found by a successor search
relative to the context.

All texts are read: those with crc32(doc_id as text) mod FOLDS different from
HELD_OUT are counted, and all are scored. Counting merges per task before the
shuffle, in shards cut at equal shares of all tokens, so that a frequent word is
spread over several. Null texts count as empty: one end token. A null id is held
out. Texts are tokenised whole. Repeated ids and rows are documents like others; an
empty table gives no rows and no model; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import elias_fano as ef
from .common import documents, fresh_path, spool

FOLDS, HELD_OUT = 7, 2
MIN_COUNT, DISCOUNT = 1, 0.75
END = 0  # its hash; a word has another
WORDS_A_SHARD = 1 << 20
TOKENS_A_SHARD = 1 << 21
#: Bytes of text and numbered tokens that a task looks up at a time.
TEXT_BATCH, ID_BATCH = 1 << 23, 3 << 19
#: Distinct words that a task counts before it passes them on.
WORDS_HELD = 1 << 20
STEPS_A_DECADE = 32  # of the quantised logarithms; 256 of them reach down to 1e-8
_VALUES = np.concatenate([10.0 ** (-np.arange(255) / STEPS_A_DECADE), [0.0]]).astype(np.float32)


def quantise(p: np.ndarray) -> np.ndarray:
    """The code of the largest value of the code book that is not above p."""
    steps = np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS_A_DECADE - 1e-9)
    return np.clip(steps, 0, 255).astype(np.uint8)


def _letters() -> np.ndarray:
    """What each byte adds to the hash of its word: A-Z as a-z, 0 for white space."""
    values = np.arange(1, 257, dtype=np.uint64)
    values[65:91] += np.uint64(32)
    values[[32, *range(9, 14)]] = 0
    return values


_LETTERS = _letters()
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time.
HASHED = 1 << 19


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of these bytes, and where they start. A word's hash
    is a polynomial of its bytes, taken from prefix sums, and then mixed."""
    value = _LETTERS[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = value != 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(1 << max(HASHED.bit_length() - 1, len(data).bit_length()))
    value *= power[: len(data)]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, starts


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and then END, and the
    number of tokens of each text."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    parts, places, at = [], [], 0
    while at < len(data):
        end = min(at + HASHED, len(data))
        while end < len(data) and _LETTERS[data[end]]:  # to the end of a word
            end += 1
        h, starts = _hash_words(data[at:end])
        parts.append(h)
        places.append(starts + at)
        at = end
    h, starts = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((parts, np.uint64), (places, np.int64)))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, text_ends)
    sizes = np.diff(upto, prepend=0) + 1
    out = np.full(len(h) + len(texts), END, dtype=np.uint64)
    is_word = np.ones(len(out), dtype=bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = h
    return out, sizes


def _text(scalar: pa.StringScalar) -> bytes:
    buffer = scalar.as_buffer()
    return b"" if buffer is None else buffer.to_pybytes()


@lru_cache(maxsize=4096)
def _mapped(uri: str) -> ef.Mapped:
    return ef.open_mapped(uri)


def _spans(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal numbers of a sorted array."""
    if len(part):
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(part[begin]), slice(begin, end)


@dataclass
class Words:
    """Level 1. Ids are ranks of the words' hashes."""

    folder: str
    bits: int  # a shard has the hashes of equal first bits
    bases: list[int]  # per shard, of ids; then their number
    totals: list[int]  # per shard, of counts; then their sum

    @property
    def size(self) -> int:
        return self.bases[-1]

    @property
    def n_tokens(self) -> int:
        return self.totals[-1]

    def _shard(self, number: int) -> tuple[ef.Sequence, ef.Sequence]:
        arrays = _mapped(f"{self.folder}/words-{number}")
        return ef.sequence(arrays, "hash"), ef.sequence(arrays, "count")

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (self.size: unknown) and counts (0: unknown) of sorted hashes."""
        ids, counts = np.full(len(hashes), self.size, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        shards = (hashes >> np.uint64(64 - self.bits)) if self.bits else np.zeros(len(hashes), dtype=np.uint64)
        for number, own in _spans(shards):
            if self.bases[number] == self.bases[number + 1]:
                continue
            sequence, cumulated = self._shard(number)
            found = sequence.find(hashes[own])
            known = found >= 0
            ids[own] = np.where(known, found + self.bases[number], self.size)
            counts[np.arange(own.start, own.stop)[known]] = _differences(cumulated, found[known])
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for number, own in _spans(np.searchsorted(self.bases, ids, "right") - 1):
            out[own] = _differences(self._shard(number)[1], ids[own] - self.bases[number])
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids in any order; 0 of the unknown."""
        values, back = np.unique(ids, return_inverse=True)
        n_known = int(np.searchsorted(values, self.size))
        return np.concatenate([self.counts(values[:n_known]), np.zeros(len(values) - n_known, dtype=np.int64)])[back]

    def at_share(self, share: float) -> tuple[int, float]:
        """The word at this share of all tokens, in the order of ids, and the share
        of its own tokens that lies before."""
        want = min(int(share * self.n_tokens), self.n_tokens - 1)
        number = int(np.searchsorted(self.totals, want, "right")) - 1
        rest = want - self.totals[number]
        index, before = self._shard(number)[1].last_not_above(np.array([rest], dtype=np.uint64))
        word = int(index[0]) + self.bases[number]
        return word, (rest - int(before[0])) / max(1, int(self.counts(np.array([word]))[0]))


def _differences(cumulated: ef.Sequence, index: np.ndarray) -> np.ndarray:
    """The steps of a cumulated sequence at sorted indices."""
    both = np.union1d(index, index + 1)
    values = cumulated.get(both).astype(np.int64)
    return values[np.searchsorted(both, index + 1)] - values[np.searchsorted(both, index)]


@dataclass
class Level:
    """Level 2 or 3: children of contexts. A pair's key is the context, shifted by
    `bits`, and the child."""

    folder: str
    name: str
    bits: int
    bounds: np.ndarray  # keys at which a shard ends
    bases: list[int] = field(default_factory=lambda: [0])  # per shard, of pairs; then their number
    totals: list[int] = field(default_factory=lambda: [0])
    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # contexts that a bound cuts: code of g, first pair
    longest: int = 0  # children of a context

    def _arrays(self, number: int) -> ef.Mapped:
        return _mapped(f"{self.folder}/{self.name}-{number}")

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For keys in any order: the pair's number (-1: not held), the place among
        its context's children, its own share, and the context's g."""
        order = np.argsort(keys)
        keys = keys[order]
        first = np.ones(len(keys), dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
        keys = keys[first]  # each once
        pair, place = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int32 if self.longest < 2**31 else np.int64)
        share, free = np.zeros(len(keys), dtype=np.float32), np.ones(len(keys), dtype=np.float32)
        bits = np.uint64(self.bits)
        for number, own in _spans(np.searchsorted(self.bounds, keys, "right")):
            of_key = keys[own] >> bits
            new = np.concatenate([[True], of_key[1:] != of_key[:-1]])
            contexts, back = of_key[new], np.cumsum(new) - 1
            start = np.zeros(len(contexts), dtype=np.int64)
            g = np.ones(len(contexts), dtype=np.float32)
            if self.bases[number] < self.bases[number + 1]:
                arrays = self._arrays(number)
                rank = ef.sequence(arrays, "context").find(contexts)
                held = rank >= 0
                start[held] = self.bases[number] + ef.sequence(arrays, "start").get(rank[held]).astype(np.int64)
                g[held] = _VALUES[arrays["free"][rank[held]]]
                asked = np.flatnonzero(held[back])
                wanted = keys[own][asked] + ((rank[back[asked]].astype(np.uint64) - of_key[asked]) << bits)
                found = ef.sequence(arrays, "child").find(wanted)
                asked, found = asked[found >= 0], found[found >= 0]
                pair[own.start + asked] = self.bases[number] + found
                share[own.start + asked] = _VALUES[arrays["share"][found]]
                arrays.release()  # a task goes through all shards, and would hold the whole model
            for i in np.flatnonzero(np.isin(contexts, self._split_contexts())) if self.split else ():
                code, start[i] = self.split[int(contexts[i])]
                g[i] = _VALUES[code]
            free[own] = g[back]
            place[own] = np.where(pair[own] >= 0, pair[own] - start[back], 0)
        del keys
        of_key = np.empty(len(order), dtype=np.int64)
        of_key[order] = np.cumsum(first) - 1

        def back_in_order(x: np.ndarray) -> np.ndarray:
            return x[of_key]

        return back_in_order(pair), back_in_order(place), back_in_order(share), back_in_order(free)

    def _split_contexts(self) -> np.ndarray:
        return np.fromiter(self.split, dtype=np.uint64, count=len(self.split))

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of sorted pair numbers."""
        out = np.zeros(len(pairs), dtype=np.int64)
        for number, own in _spans(np.searchsorted(self.bases, pairs, "right") - 1):
            out[own] = _differences(ef.sequence(self._arrays(number), "count"), pairs[own] - self.bases[number])
        return out

    def at_share(self, share: float) -> tuple[int, float]:
        """The pair at this share of all counts, and the share of its own before."""
        want = min(int(share * self.totals[-1]), self.totals[-1] - 1)
        number = int(np.searchsorted(self.totals, want, "right")) - 1
        index, before = ef.sequence(self._arrays(number), "count").last_not_above(np.array([want - self.totals[number]], dtype=np.uint64))
        pair = int(index[0]) + self.bases[number]
        return pair, (want - self.totals[number] - int(before[0])) / max(1, int(self.counts(np.array([pair]))[0]))


@dataclass
class Model:
    words: Words
    bigrams: Level | None = None
    trigrams: Level | None = None

    def known_share(self, counts: np.ndarray) -> np.ndarray:
        """p(w) from the words' counts."""
        v, n = self.words.size, self.words.n_tokens
        if not n:
            return np.full(len(counts), 1 / (v + 1))
        return np.maximum(counts - DISCOUNT, 0) / n + DISCOUNT * v / n / (v + 1)

    @property
    def trigram_bits(self) -> int:
        return self.bigrams.longest.bit_length()

    def pair_keys(self, ids: np.ndarray) -> np.ndarray:
        ids = ids.view(np.uint64)
        return (ids[:-1] << np.uint64(self.bigrams.bits)) | ids[1:]

    def trigram_keys(self, pair: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of consecutive pairs; a second pair that isn't held has a place of its own."""
        child = np.where(pair[1:] >= 0, place[1:], self.bigrams.longest).astype(np.uint64)
        return (pair[:-1].view(np.uint64) << np.uint64(self.trigram_bits)) | child

    def log10_probabilities(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token; counts: of its word, first: whether it begins a document."""
        p = self.known_share(counts)
        if self.bigrams is None or len(ids) < 2:
            return np.log10(p)
        pair, place, share, free = self.bigrams.lookup(self.pair_keys(ids))
        inside = ~first[1:]
        p[1:] = np.where(inside, free * p[1:] + share, p[1:])
        if self.trigrams is not None and len(ids) > 2:
            at = np.flatnonzero(inside[:-1] & inside[1:] & (pair[:-1] >= 0))
            _, _, share, free = self.trigrams.lookup(self.trigram_keys(pair, place)[at])
            p[at + 2] = free * p[at + 2] + share
        return np.log10(p)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new, dtype=np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows without their last column, and that column's texts, up to TEXT_BATCH bytes."""
    rows: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for *row, text in zip(*batch.columns, strict=True):
            rows.append(tuple(x.as_py() for x in row))
            texts.append(_text(text))
            size += len(texts[-1])
            if size > TEXT_BATCH:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def count_words(docs: DataFrame) -> DataFrame:
    """docs(text): key, the hash of each word as a signed number, and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        for _, texts in _texts(batches):
            more, n = np.unique(token_hashes(texts)[0], return_counts=True)
            keys, counts = _merged(np.concatenate([keys, more]), np.concatenate([counts, n]))
            if len(keys) > WORDS_HELD:
                yield _batch(key=pa.array(keys.view(np.int64)), n=pa.array(counts))
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield _batch(key=pa.array(keys.view(np.int64)), n=pa.array(counts))

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def build_words(counts: DataFrame, folder: str) -> Words:
    """counts(key, n): write level 1."""
    n_words = counts.count()
    bits = max(0, math.ceil(math.log2(max(1, n_words / WORDS_A_SHARD))))

    def build(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        hashes = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        total = np.concatenate([[0], np.cumsum(table["n"].to_numpy()[order])])
        arrays = ef.named("hash", ef.encode(hashes[order], 1 << 64)) | ef.named("count", ef.encode(total, int(total[-1]) + 1))
        ef.write(f"{folder}/words-{number}", arrays)
        return pa.table({"shard": [number], "words": [len(order)], "tokens": [int(total[-1])]})

    shard = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")
    stats = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard bigint, words bigint, tokens bigint").collect()
    found = {r.shard: (r.words, r.tokens) for r in stats}  # a row for each shard
    sizes = np.array([found.get(i, (0, 0)) for i in range(1 << bits)], dtype=np.int64).reshape(-1, 2)
    ends = np.concatenate([[[0, 0]], np.cumsum(sizes, axis=0)])
    return Words(folder, bits, ends[:, 0].tolist(), ends[:, 1].tolist())


def _kind(largest: int) -> np.dtype:
    return np.dtype("<u4" if largest < 2**32 else "<u8")


def number_words(docs: DataFrame, words: Words) -> DataFrame:
    """docs(doc_id, text): doc_id, held_out, n_tokens, n_known, base_score, and the
    ids of its tokens (the vocabulary's size for the unknown), of 4 or 8 bytes each."""
    id_kind = _kind(words.size)
    log_all = math.log10(words.n_tokens + words.size + 1)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _texts(batches):
            hashes, sizes = token_hashes(texts)
            order = np.argsort(hashes)
            hashes = hashes[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            ids, counts = words.lookup(hashes[new])
            at = np.empty(len(order), dtype=np.int64)
            at[order] = np.cumsum(new) - 1
            ends = np.cumsum(sizes)
            begins = ends - sizes
            base = np.add.reduceat((np.log10(counts + 1.0) - log_all)[at], begins)
            known = np.add.reduceat((counts > 0).astype(np.int64)[at], begins)
            cut = lambda x: pa.array([x[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary())
            yield _batch(
                doc_id=pa.array([r[0] for r in rows], id_type), held_out=pa.array([r[1] for r in rows], pa.bool_()), n_tokens=pa.array(sizes),
                n_known=pa.array(known), base_score=pa.array(base), ids=cut(ids.astype(id_kind)[at]),
            )

    narrow = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, ids binary"
    return narrow.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Small batches, gathered up to ID_BATCH tokens."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            held.append(whole.slice(at, 64))
            size += sum(len(x.as_buffer()) for x in held[-1].column("ids")) // 4
            if size > ID_BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbers(held: list[pa.RecordBatch], column: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A column of the tokens' numbers, and whether each begins a document."""
    lists = [np.frombuffer(x.as_buffer(), dtype=kind) for b in held for x in b.column(column)]
    flat = np.concatenate(lists).astype(np.int64)
    first = np.zeros(len(flat), dtype=bool)
    first[np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])] = True
    return flat, first


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane, which compresses well."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _count_keys(ids: DataFrame, kind: np.dtype, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], bounds: np.ndarray) -> DataFrame:
    """Per task, batch and shard one row: the sorted distinct keys and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            keys, counts = np.unique(keys_of(*_numbers(held, "ids", kind)), return_counts=True)
            spans = list(_spans(np.searchsorted(bounds, keys, "right")))
            yield _batch(
                shard=pa.array([s for s, _ in spans], pa.int32()),
                keys=pa.array([_pack(keys[own]) for _, own in spans], pa.binary()),
                counts=pa.array([counts[own].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for _, own in spans], pa.binary()),
            )

    return ids.where(~F.col("held_out")).select("ids").mapInArrow(run, "shard int, keys binary, counts binary")


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a shard and their counts over all rows."""
    sizes = [len(x.as_buffer()) // 8 for x in table["keys"]]
    keys, counts, at = np.empty(sum(sizes), dtype=np.uint64), np.empty(sum(sizes), dtype=np.uint32), 0
    for k, c, n in zip(table["keys"], table["counts"], sizes, strict=True):
        keys[at : at + n] = _unpack(k.as_buffer())
        counts[at : at + n] = np.ascontiguousarray(np.frombuffer(c.as_buffer(), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
        at += n
    return _merged(keys, counts)


def build_level(counted: DataFrame, level: Level, context_counts: Callable[[np.ndarray], np.ndarray]) -> Level:
    """Write the shards of a level. Contexts that lie in several shards are put
    together from what each shard says of its first and last context."""

    def build(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        keys, counts = _merge(table)
        keys, counts = keys[counts >= MIN_COUNT], counts[counts >= MIN_COUNT]
        bits = np.uint64(level.bits)
        contexts, start, size = np.unique(keys >> bits, return_index=True, return_counts=True)
        said = []
        if len(keys):
            totals = context_counts(contexts.astype(np.int64)).astype(np.float64)
            rank = np.repeat(np.arange(len(contexts)), size)
            share = (counts - DISCOUNT) / totals[rank]
            mass = np.add.reduceat(share, start)
            cumulated = np.concatenate([[0], np.cumsum(counts)])
            child = keys + ((rank.astype(np.uint64) - contexts[rank]) << bits)
            arrays = (
                ef.named("context", ef.encode(contexts, int(contexts[-1]) + 1))
                | ef.named("start", ef.encode(start, len(keys) + 1))
                | ef.named("child", ef.encode(child, len(contexts) << level.bits))
                | ef.named("count", ef.encode(cumulated, int(cumulated[-1]) + 1))
                | {"share": quantise(share), "free": quantise(1 - mass)}
            )
            ef.write(f"{level.folder}/{level.name}-{number}", arrays)
            ends = dict.fromkeys((0, len(contexts) - 1))
            said = [(int(contexts[i]), float(mass[i]), int(start[i]), int(size[i])) for i in ends]
        names = ("context", "mass", "start", "size")
        ends = [dict(zip(names, x, strict=True)) for x in said]
        return pa.table({
            "shard": pa.array([number], pa.int32()), "pairs": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()),
            "longest": pa.array([int(size.max()) if len(size) else 0], pa.int64()),
            "ends": pa.array([ends], pa.list_(pa.struct([("context", pa.int64()), ("mass", pa.float64()), ("start", pa.int64()), ("size", pa.int64())]))),
        })

    schema = "shard int, pairs bigint, tokens bigint, longest bigint, ends array<struct<context: bigint, mass: double, start: bigint, size: bigint>>"
    stats = {r.shard: r for r in counted.groupBy("shard").applyInArrow(build, schema).collect()}  # a row for each shard
    parts: dict[int, list] = {}
    for number in range(len(level.bounds) + 1):
        r = stats.get(number)
        for end in r.ends if r else ():
            parts.setdefault(end.context, []).append((end.mass, level.bases[-1] + end.start, end.size))
        level.bases.append(level.bases[-1] + (r.pairs if r else 0))
        level.totals.append(level.totals[-1] + (r.tokens if r else 0))
    level.longest = max([0, *(r.longest for r in stats.values()), *(sum(s for *_, s in p) for p in parts.values())])
    cut = {int(b) >> level.bits for b in level.bounds}
    level.split = {c: (int(quantise(np.array([1 - sum(m for m, *_ in p)]))[0]), p[0][1]) for c, p in parts.items() if c in cut}
    return level


def _one_task(spark: SparkSession, make: Callable[[], list[int]]) -> np.ndarray:
    """Sorted keys that one task makes from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield _batch(key=pa.array(np.array(make(), dtype=np.uint64).view(np.int64)))

    rows = spark.range(0, 1, 1, 1).mapInArrow(run, "key bigint").collect()  # a key for each shard
    return np.unique(np.array([r.key for r in rows], dtype=np.int64).view(np.uint64))


def train(ids: DataFrame, words: Words) -> Model:
    """ids: of number_words(). The model of the rows that aren't held out."""
    spark, model = ids.sparkSession, Model(words)
    if not words.n_tokens:
        return model
    kind, bits = _kind(words.size), words.size.bit_length()
    n_shards = -(-words.n_tokens // TOKENS_A_SHARD)

    def word_bounds() -> list[int]:
        out = []
        for i in range(1, n_shards):
            word, part = words.at_share(i / n_shards)
            out.append((word << bits) | words.at_share(part)[0])  # its successors are like other words
        return out

    model.bigrams = Level(words.folder, "bigrams", bits, _one_task(spark, word_bounds))
    numbered = lambda numbers, first: model.pair_keys(numbers)[~first[1:]]
    build_level(_count_keys(ids, kind, numbered, model.bigrams.bounds), model.bigrams, words.counts)
    if not model.bigrams.bases[-1]:
        model.bigrams = None
        return model
    bigrams = model.bigrams
    n_shards = -(-bigrams.totals[-1] // TOKENS_A_SHARD)

    def pair_bounds() -> list[int]:
        return [(pair << model.trigram_bits) | int(part * bigrams.longest) for pair, part in (bigrams.at_share(i / n_shards) for i in range(1, n_shards))]

    if bigrams.bases[-1].bit_length() + model.trigram_bits > 64:
        raise OverflowError("too many bigrams for the keys of trigrams")
    trigrams = Level(words.folder, "trigrams", model.trigram_bits, _one_task(spark, pair_bounds))

    def triples(numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        pair, place, _, _ = bigrams.lookup(model.pair_keys(numbers))
        held = (pair >= 0) & ~first[1:]
        return model.trigram_keys(pair, place)[held[:-1] & held[1:]]

    model.trigrams = build_level(_count_keys(ids, kind, triples, trigrams.bounds), trigrams, bigrams.counts)
    return model


def score(ids: DataFrame, model: Model) -> DataFrame:
    """One row per document of number_words(), with the model's score."""
    id_kind = _kind(model.words.size)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            table = pa.Table.from_batches(held).select(names)
            numbers, first = _numbers(held, "ids", id_kind)
            p = model.log10_probabilities(numbers, model.words.counts_of(numbers), first)
            found = np.add.reduceat(p, np.flatnonzero(first))
            yield from table.append_column("score", pa.array(found)).combine_chunks().to_batches()

    types = dict(ids.dtypes)
    return ids.select(*names, "ids").mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names) + ", score double")


def op5_trie_language_model(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "trie"))
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    counts = spool(count_words(docs.where(~is_held_out(F.col("doc_id")))), "words", codec="zstd")
    words = build_words(counts, folder)
    ids = spool(number_words(docs, words), "ids", codec="zstd")
    found = score(ids, train(ids, words))
    return found.withColumn("train_tokens", F.lit(words.n_tokens).cast("bigint"))


#: Not expressible in SQL as a model; tested against a brute-force version.
ORACLE = None
