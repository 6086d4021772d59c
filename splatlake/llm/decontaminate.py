"""Benchmark decontamination by an FM-index per shard of training documents.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. The phrases of an item are its
windows of 10 consecutive words, or all its words if it has fewer. Each task cuts its documents into
shards, builds an FM-index for each, searches all phrases backward together, locates the occurrences by
sampled suffix positions and merges them to removal spans. A neighbourhood of two words that no phrase
has cannot lie inside an occurrence, so the shard's text is cut there before it is indexed and what is
shorter than the shortest phrase is left out; this is exact and keeps indexes small.

Items are read in blocks of some ``BLOCK_BYTES`` of text, each with its own pass over the documents, which
is written to the shared folder before the next block is broadcast; so what is broadcast at a time is
bounded whatever the size of the benchmark.

Defined results: null or empty documents have no words; items without words or without an id have no
phrases; repeated rows count for themselves; empty tables give no rows or no hits; extra columns are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.columns import shielded
from splatlake.llm.fmindex import FMIndex
from splatlake.llm.storage import discard, written
from splatlake.llm.words import NOT_ALNUM, Scanner, column, offsets_of, ranges_of, sub_ranges

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Text of a shard.
SHARD_BYTES = 8 << 20
#: Words in the index of a shard.
SHARD_WORDS = 1 << 18


@dataclass
class Phrases:
    """Phrases of a block of items over its own alphabet (symbols from 2; 1 separates)."""

    words: np.ndarray  # sorted hashes; symbol = place + 2
    pairs: np.ndarray  # sorted codes of neighbouring symbols
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: phrases, item offsets, items
    items: list[str]

    @staticmethod
    def of(rows: list[tuple], window: int = WINDOW) -> Phrases:
        names = sorted({str(r[0]) for r in rows})
        place = {name: k for k, name in enumerate(names)}
        scan = Scanner(NOT_ALNUM, lower=True)
        found: dict[tuple, set[int]] = {}
        for name, text in rows:
            for part in scan(pa.array([text]), 1 << 40):
                h = part.hash.tolist()
                for k in range(max(1, len(h) - window + 1)) if h else ():
                    found.setdefault(tuple(h[k : k + window]), set()).add(place[str(name)])
        words = np.unique(np.array([w for p in found for w in p], np.uint64))
        by_length, pairs = {}, [np.zeros(0, np.int64)]
        for length in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == length]
            symbols = np.searchsorted(words, np.array(own, np.uint64).reshape(-1, length)) + 2
            sizes = [len(found[p]) for p in own]
            by_length[length] = (symbols, np.concatenate([[0], np.cumsum(sizes)]), np.array([i for p in own for i in sorted(found[p])], np.int64))
            pairs.append((symbols[:, :-1] * (len(words) + 2) + symbols[:, 1:]).ravel())
        return Phrases(words, np.unique(np.concatenate(pairs)), by_length, names)


class Shard:
    """Words of consecutive documents, of which those that may lie in an occurrence are indexed."""

    def __init__(self, phrases: Phrases):
        self.p = phrases
        self.shortest = min(phrases.by_length, default=1)
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = self.words = 0

    def add(self, hashes: np.ndarray, limit: np.ndarray) -> None:
        """Words of a slice; limit: where each word's document ends."""
        n, at = len(hashes), np.searchsorted(self.p.words, hashes)
        at[at == len(self.p.words)] = 0
        symbol = np.where(self.p.words[at] == hashes, at + 2, 0) if len(self.p.words) else np.zeros(n, np.int64)
        joined = np.zeros(n, bool)  # with the next word
        if n > 1 and len(self.p.pairs):
            both = np.flatnonzero((symbol[:-1] > 0) & (symbol[1:] > 0) & (limit[:-1] > np.arange(1, n)))
            code = symbol[both] * (len(self.p.words) + 2) + symbol[both + 1]
            k = np.searchsorted(self.p.pairs, code)
            k[k == len(self.p.pairs)] = 0
            joined[both] = self.p.pairs[k] == code
        inside = symbol > 0
        first = inside & ~np.concatenate([[False], joined[:-1]])
        start = np.flatnonzero(first)
        stop = np.flatnonzero(inside & ~joined) + 1
        long = stop - start >= self.shortest
        start, size = start[long], (stop - start)[long]
        # One separator after each run.
        place = sub_ranges(start, size + 1)
        ends = np.cumsum(size + 1) - 1
        values = symbol[np.minimum(place, n - 1)] if n else symbol
        values[ends] = 1
        self.symbols.append(values)
        self.places.append(place + self.words)
        self.size, self.words = self.size + len(values), self.words + n

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, length of each occurrence; (occurrence's first word, item) pairs."""
        out: tuple[list, ...] = ([], [], [], [])
        if self.size:
            index, place = FMIndex(np.concatenate(self.symbols), len(self.p.words) + 2), np.concatenate(self.places)
            for length, (symbols, offsets, items) in self.p.by_length.items():
                low, high = index.search(symbols)
                rows = sub_ranges(low, high - low)
                phrase = np.repeat(np.arange(len(low)), high - low)
                word = place[index.locate(rows)]
                sizes = np.diff(offsets)[phrase]
                for column_, value in zip(out, (word, np.full(len(word), length), np.repeat(word, sizes), items[sub_ranges(offsets[phrase], sizes)]), strict=True):
                    column_.append(value)
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


ADDED = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "clean_text": "string"}


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items_sha256, contaminated and clean_text (hit spans removed) in place of columns of these names."""
    plain, _, safe = shielded(docs, "text")
    return _scanned(plain, benchmark, window).select(*[F.col(s).alias(c) for c, s in safe.items() if c not in ADDED], *[F.col(f"_dc_{c}").alias(c) for c in ADDED])


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = docs.withColumns({"_dc_hits": F.lit(None).cast("binary"), "_dc_items": F.array().cast("array<string>")})
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        phrases = spark.sparkContext.broadcast(Phrases.of([tuple(r) for r in own.collect()], window))  # one bounded block
        last = block == blocks - 1
        schema = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
        if last:
            schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + "".join(f", _dc_{c} {t}" for c, t in ADDED.items())
        before, out = out, out.mapInArrow(_pass(phrases, last), schema)
        if not last:
            out = written(out, "hits")
            phrases.destroy()
        if block and not last:
            discard(before)
    return out


def _pass(phrases, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(NOT_ALNUM, lower=True)
        for batch in batches:
            texts = column(batch, "text")
            for row, end in ranges_of(texts, SHARD_BYTES):
                yield from _shard(batch.slice(row, end - row), texts.slice(row, end - row), scan, phrases.value, last)

    return run


def _shard(batch: pa.RecordBatch, texts: pa.Array, scan: Scanner, phrases: Phrases, last: bool) -> Iterator[pa.RecordBatch]:
    parts = []
    found: tuple[list, ...] = ([], [], [], [])
    shard, base, words = Shard(phrases), 0, 0

    def close() -> None:
        for to, value, shift in zip(found, shard.occurrences(), (base, 0, base, 0), strict=True):
            to.append(value + shift)

    for part in scan(texts):
        shard.add(part.hash, part.limit())
        words += len(part.start)
        parts.append((part.start + part.doc_bytes[0], part.end, part.doc, len(part.start)))
        if shard.size >= SHARD_WORDS:
            close()
            base, shard = words, Shard(phrases)
    close()
    word, length, of_word, item = (np.concatenate(x) for x in found)
    # Word offsets of documents in the shard, and bytes of words in the shard's text.
    n, shift_words, at = len(texts), 0, [np.zeros(1, np.int64)]
    for _, _, doc, size in parts:
        at.append(doc[1:] + shift_words)
        shift_words += size
    doc = np.concatenate(at)
    cover = np.zeros(words + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + length, -1)
    hit = np.cumsum(cover[:-1]) > 0
    names = np.array(phrases.items, object)
    pairs = np.unique((np.searchsorted(doc, of_word, "right") - 1) * max(1, len(names)) + item)
    of_doc, of_item = pairs // max(1, len(names)), pairs % max(1, len(names))
    cuts = np.searchsorted(of_doc, np.arange(n + 1))
    hits_before = batch.column(batch.schema.get_field_index("_dc_hits"))
    items_before = batch.column(batch.schema.get_field_index("_dc_items"))
    if hits_before.null_count < n:  # an earlier block of items has marked words
        for k, bits in enumerate(hits_before):
            if bits.is_valid:
                hit[doc[k] : doc[k + 1]] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8))[: doc[k + 1] - doc[k]].astype(bool)
    items = []
    for k in range(n):
        own = names[of_item[cuts[k] : cuts[k + 1]]].tolist() if cuts[k] < cuts[k + 1] else []
        items.append(sorted({*own, *(items_before[k].as_py() or [])}))
    keep = [i for i, name in enumerate(batch.schema.names) if name not in ("_dc_hits", "_dc_items")]
    columns, labels = [batch.column(i) for i in keep], [batch.schema.names[i] for i in keep]
    if not last:
        bits = [np.packbits(hit[doc[k] : doc[k + 1]]).tobytes() for k in range(n)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))], [*labels, "_dc_hits", "_dc_items"])
        return
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[doc[1:]] - total[doc[:-1]]
    text = texts.cast(pa.string())
    if n_hit.any():
        text = _without(texts, parts, hit, doc, n_hit)
    digests: dict[tuple, str] = {}
    sha = [digests.get(key := tuple(x)) or digests.setdefault(key, hashlib.sha256(",".join(x).encode()).hexdigest()) for x in items]
    added = [pa.array(np.diff(doc)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0), text]
    yield pa.RecordBatch.from_arrays([*columns, *added], [*labels, *[f"_dc_{c}" for c in ADDED]])


def _without(texts: pa.Array, parts: list, hit: np.ndarray, doc: np.ndarray, n_hit: np.ndarray) -> pa.Array:
    """Texts without each hit word and what stands between it and the next word."""
    offsets, starts, row, seen = offsets_of(texts), [], 0, 0
    for start, _, own, size in parts:
        starts.append(start + (offsets[row] - offsets[0]))
        row += len(own) - 1
        seen += size
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    out = []
    for k, text in enumerate(texts):
        if not n_hit[k]:
            out.append(text.as_py())
            continue
        data, own = text.as_buffer().to_pybytes(), slice(doc[k], doc[k + 1])
        begin = np.append(start[own] - (offsets[k] - offsets[0]), len(data))
        edge = np.diff(np.concatenate([[0], hit[own].astype(np.int8), [0]]))
        at, kept = 0, []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            kept.append(data[at : begin[a]])
            at = begin[b]
        kept.append(data[at:])
        out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with all benchmark passages cut out of their texts (and n_chars counted anew, if there)."""
    names = docs.columns
    plain, restored, _ = shielded(docs, "text", "n_chars")
    out = _scanned(plain, benchmark, window).withColumn("text", F.when(F.col("_dc_contaminated"), F.col("_dc_clean_text")).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_dc_contaminated"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return restored(out)
