"""Best-fit decreasing packing of tokenised documents into sequences of bounded length.

Best-fit decreasing looks only at lengths, so it is run on the histogram of piece lengths (at most
``capacity`` counts, whatever the input, which is all that the driver sees): equal pieces are placed together into runs of equally full
open sequences. A segment tree over remaining capacities finds the tightest open sequences in
logarithmic time. The plan says for the r-th piece of each length where it lies; pieces get their rank
by counting per (length, bucket) before ranking inside a bucket. Buckets grow in number with the pieces and are
dealt by a hash of the piece and its place in the task that made it, so neither a length with a third of all
pieces nor equal rows are ranked by one task.

Defined results: null and empty texts are the end-of-document id alone; repeated rows are packed one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splatlake.llm.storage import written

CAPACITY = 4096
END_ID = 1
#: Words kept with their ids in a task.
CACHE_WORDS = 450_000
#: New words that the tokenizer gets at once.
LINES = 20_000
#: Bytes of texts that are encoded at once.
SLICE_BYTES = 1 << 22
#: Pieces of one length that a task ranks.
BUCKET_ROWS = 100_000


def _stand_ins() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


STAND_INS = _stand_ins()
# The stages before the model for which texts may be encoded word by word.
STAGES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_in(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


#: Marks after a word that are a token's text of their own; those of special tokens and contractions are not among them.
MARKS = "".join(sorted(set(string.punctuation) - set("'<|>_")))
BLANK_BYTES, MARK_BYTES, LETTER_BYTES = _bytes_in(b" \t\n\r"), _bytes_in(MARKS.encode()), _bytes_in(string.ascii_letters.encode())


def blank_separated(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of UTF-8 texts in turn, and the number of words up to each text's end.

    Marks between an ASCII letter and a blank are a word of their own.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # each text ends with a blank
    blank, mark = BLANK_BYTES[data], MARK_BYTES[data]
    keep = ~blank
    begin = keep.copy()
    begin[1:] &= blank[:-1]
    after = np.flatnonzero(mark[1:] & LETTER_BYTES[data[:-1]]) + 1
    other = np.flatnonzero(~mark)
    begin[after[blank[other[np.searchsorted(other, after)]]]] = True
    at = np.flatnonzero(begin)
    kept = data[keep]
    offsets = np.append(np.cumsum(keep, dtype=np.int32)[at] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))


class WordEncoder:
    """Ids of whole texts, by a memo of the ids of blank-separated words; other tokenizers than that of ``STAGES`` get whole texts.

    The tokenizer folds runs of white space, drops them and never joins what stands on both sides of
    one, so a text's ids are those of its words in turn. It also lower-cases, and parts letters from the
    marks after them; doing so before words are looked up keeps the memo small. Texts are taken many at
    once: each of their different words is looked up once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            stages = json.load(f)
        added = stages.get("added_tokens") or []
        plain = not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or set(a["content"]) & set(" \t\n\r" + MARKS) for a in added)
        self.by_words = plain and all(stages.get(k) == v for k, v in STAGES.items()) and stages.get("post_processor") is None
        self.special = [a["content"].lower() for a in added]
        # For lines of letters alone, each one pre-token, and the id between two.
        self.lines = Tokenizer(self.tokenizer.model)
        self.lines.pre_tokenizer = Sequence([Split("\n", "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.line_end = self.lines.encode("\n", add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return self.encode_texts([text])[0]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.by_words:
            return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        words, ends = blank_separated([self.lowered(t).encode() for t in texts])
        codes = words.dictionary_encode()
        ids = self.look_up(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins, codes = np.cumsum(sizes) - sizes, codes.indices.to_numpy()
        sizes = sizes[codes]
        edges = np.append(0, np.cumsum(sizes))
        places = np.repeat(begins[codes] - edges[:-1], sizes) + np.arange(edges[-1])
        flat = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        return [flat[a:b] for a, b in itertools.pairwise([0, *(4 * edges[ends]).tolist()])]

    def lowered(self, text: str) -> str:
        """The text in lower case where this changes no id, else as it is."""
        low = text.lower()
        if not text.isascii() and (len(low) != len(text) or "Σ" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low))):
            return text
        return text if any(s in low for s in self.special) else low  # <|EndOfText|> is no special token, but is one in lower case

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        found = list(map(self.memo.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            self.learn([words[k] for k in missing])
            for k in missing:
                found[k] = self.memo[words[k]]
        return found

    def learn(self, words: list[str]) -> None:
        if len(self.memo) > CACHE_WORDS:  # what came first is mostly what is frequent
            self.memo = dict(itertools.islice(self.memo.items(), CACHE_WORDS // 2))
        letters, parts = [], {}
        for w in words:
            if self.is_letters(w):
                letters.append(w)
            else:
                parts[w] = self.parts(w)
        more = {p for some in parts.values() for p in some}.difference(letters, self.memo)
        self.encode_letters([*letters, *filter(self.is_letters, more)])
        self.encode_words([p for p in more if p not in self.memo])
        for w, some in parts.items():
            self.memo[w] = b"".join(map(self.memo.__getitem__, some))

    @staticmethod
    def is_letters(word: str) -> bool:
        """Whether the tokenizer takes a word as it is for one pre-token of letters."""
        if word.isascii():
            return word.isalpha() and word.islower()
        return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)

    def parts(self, word: str) -> tuple[str, ...]:
        word = self.lowered(word)
        letters = word.rstrip(MARKS)
        if letters != word and letters and self.is_letters(letters[-1]):
            return letters, word[len(letters) :]
        return (word,)

    def encode_letters(self, words: list[str]) -> None:
        for k in range(0, len(words), LINES):
            lines = words[k : k + LINES]
            ids = np.asarray(self.lines.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.line_end[0])).tolist() if len(self.line_end) == 1 else []
            if len(ends) == len(lines) - 1:
                flat = ids.tobytes()
                self.memo.update(zip(lines, [flat[a + 4 : b] for a, b in itertools.pairwise([-4, *ends, len(flat)])], strict=True))
            else:  # the vocabulary has no line end of its own
                self.encode_words(lines)

    def encode_words(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.memo[w] = np.asarray(e.ids, "<u4").tobytes()


@functools.lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (doc_id, text) of about ``SLICE_BYTES`` of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
        yield batch.slice(a, b - a)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, salt (and ids).

    The salt tells equal rows of a task apart.
    """
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(path), 0
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            size = 0
            for doc, ids in zip(batch.column(0), encode.encode_texts([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                salt = salt + 1 & 0x7FFFFFFF
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc.as_py(), k, at // 4, len(piece) // 4, zlib.crc32(piece), salt, piece if with_ids else None), strict=True):
                        column.append(value)
                    size += len(piece) if with_ids else 0
                if size > 1 << 24:
                    yield table(rows)
                    rows, size = ([], [], [], [], [], [], []), 0
            yield table(rows)

    def table(rows) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        arrays = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
        return pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:6], names if with_ids else names[:6])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


class OpenSequences:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while sequences with that room are open."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        self.runs[room].append((first, count))
        node = room + self.width
        while node and not self.tree[node]:
            self.tree[node] = 1
            node >>= 1

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            node = room + self.width
            self.tree[node] = 0
            node >>= 1
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = 0
                node >>= 1
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open sequence has."""
        node = need + self.width
        if self.tree[node]:
            return need
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on counts: rows (length, first rank, ranks, first sequence, sequences, pieces in each, offset).

    Of one length, ranks [first, first + ranks) go to the sequences in turn, each taking up to
    ``pieces in each`` beside each other, from ``offset`` on.
    """
    rows, opened, tree = [], 0, OpenSequences(capacity)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                fit = capacity // length
                room, first, count = capacity, opened, -(-left // fit)
                opened += count
            else:
                first, count = tree.pop(room)
            fit = room // length
            whole = min(count, left // fit)
            if whole:
                rows.append((length, rank, whole * fit, first, whole, fit, capacity - room))
                tree.push(room - fit * length, first, whole)
                rank, left = rank + whole * fit, left - whole * fit
            if whole < count:
                rest = count - whole
                if left and left < fit:
                    rows.append((length, rank, left, first + whole, 1, left, capacity - room))
                    tree.push(room - left * length, first + whole, 1)
                    whole, rest, left = whole + 1, rest - 1, 0
                if rest:
                    tree.push(room, first + whole, rest)
    return np.array(rows, np.int64).reshape(-1, 7)


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces, as ``pieces`` makes it; the salt goes."""
    spark = cut.sparkSession
    histogram = dict(cut.groupBy("length").count().collect())  # at most capacity counts
    if not histogram:
        return cut.drop("salt").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    buckets = -(-max(histogram.values()) // bucket_rows)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    placed = plan(histogram, capacity)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = cut.withColumn("nth", F.row_number().over(order) - 1).join(begin, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("begin") + F.col("nth")).drop("begin", "nth", "bucket", "salt")
    step = int(placed[:, 1].max()) + int(placed[:, 2].max()) + 1
    shared = spark.sparkContext.broadcast(placed)
    at = [ranked.columns.index(c) for c in ("length", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * step + rows[:, 1]
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            row = rows[np.searchsorted(keys, length * step + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 3] + nth // row[:, 5]
            offset = row[:, 6] + nth % row[:, 5] * length
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at[1]]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, path or tokenizer_path(), capacity), "pieces")
    return pack(cut, capacity)
