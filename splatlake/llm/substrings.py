"""Substring deduplication: words in windows that occur more than once are removed.

The reference is the corpus itself. Its suffix automata are made by shard, and documents are streamed
against them for matching statistics; but as the reference grows with the corpus, neither can all of it
be broadcast nor each document meet every shard. So both go to shards by content:

1. Each window of ``WINDOW`` words is anchored at the leftmost of its k-word grams with the smallest hash;
   equal windows have equal anchors. Anchors are (hash, document, place); those whose hash occurs once
   can't belong to a repeated window and are left out. Within a batch a hash goes to the shuffle once.
2. Documents get their remaining anchors and cut segments, the windows of an anchor and no more. Equal
   segments of a batch become one row with a list of places.
3. A shard (a range of anchor hashes) builds the suffix automaton of its segments, weighted by copies,
   and streams them through it: a window whose matching statistic reaches its length and that occurs
   twice or more is repeated. Spans of such windows return to their documents and are removed, merged.

Automata are of at most about ``AUTOMATON_WORDS`` words; a shard holds one at a time. ``remove_known``
is the plain form, for a given reference: automata of its parts are broadcast, as many at a time as a bound
allows, and documents are streamed once for each such block.

Defined results: null and empty texts have no words; rows that repeat in doc_id and text count as
places each; a null doc_id is a value like others; empty tables give no rows; extra columns are kept by
``drop_repeats``, whatever their names, and ignored else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.automaton import SuffixAutomaton
from splatlake.llm.columns import shielded
from splatlake.llm.storage import discard, written
from splatlake.llm.words import Scanner, Words, column, mix, sliding_min

WINDOW = 35
GRAM = 16
AUTOMATON_WORDS = 60_000
_U = np.uint64
_PLACE = _U((1 << 28) - 1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def anchors(part: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash, word, first window and last window of each anchor; words are those of the slice."""
    n = len(part.start)
    place = np.arange(n)
    whole = place + window <= part.limit()
    if not whole.any():
        return (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
    h = part.ngrams(gram)
    # The high bits of the hash and then the place: the smallest is the leftmost of the smallest.
    least = sliding_min(h & ~_PLACE | place.astype(_U), window - gram + 1)
    start = np.flatnonzero(whole)
    at = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return h[at[first]], at[first], start[first], start[np.append(first[1:], len(start)) - 1]


def _keys(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({"_sd_k1": F.xxhash64("doc_id", text), "_sd_k2": F.hash(text, "doc_id")})


def _named(table: DataFrame) -> DataFrame:
    """With names that shielded columns don't have."""
    return table.select(*[F.col(c).alias(f"_sd_{c}") for c in table.columns])


def _scan(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            found: tuple[list, ...] = ([], [], [], [])
            for part in Scanner()(column(batch, "text")):
                h, at, _, _ = anchors(part, window, gram)
                row = np.searchsorted(part.doc, at, "right") - 1
                for to, x in zip(found, (h, k1[part.row + row], k2[part.row + row], at - part.doc[row]), strict=True):
                    to.append(x)
            if not found[0]:
                continue
            h, k1, k2, at = (np.concatenate(x) for x in found)
            order = np.lexsort((at, k2, k1, h))
            h, k1, k2, at = h[order], k1[order], k2[order], at[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            repeated = np.zeros(len(h), bool)
            other = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (at[1:] != at[:-1])
            group = np.cumsum(new) - 1
            repeated = np.bincount(group[1:][~new[1:] & other], minlength=group[-1] + 1 if len(group) else 0)[group] > 0 if len(h) else repeated
            # Of a hash the first place goes to the hash's partition; other places only where there is room.
            key = np.where(new, h, mix(k1.view(_U) ^ at.astype(_U)))
            keep = new | repeated
            columns = [pa.array(key[keep].view(np.int64)), pa.array(k1[keep]), pa.array(k2[keep]), pa.array(at[keep].astype(np.int32)), pa.array((new.astype(np.int8) + 2 * repeated.astype(np.int8))[keep])]
            for a in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 100_000) for c in columns], ["key", "k1", "k2", "at", "kind"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of hashes that occur at two places or more; rows come sorted by (key, kind, k1, k2, at).

    kind: 1 first of its hash in a batch, 2 a further place (known to be repeated), 3 first and known.
    """
    held: tuple | None = None  # the first row of a hash, while it is not known to be repeated
    now, known = None, False
    for batch in batches:
        key, k1, k2, at, kind = (batch.column(i).to_numpy() for i in range(5))
        if not len(key):
            continue
        out = kind == 2
        first = np.flatnonzero(kind != 2)
        k = key[first]
        cut = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        group = np.cumsum(cut) - 1
        place = np.column_stack([k1[first], k2[first], at[first]])
        if len(k):
            carry = now == k[0]
            differs = np.concatenate([[False], (place[1:] != place[:-1]).any(1) & ~cut[1:]])
            if carry and held is not None and tuple(place[0]) != held[0]:
                differs[0] = True
            flag = np.bincount(group[differs | (kind[first] == 3)], minlength=group[-1] + 1) > 0
            if carry and known:
                flag[0] = True
            out[first] = flag[group]
            extra = [held[0]] if carry and held is not None and flag[0] and not known else []
            last_known = bool(flag[-1])
            if group[-1] > 0 or not carry:
                held = tuple(place[np.flatnonzero(cut)[-1]]), None
            now, known = k[-1], last_known
        else:
            extra = []
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[out], np.array([e[i] for e in extra], x.dtype)])) for i, x in enumerate((k1, k2, at))], ["k1", "k2", "at"])


def _segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, wanted = (batch.column(batch.schema.get_field_index(c)) for c in ("_sd_k1", "_sd_k2", "_sd_wanted"))
            k1, k2 = k1.to_numpy(), k2.to_numpy()
            found: dict[tuple[int, bytes], list] = {}
            for part in Scanner()(column(batch, "text")):
                h, at, low, high = anchors(part, window, gram)
                row = np.searchsorted(part.doc, at, "right") - 1
                chosen = np.zeros(len(part.start), bool)
                for d in range(part.n):
                    chosen[part.doc[d] + wanted[part.row + d].values.to_numpy()] = True
                own = np.flatnonzero(chosen[at])
                for a, hash_, r, lo, hi in zip(own, h[own].view(np.int64).tolist(), row[own].tolist(), low[own].tolist(), high[own].tolist(), strict=True):
                    words = part.hash[lo : hi + window].tobytes()
                    found.setdefault((hash_, words), []).append((k1[part.row + r], k2[part.row + r], lo - part.doc[r]))
                if len(found) > 40_000:
                    yield _rows(found)
                    found = {}
            yield _rows(found)

    return run


_PLACE_TYPE = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("at", "<i4")])


def _rows(found: dict) -> pa.RecordBatch:
    h, words = zip(*found, strict=True) if found else ((), ())
    places = [np.array(sorted(set(x)), _PLACE_TYPE).tobytes() for x in found.values()]
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(words, pa.binary()), pa.array(places, pa.binary())], ["hash", "words", "places"])


def _match(window: int):
    def solve(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        """Spans of repeated windows of the segments of whole anchor hashes."""
        merged: dict[bytes, set[bytes]] = {}
        size = _PLACE_TYPE.itemsize
        for words, places in rows:
            own = merged.setdefault(words, set())
            own.update(places[k : k + size] for k in range(0, len(places), size))
        automaton = SuffixAutomaton()
        sequences = {w: np.frombuffer(w, "<i8").tolist() for w in merged}
        for w, sequence in sequences.items():
            automaton.add(sequence, len(merged[w]))
        automaton.close()
        out: tuple[list, ...] = ([], [], [], [])
        for w, sequence in sequences.items():
            sizes, counts = automaton.matching_statistics(sequence, window)
            hits = [e - window + 1 for e in range(window - 1, len(sequence)) if sizes[e] >= window and counts[e] > 1]
            if hits:
                cover = np.array(hits)
                first = np.flatnonzero(np.diff(cover, prepend=-2 * window) > window)
                begin, end = cover[first], cover[np.append(first[1:], len(cover)) - 1] + window
                places = np.frombuffer(b"".join(merged[w]), _PLACE_TYPE)
                for b, e in zip(begin, end, strict=True):
                    for to, x in zip(out, (places["k1"], places["k2"], places["at"] + b, places["at"] + e), strict=True):
                        to.append(x)
        kinds = (np.int64, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], ["k1", "k2", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes]] = []
        now, size = None, 0
        for batch in batches:
            for h, words, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h != now and size > AUTOMATON_WORDS:
                    yield solve(rows)
                    rows, size = [], 0
                now = h
                rows.append((words, places))
                size += len(words) // 8
        yield solve(rows)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents with ``_sd_spans``, the word spans of repeated windows (null: none), and ``_sd_rows``, if over one row has the same doc_id and text."""
    keyed = _keys(docs)
    texts = keyed.select(F.col("_sd_k1").alias("k1"), F.col("_sd_k2").alias("k2"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_scan(window, gram), "key long, k1 long, k2 int, at int, kind byte")
    found = found.repartition("key").sortWithinPartitions("key", "kind", "k1", "k2", "at").mapInArrow(_repeated, "k1 long, k2 int, at int")
    wanted = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("wanted"))
    # With all columns, so that the shuffle of the documents is the one that the last join uses, too.
    segments = keyed.join(_named(wanted), ["_sd_k1", "_sd_k2"]).select(*keyed.columns, "_sd_wanted").mapInArrow(_segments(window, gram), "hash long, words binary, places binary")
    spans = segments.repartition("hash").sortWithinPartitions("hash").mapInArrow(_match(window), "k1 long, k2 int, begin int, end int")
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    # Rows that repeat in doc_id and text are places of their own: all their windows are repeated.
    twice = keyed.groupBy("_sd_k1", "_sd_k2").agg(F.count("*").alias("_sd_rows")).where("_sd_rows > 1")
    return keyed.join(_named(spans), ["_sd_k1", "_sd_k2"], "left").join(twice, ["_sd_k1", "_sd_k2"], "left")


def _removed(words: int, spans: list | None, rows: int | None, window: int) -> np.ndarray:
    gone = np.zeros(words + 1, np.int64)
    if rows and words >= window:
        gone[0] += 1
        gone[words] -= 1
    for s in spans or ():
        gone[s["begin"]] += 1
        gone[s["end"]] -= 1
    return np.cumsum(gone[:-1]) > 0


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for text, spans, rows in zip(column(batch, "text"), batch.column(2), batch.column(3), strict=True):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                if spans.is_valid or rows.is_valid:
                    gone = _removed(n, spans.as_py(), rows.as_py(), window)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for to, x in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = repeated_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), window)
    kind = dict(docs.dtypes)["doc_id"]
    return found.select("doc_id", "text", "_sd_spans", "_sd_rows").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def _cut(text: bytes, gone: np.ndarray) -> str:
    """The text without removed words and what stands between each and the next word."""
    begin = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    at, kept = 0, []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        kept.append(text[at : begin[a]])
        at = begin[b]
    return b"".join([*kept, text[at:]]).decode()


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without the words of repeated windows (and n_chars counted anew, if there)."""
    docs, restored, _ = shielded(docs, "doc_id", "text", "n_chars")
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, rows in zip(batch.column(place), batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                if text.is_valid and (spans.is_valid or rows.is_valid):
                    data = text.as_buffer().to_pybytes()
                    gone = _removed(len(data.split()), spans.as_py(), rows.as_py(), window)
                    out.append(_cut(data, gone) if gone.any() else text.as_py())
                else:
                    out.append(text.as_py())
            columns = [pa.array(out, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.is_valid for s in batch.column(len(names))], pa.bool_())], [*names, "_sd_cut"])

    clean = repeated_spans(docs.withColumn("text", F.col("text").cast("string")), window).select(*names, "_sd_spans", "_sd_rows")
    schema = ", ".join(f"`{c}` {t}" for c, t in clean.select(*names).dtypes) + ", _sd_cut boolean"
    clean = clean.mapInArrow(run, schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.col("_sd_cut"), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return restored(clean)


class Shards:
    """Automata of word sequences, made once in each worker that holds the broadcast."""

    def __init__(self, sequences: list[bytes]):
        self.sequences, self.made = sequences, None

    def __getstate__(self):
        return {"sequences": self.sequences, "made": None}

    def automata(self) -> list[SuffixAutomaton]:
        if self.made is None:
            self.made = []
            for sequence in self.sequences:
                self.made.append(SuffixAutomaton())
                self.made[-1].add(np.frombuffer(sequence, "<i8").tolist())
        return self.made


def _reference_parts(window: int, words: int):
    """Word hashes of texts, cut into parts that overlap by a window less a word, so that each window lies in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in Scanner()(column(batch, "text")):
                out = []
                for d in range(part.n):
                    own = part.hash[part.doc[d] : part.doc[d + 1]]
                    out += [own[k : k + words + window - 1].tobytes() for k in range(0, len(own) - window + 1, words)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    return run


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, part_words: int = AUTOMATON_WORDS, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id and spans of words that the texts of ``reference`` share in runs of at least ``window`` words.

    Blocks of some ``block_bytes`` of word hashes are broadcast one after the other; spans found so far are
    written to the shared folder between them.
    """
    parts = written(reference.select(F.col("text").cast("string").alias("text")).mapInArrow(_reference_parts(window, part_words), "words binary"), "reference")
    size = parts.agg(F.sum(F.octet_length("words"))).head()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    schema = f"doc_id {kind}, text string, spans array<struct<begin:int,end:int>>"
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def streamed(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = shared.value.automata()
            for batch in batches:
                found: list[list] = [[] for _ in range(batch.num_rows)]
                known = batch.column(2).to_pylist()
                for part in Scanner()(column(batch, "text")):
                    for d in range(part.n):
                        sequence = part.hash[part.doc[d] : part.doc[d + 1]].view(np.int64).tolist()
                        gone = np.zeros(len(sequence) + 1, np.int64)
                        for s in known[part.row + d]:
                            gone[s["begin"]] += 1
                            gone[s["end"]] -= 1
                        for automaton in automata:
                            sizes = np.array(automaton.matching_statistics(sequence, len(sequence))[0], np.int64)
                            end = np.flatnonzero(sizes >= window)
                            np.add.at(gone, end + 1 - sizes[end], 1)
                            np.add.at(gone, end + 1, -1)
                        edge = np.diff(np.concatenate([[0], (np.cumsum(gone[:-1]) > 0).astype(np.int8), [0]]))
                        found[part.row + d] = [{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, spans)], ["doc_id", "text", "spans"])

        return run

    for block in range(blocks):
        own = parts.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(Shards([bytes(r[0]) for r in own.collect()]))  # one block
        before, out = out, out.mapInArrow(streamed(shared), schema)
        if block < blocks - 1:
            out = written(out, "known-spans")
            shared.destroy()
        if 0 < block < blocks - 1:
            discard(before)
    return out.select("doc_id", "spans")
