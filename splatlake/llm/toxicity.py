"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's features are its words and the byte n-grams of its lower-cased words with a mark at either
end, hashed into buckets with an embedding each; misspelled or inflected words that were never seen
share n-gram vectors with those that were. A segment of ``SEGMENT`` words is the average of its
features' embeddings, put through a linear softmax over two classes; embeddings and softmax are
trained together. A text is as toxic as its most toxic segment, so a few insults in a long text are
not averaged away; training starts with the segments whose features are likeliest in toxic texts (by counts of texts) and goes on with those that the
model finds most toxic.

Labels are learned from a bounded sample of rows, ``SAMPLE`` documents a class, taken by a hash; of these, whole texts of any
length. In each round tasks score all segments of the sample and hand the most toxic few of each text to the driver, which
trains on them; so the driver holds some segments a text, never the texts. Scoring covers whole texts in the
tasks that read them, without a shuffle. Texts beyond ``SLICE_BYTES`` are worked on in slices, in which segments begin anew.

The bias is set where texts that a model hasn't learned from are judged best: one of ``FOLDS`` parts of the sample is left out in turn, until
``JUDGED`` toxic texts have been judged or all parts have been.

Defined results: null ids are neither learned nor held out; a null or empty text, or one without words, has no feature and scores the softmax of
its bias; repeated rows score alike; of several labels of a document the majority counts (ties: not
toxic), null labels do not; if there are no labels of both kinds, every score is the share of toxic
labels (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatlake.llm.storage import written
from splatlake.llm.words import NOT_ALNUM, Scanner, column, mix, ranges_of, sub_ranges

SAMPLE = 2000
#: Parts of the sample for the bias, and toxic texts that are enough to set it.
FOLDS, JUDGED = 5, 20
#: Bytes of a sample that the driver works on itself, with the same results as tasks.
LOCAL_BYTES = 2 << 20
SEGMENT = 6
BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (3, 4, 5)
#: Text scored at once; its features take some two hundred times as many bytes.
SLICE_BYTES = 1 << 17
#: Texts worked on at once, and tasks that learn.
TEXTS, SPREAD = 40, 24
_U = np.uint64


@dataclass
class Features:
    """Features of texts: bucket of each, and the feature offsets of words, the word offsets of texts."""

    bucket: np.ndarray
    word: np.ndarray
    doc: np.ndarray

    def segments(self, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
        """Feature offsets of segments of ``size`` words (the last of a text may have fewer), segment offsets of texts."""
        words = np.diff(self.doc)
        counts = -(-words // size)
        at = np.concatenate([[0], np.cumsum(counts)])
        first = np.repeat(self.doc[:-1], counts) + (np.arange(at[-1]) - np.repeat(at[:-1], counts)) * size
        return np.append(self.word[first], len(self.bucket)), at


_SCAN = Scanner(NOT_ALNUM, lower=True)
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[list(NOT_ALNUM)] = 0x20


def features(texts: list[str]) -> Features:
    data = bytearray(b" ")
    at = [1]
    for text in texts:
        data += text.lower().encode("utf-8", "replace") + b" "
        at.append(len(data))
    raw = np.frombuffer(bytes(data), np.uint8)
    words = _SCAN.words(0, raw, np.array([0, *at[1:]]))
    n = len(raw)
    byte, apart = _FOLD[raw], (_FOLD[raw] == 0x20)
    gaps = np.concatenate([[0], np.cumsum(apart)])
    buckets, places = [words.hash % _U(BUCKETS)], [words.start]
    value = byte.copy()
    for k in range(2, max(NGRAMS) + 1):
        if n < k:
            break
        value = value[: n - k + 1] * _U(257) + byte[k - 1 :]
        if k in NGRAMS:
            # Marks of a word's ends may stand at either end of an n-gram, not inside.
            own = np.flatnonzero((gaps[k - 1 : n] - gaps[1 : n - k + 2] == 0) & ~(apart[: n - k + 1] & apart[k - 1 :]))
            buckets.append(mix(value[own] + _U(k << 56)) % _U(BUCKETS))
            places.append(own)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    bucket = np.concatenate(buckets)[order].astype(np.int32)
    # An n-gram with a leading mark begins one byte before its word.
    word = np.searchsorted(place[order], np.append(words.start - 1, n))
    return Features(bucket, word, words.doc)


@dataclass
class ToxicityModel:
    """Embeddings and softmax; ``weight`` is each bucket's share of the score, which is all that scoring needs."""

    weight: np.ndarray
    bias: float

    def logits(self, f: Features, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
        """Score of each segment; segment offsets of texts."""
        edges, at = f.segments(size)
        total = np.concatenate([[0], np.cumsum(self.weight[f.bucket], dtype=np.float64)])
        return (total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, np.diff(edges)) + self.bias, at

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        for owner, part in units(texts):
            logit, at = self.logits(features(part))
            some = np.flatnonzero(np.diff(at))
            if len(some):
                np.maximum.at(out, owner[some], np.maximum.reduceat(logit, at[some]))
        return 1 / (1 + np.exp(-np.clip(np.where(out > -np.inf, out, self.bias), -60, 60)))


def units(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts, long ones in slices cut at blanks, as many as have some ``SLICE_BYTES`` together; and the number of each one's text."""
    owner, part, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + SLICE_BYTES
            if end < len(text):
                blank = text.rfind(" ", at + 1, end)
                end = blank if blank > 0 else end
            owner.append(k)
            part.append(text[at:end])
            size += end - at
            at = end
            if size >= SLICE_BYTES or len(part) >= TEXTS:
                yield np.array(owner), part
                owner, part, size = [], [], 0
    if part:
        yield np.array(owner), part


def bucket_counts(texts: list[str], toxic: list[int]) -> np.ndarray:
    """For each bucket the number of clean texts and of toxic ones that have it."""
    counts = np.zeros((2, BUCKETS), np.int64)
    open_, own = -1, np.zeros(0, np.int64)
    for owner, part in units(texts):
        f = features(part)
        text = np.repeat(owner, np.diff(f.word[f.doc]) if len(f.word) else 0)
        for k in np.unique(owner).tolist():
            seen = np.unique(f.bucket[text == k]) if len(text) == len(f.bucket) else np.zeros(0, np.int64)
            if k == open_:
                seen = np.setdiff1d(seen, own)
                own = np.union1d(own, seen)
            else:
                open_, own = k, seen
            counts[toxic[k], seen] += 1
    return counts


def log_odds(counts: np.ndarray) -> np.ndarray:
    """How much likelier a bucket is in a toxic text than in a clean one; a needle in long texts stands out, what all texts have does not."""
    share = (counts + 0.5) / (counts.max(1, keepdims=True) + 1)
    return np.where(counts.sum(0) > 1, np.log(share[1] / share[0]), 0.0)


def chosen_segments(texts: list[str], toxic: list[int], weight: np.ndarray, turn: int) -> list[tuple[int, np.ndarray]]:
    """(number of the text, buckets) of the segments to train on next: of a toxic text the most toxic one (at first some), of a clean one the three likeliest mistakes."""
    best: dict[int, list[tuple[float, np.ndarray]]] = {}
    model = ToxicityModel(weight, 0.0)
    for owner, part in units(texts):
        f = features(part)
        logit, at = model.logits(f)
        edges, _ = f.segments()
        for k, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if first == last:
                continue
            own = logit[first:last]
            text = int(owner[k])
            most = (4 if turn == 0 else 1) if toxic[text] else 3
            top = np.argsort(-own, kind="stable")[:most]
            rows = best.setdefault(text, [])
            rows += [(float(own[j]), f.bucket[edges[first + j] : edges[first + j + 1]]) for j in top.tolist()]
            rows.sort(key=lambda r: -r[0])
            del rows[most:]
    return [(text, bucket) for text in sorted(best) for _, bucket in best[text]]


@dataclass
class LocalSample:
    """Texts at hand, with the parts of the sample that they are in."""

    texts: list[str]
    toxic: list[int]
    fold: list[int]

    def counts(self) -> np.ndarray:
        """``bucket_counts`` of each fold."""
        out = np.zeros((FOLDS, 2, BUCKETS), np.int64)
        for fold in set(self.fold):
            rows = [k for k, f in enumerate(self.fold) if f == fold]
            out[fold] = bucket_counts([self.texts[k] for k in rows], [self.toxic[k] for k in rows])
        return out

    def chosen(self, weight: np.ndarray, turn: int, fold: int | None) -> list[tuple[int, np.ndarray]]:
        rows = [k for k in range(len(self.texts)) if self.fold[k] != fold]
        labels = [self.toxic[k] for k in rows]
        found = chosen_segments([self.texts[k] for k in rows], labels, weight.astype(np.float32), turn)
        return sorted(((labels[k], bucket) for k, bucket in found), key=lambda r: (r[0], r[1].tobytes()))

    def judged(self, model: ToxicityModel, fold: int) -> list[tuple[int, float]]:
        rows = [k for k in range(len(self.texts)) if self.fold[k] == fold]
        return list(zip([self.toxic[k] for k in rows], model.scores([self.texts[k] for k in rows]).tolist(), strict=True))


class SharedSample:
    """A written table (toxic, fold, text) that tasks read in each round."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _each(self, work, schema: str) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = work(LocalSample([t or "" for t in batch.column(2).to_pylist()], batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, fields, strict=True)], [f.name for f in fields])

        fields = {"counts": [pa.field("counts", pa.binary())], "chosen": [pa.field("toxic", pa.int32()), pa.field("bucket", pa.binary())], "judged": [pa.field("toxic", pa.int32()), pa.field("p", pa.float64())]}[schema]
        kinds = {pa.binary(): "binary", pa.int32(): "int", pa.float64(): "double"}
        return self.rows.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in fields)).collect()

    def counts(self) -> np.ndarray:
        total = np.zeros((FOLDS, 2, BUCKETS), np.int64)
        for r in self._each(lambda s: ([zlib.compress(s.counts().astype("<i4").tobytes(), 1)],), "counts"):
            total += np.frombuffer(zlib.decompress(bytes(r[0])), "<i4").reshape(total.shape)
        return total

    def chosen(self, weight: np.ndarray, turn: int, fold: int | None) -> list[tuple[int, np.ndarray]]:
        shared = self.rows.sparkSession.sparkContext.broadcast(weight)  # of fixed size
        found = self._each(lambda s: tuple(zip(*[(y, b.astype("<i4").tobytes()) for y, b in s.chosen(shared.value, turn, fold)], strict=True)) or ((), ()), "chosen")
        return sorted(((r[0], np.frombuffer(bytes(r[1]), "<i4")) for r in found), key=lambda r: (r[0], r[1].tobytes()))

    def judged(self, model: ToxicityModel, fold: int) -> list[tuple[int, float]]:
        shared = self.rows.sparkSession.sparkContext.broadcast(model)  # of fixed size
        found = self._each(lambda s: tuple(zip(*s.judged(shared.value, fold), strict=True)) or ((), ()), "judged")
        return [(r[0], r[1]) for r in found]


def train(texts: list[str], toxic: list[int], clean_weight: float = 1.0) -> ToxicityModel:
    """Fit on texts at hand."""
    return trained(LocalSample(texts, [int(v) for v in toxic], [k % FOLDS for k in range(len(texts))]), sum(toxic), len(texts), clean_weight)


def trained(sample: LocalSample | SharedSample, toxic: int, total: int, clean_weight: float = 1.0) -> ToxicityModel:
    """Fit, and move the bias to where texts that were left out are judged best.

    ``clean_weight``: how many clean texts of the corpus stand behind one of the sample, for each toxic one.
    """
    if not 0 < toxic < total:
        share = float(np.clip(toxic / total if total else 0, 1e-9, 1 - 1e-9))
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    counts = sample.counts()
    rows: list[tuple[int, float]] = []
    for fold in range(FOLDS):
        model = _fit(sample, counts, fold)
        rows += sample.judged(model, fold)
        if sum(y for y, _ in rows) >= JUDGED:
            break
    else:
        model = _fit(sample, counts, None)
    y, p = np.array([r[0] for r in rows]), np.clip([r[1] for r in rows], 1e-12, 1 - 1e-12)
    if not 0 < y.sum() < len(y):
        return model
    logit = np.log(p / (1 - p))
    order = np.argsort(-logit, kind="stable")
    cost = np.concatenate([[0], np.cumsum(np.where(y[order] > 0, -1.0, clean_weight))])
    low = np.flatnonzero(cost <= cost.min() + 1e-9)
    cut = low[len(low) // 2]
    edge = np.concatenate([[logit[order[0]] + 1], logit[order], [logit[order[-1]] - 1]])
    model.bias -= float((edge[cut] + edge[cut + 1]) / 2)
    return model


def _fit(sample: LocalSample | SharedSample, counts: np.ndarray, fold: int | None, seed: int = 7, rounds: int = 4, epochs: int = 6) -> ToxicityModel:
    """Fit embeddings and softmax together by AdaGrad on mini-batches of segments; the part ``fold`` is left out."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.01, (BUCKETS, DIMENSIONS))
    direction, bias = rng.normal(0, 0.3, DIMENSIONS), 0.0
    seen_e, seen_d, seen_b = np.full(BUCKETS, 1e-4), np.full(DIMENSIONS, 1e-4), 1e-4
    most = 1e-4
    # Buckets that only one text has tell texts apart, not kinds of text: they stay out.
    own = counts.sum(0) - (counts[fold] if fold is not None else 0)
    known = own.sum(0) > 1
    embedding[~known] = 0
    for turn in range(rounds):
        found = sample.chosen(embedding @ direction if turn else log_odds(own), turn, fold)
        if not found:
            break
        y = np.array([t for t, _ in found], np.float64)
        edges = np.concatenate([[0], np.cumsum([len(b) for _, b in found])])
        bucket_of = np.concatenate([b for _, b in found])
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(found)), max(min(40, len(found)), len(found) // 256)):
                size = edges[batch + 1] - edges[batch]
                bucket = bucket_of[sub_ranges(edges[batch], size)]
                row = np.repeat(np.arange(len(batch)), size)
                used, place = np.unique(bucket, return_inverse=True)
                here = embedding[used]
                mean = np.stack([np.bincount(row, here[place, d], len(batch)) for d in range(DIMENSIONS)], 1) / np.maximum(1, size)[:, None]
                p = 1 / (1 + np.exp(-np.clip(mean @ direction + bias, -60, 60)))
                g = p - y[batch]
                share = np.bincount(place, (g / np.maximum(1, size))[row], len(used)) * known[used]
                grad_e = share[:, None] * direction
                grad_d, grad_b = g @ mean, g.sum()
                seen_e[used] += (grad_e**2).sum(1) / DIMENSIONS
                most = max(most, float(seen_e[used].max(initial=0)))
                seen_d += grad_d**2
                seen_b += grad_b**2
                # Rare buckets learn in proportion, not at full speed as each rate of its own would let them.
                embedding[used] = here - 0.5 * grad_e / (np.sqrt(seen_e[used]) + 0.1 * np.sqrt(most))[:, None]
                direction -= 0.1 * grad_d / np.sqrt(seen_d)
                bias -= 0.1 * grad_b / np.sqrt(seen_b)
    return ToxicityModel((embedding @ direction).astype(np.float32), float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from labelled documents that are not held out: a bounded sample in the order of a hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.when(F.avg("toxic") > 0.5, 1).otherwise(0).alias("toxic")), "labels")
    counts = dict(known.groupBy("toxic").count().collect())
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 x sample rows of two numbers

    texts = docs.select("doc_id", F.col("text").cast("string")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    # Dealt out evenly: at most SPREAD tasks, of which each hands a bounded summary to the driver.
    rows = texts.select(F.col("toxic").cast("int"), (F.crc32(F.reverse(F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int").alias("fold"), "text")
    rows = written(rows.repartition(SPREAD), "sample")
    sizes = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    n = {r["toxic"]: r["n"] for r in sizes}
    weight = counts.get(0, 0) / max(1, n.get(0, 0)) / max(1, counts.get(1, 0) / max(1, n.get(1, 0)))
    sample = SharedSample(rows)
    if sum(r["bytes"] or 0 for r in sizes) <= LOCAL_BYTES:
        sample = LocalSample(*zip(*[(r["text"] or "", r["toxic"], r["fold"]) for r in rows.collect()], strict=True)) if n else LocalSample([], [], [])
    return trained(sample, n.get(1, 0), sum(n.values()), weight)


def score(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """All columns of the documents, with one (in place of any of that name) between 0 and 1."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            out = [shared.value.scores(texts.slice(a, b - a).to_pylist()) for a, b in ranges_of(texts, SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double")
