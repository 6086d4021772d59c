"""N-gram Jaccard self-join with a token-group matrix, giving the components of similar documents.

A document's tokens are its distinct shingles of some words. Documents with equal token sets form one class
and one of them stands for all. All tokens are put into one order, the rare ones first: their
frequencies are counted over all documents in a table of ``SLOTS`` hashed counters. If a set of n tokens has a
similarity of t or more with another, some token that both have is among the first n - ceil(tn) + 1 of its
order; the i-th of these (from 0) can be the first common one only with sets of at most
(n - i)(1 + t) / t - n tokens. Any order gives all links; in this one, texts that only
share frequent passages seldom meet. Documents that meet at a token within these sizes form a run. In runs of at
most ``SMALL`` documents, pairs are left out whose parity bitmaps (a bit for each slot that holds an odd
number of the set's tokens) differ in more bits than similar sets in tokens; larger runs stay together. The
connected components of what is left partition similar documents.

Within a component, blocks of documents are compared: documents of a block with close smallest hashes
make up groups of ``GROUP``, whose token unions form the columns of a token-group matrix. The overlap of
a document with a group's union bounds the overlap with each member; only groups that reach t of the
document's tokens are opened, and not if all members are connected to it already. Tasks return
edges that connect, at most one for each document and block, never all pairs.

A component of several blocks goes through them once with some ``REPRESENTATIVES`` of its documents in every
block, which connects what is similar to them. Then only documents outside the component's largest cluster
are compared with the other blocks. Large runs are reduced to their first document before the shuffle, and
to edges to it after it.

Defined results: null and empty texts and texts without words have no tokens and link with nothing; of
fewer words than a shingle's the whole sequence is the one token; rows with one doc_id count as one document;
rows without a doc_id get no component; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.columns import shielded
from splatlake.llm.storage import written
from splatlake.llm.words import Scanner, column, mix, sub_ranges
from splatlake.operators.components import connected_components

#: Of op7_ngram_jaccard_join; stages of a pipeline give their own.
SHINGLE = 3
PERCENT = 90
#: Documents and tokens of a block.
BLOCK = 1000
BLOCK_TOKENS = 400_000
GROUP = 32
REPRESENTATIVES = 32
#: Tokens that one task compares.
TASK_TOKENS = 1_000_000
#: Counters of token frequencies, in parts that are added up one by one, ``FAN`` tables at a time.
SLOTS, PARTS, FAN = 1 << 20, 32, 64
#: Tokens counted, or candidates reduced, at a time.
HELD = 400_000
SMALL = 64
#: Candidates of at most so many documents are broadcast to the texts; the texts of more are shuffled.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def token_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct token hashes of each text."""
    for part in Scanner(lower=True)(texts):
        grams = part.ngrams(k)
        for d in range(part.n):
            a, b = int(part.doc[d]), int(part.doc[d + 1])
            if b - a >= k:
                yield part.row + d, np.unique(grams[a : b - k + 1])
            elif b > a:
                h = _U(b - a)
                for w in part.hash[a:b]:
                    h = mix(np.array([h], _U) + w)[0]
                yield part.row + d, np.array([h], _U)
            else:
                yield part.row + d, np.zeros(0, _U)


def _mixed(tokens: np.ndarray) -> np.ndarray:
    """Hashes whose high bits are a token's slot among the counters."""
    return mix(tokens ^ _U(0x5851F42D4C957F2D))


def _slot(mixed: np.ndarray) -> np.ndarray:
    return (mixed >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens in the common order (as numbers in that order) and for each the largest size of a set that it may be the first in common with."""
    n = len(tokens)
    if percent >= 100 or n < -(-percent // (100 - percent)):  # only equal sets are similar
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keep = n - -(-percent * n // 100) + 1
    mixed = _mixed(tokens)
    order = levels[_slot(mixed)].astype(_U) << _U(56) | mixed >> _U(8)
    order = np.sort(np.partition(order, keep - 1)[:keep])
    return order, (n - np.arange(keep)) * (100 + percent) // percent - n


def bitmap(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of the counts of tokens in slots: some two and a half times as many as tokens in which similar sets can differ."""
    bits = 1 << max(6, (2 * len(tokens) * (100 - percent) // (100 + percent) * 12 // 5).bit_length())
    slots = np.bincount((mix(tokens ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(slots & 1, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """The bitmap over so many bytes, as a number."""
    value, n = int.from_bytes(bits, "little"), len(bits)
    while n > size:
        n //= 2
        value = value >> 8 * n ^ value & (1 << 8 * n) - 1
    return value


def _scan(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """doc_id, number of tokens, 128 bits and the bitmap of the token set of each row; at the end the task's counters in parts."""
    names = ["doc_id", "n", "f1", "f2", "bits", "part", "counts"]
    total, held, size = np.zeros(SLOTS, np.int64), [np.zeros(0, _U)], 0
    for batch in batches:
        ids, rows = batch.column(0), ([], [], [], [], [])
        for row, tokens in token_sets(column(batch, "text"), shingle):
            f1, f2 = (int(np.add.reduce(mix(tokens + _U(c)))) for c in (11, 23)) if len(tokens) else (0, 0)
            for to, value in zip(rows, (ids[row].as_py(), len(tokens), f1 - (f1 >> 63 << 64), f2 - (f2 >> 63 << 64), bitmap(tokens, percent)), strict=True):
                to.append(value)
            held.append(tokens)
            size += len(tokens)
            if size > HELD:
                total += np.bincount(_slot(_mixed(np.concatenate(held))), minlength=SLOTS)
                held, size = [np.zeros(0, _U)], 0
        n = len(rows[0])
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in rows[:4]], pa.array(rows[4], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    total += np.bincount(_slot(_mixed(np.concatenate(held))), minlength=SLOTS)
    if total.any():
        counts = [zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 4, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(counts, pa.binary())], names)


def _levels(counts: DataFrame) -> np.ndarray:
    """A byte for each slot that grows with the logarithm of its count; from rows (part, counts) of all tasks."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // PARTS, np.int64)
        for data in rows["counts"]:
            total += np.frombuffer(zlib.decompress(data.as_py()), np.int64)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["part", "counts"])

    left = counts.where("part = 0").count()
    while left > 1:
        left = -(-left // FAN)
        counts = counts.withColumn("team", F.pmod(F.xxhash64("counts"), F.lit(left))).groupBy("part", "team").applyInArrow(add, "part int, counts binary")
    out = np.zeros((PARTS, SLOTS // PARTS), np.uint8)
    for part, data in counts.collect():  # SLOTS counters, however large the input
        out[part] = np.minimum(255, 8 * np.log2(1 + np.frombuffer(zlib.decompress(data), np.int64)))
    return out.ravel()


def _runs(key: np.ndarray, size: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of (key, size): the first row of each run, and the largest ``upto`` of the key so far.

    A run ends with its key, or where the next size is larger than all before it may meet.
    """
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    team = np.cumsum(first) << 40
    most = np.maximum.accumulate(team + upto) - team
    first[1:] |= size[1:] > most[:-1]
    return np.flatnonzero(first), most


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of different numbers."""
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _candidates(levels, shingle: int = SHINGLE, percent: int = PERCENT):
    """Rows (key, size, upto, doc, leader, many): documents at a token; of large runs the first, for many, and edges of the others to it."""

    def reduced(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, size, upto, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, size, key))
        key, size, upto, doc = key[order], size[order], upto[order], doc[order]
        first, most = _runs(key, size, upto)
        ends = np.append(first[1:], len(key))
        large = np.repeat(ends - first > SMALL, ends - first)
        a, b = _distinct(doc[large], np.repeat(doc[first], ends - first)[large])
        many = np.zeros(len(key), bool)
        many[first] = large[first]
        upto[first] = np.where(large[first], most[ends - 1], upto[first])
        large[first] = False
        rows, none = [x[~large] for x in (key.view(np.int64), size, upto, doc)], np.zeros(len(a), np.int64)
        n = len(rows[0])
        leader = pa.array(np.concatenate([np.zeros(n, np.int64), b]), mask=np.arange(n + len(a)) < n)
        columns = [pa.array(np.concatenate(x)) for x in zip(rows, (mix(a.astype(_U)).view(np.int64), none, none, a), strict=True)] + [leader, pa.array(np.concatenate([many[~large], none > 0]))]
        for k in range(0, n + len(a), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(k, 100_000) for c in columns], ["key", "size", "upto", "doc", "leader", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0)
            for row, tokens in token_sets(column(batch, "text"), shingle):
                order, upto = prefix(tokens, levels.value, percent)
                if len(order):
                    found.append((order, np.full(len(order), len(tokens)), upto, np.full(len(order), ids[row].as_py(), np.int64)))
                    held += len(order)
                if held > HELD:
                    yield from reduced(found)
                    found, held = [], 0
        if found:
            yield from reduced(found)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (docs, a, b): the documents of each small run, or edges to the first of a large one; rows come sorted by (key, size, doc)."""
    held, far = [*[np.zeros(0, np.int64)] * 4, np.zeros(0, bool)], False  # rows of the run that the last batch ended in; far: it is large, and this is its first
    for batch in itertools.chain(batches, [None]):
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = held
        if batch is not None:
            edge = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5)]
            a.append(columns[3][edge])
            b.append(batch.column(4).fill_null(0).to_numpy()[edge])
            rows = [np.concatenate([x, y[~edge]]) for x, y in zip(held, columns, strict=True)]
        key, size, upto, doc, many = rows
        lists = np.zeros(0, bool)
        if len(key):
            first, most = _runs(key, size, upto)
            count = np.diff(np.append(first, len(key)))
            large = (count > SMALL) | np.logical_or.reduceat(many, first)
            large[0] |= far
            open_ = np.arange(len(first)) == len(first) - 1 if batch is not None else np.zeros(len(first), bool)
            own = np.repeat(large, count)
            a.append(doc[own])
            b.append(np.repeat(doc[first], count)[own])
            lists = ~large & ~open_ & (count > 1)
            far = bool(large[-1])
            k = first[-1]
            held = [x[k : k + 1] for x in (key, size, most, doc, many)] if far else [x[k:] for x in rows]
            if far:
                held[2] = most[-1:]
        pairs = _distinct(np.concatenate(a), np.concatenate(b))
        n, values = int(lists.sum()), np.zeros(0, np.int64)
        offsets = np.zeros(1, np.int64)
        if n:
            values, offsets = doc[sub_ranges(first[lists], count[lists])], np.concatenate([[0], np.cumsum(count[lists])])
        docs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        none = pa.nulls(len(pairs[0]), docs.type)
        ends = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x)]) for x in pairs]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([docs, none]), *ends], ["docs", "a", "b"])


def _may_be_similar(percent: int = PERCENT):
    """Edges between documents of a run (run, doc_id, n, bits) whose bitmaps allow for similarity; rows come sorted by run."""

    def pairs(group: list[tuple]) -> Iterator[tuple[int, int]]:
        least = min(len(x[2]) for x in group)
        bits = [folded(x[2], least) for x in group]
        for i in range(1, len(group)):
            for j in range(i):
                if (bits[i] ^ bits[j]).bit_count() * (100 + percent) <= (group[i][1] + group[j][1]) * (100 - percent):
                    yield group[i][0], group[j][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in itertools.chain(batches, [None]):
            found = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, None)]:
                if key != now:
                    found += pairs(group) if len(group) > 1 else ()
                    now, group = key, []
                group.append(row)
            both = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def _packed_sets(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """The rows, with a column of token sets in place of texts."""
    for batch in batches:
        place = batch.schema.get_field_index("text")
        others = [i for i in range(batch.num_columns) if i != place]
        rows, sets, size = [], [], 0

        def table(batch=batch, others=others) -> pa.RecordBatch:
            own = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*[batch.column(i).take(own) for i in others], pa.array(sets, pa.binary())], [*[batch.schema.names[i] for i in others], "tokens"])

        for row, tokens in token_sets(column(batch, "text"), shingle):
            rows.append(row)
            sets.append(tokens.tobytes())
            size += 8 * len(tokens)
            if size > 1 << 24:
                yield table()
                rows, sets, size = [], [], 0
        yield table()


class _Union:
    def __init__(self, known: np.ndarray):
        """Of things in known sets, by the name of each one's set."""
        _, first, own = np.unique(known, return_index=True, return_inverse=True)
        self.up = first[own]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while (self.up != (flat := self.up[self.up])).any():
            self.up = flat
        return self.up

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def connect(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect linked sets (only between sides 0 and 1, if both are there), by a token-group matrix.

    known: names of the clusters in which sets are connected already.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    two = len(np.unique(side)) > 1
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    # Similar sets mostly share their smallest hash and have about as many tokens.
    order = np.lexsort((sizes, [s[0] for s in sets]))
    groups = [g for v in (0, 1) for own in [order[side[order] == v]] for g in np.array_split(own, -(-len(own) // GROUP) or 1) if len(g)]
    n_tokens, union, edges = int(token.max()) + 1, _Union(np.arange(n) if known is None else known), []
    matrix = np.zeros((n_tokens, len(groups)), bool)
    for g, own in enumerate(groups):
        for d in own:
            matrix[token[at[d] : at[d + 1]], g] = True
    owner = np.repeat(np.arange(n), sizes)
    need = -(-percent * sizes // 100)
    step = max(1, 8_000_000 // max(1, len(groups)))
    overlap = np.zeros((n, len(groups)), np.int64)
    for a in range(0, len(token), step):
        rows, cells = owner[a : a + step], matrix[token[a : a + step]]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        overlap[rows[first]] += np.add.reduceat(cells, first, axis=0, dtype=np.int64)
    opened = overlap >= need[:, None]
    for g, own in enumerate(groups):
        roots = union.roots()
        asks = np.flatnonzero(opened[:, g])
        if two:
            asks = asks[(side[asks] == 0) & (side[own[0]] == 1)]
        if len(np.unique(roots[own])) == 1:
            asks = asks[roots[asks] != roots[own[0]]]
        asks = asks[(sizes[asks] * percent <= 100 * sizes[own].max()) & (sizes[asks] * 100 >= percent * sizes[own].min())]
        if not len(asks):
            continue
        members = np.zeros((n_tokens, len(own)), bool)
        for c, d in enumerate(own):
            members[token[at[d] : at[d + 1]], c] = True
        for part in np.array_split(asks, max(1, int(sizes[asks].sum()) * len(own) // 8_000_000)):
            if not len(part):
                continue
            cells = members[np.concatenate([token[at[d] : at[d + 1]] for d in part])]
            common = np.add.reduceat(cells, np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), axis=0, dtype=np.int64)
            both = sizes[part][:, None] + sizes[own][None, :]
            for q, c in np.argwhere((100 + percent) * common >= percent * both):
                if part[q] != own[c] and union.join(int(part[q]), int(own[c])):
                    edges.append((int(part[q]), int(own[c])))
    return edges


def _solve(rows: pa.Table, percent: int = PERCENT) -> pa.Table:
    """All (component, low, high) of a bin."""
    a, b = [], []
    rows = rows.sort_by([(c, "ascending") for c in ("component", "low", "high", "side", "doc_id")])
    if rows.num_rows:
        keys = np.column_stack([rows[c].to_numpy() for c in ("component", "low", "high")])
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])), len(keys))
        ids, side, known = (rows[c].to_numpy() for c in ("doc_id", "side", "known"))
        packed = rows["tokens"].to_pylist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = [k for k in range(i, j) if packed[k]]
            if len(some) > 1:
                sets = [np.frombuffer(packed[k], _U) for k in some]
                for x, y in connect(sets, side[some], percent, known[some]):
                    a.append(ids[some[x]])
                    b.append(ids[some[y]])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    """Edges of (doc_id, tokens, component, low, high, side, known): documents that are together in (component, low, high) are compared."""

    def solve(rows: pa.Table) -> pa.Table:
        return _solve(rows, percent)

    total = compared.agg(F.sum(F.octet_length("tokens"))).head()[0] or 0
    bins = max(1, total // (8 * TASK_TOKENS), int(compared.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    compared = compared.withColumn("bin", F.pmod(F.xxhash64("component", "low", "high"), F.lit(bins)))
    return compared.select("bin", "doc_id", "component", "low", "high", "side", "known", "tokens").groupBy("bin").applyInArrow(solve, "a long, b long")


def _from_others(packed: DataFrame, links: DataFrame, percent: int) -> DataFrame | None:
    """Edges between blocks that are not yet known; None if each component of several blocks is one cluster."""
    several = packed.where("blocks > 1").select("doc_id", "component", "blocks")
    clusters = several.join(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("own")), "doc_id", "left")
    clusters = written(clusters.withColumn("known", F.coalesce("own", "doc_id")).drop("own").distinct(), "clusters")
    largest = clusters.groupBy("component", "known").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    each = clusters.join(largest, "component").groupBy("component", "blocks").agg(F.count("*").alias("n"), F.count_if(F.expr("known <> main")).alias("rest"))
    counts = written(each.where("rest > 0").select("component", F.ceil(F.col("blocks") * F.col("rest") / F.col("n")).cast("int").alias("parts")), "clusters-left")
    if counts.isEmpty():
        return None
    clusters = clusters.join(counts, "component").join(largest, "component").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))
    sets = written(packed.select("doc_id", "tokens", "block").join(clusters, "doc_id"), "sets-left")
    left = sets.where("known <> main").withColumn("side", F.lit(0)).withColumn("high", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.col("part"))
    right = sets.withColumn("side", F.lit(1)).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("high", F.col("block"))
    names = ("doc_id", "tokens", "component", "low", "high", "side", "known")
    return _linked(left.select(*names).union(right.select(*names)), percent)


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links of ``percent`` or more) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan(batches, shingle, percent)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed_sets(batches, shingle)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = written(texts.mapInArrow(scan, "doc_id long, n long, f1 long, f2 long, bits binary, part int, counts binary"), "token-sets")
    levels = docs.sparkSession.sparkContext.broadcast(_levels(scanned.where("part IS NOT NULL").select("part", "counts")))  # SLOTS bytes
    scanned = scanned.where("part IS NULL").drop("part", "counts")
    full = scanned.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("first"))
    member = written(full.join(classes, ["n", "f1", "f2"]).select("doc_id", "first", "n"), "classes")
    copies = member.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # The texts are read again rather than their tokens kept, which would be the largest table here.
    rows = texts.where(F.col("doc_id").isNotNull()).mapInArrow(_candidates(levels, shingle, percent), "key long, size long, upto long, doc long, leader long, many boolean")
    rows = rows.repartition("key").sortWithinPartitions("key", "size", "doc")
    met = written(rows.mapInArrow(_meet, "docs array<long>, a long, b long").distinct(), "runs")
    runs = met.where("docs IS NOT NULL").select(F.xxhash64("docs").alias("run"), F.explode("docs").alias("doc_id"))
    runs = runs.join(full.select("doc_id", "n", "bits").distinct(), "doc_id").select("run", "doc_id", "n", "bits").repartition("run").sortWithinPartitions("run", "doc_id")
    candidates = met.where("docs IS NULL").select("a", "b").union(runs.mapInArrow(_may_be_similar(percent), "a long, b long")).distinct()
    for end in ("a", "b"):  # each class by its first document
        candidates = candidates.join(member.select(F.col("doc_id").alias(end), F.col("first").alias(f"{end}1")).distinct(), end)
    candidates = candidates.where("a1 <> b1").select(F.col("a1").alias("a"), F.col("b1").alias("b"))
    near = connected_components(candidates).select(F.col("node").alias("doc_id"), "component")
    near = written(near.join(member.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id"), "candidates")
    few = near.count() <= BROADCAST_ROWS
    sizes = near.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    near = near.join(sizes, "component").withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int"))
    near = near.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # About so many documents of each component of several blocks go to all of its blocks.
    everywhere = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.ceil(F.col("members") / REPRESENTATIVES)) == 0)
    near = near.select("doc_id", "component", "blocks", "block", everywhere.alias("everywhere"))
    packed = texts.join(F.broadcast(near) if few else near, "doc_id").mapInArrow(pack, "doc_id long, component long, blocks int, block int, everywhere boolean, tokens binary")
    packed = written(packed, "sets")
    to = F.explode(F.when(F.col("everywhere"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    once = packed.select("doc_id", "tokens", "component", to.alias("low")).withColumns({"high": F.col("low"), "side": F.lit(0), "known": F.col("doc_id")})
    links = written(_linked(once, percent), "links")
    more = _from_others(packed, links, percent) if not packed.where("blocks > 1").isEmpty() else None
    found = connected_components((links if more is None else links.union(more)).union(copies))
    return scanned.join(found, scanned["doc_id"] == found["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component of similar texts the rows' smallest doc_id stays (null ids come last), as one row.

    Rows are told apart by doc_id and text, so another text under the same doc_id is judged by itself; of rows
    that repeat in both, the smallest in the order of the other columns stays.
    """
    docs, restored, _ = shielded(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    keyed = docs.withColumn("_nd_key", F.xxhash64("doc_id", text, F.col("doc_id").isNull()))
    found = similar_documents(keyed.select(F.col("_nd_key").alias("doc_id"), "text"), shingle, percent)
    found = found.select(F.col("doc_id").alias("_nd_key"), "component_id").distinct()
    rows = keyed.groupBy("_nd_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("_nd_rows"))
    rows = written(rows.join(found, "_nd_key"), "similar-rows")
    best = rows.groupBy("component_id").agg(F.count("*").alias("members"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_nd_key")).alias("best"))
    best = best.where("members > 1").select("component_id", F.col("best._nd_key").alias("kept"))
    # Rows of the others go, and repeated ones meet by key, reduced in each task before the shuffle.
    marks = rows.join(best, "component_id", "left").select("_nd_key", "_nd_rows", F.coalesce(F.col("_nd_key") != F.col("kept"), F.lit(False)).alias("_nd_gone"))
    marks = written(marks.where("_nd_gone OR _nd_rows > 1"), "similar-marks")
    kept = keyed.join(marks, "_nd_key", "left").where("NOT coalesce(_nd_gone, false)")
    once = kept.where("_nd_rows IS NULL").select(*docs.columns)
    several = kept.where("_nd_rows > 1").groupBy("_nd_key").agg(F.min(F.struct(*docs.columns)).alias("_nd_row"))
    return restored(once.union(several.select("_nd_row.*")))
