"""Readers of splat files into tables: .splat, binary PLY, and SOG bundles and folders (lossless WebP or PNG textures)."""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splatlake.functions import expr as X
from splatlake.operators.sog import quat_unpack, signed_exp
from splatlake.sources.webp import WebpError, decode_webp

SCHEMA = "splat_id long, " + ", ".join(f"{c} double" for c in X.SCALARS) + ", f_rest array<double>"
ROW = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 3), ("a", "u1"), ("q", "u1", 4)])
# Scalar types of the PLY format.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
BATCH = 1 << 16
#: Rows of a part of a file.
PART_ROWS = 1 << 20


class SourceError(ValueError):
    pass


def _batch(first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(columns["x"])
    arrays = [pa.array(np.arange(first, first + n)), *[pa.array(np.asarray(columns[c], np.float64)) for c in X.SCALARS], pa.array([[]] * n, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, ["splat_id", *X.SCALARS, "f_rest"])


def _unit(q: np.ndarray) -> np.ndarray:
    n = np.sqrt((q**2).sum(1))
    good = np.isfinite(n) & (n > 0)
    return np.where(good[:, None], q / np.where(good, n, 1)[:, None], np.array([1.0, 0, 0, 0]))


def splat_count(size: int) -> int:
    """Rows of a .splat file of so many bytes."""
    if not size:
        raise SourceError("the .splat file is empty")
    if size % ROW.itemsize:
        raise SourceError(f"the .splat file's length {size} is not divisible by {ROW.itemsize}")
    return size // ROW.itemsize


def splat_batches(data: bytes, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of a .splat file, or of a part of it that begins at row ``first``: linear scales and bytes become logarithms, harmonics and logits."""
    count = splat_count(len(data))
    for k in range(0, count, BATCH):
        r = np.frombuffer(data, ROW, min(BATCH, count - k), k * ROW.itemsize)
        s = r["s"].astype(np.float64)
        if not (s > 0).all():
            raise SourceError("a scale is not positive")
        a = np.clip(r["a"] / 255.0, 1e-6, 1 - 1e-6)
        q = _unit(r["q"] / 255.0 * 2 - 1)
        dc = (r["c"] / 255.0 - 0.5) / X.SH_C0
        cols = {c: r["p"][:, i] for i, c in enumerate("xyz")} | {f"scale_{i}": np.log(s[:, i]) for i in range(3)} | {"opacity": np.log(a / (1 - a))} | {f"f_dc_{i}": dc[:, i] for i in range(3)} | {f"rot_{i}": q[:, i] for i in range(4)}
        yield _batch(first + k, cols)


def ply_header(data: bytes) -> tuple[int, np.dtype, int]:
    """Vertex count, row layout and offset of the rows."""
    end = data.find(b"end_header\n", 0, 1 << 20)
    skip = 11
    if end < 0:
        end, skip = data.find(b"end_header\r\n", 0, 1 << 20), 12
    if end < 0:
        raise SourceError("missing end_header")
    lines = data[:end].decode("ascii", "replace").splitlines()
    if not any(x.split()[:2] == ["format", "binary_little_endian"] for x in lines):
        raise SourceError("only binary_little_endian PLY is read")
    count, names, inside = None, [], False
    for words in map(str.split, lines):
        if words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            if words[1] not in PLY_TYPES:
                raise SourceError(f"unknown property type {words[1]}")
            names.append((words[2], PLY_TYPES[words[1]]))
    if count is None:
        raise SourceError("missing vertex element")
    if not names:
        raise SourceError("the vertex element has no properties")
    return count, np.dtype(names), end + skip


def _ply_rows(data: bytes, row: np.dtype, first: int) -> Iterator[pa.RecordBatch]:
    """Whole rows of the body of a PLY file, from row ``first`` on."""
    for k in range(0, len(data) // row.itemsize, BATCH):
        r = np.frombuffer(data, row, min(BATCH, len(data) // row.itemsize - k), k * row.itemsize)
        q = _unit(np.stack([r[f"rot_{i}"].astype(np.float64) for i in range(4)], 1))
        yield _batch(first + k, {c: r[c] for c in X.SCALARS if not c.startswith("rot_")} | {f"rot_{i}": q[:, i] for i in range(4)})


def ply_layout(head: bytes, size: int) -> tuple[int, np.dtype, int]:
    """As ``ply_header``, of a file of so many bytes that holds all rows and columns."""
    count, row, at = ply_header(head)
    if missing := [c for c in X.SCALARS if c not in row.names]:
        raise SourceError(f"missing column {missing[0]}")
    if size < at + count * row.itemsize:
        raise SourceError("the PLY file is cut off")
    return count, row, at


def ply_batches(data: bytes) -> Iterator[pa.RecordBatch]:
    count, row, at = ply_layout(data, len(data))
    yield from _ply_rows(data[at : at + count * row.itemsize], row, 0)


def ply_metadata(path: str) -> tuple[int, int]:
    """Vertex count and row size, from the header alone."""
    with open(path, "rb") as f:
        count, row, _ = ply_header(f.read(1 << 20))
    return count, row.itemsize


def _binary(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from decode(content.as_py())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def _local(path: str) -> str | None:
    """The path of a single file that driver and tasks can open and seek in; None for others, which Spark reads whole."""
    plain = path.removeprefix("file://")
    return plain if "://" not in plain and os.path.isfile(plain) else None


def _by_parts(spark: SparkSession, path: str, count: int, row: int, at: int, decode) -> DataFrame:
    """Rows of fixed size after byte ``at``, a range of them for each task. decode: bytes and first row to batches."""
    starts = spark.range(0, count, PART_ROWS, numPartitions=max(1, -(-count // PART_ROWS)))

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    f.seek(at + first * row)
                    yield from decode(f.read(min(PART_ROWS, count - first) * row), first)

    return starts.mapInArrow(run, SCHEMA)


def read_splat(spark: SparkSession, path: str) -> DataFrame:
    """Ranges of rows are read side by side where tasks can open the file; in other stores a file is one task's."""
    if plain := _local(path):
        return _by_parts(spark, plain, splat_count(os.path.getsize(plain)), ROW.itemsize, 0, splat_batches)
    return _binary(spark, path, splat_batches)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_splat``; the driver reads the header."""
    if plain := _local(path):
        with open(plain, "rb") as f:
            count, row, at = ply_layout(f.read(1 << 20), os.path.getsize(plain))
        return _by_parts(spark, plain, count, row.itemsize, at, lambda data, first: _ply_rows(data, row, first))
    return _binary(spark, path, ply_batches)


def decode_png(data: bytes) -> np.ndarray:
    """8-bit RGBA or RGB pixels (height, width, 4)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise SourceError("textures must be lossless WebP or PNG")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    width, height, depth, color, _, _, interlace = head
    if depth != 8 or color not in (2, 6) or interlace:
        raise SourceError("textures must be 8-bit RGB or RGBA without interlace")
    n = 4 if color == 6 else 3
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        filt, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width * n, np.int64)
        if filt == 0:
            out[y] = line
        elif filt == 2:
            out[y] = (line + up) & 255
        elif filt == 1:
            out[y] = (np.cumsum(line.reshape(-1, n), 0) & 255).ravel()
        else:
            row = np.zeros(width * n, np.int64)
            for i in range(width * n):
                left, corner = (row[i - n], up[i - n]) if i >= n else (0, 0)
                if filt == 3:
                    guess = (left + up[i]) // 2
                else:
                    p = left + up[i] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner))[2]
                row[i] = (line[i] + guess) & 255
            out[y] = row
    out = out.reshape(height, width, n)
    return out if n == 4 else np.concatenate([out, np.full((height, width, 1), 255, np.uint8)], 2)


def decode_texture(data: bytes) -> np.ndarray:
    """RGBA pixels of a texture: lossless WebP, as the format has it, or PNG."""
    if data[:4] != b"RIFF":
        return decode_png(data)
    try:
        return decode_webp(data)
    except WebpError as e:
        raise SourceError(f"texture: {e}") from e


def _decoded(spark: SparkSession, textures: dict[str, bytes]) -> dict[str, np.ndarray]:
    """All textures, a task each."""
    sc = spark.sparkContext

    def decode(item: tuple[str, bytes]) -> tuple[str, np.ndarray | str]:
        try:
            return item[0], decode_texture(item[1])
        except SourceError as e:
            return item[0], str(e)

    found = dict(sc.parallelize(list(textures.items()), max(1, len(textures))).map(decode).collect())
    for v in found.values():
        if isinstance(v, str):
            raise SourceError(v)
    return found


def _sog_files(content: bytes | None, folder: str | None):
    if content is not None:
        z = zipfile.ZipFile(io.BytesIO(content))
        names = set(z.namelist())
        return lambda n: z.read(n) if n in names else None

    def read(name: str) -> bytes | None:
        p = os.path.join(folder, name)
        return open(p, "rb").read() if os.path.exists(p) else None

    return read


def _within(key: str, codes: np.ndarray, codebook: list) -> None:
    if codes.size and codes.max() >= len(codebook):
        raise SourceError(f"{key}: code {codes.max()} is beyond the {len(codebook)} entries of the codebook")


def read_sog(spark: SparkSession, path: str) -> DataFrame:
    """A SOG bundle (ZIP) or the folder of a meta.json; textures are decoded by a task each, values by expressions."""
    bundle = not path.endswith("meta.json")
    files = _sog_files(bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]) if bundle else None, None if bundle else os.path.dirname(path))
    need = lambda n: files(n) if files(n) is not None else (_ for _ in ()).throw(SourceError(f"missing file {n}"))
    meta = json.loads(need("meta.json"))
    v2 = "version" in meta
    if v2 and meta["version"] != 2:
        raise SourceError("SOG version must be 2")
    count = meta["count"] if v2 else meta["means"]["shape"][0]
    texture = {}
    shn = meta.get("shN")
    image = _decoded(spark, {name: need(name) for part in ("means", "scales", "quats", "sh0", *(["shN"] if shn else [])) for name in meta[part]["files"]})
    for key in ("means", "scales", "quats", "sh0"):
        for i, name in enumerate(meta[key]["files"]):
            t = image[name].reshape(-1, 4)
            if len(t) < count:
                raise SourceError(f"texture {name} has under {count} texels")
            texture[f"{key}{i}"] = t[:count].astype(np.int32)
    if v2:
        for key in ("scales", "sh0"):
            _within(key, texture[f"{key}0"][:, :3], meta[key]["codebook"])
    lo, hi = texture["means0"], texture["means1"]
    columns = {"splat_id": np.arange(count)} | {f"m{c}": lo[:, i] | hi[:, i] << 8 for i, c in enumerate("xyz")} | {f"s{i}": texture["scales0"][:, i] for i in range(3)} | {f"q{i}": texture["quats0"][:, i] for i in range(4)} | {f"h{i}": texture["sh00"][:, i] for i in range(4)}
    if shn:
        labels = image[shn["files"][1]].reshape(-1, 4)[:count].astype(np.int32)
        columns["label"] = labels[:, 0] | labels[:, 1] << 8
    raw = spark.createDataFrame(pa.table({k: np.asarray(v, np.int64 if k == "splat_id" else np.int32) for k, v in columns.items()}))
    span = lambda low, high: (high - low) or 1.0
    mean = {c: signed_exp(F.col(f"m{c}") / 65535 * span(meta["means"]["mins"][i], meta["means"]["maxs"][i]) + meta["means"]["mins"][i]) for i, c in enumerate("xyz")}
    if v2:
        book = lambda key: F.array(*[F.lit(float(v)) for v in meta[key]["codebook"]])
        scale = [F.element_at(book("scales"), F.col(f"s{i}") + 1) for i in range(3)]
        dc = [F.element_at(book("sh0"), F.col(f"h{i}") + 1) for i in range(3)]
        a = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("h3") / 255))
        opacity = X.logit(a)
    else:
        lerp = lambda c, key, i: F.col(c) / 255 * (meta[key]["maxs"][i] - meta[key]["mins"][i]) + meta[key]["mins"][i]
        scale, dc, opacity = [lerp(f"s{i}", "scales", i) for i in range(3)], [lerp(f"h{i}", "sh0", i) for i in range(3)], lerp("h3", "sh0", 3)
    q = quat_unpack([F.col(f"q{i}") for i in range(3)], F.col("q3"))
    out = raw.select("splat_id", *[v.alias(c) for c, v in mean.items()], *[v.alias(f"scale_{i}") for i, v in enumerate(scale)], opacity.alias("opacity"), *[v.alias(f"f_dc_{i}") for i, v in enumerate(dc)], *[v.alias(f"rot_{i}") for i, v in enumerate(q)], *(["label"] if shn else []))
    if not shn:
        return out.withColumn("f_rest", F.array().cast("array<double>"))
    pixels = image[shn["files"][0]]
    coeffs = {1: 3, 2: 8, 3: 15}[shn["bands"]] if "bands" in shn else {192: 3, 512: 8, 960: 15}[pixels.shape[1]]
    if v2:
        _within("shN", pixels[..., :3], shn["codebook"])
    values = np.array(shn["codebook"]) if v2 else np.arange(256) / 255 * (shn["maxs"] - shn["mins"]) + shn["mins"]
    rows = []
    for label in range(pixels.shape[0] * 64):
        block = pixels[label // 64, label % 64 * coeffs : (label % 64 + 1) * coeffs, :3]
        rows.append((label, [float(v) for v in values[block.T.reshape(-1)]]))
    table = spark.createDataFrame(rows, "label int, f_rest array<double>")  # at most 65 536 centroids, the format's limit
    return out.join(table, "label", "left").withColumn("f_rest", F.coalesce("f_rest", F.array_repeat(F.lit(0.0), 3 * coeffs))).drop("label")


def read_source(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Table and format of a source, by its name."""
    name = path.rsplit("/", 1)[-1].lower()
    kind = name.rsplit(".", 1)[-1]
    if kind == "splat":
        return read_splat(spark, path), kind
    if kind == "ply":
        return read_ply(spark, path), kind
    if kind == "sog" or name == "meta.json":
        return read_sog(spark, path), "sog"
    raise SourceError(f"unsupported format {kind}")


def source_metadata(path: str) -> dict:
    """Count and size of a local .splat or .ply without reading its rows."""
    size, kind = os.path.getsize(path), path.rsplit(".", 1)[-1].lower()
    if kind == "splat":
        return {"path": path, "bytes": size, "format": kind, "splatCount": size // ROW.itemsize}
    if kind == "ply":
        return {"path": path, "bytes": size, "format": kind, "splatCount": ply_metadata(path)[0]}
    raise SourceError(f"unsupported format {kind}")
