"""Reading OSM PBF files: Spark reads the bytes, one task a file cuts it into its blocks, and the blocks are dealt to all
tasks, which decompress and decode them. A source writes what was decoded once and reads that for every kind of element."""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CAR, VehicleProfile
from ..core import materialize
from ..model import GeoGraph
from .osm import to_geo_graph

KIND = "kind string, id long, lat double, lon double, node_ids array<long>, members array<struct<type:int,ref:long,role:string>>, tags map<string,string>"
COLUMNS = ["kind", "id", "lat", "lon", "node_ids", "members", "tags"]


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        if x < 128:
            return out, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = b[i : i + n], i + n
        yield key >> 3, v


def _packed(b: bytes, signed: bool = False, delta: bool = False) -> list[int]:
    """All numbers of a packed field at once."""
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return []
    last = x < 128
    start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    of = np.cumsum(last) - last
    v = np.bitwise_or.reduceat((x & 127).astype(np.uint64) << (7 * (np.arange(len(x)) - start[of])).astype(np.uint64), start)
    out = v.astype(np.int64)
    if signed:
        out = (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
    return (np.cumsum(out) if delta else out).tolist()


def blobs(data: bytes) -> Iterator[bytes]:
    """The data blocks of a file, as they are stored."""
    i = 0
    while i + 4 <= len(data):
        (n,) = struct.unpack(">I", data[i : i + 4])
        head = dict(_fields(data[i + 4 : i + 4 + n]))
        i += 4 + n
        if head[1] == b"OSMData":
            yield data[i : i + head[3]]
        i += head[3]


def unpacked(blob: bytes) -> bytes:
    """A block's content; raw, zlib, LZMA or, where the library for it is there, Zstandard."""
    f = dict(_fields(blob))
    if 1 in f:
        return f[1]
    if 3 in f:
        return zlib.decompress(f[3])
    if 4 in f:
        return lzma.decompress(f[4])
    if 7 in f:
        try:
            import zstandard
        except ImportError as e:
            raise ValueError("a block is compressed with Zstandard, which needs the zstandard package") from e
        return zstandard.ZstdDecompressor().decompress(f[7], max_output_size=f.get(2, 0))
    raise ValueError("a block has a compression that is not supported")


def decoded(block: bytes) -> Iterator[tuple]:
    """Rows of ``COLUMNS``; unset numbers have the format's defaults."""
    parts: dict[int, list] = {}
    for k, v in _fields(block):
        parts.setdefault(k, []).append(v)
    text = [v.decode() for k, v in _fields(parts[1][0]) if k == 1]
    unit, lat0, lon0 = parts.get(17, [100])[0], parts.get(19, [0])[0], parts.get(20, [0])[0]
    tags = lambda f: {text[k]: text[v] for k, v in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")))}
    for group in parts.get(2, []):
        for kind, body in _fields(group):
            f = dict(_fields(body))
            if kind == 1:
                zig = lambda v: (v >> 1) ^ -(v & 1)
                yield "node", zig(f[1]), (lat0 + unit * zig(f[8])) * 1e-9, (lon0 + unit * zig(f[9])) * 1e-9, None, None, tags(f)
            elif kind == 2:
                kv, own = _packed(f.get(10, b"")), []
                while kv:
                    end = kv.index(0)
                    own.append({text[kv[j]]: text[kv[j + 1]] for j in range(0, end, 2)})
                    kv = kv[end + 1 :]
                ids, lats, lons = (_packed(f.get(k, b""), True, True) for k in (1, 8, 9))
                for n, (i, la, lo) in enumerate(zip(ids, lats, lons)):
                    yield "node", i, (lat0 + unit * la) * 1e-9, (lon0 + unit * lo) * 1e-9, None, None, own[n] if n < len(own) else {}
            elif kind == 3:
                yield "way", f[1], None, None, _packed(f.get(8, b""), True, True), None, tags(f)
            elif kind == 4:
                who = zip(_packed(f.get(10, b"")), _packed(f.get(9, b""), True, True), _packed(f.get(8, b"")))
                yield "relation", f[1], None, None, None, [{"type": t, "ref": r, "role": text[s]} for t, r, s in who], tags(f)


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """All elements of the files at ``path``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                for k, blob in enumerate(blobs(bytes(data))):
                    yield pd.DataFrame({"k": [k], "blob": [blob]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["blob"]:
                yield pd.DataFrame(list(decoded(unpacked(bytes(blob)))), columns=COLUMNS)

    stored = spark.read.format("binaryFile").load(path).select("content").mapInPandas(cut, "k long, blob binary")
    return stored.repartition(F.xxhash64("k", "blob")).select("blob").mapInPandas(rows, KIND)


class PbfSource:
    """A graph source over PBF files."""

    def __init__(self, spark: SparkSession, path: str, profile: VehicleProfile = CAR):
        self.spark, self.path, self.profile = spark, path, profile

    def load_graph(self) -> GeoGraph:
        e = materialize(read_pbf(self.spark, self.path))
        nodes = e.filter("kind = 'node'").select("id", "lat", "lon", "tags")
        ways = e.filter("kind = 'way'").select("id", "node_ids", "tags")
        return to_geo_graph(ways, nodes, e.filter("kind = 'relation'").select("id", "members", "tags"), self.profile)[0]
