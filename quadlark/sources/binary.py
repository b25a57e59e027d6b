"""Binary tile indices and reference maps, read and written as rows.

Files are read by Spark (binaryFile), so any file system will do; each file is decoded where it is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..ship import ship

#: Marks at the beginning of files, and of the trees in them (fixed values).
INDEX_MAGIC, TREE_MAGIC, TREE_MAGIC_1, MASK_MAGIC, MAP_MAGIC = b"TI", b"qt", b"QT", b"QMASK", b"TM"
#: Node types in two bits of a flag byte, the mark of black-and-white trees, and the inner node of the first version (fixed values).
INNER, BYTE, WORD, DWORD, BLACK, WHITE, TWO_VALUED, INNER_1 = 0, 1, 2, 3, 1, 2, 0x80, 0xFF

Quad = tuple[int, int, int, int]  # depth, x, y, value


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> int:
        (v,) = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return v

    def skip(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


def _order_of(size: int) -> int:
    return max(0, size.bit_length() - 1)


def read_tree(r: Reader) -> tuple[int, list[Quad]]:
    """(order, uniform quads with a value) of one tree: the current format, the first one, or a plain raster mask."""
    mark = r.skip(2)
    if mark == TREE_MAGIC:
        if (version := r.take("H")) != 2:
            raise ValueError(f"unknown tree version {version}")
        order, flags = r.take("B"), r.take("B")
        return order, list(_walk(r, flags & 3, bool(flags & TWO_VALUED)))
    if mark == TREE_MAGIC_1:
        order = r.take("B")
        return order, list(_walk_plain(r, lambda b: None if b == INNER_1 else b))
    if mark + r.skip(3) == MASK_MAGIC:
        r.skip(3)
        r.take("i"), r.take("i")
        order = _order_of(r.take("i"))
        r.take("I")
        return order, list(_walk_plain(r, lambda b: {0: 1, 1: 0}.get(b)))
    raise ValueError("not a tree")


def _walk(r: Reader, kind: int, two: bool) -> Iterator[Quad]:
    """Depth first; an inner node's byte holds its children's types, two bits each, lowest first."""
    todo = [(0, 0, 0, kind)]
    while todo:
        depth, x, y, kind = todo.pop()
        if kind == INNER:
            flags = r.take("B")
            todo += [(depth + 1, 2 * x + (i & 1), 2 * y + (i >> 1), flags >> 2 * i & 3) for i in (3, 2, 1, 0)]
            continue
        value = int(kind != BLACK) if two else r.take({BYTE: "B", WORD: "H", DWORD: "I"}[kind])
        if value:
            yield depth, x, y, value


def _walk_plain(r: Reader, value_of) -> Iterator[Quad]:
    todo = [(0, 0, 0)]
    while todo:
        depth, x, y = todo.pop()
        value = value_of(r.take("B"))
        if value is None:
            todo += [(depth + 1, 2 * x + (i & 1), 2 * y + (i >> 1)) for i in (3, 2, 1, 0)]
        elif value:
            yield depth, x, y, value


def write_tree(order: int, cells: dict[tuple[int, int], int]) -> bytes:
    """One tree of single cells; equal neighbours join to larger quads."""
    levels = [{k: v for k, v in cells.items() if v}]
    for _ in range(order):  # None: an inner node
        up: dict = {}
        for (x, y), _v in levels[-1].items():
            key = (x >> 1, y >> 1)
            if key not in up:
                kids = [levels[-1].get((2 * key[0] + (i & 1), 2 * key[1] + (i >> 1)), 0) for i in range(4)]
                up[key] = kids[0] if kids[0] is not None and len(set(kids)) == 1 else None
        levels.append(up)
    kind = lambda v: INNER if v is None else BYTE if v < 1 << 8 else WORD if v < 1 << 16 else DWORD
    leaf = lambda v: struct.pack({BYTE: "<B", WORD: "<H", DWORD: "<I"}[kind(v)], v)
    root = levels[-1].get((0, 0), 0)
    out = [TREE_MAGIC, struct.pack("<HBB", 2, order, kind(root))]
    todo = [(order, 0, 0, root)]
    while todo:
        level, x, y, value = todo.pop()
        if value is not None:
            out.append(leaf(value))
            continue
        kids = [(2 * x + (i & 1), 2 * y + (i >> 1)) for i in range(4)]
        values = [levels[level - 1].get(k, 0) for k in kids]
        out.append(bytes([sum(kind(v) << 2 * i for i, v in enumerate(values))]))
        todo += [(level - 1, *k, v) for k, v in zip(kids[::-1], values[::-1])]
    return b"".join(out)


def read_index(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(lod, qlod, qx, qy, flags) of a whole index file."""
    r = Reader(data)
    if r.skip(2) != INDEX_MAGIC:
        raise ValueError("not a tile index")
    low, n = r.take("B"), r.take("B")
    out = []
    for lod in range(low, low + n):
        order, quads = read_tree(r)
        out += [(lod, lod - order + depth, x, y, v) for depth, x, y, v in quads]
    return out


def tile_indices(spark: SparkSession, path: str) -> DataFrame:
    """Index files as quad rows (file, lod, qlod, qx, qy, flags)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = read_index(content.as_py())
                columns = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), *map(pa.array, columns[2:])], ["file", "lod", "qlod", "qx", "qy", "flags"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, lod int, qlod int, qx bigint, qy bigint, flags bigint")


def index_files(tiles: DataFrame) -> DataFrame:
    """Tiles (tileset, lod, x, y, flags) to (tileset, content): one index file each. A level's tree is made in one task; a file then joins them."""

    def tree(t: pa.Table) -> pa.Table:
        lod = t.column("lod")[0].as_py()
        cells = {(x, y): f for x, y, f in zip(*(t.column(c).to_pylist() for c in ("x", "y", "flags")))}
        return pa.table({"tileset": t.column("tileset")[:1], "lod": t.column("lod")[:1], "tree": pa.array([write_tree(lod, cells)], pa.binary())})

    ship(tiles.sparkSession)
    trees = tiles.groupBy("tileset", "lod").applyInArrow(tree, "tileset string, lod int, tree binary")

    def join(t: pa.Table) -> pa.Table:
        found = dict(zip(t.column("lod").to_pylist(), t.column("tree").to_pylist()))
        low, high = min(found), max(found)
        body = b"".join(found.get(lod) or write_tree(lod, {}) for lod in range(low, high + 1))
        return pa.table({"tileset": t.column("tileset")[:1], "content": pa.array([INDEX_MAGIC + bytes([low, high - low + 1]) + body], pa.binary())})

    return trees.groupBy("tileset").applyInArrow(join, "tileset string, content binary")


def read_map(data: bytes, reference: str = "H") -> list[list[int]]:
    """A list of reference lists."""
    r = Reader(data)
    if r.skip(2) != MAP_MAGIC:
        raise ValueError("not a reference map")
    return [[r.take(reference) for _ in range(r.take("B"))] for _ in range(r.take("H"))]


def write_map(lists: list[list[int]], reference: str = "H") -> bytes:
    return MAP_MAGIC + struct.pack("<H", len(lists)) + b"".join(struct.pack(f"<B{len(x)}{reference}", len(x), *x) for x in lists)


def read_maps(files: DataFrame) -> DataFrame:
    """(path, content) to (path, maps array<array<int>>)."""

    @F.pandas_udf("array<array<int>>")
    def decode(content):
        import pandas as pd

        return pd.Series([read_map(bytes(c)) for c in content])

    ship(files.sparkSession)
    return files.select("path", decode("content").alias("maps"))
