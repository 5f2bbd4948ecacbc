"""Chunks of a cube as rows: a block for each chunk that has a value.

    t_chunk, h_chunk, j_chunk, i_chunk   the chunk, with the place in a Z-order of (j, i)
    n_valid                              cells that have a value
    low, high                            the least and the greatest of these
    valid                                a bit for each cell of the chunk, in the order t, h, j, i
    data                                 the values of those cells: four planes of bytes

Values are 32-bit floats, or packed integers.  Planes put bytes together that differ
little, which the file's compression makes use of.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packing import chunk_ids

AXES = ("t", "h", "j", "i")
CHUNK = tuple(f"{a}_chunk" for a in AXES)
SCHEMA = "t_chunk long, h_chunk long, j_chunk long, i_chunk long, z long, n_valid long, low double, high double, valid binary, data binary"
_ARROW = pa.schema([*((c, pa.int64()) for c in (*CHUNK, "z", "n_valid")), ("low", pa.float64()), ("high", pa.float64()), ("valid", pa.binary()), ("data", pa.binary())])


def z_order(j: Column, i: Column, bits: int = 20) -> Column:
    """The bits of j and i in turn: places that are near in both are near in this order."""
    spread = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), 2 * b + k) for k, c in ((1, j.cast("long")), (0, i.cast("long"))) for b in range(bits)]
    out = spread[0]
    for x in spread[1:]:
        out = out.bitwiseOR(x)
    return out


def encoded(cells: DataFrame, shape: Mapping[str, int], integers: bool = False) -> DataFrame:
    """Blocks of rows (t, h, j, i, value); missing values have no cell.

    One shuffle brings a chunk's cells together, and a task holds one chunk at a time.
    Of rows that share a cell any one stands.
    """
    size = [int(shape[a]) for a in AXES]
    kind = np.int32 if integers else np.float32
    ids = chunk_ids(shape)
    cells = cells.filter("value IS NOT NULL").select(*AXES, F.col("value").cast("int" if integers else "float").alias("value")).withColumns(ids)
    cells = cells.withColumn("z", z_order(F.col("j_chunk"), F.col("i_chunk"))).repartition(*CHUNK)
    order = ["h_chunk", "z", "t_chunk", "j_chunk", "i_chunk"]

    def block(chunk: list[int], place: np.ndarray, value: np.ndarray, z: int) -> pa.RecordBatch:
        bits = np.zeros(int(np.prod(size)), bool)
        dense = np.zeros(len(bits), kind)
        bits[place], dense[place] = True, value
        own = dense[bits]
        planes = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 4).T).tobytes()
        known = own[~np.isnan(own)] if kind is np.float32 else own
        ends = (float(known.min()), float(known.max())) if len(known) else (None, None)
        row = [*chunk, z, len(own), *ends, np.packbits(bits).tobytes(), planes]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z, held = None, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(k).to_numpy() for k in range(4)]
            value, chunk, zs = b.column(4).to_numpy(), np.stack([b.column(k).to_numpy() for k in range(5, 9)]), b.column(9).to_numpy()
            place = np.zeros(b.num_rows, np.int64)
            for x, c, n in zip(at, chunk, size, strict=True):
                place = place * n + (x - c * n)
            cut = [0, *(np.flatnonzero((chunk[:, 1:] != chunk[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = chunk[:, lo].tolist()
                if own != now and held:
                    yield block(now, np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held]), z)
                    held = []
                now, z = own, int(zs[lo])
                held.append((place[lo:hi], value[lo:hi]))
        if held:
            yield block(now, np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held]), z)

    return cells.sortWithinPartitions(*order).select(*AXES, "value", *CHUNK, "z").mapInArrow(run, SCHEMA)


def decoded(blocks: DataFrame, shape: Mapping[str, int], integers: bool = False, extent: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Rows (t, h, j, i, value) of blocks.  With ``extent``, the first and last index of
    each axis, all cells within it come out, those without a value as nulls; a block may
    then lack its bits (a chunk that was never written)."""
    size = [int(shape[a]) for a in AXES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = int(np.prod(size))
                bits = np.unpackbits(np.frombuffer(row["valid"], np.uint8), count=n).astype(bool) if row["valid"] is not None else np.zeros(n, bool)
                values = np.zeros(n, np.int32 if integers else np.float32)
                if row["data"] is not None:
                    values[bits] = np.ascontiguousarray(np.frombuffer(row["data"], np.uint8).reshape(4, -1).T).view(values.dtype).reshape(-1)
                at = [x + row[c] * k for x, c, k in zip(np.unravel_index(np.arange(n), size), CHUNK, size, strict=True)]
                keep = bits
                if extent is not None:
                    keep = np.ones(n, bool)
                    for x, (lo, hi) in zip(at, extent, strict=True):
                        keep &= (x >= lo) & (x <= hi)
                out = [*(x[keep].astype(np.int32) for x in at), values[keep]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out[:4]), pa.array(out[4], mask=~bits[keep])], [*AXES, "value"])

    return blocks.select(*CHUNK, "valid", "data").mapInArrow(run, f"t int, h int, j int, i int, value {'int' if integers else 'float'}")


def within(blocks: DataFrame, shape: Mapping[str, int], box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Blocks that touch a box of indices (first and last of some axes), as literal
    bounds that reach the scan."""
    for axis, (lo, hi) in box.items():
        blocks = blocks.filter(F.col(f"{axis}_chunk").between(lo // shape[axis], hi // shape[axis]))
    return blocks


def every_chunk(blocks: DataFrame, shape: Mapping[str, int], extent: Sequence[tuple[int, int]]) -> DataFrame:
    """``blocks`` and a row without bits for each chunk of the extent that they lack.
    Chunks are counted through, so axes are never multiplied by joins."""
    first = [lo // shape[a] for a, (lo, _) in zip(AXES, extent, strict=True)]
    many = [hi // shape[a] - f + 1 for a, f, (_, hi) in zip(AXES, first, extent, strict=True)]
    rest, columns = F.col("id"), []
    for name, f, n in reversed([*zip(CHUNK, first, many, strict=True)]):
        columns.append((rest % n + f).alias(name))
        rest = F.floor(rest / n).cast("long")
    grid = blocks.sparkSession.range(int(np.prod(many))).select(*reversed(columns))
    return grid.join(blocks, [*CHUNK], "left")
