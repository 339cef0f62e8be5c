"""Jobs on frame tables with pixels: (video_id, frame_id, height, width, channels, pixels, ...). Pixels are never shuffled.

Frames whose pixels are null keep null pixels and get no boxes; boxes with a null coordinate are passed over.

Set spark.sql.execution.arrow.maxRecordsPerBatch to a few dozen for large frames; batches are also limited to spark.sql.execution.arrow.maxBytesPerBatch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framejobs.operators.pixels import AT_ONCE, cells_over, decode_cells, ensure_rgb, redact_frame, resize_bytes, to_network_input

BOXES = "array<struct<det_idx: int, x1: double, y1: double, x2: double, y2: double, score: double, landmarks: array<double>>>"

BOX = pa.struct([("det_idx", pa.int32()), *((c, pa.float64()) for c in ("x1", "y1", "x2", "y2", "score")), ("landmarks", pa.list_(pa.float64()))])

#: Bytes of frames that wait in a task for others of their shape.
HELD_BYTES = 256 << 20


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.height, row.width, row.channels)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column one after the other, and where each row begins and the last one ends; a null has none."""
    wide = column.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=len(wide) + 1, offset=8 * wide.offset) if len(wide) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def binary_column(data: np.ndarray, ends: np.ndarray, kind: pa.DataType, null: np.ndarray | None = None) -> pa.Array:
    """The other way round."""
    valid = None if null is None or not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little"))
    out = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [valid, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)), pa.py_buffer(data)])
    return out.cast(kind)


def rgb_frames(frames: DataFrame) -> DataFrame:
    """Frames with three channels."""

    def run(batches):
        for b in batches:
            b["pixels"] = [None if r.pixels is None else ensure_rgb(array_of(r)).tobytes() for r in b.itertuples(index=False)]
            b["channels"] = 3
            yield b.astype({"channels": "int32"})

    return frames.mapInPandas(run, frames.schema)


def redact_frames(frames: DataFrame, mode: str = "blur", **options) -> DataFrame:
    """Frames with the boxes of their array column ``boxes`` covered, in the order of det_idx."""
    if mode == "none":
        return frames

    def run(batches):
        for b in batches:
            lists, pixels = b.column("boxes"), b.column("pixels")
            flat = lists.flatten()
            corners = np.stack([flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], axis=1)
            row, index = pc.list_parent_indices(lists).to_numpy(), flat.field("det_idx")
            order = np.lexsort((index.fill_null(0).to_numpy(zero_copy_only=False), index.is_null().to_numpy(zero_copy_only=False), row))
            gone = np.isnan(corners).any(axis=1) | flat.is_null().to_numpy(zero_copy_only=False) | pixels.is_null().to_numpy(zero_copy_only=False)[row]
            order = order[~gone[order]]
            if len(order):
                data, at = flat_bytes(pixels)
                data = data.copy()
                found, first = np.unique(row[order], return_index=True)
                shapes = zip(*(b.column(c).take(pa.array(found)).to_pylist() for c in ("height", "width", "channels")), strict=True)
                for k, shape, own in zip(found.tolist(), shapes, np.split(order, first[1:]), strict=True):
                    frame = data[at[k] : at[k + 1]].reshape(shape)
                    frame[:] = redact_frame(frame, corners[own].tolist(), mode, **options)
                pixels = binary_column(data, at, pixels.type, pixels.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pixels if n == "pixels" else c for n, c in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return frames.mapInArrow(run, frames.schema)


#: Images are frames too.
redact_images = redact_frames


def resize_frames(frames: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Frames in another size: one for all, or that of the columns out_width and out_height."""
    sized = frames if width is None else frames.withColumns({"out_width": F.lit(width), "out_height": F.lit(height)})

    def run(batches):
        for b in batches:
            b["pixels"] = [None if r.pixels is None else resize_bytes(array_of(r), r.out_width, r.out_height).tobytes() for r in b.itertuples(index=False)]
            b["width"], b["height"] = b["out_width"], b["out_height"]
            yield b.drop(columns=["out_width", "out_height"])

    schema = frames.drop("out_width", "out_height").schema
    return sized.mapInPandas(run, schema)


def score_frames(frames: DataFrame, model_fn, batch: int = 8, threshold: float = 0.2, limit: float = 0.3, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Adds ``boxes``: scored, decoded, suppressed, and back in source pixels, within the row. ``model_fn()`` is called once a task and returns a
    function from a float32 (batch, 3, y, x) to heat (b, 1, h, w), scale (b, 2, h, w), offset (b, 2, h, w) and landmarks (b, 10, h, w).

    Frames of one shape wait for each other over the whole task, whatever batches they arrive in, so that the model is called with full batches, and
    once more for what is left of a shape at the end. Only where frames of very many shapes wait, with more than ``held_bytes`` of pixels, the shape that
    has waited longest goes early. Rows come out as they are scored, not in their order.
    """

    def run(batches):
        model = model_fn()
        waiting: dict[tuple, pa.RecordBatch] = {}  # rows by shape; the shape that has waited longest comes first
        bytes_of = lambda rows: pc.sum(pc.binary_length(rows.column("pixels"))).as_py() or 0

        def with_boxes(rows: pa.RecordBatch, ends: np.ndarray, boxes: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), boxes)], names=[*rows.schema.names, "boxes"])

        def scored(rows: pa.RecordBatch, h: int, w: int) -> pa.RecordBatch:
            nw, nh = -(-w // 32) * 32, -(-h // 32) * 32
            data, at = flat_bytes(rows.column("pixels"))
            shown = [data[s:e].reshape(h, w, c) for s, e, c in zip(at[:-1], at[1:], rows.column("channels").to_pylist(), strict=True)]
            step, cells = max(batch, AT_ONCE // (3 * nw * nh) // batch * batch), []
            for s in range(0, len(shown), step):
                x = to_network_input(shown[s : s + step], nw, nh)
                for k in range(0, len(x), batch):
                    got = cells_over(*model(x[k : k + batch]), threshold)
                    if len(got[0]):
                        cells.append((got[0] + s + k, *got[1:]))
            if not cells:
                return with_boxes(rows, np.zeros(rows.num_rows + 1, dtype=np.int32), pa.array([], BOX))
            k, det_idx, corners, score, points = decode_cells(tuple(map(np.concatenate, zip(*cells, strict=True))), (nh, nw), limit)
            by = np.array([nw / w, nh / h])
            corners, points = corners / np.tile(by, 2), points / np.tile(by, 5)
            marks = pa.ListArray.from_arrays(pa.array(np.arange(0, points.size + 1, 10), pa.int32()), pa.array(points.ravel()))
            boxes = pa.StructArray.from_arrays([pa.array(det_idx, pa.int32()), *(pa.array(c) for c in corners.T), pa.array(score), marks], fields=list(BOX))
            return with_boxes(rows, np.searchsorted(k, np.arange(rows.num_rows + 1)), boxes)

        for b in batches:
            sizes = [b.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("height", "width")]
            blank = b.column("pixels").is_null().to_numpy(zero_copy_only=False) | (sizes[0] < 0) | (sizes[1] < 0)
            if blank.any():
                rows = b.filter(pa.array(blank))
                yield with_boxes(rows, np.zeros(rows.num_rows + 1, dtype=np.int32), pa.array([], BOX))
            for shape in np.unique(np.stack(sizes, axis=1)[~blank], axis=0).tolist():
                rows = b.filter(pa.array(~blank & (sizes[0] == shape[0]) & (sizes[1] == shape[1])))
                before = waiting.pop(tuple(shape), None)
                rows = rows if before is None else pa.Table.from_batches([before, rows]).combine_chunks().to_batches()[0]
                full = rows.num_rows - rows.num_rows % batch
                if full:
                    yield scored(rows.slice(0, full), *shape)
                if full < rows.num_rows:
                    waiting[tuple(shape)] = rows.take(pa.array(np.arange(full, rows.num_rows)))  # a slice would keep all
            held = sum(map(bytes_of, waiting.values()))
            while held > held_bytes:
                shape = next(iter(waiting))
                rows = waiting.pop(shape)
                held -= bytes_of(rows)
                yield scored(rows, *shape)
        for shape, rows in waiting.items():
            yield scored(rows, *shape)

    fields = [f for f in frames.schema.fields if f.name != "boxes"]
    schema = T.StructType(fields + T.StructType.fromDDL(f"boxes {BOXES}").fields)
    return frames.drop("boxes").mapInArrow(run, schema)
