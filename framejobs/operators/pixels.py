"""Small NumPy helpers on one frame at a time."""

from __future__ import annotations

import numpy as np


def ensure_rgb(a: np.ndarray) -> np.ndarray:
    """Three channels: one is repeated, a fourth is dropped."""
    if a.ndim == 2:
        a = a[:, :, None]
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]


def resize_planes(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear over the last two axes (y, x), pixel centres aligned, as float."""
    h, w = a.shape[-2:]
    f = np.ascontiguousarray(a, dtype=np.float64)
    if (h, w) == (height, width):
        return f
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)

    def between(f: np.ndarray, first: np.ndarray, second: np.ndarray, share: np.ndarray, axis: int) -> np.ndarray:
        out, other = np.take(f, first, axis=axis), np.take(f, second, axis=axis)
        out *= 1 - share
        other *= share
        out += other
        return out

    return between(between(f, x0, x1, x - x0, -1), y0, y1, (y - y0)[:, None], -2)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """One frame (y, x, channel), see resize_planes."""
    return resize_planes(a.transpose(2, 0, 1), width, height).transpose(1, 2, 0)


def resize_bytes(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.clip(np.rint(resize(a, width, height)), 0, 255).astype(np.uint8)


#: Values of the model's input that are resized at once; larger frames come one by one.
AT_ONCE = 1 << 17


def to_network_input(frames: list[np.ndarray], net_width: int, net_height: int) -> np.ndarray:
    """Frames of one shape as (batch, channel, y, x), float32; a single channel is resized once."""
    out = np.empty((len(frames), 3, net_height, net_width), dtype=np.float32)
    frames = [f[:, :, None] if f.ndim == 2 else f[:, :, :3] for f in frames]
    depths = np.array([f.shape[2] for f in frames])
    step = max(1, AT_ONCE // (3 * net_width * net_height))
    for depth in set(depths.tolist()):
        at = np.nonzero(depths == depth)[0]
        for s in range(0, len(at), step):
            some = at[s : s + step]
            out[some] = resize_planes(np.stack([frames[k] for k in some]).transpose(0, 3, 1, 2), net_width, net_height)
    return out


def box_blur(a: np.ndarray, kw: int, kh: int) -> np.ndarray:
    """Mean of kw x kh pixels around each; borders mirrored without their edge; the work does not grow with the kernel."""
    ax, ay = kw // 2, kh // 2
    p = np.pad(a.astype(np.int64), ((ay, kh - 1 - ay), (ax, kw - 1 - ax), (0, 0)), mode="reflect")
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1, p.shape[2]), dtype=np.int64)
    s[1:, 1:] = p.cumsum(0).cumsum(1)
    total = s[kh:, kw:] - s[:-kh, kw:] - s[kh:, :-kw] + s[:-kh, :-kw]
    return np.rint(total / (kw * kh)).astype(np.uint8)


def ellipse_mask(h: int, w: int) -> np.ndarray:
    cy, cx = h // 2, w // 2
    y, x = np.ogrid[:h, :w]
    return ((y - cy) / cy) ** 2 + ((x - cx) / cx) ** 2 < 1


def grow_clip(box, width: int, height: int, mask_scale: float) -> tuple[int, int, int, int]:
    """The numpy twin of functions.boxes.grow_clip_box."""
    x1, y1, x2, y2 = (int(v) for v in box)
    s = mask_scale - 1.0
    w, h = x2 - x1, y2 - y1
    r = lambda v: int(np.rint(v))
    return max(0, r(x1 - w * s)), max(0, r(y1 - h * s)), min(width - 1, r(x2 + w * s)), min(height - 1, r(y2 + h * s))


def redact_frame(frame: np.ndarray, boxes, mode: str = "blur", ellipse: bool = True, mask_scale: float = 1.3, color=(0, 0, 0), image: np.ndarray | None = None, mosaic_size: int = 20) -> np.ndarray:
    """A copy of the frame with all boxes covered, one after the other. Boxes that have no pixels after clipping change nothing."""
    out = frame.copy()
    for box in boxes:
        x1, y1, x2, y2 = grow_clip(box, frame.shape[1], frame.shape[0], mask_scale)
        if x2 < x1 or y2 < y1 or mode == "none":
            continue
        w, h = x2 - x1, y2 - y1
        if mode == "solid":
            out[y1 : y2 + 1, x1 : x2 + 1] = (*color, 0)[: out.shape[2]]  # a fourth channel is cleared
        elif mode == "mosaic":
            ys, xs = (np.arange(a, min(b, a + -(-(b - a) // mosaic_size) * mosaic_size - 1) + 1) for a, b in ((y1, y2), (x1, x2)))
            if w and h:
                from_y, from_x = (a + (v - a) // mosaic_size * mosaic_size for v, a in ((ys, y1), (xs, x1)))
                out[ys[:, None], xs[None, :]] = out[from_y[:, None], from_x[None, :]]
        elif mode == "blur":
            if w // 2 and h // 2:
                blurred = box_blur(out[y1:y2, x1:x2], w // 2, h // 2)
                if ellipse:
                    mask = ellipse_mask(h, w)
                    out[y1:y2, x1:x2][mask] = blurred[mask]
                else:
                    out[y1:y2, x1:x2] = blurred
        elif mode == "img":
            if w and h:
                r = resize_bytes(image, w, h).astype(np.float64)
                part = out[y1:y2, x1:x2, :3]
                if image.shape[2] == 4:
                    alpha = r[:, :, 3:] / 255
                    part[:] = (part * (1 - alpha) + r[:, :, : part.shape[2]] * alpha).astype(np.uint8)
                else:
                    part[:] = r[:, :, : part.shape[2]].astype(np.uint8)
        else:
            raise ValueError(f"unknown mode {mode}")
    return out


def cells_over(heat: np.ndarray, scale: np.ndarray, offset: np.ndarray, marks: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """The cells over the threshold of one call of a model, frame by frame and row by row: frame, y, x, heat, and its (2,), (2,) and (10,) values."""
    k, cy, cx = np.nonzero(heat[:, 0] > threshold)
    return k, cy, cx, heat[k, 0, cy, cx], scale[k, :, cy, cx], offset[k, :, cy, cx], marks[k, :, cy, cx]


def decode_cells(cells: tuple[np.ndarray, ...], size: tuple[int, int], limit: float = 0.3, stride: int = 4) -> tuple[np.ndarray, ...]:
    """Boxes of cells_over in network pixels (size: height, width), without the suppressed ones: frame, det_idx, (4,) corners, score, (10,) landmarks."""
    k, cy, cx, heat, scale, offset, marks = cells
    h, w = (np.exp(scale[:, i].astype(np.float64)) * stride for i in (0, 1))
    x1 = np.clip((cx + offset[:, 1] + 0.5) * stride - w / 2, 0, size[1])
    y1 = np.clip((cy + offset[:, 0] + 0.5) * stride - h / 2, 0, size[0])
    corners = np.stack((x1, y1, np.minimum(x1 + w, size[1]), np.minimum(y1 + h, size[0])), axis=1).astype(np.float64)
    score = heat.astype(np.float64)
    det_idx = np.arange(len(k)) - np.searchsorted(k, k)
    order = np.lexsort((-det_idx, -score, k))
    kept = np.sort(order[suppress_groups(corners[order], k[order], limit)])
    lm = marks.astype(np.float64)
    points = np.stack([v for j in range(5) for v in (lm[:, 2 * j + 1] * w + x1, lm[:, 2 * j] * h + y1)], axis=1)
    return k[kept], det_idx[kept], corners[kept], score[kept], points[kept]


def decode_and_suppress(heat: np.ndarray, scale: np.ndarray, offset: np.ndarray, marks: np.ndarray, size: tuple[int, int], threshold: float = 0.2, limit: float = 0.3, stride: int = 4) -> list[dict]:
    """Boxes of one frame from its four model outputs, (y, x), (2, y, x), (2, y, x) and (10, y, x), in network pixels (size: height, width)."""
    cells = cells_over(heat[None, None], scale[None], offset[None], marks[None], threshold)
    return [
        {"det_idx": int(k), **dict(zip(("x1", "y1", "x2", "y2"), c, strict=True)), "score": v, "landmarks": p}
        for k, c, v, p in zip(*(x.tolist() for x in decode_cells(cells, size, limit, stride)[1:]), strict=True)
    ]


def suppress(boxes: np.ndarray, score: np.ndarray, limit: float) -> list[int]:
    """The numpy twin of operators.detections.nms; indexes of the kept boxes in their order."""
    left = np.lexsort((-np.arange(len(score)), -score))
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    kept = []
    while len(left):
        k, left = left[0], left[1:]
        kept.append(int(k))
        w = np.maximum(0, np.minimum(boxes[k, 2], boxes[left, 2]) - np.maximum(boxes[k, 0], boxes[left, 0]))
        h = np.maximum(0, np.minimum(boxes[k, 3], boxes[left, 3]) - np.maximum(boxes[k, 1], boxes[left, 1]))
        union = area[k] + area[left] - w * h
        left = left[~((union > 0) & (w * h >= limit * union))]
    return sorted(kept)


def suppress_in_order(boxes: np.ndarray, limit: float) -> list[int]:
    """Indexes of the kept ones of (n, 4) boxes that are sorted from the best down.

    Kept boxes lie in grids by size: boxes that overlap by ``limit`` differ in width and height by a factor of 1 / limit at most, so a box looks only at
    the grids of such sizes, and there at the cells it touches; a grid's cells are as large as its largest boxes, so a box lies in four at most.
    """
    x1, y1, x2, y2 = boxes.T
    w, h = x2 - x1, y2 - y1
    area = w * h
    proper = (w > 0) & (h > 0) & np.isfinite(boxes).all(axis=1)
    size = np.full((len(boxes), 2), 0, dtype=np.int64)
    size[proper] = np.ceil(np.log2(np.stack((w, h), axis=1)[proper])).astype(np.int64)
    reach = int(np.ceil(np.log2(1 / min(limit, 1.0)))) + 1
    grids: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = {}

    def cells(k: int, sx: int, sy: int):
        cw, ch = 2.0**sx, 2.0**sy
        for cx in range(int(np.floor(x1[k] / cw)), int(np.floor(x2[k] / cw)) + 1):
            for cy in range(int(np.floor(y1[k] / ch)), int(np.floor(y2[k] / ch)) + 1):
                yield cx, cy

    kept = []
    for k in range(len(boxes)):
        if proper[k]:  # other boxes overlap nothing
            sx, sy = size[k].tolist()
            near = [i for (gx, gy), grid in grids.items() if abs(gx - sx) <= reach and abs(gy - sy) <= reach for c in cells(k, gx, gy) for i in grid.get(c, ())]
            if near:
                i = np.array(near)
                shared = np.maximum(0, np.minimum(x2[k], x2[i]) - np.maximum(x1[k], x1[i])) * np.maximum(0, np.minimum(y2[k], y2[i]) - np.maximum(y1[k], y1[i]))
                union = area[k] + area[i] - shared
                if ((union > 0) & (shared >= limit * union)).any():
                    continue
            grid = grids.setdefault((sx, sy), {})
            for c in cells(k, sx, sy):
                grid.setdefault(c, []).append(k)
        kept.append(k)
    return kept


#: Pairs of boxes, side by side in x, that are compared at once; a frame with more of them than CROWD is looked up in grids.
PAIRS, CROWD = 1 << 19, 1 << 21


def suppress_groups(boxes: np.ndarray, group: np.ndarray, limit: float, pairs: int = PAIRS, crowd: int = CROWD) -> np.ndarray:
    """Which of (n, 4) boxes are kept, those of a group being together and sorted from the best down; boxes of different groups never meet.

    Boxes are sorted by their left edge, each is compared with those that begin before it ends, and the pairs that overlap by ``limit`` are gone through
    by their worse box: it goes if the better one is still there. Pairs are made for whole groups, about ``pairs`` at a time.
    """
    keep = np.ones(len(boxes), dtype=bool)
    if not len(boxes):
        return keep
    group = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
    if limit <= 0:
        for at in np.split(np.arange(len(boxes)), np.nonzero(np.diff(group))[0] + 1):
            keep[at] = False
            keep[at[suppress(boxes[at], -np.arange(len(at)), limit)]] = True
        return keep
    x1, y1, x2, y2 = np.ascontiguousarray(boxes.T, dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        area = (x2 - x1) * (y2 - y1)
        at = np.nonzero((x2 > x1) & (y2 > y1) & np.isfinite(boxes).all(axis=1))[0]  # other boxes overlap nothing
    at = at[np.lexsort((x1[at], group[at]))]
    edges = np.unique(x1[at])
    first = group[at] * (len(edges) + 1)
    begin = first + np.searchsorted(edges, x1[at])
    n_right = np.searchsorted(begin, first + np.searchsorted(edges, x2[at])) - np.arange(len(at)) - 1
    of_group = np.bincount(group[at], weights=n_right, minlength=int(group[-1]) + 1)
    for g in np.nonzero(of_group > crowd)[0]:
        some = np.arange(*np.searchsorted(group, (g, g + 1)))
        keep[some] = False
        keep[some[suppress_in_order(boxes[some], limit)]] = True
    n_right[(of_group > crowd)[group[at]]] = 0
    portion = (np.cumsum(np.where(of_group > crowd, 0, of_group)) // pairs)[group[at]]
    cuts = [0, *(np.nonzero(np.diff(portion))[0] + 1).tolist(), len(at)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n = n_right[lo:hi]
        left = np.repeat(np.arange(lo, hi), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + left + 1
        i, j = at[left], at[right]
        near = (y1[i] < y2[j]) & (y1[j] < y2[i])
        i, j = i[near], j[near]
        with np.errstate(invalid="ignore", over="ignore"):
            shared = np.maximum(0, np.minimum(x2[i], x2[j]) - np.maximum(x1[i], x1[j])) * np.maximum(0, np.minimum(y2[i], y2[j]) - np.maximum(y1[i], y1[j]))
            union = area[i] + area[j] - shared
            close = (union > 0) & (shared >= limit * union)
        better, worse = np.minimum(i[close], j[close]), np.maximum(i[close], j[close])
        by_worse = np.argsort(worse, kind="stable")
        gone = set()
        for b, w in zip(better[by_worse].tolist(), worse[by_worse].tolist(), strict=True):
            if b not in gone:
                gone.add(w)
        keep[list(gone)] = False
    return keep
