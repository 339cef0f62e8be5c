import math
import random

import numpy as np
import pytest

from framejobs.operators import pixels as P


def reflect(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i


def naive(frame, boxes, mode, ellipse, size):
    f = frame.astype(int).copy()
    for box in boxes:
        x1, y1, x2, y2 = P.grow_clip(box, f.shape[1], f.shape[0], 1.3)
        w, h = x2 - x1, y2 - y1
        if w < 0 or h < 0:
            continue
        if mode == "solid":
            for y in range(y1, y2 + 1):
                for x in range(x1, x2 + 1):
                    f[y, x] = 0
        elif mode == "mosaic":
            for y in range(y1, y2, size):
                for x in range(x1, x2, size):
                    colour = f[y, x].copy()
                    for yy in range(y, min(y2, y + size - 1) + 1):
                        for xx in range(x, min(x2, x + size - 1) + 1):
                            f[yy, xx] = colour
        elif w // 2 and h // 2:
            kw, kh = w // 2, h // 2
            crop = f[y1:y2, x1:x2].copy()
            for y in range(h):
                for x in range(w):
                    if ellipse and not ((y - h // 2) / (h // 2)) ** 2 + ((x - w // 2) / (w // 2)) ** 2 < 1:
                        continue
                    total = sum(crop[reflect(y - kh // 2 + dy, h), reflect(x - kw // 2 + dx, w)] for dy in range(kh) for dx in range(kw))
                    f[y1 + y, x1 + x] = np.rint(total / (kw * kh))
    return f.astype(np.uint8)


@pytest.mark.parametrize("seed", range(12))
def test_modes_match_loops(seed):
    r, g = random.Random(seed), np.random.default_rng(seed)
    h, w, c = r.randint(6, 16), r.randint(6, 16), r.choice([1, 3, 4])
    frame = g.integers(0, 256, (h, w, c), dtype=np.uint8)
    boxes = [(x, y, x + r.uniform(0, 8), y + r.uniform(0, 8)) for x, y in [(r.uniform(-3, w + 2), r.uniform(-3, h + 2)) for _ in range(3)]]
    for mode, ellipse, size in (("solid", True, 0), ("mosaic", True, 3), ("mosaic", True, 20), ("blur", True, 0), ("blur", False, 0)):
        got = P.redact_frame(frame, boxes, mode, ellipse=ellipse, mosaic_size=size or 20)
        assert (got == naive(frame, boxes, mode, ellipse, size)).all(), (mode, ellipse)
    assert (P.redact_frame(frame, boxes, "none") == frame).all()
    with pytest.raises(ValueError):
        P.redact_frame(frame, [(0, 0, 5, 5)], "smear")


def test_replacement_images():
    frame = np.full((12, 12, 3), 100, dtype=np.uint8)
    box = [(3, 3, 8, 8)]
    rgb = np.full((2, 2, 3), 7, dtype=np.uint8)
    x1, y1, x2, y2 = P.grow_clip(box[0], 12, 12, 1.3)
    out = P.redact_frame(frame, box, "img", image=rgb)
    assert (out[y1:y2, x1:x2] == 7).all() and (out == 7).sum() == 3 * (x2 - x1) * (y2 - y1)
    half = np.dstack([rgb, np.full((2, 2), 128, dtype=np.uint8)])
    assert (P.redact_frame(frame, box, "img", image=half)[y1:y2, x1:x2] == int(100 * (1 - 128 / 255) + 7 * 128 / 255)).all()


def test_resize_and_channels():
    g = np.random.default_rng(1)
    a = g.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (P.resize_bytes(a, 5, 7) == a).all()
    out = P.resize(a, 3, 4)
    for y in range(4):
        for x in range(3):
            sy, sx = min(max((y + 0.5) * 7 / 4 - 0.5, 0), 6), min(max((x + 0.5) * 5 / 3 - 0.5, 0), 4)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 6), min(x0 + 1, 4)
            fy, fx = sy - y0, sx - x0
            want = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
            assert np.allclose(out[y, x], want)
    assert P.ensure_rgb(a[:, :, :1]).shape == (7, 5, 3) and (P.ensure_rgb(np.dstack([a, a[:, :, :1]])) == a).all() and P.ensure_rgb(a[:, :, 0]).shape == (7, 5, 3)
    assert P.to_network_input([a, a], 32, 32).shape == (2, 3, 32, 32) and P.to_network_input([a], 32, 32).dtype == np.float32


def test_suppression_rules():
    box = lambda x, s=10: [x, 0, x + s, s]
    run = lambda b, s: P.suppress(np.array(b, dtype=float), np.array(s, dtype=float), 0.3)
    assert run([[1, 1, 1, 1]] * 2, [0.5, 0.6]) == [0, 1]
    assert run([box(0), box(0), box(0)], [0.5, 0.5, 0.5]) == [2]
    edge = 10 - 20 * 0.3 / 1.3  # overlap of exactly 0.3 goes
    assert run([box(0), box(edge)], [0.9, 0.8]) in ([0], [0, 1]) and run([box(0), box(4)], [0.9, 0.8]) == [0] and run([box(0), box(6)], [0.9, 0.8]) == [0, 1]
    assert run([[0, 0, 13, 10], [7, 0, 20, 10]], [0.9, 0.8]) == [0]
    assert P.decode_and_suppress(np.full((2, 2), 0.2), np.zeros((2, 2, 2)), np.zeros((2, 2, 2)), np.zeros((10, 2, 2)), (8, 8), 0.2) == []
    assert math.isclose(P.decode_and_suppress(np.array([[0.9]]), np.zeros((2, 1, 1)), np.zeros((2, 1, 1)), np.zeros((10, 1, 1)), (4, 4))[0]["x2"], 4.0)
