import numpy as np
import pytest

from framejobs.operators import pixels as P
from framejobs.operators.redact import array_of
from framejobs.plans import queries as Q
from tests.media.test_pixels import naive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    rows = Q.pixel_frames(spark, SF, best_only=False).collect()
    assert sum(len(r.boxes) > 1 for r in rows) > 50 and {r.channels for r in rows} == {1, 3, 4}
    return rows


def boxes_of(r):
    return [(b.x1, b.y1, b.x2, b.y2) for b in sorted(r.boxes, key=lambda b: b.det_idx)]


def image_loop(frame, boxes, image):
    f = frame.copy()
    for b in boxes:
        x1, y1, x2, y2 = P.grow_clip(b, f.shape[1], f.shape[0], 1.3)
        if x2 > x1 and y2 > y1:
            small = P.resize_bytes(image, x2 - x1, y2 - y1).astype(float)
            for y in range(y2 - y1):
                for x in range(x2 - x1):
                    a = small[y, x, 3] / 255
                    for c in range(min(3, f.shape[2])):
                        f[y1 + y, x1 + x, c] = int(f[y1 + y, x1 + x, c] * (1 - a) + small[y, x, c] * a)
    return f


@pytest.mark.parametrize(("name", "mode", "ellipse", "size"), [
    ("redact_solid_all", "solid", True, 0), ("redact_mosaic_all", "mosaic", True, 4), ("redact_blur_all", "blur", False, 0), ("redact_blur_ellipse_all", "blur", True, 0), ("redact_img", "img", True, 0),
])
def test_all_boxes_are_drawn(spark, frames, name, mode, ellipse, size):
    got = {(r.video_id, r.frame_id): r.byte_sum for r in Q.QUERIES[name](spark, SF).collect()}
    assert set(got) == {(r.video_id, r.frame_id) for r in frames}
    image = np.arange(6 * 5 * 4, dtype=np.uint8).reshape(6, 5, 4)
    several = 0
    for r in [f for f in frames if len(f.boxes) > 1][:60] + frames[:20]:
        loop = lambda boxes: int((image_loop(array_of(r), boxes, image) if mode == "img" else naive(array_of(r), boxes, mode, ellipse, size)).sum())  # noqa: B023, E731
        boxes = boxes_of(r)
        assert got[r.video_id, r.frame_id] == loop(boxes)
        several += len(boxes) > 1 and loop(boxes) != loop(boxes[:1])
    assert several
