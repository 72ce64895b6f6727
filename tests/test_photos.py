"""Photos that are opened, and crops of them."""

import random
import struct
import zlib

from pyspark.sql import functions as F

from duskframe.plans.versions import VersionedTable
from duskframe.sources import images, photos
from test_io import jpeg


def png(width, height, pixel):
    """A picture of three bytes a pixel, in the order red, green, blue."""
    raw = b"".join(b"\x00" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_a_queue_with_broken_photos(spark, tmp_path):
    base = tmp_path / "traps"
    (base / "night").mkdir(parents=True)
    pixel = lambda x, y: (x, y, 7)
    for k in range(3):
        (base / "night" / f"{k}.jpg").write_bytes(png(5 + k, 4, pixel))
    (base / "night" / "3.jpg").write_bytes(b"not a photo")
    (base / "night" / "4.jpg").write_bytes(png(5, 4, pixel)[:60])
    (base / "night" / "9.jpg").write_bytes(b"not in the queue, and broken")
    rows = [(k, f"night/{k}.jpg", True, None) for k in range(6)] + [(6, None, True, None), (7, "night/0.jpg", False, None)]
    table = VersionedTable.create(spark.createDataFrame(rows, "id long, path string, in_queue boolean, last_processed timestamp"), str(tmp_path / "t"), ["id"], 4)
    good, bad = photos.pull_photos(table, str(base), 100)
    assert {(r["id"], r["width"], r["height"], r["channels"]) for r in good.collect()} == {(k, 5 + k, 4, 3) for k in range(3)}
    data = bytes(good.filter("id = 1").first()["pixels"])
    assert data == bytes(v for y in range(4) for x in range(6) for v in pixel(x, y)[::-1])  # blue comes first
    assert {(r["id"], r["error"]) for r in bad.collect()} == {(3, "unreadable"), (4, "unreadable"), (5, "missing"), (6, "missing")}
    assert photos.pull_photos(table, str(base), 100) is None
    assert photos.open_photos(spark, str(base), spark.createDataFrame([(1, "night/none.jpg")], "id long, path string"))[0].count() == 0


def test_crops_equal_loops(spark):
    rng = random.Random(2)
    shots, boxes = [], []
    for k in range(6):
        w, h, c = rng.randint(1, 30), rng.randint(1, 20), rng.choice([1, 3, 4])
        shots.append((k, w, h, c, bytearray(rng.randrange(256) for _ in range(w * h * c))))
        boxes += [(100 * k + i, k, [rng.uniform(-8, 35) for _ in range(4)]) for i in range(25)]
        boxes += [(100 * k + 50, k, [0.0, 0.0, float(w), float(h)]), (100 * k + 51, k, None), (100 * k + 52, k, [3.2, 3.2, 3.9, 9.0])]
    boxes.append((999, 77, [0.0, 0.0, 5.0, 5.0]))
    got = photos.crops(spark.createDataFrame(shots, "id long, width int, height int, channels int, pixels binary"), spark.createDataFrame(boxes, "id long, image_id long, bbox array<double>")).collect()
    assert len(got) == len(boxes) - 1
    found = {r["id"]: r["crop"] for r in got}
    some = 0
    for i, k, box in boxes[:-1]:
        _, w, h, c, data = shots[k]
        if box is None:
            assert found[i] is None
            continue
        x1, y1, x2, y2 = (min(max(int(v), 0), side) for v, side in zip(box, (w, h, w, h)))
        rows = [bytes(data[(y * w + x1) * c : (y * w + x2) * c]) for y in range(y1, y2)]
        if x2 <= x1 or y2 <= y1:
            assert found[i] is None
        else:
            some += 1
            assert (found[i]["width"], found[i]["height"], found[i]["channels"], [bytes(r) for r in found[i]["rows"]]) == (x2 - x1, y2 - y1, c, rows)
    assert some > 20


def test_sizes_of_photos_with_long_headers(spark, tmp_path):
    """A frame that comes after the part of a file that is looked at first."""
    comment = b"\xff\xfe" + struct.pack(">H", 65535) + b"x" * 65533
    (tmp_path / "20220810231507-00.jpg").write_bytes(b"\xff\xd8" + comment * 5 + jpeg(40, 30)[2:])
    (tmp_path / "20220810231508-00.jpg").write_bytes(b"\xff\xd8" + comment * 5)
    shapes = images.find_images(spark, str(tmp_path)).select(F.col("shape.width")).collect()
    assert sorted(str(r[0]) for r in shapes) == ["40", "None"]
