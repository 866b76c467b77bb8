"""Files of nested boxes made by hand, and their samples found by ranges."""

import io
import struct
import tempfile

import numpy as np
import pytest

from framewright.sources import boxes


def put(data):
    path = tempfile.mkdtemp(prefix="framewright-box-") + "/a.boxes"
    with open(path, "wb") as f:
        f.write(data)
    return path


def read(data):
    return boxes.tracks(io.BytesIO(data), len(data))


def table(kind, *numbers, form="I"):
    return boxes.box(kind, struct.pack(f">{len(numbers)}{form}", *numbers)) if form == "I" else boxes.box(kind, struct.pack(">II", *numbers[:2]), struct.pack(f">{len(numbers) - 2}Q", *numbers[2:]))


def track(*tables):
    return boxes.box(b"trak", boxes.box(b"tkhd", b"x" * 20), boxes.box(b"mdia", boxes.box(b"minf", boxes.box(b"stbl", *tables))))


@pytest.mark.parametrize("seed", range(6))
def test_samples_of_many_files(spark, seed):
    draw = np.random.default_rng(seed)
    want, paths = set(), []
    for _ in range(5):
        samples = [draw.bytes(int(draw.integers(0, 30))) for _ in range(int(draw.integers(0, 60)))]
        runs = [(1, int(draw.integers(1, 6)))] + [(int(c), int(draw.integers(1, 6))) for c in sorted(draw.choice(np.arange(2, 12), 3, replace=False))]
        data = boxes.file_of(samples, runs, gap=int(draw.integers(0, 4)))
        paths.append(put(data))
        at = 0
        for k, s in enumerate(samples):
            at = data.index(s, at) if s else at
            want.add((paths[-1], k, len(s), s))
    got = boxes.read_samples(spark, paths, samples_per_task=7, tasks=3).collect()
    assert {(r["path"], r["sample"], r["size"], bytes(r["data"])) for r in got} == want and len(got) == len(want)
    for r in got:
        with open(r["path"], "rb") as f:
            f.seek(r["offset"])
            assert f.read(r["size"]) == bytes(r["data"])


def test_forms_of_boxes_and_tables():
    """A box with a long size, one to the end of the file, equal sizes, and long offsets."""
    one = track(table(b"stsc", 0, 2, 1, 2, 1, 3, 1, 1), table(b"stsz", 0, 9, 5), table(b"co64", 0, 3, 100, 1 << 33, 400, form="Q"))
    large = struct.pack(">I4sQ", 1, b"free", 16 + 3) + b"abc"
    moov = struct.pack(">I4s", 0, b"moov") + boxes.box(b"mvhd", b"") + one + track()
    first, second = read(large + moov)
    offsets, sizes = boxes.sample_ranges(first)
    assert offsets.tolist() == [100, 109, 1 << 33, (1 << 33) + 9, 400] and sizes.tolist() == [9] * 5
    assert boxes.sample_ranges(second)[0].tolist() == [] and read(b"") == [] and read(boxes.box(b"mdat", b"trak")) == []


@pytest.mark.parametrize(
    ("data", "says"),
    [
        (b"\0\0\0", "cut short"),
        (struct.pack(">I4s", 4, b"free"), "says"),
        (struct.pack(">I4s", 99, b"free"), "says"),
        (struct.pack(">I4s", 1, b"free"), "cut short"),
        (boxes.box(b"moov", struct.pack(">I4s", 40, b"trak")), "says"),
        (boxes.box(b"moov", track(boxes.box(b"stco", struct.pack(">III", 0, 5, 1)))), "cut short"),
        (boxes.box(b"moov", track(boxes.box(b"stco", struct.pack(">II", 1 << 24, 0)))), "known form"),
    ],
)
def test_bad_boxes(data, says):
    with pytest.raises(ValueError, match=says):
        read(data)


def test_tables_that_do_not_agree():
    for runs, chunks in (([(1, 2)], 2), ([(2, 3)], 1), ([(1, 3), (1, 3)], 1), ([], 1)):
        made = boxes.Track(np.array(runs, np.int64).reshape(-1, 2), np.full(3, 4), np.arange(chunks))
        with pytest.raises(ValueError, match="samples in chunks|runs of chunks"):
            boxes.sample_ranges(made)


def test_chunks_without_samples():
    made = boxes.Track(np.array([(1, 0), (2, 2), (3, 0), (4, 1)]), np.array([5, 6, 7]), np.array([10, 20, 30, 40]))
    assert boxes.sample_ranges(made)[0].tolist() == [20, 25, 40]
