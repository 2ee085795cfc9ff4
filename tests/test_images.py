"""Pixel steps against plain loops, and the Arrow operators over decoded files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.functions import pixels
from pngs import encode_png
from doctables.operators import images as I
from doctables.sources import tables as sources


def otsu_by_hand(img):
    flat = [int(x) for x in img.ravel()]
    best, level = 0.0, 0
    for t in range(256):
        low, high = [x for x in flat if x <= t], [x for x in flat if x > t]
        if low and high:
            gap = sum(low) / len(low) - sum(high) / len(high)
            var = len(low) * len(high) * gap * gap
            if var > best * (1 + 1e-12):
                best, level = var, t
    return level


@pytest.mark.parametrize("seed", range(20))
def test_otsu(seed):
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 256 if seed % 2 else 6, (7, 9), dtype=np.uint8)
    assert pixels.otsu_level(img) == otsu_by_hand(img)


def test_otsu_special_images():
    assert pixels.otsu_level(np.full((4, 4), 77, np.uint8)) == 0
    two = np.array([[10, 10, 200, 200]], np.uint8)
    assert pixels.otsu_level(two) == 10
    assert pixels.binarize(two).tolist() == [[0, 0, 255, 255]]
    assert pixels.binarize(np.full((2, 2), 77, np.uint8)).min() == 255
    assert pixels.binarize(np.zeros((2, 2), np.uint8)).max() == 0


def test_gray_weights():
    rgb = np.array([[[255, 255, 255], [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]]], np.uint8)
    assert pixels.to_gray(rgb).tolist() == [[255, 76, 150, 29, 0]]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_dilate(size):
    img = np.random.default_rng(size).integers(0, 256, (6, 8), dtype=np.uint8)
    before = size // 2
    for y in range(6):
        for x in range(8):
            window = img[max(y - before, 0) : y - before + size, max(x - before, 0) : x - before + size]
            assert pixels.dilate(img, size)[y, x] == window.max()


def test_resize_sides():
    assert pixels.resized_sides(2550, 3300, 800) == (618, 800)
    assert pixels.resized_sides(100, 50, 800) == (800, 400)
    # 0.5 goes to the even side.
    assert pixels.resized_sides(800, 5, 80) == (80, 0)
    assert pixels.resized_sides(800, 15, 80) == (80, 2)


def test_resize_keeps_flat_and_equal_sized_images():
    flat = np.full((30, 20), 131, np.uint8)
    assert set(np.unique(pixels.resize(flat, 47))) == {131}
    img = np.random.default_rng(1).integers(0, 256, (8, 6, 3), dtype=np.uint8)
    assert np.array_equal(pixels.resize(img, 8), img)


def test_resize_by_hand():
    """Two pixels to four: cubic weights at distances 0.25, 0.75 and so on, edge pixels renormalised."""
    def cubic(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else (-0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0)

    want = []
    for o in range(4):
        c = (o + 0.5) / 2
        w = [cubic(p + 0.5 - c) for p in range(2)]
        want.append(round(max(0, min(255, (w[0] * 40 + w[1] * 200) / sum(w)))))
    assert pixels.resize(np.array([[40, 200]], np.uint8), 4)[0].tolist() == want


def test_profiles():
    img = np.random.default_rng(3).integers(0, 256, (40, 30, 3), dtype=np.uint8)
    plain = pixels.prepare(img, pixels.PLAIN)
    assert plain.shape == (3, 800, 600) and plain.dtype == np.float32
    first = (pixels.resize(img[..., ::-1], 800)[0, 0] / 255 - np.array(pixels.PLAIN.mean)) / np.array(pixels.PLAIN.std)
    assert plain[:, 0, 0] == pytest.approx(first, abs=1e-5)
    binary = pixels.prepare(img, pixels.BINARIZED)
    assert np.array_equal(binary[0], binary[1]) and np.array_equal(binary[0], binary[2])
    # The threshold is taken at full size, before resizing.
    black_white = pixels.binarize(pixels.to_gray(img[..., ::-1]))
    again = pixels.normalize(pixels.resize(pixels.three_channels(black_white), 800), (0.485,) * 3, (0.229,) * 3)
    assert np.array_equal(binary, again)


def test_decoded_files(spark, folder):
    rng = np.random.default_rng(9)
    made = {"g_page_1.png": rng.integers(0, 256, (5, 7), dtype=np.uint8), "c_page_1.png": rng.integers(0, 256, (6, 4, 3), dtype=np.uint8)}
    for name, img in made.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(encode_png(img))
    with open(f"{folder}/x_page_1.png", "wb") as f:
        f.write(b"nothing")
    images = sources.read_images(spark, folder)
    name = F.substring_index("file_path", "/", -1).alias("name")

    def arrays(df):
        rows = df.select(name, "image.*").collect()
        return {r.name: pixels.as_array(r.data, r.height, r.width, r.nChannels) for r in rows if r.height > 0}

    rgb = arrays(I.bgr_to_rgb(images))
    gray = arrays(I.grayscale(I.bgr_to_rgb(images)))
    for key, img in made.items():
        assert np.array_equal(rgb[key], img)
        assert np.array_equal(gray[key], pixels.to_gray(img))
    assert I.bgr_to_rgb(images).count() == 3
    tensors = {r.name: r.tensor for r in I.prepared(images).select(name, "tensor").collect()}
    for key, img in made.items():
        want = pixels.prepare(img, pixels.Profile(binarize=True, bgr=False))
        t = tensors[key]
        assert (t.c, t.h, t.w) == want.shape
        assert np.array_equal(np.array(t.data, np.float32).reshape(want.shape), want)
    assert tensors["x_page_1.png"].data is None
    stored = {r.name: r.content for r in I.encoded(images, encode_png).select(name, "content").collect()}
    assert stored["c_page_1.png"] == encode_png(made["c_page_1.png"])


def test_a_chain_of_steps_is_one_pass(spark):
    df = spark.createDataFrame([(("", 2, 2, 3, 16, bytes(range(12))),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    steps = [pixels.swap_channels, pixels.to_gray, pixels.three_channels, lambda img: pixels.resize(img, 4)]
    chain = I.map_images(df, steps)
    one = df
    for step in steps:
        one = I.map_images(one, step)
    assert chain.collect() == one.collect()
    assert chain._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
