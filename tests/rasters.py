"""Small images as tables."""

import random

from gridfuse.schema import RASTER_ROWS, STACK

from brute import BANDS


def image_of(rows, cols, cell):
    return {(r, c): tuple(cell(r, c)) for r in range(rows) for c in range(cols)}


def noisy_image(seed, rows, cols, no_data=0.05):
    rnd = random.Random(seed)

    def cell(r, c):
        base = 100 + 60 * ((r // 3 + c // 4) % 3)
        f1, f2 = base + rnd.randint(-15, 15), base + 20 + rnd.randint(-15, 15)
        c1, c2, c0 = (base + d + rnd.randint(-9, 9) for d in (0, 20, 12))
        return [0 if rnd.random() < no_data else f1, 0 if rnd.random() < no_data else f2, c1, c2, c0]

    return image_of(rows, cols, cell)


def lines_of(image):
    """{row: [cells in column order]}"""
    rows = {}
    for (r, c), cell in sorted(image.items()):
        rows.setdefault(r, []).append(cell)
    return rows


def raster_rows(spark, images, shuffle=None):
    """RASTER_ROWS of ``{scene: image}``."""
    data = [
        (scene, band, r, [cell[k] for cell in cells])
        for scene, image in images.items()
        for r, cells in lines_of(image).items()
        for k, band in enumerate(BANDS)
    ]
    if shuffle is not None:
        random.Random(shuffle).shuffle(data)
    return spark.createDataFrame(data, RASTER_ROWS)


def stack_rows(spark, images):
    data = [
        (scene, r, *[[cell[k] for cell in cells] for k in range(5)])
        for scene, image in images.items()
        for r, cells in lines_of(image).items()
    ]
    return spark.createDataFrame(data, STACK)


def cells_of(fused):
    """{scene: {(row, col): value}} of a fused image."""
    result = {}
    for row in fused.collect():
        for c, value in enumerate(row["pixels"]):
            result.setdefault(row["scene"], {})[row["row_key"], c] = value
    return result
