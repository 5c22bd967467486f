"""The fusion cell by cell in plain Python, to compare the library against."""

import math
import statistics

BANDS = ("fine1", "fine2", "coarse1", "coarse2", "coarse0")


def thresholds(image, num_class=4):
    """``image``: {(row, col): (f1, f2, c1, c2, c0)}"""
    return [
        round(statistics.pstdev([v[k] for v in image.values()]) * 2 / num_class, 6) for k in (0, 1)
    ]


def block(image, r, c, window):
    for dr in range(window):
        for dc in range(window):
            if (r + dr, c + dc) in image:
                yield dr, dc, image[r + dr, c + dc]


def similar(image, r, c, t1, t2, window):
    f1, f2 = image[r, c][:2]
    found = []
    for dr, dc, near in block(image, r, c, window):
        if (dr or dc) and 0 not in (f1, f2, near[0], near[1]):
            if abs(f1 - near[0]) <= t1 and abs(f2 - near[1]) <= t2:
                found.append((dr, dc, near))
    return found


def correlation(near):
    """Pearson's formula over the two dates, 0 where it is undefined."""
    x, y = near[0:2], near[2:4]
    mx, my = sum(x) / 2, sum(y) / 2
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
    spread = math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    return cov / spread if spread else 0.0


def raw_weight(dr, dc, near, window):
    distance = 1 + math.hypot(dr, dc) / (window // 2)
    return 1 / ((1 - correlation(near) + 1e-7) * distance)


def slope_of(found, orientation):
    points = [(near[k], near[k + 2]) for _, _, near in found for k in (0, 1)]
    if orientation == "fine_on_coarse":
        points = [(y, x) for x, y in points]
    if len({x for x, _ in points}) < 2:
        return 1.0
    return statistics.linear_regression(*zip(*points)).slope


def date_weights(tp, tkm, tkn, zero_change):
    m, n = abs(tkm - tp), abs(tkn - tp)
    if m and n:
        return (1 / m) / (1 / m + 1 / n), (1 / n) / (1 / m + 1 / n)
    if zero_change == "zero":
        return 0.0, 0.0
    if m == n:
        return 0.5, 0.5
    return (1.0, 0.0) if m == 0 else (0.0, 1.0)


def fuse(image, num_class=4, slope="coarse_on_fine", zero_change="limit", window=5):
    t1, t2 = thresholds(image, num_class)
    result = {}
    for (r, c), cell in image.items():
        found = similar(image, r, c, t1, t2, window)
        raw = [raw_weight(dr, dc, near, window) for dr, dc, near in found]
        weights = [x / sum(raw) for x in raw]
        v = slope_of(found, slope)
        predictions = [
            cell[k] + v * sum(w * (near[4] - near[2 + k]) for w, (_, _, near) in zip(weights, found))
            for k in (0, 1)
        ]
        near = [values for _, _, values in block(image, r, c, window)]
        tm, tn = date_weights(*(sum(v[k] for v in near) for k in (4, 2, 3)), zero_change)
        result[r, c] = tm * predictions[0] + tn * predictions[1]
    return result
