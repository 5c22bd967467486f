"""Array arithmetic of one tile.

Spark cuts, shuffles and groups the tiles; this module only evaluates the
stencil on one of them.  Every operation covers a block of cells at once, and a tile
has a fixed largest size, so neither time nor memory grows with the image.

Cells outside the image and no-data cells are both stored as 0: neither can be
similar to anything, and neither adds to a block sum.
"""

import numpy as np
import pyarrow as pa

from gridfuse.functions.packing import INT_CELL, blob_cells
from gridfuse.functions.stencil import EPSILON, LIMB_BITS
from gridfuse.schema import BANDS, Grid

#: Sums of squares of whole numbers below this are exact as double.
EXACT_SQUARES = 2**53
_CELLS_AT_ONCE, _COLS_AT_ONCE = 8_192, 512  # keeps the working arrays of a step in cache


def line_cells(table: pa.Table):
    """The cells of all lines, arrays or packed, and where each line begins and ends."""
    pixels = table.column("pixels").combine_chunks()
    if pixels.null_count:
        raise ValueError("a line has no cells")
    if pa.types.is_binary(pixels.type) or pa.types.is_large_binary(pixels.type):
        return blob_cells(pixels, INT_CELL)
    return pixels.values.to_numpy(), pixels.offsets.to_numpy()


def band_grids(table: pa.Table, first_row: int, rows: int, cols: int):
    """Band lines of a tile as five padded grids, and the length of each complete line.

    A line counts only if all five bands have it, as in an inner join; other
    lines are outside the image (length -1).
    """
    lines = table.combine_chunks()
    offset = lines.column("row_key").to_numpy() - first_row
    names = lines.column("band").to_pylist()
    flat, starts = line_cells(table)
    grids = {b: np.zeros((rows, cols), dtype=np.int32) for b in BANDS}
    lengths = {b: np.full(rows, -1) for b in BANDS}
    for i, (band, r) in enumerate(zip(names, offset)):
        n = starts[i + 1] - starts[i]
        if lengths[band][r] >= 0:
            raise ValueError(f"line {first_row + r} of band {band} occurs more than once")
        lengths[band][r] = n
        grids[band][r, :n] = flat[starts[i] : starts[i + 1]]
    size = np.stack([lengths[b] for b in BANDS])
    complete = (size >= 0).all(axis=0)
    uneven = complete & (size != size[0]).any(axis=0)
    if uneven.any():
        line = first_row + int(np.flatnonzero(uneven)[0])
        raise ValueError(f"the five bands differ in length on line {line}")
    for grid in grids.values():
        grid[~complete] = 0
    return grids, np.where(complete, size[0], -1)


def coarse_sums(table: pa.Table, grid: Grid):
    """Block sums of the three coarse images for the owned cells of a tile of STACK lines.

    A line shorter than those below it still sees all their cells: lines are padded
    with 0 to the width of the tile.
    """
    halo, tile_rows = grid.halo, grid.tile_rows
    first_row = table.column("tile_row")[0].as_py() * tile_rows
    offset = table.column("row_key").to_numpy() - first_row
    lines = {b: table.column(b).combine_chunks() for b in ("coarse0", "coarse1", "coarse2")}
    lengths = np.diff(lines["coarse0"].offsets.to_numpy())
    longest = int(lengths.max(initial=0))
    blocks = []
    for line in lines.values():
        cells, starts = line.values.to_numpy(), line.offsets.to_numpy()
        padded = np.zeros((tile_rows + halo, longest + halo), np.int64)
        for r, begin, end in zip(offset, starts, starts[1:]):
            padded[r, : end - begin] = cells[begin:end]
        blocks.append(_box_sum(padded, grid.window))
    owned = np.flatnonzero(offset < tile_rows)
    width = np.minimum(lengths[owned], grid.tile_cols or longest)
    rows = np.repeat(offset[owned], width)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(width) - width, width)
    return rows + first_row, cols, [b[rows, cols] for b in blocks]


def _largest(grids, bands) -> int:
    return max(max(int(grids[b].max()), -int(grids[b].min())) for b in bands)


def _box_sum(values: np.ndarray, window: int) -> np.ndarray:
    h, w = values.shape[0] - window + 1, values.shape[1] - window + 1
    down = sum(values[k : k + h] for k in range(window))
    return sum(down[:, k : k + w] for k in range(window))


def _temporal_weights(tp, tkm, tkn, zero_change):
    to_m, to_n = np.abs(tkm - tp), np.abs(tkn - tp)
    total = to_m + to_n
    wm = np.where(total == 0, 0.5, to_n / np.maximum(total, 1))
    wn = 1.0 - wm
    if zero_change == "zero":
        still = (to_m == 0) | (to_n == 0)
        wm, wn = np.where(still, 0.0, wm), np.where(still, 0.0, wn)
    return wm, wn


def _cell_terms(grids):
    """What a cell contributes to the weighted sums of the cells that find it similar."""
    f1, f2, c1, c2, c0 = (grids[b].astype(np.float64) for b in BANDS)
    closeness = 1.0 / (1.0 - np.sign(f1 - f2) * np.sign(c1 - c2) + EPSILON)
    return [closeness, closeness * (c0 - c1), closeness * (c0 - c2)]


def _similar_sums(grids, t1, t2, window, slope, h, w):
    """Sums over the similar neighbours of each cell: three weighted ones, then x, y, xy, xx,
    yy of both dates and the number of neighbours.

    x and y are taken relative to the cell's own values at the first date.  The slope does
    not change under such a shift, and the sums, of differences, stay exact unless similar
    cells are far apart (:func:`_exact_slopes`).
    """
    by_distance = _cell_terms(grids)
    names = ("fine1", "fine2", "coarse1", "coarse2")
    if slope != "coarse_on_fine":
        names = names[2:] + names[:2]
    values = [grids[b].astype(np.float64) for b in names]
    own = [np.ascontiguousarray(values[k][:h, :w]) for k in (0, 2)]
    usable = (grids["fine1"] != 0) & (grids["fine2"] != 0)
    small = _largest(grids, ("fine1", "fine2")) < 2**23
    kind = np.float32 if small else np.float64  # either holds the integers exactly
    near = [np.where(usable, grids[b], np.nan).astype(kind) for b in ("fine1", "fine2")]
    centre = [np.ascontiguousarray(v[:h, :w]) for v in near]
    limit = [kind(np.floor(t)) for t in (t1, t2)]

    sums = np.zeros((9, h, w))
    gap, term, keep = np.empty((h, w), kind), np.empty((h, w)), np.empty((h, w))
    shifted = [np.empty((h, w)) for _ in values]
    similar = [np.empty((h, w), bool) for _ in near]
    for dc in range(window):
        # Shifting columns once per dc keeps the inner operations on aligned memory.
        near_dc, by_distance_dc, values_dc = (
            [np.ascontiguousarray(v[:, dc : dc + w]) for v in group]
            for group in (near, by_distance, values)
        )
        for dr in range(1 if dc == 0 else 0, window):
            rows = slice(dr, dr + h)
            for k in (0, 1):
                np.abs(np.subtract(centre[k], near_dc[k][rows], out=gap), out=gap)
                np.less_equal(gap, limit[k], out=similar[k])
            np.logical_and(*similar, out=similar[0])
            np.copyto(keep, similar[0])
            for k, value in enumerate(values_dc):
                np.subtract(value[rows], own[k // 2], out=shifted[k])
                shifted[k] *= keep
            (x1, x2, y1, y2), (sx, sy, sxy, sxx, syy, similar_cells) = shifted, sums[3:]
            for total, parts in ((sx, (x1, x2)), (sy, (y1, y2))):
                for part in parts:
                    total += part
            for total, factors in (
                (sxy, ((x1, y1), (x2, y2))),
                (sxx, ((x1, x1), (x2, x2))),
                (syy, ((y1, y1), (y2, y2))),
            ):
                for one, other in factors:
                    total += np.multiply(one, other, out=term)
            similar_cells += keep
            keep /= 1.0 + np.sqrt(dr * dr + dc * dc) / (window // 2)
            for total, value in zip(sums, by_distance_dc):
                total += np.multiply(keep, value[rows], out=term)
    return sums


def _slopes(pairs, sx, sy, sxy, sxx):
    """Least-squares slopes from whole numbers below 2**63, 1 where undefined."""
    spread = pairs * sxx - sx * sx
    flat = spread == 0
    return np.where(flat, 1.0, (pairs * sxy - sx * sy) / np.where(flat, 1, spread))


def _exact_slopes(grids, t1, t2, window, slope, h, w):
    """The same for cells of any int values: products are summed in two parts, and the
    quotient is of Python's unbounded whole numbers."""
    f1, f2, c1, c2 = (grids[b].astype(np.int64) for b in BANDS[:4])
    usable = (f1 != 0) & (f2 != 0)
    names = (f1, f2, c1, c2) if slope == "coarse_on_fine" else (c1, c2, f1, f2)
    own = [names[0][:h, :w], names[2][:h, :w]]
    pairs, sx, sy = (np.zeros((h, w), np.int64) for _ in range(3))
    sxy, sxx = (np.zeros((2, h, w), np.int64) for _ in range(2))
    for dr in range(window):
        for dc in range(window):
            at = (slice(dr, dr + h), slice(dc, dc + w))
            keep = usable[:h, :w] & usable[at] & (dr + dc > 0)
            for fine, limit in ((f1, t1), (f2, t2)):
                keep &= np.abs(fine[:h, :w] - fine[at]) <= limit
            x1, x2 = (np.where(keep, v[at] - own[0], 0) for v in names[:2])
            y1, y2 = (np.where(keep, v[at] - own[1], 0) for v in names[2:])
            pairs += 2 * keep
            sx += x1 + x2
            sy += y1 + y2
            for total, factors in ((sxy, ((x1, y1), (x2, y2))), (sxx, ((x1, x1), (x2, x2)))):
                for one, other in factors:
                    total[0] += (one >> LIMB_BITS) * other
                    total[1] += (one & (2**LIMB_BITS - 1)) * other
    pairs, sx, sy = (v.astype(object) for v in (pairs, sx, sy))
    sxy, sxx = (v[0].astype(object) * 2**LIMB_BITS + v[1] for v in (sxy, sxx))
    quotient = np.frompyfunc(lambda rise, spread: rise / spread if spread else 1.0, 2, 1)
    return quotient(pairs * sxy - sx * sy, pairs * sxx - sx * sx).astype(np.float64)


def fuse_grids(grids, t1, t2, window, slope, zero_change):
    """Fused values of the owned cells, from grids that carry the halo."""
    h, w = (n - window + 1 for n in grids["fine1"].shape)
    inv, change_m, change_n, *sums = _similar_sums(grids, t1, t2, window, slope, h, w)
    if max(sums[3].max(initial=0), sums[4].max(initial=0)) < EXACT_SQUARES:
        sx, sy, sxy, sxx, _, similar = (v.astype(np.int64) for v in sums)
        v = _slopes(2 * similar, sx, sy, sxy, sxx)
    else:
        v = _exact_slopes(grids, t1, t2, window, slope, h, w)
    norm = np.where(inv == 0, 1.0, inv)
    tp, tkm, tkn = (
        _box_sum(grids[b].astype(np.int64), window) for b in ("coarse0", "coarse1", "coarse2")
    )
    wm, wn = _temporal_weights(tp, tkm, tkn, zero_change)
    pred_m = grids["fine1"][:h, :w] + v * (change_m / norm)
    pred_n = grids["fine2"][:h, :w] + v * (change_n / norm)
    return wm * pred_m + wn * pred_n


def fuse_tile(table: pa.Table, grid: Grid, slope: str, zero_change: str):
    """One tile of band lines in; the keys, list offsets and values of its owned lines out."""
    halo, tile_rows = grid.halo, grid.tile_rows
    longest = int(np.diff(line_cells(table)[1]).max())
    tile_cols = max(1, min(longest, grid.tile_cols or longest))
    first_row = table.column("tile_row")[0].as_py() * tile_rows
    grids, length = band_grids(table, first_row, tile_rows + halo, longest + halo)
    owned = np.flatnonzero(length[:tile_rows] >= 0)
    t1, t2 = table.column("t1")[0].as_py(), table.column("t2")[0].as_py()
    if len(owned) and (t1 is None or t2 is None):
        raise ValueError("no similarity threshold for this tile")
    width = np.minimum(length[owned], tile_cols)
    last = int(owned[-1]) + 1 if len(owned) else 0
    fused = np.empty((last, tile_cols))
    cols = min(_COLS_AT_ONCE, tile_cols)
    rows = max(8, _CELLS_AT_ONCE // cols)
    for top in range(0, last, rows):
        bottom = min(top + rows, last)
        for left in range(0, tile_cols, cols):
            right = min(left + cols, tile_cols)
            held = (slice(top, bottom + halo), slice(left, right + halo))
            part = {b: g[held] for b, g in grids.items()}
            fused[top:bottom, left:right] = fuse_grids(
                part, t1, t2, grid.window, slope, zero_change
            )
    values = [np.empty(0), *(fused[r, :n] for r, n in zip(owned, width))]
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return owned + first_row, ends, np.concatenate(values)
