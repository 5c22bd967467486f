"""The registered queries once more, as SQL over cells.

The SQL knows neither lines nor tiles: a neighbourhood is a join of cells on
their coordinates.
"""

from gridfuse.schema import BANDS

# The rasters of the orders table, one row per cell.
_PIX = """
placed AS (
  SELECT o_orderkey, o_custkey, o_orderkey // 128 AS line,
         length(bin(o_orderkey // 128 // 60 + 1)) - 1 AS step,
         CAST(o_orderkey % 128 AS INTEGER) AS col,
         CAST(floor(o_totalprice) AS BIGINT) % 41 - 20 AS noise
  FROM orders),
classed AS (
  SELECT *, 's' || step AS scene,
         CAST(line - 60 * ((1 << step) - 1) AS INTEGER) AS row_key,
         ((line - 60 * ((1 << step) - 1)) // 8 + col // 8) % 4 AS cls
  FROM placed),
fine AS (
  SELECT scene, row_key, col, row_key // 5 AS br, col // 5 AS bc,
         CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 400 + 300 * cls + noise END AS fine1,
         400 + 300 * cls + noise + 50 * (cls + 1) + o_custkey % 7 AS fine2,
         400 + 300 * cls + noise
           + CASE cls WHEN 0 THEN 10 WHEN 1 THEN 90 WHEN 2 THEN 40 ELSE 180 END
           + o_custkey % 5 AS truth
  FROM classed),
blocks AS (
  SELECT scene, br, bc, CAST(sum(fine1) // count(*) AS INTEGER) AS coarse1,
         CAST(sum(fine2) // count(*) AS INTEGER) AS coarse2,
         CAST(sum(truth) // count(*) AS INTEGER) AS coarse0
  FROM fine GROUP BY ALL),
pix AS (
  SELECT scene, row_key, col, CAST(fine1 AS INTEGER) AS fine1,
         CAST(fine2 AS INTEGER) AS fine2, coarse1, coarse2, coarse0
  FROM fine JOIN blocks USING (scene, br, bc))"""

_BAND_PIX = """
band_pix AS (
  SELECT scene, row_key, col, unnest(['fine1', 'fine2', 'coarse1', 'coarse2', 'coarse0']) AS band,
         unnest([fine1, fine2, coarse1, coarse2, coarse0]) AS px
  FROM pix)"""

_NEAR = """
offs AS (
  SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc
  FROM range(5) AS r(dr), range(5) AS c(dc)),
aimed AS (
  SELECT pix.*, dr, dc, row_key + dr AS to_row, col + dc AS to_col FROM pix, offs),
block AS (
  SELECT a.scene, a.row_key, a.col, a.dr, a.dc,
         a.fine1, a.fine2, a.coarse1, a.coarse2, a.coarse0,
         b.fine1 AS near_fine1, b.fine2 AS near_fine2, b.coarse1 AS near_coarse1,
         b.coarse2 AS near_coarse2, b.coarse0 AS near_coarse0
  FROM aimed a JOIN pix b
    ON b.scene = a.scene AND b.row_key = a.to_row AND b.col = a.to_col),
near AS (SELECT * FROM block WHERE dr + dc > 0)"""


def _thresholds(num_class: int) -> str:
    return f"""
limits AS (
  SELECT scene, round(stddev_pop(fine1) * 2 / {num_class}, 6) AS t1,
         round(stddev_pop(fine2) * 2 / {num_class}, 6) AS t2
  FROM pix GROUP BY scene)"""


_SIMILAR = """
sim AS (
  SELECT near.*, t1, t2 FROM near JOIN limits USING (scene)
  WHERE fine1 <> 0 AND fine2 <> 0 AND near_fine1 <> 0 AND near_fine2 <> 0
    AND abs(fine1 - near_fine1) <= t1 AND abs(fine2 - near_fine2) <= t2)"""

_WEIGHED = """
rated AS (
  SELECT *, CAST(sign(CAST(near_fine1 - near_fine2 AS BIGINT)
                      * (near_coarse1 - near_coarse2)) AS DOUBLE) AS r,
         1 + sqrt(dr * dr + dc * dc) / 2 AS d
  FROM sim),
weighed AS (
  SELECT *, (1 / ((1 - r + 1e-7) * d))
            / sum(1 / ((1 - r + 1e-7) * d)) OVER (PARTITION BY scene, row_key, col) AS w
  FROM rated)"""

_BLOCK_SUMS = """
sums AS (
  SELECT scene, row_key, col, CAST(sum(near_coarse0) AS BIGINT) AS tp,
         CAST(sum(near_coarse1) AS BIGINT) AS tkm, CAST(sum(near_coarse2) AS BIGINT) AS tkn
  FROM block GROUP BY scene, row_key, col)"""


def _temporal(zero_change: str) -> str:
    if zero_change == "zero":
        still = "WHEN tkm = tp OR tkn = tp THEN 0"
        still_n = still
    else:
        still = "WHEN tkm = tp AND tkn = tp THEN 0.5 WHEN tkm = tp THEN 1 WHEN tkn = tp THEN 0"
        still_n = "WHEN tkm = tp AND tkn = tp THEN 0.5 WHEN tkm = tp THEN 0 WHEN tkn = tp THEN 1"
    both = "(1 / abs(tkm - tp) + 1 / abs(tkn - tp))"
    return f"""
timed AS (
  SELECT *, CAST(CASE {still} ELSE 1 / abs(tkm - tp) / {both} END AS DOUBLE) AS tm,
         CAST(CASE {still_n} ELSE 1 / abs(tkn - tp) / {both} END AS DOUBLE) AS tn
  FROM sums)"""


# The same weights with one division of integers, which needs no rounding to compare.
_SHARES = """
shares AS (
  SELECT scene, row_key, col, tkm = tp OR tkn = tp AS still,
         CAST(CASE WHEN tkm = tp AND tkn = tp THEN 0.5
              ELSE abs(tkn - tp) / (abs(tkm - tp) + abs(tkn - tp)) END AS DOUBLE) AS tm
  FROM sums)"""


def _slopes(slope: str) -> str:
    x, y = ("fine", "coarse") if slope == "coarse_on_fine" else ("coarse", "fine")
    return f"""
pairs AS (
  SELECT scene, row_key, col, near_{x}1 AS x, near_{y}1 AS y FROM sim
  UNION ALL
  SELECT scene, row_key, col, near_{x}2, near_{y}2 FROM sim),
fits AS (
  SELECT scene, row_key, col, count(*) AS n, sum(x) AS sx, sum(y) AS sy,
         sum(CAST(x AS BIGINT) * y) AS sxy, sum(CAST(x AS BIGINT) * x) AS sxx
  FROM pairs GROUP BY scene, row_key, col),
slopes AS (
  SELECT scene, row_key, col, CAST(coalesce(n, 0) // 2 AS BIGINT) AS n_similar,
         CASE WHEN n IS NULL OR n * sxx = sx * sx THEN 1.0
              ELSE CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) END AS v
  FROM pix LEFT JOIN fits USING (scene, row_key, col))"""


_PREDICTED = """
changes AS (
  SELECT scene, row_key, col, sum(w * (near_coarse0 - near_coarse1)) AS cm,
         sum(w * (near_coarse0 - near_coarse2)) AS cn
  FROM weighed GROUP BY scene, row_key, col),
predicted AS (
  SELECT scene, row_key, col, fine1 + v * coalesce(cm, 0) AS pred_m,
         fine2 + v * coalesce(cn, 0) AS pred_n
  FROM pix JOIN slopes USING (scene, row_key, col)
           LEFT JOIN changes USING (scene, row_key, col))"""

_FUSED = """
fused AS (
  SELECT scene, row_key, col, tm * pred_m + tn * pred_n AS fused
  FROM predicted JOIN timed USING (scene, row_key, col))"""


def _fusion(num_class=4, slope="coarse_on_fine", zero_change="limit") -> list[str]:
    return [
        _PIX,
        _NEAR,
        _thresholds(num_class),
        _SIMILAR,
        _WEIGHED,
        _BLOCK_SUMS,
        _temporal(zero_change),
        _slopes(slope),
        _PREDICTED,
        _FUSED,
    ]


def _with(parts, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _line(value: str) -> str:
    return f"string_agg(CAST({value} AS VARCHAR), ',' ORDER BY col)"


_STACK_TEXT = ", ".join(f"{_line(b)} AS {b}" for b in BANDS)
_STACK_LINES = f"SELECT scene, row_key, {_STACK_TEXT} FROM pix GROUP BY scene, row_key"

# All scenes below each other; a wide file has all columns, so cells that the
# last line lacks are 0.
_SHEET = """
sheet AS (
  SELECT CAST(line AS INTEGER) AS row_key, col,
         coalesce(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 400 + 300 * cls + noise END, 0) AS px
  FROM (SELECT line, CAST(c AS INTEGER) AS col
        FROM (SELECT DISTINCT line FROM placed), range(128) AS r(c))
       LEFT JOIN classed USING (line, col))"""
_WIDE = _with(
    [_PIX, _SHEET],
    f"""SELECT 's0' AS scene, 'fine1' AS band, row_key, {_line('px')} AS cells
FROM sheet GROUP BY row_key""",
)

# The same sheet as one scene with five bands, for the fusion of wide files.
_SHEET_PIX = """
cells AS (
  SELECT CAST(line AS INTEGER) AS row_key, CAST(c AS INTEGER) AS col
  FROM (SELECT DISTINCT line FROM placed), range(128) AS r(c)),
lined AS (
  SELECT CAST(row_key + 60 * ((1 << CAST(substr(scene, 2) AS INTEGER)) - 1) AS INTEGER)
           AS row_key, * EXCLUDE (scene, row_key)
  FROM scene_pix),
pix AS (
  SELECT 's0' AS scene, row_key, col, coalesce(fine1, 0) AS fine1, coalesce(fine2, 0) AS fine2,
         coalesce(coarse1, 0) AS coarse1, coalesce(coarse2, 0) AS coarse2,
         coalesce(coarse0, 0) AS coarse0
  FROM cells LEFT JOIN lined USING (row_key, col))"""


def _scaled_line(value: str) -> str:
    return _line(f"CAST(round({value} * 1000000) AS BIGINT)")


_FUSED_CELLS = "SELECT scene, row_key, col, round(fused, 6) AS fused FROM fused"
_FLOAT_LINES = f"""SELECT scene, row_key,
  {_scaled_line('CAST(CAST(fused AS FLOAT) AS DOUBLE)')} AS cells
FROM fused GROUP BY scene, row_key"""
_FUSED_LINES = f"""SELECT scene, row_key, {_scaled_line('fused')} AS cells
FROM fused GROUP BY scene, row_key"""

_LINES = """
lines AS (SELECT DISTINCT scene, row_key FROM pix)"""
_WINDOWED = """SELECT a.scene, a.row_key, count(*) AS n_lines, min(b.row_key) AS base_key,
       string_agg(CAST(b.row_key AS VARCHAR), ',' ORDER BY b.row_key) AS keys
FROM lines a JOIN lines b
  ON b.scene = a.scene AND b.row_key BETWEEN a.row_key AND a.row_key + 4
GROUP BY a.scene, a.row_key"""

_PATCHES = """
patches AS (
  SELECT scene, CAST(row_key // 8 AS BIGINT) AS patch_row, CAST(col // 8 AS BIGINT) AS patch_col,
         row_key, col, fine1, coarse1
  FROM pix),
lines_of AS (
  SELECT scene, patch_row, patch_col, count(*) AS n,
         CASE WHEN count(*) >= 2 AND min(fine1) < max(fine1)
              THEN regr_slope(coarse1, fine1) END AS slope,
         CASE WHEN count(*) >= 2 AND min(fine1) < max(fine1)
              THEN regr_intercept(coarse1, fine1) END AS intercept
  FROM patches GROUP BY scene, patch_row, patch_col)"""

_SIMILAR_PARTS = [_PIX, _NEAR, _thresholds(4), _SIMILAR]
_NEAR_COLUMNS = """scene, row_key, col, dr, dc, fine1, fine2, coarse1, coarse2, coarse0,
  near_fine1, near_fine2, near_coarse1, near_coarse2, near_coarse0"""

_RAISED = """
pix AS (
  SELECT scene, row_key, col, """ + ", ".join(
    f"CASE WHEN {b} = 0 THEN 0 ELSE {b} + 20000000 END AS {b}" for b in BANDS
) + """
  FROM small_pix)"""
_STRETCHED = """
pix AS (
  SELECT scene, row_key, col, """ + ", ".join(
    f"CASE WHEN {b} = 0 THEN 0 ELSE (CAST({b} AS BIGINT) - 950) * 3300000 END AS {b}" for b in BANDS
) + """
  FROM small_pix)"""
# The product of two differences over the whole range would not fit a bigint; its sign does.
_SIGN = "sign(near_fine1 - near_fine2) * sign(near_coarse1 - near_coarse2)"
_WEIGHED_FAR = f"""
rated AS (
  SELECT *, CAST({_SIGN} AS DOUBLE) AS r, 1 + sqrt(dr * dr + dc * dc) / 2 AS d FROM sim),
""" + _WEIGHED[_WEIGHED.index("weighed AS") :]
_RAGGED = """
pix AS (SELECT * FROM all_pix WHERE col < 128 - row_key * 7 % 50)"""

ORACLE = {
    "rows_from_wide": _WIDE,
    "write_roundtrip": _WIDE,
    "fusion_job": _with(
        [_PIX.replace("\npix AS", "\nscene_pix AS"), _SHEET_PIX, *_fusion()[1:]], _FUSED_LINES
    ),
    "raster_shape": _with(
        [_PIX, _BAND_PIX],
        """SELECT scene, band, 2 AS n_dims, count(DISTINCT row_key) AS n_rows,
       max(col) + 1 AS n_cols, count(*) AS n_cells
FROM band_pix GROUP BY scene, band""",
    ),
    "first_row": _with([_PIX], _STACK_LINES + " ORDER BY scene, row_key LIMIT 1"),
    "truncate_pixels": """SELECT o_orderkey, CAST(CASE
    WHEN o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 OR o_orderkey % 52 = 0 THEN 0
    ELSE trunc(o_totalprice - 250000) END AS INTEGER) AS px
FROM orders""",
    "pack_rows": _with(
        [_PIX],
        """SELECT scene, row_key,
  string_agg(printf('%08X', fine1), '' ORDER BY col) || printf('%08X', row_key) AS value
FROM pix GROUP BY scene, row_key""",
    ),
    "unpack_rows": _with(
        [_PIX],
        f"SELECT scene, row_key, {_line('fine2')} AS cells FROM pix GROUP BY scene, row_key",
    ),
    "pixels_long": _with([_PIX], "SELECT * FROM pix"),
    "assemble_stack": _with([_PIX], _STACK_LINES),
    "lines_to_stack": _with([_PIX], _STACK_LINES),
    "range_layout": _with(
        [_PIX],
        """SELECT scene, row_key, CAST(count(*) AS INTEGER) AS n_cells
FROM pix GROUP BY scene, row_key""",
    ),
    "image_mean": _with(
        [_PIX, _BAND_PIX],
        "SELECT scene, band, round(avg(px), 6) AS mean FROM band_pix GROUP BY scene, band",
    ),
    "image_stddev": _with(
        [_PIX, _BAND_PIX],
        "SELECT scene, band, round(stddev_pop(px), 6) AS stddev FROM band_pix GROUP BY scene, band",
    ),
    "similarity_threshold": _with([_PIX, _thresholds(4)], "SELECT scene, t1, t2 FROM limits"),
    "window_rows": _with([_PIX, _LINES], _WINDOWED),
    "line_in_window": _with(
        [_PIX, _LINES],
        f"""SELECT a.scene, a.row_key, {_line('coarse0')} AS cells
FROM lines a JOIN pix b ON b.scene = a.scene AND b.row_key = a.row_key + 3
GROUP BY a.scene, a.row_key""",
    ),
    "neighbors": _with([_PIX, _NEAR], f"SELECT {_NEAR_COLUMNS} FROM near"),
    "window_sums": _with([_PIX, _NEAR, _BLOCK_SUMS], "SELECT * FROM sums"),
    "similar_pixels": _with(_SIMILAR_PARTS, f"SELECT {_NEAR_COLUMNS}, t1, t2 FROM sim"),
    "spectral_corr": _with(
        [*_SIMILAR_PARTS, _WEIGHED], "SELECT scene, row_key, col, dr, dc, r FROM rated"
    ),
    "spatial_distance": _with(
        [*_SIMILAR_PARTS, _WEIGHED],
        "SELECT scene, row_key, col, dr, dc, round(d, 6) AS d FROM rated",
    ),
    "weights": _with(
        [*_SIMILAR_PARTS, _WEIGHED],
        "SELECT scene, row_key, col, dr, dc, round(w, 6) AS w FROM weighed",
    ),
    "conversion_slope": _with(
        [*_SIMILAR_PARTS, _slopes("coarse_on_fine")],
        "SELECT scene, row_key, col, n_similar, round(v, 6) AS v FROM slopes",
    ),
    "temporal_weights": _with(
        [_PIX, _NEAR, _BLOCK_SUMS, _SHARES], "SELECT scene, row_key, col, tm, 1 - tm AS tn FROM shares"
    ),
    "temporal_weights_zero": _with(
        [_PIX, _NEAR, _BLOCK_SUMS, _SHARES],
        """SELECT scene, row_key, col, CASE WHEN still THEN 0.0::DOUBLE ELSE tm END AS tm,
       CASE WHEN still THEN 0.0::DOUBLE ELSE 1 - tm END AS tn
FROM shares""",
    ),
    "date_predictions": _with(
        _fusion()[:-1],
        """SELECT scene, row_key, col, round(pred_m, 4) AS pred_m, round(pred_n, 4) AS pred_n
FROM predicted""",
    ),
    "fused": _with(_fusion(), _FUSED_CELLS),
    "fused_expr": _with(_fusion(), _FUSED_CELLS),
    "fused_by_sql": _with(_fusion(), _FUSED_CELLS),
    "fused_by_group": _with(_fusion(), _FUSED_CELLS),
    "fused_with_moments": _with(_fusion(), _FUSED_CELLS),
    "tiles_in_box": _with(
        [_PIX],
        """SELECT scene, row_key, col, fine1 FROM pix
WHERE row_key BETWEEN 40 AND 90 AND col BETWEEN 20 AND 70""",
    ),
    "rows_from_very_wide": _WIDE,
    "fused_published_slope": _with(_fusion(slope="fine_on_coarse"), _FUSED_CELLS),
    "fused_zero_change": _with(_fusion(zero_change="zero"), _FUSED_CELLS),
    "fused_six_classes": _with(_fusion(num_class=6), _FUSED_CELLS),
    "fused_rows": _with(_fusion(), _FLOAT_LINES),
    "fused_packed": _with(_fusion(), _FLOAT_LINES),
    "fused_packed_tiles": _with(_fusion(), _FLOAT_LINES),
    "fused_preview": _with(_fusion(), _FUSED_LINES + " ORDER BY scene, row_key LIMIT 20"),
    "regression_fit": _with(
        [_PIX, _PATCHES],
        """SELECT scene, patch_row, patch_col, round(intercept, 5) AS intercept,
       round(slope, 6) AS slope, n
FROM lines_of""",
    ),
    "regression_eval": _with(
        [_PIX, _PATCHES],
        """SELECT scene, row_key, col, round(intercept + slope * fine1, 6) AS yhat
FROM patches JOIN lines_of USING (scene, patch_row, patch_col)""",
    ),
    "fused_large_values": _with(
        [_PIX.replace("\npix AS", "\nsmall_pix AS"), _RAISED, *_fusion()[1:]],
        "SELECT scene, row_key, col, round(fused, 4) AS fused FROM fused",
    ),
    "fused_extreme_values": _with(
        [
            _PIX.replace("\npix AS", "\nsmall_pix AS"),
            _STRETCHED,
            *(_WEIGHED_FAR if part is _WEIGHED else part for part in _fusion()[1:]),
        ],
        "SELECT scene, row_key, col, CAST(round(fused / 1000) AS BIGINT) AS fused FROM fused",
    ),
    "pack_unpack_nulls": _with(
        [_PIX],
        f"""SELECT scene, row_key, CASE WHEN row_key % 7 <> 0
  THEN {_line('CASE WHEN col % 11 = 0 THEN 0 ELSE fine1 END')} END AS cells
FROM pix GROUP BY scene, row_key""",
    ),
    "window_sums_ragged": _with(
        [_PIX.replace("\npix AS", "\nall_pix AS"), _RAGGED, _NEAR, _BLOCK_SUMS], "SELECT * FROM sums"
    ),
    "single_cell": _with(
        [_PIX, _LINES],
        """SELECT l.scene, l.row_key, coalesce(fine1, 0) AS px
FROM lines l LEFT JOIN pix p
  ON p.scene = l.scene AND p.row_key = l.row_key AND p.col = l.row_key * 3 % 160""",
    ),
    "range_layout_order": _with(
        [_PIX, _LINES],
        """SELECT count(*) AS n_lines, 0::BIGINT AS n_overlapping, 0::BIGINT AS n_unsorted
FROM lines""",
    ),
    "image_without_key": _WIDE,
    "assemble_stored": _with([_PIX], _STACK_LINES),
    "block_sums": _with([_PIX, _NEAR, _BLOCK_SUMS], "SELECT * FROM sums"),
    "regression_global": _with(
        [_PIX],
        """SELECT scene, row_key, col, round(intercept + slope * fine1, 6) AS yhat
FROM pix, (SELECT regr_slope(coarse1, fine1) AS slope,
                  regr_intercept(coarse1, fine1) AS intercept FROM pix)""",
    ),
    "regression_few_points": """WITH points AS (
  SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS grp,
         CASE WHEN o_custkey % 10 = 1 THEN 7 ELSE o_orderkey % 100 END AS x,
         floor(o_totalprice) / 7.13::DOUBLE AS y
  FROM orders),
lines_of AS (
  SELECT grp, CASE WHEN count(*) >= 2 AND min(x) < max(x) THEN regr_slope(y, x) END AS slope,
         CASE WHEN count(*) >= 2 AND min(x) < max(x) THEN regr_intercept(y, x) END AS intercept
  FROM points GROUP BY grp)
SELECT o_orderkey, round(intercept + slope * x, 4) AS yhat
FROM points p JOIN lines_of l ON p.grp IS NOT DISTINCT FROM l.grp""",
}
