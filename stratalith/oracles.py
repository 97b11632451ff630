"""DuckDB SQL for the queries of registry.QUERIES that SQL can express."""

from __future__ import annotations

from .fixtures import FLAGS, KINDS, TRIANGLES
from .options import CellModel, Correlation

ORACLES: dict[str, str] = {}


def q(x: str, unit: str = "1e-6") -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) / {unit} + 501e-3) AS BIGINT)"


def _number(column: str, names: tuple[str, ...]) -> str:
    return f"CAST(list_position([{', '.join(repr(x) for x in names)}], {column}) - 1 AS INTEGER)"


LOGS = f"""raw AS (SELECT {_number("event_type", KINDS)} AS log_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS DOUBLE) AS md, value FROM events),
c AS (SELECT log_id, md, avg(CASE WHEN value NOT IN (-999.25, -999, 999.25) THEN value END) AS value FROM raw WHERE md IS NOT NULL GROUP BY log_id, md HAVING avg(CASE WHEN value NOT IN (-999.25, -999, 999.25) THEN value END) IS NOT NULL)"""
GAPS = "g AS (SELECT * FROM (SELECT log_id, md, lead(md) OVER w AS next_md, lead(md) OVER w - md AS gap FROM c WINDOW w AS (PARTITION BY log_id ORDER BY md)) WHERE next_md IS NOT NULL)"
STEPS = "s AS (SELECT log_id, median(gap) AS step FROM g GROUP BY log_id)"
# hours and a step of 0.7: rounding stays far below the tolerance of the grid's end
def _grid(step: str) -> str:
    return f"""e AS (SELECT log_id, min(md) AS top, max(md) AS bottom FROM c GROUP BY log_id),
gp AS (SELECT *, CAST(floor((bottom - top) / {step} + 1e-9) AS BIGINT) AS k FROM e),
p2 AS (SELECT *, abs(top + k * {step} - bottom) > 1e-9 AS more FROM gp),
grid AS (SELECT log_id, CAST(i AS INTEGER) AS idx, CASE WHEN i = k + CAST(more AS INTEGER) THEN bottom ELSE top + i * {step} END AS md FROM p2, LATERAL (SELECT unnest(range(0, k + 1 + CAST(more AS INTEGER))) AS i))"""


GRID = _grid("7e-1")
KNOTS = "kn AS (SELECT log_id, md AS a, value AS va, lead(md) OVER w AS b, lead(value) OVER w AS vb FROM c WINDOW w AS (PARTITION BY log_id ORDER BY md))"
RESAMPLED = "r AS (SELECT grid.log_id, idx, md, CASE WHEN b IS NULL OR a = md THEN va ELSE (vb - va) / (b - a) * (md - a) + va END AS value FROM grid ASOF JOIN kn ON grid.log_id = kn.log_id AND grid.md >= kn.a)"


def _normal(rows: str, clip: str = "") -> str:
    scaled = f"""m AS (SELECT *, min(value) OVER w / 2 + max(value) OVER w / 2 AS mid FROM {rows} WINDOW w AS (PARTITION BY log_id)),
s1 AS (SELECT *, (value - mid) / max(abs(value - mid)) OVER (PARTITION BY log_id) AS s0 FROM m),"""
    cut = f"s2 AS (SELECT *, {clip or 's0'} AS s FROM s1)," if not clip else f"lim AS (SELECT log_id, quantile_cont(s0, 5e-2) AS lo, quantile_cont(s0, 95e-2) AS hi FROM s1 GROUP BY log_id), s2 AS (SELECT s1.*, least(greatest(s0, lo), hi) AS s FROM s1 JOIN lim USING (log_id)),"
    return scaled + cut + "z AS (SELECT *, (s - avg(s) OVER w) / stddev_pop(s) OVER w AS z FROM s2 WINDOW w AS (PARTITION BY log_id))"


ORACLES["log_clean"] = f"WITH {LOGS} SELECT log_id, CAST(md AS BIGINT) AS md, {q('value')} AS value FROM c"
ORACLES["numeric_parse"] = r"""
WITH t AS (SELECT event_id, CAST(event_id AS VARCHAR) AS n, event_id % 8 AS k FROM events),
s AS (SELECT event_id, CASE k WHEN 0 THEN '  1 ' || n || ',5 ' WHEN 1 THEN n || chr(160) || '000,25' WHEN 2 THEN n || ',234.5' WHEN 3 THEN n || 'd' WHEN 4 THEN '' WHEN 5 THEN 'NA' WHEN 6 THEN '-' || n || '.5e2' ELSE 'x' || n END AS x FROM t),
b AS (SELECT event_id, replace(replace(replace(trim(x), chr(160), ''), ' ', ''), ',', '.') AS x FROM s)
SELECT event_id, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END AS number FROM b
"""
ORACLES["median_steps"] = f"WITH {LOGS}, {GAPS}, {STEPS} SELECT * FROM s"
ORACLES["common_step"] = f"WITH {LOGS}, {GAPS}, {STEPS} SELECT median(step) AS step FROM s WHERE isfinite(step) AND step > 0"
ORACLES["gap_check"] = f"WITH {LOGS}, {GAPS} SELECT log_id, md, next_md, gap FROM g WHERE gap > 1.5 + 1e-9 QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY gap DESC, md) = 1"
ORACLES["regular_grid"] = f"WITH {LOGS}, {GRID} SELECT log_id, idx, {q('md')} AS md FROM grid"
ORACLES["resample_linear"] = f"WITH {LOGS}, {GRID}, {KNOTS}, {RESAMPLED} SELECT log_id, idx, {q('value')} AS value FROM r"
ORACLES["normalize"] = f"WITH {LOGS}, {_normal('c')} SELECT log_id, CAST(md AS BIGINT) AS md, {q('z')} AS z FROM z"
ORACLES["normalize_clipped"] = f"WITH {LOGS}, {_normal('c', 'x')} SELECT log_id, CAST(md AS BIGINT) AS md, {q('z')} AS z FROM z"
ORACLES["prepare_logs"] = f"WITH {LOGS}, {GRID}, {KNOTS}, {RESAMPLED}, {_normal('r')} SELECT log_id, idx, {q('md')} AS md, {q('z')} AS z FROM z"
ORACLES["well_pairs"] = "SELECT * FROM (SELECT s_suppkey AS pair, s_suppkey AS left_id, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS right_id FROM supplier) WHERE right_id IS NOT NULL"
ORACLES["well_names"] = """
WITH s AS (SELECT s_suppkey AS log_id, 'field ' || s_suppkey AS parent, CASE s_suppkey % 3 WHEN 0 THEN 'field ' || s_suppkey WHEN 1 THEN 'Same' ELSE s_name END AS own FROM supplier)
SELECT log_id, CASE WHEN count(*) OVER (PARTITION BY lower(own)) > 1 THEN parent ELSE own END AS name FROM s
"""
ORACLES["corridor_cells"] = """
WITH s AS (SELECT p_partkey AS pair, p_size % 12 + 2 AS n, p_partkey % 9 + 2 AS m FROM part),
b AS (SELECT *, CAST(floor(CAST(0.1 AS DOUBLE) * ((n - 1) * (m - 1)) + CAST(0.5 AS DOUBLE) * greatest(n - 1, m - 1)) AS BIGINT) AS band FROM s)
SELECT pair, CAST(i AS INTEGER) AS i, j FROM b, LATERAL (SELECT unnest(range(0, n)) AS i) x, LATERAL (SELECT unnest(range(0, m)) AS j) y WHERE abs(i * (m - 1) - j * (n - 1)) <= band
"""
SERIES = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
ORACLES["local_cost"] = f"""
WITH {SERIES}, p AS (SELECT x.vec_id AS pair, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
k AS (SELECT pair, a, b, len(a) AS n, len(b) AS m, unnest(range(0, len(a))) AS i FROM p),
c AS (SELECT *, unnest(range(0, m)) AS j FROM k)
SELECT pair, CAST(i AS INTEGER) AS i, count(*) AS cells, {q("sum(abs(a[i + 1] - b[j + 1]))")} AS cost FROM c
WHERE abs(i * (m - 1) - j * (n - 1)) <= floor(CAST(0.1 AS DOUBLE) * ((n - 1) * (m - 1)) + CAST(0.5 AS DOUBLE) * greatest(n - 1, m - 1)) GROUP BY pair, i
"""

# A row of cells is folded from the row above; a cell holds its cost, its length and the moves that lead to it.
CANDIDATE = "struct_pack(c := {c}, l := {l}, k := {k}, p := {p})"
FAR = CANDIDATE.format(c="CAST('inf' AS DOUBLE)", l="1000000", k="9", p="''")


def _step(cell: str, penalty: str, k: int, move: str) -> str:
    return CANDIDATE.format(c=f"{cell}.c + {penalty}", l=f"{cell}.l", k=k, p=f"{cell}.p || '{move}'")


_BEST = f"list_sort([CASE WHEN j > 0 THEN {_step('f.row[j]', '0', 1, 'D')} ELSE {FAR} END, {_step('f.row[j + 1]', '5e-2', 2, 'U')}, CASE WHEN j > 0 THEN {_step('acc[j]', '5e-2', 3, 'L')} ELSE {FAR} END])[1]"
_ROW = f"""list_reduce(list_concat([CAST([] AS STRUCT(c DOUBLE, l INTEGER, k INTEGER, p VARCHAR)[])], list_transform(range(0, m), lambda j: [struct_pack(c := CAST(j AS DOUBLE), l := 0, k := 0, p := '')])),
  lambda acc, x: list_append(acc, list_transform([CAST(x[1].c AS BIGINT)], lambda j: CASE WHEN abs((f.i + 1) * (m - 1) - j * (n - 1)) > band THEN {FAR} ELSE
    list_transform([{_BEST}], lambda b: struct_pack(c := b.c + abs(r[f.i + 2] - s[j + 1]), l := b.l + 1, k := b.k, p := b.p))[1] END)[1]))"""
_FIRST = f"""list_reduce(list_concat([CAST([] AS STRUCT(c DOUBLE, l INTEGER, k INTEGER, p VARCHAR)[])], list_transform(range(0, m), lambda j: [struct_pack(c := CAST(j AS DOUBLE), l := 0, k := 0, p := '')])),
  lambda acc, x: list_append(acc, list_transform([CAST(x[1].c AS BIGINT)], lambda j: CASE WHEN j * (n - 1) > band THEN {FAR} WHEN j = 0 THEN {CANDIDATE.format(c="abs(r[1] - s[1])", l="1", k="0", p="''")}
    ELSE {CANDIDATE.format(c="acc[j].c + 5e-2 + abs(r[1] - s[j + 1])", l="acc[j].l + 1", k="3", p="acc[j].p || 'L'")} END)[1]))"""
PAIRS = f"{SERIES}, p AS (SELECT x.vec_id AS pair, x.v AS a, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)"
WARPED = f"""d AS (SELECT *, list_filter(range(1, len(a) + 1), lambda k: a[k] <> b[k])[1] AS f FROM p),
o AS (SELECT pair, CASE WHEN len(a) <> len(b) THEN len(a) < len(b) ELSE coalesce(a[f] < b[f], false) END AS swap, a, b FROM d),
t AS (SELECT pair, swap, r, s, len(r) AS n, len(s) AS m FROM (SELECT pair, swap, CASE WHEN swap THEN b ELSE a END AS r, CASE WHEN swap THEN a ELSE b END AS s FROM o)),
u AS (SELECT *, CAST(floor(CAST(0.1 AS DOUBLE) * ((n - 1) * (m - 1)) + CAST(0.5 AS DOUBLE) * greatest(n - 1, m - 1)) AS BIGINT) AS band FROM t),
f(pair, i, row) AS (
  SELECT pair, CAST(0 AS BIGINT), {_FIRST} FROM u
  UNION ALL
  SELECT f.pair, f.i + 1, {_ROW} FROM f JOIN u ON u.pair = f.pair WHERE f.i + 1 < n),
last AS (SELECT pair, swap, r, s, n, m, band, row[m] AS x FROM f JOIN u USING (pair) WHERE f.i = n - 1),
mv AS (SELECT pair, CASE WHEN swap THEN s ELSE r END AS a, CASE WHEN swap THEN r ELSE s END AS b, CASE WHEN swap THEN m ELSE n END AS n, CASE WHEN swap THEN n ELSE m END AS m, band, 'S' || CASE WHEN swap THEN translate(x.p, 'UL', 'LU') ELSE x.p END AS p FROM last),
st AS (SELECT *, k - 1 AS path_index, p[k] AS mv FROM (SELECT *, unnest(range(1, length(p) + 1)) AS k FROM mv)),
ij AS (SELECT *, CAST(sum(CAST(mv IN ('D', 'U') AS INTEGER)) OVER w AS BIGINT) AS i, CAST(sum(CAST(mv IN ('D', 'L') AS INTEGER)) OVER w AS BIGINT) AS j FROM st WINDOW w AS (PARTITION BY pair ORDER BY path_index ROWS UNBOUNDED PRECEDING)),
rows AS (SELECT pair, path_index, i, j, mv, abs(a[i + 1] - b[j + 1]) AS local_cost, path_index > 0 AND path_index < length(p) - 1 AND (j = greatest(0, CAST(ceil((i * (m - 1) - band) / (n - 1)) AS BIGINT)) OR j = least(m - 1, CAST(floor((i * (m - 1) + band) / (n - 1)) AS BIGINT))) AS boundary_hit FROM ij),
runs AS (SELECT pair, mv, count(*) AS c FROM (SELECT *, path_index - row_number() OVER (PARTITION BY pair, mv ORDER BY path_index) AS g FROM rows) GROUP BY pair, mv, g),
run AS (SELECT pair, CAST(coalesce(max(c) FILTER (mv IN ('U', 'L')), 0) AS INTEGER) AS max_warp_run FROM runs GROUP BY pair),
qc AS (SELECT pair, count(*) AS path_length, sum(local_cost) + 5e-2 * count(*) FILTER (mv IN ('U', 'L')) AS total, avg(local_cost) AS mean, avg(CAST(boundary_hit AS DOUBLE)) AS bf,
  CAST(count(*) FILTER (mv = 'D') AS INTEGER) AS diagonal_steps, CAST(count(*) FILTER (mv = 'U') AS INTEGER) AS up_steps, CAST(count(*) FILTER (mv = 'L') AS INTEGER) AS left_steps FROM rows GROUP BY pair)"""
ORACLES["dtw_fold"] = f"WITH RECURSIVE {PAIRS}, {WARPED} SELECT pair, {q('total')} AS total_cost, path_length FROM qc"
ORACLES["dtw_cost"] = f"WITH RECURSIVE {PAIRS}, {WARPED} SELECT pair, {q('total')} AS total_cost, path_length, diagonal_steps, up_steps, left_steps, max_warp_run, {q('total / path_length')} AS normalized_cost FROM qc JOIN run USING (pair)"
ORACLES["dtw_path"] = f"""WITH RECURSIVE {PAIRS}, {WARPED}
SELECT pair, CAST(path_index AS INTEGER) AS path_index, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE mv WHEN 'S' THEN 'start' WHEN 'D' THEN 'diagonal' WHEN 'U' THEN 'up' ELSE 'left' END AS move,
       {q("sum(local_cost + CASE WHEN mv IN ('U', 'L') THEN 5e-2 ELSE 0 END) OVER (PARTITION BY pair ORDER BY path_index ROWS UNBOUNDED PRECEDING)")} AS cumulative_cost, boundary_hit FROM rows"""
ORACLES["dtw_path_quality"] = f"""WITH RECURSIVE {PAIRS}, {WARPED}
SELECT pair, path_length, {q("total")} AS total_cost, {q("total / path_length")} AS normalized_cost, {q("mean")} AS mean_local_cost, {q("bf")} AS boundary_fraction, diagonal_steps, up_steps, left_steps, max_warp_run FROM qc JOIN run USING (pair)"""

_Q = {x: q(x) for x in ("left_md", "right_md", "left_z", "right_z", "local_cost", "mean_cost", "cumulative_cost", "total_cost", "normalized_cost", "warp_penalty", "boundary_fraction")}
ORACLES["correlate_table"] = f"""WITH RECURSIVE {LOGS}, {_grid("3")}, {KNOTS}, {RESAMPLED}, {_normal("r")},
wl AS (SELECT CAST(log_id AS BIGINT) AS k, list_extract([{", ".join(repr(x) for x in KINDS)}], log_id + 1) AS name, list(md ORDER BY idx) AS mds, list(floor(z * 1048576 + 5e-1) / 1048576 ORDER BY idx) AS zs FROM z GROUP BY log_id),
p AS (SELECT x.k AS pair, x.zs AS a, y.zs AS b FROM wl x JOIN wl y ON y.k = x.k + 1), {WARPED.replace('5e-2', '625e-4')},
tab AS (
  SELECT rows.pair, x.name AS left_well, y.name AS right_well, x.mds[i + 1] AS left_md, y.mds[j + 1] AS right_md, x.zs[i + 1] AS left_z, y.zs[j + 1] AS right_z, local_cost, mean AS mean_cost,
         CAST(path_index AS INTEGER) AS path_index, CASE mv WHEN 'S' THEN 'start' WHEN 'D' THEN 'diagonal' WHEN 'U' THEN 'up' ELSE 'left' END AS move,
         sum(local_cost + CASE WHEN mv IN ('U', 'L') THEN 625e-4 ELSE 0 END) OVER (PARTITION BY rows.pair ORDER BY path_index ROWS UNBOUNDED PRECEDING) AS cumulative_cost,
         total AS total_cost, total / path_length AS normalized_cost, 625e-4 AS warp_penalty, diagonal_steps, up_steps, left_steps, max_warp_run, boundary_hit, bf AS boundary_fraction
  FROM rows JOIN qc ON qc.pair = rows.pair JOIN run ON run.pair = rows.pair JOIN wl x ON x.k = rows.pair JOIN wl y ON y.k = rows.pair + 1)
SELECT * REPLACE ({", ".join(f"{v} AS {k}" for k, v in _Q.items())}) FROM tab"""

POINTS = f"""pt AS (SELECT {_number("l_returnflag", FLAGS)} AS surface_id, l_quantity AS x, floor(l_discount * 100 + 5e-1) AS y, avg(l_extendedprice) AS value, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
points AS (SELECT *, CAST(y * 50 + x - 1 AS BIGINT) AS point_id FROM pt)"""
NODES = """nd AS (SELECT CAST(s AS INTEGER) AS surface_id, iy * 50 + ix AS node_id, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, 1 + ix * CAST(1 AS DOUBLE) AS x, iy * CAST(1 AS DOUBLE) AS y FROM range(3) a(s), range(50) b(ix), range(11) c(iy)),
flat AS (SELECT nd.surface_id, node_id, ix, iy, coalesce(value, 0) AS z FROM nd LEFT JOIN points p ON p.surface_id = nd.surface_id AND p.point_id = nd.node_id)"""
OFF = """off AS (SELECT surface_id, point_id, least(x + 3e-1, 50) AS x, least(y + 45e-2, 10) AS y, value, weight FROM points),
cell AS (SELECT *, least(floor(x - 1), 48) AS cx, least(floor(y), 9) AS cy FROM off),
fr AS (SELECT *, x - 1 - cx AS fx, y - cy AS fy FROM cell)"""
WEIGHTS = {
    CellModel.BILINEAR: "[(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]",
    CellModel.BOTTOM_LEFT_TO_TOP_RIGHT: "CASE WHEN fy <= fx THEN [1 - fx, fx - fy, 0, fy] ELSE [1 - fy, 0, fy - fx, fx] END",
    CellModel.BOTTOM_RIGHT_TO_TOP_LEFT: "CASE WHEN fx + fy <= 1 THEN [1 - fx - fy, fx, fy, 0] ELSE [0, 1 - fy, 1 - fx, fx + fy - 1] END",
}


def _stencils(model: CellModel) -> str:
    return f"""WITH {POINTS}, {NODES}, {OFF},
st AS (SELECT surface_id, point_id, value, weight, CAST(k AS INTEGER) AS corner, CAST((cy + k // 2) * 50 + cx + k % 2 AS BIGINT) AS node_id, ws[k + 1] AS coef FROM (SELECT *, {WEIGHTS[model]} AS ws FROM fr), range(4) r(k))"""


ORACLES["point_verdicts"] = f"""WITH {POINTS}, o AS (SELECT surface_id, point_id, x - 15e-1 AS x, y, CASE WHEN point_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value, weight * (point_id % 5 - 1) AS weight FROM points)
SELECT surface_id, point_id, CASE WHEN isnan(value) THEN 'not_finite' WHEN weight < 0 THEN 'negative_weight' WHEN weight = 0 THEN 'unused' WHEN x < 1 - 1e-9 OR x > 50 + 1e-9 THEN 'outside' ELSE 'ok' END AS verdict FROM o"""
for _m in CellModel:
    ORACLES[f"evaluate_{_m.value}"] = f"{_stencils(_m)} SELECT st.surface_id, point_id AS query_id, {q('sum(coef * z)')} AS z FROM st JOIN flat USING (surface_id, node_id) GROUP BY ALL"
ORACLES["stencil_rows"] = f"{_stencils(CellModel.BOTTOM_RIGHT_TO_TOP_LEFT)} SELECT surface_id, point_id, corner, node_id, {q('coef', '1e-9')} AS coef FROM st"
ORACLES["scatter_weights"] = f"{_stencils(CellModel.BILINEAR)} SELECT nd.surface_id, nd.node_id, {q('coalesce(sum(coef * weight), 0)')} AS z FROM nd LEFT JOIN st USING (surface_id, node_id) GROUP BY ALL"
ORACLES["constraint_stats"] = f"""{_stencils(CellModel.BILINEAR)}, r AS (SELECT surface_id, point_id, value, weight, sum(coef * z) - value AS r FROM st JOIN flat USING (surface_id, node_id) GROUP BY surface_id, point_id, value, weight)
SELECT surface_id, {q("max(abs(r))")} AS max_absolute, {q("max(abs(r) / greatest(1, abs(value)))", "1e-9")} AS max_relative, {q("sqrt(sum(weight * r * r) / sum(weight))")} AS weighted_rms, CAST(sum(weight) AS BIGINT) AS total_weight FROM r GROUP BY surface_id"""
ORACLES["support_groups"] = f"""{_stencils(CellModel.BOTTOM_LEFT_TO_TOP_RIGHT)}, s AS (SELECT surface_id, point_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS support FROM st WHERE coef > 1e-13 GROUP BY ALL)
SELECT surface_id, support, count(*) AS n FROM s GROUP BY ALL"""
ORACLES["mask_violations"] = f"{_stencils(CellModel.BOTTOM_RIGHT_TO_TOP_LEFT)} SELECT DISTINCT st.surface_id, point_id FROM st JOIN nd USING (surface_id, node_id) WHERE coef > 1e-13 AND ix + iy >= 50"
_UV = "SELECT surface_id, weight AS w, (x - 255e-1) / 245e-1 AS u, (y - 5) / 5 AS v, value AS z FROM points"
_SUMS = "SELECT surface_id, sum(w) AS n, sum(w*u) AS u, sum(w*v) AS v, sum(w*u*u) + 1e-12 * sum(w) AS uu, sum(w*u*v) AS uv, sum(w*v*v) + 1e-12 * sum(w) AS vv, sum(w*z) AS z, sum(w*u*z) AS uz, sum(w*v*z) AS vz FROM uv GROUP BY surface_id"
ORACLES["plane_fit"] = f"""WITH {POINTS}, uv AS ({_UV}), m AS ({_SUMS}),
d AS (SELECT *, n * (uu * vv - uv * uv) - u * (u * vv - uv * v) + v * (u * uv - uu * v) AS det FROM m)
SELECT surface_id, {q("(z * (uu * vv - uv * uv) - u * (uz * vv - uv * vz) + v * (uz * uv - uu * vz)) / det", "1e-4")} AS a,
       {q("(n * (uz * vv - uv * vz) - z * (u * vv - uv * v) + v * (u * vz - uz * v)) / det", "1e-4")} AS bx,
       {q("(n * (uu * vz - uz * uv) - u * (u * vz - uz * v) + z * (u * uv - uu * v)) / det", "1e-4")} AS by FROM d"""
ORACLES["plane_nodes"] = f"WITH {POINTS}, {NODES} SELECT surface_id, node_id, {q('3 + 2 * x - y')} AS z FROM nd"
ORACLES["variance_estimate"] = f"""WITH {POINTS}, r AS (SELECT surface_id, value, weight AS w, value - x * 700 AS r FROM points), m AS (SELECT surface_id, sum(w * r) / sum(w) AS m FROM r GROUP BY surface_id)
SELECT surface_id, {q("greatest(sum(w * (r - m) * (r - m)) / sum(w), greatest(1, max(abs(value))) ** 2 * 1e-12)", "1e-2")} AS variance FROM r JOIN m USING (surface_id) GROUP BY surface_id"""
# In units of the larger extent, 49, both steps are 1/49: dxx and dyy weigh 49^2, dxy twice that.
ORACLES["curvature_apply"] = f"""WITH {POINTS}, {NODES},
t AS (
  SELECT surface_id, iy, ix, 2401 AS s, [ix - 1, ix, ix + 1] AS xs, [iy, iy, iy] AS ys, [1, -2, 1] AS cs FROM nd WHERE ix BETWEEN 1 AND 48
  UNION ALL SELECT surface_id, iy, ix, 2401, [ix, ix, ix], [iy - 1, iy, iy + 1], [1, -2, 1] FROM nd WHERE iy BETWEEN 1 AND 9
  UNION ALL SELECT surface_id, iy, ix, 4802, [ix, ix + 1, ix, ix + 1], [iy, iy, iy + 1, iy + 1], [1, -1, -1, 1] FROM nd WHERE ix < 49 AND iy < 10),
k AS (SELECT row_number() OVER () AS id, * FROM t),
x AS (SELECT id, surface_id, s, unnest(xs) AS ix, unnest(ys) AS iy, unnest(cs) AS c FROM k),
d AS (SELECT id, sum(c * z) AS d FROM x JOIN flat USING (surface_id, ix, iy) GROUP BY id)
SELECT surface_id, CAST(iy * 50 + ix AS BIGINT) AS node_id, {q("sum(s * c * d)", "1e-1")} AS kz FROM x JOIN d USING (id) GROUP BY ALL"""
_DIAGONAL = """t AS (
  SELECT surface_id, 2401 AS s, [ix - 1, ix, ix + 1] AS xs, [iy, iy, iy] AS ys, [1, -2, 1] AS cs FROM nd WHERE ix BETWEEN 1 AND 48
  UNION ALL SELECT surface_id, 2401, [ix, ix, ix], [iy - 1, iy, iy + 1], [1, -2, 1] FROM nd WHERE iy BETWEEN 1 AND 9
  UNION ALL SELECT surface_id, 4802, [ix, ix + 1, ix, ix + 1], [iy, iy, iy + 1, iy + 1], [1, -1, -1, 1] FROM nd WHERE ix < 49 AND iy < 10),
dg AS (SELECT surface_id, CAST(iy * 50 + ix AS BIGINT) AS node_id, CAST(sum(s * c * c) AS DOUBLE) AS d FROM (SELECT surface_id, s, unnest(xs) AS ix, unnest(ys) AS iy, unnest(cs) AS c FROM t) GROUP BY ALL)"""
ORACLES["curvature_diagonal"] = f"WITH {POINTS}, {NODES}, {_DIAGONAL} SELECT surface_id, node_id, {q('d', '1e-3')} AS d FROM dg"
ORACLES["curvature_scale"] = f"WITH {POINTS}, {NODES}, {_DIAGONAL} SELECT surface_id, {q('avg(d)', '1e-3')} AS scale FROM dg WHERE d > 0 GROUP BY surface_id"
ORACLES["level_resample"] = f"""WITH {POINTS}, {NODES},
t AS (SELECT CAST(s AS INTEGER) AS surface_id, jy * 26 + jx AS node_id, jx * (CAST(49 AS DOUBLE) / 25) AS ax, jy * CAST(2 AS DOUBLE) AS ay FROM range(3) a(s), range(26) b(jx), range(6) c(jy)),
c AS (SELECT *, least(floor(ax), 48) AS cx, least(floor(ay), 9) AS cy FROM t),
w AS (SELECT surface_id, node_id, cx + a AS ix, cy + b AS iy, (CASE a WHEN 1 THEN least(greatest(ax - cx, 0), 1) ELSE 1 - least(greatest(ax - cx, 0), 1) END) * (CASE b WHEN 1 THEN ay - cy ELSE 1 - (ay - cy) END) AS coef FROM c, range(2) p(a), range(2) q(b))
SELECT surface_id, w.node_id, {q("sum(coef * z)")} AS z FROM w JOIN flat USING (surface_id, ix, iy) GROUP BY ALL"""
_TURN = "radians(CAST(30 AS DOUBLE))"


def _rho(dx: str, dy: str, model: Correlation, major: str = "98e-1", minor: str = "2") -> str:
    h = f"sqrt(pow((({dx}) * cos({_TURN}) + ({dy}) * sin({_TURN})) / {major}, 2) + pow((({dy}) * cos({_TURN}) - ({dx}) * sin({_TURN})) / {minor}, 2))"
    return {
        Correlation.GAUSSIAN: f"exp(-3 * {h} * {h})",
        Correlation.EXPONENTIAL: f"exp(-3 * {h})",
        Correlation.SPHERICAL: f"CASE WHEN {h} >= 1 THEN 0 ELSE 1 - 15e-1 * {h} + 5e-1 * {h} * {h} * {h} END",
    }[model]


for _c in Correlation:
    ORACLES[f"covariance_{_c.value}"] = f"""WITH {POINTS}, {NODES}, r AS (SELECT surface_id, node_id, {_rho("x - 1", "y", _c)} AS rho FROM nd)
SELECT surface_id, node_id, {q("rho", "1e-9")} AS rho, {q("rho * 25e-1 + CASE WHEN node_id = 0 THEN 25e-2 ELSE 0 END", "1e-9")} AS cov FROM r"""
ORACLES["conditioning_diagonal"] = f"""{_stencils(CellModel.BILINEAR)}
SELECT a.surface_id, a.point_id, {q(f"sum(a.coef * b.coef * (25e-1 * ({_rho('a.node_id % 50 - b.node_id % 50', 'a.node_id // 50 - b.node_id // 50', Correlation.EXPONENTIAL)}) + CASE WHEN a.node_id = b.node_id THEN 25e-2 ELSE 0 END))", "1e-9")} AS d
FROM st a JOIN st b ON a.surface_id = b.surface_id AND a.point_id = b.point_id WHERE a.coef <> 0 AND b.coef <> 0 GROUP BY ALL"""
_LAG = "CASE WHEN {0} * 2 <= {1} THEN {0} ELSE {0} - {1} END"


def _torus(x: str, y: str) -> str:
    return f"25e-1 * ({_rho(_LAG.format(x, 16), _LAG.format(y, 8), Correlation.EXPONENTIAL, '3', '2')}) + CASE WHEN {x} = 0 AND {y} = 0 THEN 25e-2 ELSE 0 END"


ORACLES["spectrum_small"] = f"""WITH k AS (SELECT x, y, CASE WHEN x = 8 OR y = 4 THEN (({_torus("x", "y")}) + ({_torus("((16 - x) % 16)", "((8 - y) % 8)")})) / 2 ELSE {_torus("x", "y")} END AS c FROM range(16) a(x), range(8) b(y))
SELECT CAST(s AS INTEGER) AS surface_id, f.x AS fx, f.y AS fy, {q("sum(k.c * cos(2 * pi() * (f.x * k.x / CAST(16 AS DOUBLE) + f.y * k.y / CAST(8 AS DOUBLE))))")} AS eigenvalue FROM k f, k, range(3) t(s) GROUP BY ALL"""
ORACLES["surface_convergent_fit"] = f"WITH {POINTS} SELECT surface_id, point_id, {q('value', '1e-1')} AS z FROM points"
ORACLES["surface_convergent_plane"] = f"SELECT CAST(s AS INTEGER) AS surface_id, iy * 99 + ix AS node_id, {q('3 + 2 * (1 + ix * CAST(0.5 AS DOUBLE)) - iy * CAST(0.5 AS DOUBLE)')} AS z FROM range(3) a(s), range(99) b(ix), range(21) c(iy)"
ORACLES["gaussian_conditioned_fit"] = ORACLES["surface_convergent_fit"]
ORACLES["log_problems"] = f"""WITH raw AS (SELECT {_number("event_type", KINDS)} AS log_id, CAST(floor((epoch(ts) - 1704067200) / 3600) AS DOUBLE) AS md, value FROM events),
o AS (SELECT log_id, CASE WHEN log_id <> 3 THEN md END AS md, CASE log_id WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN 1 ELSE value END AS value FROM raw),
m AS (SELECT log_id, md, avg(value) FILTER (value NOT IN (-999.25, -999, 999.25)) AS v FROM o WHERE md IS NOT NULL GROUP BY log_id, md),
k AS (SELECT log_id, count(v) AS n, min(v) AS lo, max(v) AS hi FROM m GROUP BY log_id),
i AS (SELECT log_id, bool_or(coalesce(isinf(value) OR isinf(md), false)) AS infinite FROM o GROUP BY log_id),
p AS (SELECT i.log_id, CASE WHEN infinite THEN 'infinite' WHEN coalesce(n, 0) < 2 THEN 'few' WHEN lo = hi THEN 'constant' END AS problem FROM i LEFT JOIN k ON i.log_id = k.log_id)
SELECT * FROM p WHERE problem IS NOT NULL"""
ORACLES["corridor_rows"] = """
WITH s AS (SELECT p_partkey AS pair, p_size % 12 + 2 AS n, p_partkey % 9 + 2 AS m FROM part),
b AS (SELECT *, CAST(floor(CAST(0.1 AS DOUBLE) * ((n - 1) * (m - 1)) + CAST(0.5 AS DOUBLE) * greatest(n - 1, m - 1)) AS BIGINT) AS band FROM s),
c AS (SELECT pair, i, j FROM b, LATERAL (SELECT unnest(range(0, n)) AS i) x, LATERAL (SELECT unnest(range(0, m)) AS j) y WHERE abs(i * (m - 1) - j * (n - 1)) <= band)
SELECT pair, CAST(i AS INTEGER) AS i, min(j) AS start, max(j) AS "end" FROM c GROUP BY pair, i
"""
ORACLES["grid_nodes"] = f"SELECT CAST(s AS INTEGER) AS surface_id, iy * 99 + ix AS node_id, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {q('1 + ix * 5e-1')} AS x, {q('iy * 5e-1')} AS y FROM range(3) a(s), range(99) b(ix), range(21) c(iy)"
ORACLES["effective_parameters"] = f"SELECT CAST(s AS INTEGER) AS surface_id, {q('49 * 2e-1', '1e-9')} AS major_range, {q('25e-1', '1e-9')} AS minor_range, {q(f'cos({_TURN})', '1e-9')} AS cos_azimuth, {q(f'sin({_TURN})', '1e-9')} AS sin_azimuth FROM range(3) a(s)"
ORACLES["effective_tolerance"] = f"WITH {POINTS} SELECT surface_id, {q('1e-10 * greatest(1, max(abs(value)))', '1e-9')} AS tolerance FROM points GROUP BY surface_id"
ORACLES["plane_constant"] = f"WITH {POINTS} SELECT surface_id, {q('sum(weight * value) / sum(weight)', '1e-4')} AS a, CAST(0 AS BIGINT) AS bx, CAST(0 AS BIGINT) AS by FROM points GROUP BY surface_id"
ORACLES["local_cost_long"] = f"""WITH {SERIES},
p AS (SELECT x.vec_id AS pair, x.v AS a, y.v AS b, len(x.v) AS n, len(y.v) AS m FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
c AS (SELECT *, unnest(range(0, m)) AS j FROM (SELECT *, unnest(range(0, n)) AS i FROM p))
SELECT pair, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {q("abs(a[i + 1] - b[j + 1])")} AS local_cost FROM c
WHERE abs(i * (m - 1) - j * (n - 1)) <= floor(CAST(0.1 AS DOUBLE) * ((n - 1) * (m - 1)) + CAST(0.5 AS DOUBLE) * greatest(n - 1, m - 1))"""
ORACLES["log_limits"] = f"""WITH {LOGS}, {GRID}, {GAPS}
SELECT log_id, 'limit' AS problem FROM grid GROUP BY log_id HAVING count(*) > 1028 UNION ALL SELECT log_id, 'gap' FROM g GROUP BY log_id HAVING max(gap) > 15e-1 + 1e-9"""


def _solution(rows: str) -> str:
    """gj: systems (rows: surface_id, a: rows of a matrix with the right side behind it) after k - 1 steps of elimination without exchanges."""
    return f"""gj(surface_id, k, a, pr) AS (
  SELECT surface_id, 1, a, a[1] FROM {rows}
  UNION ALL
  SELECT surface_id, k + 1, n, n[k + 1] FROM (SELECT surface_id, k, list_transform(a, lambda r, i: CASE WHEN i = k THEN list_transform(pr, lambda v: v / pr[k]) ELSE list_transform(r, lambda v, j: v - r[k] / pr[k] * pr[j]) END) AS n FROM gj WHERE k <= len(a)))"""


# the grid of 13 by 6 in units of its larger extent: steps 1/12 and 2/49
_H, _V = "(CAST(1 AS DOUBLE) / 12)", "(CAST(2 AS DOUBLE) / 49)"
_BEND = f"""nd AS (SELECT CAST(s AS INTEGER) AS surface_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, iy * 13 + ix AS i FROM range(3) a(s), range(13) b(ix), range(6) c(iy)),
te AS (
  SELECT iy * 13 + ix AS id, {_V} / pow({_H}, 3) AS s, [ix - 1, ix, ix + 1] AS xs, [iy, iy, iy] AS ys, [1, -2, 1] AS cs FROM nd WHERE surface_id = 0 AND ix BETWEEN 1 AND 11
  UNION ALL SELECT 1000 + iy * 13 + ix, {_H} / pow({_V}, 3), [ix, ix, ix], [iy - 1, iy, iy + 1], [1, -2, 1] FROM nd WHERE surface_id = 0 AND iy BETWEEN 1 AND 4
  UNION ALL SELECT 2000 + iy * 13 + ix, 2 / ({_H} * {_V}), [ix, ix + 1, ix, ix + 1], [iy, iy, iy + 1, iy + 1], [1, -1, -1, 1] FROM nd WHERE surface_id = 0 AND ix < 12 AND iy < 5),
tx AS (SELECT id, s, unnest(xs) + 13 * unnest(ys) AS i, unnest(cs) AS c FROM te),
ke AS (SELECT x.i, y.i AS j, sum(x.s * x.c * y.c) AS k FROM tx x JOIN tx y USING (id) GROUP BY ALL),
sc AS (SELECT avg(k) AS scale FROM ke WHERE i = j)"""


def _springs(points: str) -> str:
    """The fitted plane at the nodes (pl), and the stencils (st) of points on the grid of 13 by 6."""
    return f"""uv AS (SELECT surface_id, weight AS w, (x - 255e-1) / 245e-1 AS u, (y - 5) / 5 AS v, value AS z FROM {points}), mo AS ({_SUMS}),
de AS (SELECT *, n * (uu * vv - uv * uv) - u * (u * vv - uv * v) + v * (u * uv - uu * v) AS det FROM mo),
co AS (SELECT surface_id, (z * (uu * vv - uv * uv) - u * (uz * vv - uv * vz) + v * (uz * uv - uu * vz)) / det AS a, (n * (uz * vv - uv * vz) - z * (u * vv - uv * v) + v * (u * vz - uz * v)) / det AS b,
  (n * (uu * vz - uz * uv) - u * (u * vz - uz * v) + z * (u * uv - uu * v)) / det AS c FROM de),
pl AS (SELECT nd.surface_id, i, a + b * (ix - 6) / 6 + c * (iy - 25e-1) / 25e-1 AS z FROM nd JOIN co USING (surface_id)),
ax AS (SELECT *, (x - 1) * 12 / 49 AS ax, y / 2 AS ay FROM {points}),
fr AS (SELECT *, ax - cx AS fx, ay - cy AS fy FROM (SELECT *, least(floor(ax), 11) AS cx, least(floor(ay), 4) AS cy FROM ax)),
st AS (SELECT surface_id, point_id, value, weight, CAST((cy + k // 2) * 13 + cx + k % 2 AS BIGINT) AS i, ws[k + 1] AS coef FROM (SELECT *, {WEIGHTS[CellModel.BOTTOM_RIGHT_TO_TOP_LEFT]} AS ws FROM fr), range(4) r(k) WHERE ws[k + 1] <> 0),
bb AS (SELECT x.surface_id, x.i, y.i AS j, sum(x.weight * x.coef * y.coef) AS k FROM st x JOIN st y USING (surface_id, point_id) GROUP BY ALL),
bv AS (SELECT surface_id, i, sum(weight * coef * value) AS v FROM st GROUP BY ALL),
ss AS (SELECT x.surface_id, x.i, y.i AS j, coalesce(ke.k, 0) + 1000 * scale * coalesce(bb.k, 0) + CASE WHEN x.i = y.i THEN 1e-10 * scale ELSE 0 END AS k FROM nd x JOIN nd y USING (surface_id) CROSS JOIN sc LEFT JOIN ke ON ke.i = x.i AND ke.j = y.i LEFT JOIN bb ON bb.surface_id = x.surface_id AND bb.i = x.i AND bb.j = y.i),
rh AS (SELECT pl.surface_id, pl.i, 1000 * scale * coalesce(v, 0) + 1e-10 * scale * pl.z AS v FROM pl CROSS JOIN sc LEFT JOIN bv ON bv.surface_id = pl.surface_id AND bv.i = pl.i)"""


_NODES_OF = "SELECT surface_id, CAST(i - 1 AS BIGINT) AS node_id, {0} AS z FROM (SELECT surface_id, i, a[i][len(a) + 1] AS z FROM gj, range(1, 79) t(i) WHERE k = len(a) + 1)"
ORACLES["surface_soft_nodes"] = f"""WITH RECURSIVE {POINTS}, {_BEND}, {_springs("points")},
ro AS (SELECT surface_id, i, list(k ORDER BY j) AS r FROM ss GROUP BY ALL),
sy AS (SELECT surface_id, list(list_append(r, v) ORDER BY i) AS a FROM ro JOIN rh USING (surface_id, i) GROUP BY surface_id),
{_solution("sy")} {_NODES_OF.format(q("z", "1e-3"))}"""
# unknowns: the nodes, then the points' multipliers, whose rows stand below; springs on top of them change nothing but the condition
ORACLES["surface_hard_nodes"] = f"""WITH RECURSIVE {POINTS}, hp AS (SELECT * FROM points WHERE x % 9 = 4 AND y % 5 = 2), {_BEND}, {_springs("hp")},
pn AS (SELECT surface_id, point_id, value, 78 + row_number() OVER (PARTITION BY surface_id ORDER BY point_id) - 1 AS j FROM hp),
en AS (
  SELECT surface_id, i, j, k FROM ss
  UNION ALL SELECT nd.surface_id, nd.i, pn.j, coalesce(coef, 0) * scale FROM nd JOIN pn USING (surface_id) CROSS JOIN sc LEFT JOIN st ON st.surface_id = nd.surface_id AND st.point_id = pn.point_id AND st.i = nd.i
  UNION ALL SELECT nd.surface_id, pn.j, nd.i, coalesce(coef, 0) * scale FROM nd JOIN pn USING (surface_id) CROSS JOIN sc LEFT JOIN st ON st.surface_id = nd.surface_id AND st.point_id = pn.point_id AND st.i = nd.i
  UNION ALL SELECT x.surface_id, x.j, y.j, 0 FROM pn x JOIN pn y USING (surface_id)),
rv AS (SELECT surface_id, i, v FROM rh UNION ALL SELECT surface_id, j, value * scale FROM pn CROSS JOIN sc),
ro AS (SELECT surface_id, i, list(k ORDER BY j) AS r FROM en GROUP BY ALL),
sy AS (SELECT surface_id, list(list_append(r, v) ORDER BY i) AS a FROM ro JOIN rv USING (surface_id, i) GROUP BY surface_id),
{_solution("sy")} {_NODES_OF.format(q("z", "1"))}"""

_U = "CAST({} AS UBIGINT)".format
_TWIST = f"xor(x >> 1, CASE WHEN x & 1 = 1 THEN {_U(0xB5026F5AA96619E9)} ELSE {_U(0)} END)"


def _tempered(x: str) -> str:
    """A word of the generator's state made its output; shifts to the left lose the upper bits first."""
    for shift, mask in ((29, 0x5555555555555555), (-17, 0x71D67FFFEDA60000), (-37, 0xFFF7EEE000000000), (43, 0xFFFFFFFFFFFFFFFF)):
        moved = "(x >> {0})".format(shift) if shift > 0 else "((x & {1}) << {0})".format(-shift, _U(2 ** (64 + shift) - 1))
        x = f"SELECT seed, k, xor(x, {moved} & {_U(mask)}) AS x FROM ({x})"
    return x


def _field(seeds: str) -> str:
    """wn: standard normal numbers on the torus of 16 by 8 for each seed (the 64-bit twister, in pairs); fl: the coloured field at the nodes of 8 by 4."""
    start = f"SELECT seed, 0, CAST(CASE WHEN seed < 0 THEN CAST(seed AS HUGEINT) + 18446744073709551616 ELSE seed END AS UBIGINT) FROM (SELECT unnest({seeds}) AS seed)"
    return f"""mt(seed, k, x) AS ({start} UNION ALL
  SELECT seed, k + 1, CAST((CAST(6364136223846793005 AS UHUGEINT) * CAST(xor(x, x >> 62) AS UHUGEINT) + CAST(k + 1 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) FROM mt WHERE k < 311),
tw AS (SELECT a.seed, a.k, (a.x & {_U(0xFFFFFFFF80000000)}) | (b.x & {_U(0x7FFFFFFF)}) AS x, c.x AS far FROM mt a JOIN mt b ON b.seed = a.seed AND b.k = a.k + 1 JOIN mt c ON c.seed = a.seed AND c.k = a.k + 156 WHERE a.k < 128),
ou AS ({_tempered(f"SELECT seed, k, xor(far, {_TWIST}) AS x FROM tw")}),
un AS (SELECT seed, k, (CAST(x >> 11 AS DOUBLE) + 5e-1) / 9007199254740992 AS u FROM ou),
wn AS (SELECT a.seed, a.k + h AS k, sqrt(-2 * ln(a.u)) * CASE h WHEN 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END AS n FROM un a JOIN un b ON b.seed = a.seed AND b.k = a.k + 1, range(2) t(h) WHERE a.k % 2 = 0),
kk AS (SELECT x, y, CASE WHEN x = 8 OR y = 4 THEN (({_torus("x", "y")}) + ({_torus("((16 - x) % 16)", "((8 - y) % 8)")})) / 2 ELSE {_torus("x", "y")} END AS c FROM range(16) a(x), range(8) b(y)),
la AS (SELECT f.x, f.y, greatest(sum(k.c * cos(2 * pi() * (f.x * k.x / CAST(16 AS DOUBLE) + f.y * k.y / CAST(8 AS DOUBLE)))), 0) AS l FROM kk f, kk k GROUP BY ALL),
hh AS (SELECT p.x, p.y, sum(sqrt(f.l) * cos(2 * pi() * (f.x * p.x / CAST(16 AS DOUBLE) + f.y * p.y / CAST(8 AS DOUBLE)))) / 128 AS h FROM kk p, la f GROUP BY ALL),
fl AS (SELECT seed, iy * 8 + ix AS node_id, ix, iy, sum(n * h) AS f FROM range(8) a(ix), range(4) b(iy), wn JOIN hh ON hh.x = (ix - k % 16 + 16) % 16 AND hh.y = (iy - k // 16 + 8) % 8 GROUP BY ALL)"""


ORACLES["gaussian_field"] = f"""WITH RECURSIVE {_field("[1, 5489, -9223372036854775801]")}
SELECT CAST(s AS INTEGER) AS surface_id, CAST(seed AS BIGINT) AS seed, CAST(node_id AS BIGINT) AS node_id, {q("f + ix + 2 * iy + s")} AS z FROM fl, range(3) t(s)"""
ORACLES["gaussian_conditioned_nodes"] = f"""WITH RECURSIVE {_field("[7]")}, {POINTS},
up AS (SELECT surface_id, row_number() OVER (PARTITION BY surface_id ORDER BY point_id) AS p, x - 1 + 3e-1 AS x, y + 45e-2 AS y, value / 1000 AS value, weight FROM points WHERE x <= 7 AND y <= 2 AND (x + y) % 3 = 0),
me AS (SELECT surface_id, sum(weight * value) / sum(weight) AS mean FROM up GROUP BY surface_id),
fr AS (SELECT *, floor(x) AS cx, floor(y) AS cy, x - floor(x) AS fx, y - floor(y) AS fy FROM up),
st AS (SELECT surface_id, p, value, cx + k % 2 AS ix, cy + k // 2 AS iy, ws[k + 1] AS coef FROM (SELECT *, {WEIGHTS[CellModel.BOTTOM_RIGHT_TO_TOP_LEFT]} AS ws FROM fr), range(4) r(k) WHERE ws[k + 1] <> 0),
z0 AS (SELECT surface_id, node_id, ix, iy, mean + f AS z FROM fl, me),
ga AS (SELECT surface_id, p, any_value(value) - sum(coef * z) AS gap FROM st JOIN z0 USING (surface_id, ix, iy) GROUP BY ALL),
cb AS (SELECT st.surface_id, st.p, z0.node_id, z0.ix, z0.iy, sum(coef * (25e-1 * ({_rho('z0.ix - st.ix', 'z0.iy - st.iy', Correlation.EXPONENTIAL, '3', '2')}) + CASE WHEN z0.ix = st.ix AND z0.iy = st.iy THEN 25e-2 ELSE 0 END)) AS c FROM st JOIN z0 ON z0.surface_id = st.surface_id GROUP BY ALL),
sm AS (SELECT st.surface_id, st.p AS i, cb.p AS j, sum(st.coef * cb.c) AS k FROM st JOIN cb ON cb.surface_id = st.surface_id AND cb.ix = st.ix AND cb.iy = st.iy GROUP BY ALL),
ro AS (SELECT surface_id, i, list(k ORDER BY j) AS r FROM sm GROUP BY ALL),
sy AS (SELECT ro.surface_id, list(list_append(r, gap) ORDER BY i) AS a FROM ro JOIN ga ON ga.surface_id = ro.surface_id AND ga.p = ro.i GROUP BY ro.surface_id),
{_solution("sy")},
wt AS (SELECT surface_id, i AS p, a[i][len(a) + 1] AS w FROM gj, range(1, 9) t(i) WHERE k = len(a) + 1 AND i <= len(a)),
dz AS (SELECT cb.surface_id, node_id, sum(w * c) AS dz FROM cb JOIN wt USING (surface_id, p) GROUP BY ALL)
SELECT surface_id, CAST(7 AS BIGINT) AS seed, CAST(node_id AS BIGINT) AS node_id, {q("z + dz", "1e-5")} AS z FROM z0 JOIN dz USING (surface_id, node_id)"""
ORACLES["gaussian_conditioned_fit"] = ORACLES["surface_convergent_fit"]
_TRIANGLES = ", ".join(f"({k}, CAST({x!r} AS DOUBLE), CAST({y!r} AS DOUBLE), CAST({v!r} AS DOUBLE), {n})" for n, (k, x, y, v) in enumerate(TRIANGLES))
ORACLES["surface_status"] = f"""WITH {POINTS},
b AS (SELECT CAST(s AS INTEGER) AS surface_id, point_id, CASE WHEN s = 3 AND point_id % 7 = 0 THEN x + 60 ELSE x END AS x, y, CASE WHEN s = 4 AND point_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value,
        CASE WHEN s = 2 AND point_id % 7 = 0 THEN -weight WHEN s = 6 THEN 0 ELSE weight END AS weight FROM points, range(9) t(s) WHERE surface_id = 0),
a AS (SELECT * FROM b UNION ALL SELECT surface_id, point_id + 10000, x, y, CASE surface_id WHEN 1 THEN value + 1 ELSE value END, weight FROM b WHERE surface_id IN (1, 5)),
f AS (SELECT surface_id, bool_or(isnan(value) OR weight < 0) AS bad, bool_or(x > 50 + 1e-9) AS outside, sum(weight) = 0 AS none, bool_or(surface_id = 7 AND x - 1 > 30) AS off, surface_id = 8 AS short FROM a GROUP BY surface_id),
d AS (SELECT surface_id, bool_or(hi > lo) AS twice FROM (SELECT surface_id, x, y, max(value) AS hi, min(value) AS lo FROM a WHERE NOT isnan(value) GROUP BY ALL) GROUP BY surface_id),
t(surface_id, x, y, v, n) AS (VALUES {_TRIANGLES}),
w AS (SELECT surface_id, max(x) FILTER (n % 4 = 0) AS x0, max(y) FILTER (n % 4 = 0) AS y0, max(v) FILTER (n % 4 = 0) AS v0, max(x) FILTER (n % 4 = 1) AS x1, max(v) FILTER (n % 4 = 1) AS v1,
        max(y) FILTER (n % 4 = 2) AS y2, max(v) FILTER (n % 4 = 2) AS v2, max(x) FILTER (n % 4 = 3) AS x3, max(y) FILTER (n % 4 = 3) AS y3, max(v) FILTER (n % 4 = 3) AS v3 FROM t GROUP BY surface_id)
SELECT surface_id, CASE WHEN bad THEN 'invalid_input' WHEN outside THEN 'out_of_range' WHEN none OR twice OR short THEN 'invalid_input' WHEN off THEN 'out_of_range' ELSE 'ok' END AS status FROM f JOIN d USING (surface_id)
UNION ALL SELECT surface_id, CASE WHEN abs(v0 + (v1 - v0) / (x1 - x0) * (x3 - x0) + (v2 - v0) / (y2 - y0) * (y3 - y0) - v3) > 1e-6 THEN 'invalid_input' ELSE 'ok' END FROM w"""
