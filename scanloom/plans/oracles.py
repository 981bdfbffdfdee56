"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from ..functions.labels import BACKGROUND, CELL_ORDER, FOREGROUND
from ..operators.graphs import BLOCKS
from .fixtures import move_sql, patches_sql, points_sql, poses_sql

_FG = ", ".join(map(str, FOREGROUND))
_BG = ", ".join(map(str, BACKGROUND))


def _r(x: str, name: str = "") -> str:
    """Rounded like the queries' results."""
    return f"round({x}, 6) + 0.0" + (f" AS {name}" if name else "")


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _sum2(template: str, names: str = "xyz") -> str:
    """Sum of squares of a template with # for each axis."""
    return " + ".join(f"({template.replace('#', c)}) * ({template.replace('#', c)})" for c in names)


# Retrieval
_TOP = """cand AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id,
    round(list_sum(list_transform(range(1, 65), lambda i: (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i]) * (CAST(q.embedding[i] AS DOUBLE) - c.embedding[i]))), 6) AS d2
  FROM embeddings q JOIN embeddings c ON c.vec_id < q.vec_id - 100 WHERE q.vec_id > 100),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d2, cand_id) AS INT) AS rk FROM cand QUALIFY rk <= 50)"""
_PADDED = """padded AS (SELECT s.query_id, s.rk, coalesce(t.cand_id, -1) AS cand_id, coalesce(t.d2, 2.0) AS d2
  FROM (SELECT vec_id AS query_id, CAST(k AS INT) AS rk FROM embeddings, unnest(range(1, 51)) AS u(k) WHERE vec_id > 100) s
  LEFT JOIN top t ON t.query_id = s.query_id AND t.rk = s.rk)"""
_MARKED = """firsts AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label),
marked AS (SELECT p.query_id, p.rk, p.cand_id, p.d2, f.first_id < p.query_id - 100 AS has_truth, coalesce(q.label = c.label, false) AS is_true
  FROM padded p JOIN embeddings q ON q.vec_id = p.query_id JOIN firsts f ON f.label = q.label LEFT JOIN embeddings c ON c.vec_id = p.cand_id)"""
_TOP1 = "top1 AS (SELECT * FROM marked WHERE rk = 1 AND query_id >= 150 AND query_id < (SELECT max(vec_id) FROM embeddings))"
_SWEEP = """counts AS (SELECT CAST(i AS INT) AS step, count(*) FILTER (WHERE d2s <= i AND is_true) AS tp, count(*) FILTER (WHERE d2s <= i AND NOT is_true) AS fp,
    count(*) FILTER (WHERE d2s > i AND NOT has_truth) AS tn, count(*) FILTER (WHERE d2s > i AND has_truth) AS fn
  FROM (SELECT *, ceil(round(d2 / 0.01, 6)) AS d2s FROM top1), unnest(range(211)) AS u(i) GROUP BY i),
rates AS (SELECT *, CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM counts),
sweep AS (SELECT * FROM rates WHERE step <= coalesce((SELECT min(step) FROM rates WHERE recall = 1), 211))"""
_RETRIEVAL = (_TOP, _PADDED, _MARKED, _TOP1)
_CURVE = """scored AS (SELECT round(2 - d2, 3) AS score, CAST(is_true AS INT) AS label FROM top1),
groups AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score),
curve AS (SELECT score, sum(pos) OVER o / sum(n) OVER o AS precision,
    coalesce(sum(pos) OVER o / nullif(sum(pos) OVER (), 0), 1.0::DOUBLE) AS recall FROM groups WINDOW o AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# Points
_AZIMUTH = "CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360.0 ELSE degrees(atan2(y, x)) END"
_POLAR = f"""polar AS (SELECT * REPLACE (CASE WHEN azimuth >= 360.0 THEN 0.0 ELSE azimuth END AS azimuth), degrees(atan2(z, xy_range)) AS elevation
  FROM (SELECT *, {_AZIMUTH} AS azimuth, sqrt(x * x + y * y) AS xy_range FROM pts))"""
_VOX = f"""vox AS (SELECT *, CAST(trunc((elevation + 24.8::DOUBLE) / 2.0) AS INT) AS vrow, CAST(trunc(azimuth / 2.0) AS INT) AS vcol,
    CAST(trunc(xy_range - min(xy_range) OVER (PARTITION BY scan_id, label)) AS INT) AS vrng FROM polar WHERE label IN ({_FG}))"""
_CLUSTER = """cells AS (SELECT DISTINCT scan_id, label, vrow, vcol, vrng, ((CAST(vrow AS BIGINT) + 100) * 1000 + vcol) * 1000000 + vrng AS code FROM vox),
touch AS (SELECT a.scan_id, a.label, a.code AS a, b.code AS b FROM cells a JOIN cells b ON a.scan_id = b.scan_id AND a.label = b.label
  AND abs(a.vrow - b.vrow) <= 1 AND abs(a.vrng - b.vrng) <= 1 AND (abs(a.vcol - b.vcol) <= 1 OR abs(a.vcol - b.vcol) = 179)
  AND (a.vrow BETWEEN 0 AND 13 OR b.vrow BETWEEN 0 AND 13)),
reach AS (SELECT scan_id, label, code AS a, code AS b FROM cells UNION
  SELECT r.scan_id, r.label, r.a, t.b FROM reach r JOIN touch t ON t.scan_id = r.scan_id AND t.label = r.label AND t.a = r.b),
comp AS (SELECT scan_id, label, a AS code, min(b) AS component, count(*) AS n_cells FROM reach GROUP BY scan_id, label, a),
clustered AS (SELECT v.*, comp.component FROM vox v JOIN comp ON comp.scan_id = v.scan_id AND comp.label = v.label
    AND comp.code = ((CAST(v.vrow AS BIGINT) + 100) * 1000 + v.vcol) * 1000000 + v.vrng
  WHERE v.vrow BETWEEN 0 AND 13 OR comp.n_cells > 1)"""


def _instances(check: bool = False) -> str:
    where = "WHERE CASE WHEN cls = 1 THEN dx >= 0.5 AND dy >= 0.5 AND dz >= 0.3 ELSE dz >= 0.3 END" if check else ""
    box = ", ".join([f"(min({c}) + max({c})) / 2 AS c{c}, max({c}) - min({c}) AS d{c}" for c in "xyz"])
    return f"""boxes AS (SELECT scan_id, CASE WHEN label IN (1, 4, 5) THEN 1 WHEN label = 16 THEN 2 ELSE 3 END AS cls, {box}, count(*) AS n, label, component
  FROM clustered GROUP BY scan_id, label, component HAVING count(*) >= 10),
inst AS (SELECT scan_id, cls, cx, cy, cz, dx, dy, dz, n, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY cls, cx, cy, cz, label, component) - 1 AS INT) AS node_id
  FROM boxes {where})"""


def _scans(vectors: int = 25, check: bool = False) -> tuple[str, ...]:
    return points_sql(vectors), _POLAR, _VOX, _CLUSTER, _instances(check)


_LINKS = f"""links AS (SELECT *, CAST(trunc(dist / 2.0) AS INT) AS bin FROM (
  SELECT a.scan_id, a.node_id AS src, b.node_id AS dst, a.cls AS src_cls, b.cls AS dst_cls, sqrt({_sum2("a.c# - b.c#")}) AS dist
  FROM inst a JOIN inst b ON a.scan_id = b.scan_id) WHERE dist < 60)"""
_COUNTS = "counts AS (SELECT scan_id, count(*) FILTER (WHERE cls = 1) AS n_vehicle, count(*) FILTER (WHERE cls = 2) AS n_trunk, count(*) FILTER (WHERE cls = 3) AS n_pole FROM inst GROUP BY scan_id)"
_BLOCK = "CASE " + " ".join(f"WHEN least(src_cls, dst_cls) = {a} AND greatest(src_cls, dst_cls) = {b} THEN {i}" for i, (a, b) in enumerate(BLOCKS)) + " END"
_GRAPH = f"""slots AS (SELECT scan_id, CAST(3 + {_BLOCK} * 30 + bin AS INT) AS slot, count(*) AS n FROM links WHERE src < dst GROUP BY ALL
  UNION ALL SELECT scan_id, 0, n_vehicle FROM counts WHERE n_vehicle > 0 UNION ALL SELECT scan_id, 1, n_trunk FROM counts WHERE n_trunk > 0
  UNION ALL SELECT scan_id, 2, n_pole FROM counts WHERE n_pole > 0),
parts AS (SELECT scan_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY scan_id, slot < 3)) AS value FROM slots),
graph AS (SELECT scan_id, slot, value / sqrt(sum(value * value) OVER (PARTITION BY scan_id)) AS value FROM parts)"""

_PRIORITY = "CASE label " + " ".join(f"WHEN {c} THEN {len(CELL_ORDER) - i}" for i, c in enumerate(CELL_ORDER)) + " END"
_CELLS = f"""bg AS (SELECT *, CAST(trunc((xy_range - 5.0) / 1.875) AS INT) AS ring, CAST(trunc(azimuth / 1.0) AS INT) AS sector
  FROM polar WHERE label IN ({_BG}) AND xy_range >= 5 AND xy_range < 50)"""
_GRID = f"grid AS (SELECT scan_id, ring, sector, arg_max(label, {_PRIORITY}) AS label FROM bg GROUP BY scan_id, ring, sector)"
_RINGS = """seen AS (SELECT scan_id, CAST(CASE WHEN label = 13 THEN 0 ELSE 24 END + ring AS INT) AS slot, count(DISTINCT sector) AS n FROM bg WHERE label IN (9, 13) GROUP BY ALL),
rings AS (SELECT scan_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY scan_id)) AS value FROM seen)"""

_VOXEL = lambda size: ", ".join(f"CAST(trunc({c} / {size:.6f}::DOUBLE) AS INT) AS v{c}" for c in "xyz")
_SHIFTED = ", ".join(f"{c} + {s}::DOUBLE AS s{c}" for c, s in (("x", "0.2"), ("y", "(-0.1)"), ("z", "0.05")))
_NEAREST = f"""src AS (SELECT scan_id AS pair_id, pt_idx AS src_idx, {_SHIFTED} FROM pts WHERE label IN ({_FG})),
srcv AS (SELECT *, {", ".join(f"CAST(trunc(s{c}) AS INT) AS v{c}" for c in "xyz")} FROM src),
tgt AS (SELECT * FROM (SELECT scan_id AS pair_id, pt_idx AS tgt_idx, x AS tx, y AS ty, z AS tz, {_VOXEL(1)} FROM pts WHERE label IN ({_FG}))
  QUALIFY row_number() OVER (PARTITION BY pair_id, vx, vy, vz ORDER BY tgt_idx) <= 5),
near AS (SELECT * FROM (SELECT s.pair_id, src_idx, tgt_idx, sx, sy, sz, tx, ty, tz, {_sum2("s# - t#")} AS d2
    FROM srcv s JOIN tgt t ON s.pair_id = t.pair_id AND abs(s.vx - t.vx) <= 1 AND abs(s.vy - t.vy) <= 1 AND abs(s.vz - t.vz) <= 1)
  WHERE d2 < 0.25 QUALIFY row_number() OVER (PARTITION BY pair_id, src_idx ORDER BY d2, tgt_idx) = 1)"""

_MOVED = move_sql("truth")
_COPIED = f"""copied AS (SELECT pair_id, pt_idx, x AS ax, y AS ay, z AS az, {", ".join(f'{e} AS "b{c}"' for e, c in zip(_MOVED, "xyz", strict=True))}
  FROM pts JOIN pose ON pose.pair_id = pts.scan_id)"""
_TRACE = " + ".join(f"truth[{4 * i + k + 1}] * pose[{4 * i + k + 1}]" for i in range(3) for k in range(3))
_ERRORS = f"""errors AS (SELECT pair_id, sqrt({" + ".join(f"(truth[{i}] - pose[{i}]) * (truth[{i}] - pose[{i}])" for i in (4, 8, 12))}) AS rte,
    degrees(acos(greatest(-1.0, least(1.0, ({_TRACE} - 1.0) / 2.0)))) AS rre FROM pose),
judged AS (SELECT *, rte < 2 AND rre < 5 AS success FROM errors)"""


def _inverse() -> str:
    parts = []
    for i in range(3):
        parts += [_r(f"truth[{4 * k + i + 1}]", f"p{4 * i + k}") for k in range(3)]
        parts.append(_r("-(" + " + ".join(f"truth[{4 * k + i + 1}] * truth[{4 * k + 4}]" for k in range(3)) + ")", f"p{4 * i + 3}"))
    return ", ".join(parts)


def _normal_equations() -> str:
    rows = [["1", "0", "0", "0", "sz", "-sy"], ["0", "1", "0", "-sz", "0", "sx"], ["0", "0", "1", "sy", "-sx", "0"]]
    out = []
    for i in range(6):
        out += [_r("sum(" + " + ".join(f"({r[i]}) * ({r[j]})::DOUBLE" for r in rows) + ")", f"h{i}{j}") for j in range(i, 6)]
    out += [_r("sum(" + " + ".join(f"({r[i]}) * (s{c} - t{c})" for r, c in zip(rows, "xyz", strict=True)) + ")", f"b{i}") for i in range(6)]
    return ", ".join(out)


def _kabsch() -> str:
    means = [_r(f'avg("{s}{c}")', f"m{s}{c}") for s in "ab" for c in "xyz"]
    cross = [_r(f'sum(a{p} * "b{q}") - count(*) * avg(a{p}) * avg("b{q}")', f"w{p}{q}") for p in "xyz" for q in "xyz"]
    return ", ".join(means + cross)


def _moments() -> str:
    means = [_r(f"sum({a}) / count(*)", f"m{a}") for a in "xyz"]
    second = [_r(f"sum({a} * {b}) / count(*) - (sum({a}) / count(*)) * (sum({b}) / count(*))", f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return ", ".join(means + second)


def _tilt() -> str:
    c, s = "cos(radians(0.205::DOUBLE))", "sin(radians(0.205::DOUBLE))"
    r = "sqrt(x * x + y * y)"
    wide = f"({c} - CASE WHEN {r} > 0 THEN {s} * z / {r} ELSE 0 END)"
    return f"{_r(f'x * {wide}', 'tx')}, {_r(f'y * {wide}', 'ty')}, {_r(f'{c} * z + {s} * {r}', 'tz')}"


def _triangles(side: str, table: str) -> str:
    """Triangles of each node of a table (scan_id, node_id, cx, cy, cz)."""
    return f"""near_{side} AS (SELECT * FROM (SELECT a.scan_id, a.node_id, b.node_id AS other, b.cx, b.cy, b.cz, sqrt({_sum2("a.c# - b.c#")}) AS side
    FROM {table} a JOIN {table} b ON a.scan_id = b.scan_id AND a.node_id <> b.node_id) WHERE side < 20 AND side <> 0),
tri_{side} AS (SELECT m.scan_id, m.node_id, list_sort([m.side, n.side, sqrt({_sum2("m.c# - n.c#")})]) AS s, k.n_near
  FROM near_{side} m JOIN near_{side} n ON m.scan_id = n.scan_id AND m.node_id = n.node_id AND m.other < n.other
  JOIN (SELECT scan_id, node_id, count(*) AS n_near FROM near_{side} GROUP BY ALL) k ON k.scan_id = m.scan_id AND k.node_id = m.node_id)"""


_PRUNE = ",\n".join(
    (
        "shifted AS (SELECT scan_id, node_id, cx + sin(node_id * 1) * 0.15::DOUBLE AS cx, cy + sin(node_id * 2) * 0.15::DOUBLE AS cy, cz + sin(node_id * 3) * 0.15::DOUBLE AS cz FROM inst)",
        _triangles("a", "inst"),
        _triangles("b", "shifted"),
        """met AS (SELECT a.scan_id, a.node_id, count(*) AS n_triangles, min(a.n_near) AS near_a, min(b.n_near) AS near_b
  FROM tri_a a JOIN tri_b b ON a.scan_id = b.scan_id AND a.node_id = b.node_id
    AND abs(a.s[1] - b.s[1]) < 0.25 AND abs(a.s[2] - b.s[2]) < 0.25 AND abs(a.s[3] - b.s[3]) < 0.25 GROUP BY ALL)""",
    )
)
_MOVED_NODES = ", ".join(f"a.c{c} + {s}::DOUBLE - b.c{c}" for c, s in (("x", "0.2"), ("y", "(-0.1)"), ("z", "0.05")))
_FIT_D2 = " + ".join(f"({e}) * ({e})" for e in _MOVED_NODES.split(", "))

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * {b}[i]))"
_COSINE = f"{_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')}))"


def _pad(column: str, n: int) -> str:
    return f"CASE WHEN length(CAST({column} AS VARCHAR)) >= {n} THEN CAST({column} AS VARCHAR) ELSE lpad(CAST({column} AS VARCHAR), {n}, '0') END"


def _true_pairs(vectors: int = 50) -> str:
    """Every scan and its copy, whose motion is known, so the pose found must be close."""
    return _with(poses_sql(vectors)) + "SELECT pair_id * 2 AS pair_id, true AS close FROM pose"


# Planes: the least eigenvalue of a symmetric 3x3 in closed form; its direction is a column
# of the adjugate of what is left, applied to it once more.
def _planes() -> list[str]:
    second = [f"avg({p} * {q}) - avg({p}) * avg({q}) AS c{p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    adjugate = {
        "xx": "(yy * zz - yz * yz)", "yy": "(xx * zz - xz * xz)", "zz": "(xx * yy - xy * xy)",
        "xy": "(xz * yz - xy * zz)", "xz": "(xy * yz - xz * yy)", "yz": "(xy * xz - xx * yz)",
    }
    row = lambda p: [adjugate["".join(sorted(p + q))] for q in "xyz"]
    pick = [f"CASE WHEN axx >= ayy AND axx >= azz THEN {row('x')[i]} WHEN ayy >= azz THEN {row('y')[i]} ELSE {row('z')[i]} END AS f{c}" for i, c in enumerate("xyz")]
    again = [f"{' + '.join(f'{m} * f{q}' for m, q in zip(row(p), 'xyz', strict=True))} AS g{p}" for p in "xyz"]
    lead = "CASE WHEN abs(gx) >= abs(gy) AND abs(gx) >= abs(gz) THEN gx WHEN abs(gy) >= abs(gz) THEN gy ELSE gz END"
    return [
        f"thin AS (SELECT * FROM (SELECT *, {_VOXEL(0.25)} FROM pts) QUALIFY row_number() OVER (PARTITION BY scan_id, vx, vy, vz ORDER BY pt_idx) = 1)",
        f"""moments AS (SELECT scan_id, vx, vy, vz, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {", ".join(second)}
  FROM (SELECT scan_id, x, y, z, {_VOXEL(1)} FROM thin) GROUP BY scan_id, vx, vy, vz HAVING count(*) >= 8)""",
        """spread AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz)
    + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS low
  FROM (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p
    FROM (SELECT *, (cxx + cyy + czz) / 3 AS q FROM moments)))""",
        f"""planes AS (SELECT scan_id, vx, vy, vz, n, mx, my, mz, {", ".join(f"g{c} / sqrt(gx * gx + gy * gy + gz * gz) * sign({lead}) AS n{c}" for c in "xyz")}
  FROM (SELECT *, {", ".join(again)} FROM (SELECT *, {", ".join(pick)} FROM (SELECT *, {", ".join(f"{adjugate[p + p]} AS a{p}{p}" for p in "xyz")}
    FROM (SELECT *, cxx - low AS xx, cyy - low AS yy, czz - low AS zz, cxy AS xy, cxz AS xz, cyz AS yz FROM spread WHERE low <= 0.005)))))""",
    ]


def _plane_pairs() -> str:
    pose = ["cos(0.02)", "-sin(0.02)", "0", "0.05", "sin(0.02)", "cos(0.02)", "0", "-0.03", "0", "0", "1", "0.02"]
    turn = lambda v, i: " + ".join(f"{pose[4 * i + k]} * {v}{c}" for k, c in enumerate("xyz"))
    moved = ", ".join([f"{turn('m', i)} + {pose[4 * i + 3]} AS q{c}" for i, c in enumerate("xyz")] + [f"{turn('n', i)} AS r{c}" for i, c in enumerate("xyz")])
    d2 = " + ".join(f"(q{c} - t{c}) * (q{c} - t{c})" for c in "xyz")
    near = " AND ".join(f"abs(CAST(trunc(q{c}) AS INT) - CAST(trunc(t{c}) AS INT)) <= 1" for c in "xyz")
    apart = lambda sign: f"sqrt({' + '.join(f'(r{c} {sign} u{c}) * (r{c} {sign} u{c})' for c in 'xyz')})"
    off = f"abs({' + '.join(f'(q{c} - t{c}) * u{c}' for c in 'xyz')})"
    return f"""SELECT a.scan_id AS pair_id, a_vx, a_vy, a_vz, b_vx, b_vy, b_vz, {_r("d2", "d2")} FROM (
  SELECT a.*, b.*, {d2} AS d2 FROM (SELECT scan_id, vx AS a_vx, vy AS a_vy, vz AS a_vz, {moved} FROM planes) a
  JOIN (SELECT scan_id AS b_scan, vx AS b_vx, vy AS b_vy, vz AS b_vz, mx + 0.1 AS tx, my AS ty, mz AS tz, nx AS ux, ny AS uy, nz AS uz FROM planes) b
  ON a.scan_id = b_scan AND {near} QUALIFY row_number() OVER (PARTITION BY a.scan_id, a_vx, a_vy, a_vz ORDER BY d2, b_vx, b_vy, b_vz) = 1) a
WHERE least({apart("-")}, {apart("+")}) < 0.2 AND {off} < 0.5 AND d2 < 3"""


ORACLES: dict[str, str] = {
    "knn_pivot_topk": _with(_TOP) + "SELECT query_id, cand_id, d2, rk FROM top",
    "knn_exclusion_topk": _with(_TOP) + "SELECT query_id, cand_id, d2, rk FROM top",
    "knn_padded_candidates": _with(_TOP, _PADDED) + "SELECT query_id, rk, cand_id, d2 FROM padded",
    "stream_retrieval": _with(_TOP, _PADDED) + "SELECT query_id, rk, cand_id, d2 FROM padded",
    "stream_shuffled_retrieval": _with(_TOP, _PADDED) + "SELECT query_id, rk, cand_id, d2 FROM padded",
    "knn_top1_label_recall": _with(_TOP, _PADDED, _MARKED)
    + """SELECT n_queries, n_hits, round(n_hits / nullif(n_queries, 0), 6) AS recall, top_n FROM (
  SELECT CAST(k AS INT) AS top_n, count(DISTINCT query_id) AS n_queries, count(DISTINCT CASE WHEN is_true AND rk <= k THEN query_id END) AS n_hits
  FROM marked, unnest([1, 5, 20]) AS u(k) WHERE has_truth GROUP BY k)""",
    "pr_threshold_sweep": _with(*_RETRIEVAL, _SWEEP)
    + f"SELECT step, round(step * 0.01::DOUBLE, 2) AS threshold, tp, fp, tn, fn, {_r('precision', 'precision')}, {_r('recall', 'recall')} FROM sweep",
    "pr_average_precision": _with(*_RETRIEVAL, _SWEEP)
    + f"""SELECT {_r("coalesce(sum(gain * precision), 0)", "ap")}, {_r("max(2 * precision * recall / (precision + recall + 1e-12))", "f1_max")}
FROM (SELECT *, recall - lag(recall) OVER (ORDER BY step) AS gain FROM sweep)""",
    "pr_auc": _with(*_RETRIEVAL, _SWEEP)
    + f"""SELECT {_r("sum((recall - r0) * (precision + p0) / 2) * 100", "auc")}
FROM (SELECT *, lag(recall) OVER o AS r0, lag(precision) OVER o AS p0 FROM sweep WINDOW o AS (ORDER BY recall, precision, step))""",
    "pr_score_ranked": _with(*_RETRIEVAL, _CURVE) + f"SELECT {_r('score', 'score')}, {_r('precision', 'precision')}, {_r('recall', 'recall')} FROM curve",
    "pr_score_summary": _with(*_RETRIEVAL, _CURVE)
    + f"""SELECT {_r("f1_max", "f1_max")}, {_r("recall_at_p1", "recall_at_p1")}, {_r("precision_at_r0", "precision_at_r0")}, {_r("(precision_at_r0 + recall_at_p1) / 2", "ep")}
FROM (SELECT max(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)) AS f1_max,
  coalesce(max(CASE WHEN precision = 1 THEN recall END), 0.0::DOUBLE) AS recall_at_p1,
  CASE WHEN min(recall) = 0 THEN min(CASE WHEN recall = 0 THEN precision END) ELSE 1.0::DOUBLE END AS precision_at_r0 FROM curve)""",
    "cosine_pairs_gated": f"""SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.label, {_r("cost", "cost")}
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 25 + 1 = b.vec_id // 25,
  LATERAL (SELECT greatest(0.0, 1 - {_COSINE}) AS cost) WHERE cost <= 0.9""",
    "assignment_totals": _with(
        f"""edges AS (SELECT a.vec_id // 5 AS pair_id, a.vec_id % 5 AS r, 1 << CAST(b.vec_id % 5 AS INT) AS bit, 1 AS one, cost
  FROM embeddings a JOIN embeddings b ON a.vec_id // 5 + 1 = b.vec_id // 5, LATERAL (SELECT round(1 - {_COSINE}, 6) AS cost) WHERE cost <= 1.0)""",
        "choices AS (SELECT * FROM edges UNION ALL SELECT DISTINCT pair_id, u.r, 0, 0, 0.0 FROM edges, unnest(range(5)) AS u(r))",
        """walk AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS r, 0 AS used, 0 AS n, CAST(0 AS DOUBLE) AS total FROM edges
  UNION ALL SELECT w.pair_id, w.r + 1, w.used | c.bit, w.n + c.one, w.total + c.cost FROM walk w JOIN choices c ON c.pair_id = w.pair_id AND c.r = w.r AND w.used & c.bit = 0)""",
    )
    + f"""SELECT pair_id, CAST(n AS BIGINT) AS n, {_r("total", "total")} FROM walk WHERE r = 5
QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, total) = 1""",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x * 2 AS DOUBLE))) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT vec_id, CAST(i - 1 AS INT) AS slot, {_r("v[i] / CASE WHEN n = 0 THEN 1e-6 ELSE n END", "value")} FROM n, unnest(range(1, 129)) AS u(i)""",
    "file_name_pad": f"SELECT o_orderkey, 'velodyne/' || {_pad('o_orderkey', 6)} || '.bin' AS scan_file, 'labels/' || {_pad('o_custkey', 10)} || '.label' AS label_file FROM orders",
    "label_remap": _with(points_sql()) + "SELECT scan_id, pt_idx, CAST(raw_label AS INT) AS raw_label, label FROM pts",
    "fg_points": _with(points_sql()) + f"SELECT scan_id, pt_idx, label FROM pts WHERE label IN ({_FG})",
    "bg_points": _with(points_sql()) + f"SELECT scan_id, pt_idx, label FROM pts WHERE label IN ({_BG})",
    "spherical_coords": _with(points_sql(), _POLAR)
    + f"SELECT scan_id, pt_idx, {_r('azimuth', 'azimuth')}, {_r('elevation', 'elevation')}, {_r('xy_range', 'xy_range')} FROM polar",
    "spherical_voxels": _with(points_sql(), _POLAR, _VOX) + "SELECT scan_id, label, vrow, vcol, vrng, count(*) AS n FROM vox GROUP BY ALL",
    "voxel_downsample_first": _with(points_sql())
    + f"SELECT scan_id, min(pt_idx) AS pt_idx, vx, vy, vz FROM (SELECT scan_id, pt_idx, {_VOXEL(0.25)} FROM pts) GROUP BY scan_id, vx, vy, vz",
    "voxel_cap5": _with(points_sql())
    + f"""SELECT scan_id, vx, vy, vz, pt_idx, CAST(row_number() OVER (PARTITION BY scan_id, vx, vy, vz ORDER BY pt_idx) AS INT) AS rank_in_voxel
FROM (SELECT scan_id, pt_idx, {_VOXEL(4)} FROM pts) QUALIFY rank_in_voxel <= 5""",
    "neighbor27_nn": _with(points_sql(), _NEAREST) + f"SELECT pair_id, src_idx, tgt_idx, {_r('d2', 'd2')} FROM near",
    "tilt_correction": _with(points_sql()) + f"SELECT scan_id, pt_idx, {_tilt()} FROM pts",
    "cluster_components": _with(*_scans()) + "SELECT scan_id, pt_idx, label, component FROM clustered",
    "noise_clusters": _with(*_scans())
    + """SELECT scan_id, label, component, n, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, label, component) AS INT) AS place
FROM (SELECT scan_id, label, component, count(*) AS n FROM clustered GROUP BY ALL) WHERE n > 10""",
    "instance_boxes": _with(*_scans())
    + f"SELECT scan_id, cls, n, node_id, {', '.join(_r(f'{k}{c}', f'{k}{c}') for k in 'cd' for c in 'xyz')} FROM inst",
    "instance_boxes_checked": _with(*_scans(check=True))
    + f"SELECT scan_id, cls, n, node_id, {', '.join(_r(f'{k}{c}', f'{k}{c}') for k in 'cd' for c in 'xyz')} FROM inst",
    "instance_edges": _with(*_scans(), _LINKS) + f"SELECT scan_id, src, dst, src_cls, dst_cls, {_r('dist', 'dist')}, bin FROM links WHERE src < dst",
    "class_counts": _with(*_scans(), _COUNTS) + "SELECT * FROM counts",
    "node_edge_hist": _with(*_scans(), _LINKS)
    + f"""SELECT scan_id, node_id, slot, {_r("n / sqrt(sum(n * n) OVER (PARTITION BY scan_id, node_id))", "value")}
FROM (SELECT scan_id, src AS node_id, CAST((dst_cls - 1) * 30 + bin AS INT) AS slot, count(*) AS n FROM links GROUP BY ALL)""",
    "graph_edge_hist": _with(*_scans(), _LINKS, _COUNTS, _GRAPH) + f"SELECT scan_id, slot, {_r('value', 'value')} FROM graph",
    "scan_descriptor": _with(*_scans(), _LINKS, _COUNTS, _GRAPH, _CELLS, _RINGS)
    + f"""SELECT scan_id, slot, {_r("value / sqrt(sum(value * value) OVER (PARTITION BY scan_id))", "value")}
FROM (SELECT * FROM graph UNION ALL SELECT scan_id, CAST(slot + 183 AS INT), value FROM rings)""",
    "polar_grid": _with(points_sql(), _POLAR, _CELLS, _GRID) + "SELECT * FROM grid",
    "ring_occupancy": _with(points_sql(), _POLAR, _CELLS, _RINGS) + f"SELECT scan_id, slot, {_r('value', 'value')} FROM rings",
    "grid_similarity": _with(points_sql(), _POLAR, _CELLS, _GRID)
    + f"""SELECT pair_id, n_equal, n_cells, {_r("n_equal / n_cells", "similarity")} FROM (
  SELECT coalesce(a.scan_id, b.scan_id - 1) AS pair_id, count(*) FILTER (WHERE a.label = b.label) AS n_equal, count(*) AS n_cells
  FROM (SELECT * FROM grid WHERE scan_id < (SELECT max(scan_id) FROM grid)) a
  FULL JOIN (SELECT * FROM grid WHERE scan_id >= 1) b ON b.scan_id - 1 = a.scan_id AND a.ring = b.ring AND a.sector = b.sector GROUP BY 1)""",
    "triangle_pruning": _with(*_scans(50), _PRUNE)
    + """SELECT i.scan_id AS pair_id, i.node_id AS match_id, i.node_id AS node_a, i.node_id AS node_b, coalesce(n_triangles, 0) AS n_triangles,
  count(*) OVER (PARTITION BY i.scan_id) < 15 OR coalesce(n_triangles >= CASE WHEN near_a > 3 AND near_b > 3 THEN 2 ELSE 1 END, false) AS kept
FROM inst i LEFT JOIN met ON met.scan_id = i.scan_id AND met.node_id = i.node_id""",
    "size_gated_pairs": _with(*_scans())
    + """SELECT a.scan_id AS pair_id, a.cls, a.node_id AS node_a, b.node_id AS node_b FROM inst a JOIN inst b ON b.scan_id = a.scan_id + 1 AND b.cls = a.cls
WHERE abs(a.dx - b.dx) <= 2 AND abs(a.dy - b.dy) <= 2 AND abs(a.dz - b.dz) <= 2""",
    "ransac_pose": _true_pairs(),
    "ransac_matched_pose": _true_pairs(),
    "icp_pose": _true_pairs(25),
    "icp_rounds_pose": _true_pairs(25),
    "plane_icp_pose": _true_pairs(25),
    "plane_normals": _with(patches_sql(), *_planes()) + f"SELECT scan_id, vx, vy, vz, n, {', '.join(_r(f'{k}{c}', f'{k}{c}') for k in 'mn' for c in 'xyz')} FROM planes",
    "plane_pairs": _with(patches_sql(), *_planes()) + _plane_pairs(),
    "loop_pose": _true_pairs(),
    "loop_similarity": _with(poses_sql(50))
    + """SELECT pair_id * 2 AS pair_id, CAST(1 AS INT) AS gt, true AS good FROM pose
UNION ALL SELECT pair_id * 2 + 1, 0, false FROM pose WHERE pair_id < (SELECT max(pair_id) FROM pose)""",
    "kabsch_moments": _with(points_sql(), poses_sql(), _COPIED) + f"SELECT pair_id, count(*) AS n, {_kabsch()} FROM copied GROUP BY pair_id",
    "kabsch_pose_error": _with(poses_sql()) + "SELECT pair_id, 0.0::DOUBLE AS rte, 0.0::DOUBLE AS rre, true AS success FROM pose",
    "icp_normal_equations": _with(points_sql(), _NEAREST) + f"SELECT pair_id, count(*) AS n, {_normal_equations()} FROM near GROUP BY pair_id",
    "plane_moments": _with(points_sql())
    + f"""SELECT scan_id, vx, vy, vz, count(*) AS n, {_moments()} FROM (SELECT scan_id, x, y, z, {_VOXEL(20)} FROM pts WHERE label IN ({_BG}))
GROUP BY scan_id, vx, vy, vz HAVING count(*) >= 3""",
    "rigid_transform": _with(points_sql(), poses_sql(), _COPIED) + f'''SELECT pair_id, pt_idx, {_r('bx', 'bx')}, {_r('"by"', '"by"')}, {_r('bz', 'bz')} FROM copied''',
    "rte_rre": _with(poses_sql(), _ERRORS) + f"SELECT pair_id, {_r('rte', 'rte')}, {_r('rre', 'rre')}, success FROM judged",
    "pose_success_rate": _with(poses_sql(), _ERRORS)
    + f"""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE success) AS n_success, {_r("avg(CAST(success AS INT))", "success_rate")},
  {_r("avg(CASE WHEN success THEN rte END)", "mean_rte")}, {_r("avg(CASE WHEN success THEN rre END)", "mean_rre")} FROM judged""",
    "pose_inverse": _with(poses_sql()) + f"SELECT pair_id, {_inverse()} FROM pose",
    "alignment_fit_score": _with(*_scans())
    + f"""SELECT pair_id, {_r("avg(CASE WHEN a_cls = b_cls AND d2 < 0.2 THEN d2 ELSE 0 END)", "fit_score")}, count(*) AS n_nodes FROM (
  SELECT a.scan_id AS pair_id, a.node_id, a.cls AS a_cls, b.cls AS b_cls, {_FIT_D2} AS d2 FROM inst a JOIN inst b ON a.scan_id = b.scan_id
  QUALIFY row_number() OVER (PARTITION BY a.scan_id, a.node_id ORDER BY d2, b.node_id) = 1) GROUP BY pair_id""",
}
