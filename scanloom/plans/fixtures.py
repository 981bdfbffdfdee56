"""Scans, pairs and poses that the driver's tables define, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import transform
from ..functions.labels import PLANES, train_label

POINTS_A_VECTOR = 20
# Raw class by the label of a vector.
RAW_LABELS = (10, 18, 20, 71, 80, 40, 50, 51, 70, 252)
COPY = 1_000_000


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def points(spark: SparkSession, sf_dir: str, vectors_a_scan: int = 25) -> DataFrame:
    """Vectors as points: classes 0-4 in compact objects, 5-8 scattered, 9 moving."""
    e = lambda i: F.get(F.col("embedding"), i).cast("double")
    j = F.col("j")
    compact = F.col("label") < 5
    return (
        embeddings(spark, sf_dir)
        .select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(POINTS_A_VECTOR - 1))).alias("j"))
        .select(
            F.expr(f"vec_id div {vectors_a_scan}").alias("scan_id"),
            ((F.col("vec_id") % vectors_a_scan) * POINTS_A_VECTOR + j).cast("int").alias("pt_idx"),
            F.when(compact, e(F.lit(0)) * 120 + e(3 * j + 3) * 3).otherwise(e(3 * j + 3) * 240).alias("x"),
            F.when(compact, e(F.lit(1)) * 120 + e(3 * j + 4) * 3).otherwise(e(3 * j + 4) * 240).alias("y"),
            (e(3 * j + 5) * 2 - 1.0).alias("z"),
            F.get(F.array(*[F.lit(x) for x in RAW_LABELS]), F.col("label")).alias("raw_label"),
        )
        .withColumn("label", train_label(F.col("raw_label")))
    )


PATCH, PATCH_STEP = 6, 0.26


def patches(spark: SparkSession, sf_dir: str, vectors_a_scan: int = 25) -> DataFrame:
    """Vectors as flat squares of 36 points, of road, buildings and fences: a square lies
    at components 0 to 2, along components 3 to 5, tilted by 6 to 8."""
    e = lambda i: F.get(F.col("embedding"), F.lit(i)).cast("double")
    base = embeddings(spark, sf_dir).select("vec_id", *[(e(i) * k).alias(f"o{i}") for i, k in enumerate((80, 80, 8))], *[e(i).alias(f"e{i}") for i in range(3, 9)])
    c = lambda name, of: [F.col(f"{name}{i}") for i in of]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    u = c("e", (3, 4, 5))
    base = base.select("vec_id", *c("o", (0, 1, 2)), *c("e", (6, 7, 8)), *[(x / norm(u)).alias(f"u{i}") for i, x in enumerate(u)])
    n = cross(c("u", (0, 1, 2)), c("e", (6, 7, 8)))
    base = base.select("vec_id", *c("o", (0, 1, 2)), *c("u", (0, 1, 2)), *[(x / norm(n)).alias(f"n{i}") for i, x in enumerate(n)])
    w = cross(c("n", (0, 1, 2)), c("u", (0, 1, 2)))
    base = base.select("*", *[x.alias(f"w{i}") for i, x in enumerate(w)]).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PATCH * PATCH - 1))))
    p, q = ((x - (PATCH - 1) / 2) * PATCH_STEP for x in (F.expr(f"j div {PATCH}").cast("double"), (F.col("j") % PATCH).cast("double")))
    return base.select(
        F.expr(f"vec_id div {vectors_a_scan}").alias("scan_id"),
        ((F.col("vec_id") % vectors_a_scan) * PATCH * PATCH + F.col("j")).cast("int").alias("pt_idx"),
        *[(F.col(f"o{i}") + p * F.col(f"u{i}") + q * F.col(f"w{i}")).alias(a) for i, a in enumerate("xyz")],
        F.get(F.array(*[F.lit(x) for x in PLANES]), (F.col("vec_id") % 3).cast("int")).alias("label"),
    )


def _pose(angle: F.Column, shift: list) -> F.Column:
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, shift[0], s, c, zero, shift[1], zero, zero, one, shift[2])


def poses(spark: SparkSession, sf_dir: str, vectors_a_scan: int = 25) -> DataFrame:
    """(pair_id, truth, pose) for each scan: the motion of its copy, and an estimate
    that is off by more the larger the scan's number modulo 40."""
    scans = embeddings(spark, sf_dir).select(F.expr(f"vec_id div {vectors_a_scan}").alias("pair_id")).distinct()
    s, off = F.col("pair_id"), (F.col("pair_id") % 40).cast("double")
    angle = F.lit(0.05) * (s + 1)
    step = (1 + s % 3).cast("double")
    shift = [step * k for k in (0.5, -0.3, 0.02)]
    guess = [shift[0] + off * 0.07, shift[1], shift[2]]
    return scans.select("pair_id", _pose(angle, shift).alias("truth"), _pose(angle + off * 0.004, guess).alias("pose"))


def near_poses(spark: SparkSession, sf_dir: str, vectors_a_scan: int = 25) -> DataFrame:
    """(pair_id, truth, pose) for each scan: the motion of its copy, and a guess that is
    off by 0.15 m and 0.34 degrees."""
    step = (1 + F.col("pair_id") % 3).cast("double")
    shift = [step * 0.5 + 0.12, step * -0.3 - 0.08, step * 0.02 + 0.05]
    guess = _pose(F.lit(0.05) * (F.col("pair_id") + 1) + 0.006, shift)
    return poses(spark, sf_dir, vectors_a_scan).select("pair_id", "truth", guess.alias("pose"))


def copies(table: DataFrame, moved: DataFrame) -> DataFrame:
    """points moved by each scan's true pose, as scans COPY + number."""
    joined = table.join(moved.select(F.col("pair_id").alias("scan_id"), "truth"), "scan_id")
    new = transform(F.col("truth"), F.col("x"), F.col("y"), F.col("z"))
    own = [c for c in table.columns if c not in ("scan_id", "x", "y", "z")]
    return joined.select((F.col("scan_id") + COPY).alias("scan_id"), *[e.alias(c) for e, c in zip(new, "xyz", strict=True)], *own).select(*table.columns)


def pairs_with_copies(spark: SparkSession, sf_dir: str, vectors_a_scan: int = 25) -> DataFrame:
    """Each scan with its own copy (gt 1) and with the copy of the next (gt 0)."""
    scans = poses(spark, sf_dir, vectors_a_scan).select("pair_id")
    own = scans.select((F.col("pair_id") * 2).alias("pair_id"), F.col("pair_id").alias("scan_a"), (F.col("pair_id") + COPY).alias("scan_b"), F.lit(1).alias("gt"))
    other = scans.select((F.col("pair_id") * 2 + 1).alias("pair_id"), F.col("pair_id").alias("scan_a"), (F.col("pair_id") + COPY + 1).alias("scan_b"), F.lit(0).alias("gt"))
    last = scans.agg(F.max("pair_id") + COPY).scalar()
    return own.unionByName(other.where(F.col("scan_b") <= last))


# The same tables in SQL.
def points_sql(vectors_a_scan: int = 25, name: str = "pts") -> str:
    from ..functions.labels import LEARNING_MAP

    cases = " ".join(f"WHEN {raw} THEN {LEARNING_MAP[raw]}" for raw in RAW_LABELS)
    e = lambda i: f"CAST(embedding[{i} + 1] AS DOUBLE)"
    axis = lambda k: f"CASE WHEN label < 5 THEN {e(k)} * 120 + {e(f'3 * j + {3 + k}')} * 3 ELSE {e(f'3 * j + {3 + k}')} * 240 END"
    return f"""{name} AS (SELECT *, CAST(CASE raw_label {cases} ELSE 0 END AS INT) AS label FROM (
  SELECT vec_id // {vectors_a_scan} AS scan_id, CAST((vec_id % {vectors_a_scan}) * {POINTS_A_VECTOR} + j AS INT) AS pt_idx, {axis(0)} AS x, {axis(1)} AS y,
         {e("3 * j + 5")} * 2 - 1.0 AS z, ({list(RAW_LABELS)})[label + 1] AS raw_label
  FROM embeddings, unnest(range({POINTS_A_VECTOR})) AS u(j)))"""


def patches_sql(vectors_a_scan: int = 25, name: str = "pts") -> str:
    e = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
    norm = lambda v: f"sqrt({' + '.join(f'{v}{i} * {v}{i}' for i in range(3))})"
    cross = lambda p, q: [f"({p}{i} * {q}{j} - {p}{j} * {q}{i})" for i, j in ((1, 2), (2, 0), (0, 1))]
    three = lambda found, v: ", ".join(f"{x} AS {v}{i}" for i, x in enumerate(found))
    half = f"{(PATCH - 1) / 2}::DOUBLE) * {PATCH_STEP}::DOUBLE"
    axes = ", ".join(f"o{i} + (CAST(j // {PATCH} AS DOUBLE) - {half} * u{i} + (CAST(j % {PATCH} AS DOUBLE) - {half} * w{i} AS {a}" for i, a in enumerate("xyz"))
    return f"""{name} AS (SELECT vec_id // {vectors_a_scan} AS scan_id, CAST((vec_id % {vectors_a_scan}) * {PATCH * PATCH} + j AS INT) AS pt_idx, {axes}, ({list(PLANES)})[vec_id % 3 + 1] AS label
  FROM (SELECT *, {three(cross("n", "u"), "w")} FROM (SELECT *, {three([f"m{i} / {norm('m')}" for i in range(3)], "n")} FROM (
    SELECT *, {three(cross("u", "t"), "m")} FROM (SELECT *, {three([f"d{i} / {norm('d')}" for i in range(3)], "u")} FROM (
      SELECT vec_id, {three([f"{e(i)} * {k}" for i, k in enumerate((80, 80, 8))], "o")}, {three([e(i) for i in (3, 4, 5)], "d")}, {three([e(i) for i in (6, 7, 8)], "t")} FROM embeddings))))),
    unnest(range({PATCH * PATCH})) AS k(j))"""


def poses_sql(vectors_a_scan: int = 25, name: str = "pose") -> str:
    def one(angle: str, dx: str) -> str:
        return f"[cos({angle}), -sin({angle}), 0.0::DOUBLE, {dx}, sin({angle}), cos({angle}), 0.0::DOUBLE, step * -0.3::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, step * 0.02::DOUBLE]"

    return f"""{name} AS (SELECT pair_id, {one("angle", "step * 0.5::DOUBLE")} AS truth,
         {one("(angle + off * 0.004::DOUBLE)", "(step * 0.5::DOUBLE + off * 0.07::DOUBLE)")} AS pose
  FROM (SELECT pair_id, 0.05::DOUBLE * (pair_id + 1) AS angle, CAST(1 + pair_id % 3 AS DOUBLE) AS step, CAST(pair_id % 40 AS DOUBLE) AS off
        FROM (SELECT DISTINCT vec_id // {vectors_a_scan} AS pair_id FROM embeddings)))"""


def move_sql(pose: str, x: str = "x", y: str = "y", z: str = "z") -> list[str]:
    return [f"({pose}[{4 * i + 1}] * {x} + {pose}[{4 * i + 2}] * {y} + {pose}[{4 * i + 3}] * {z} + {pose}[{4 * i + 4}])" for i in range(3)]
