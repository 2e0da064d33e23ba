"""Queries of header geometry, file selection, DICOM reading and design bookkeeping over the plain tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import headers, layout, lookup
from voxloom.plans.views import IMAGE_SQL, SHAPE, table
from voxloom.sources import dicom, motion

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _affine_rows(rows: DataFrame, key: str, affine: Column) -> DataFrame:
    """(key, i, j, v): the twelve entries of an affine."""
    long = rows.select(key, F.posexplode(affine).alias("k", "v")).filter("k < 12")
    return long.select(key, F.floor(F.col("k") / 4).cast("int").alias("i"), (F.col("k") % 4).alias("j"), (F.round("v", 6) + 0).alias("v"))


def _entries_sql(rows: list[list[str]], source: str, key: str) -> str:
    cells = ", ".join(f"({i}, {j}, {c})" for i, r in enumerate(rows) for j, c in enumerate(r))
    return f"SELECT {key}, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CAST(v AS DOUBLE), 6) + 0 AS v FROM {source}, LATERAL (VALUES {cells}) AS c(i, j, v)"


@query("WITH h AS (SELECT p_partkey, p_size AS n, p_retailprice / 1000 AS d FROM part) " + _entries_sql([["d", "0", "0", "-d * n / 2"], ["0", "d", "0", "-d * n / 2"], ["0", "0", "2 * d", "-2 * d * 36 / 2"]], "h", "p_partkey"))
def default_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affines of headers without an orientation: the middle of the volume at 0."""
    d, n = F.col("p_retailprice") / 1000, F.col("p_size")
    affine = headers.affine_column([[d, 0, 0, -d * n / 2], [0, d, 0, -d * n / 2], [0, 0, 2 * d, -2 * d * 36 / 2]])
    return _affine_rows(table(spark, sf_dir, "part"), "p_partkey", affine)


_ANALYZE = [["CASE WHEN o = 0 THEN d ELSE -d END", "0", "0", "CASE WHEN o = 0 THEN 0 ELSE d * o END"], ["0", "d", "0", "CASE WHEN o = 0 THEN 0 ELSE -d * (o - 1) END"], ["0", "0", "3", "CASE WHEN o = 0 THEN 0 ELSE -3.0 * (2 * o - 1) END"]]


@query("WITH h AS (SELECT p_partkey, p_size % 5 AS o, p_retailprice / 1000 AS d FROM part) " + _entries_sql(_ANALYZE, "h", "p_partkey"))
def analyze_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affines out of spacings and originators; some have none."""
    o, d = F.col("p_size") % 5, F.col("p_retailprice") / 1000
    return _affine_rows(table(spark, sf_dir, "part"), "p_partkey", headers.analyze_affine([d, d, F.lit(3.0)], [o, o, 2 * o]))


_R = [["-d", "0", "0"], ["0", "0.8 * d", "-1.2"], ["0", "0.6 * d", "1.6"]]
_AT = ["CASE WHEN ok THEN p - 1 ELSE 31 END", "CASE WHEN ok THEN p + 1 ELSE 31 END", "CASE WHEN ok THEN 9 ELSE 17 END"]


@query(
    "WITH h AS (SELECT p_partkey, p_retailprice / 1000 AS d, p_size * 2 AS p, p_size * 2 + 2 <= 64 AS ok FROM part) "
    + _entries_sql([[*r, "-(" + " + ".join(f"({a}) * ({b})" for a, b in zip(r, _AT, strict=True)) + ")"] for r in _R], "h", "p_partkey")
)
def reorient_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given voxel at 0 mm; the middle where it lies outside of the volume."""
    d, p = F.col("p_retailprice") / 1000, F.col("p_size") * 2
    old = headers.affine_column([[-d, 0, 0, 90], [0, 0.8 * d, -1.2, -126], [0, 0.6 * d, 1.6, -72]])
    rows = table(spark, sf_dir, "part").withColumn("old", old)
    new = headers.with_origin(F.col("old"), [F.lit(64), F.lit(64), F.lit(36)], [p, p + 2, F.lit(10)])
    return _affine_rows(rows, "p_partkey", new)


_TURN = np.array([[0.8, -0.6, 0, 5.0], [0.6, 0.8, 0, -3.0], [0, 0, 1, 2.0], [0, 0, 0, 1]])
_OLD = [["d", "0", "0", "-s"], ["0", "d", "0.1", "s / 2"], ["0", "-0.1", "3", "7"], ["0", "0", "0", "1"]]


@query("WITH h AS (SELECT p_partkey, p_size AS s, p_retailprice / 1000 AS d FROM part) " + _entries_sql([[" + ".join(f"{_TURN[i, k]} * ({_OLD[k][j]})" for k in range(4)) for j in range(4)] for i in range(3)], "h", "p_partkey"))
def reorient_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matrices applied to every header."""
    s, d = F.col("p_size"), F.col("p_retailprice") / 1000
    old = headers.affine_column([[d, 0, 0, -s], [0, d, 0.1, s / 2], [0, -0.1, 3, 7]])
    return _affine_rows(table(spark, sf_dir, "part").withColumn("old", old), "p_partkey", headers.product(_TURN, F.col("old")))


# row cosines (1, 0, 0), column cosines (0, c, s): the normal is (0, -s, c)
def _dicom_sql(mosaic: bool) -> list[list[str]]:
    x, y, z = ("-90 + 2 * d * 160", "p - 100 + 0.8 * 2 * d * 160", "p / 2 + 0.6 * 2 * d * 160") if mosaic else ("-90", "p - 100", "p / 2")
    d = "2 * d" if mosaic else "d"
    end = "* 63"
    return [[f"-{d}", "0", "0", f"-({x})"], ["0", f"0.8 * {d}", "0.6 * 3", f"-({y} + 0.8 * {d} {end})"], ["0", f"-0.6 * {d}", "0.8 * 3", f"{z} + 0.6 * {d} {end}"]]


def _dicom(spark: SparkSession, sf_dir: str, mosaic: bool) -> DataFrame:
    d, p = F.col("p_retailprice") / 1000, F.col("p_size")
    d = 2 * d if mosaic else d
    one = F.lit(1.0)
    affine = headers.dicom_affine([one, 0 * one, 0 * one], [0 * one, 0.8 * one, 0.6 * one], [F.lit(-90.0), p - 100, p / 2], [d, d, F.lit(3.0)], 36, F.lit(64), (F.lit(384), F.lit(384)) if mosaic else None)
    return _affine_rows(table(spark, sf_dir, "part"), "p_partkey", affine)


@query("WITH h AS (SELECT p_partkey, p_size AS p, p_retailprice / 1000 AS d FROM part) " + _entries_sql(_dicom_sql(False), "h", "p_partkey"))
def slice_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affines of single slices, from the patient's axes to right-anterior-superior mm."""
    return _dicom(spark, sf_dir, False)


@query("WITH h AS (SELECT p_partkey, p_size AS p, p_retailprice / 1000 AS d FROM part) " + _entries_sql(_dicom_sql(True), "h", "p_partkey"))
def mosaic_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of mosaics, whose position is that of the whole mosaic's corner."""
    return _dicom(spark, sf_dir, True)


@query("""WITH h AS (SELECT p_partkey, p_size % 3 AS m, CASE WHEN p_size % 2 = 0 THEN -0.95 ELSE 0.95 END AS c, 0.3 AS e FROM part),
a AS (SELECT p_partkey, m, CASE m WHEN 0 THEN [c, e, 0.0, e, 0.9, 0.1, 0.0, 0.1, 1.0] WHEN 1 THEN [e, c, 0.0, 0.9, e, 0.1, 0.1, 0.0, 1.0] ELSE [0.0, e, c, e, 0.9, 0.1, 1.0, 0.1, 0.0] END AS r FROM h),
n AS (SELECT *, sqrt(r[1]**2 + r[4]**2 + r[7]**2) AS n0, sqrt(r[2]**2 + r[5]**2 + r[8]**2) AS n1, sqrt(r[3]**2 + r[6]**2 + r[9]**2) AS n2 FROM a),
k AS (SELECT p_partkey, [r[1] / n0, r[2] / n1, r[3] / n2, r[4] / n0, r[5] / n1, r[6] / n2, r[7] / n0, r[8] / n1, r[9] / n2] AS q FROM n),
p(o, a, b, c) AS (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)),
f AS (SELECT p_partkey, q, a, b, c, row_number() OVER (PARTITION BY p_partkey ORDER BY round(abs(q[a + 1]) + abs(q[b + 4]) + abs(q[c + 7]), 9) DESC, o) AS n FROM k CROSS JOIN p)
SELECT p_partkey, concat(a, b, c) AS axes, concat(CAST(q[a + 1] < 0 AS INTEGER), CAST(q[b + 4] < 0 AS INTEGER), CAST(q[c + 7] < 0 AS INTEGER)) AS flips FROM f WHERE n = 1""")
def nearest_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which voxel axes run along x, y and z, and which of them backwards."""
    m, c = F.col("p_size") % 3, F.when(F.col("p_size") % 2 == 0, -0.95).otherwise(0.95)
    first = headers.affine_column([[c, 0.3, 0, 0], [0.3, 0.9, 0.1, 0], [0, 0.1, 1, 0]])
    second = headers.affine_column([[0.3, c, 0, 0], [0.9, 0.3, 0.1, 0], [0.1, 0, 1, 0]])
    third = headers.affine_column([[0, 0.3, c, 0], [0.3, 0.9, 0.1, 0], [1, 0.1, 0, 0]])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, first).when(m == 1, second).otherwise(third).alias("affine"))
    found = rows.select("p_partkey", headers.nearest_axes(F.col("affine")).alias("a"))
    return found.select("p_partkey", F.array_join(F.col("a.order").cast("array<string>"), "").alias("axes"), F.array_join(F.transform("a.flips", lambda f: f.cast("int").cast("string")), "").alias("flips"))


@query("SELECT p_partkey, (p_size % 7 = 0) OR (p_size * 10 >= 0.9 * ceil(sqrt(36)) * 64 AND p_size * 9 >= 0.9 * ceil(sqrt(36)) * 64) AS mosaic FROM part")
def mosaic_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, private = F.col("p_size"), F.when(F.col("p_size") % 7 == 0, 36)
    return table(spark, sf_dir, "part").select("p_partkey", headers.mosaic_tile(size * 10, size * 9, F.lit(36), private, F.lit(64)).alias("mosaic"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN ((l_partkey * 7919 % 65536) >> 2) & 4095 >= 2048 THEN (((l_partkey * 7919 % 65536) >> 2) & 4095) - 4096 ELSE ((l_partkey * 7919 % 65536) >> 2) & 4095 END AS v FROM lineitem")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed numbers out of twelve bits that end at bit 13."""
    v = dicom.stored_value(F.col("l_partkey") * 7919 % 65536, 12, 13, True)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


_PATH = "CASE WHEN p_size % 4 = 0 THEN 'root/' || replace(p_brand, '#', '') || '/f' || p_partkey WHEN p_size % 4 = 1 THEN 'root/' || replace(p_brand, '#', '') || '/a/f' || p_partkey ELSE 'root/' || p_size || '/b/c/f' || p_partkey END"


@query(f"""WITH f AS (SELECT p_partkey, {_PATH} AS path FROM part), d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM f)
SELECT p_partkey, path FROM d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT folder FROM d) o WHERE starts_with(d.folder, o.folder || '/'))""")
def shallowest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the highest folders that have any."""
    return dicom.shallowest(table(spark, sf_dir, "part").select("p_partkey", F.expr(_PATH).alias("path")))


@query(f"WITH {IMAGE_SQL}, n AS (SELECT t AS old, t // 40 AS series, row_number() OVER (PARTITION BY t // 40 ORDER BY t DESC) - 1 AS t FROM (SELECT DISTINCT t FROM vox)) SELECT n.series, n.t, z, y, x, round(round(v * 8000) / 100 - 5, 2) AS v FROM vox JOIN n ON n.old = vox.t")
def dicom_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaics of several series written as files (instance numbers backwards) and read again: the whole way from bytes to
    voxels."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", "embedding")

    def files(batches):
        for b in batches:
            pixels = np.round(layout.matrix(b.column("embedding")).astype(np.float32).astype(float) * 8000).reshape(-1, 8, 8)
            out = []
            for k, p in zip(b.column("vec_id").to_pylist(), pixels, strict=True):
                tags = {0x00080008: (b"CS", b"ORIGINAL\\PRIMARY\\MOSAIC"), 0x0020000E: (b"UI", b"1.2.%d" % (k // 40)), 0x00200013: (b"IS", str(1_000_000 - k).encode()), 0x00281052: (b"DS", b"-5"), 0x00281053: (b"DS", b"0.01")}
                out.append(dicom.encode(p, tags))
            yield pa.RecordBatch.from_arrays([pa.array([f"/scan/{k}.dcm" for k in b.column("vec_id").to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    found = dicom.mosaic_series(dicom.headers(rows.mapInArrow(files, "path string, content binary")), 4, 4)
    rows = found.select(F.substring("series", 5, 20).cast("long").alias("series"), F.col("t").cast("long").alias("t"), "data")
    return layout.voxels(rows, SHAPE).select("series", "t", "z", "y", "x", F.round("v", 2).alias("v"))


@query("""WITH f AS (SELECT p_brand, p_partkey, p_size % 2 AS stack, p_retailprice / 97.0 AS pos FROM part), l AS (SELECT *, CASE WHEN lag(stack) OVER w IS NOT NULL AND stack <> lag(stack) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS stack_ FROM l) SELECT p_partkey, stack_, CAST(dense_rank() OVER (PARTITION BY p_brand, stack_ ORDER BY round(pos, 2)) AS INTEGER) AS slice_ FROM r""")
def frame_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a multi-frame file: their stack and their slice in it."""
    frames = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 2).alias("stack"), (F.col("p_retailprice") / 97).alias("pos"))
    return dicom.frame_places(frames, ["p_brand"], ["p_partkey"], "pos", "stack").select("p_partkey", "stack_", "slice_")


@query("""WITH l AS (SELECT p_partkey, p_brand, p_retailprice, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 5 THEN 1 ELSE 0 END AS far FROM part)
SELECT p_partkey, CAST(sum(far) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS group_ FROM l""")
def tolerant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers whose values differ by no more than a tolerance from the next one."""
    return dicom.tolerant_groups(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_partkey", 5.0).select("p_partkey", "group_")


@query("""WITH f AS (SELECT p_brand, unnest(['size', 'kind', 'maker']) AS key, unnest([CAST(p_size AS VARCHAR), 'a', substr(p_brand, 7, 1)]) AS value FROM part)
SELECT p_brand, key, min(value) = max(value) AS constant, CASE WHEN min(value) = max(value) THEN min(value) END AS value FROM f GROUP BY p_brand, key""")
def sidecar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields that are one for a whole series, and those that differ from slice to slice."""
    rows = table(spark, sf_dir, "part")
    fields = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("size", F.col("p_size").cast("string")), ("kind", F.lit("a")), ("maker", F.substring("p_brand", 7, 1)))])
    return dicom.sidecar(rows.select("p_brand", F.explode(fields).alias("f")).select("p_brand", "f.*"), ["p_brand"])


@query("""SELECT level, c_custkey, name, born FROM (SELECT 'none' AS level, o_custkey AS c_custkey, o_orderpriority AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS born, o_orderkey FROM orders
UNION ALL SELECT 'basic', o_custkey, NULL, CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR), o_orderkey FROM orders UNION ALL SELECT 'full', o_custkey, NULL, NULL, o_orderkey FROM orders)""")
def anonymity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers at all three levels."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("born"))
    levels = [headers.age_group(level, {"name": "name", "born": "date"}, rows).select(F.lit(level).alias("level"), "c_custkey", "name", F.col("born").cast("string").alias("born")) for level in ("none", "basic", "full")]
    return levels[0].union(levels[1]).union(levels[2])


@query("""WITH c(k, name) AS (VALUES (0, 'TANDA'), (1, 'Brand#11'), (2, 'rand#2'), (3, 'nothing')), d AS (SELECT row_number() OVER (ORDER BY name) - 1 AS col, name FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part)),
e AS (SELECT c.k, min(d.col) AS col FROM c JOIN d ON d.name = c.name GROUP BY c.k), p AS (SELECT c.k, min(d.col) AS col FROM c JOIN d ON contains(d.name, c.name) GROUP BY c.k)
SELECT c.k, c.name, coalesce(e.col, p.col, -1) AS col FROM c LEFT JOIN e ON e.k = c.k LEFT JOIN p ON p.k = c.k""")
def condition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions with their design columns: by name, else the first column whose name has it in."""
    part = table(spark, sf_dir, "part")
    names = sorted(r[0] for r in part.select("p_type").union(part.select("p_brand")).distinct().collect())  # the names of a design
    columns = spark.createDataFrame(list(enumerate(names)), "col long, name string")
    wanted = spark.createDataFrame([(0, "TANDA"), (1, "Brand#11"), (2, "rand#2"), (3, "nothing")], "k int, name string")
    return lookup.columns_of(wanted, columns).withColumn("col", F.coalesce("col", F.lit(-1)))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a' || p_partkey END AS a, CASE WHEN p_size % 3 = 0 THEN 'b' || p_partkey END AS b, 'c' || p_partkey AS c FROM part) SELECT p_partkey, coalesce(a, b, c) AS path FROM p""")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several candidate files the first that is there."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    name = lambda letter: F.concat(F.lit(letter), F.col("p_partkey").cast("string"))
    there = part.filter("p_size % 2 = 0").select(name("a").alias("path")).union(part.filter("p_size % 3 = 0").select(name("b").alias("path"))).union(part.select(name("c").alias("path")))
    wanted = part.select("p_partkey", F.array(name("a"), name("b"), name("c")).alias("candidates"))
    return lookup.first_existing(wanted, ["p_partkey"], "candidates", there)


@query("""SELECT n_nationkey, coalesce(o.n, n_name) AS name, coalesce(o.k, n_regionkey) AS region FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS n, CASE WHEN s_nationkey % 2 = 0 THEN CAST(99 AS BIGINT) END AS k FROM supplier WHERE s_nationkey < 10 GROUP BY s_nationkey) o ON o.s_nationkey = n_nationkey""")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults with those settings replaced that an override gives."""
    base = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    given = table(spark, sf_dir, "supplier").filter("s_nationkey < 10").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("name"))
    return lookup.overridden(base, given.withColumn("region", F.when(F.col("n_nationkey") % 2 == 0, F.lit(99).cast("long"))), ["n_nationkey"])


@query("""SELECT event_type AS name, count(*) AS n, string_agg(CAST(CAST(floor(epoch(ts) / 3600) AS BIGINT) AS VARCHAR), ' ' ORDER BY ts, event_id) AS onsets FROM events GROUP BY event_type""")
def session_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's conditions: one row each with all onsets in order."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("onset"))
    got = lookup.conditions(rows, "event_type", ["ts", "event_id"], "onset")
    return got.select("name", "n", F.array_join(F.transform("onsets", lambda o: o.cast("string")), " ").alias("onsets"))


@query("""WITH w(step, prefix) AS (VALUES ('class', 'c'), ('import', 'rc'), ('warped', 'wc'), ('modulated', 'mwc')), k(tissue) AS (VALUES (1), (2), (3))
SELECT p_partkey, prefix || tissue || 'f' || p_partkey AS name FROM part CROSS JOIN w CROSS JOIN k WHERE (p_size >> (CASE step WHEN 'class' THEN 0 WHEN 'import' THEN 1 WHEN 'warped' THEN 2 ELSE 3 END)) & 1 = 1
UNION ALL SELECT p_partkey, 'mf' || p_partkey FROM part WHERE (p_size >> 4) & 1 = 1 UNION ALL SELECT p_partkey, 'BiasField_f' || p_partkey FROM part WHERE (p_size >> 5) & 1 = 1""")
def planned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a segmentation with given switches will write."""
    on = lambda k: F.shiftright("p_size", k).bitwiseAND(F.lit(1)) == 1
    switches = {n: on(k) for k, n in enumerate(("class", "import", "warped", "modulated", "corrected", "bias"))}
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), F.map_from_arrays(F.array(*map(F.lit, switches)), F.array(*switches.values())).alias("switches"))
    return lookup.planned_outputs(rows, "file", "switches", 3).select("p_partkey", "name")


@query("""SELECT coalesce(o_custkey, c_custkey) AS k, CASE WHEN c.c_custkey IS NULL THEN 'extra' WHEN o.o_custkey IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_custkey FROM orders) o FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) c ON c.c_custkey = o.o_custkey""")
def parity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected artefacts against those that are there."""
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return lookup.parity(table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k")), there, ["k"])


@query("""WITH a AS (SELECT DISTINCT p_size AS k FROM part), b AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS k FROM lineitem WHERE l_quantity < 20) SELECT k, row_number() OVER (ORDER BY f) AS place FROM (SELECT p_size AS k, min(p_partkey) AS f FROM part WHERE p_size NOT IN (SELECT k FROM b) GROUP BY p_size)""")
def ordered_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one list that another lacks, in the order in which they first came."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("k"), F.col("p_partkey").alias("f"))
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity < 20").select(F.col("l_quantity").cast("int").alias("k"))
    return lookup.ordered_difference(rows, gone, "k", "f").select("k", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT o_custkey % 10 AS subject, CAST(row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) - 1 AS INTEGER) AS t, o_totalprice AS tx FROM orders) SELECT subject, t, tx, tx * 2 AS v FROM m""")
def motion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion beside its scans, one to one by subject and scan."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 10).orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("subject"), place.alias("t"), F.col("o_totalprice").alias("tx"))
    return motion.aligned(rows, rows.select("subject", "t", (F.col("tx") * 2).alias("v")), ["subject", "t"]).select("subject", "t", "tx", "v")


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_type LIKE '%PROMO%' THEN 'mosaic' WHEN p_type LIKE '%STANDARD%' THEN 'standard' ELSE 'guff' END AS class FROM part) SELECT class || '/' || p_partkey AS file, class FROM c WHERE class <> 'guff'""")
def converted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by class, each class through its converter, and the lists of files together again."""
    kind = F.when(F.col("p_type").contains("PROMO"), "mosaic").when(F.col("p_type").contains("STANDARD"), "standard").otherwise("guff")
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("class"))
    convert = lambda d: d.select(F.concat_ws("/", "class", F.col("p_partkey").cast("string")).alias("file"), "class")
    return lookup.routed(rows, "class", {"mosaic": convert, "standard": convert})
