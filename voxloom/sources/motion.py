"""Motion tables: tab-separated text of six numbers per scan, without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = ("tx", "ty", "tz", "rx", "ry", "rz")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(subject, t, tx .. rz); a file per subject, named after it, or in a folder named subject=... as ``write`` leaves it.
    Any white space separates the numbers."""
    lines = spark.read.text(path, wholetext=True)
    name = F.col("subject").cast("string") if "subject" in lines.columns else F.regexp_extract(F.input_file_name(), r"rp_([^/]*)\.txt$", 1)
    lines = lines.select(name.alias("subject"), "value")
    rows = lines.select("subject", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("t", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    return rows.select("subject", "t", *[F.get(cells, F.lit(k)).cast("double").alias(n) for k, n in enumerate(NAMES)])


def write(motion: DataFrame, path: str) -> None:
    """Text files under ``path``/subject=.../, one per subject, scans in order."""
    w = Window.partitionBy("subject")
    rows = motion.withColumn("_n", F.count("*").over(w)).repartition("subject").sortWithinPartitions("subject", "t")
    rows.select("subject", F.concat_ws("\t", *[F.format_string("%.8f", n) for n in NAMES]).alias("value")).write.partitionBy("subject").text(path)


def aligned(motion: DataFrame, scans: DataFrame, on: str | list[str] = "t") -> DataFrame:
    """Scans with their motion, one to one: a scan without a row of motion, a row without a scan, or a key that occurs twice
    is an error."""
    keys = [on] if isinstance(on, str) else list(on)
    a = motion.withColumn("_m", F.count("*").over(Window.partitionBy(*keys)))
    b = scans.withColumn("_s", F.count("*").over(Window.partitionBy(*keys)))
    both = b.join(a, keys, "full")
    one = F.coalesce((F.col("_m") == 1) & (F.col("_s") == 1), F.lit(False))
    if both.filter(~one).limit(1).count():
        raise ValueError("motion and scans don't match one to one")
    return both.drop("_m", "_s")
