"""Where tables go: delimited files, JSON, and folders numbered so that no run overwrites another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_folder(spark: SparkSession, base: str) -> str:
    """base, or base_1, base_2 ...: the first that isn't there, in any file system that Spark reaches."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    while True:
        name = f"{base}_{n}" if n else base
        path = jvm.org.apache.hadoop.fs.Path(name)
        if not path.getFileSystem(conf).exists(path):
            return name
        n += 1


def write_run(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> list[str]:
    """Each table as a folder of its own, with a header where the form has one; even empty tables are written."""
    for name, table in tables.items():
        table.write.option("header", True).format(form).save(f"{folder}/{name}.{form}")
    return [f"{folder}/{name}.{form}" for name in tables]


def write_by_flag(audit: DataFrame, folder: str, flags: list[str]) -> None:
    """Audited tracks as one partition per flag; a track with several flags is in each."""
    names = F.array_compact(F.array(*[F.when(F.col(f"flag_{n}"), F.lit(n)) for n in flags]))
    audit.withColumn("flag", F.explode(names)).write.partitionBy("flag").option("header", True).csv(folder)


def write_history(history: DataFrame, folder: str) -> None:
    """Tuning runs as JSON, best score first: the files' names follow the order, each file holds a range of scores."""
    history.orderBy(F.desc("score")).write.json(folder)
