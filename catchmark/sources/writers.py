"""CSV sink, cached intermediate tables, and tables built in parts that a broken run can go on with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut
from catchmark.sources.readers import exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def cached_table(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    recompute: bool = False,
    partition_by: Sequence[str] = (),
    **parameters,
) -> DataFrame:
    """Read the table under ``path`` when it is complete, else build and write it first.

    Each set of ``parameters`` has its own folder, so a run with others never reads this one's result.

    Written Parquet survives lost executors and cuts the lineage; ``_SUCCESS`` marks a finished write.
    """
    if parameters:
        path = f"{path.rstrip('/')}/{_name_of(parameters)}"
    if recompute or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def resumed_table(
    spark: SparkSession, path: str, keys: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int = 8, recompute: bool = False, **parameters
) -> DataFrame:
    """The rows ``build`` gives for ``keys``, built part by part; a run that broke off goes on after its last finished part.

    ``keys`` has one row for each key, in the columns by which parts are told apart; ``build(some_keys)`` must give the rows of these keys alone.
    A part's rows are written first, then a manifest of its keys, each as a folder of its own that counts once its ``_SUCCESS`` is there.
    So a part is either in the manifest as a whole or redone as a whole, and rows of a part that broke off are never read. A later run builds only
    the keys in no manifest: those left over by a broken run, or new ones. Keys without rows are in the manifest too and aren't tried again.

    Each part reads the input once, for the keys it holds; more parts lose less on a failure and read more. Part numbers follow from the
    manifests, so two runs must not write to one path at a time. Each set of ``parameters`` has its own folder; ``recompute`` starts a new
    generation there, finished generations stay until then.
    """
    root = path.rstrip("/")
    if parameters:
        root = f"{root}/{_name_of(parameters)}"
    generation = 0
    while exists(spark, f"{root}/closed-{generation}/_SUCCESS"):
        generation += 1
    if recompute and exists(spark, f"{root}/generation-{generation}/done-0/_SUCCESS"):
        spark.range(0).write.mode("overwrite").parquet(f"{root}/closed-{generation}")
        generation += 1
    root, columns = f"{root}/generation-{generation}", keys.columns
    finished = 0
    while exists(spark, f"{root}/done-{finished}/_SUCCESS"):
        finished += 1

    def manifest() -> DataFrame:
        return spark.read.schema(keys.schema).parquet(*[f"{root}/done-{k}" for k in range(finished)])

    wanted = keys.distinct()
    left = cut(wanted.join(manifest(), columns, "left_anti") if finished else wanted, "keys-left")
    part = F.pmod(F.xxhash64(*columns), F.lit(parts))
    for p in sorted(r["p"] for r in left.select(part.alias("p")).distinct().collect()):  # at most ``parts`` rows
        own = left.filter(part == p)
        build(own).write.mode("overwrite").parquet(f"{root}/rows-{finished}")
        own.write.mode("overwrite").parquet(f"{root}/done-{finished}")
        finished += 1
    if not finished:
        return build(wanted)
    every = spark.read.parquet(*[f"{root}/rows-{k}" for k in range(finished)])
    # an earlier run may have had keys that this one doesn't ask for
    return every.join(wanted, columns, "left_semi")


def _name_of(parameters: dict) -> str:
    said = ",".join(f"{k}={parameters[k]!r}" for k in sorted(parameters))
    return hashlib.sha256(said.encode()).hexdigest()[:16]
