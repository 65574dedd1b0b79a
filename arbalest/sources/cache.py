"""Feature caches: Parquet tables keyed by file fingerprint and settings."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbalest.sources.staging import located


def cached(inputs: DataFrame, path: str, settings: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of ``inputs`` (fingerprint, ...): known ones come from the table, the others are computed and added.

    ``compute`` keeps the column ``fingerprint``. Each call writes a folder of its own beside the table and moves it in whole when it is
    complete, so that readers never see a part; nothing is written where nothing is missing; where two writers add one fingerprint, one of its rows is read. Rows of other
    settings are neither read nor touched.
    """
    spark, folder = inputs.sparkSession, f"{path}/settings-{hashlib.sha256(settings.encode()).hexdigest()[:16]}"
    at, files = located(spark, folder)

    def known() -> DataFrame | None:
        batches = [b.getPath().toString() for b in files.listStatus(at)] if files.exists(at) else []
        return spark.read.parquet(*batches) if batches else None

    have = known()
    missing = inputs if have is None else inputs.join(have.select("fingerprint").distinct(), "fingerprint", "left_anti")
    wanted = inputs.select("fingerprint").distinct()
    if have is not None and missing.isEmpty():
        return have.dropDuplicates(["fingerprint"]).join(wanted, "fingerprint", "left_semi").select(F.col("*"))
    name = uuid.uuid4().hex
    new = f"{path}/_new-{name}"
    compute(missing).write.parquet(new)
    files.mkdirs(at)
    if not files.rename(located(spark, new)[0], located(spark, f"{folder}/{name}")[0]):
        raise OSError(f"could not move {new} into {folder}")
    return known().dropDuplicates(["fingerprint"]).join(wanted, "fingerprint", "left_semi").select(F.col("*"))


def prefix_key(df: DataFrame, settings: str = "") -> str:
    """What the rows of a deterministic plan follow from: its canonical form and the names, sizes and times of the files under it. Python
    functions show in a plan by name and type only; what else they depend on goes into ``settings``."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        raise ValueError("the plan is not deterministic, its rows cannot be kept")
    files = []
    for name in sorted(df.inputFiles()):
        at, system = located(spark, name)
        state = system.getFileStatus(at)
        files.append((name, state.getLen(), state.getModificationTime()))
    shape = plan.canonicalized().toJSON()
    shape = re.sub(r'"exprId":\{[^}]*\}|"jvmId":"[^"]*"', "", shape)
    return hashlib.sha256(repr((shape, df.schema.json(), df.semanticHash(), files, settings)).encode()).hexdigest()


def cached_prefix(df: DataFrame, path: str, settings: str = "") -> DataFrame:
    """``df`` from a table in ``path`` under its ``prefix_key``; computed and written there if it is the first with this key. A table is moved in
    whole when it is complete; where two writers make one key, the first stays."""
    spark, folder = df.sparkSession, f"{path}/{prefix_key(df, settings)}"
    at, files = located(spark, folder)
    if not files.exists(at):
        new = f"{path}/_new-{uuid.uuid4().hex}"
        df.write.parquet(new)
        if not files.rename(located(spark, new)[0], at) and not files.exists(at):
            raise OSError(f"could not move {new} to {folder}")
        files.delete(located(spark, new)[0], True)  # left only where another writer was first
    return spark.read.schema(df.schema).parquet(folder)
