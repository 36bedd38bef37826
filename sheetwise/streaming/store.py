"""Current rows of a changing table: a base, the changes since, and a record of which counts.

Every commit names one base folder and one folder of changes (each row the latest of
its key), so a reader opens two folders however many batches there were. Changes are
merged into a new base once they are a share of it. A commit record is created only if
its number is free, so of two writers one is refused. Merging keeps the row with the
highest order value per key; a batch that comes again changes nothing, and neither does
an older row from a run that lost its checkpoint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Changes are merged into the base when they reach this share of its rows.
MERGE_SHARE = 0.25


class CommitRefused(RuntimeError):
    """Another writer has taken the commit number."""


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _last_commit(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest record; 0 and an empty one where there is none."""
    files, place = _folder(spark, f"{path}/commits")
    if not files.exists(place):
        return 0, {"base": None, "changes": None, "base_rows": 0}
    number = max((int(entry.getPath().getName()) for entry in files.listStatus(place)), default=0)
    if not number:
        return 0, {"base": None, "changes": None, "base_rows": 0}
    return number, json.loads(spark.read.text(f"{path}/commits/{number:012d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    files, place = _folder(spark, f"{path}/commits/{number:012d}")
    try:
        out = files.create(place, False)
    except Exception as error:
        if "AlreadyExists" not in str(error):
            raise
        raise CommitRefused(f"commit {number} of {path} is taken") from error
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def _latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    values = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row_")).select(*keys, "_row_.*")


def _parts(spark: SparkSession, path: str, commit: dict, names: Sequence[str]) -> DataFrame | None:
    folders = [f"{path}/{commit[name]}" for name in names if commit[name]]
    return spark.read.parquet(*folders) if folders else None


def merge_rows(rows: DataFrame, path: str, keys: Sequence[str], order: str) -> None:
    """Put ``rows`` into the table at ``path``: the row with the highest ``order`` of each key stays.
    Rows with a null order never replace others."""
    spark = rows.sparkSession
    number, now = _last_commit(spark, path)
    changes = f"changes-{uuid.uuid4().hex}"
    earlier = _parts(spark, path, now, ["changes"])
    _latest(rows if earlier is None else rows.unionByName(earlier), keys, order).write.parquet(f"{path}/{changes}")
    found = dict(now, changes=changes)
    if spark.read.parquet(f"{path}/{changes}").count() >= MERGE_SHARE * now["base_rows"]:
        base = f"base-{uuid.uuid4().hex}"
        _latest(_parts(spark, path, found, ["base", "changes"]), keys, order).write.parquet(f"{path}/{base}")
        found = {"base": base, "changes": None, "base_rows": spark.read.parquet(f"{path}/{base}").count()}
    _commit(spark, path, number + 1, found)


def last_number(spark: SparkSession, path: str) -> int:
    """Number of the newest commit; 0 where nothing was written yet."""
    return _last_commit(spark, path)[0]


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], order: str) -> DataFrame:
    """The table as of the newest commit."""
    _, now = _last_commit(spark, path)
    rows = _parts(spark, path, now, ["base", "changes"])
    if rows is None:
        raise ValueError(f"nothing was written to {path} yet")
    return _latest(rows, keys, order)
