"""Tables with a commit log: immutable data folders, and numbered manifests that say which of them are the table.

A commit writes its data to a folder of its own and then publishes one small manifest, by a rename that fails if that
version exists. Readers resolve the newest manifest (or an older one), so a table is never missing or half written, and
a reader keeps the version it began with until :func:`vacuum` removes it. A writer says which version it has built on;
if another one was committed meanwhile it fails with :class:`OutdatedBase`, and its data is never seen.

A manifest lists folders by part: a key such as a day, so that one part can be replaced without touching the others.
Listing and publishing are calls on the driver whose number does not depend on the data, but on the versions kept.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quaestor.sources import fs

LOG = "_commits"


class OutdatedBase(RuntimeError):
    """Another version was committed since the base of this one."""


@dataclass(frozen=True)
class Manifest:
    """One version of a table: its schema, the folders of every part, and notes of the writer."""

    version: int
    schema: str
    parts: dict[str, list[str]] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def folders(self) -> list[str]:
        return [folder for part in self.parts.values() for folder in part]


def _name(version: int) -> str:
    return f"{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first; none for a table that does not exist."""
    files = fs.names(spark, f"{path}/{LOG}")
    return sorted(int(n.removesuffix(".json")) for n in files if n.endswith(".json") and not n.startswith((".", "_")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version; None where there is none."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise LookupError(f"{path} has no version {version}")
    return Manifest(**json.loads(fs.read_text(spark, f"{path}/{LOG}/{_name(version)}")))


def publish(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    """Make ``new`` the newest version; fails if its number is taken or not the next one."""
    known = versions(spark, path)
    if new.version != (known[-1] + 1 if known else 0):
        raise OutdatedBase(f"{path}: version {new.version} does not follow {known[-1:] or 'nothing'}")
    staged = f"{path}/{LOG}/.{uuid.uuid4().hex}"
    fs.write_text(spark, staged, json.dumps(vars(new), sort_keys=True))
    if not fs.rename_new(spark, staged, f"{path}/{LOG}/{_name(new.version)}"):
        fs.remove(spark, staged)
        raise OutdatedBase(f"{path}: version {new.version} was committed by another writer")
    return new


def new_folder() -> str:
    """A data folder that no manifest names yet, relative to the table."""
    return f"data/{uuid.uuid4().hex}"


def write_folder(df: DataFrame, path: str, compression: str = "snappy") -> str:
    """Write data to a new folder and return it."""
    folder = new_folder()
    df.write.option("compression", compression).parquet(f"{path}/{folder}")
    return folder


def commit(
    df: DataFrame, path: str, base: Manifest | None, append: bool = False, notes: dict | None = None
) -> Manifest:
    """The next version after ``base`` (None: the first): ``df`` alone, or added to the base's folders."""
    spark, path = df.sparkSession, path.rstrip("/")
    parts = dict(base.parts) if base and append else {}
    if append and base and StructType.fromJson(json.loads(base.schema)) != df.schema:
        raise ValueError("appended rows need the table's schema")
    folder = write_folder(df, path)
    parts[""] = [*parts.get("", []), folder]
    return publish(spark, path, Manifest(base.version + 1 if base else 0, df.schema.json(), parts, notes or {}))


def read(spark: SparkSession, path: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The table at its newest or at an older version; only some of its parts if named."""
    path = path.rstrip("/")
    found = manifest(spark, path, version)
    if found is None:
        raise LookupError(f"{path} has no version")
    schema = StructType.fromJson(json.loads(found.schema))
    folders = found.folders() if parts is None else [f for p in parts for f in found.parts.get(p, [])]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Forget all but the last ``keep`` versions and remove the data that only they named.

    Run it while no writer is at work: data that is not committed yet looks unused.
    """
    path, known = path.rstrip("/"), versions(spark, path)
    needed = {f for v in known[-keep:] for f in manifest(spark, path, v).folders()}
    for version in known[:-keep]:
        fs.remove(spark, f"{path}/{LOG}/{_name(version)}")
    gone = []
    for name in fs.names(spark, f"{path}/data"):
        if not any(f == f"data/{name}" or f.startswith(f"data/{name}/") for f in needed):
            fs.remove(spark, f"{path}/data/{name}")
            gone.append(name)
    return gone
