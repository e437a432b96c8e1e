"""Derived tables that are reused or built: a store of artifacts, each described by a manifest.

An artifact is a set of tables (and small values) made from input files with parameters. Its manifest holds a key of the inputs' names, sizes and times and of the
parameters, and what files each table has. It is written beside and renamed into place, so readers see the whole old artifact or the whole new one; tables go to
a folder of their own for each key. All files are reached through Hadoop's file systems, on any store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import hadoop

MANIFEST = "manifest.json"


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name below path, bytes, time of change in ms) of all files, by name; FileNotFoundError if there is nothing."""
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    root, found, it = p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString(), [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString().removeprefix(root).lstrip("/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append((name, f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, inputs: list[str], params: dict) -> str:
    """A key of the parameters and of names, sizes and times of the inputs' files."""
    state = {"params": params, "inputs": {p: files_of(spark, p) for p in inputs}}
    return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()[:32]


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None if it isn't there."""
    fs, p = hadoop(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(p) else None


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old one or the new one, never a part."""
    fs, p = hadoop(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}"
    _, d = hadoop(spark, draft)
    stream = fs.create(d, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    absolute = [x.makeQualified(fs.getUri(), fs.getWorkingDirectory()) for x in (d, p)]
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(absolute[0].toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(*absolute, options)


class Store:
    """Artifacts by name below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.root}/{name}/{MANIFEST}")
        return json.loads(text) if text else None

    def paths(self, name: str) -> dict[str, str]:
        """Where the tables of an artifact are."""
        m = self.manifest(name)
        if m is None:
            raise FileNotFoundError(f"no artifact {name!r} in {self.root}")
        return {t: f"{self.root}/{name}/{m['key']}/{t}" for t in m["tables"]}

    def catalogue(self) -> list[dict]:
        """name, key, params and paths of every artifact, by name."""
        fs, p = hadoop(self.spark, self.root)
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []
        found = [(n, self.manifest(n)) for n in names]
        return [{"name": n, "key": m["key"], "params": m["params"], "values": m["values"], "paths": self.paths(n)} for n, m in found if m]

    def load(self, name: str) -> tuple[dict[str, DataFrame], dict]:
        """Tables and values of an artifact. FileNotFoundError where it isn't there or files of it are missing or changed in size."""
        m = self.manifest(name)
        paths = self.paths(name)
        for table, path in paths.items():
            try:
                there = {n: size for n, size, _ in files_of(self.spark, path)}
            except FileNotFoundError:
                there = {}
            lost = [n for n, size in m["tables"][table] if there.get(n) != size]
            if lost:
                raise FileNotFoundError(f"artifact {name!r} has lost {len(lost)} files of {table!r}, as {path}/{lost[0]}; build it anew with force")
        return {t: self.spark.read.parquet(p) for t, p in paths.items()}, m["values"]

    def get_or_build(self, name: str, inputs: list[str], params: dict, build: Callable[[], tuple[dict[str, DataFrame], dict]], force: bool = False) -> tuple[dict[str, DataFrame], dict]:
        """The artifact, if it was built from these inputs as they are now and with these parameters; else what build() returns (tables, values that JSON can hold) is
        written and published. Tables of an older key are deleted after that."""
        key = fingerprint(self.spark, inputs, params)
        old = self.manifest(name)
        if old and old["key"].split("-")[0] == key and not force:
            return self.load(name)
        place = f"{key}-{uuid.uuid4().hex[:8]}"  # a forced build doesn't write over what readers may have open
        tables, values = build()
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{place}/{table}")
        listed = {t: [(n, size) for n, size, _ in files_of(self.spark, f"{self.root}/{name}/{place}/{t}")] for t in tables}
        publish(self.spark, f"{self.root}/{name}/{MANIFEST}", json.dumps({"key": place, "params": params, "inputs": inputs, "tables": listed, "values": values}, sort_keys=True, default=str))
        if old:
            fs, p = hadoop(self.spark, f"{self.root}/{name}/{old['key']}")
            fs.delete(p, True)
        return self.load(name)
