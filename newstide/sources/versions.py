"""Versions of a set of tables under one root, committed together.

A version is written next to the ones before it and takes effect with one small file, written last:
its manifest, which names the folders of every table. A reader takes the newest manifest and keeps to
it. A save that stops half-way leaves folders no manifest names; readers never see them.

Tables with texts lie in parts, by symbol or by a hash of it, and a manifest names every part: one
that a new version leaves alone keeps its files. Slim tables with a row per symbol and day are
*clustered*: hashed by symbol into a fixed number of files that Spark knows as buckets, each sorted by
symbol and date, so that windows and groups by symbol need no shuffle.
"""

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from newstide import schemas
from newstide.sources.layout import create_once, file_names, read_text, remove_table

COMMITS, DATA = "_commits", "_data"
PART, SYMBOL_PARTS = "part", 256
# Files of a clustered table.
BUCKETS = 32
# Tables whose rows are stored with a digest, so that a merge compares copies without their texts.
DIGESTED, DIGEST = ("articles",), "_digest"


class CommitConflict(RuntimeError):
    """Another version was committed since this one was begun."""


def part_of(layout: str, symbol="symbol"):
    """Part of a symbol. The prefix keeps it text when a folder name is read back."""
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    parts = {"symbol": F.concat(F.lit("symbol_"), symbol),
             "bucket": F.concat(F.lit("bucket_"), F.pmod(
                 F.xxhash64(symbol), F.lit(SYMBOL_PARTS)).cast("string"))}
    if layout not in parts:
        raise ValueError(f"layout must be 'symbol' or 'bucket', not {layout!r}")
    return parts[layout]


@dataclass(frozen=True)
class Version:
    """A committed state: what the manifest says of every table."""

    number: int
    tables: Mapping[str, dict]


def versions(spark: SparkSession, root: str) -> list[int]:
    names = file_names(spark, f"{root.rstrip('/')}/{COMMITS}")
    return [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]


def version_of(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or that of a number; None without any."""
    if number is None:
        number = max(versions(spark, root), default=0)
    if not number:
        return None
    manifest = read_text(spark, f"{root.rstrip('/')}/{COMMITS}/{number:010d}.json")
    return Version(number, json.loads(manifest))


def _schema_of(name: str, entry: Mapping) -> StructType:
    return schemas.TABLES.get(name) or StructType.fromJson(entry["schema"])


def _catalog_name(path: str) -> str:
    return f"newstide_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _clustered(spark: SparkSession, path: str, schema: StructType, entry: Mapping) -> DataFrame:
    """A clustered table, made known to this session's catalog."""
    name = _catalog_name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    order = ", ".join(entry["order"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (symbol) "
              f"SORTED BY ({order}) INTO {entry['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON."""
    return F.sha2(F.to_json(F.struct(*df.columns)), 256)


def read_version(spark: SparkSession, root: str, version: Version, name: str,
                 symbol: str | None = None, parts: Iterable[str] | None = None,
                 digest: bool = False) -> DataFrame | None:
    """A table of a version, one symbol of it from its part, or some of its parts; None if the
    version has none. ``digest`` adds the stored digest of rows."""
    entry = version.tables.get(name)
    if entry is None:
        return None
    root, schema = root.rstrip("/"), _schema_of(name, entry)
    if entry["kind"] == "clustered":
        df = _clustered(spark, f"{root}/{entry['path']}", schema, entry)
    elif entry["kind"] == "plain":
        df = spark.read.schema(schema).parquet(f"{root}/{entry['path']}")
    else:
        schema = StructType([*schema, StructField(DIGEST, StringType())]) if digest else schema
        wanted, parts = parts, entry["parts"]
        if wanted is not None:
            parts = {part: parts[part] for part in wanted if part in parts}
        if symbol is not None:
            wanted = spark.range(1).select(part_of(entry["layout"], F.lit(symbol))).first()[0]
            parts = {wanted: parts[wanted]} if wanted in parts else {}
        paths = [f"{root}/{path}" for path in parts.values()]
        df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return df if symbol is None else df.where(F.col("symbol") == symbol)


@dataclass
class Draft:
    """A version that is being written. Tables that are not written stay as the base has them."""

    spark: SparkSession
    root: str
    base: Version | None
    folder: str
    tables: dict[str, dict] = field(default_factory=dict)

    def _note(self, name: str, df: DataFrame, kind: str, **more) -> None:
        schema = {} if name in schemas.TABLES else {"schema": json.loads(df.schema.json())}
        self.tables[name] = {"kind": kind, **schema, **more}

    def read(self, name: str, **some) -> DataFrame | None:
        """A table as this version will have it."""
        return read_version(self.spark, self.root, Version(0, self.tables), name, **some)

    def drop(self, *names: str) -> None:
        """Leave out tables of the base."""
        for name in names:
            self.tables.pop(name, None)

    def _write_parts(self, df: DataFrame, name: str, layout: str) -> dict[str, str]:
        """Write the rows of ``df`` by part; rebalancing splits the files of a hot part."""
        path = f"{self.folder}/{name}"
        order = [PART, "symbol", *(c for c in ("date", "bucket_start") if c in df.columns)]
        if name in DIGESTED and DIGEST not in df.columns:
            df = df.withColumn(DIGEST, row_digest(df))
        (df.withColumn(PART, part_of(layout)).hint("rebalance", PART).sortWithinPartitions(*order)
         .write.partitionBy(PART).parquet(f"{self.root}/{path}"))
        prefix = f"{PART}="
        return {one.removeprefix(prefix): f"{path}/{one}" for one in
                file_names(self.spark, f"{self.root}/{path}") if one.startswith(prefix)}

    def write(self, name: str, df: DataFrame, layout: str = "symbol", **properties) -> None:
        """Write table ``name`` in parts. ``layout='symbol'`` replaces the symbols in ``df`` and
        keeps the others of the base, which has to be of the same layout; ``'bucket'`` replaces
        the table. A table without symbols is plain, and replaced."""
        if "symbol" not in df.columns:
            path = f"{self.folder}/{name}"
            df.write.parquet(f"{self.root}/{path}")
            self._note(name, df, "plain", path=path, **properties)
            return
        before = self.tables.get(name, {})
        kept = before.get("parts", {}) if layout == "symbol" else {}
        if kept and before["layout"] != layout:
            raise ValueError(f"{name} is stored by {before['layout']}; write it with that layout")
        if kept:  # what holds of the table has to hold of the parts that stay, too
            properties = {k: v and before.get(k, False) for k, v in properties.items()}
        self._note(name, df, "parts", layout=layout, **properties,
                   parts={**kept, **self._write_parts(df, name, layout)})

    def replace_parts(self, name: str, df: DataFrame) -> None:
        """Put the rows of ``df`` in place of the parts they belong to; other parts keep their files."""
        entry = self.tables[name]
        new = self._write_parts(df, name, entry["layout"])
        self.tables[name] = entry | {"parts": entry["parts"] | new}

    def written_parts(self, name: str) -> list[str]:
        """Parts of a table that this version has written itself."""
        return [part for part, path in self.tables[name]["parts"].items()
                if path.startswith(f"{self.folder}/")]

    def write_clustered(self, name: str, df: DataFrame, order=("symbol", "date"),
                        buckets: int = BUCKETS, others: bool = False) -> None:
        """Write a slim table hashed by symbol into ``buckets`` sorted files. A symbol has a row per
        day at most, so the file of a hot symbol is no larger than others. ``others`` keeps the
        symbols of the base that ``df`` has not."""
        stored = self.read(name) if others else None
        if stored is not None:
            new = df.select("symbol").distinct()
            df = stored.join(new, "symbol", "left_anti").select(*df.columns).unionByName(df)
        path = f"{self.folder}/{name}"
        where = f"{self.root}/{path}"
        (df.repartition(buckets, "symbol").write.format("parquet").bucketBy(buckets, "symbol")
         .sortBy(*order).option("path", where).saveAsTable(_catalog_name(where)))
        self._note(name, df, "clustered", path=path, buckets=buckets, order=list(order))


@contextmanager
def new_version(spark: SparkSession, root: str) -> Iterator[Draft]:
    """Write tables of a new version; it is committed when the block ends without an exception and
    any table was changed.

    Of two that were begun on the same base the first commits; the other raises ``CommitConflict``
    and leaves everything as it was.
    """
    root = root.rstrip("/")
    base = version_of(spark, root)
    number = base.number + 1 if base else 1
    draft = Draft(spark, root, base, f"{DATA}/{number:010d}-{uuid.uuid4().hex[:12]}",
                  dict(base.tables) if base else {})
    yield draft
    if base is not None and draft.tables == base.tables:
        return
    if not create_once(spark, f"{root}/{COMMITS}/{number:010d}.json",
                       json.dumps(draft.tables, indent=1, sort_keys=True)):
        raise CommitConflict(f"version {number} of {root} is there already; begin again")


def _folders(version: Version) -> set[str]:
    """Data folders that a version has files in."""
    paths = [path for entry in version.tables.values()
             for path in [entry.get("path"), *entry.get("parts", {}).values()] if path]
    return {path.split("/")[1] for path in paths}


def remove_old_versions(spark: SparkSession, root: str, keep: int = 1) -> list[int]:
    """Remove all but the newest ``keep`` versions, and every data folder that none of these uses.

    Data of a save that is still running are such folders too: run this while nothing is saved.
    Returns the numbers of the versions that went.
    """
    if keep < 1:
        raise ValueError("at least one version has to stay")
    root, numbers = root.rstrip("/"), versions(spark, root)
    old = numbers[:-keep]
    used = set().union(*[_folders(version_of(spark, root, n)) for n in numbers[-keep:]])
    for number in old:  # manifests first: what they name is gone for every later reader
        remove_table(spark, f"{root}/{COMMITS}/{number:010d}.json")
    for name in file_names(spark, f"{root}/{DATA}"):
        if name not in used:
            remove_table(spark, f"{root}/{DATA}/{name}")
    return old
