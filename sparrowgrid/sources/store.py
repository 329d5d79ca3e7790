"""Readers, caches and the small records around a panel: what a vendor would deliver, on Parquet."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import panel as P


class Source(Protocol):
    """Prices (asset, dt, price) and series (series, dt, x) between two dates."""

    name: str

    def available(self) -> bool: ...

    def prices(self, assets: list[str], start: str, end: str, field: str = "price") -> DataFrame: ...

    def macro(self, series: list[str], start: str, end: str) -> DataFrame: ...


class ParquetSource:
    """A source on two Parquet tables: quotes (asset, dt, one column a field) and series (series, dt, x).

    A name the table lacks has no rows. ``lags`` are publication lags in weekdays, applied before
    values are carried over the weekdays; a series without values stays empty.
    """

    def __init__(self, spark: SparkSession, quotes: str | None = None, series: str | None = None, name: str = "parquet", lags: dict[str, int] | None = None):
        self.spark, self.quotes, self.series, self.name, self.lags = spark, quotes, series, name, lags or {}

    def available(self) -> bool:
        return any(p and exists(self.spark, p) for p in (self.quotes, self.series))

    def prices(self, assets: list[str], start: str, end: str, field: str = "price") -> DataFrame:
        rows = self.spark.read.parquet(self.quotes).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("asset").isin(assets))
        return P.filled(P.null_nan(rows.select("asset", "dt", F.col(field).alias("price")), "price"), "price").where("price is not null")

    def macro(self, series: list[str], start: str, end: str) -> DataFrame:
        rows = P.null_nan(self.spark.read.parquet(self.series).where(F.col("series").isin(series)), "x")
        lags = F.create_map(*[F.lit(v) for s in series for v in (s, self.lags.get(s, 0))])
        out = P.published(rows, lags[F.col("series")])
        return out.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


#: Characters of an encoded key that a folder name holds; longer ones end in the hash of the key.
_NAME = 120


def path_name(key: str) -> str:
    """A folder name of its own for each key: other than letters, digits, dash and underscore, bytes are
    written in hex. A long name keeps its start and has the whole hash, after a mark no short one has."""
    name = "".join(chr(b) if chr(b).isascii() and (chr(b).isalnum() or b in b"-_") else f"%{b:02x}" for b in key.encode())
    return name if len(name) <= _NAME else f"{name[:40]}~{hashlib.sha256(key.encode()).hexdigest()}"


class Store:
    """Tables by key below one folder; each key has a folder with versions and a manifest.

    A save writes a version under a name of its own and then puts a manifest that names it in the
    old one's place by one atomic rename, so a reader finds the old table or the new one, and a crash
    before the rename leaves the old. The version before stays, for those who still read it, until
    the next save. Of two saves at once the later rename counts.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{path_name(key)}"

    def _manifest(self, folder: str) -> dict | None:
        p, fs = _fs(self.spark, f"{folder}/manifest.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, folder: str, manifest: dict) -> None:
        target, fs = _fs(self.spark, f"{folder}/manifest.json")
        source, _ = _fs(self.spark, f"{folder}/.{manifest['now']}.json")
        out = fs.create(source, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        conf = self.spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(source), fs.makeQualified(target), how)

    def save(self, key: str, rows: DataFrame) -> None:
        folder, new = self.path(key), f"v-{uuid.uuid4().hex}"
        rows.write.option("compression", "snappy").parquet(f"{folder}/{new}")
        old = self._manifest(folder) or {}
        self._publish(folder, {"key": key, "now": new, "before": old.get("now")})
        if old.get("before"):
            p, fs = _fs(self.spark, f"{folder}/{old['before']}")
            fs.delete(p, True)

    def exists(self, key: str) -> bool:
        return exists(self.spark, f"{self.path(key)}/manifest.json")

    def load(self, key: str) -> DataFrame | None:
        manifest = self._manifest(self.path(key))
        return self.spark.read.parquet(f"{self.path(key)}/{manifest['now']}") if manifest else None

    def list(self) -> list[str]:
        """The keys, in order."""
        p, fs = _fs(self.spark, self.root)
        found = [self._manifest(s.getPath().toString()) for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(m["key"] for m in found if m)

    def delete(self, key: str) -> bool:
        p, fs = _fs(self.spark, self.path(key))
        return fs.delete(p, True)

    def through(self, key: str, fetch: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, fetched and stored first if there is none."""
        if not self.exists(key):
            self.save(key, fetch())
        return self.load(key)

    def newest(self, prefix: str) -> str | None:
        """The last key by name among those that start so."""
        return max((k for k in self.list() if k.startswith(prefix)), default=None)


class Loader:
    """Prices and series through the store, from the first source that is available."""

    def __init__(self, store: Store, sources: list[Source], macro: Source | None = None):
        self.store, self.sources, self.macro_source = store, sources, macro

    def source(self) -> Source:
        for s in self.sources:
            if s.available():
                return s
        raise LookupError("no source is available")

    def get_prices(self, assets: list[str], start: str, end: str, field: str = "price") -> DataFrame:
        s = self.source()
        return self.store.through(f"{s.name}-{field}-{start}-{end}-{'-'.join(sorted(assets))}", lambda: s.prices(assets, start, end, field))

    def get_macro(self, series: list[str], start: str, end: str) -> DataFrame:
        s = self.macro_source or self.source()
        return self.store.through(f"macro-{s.name}-{start}-{end}-{'-'.join(sorted(series))}", lambda: s.macro(series, start, end))

    def get_returns(self, assets: list[str], start: str, end: str, kind: str = "log") -> DataFrame:
        return P.returns_of(self.get_prices(assets, start, end), kind)


def resolve_column(columns: list[str], *candidates: str) -> str:
    """The first candidate that is a column, whatever its case."""
    low = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c.lower() in low:
            return low[c.lower()]
    raise KeyError(f"none of {', '.join(candidates)}")


def read_changes(raw: DataFrame) -> DataFrame:
    """(dt, asset, change) from a vendor's change log; a null or unknown change fails the job."""
    from ..operators.universe import validate

    names = {"dt": ("date", "dt"), "asset": ("ric", "instrument", "asset"), "change": ("change", "action")}
    found = {new: resolve_column(raw.columns, *old) for new, old in names.items()}
    out = raw.select(F.col(found["dt"]).cast("date").alias("dt"), F.col(found["asset"]).alias("asset"), F.lower(F.trim(found["change"])).alias("change"))
    return validate(out.replace({"joiner": "join", "leaver": "leave"}, subset=["change"]))


def fetch_missing(have: DataFrame | None, assets: DataFrame, fetch: Callable[[list[str]], DataFrame], block: int = 50) -> DataFrame:
    """``have`` with the rows of the assets it lacks, fetched in blocks; running on from what is there.

    ``assets``: (asset). An asset that the vendor does not know brings no rows.
    """
    todo = assets.select("asset").distinct()
    if have is not None:
        todo = todo.join(have.select("asset").distinct(), "asset", "left_anti")
    names = [r.asset for r in todo.orderBy("asset").collect()]  # names of a universe
    out = have
    for at in range(0, len(names), block):
        part = fetch(names[at : at + block])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else fetch([])


@dataclass(frozen=True)
class Experiment:
    """What identifies a run; its hash goes into the trial log."""

    name: str
    assets: tuple[str, ...] = ()
    start: str = ""
    end: str = ""
    params: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Experiment:
        raw = json.loads(text)
        return cls(**{f.name: tuple(raw[f.name]) if f.name == "assets" else raw[f.name] for f in fields(cls) if f.name in raw})

    def override(self, **changes) -> Experiment:
        """A copy with some settings replaced; one that does not exist is an error."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
        return type(self)(**{**asdict(self), "assets": self.assets, **changes})

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(config_hash, experiment, params, metrics) of a trial log."""
    return spark.read.schema("config_hash string, experiment string, params string, metrics string").json(path)
