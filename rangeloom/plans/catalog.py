"""A catalog of tracks, interval sets and attributes over Parquet folders.

A database is a folder that Spark reads and writes: ``chroms``, ``tracks/<name>``,
``intervals/<name>`` and ``seq`` hold Parquet, ``meta`` a row of JSON for each
entry.  Dots in names are folders.  Only names and attributes pass through the
driver; they are a list that users make, and don't grow with the data.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.sequence import Motif
from rangeloom.operators.tracks import Track, Workspace, create_dense, create_sparse, merge_arrays
from rangeloom.sources import formats

META_SCHEMA = "kind string, name string, meta string"


@dataclass
class Database:
    """One database; ``attach`` others to read from, the latest attached behind this one and before earlier ones."""

    spark: SparkSession
    path: str
    namespace: str = ""
    others: list[Database] = field(default_factory=list)
    readonly: set[str] = field(default_factory=lambda: {"created.by", "created.date"})
    _meta: dict[tuple[str, str], dict] | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, chroms: DataFrame, sequence: DataFrame | None = None) -> Database:
        """A new database with its chromosomes (``chrom_id, chrom, size``) and, maybe, sequence chunks."""
        chroms.write.parquet(f"{path}/chroms")
        if sequence is not None:
            sequence.write.partitionBy("chrom").parquet(f"{path}/seq")
        db = cls(spark, path)
        db._meta = {("db", ""): {"sequence": sequence is not None}}
        db._save()
        return db

    @classmethod
    def create_linked(cls, spark: SparkSession, path: str, parent: Database) -> Database:
        """A database whose sequence is the parent's."""
        db = cls.create(spark, path, parent.chroms())
        db.meta()["db", ""]["parent"] = parent.path
        db._save()
        return db

    # what it holds

    def chroms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chroms")

    def sequence(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.meta()['db', ''].get('parent', self.path)}/seq")

    def meta(self) -> dict[tuple[str, str], dict]:
        if self._meta is None:
            self.reload()
        return self._meta

    def reload(self) -> None:
        self.spark.catalog.refreshByPath(self.path)
        rows = self.spark.read.schema(META_SCHEMA).parquet(f"{self.path}/meta").collect()
        self._meta = {(r.kind, r.name): json.loads(r.meta) for r in rows}

    def _save(self) -> None:
        rows = [(kind, name, json.dumps(x)) for (kind, name), x in self._meta.items()]
        self.spark.createDataFrame(rows, META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")

    def info(self) -> dict:
        row = self.chroms().agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        return {"path": self.path, "chroms": row.n, "size": row["size"], "tracks": len(self.ls("track")), "intervals": len(self.ls("intervals"))}

    # names

    def _full(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z]\w*(\.[A-Za-z]\w*)*", name):
            raise ValueError(f"bad name {name!r}")
        return f"{self.namespace}.{name}" if self.namespace else name

    def cd(self, namespace: str = "") -> None:
        """Change the namespace that names are under; ``..`` goes up."""
        if namespace == "..":
            self.namespace = self.namespace.rpartition(".")[0]
        else:
            self.namespace = self._full(namespace) if namespace else ""

    def ls(self, kind: str = "track", pattern: str = "", ignore_case: bool = False, **attributes: str) -> list[str]:
        """Names by a regular expression, and by regular expressions of attributes."""
        flags = re.IGNORECASE if ignore_case else 0
        out = set()
        for db in self._sources():
            for (k, name), x in db.meta().items():
                held = x.get("attributes", {})
                if k == kind and re.search(pattern, name, flags) and all(re.search(v, held.get(a, ""), flags) for a, v in attributes.items()):
                    out.add(name)
        return sorted(out)

    def _sources(self) -> list[Database]:
        return [self, *reversed(self.others)]

    def attach(self, other: Database, force: bool = False) -> None:
        """Read from another database too; its chromosomes must be the same, and names mustn't clash unless forced."""
        mine, theirs = self.chroms(), other.chroms()
        if not mine.exceptAll(theirs).isEmpty() or not theirs.exceptAll(mine).isEmpty():
            raise ValueError("the databases' chromosomes differ")
        if clash := set(self.meta()) & set(other.meta()) - {("db", "")}:
            if not force:
                raise ValueError(f"names in both: {sorted(n for _, n in clash)}")
        self.others.append(other)

    def detach(self, path: str) -> None:
        self.others = [x for x in self.others if x.path != path]

    def where(self, kind: str, name: str) -> list[str]:
        """Paths of all sources of a name, the one that is read first."""
        return [db.path for db in self._sources() if (kind, name) in db.meta()]

    def exists(self, kind: str, name: str) -> bool:
        return bool(self.where(kind, name))

    def _source(self, kind: str, name: str) -> Database:
        for db in self._sources():
            if (kind, name) in db.meta():
                return db
        raise KeyError(f"no {kind} {name}")

    def _folder(self, kind: str, name: str) -> str:
        return f"{self.path}/{'tracks' if kind == 'track' else 'intervals'}/{name.replace('.', '/')}/data"

    # tracks and interval sets

    def save(self, kind: str, name: str, data: DataFrame, overwrite: bool = False, **meta) -> None:
        """Write a table under a name, partitioned by chromosome, or by pair, and sorted within."""
        full = self._full(name)
        if (kind, full) in self.meta() and not overwrite:
            raise ValueError(f"{kind} {full} exists")
        keys = ["chrom1", "chrom2"] if "chrom1" in data.columns else ["chrom"]
        order = next(c for c in ("bin", "start", "start1") if c in data.columns)
        # by range of place too, so that a long chromosome is written by several tasks
        laid = data.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
        laid.write.mode("overwrite").partitionBy(*keys).parquet(self._folder(kind, full))
        self._meta[kind, full] = {"columns": data.columns, "attributes": {}, "variables": {}} | meta
        self._save()

    def table(self, kind: str, name: str, chroms: list[str] | None = None) -> DataFrame:
        """A saved table; ``chroms`` prunes its partitions."""
        db = self._source(kind, name)
        df = self.spark.read.option("basePath", db._folder(kind, name)).parquet(db._folder(kind, name))
        df = df.select(db.meta()[kind, name]["columns"])
        return df.where(F.col("chrom" if "chrom" in df.columns else "chrom1").isin(chroms)) if chroms else df

    def save_dense(self, name: str, bins: DataFrame, bin_size: int, **options) -> None:
        self.save("track", name, bins, bin_size=bin_size, type="dense", **options)

    def save_sparse(self, name: str, records: DataFrame, **options) -> None:
        self.save("track", name, records, type="rectangles" if "chrom1" in records.columns else "sparse", **options)

    def track(self, name: str) -> Track:
        return Track(self.table("track", name), self._source("track", name).meta()["track", name].get("bin_size"))

    def track_info(self, name: str) -> dict:
        meta = self._source("track", name).meta()["track", name]
        return {"type": meta.get("type"), "bin_size": meta.get("bin_size"), "rows": self.table("track", name).count(), "attributes": meta["attributes"]}

    def update(self, name: str, rows: DataFrame, chrom: str) -> None:
        """Put the place of one chromosome of an interval set with ``rows``; other partitions aren't touched."""
        full = self._full(name)
        part = rows.where(F.col("chrom") == chrom).drop("chrom")
        part.write.mode("overwrite").parquet(f"{self._folder('intervals', full)}/chrom={chrom}")

    def copy(self, kind: str, name: str, to: str, overwrite: bool = False) -> None:
        meta = dict(self._source(kind, name).meta()[kind, name])
        columns = meta.pop("columns")
        self.save(kind, to, self.table(kind, name).select(columns), overwrite, **meta)

    def rm(self, kind: str, name: str, delete: bool = True) -> None:
        """Forget a name and, unless told not to, delete its files."""
        if (kind, name) not in self.meta():
            raise KeyError(f"no {kind} {name} in {self.path}")
        del self._meta[kind, name]
        self._save()
        if delete:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind, name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def unload(self) -> None:
        """Forget what was read of this database and of those attached."""
        self._meta, self.namespace = None, ""
        self.others.clear()

    def make_dir(self, namespace: str) -> None:
        """A namespace of its own, though nothing is in it yet."""
        self.meta()["dir", self._full(namespace)] = {}
        self._save()

    def dirs(self) -> list[str]:
        """Namespaces that were made, or that names are under."""
        names = {n if k == "dir" else n.rpartition(".")[0] for k, n in self.meta() if k != "db"}
        return sorted({".".join(n.split(".")[: i + 1]) for n in names if n for i in range(n.count(".") + 1)})

    def remove_dir(self, namespace: str, force: bool = False) -> None:
        """Take a namespace away; one that holds names only if forced, and then with them."""
        full = self._full(namespace)
        held = [(k, n) for k, n in self.meta() if k in ("track", "intervals") and n.startswith(f"{full}.")]
        if held and not force:
            raise ValueError(f"{full} holds {len(held)} names")
        for kind, name in held:
            self.rm(kind, name)
        for key in [(k, n) for k, n in self.meta() if k == "dir" and (n == full or n.startswith(f"{full}."))]:
            del self._meta[key]
        self._save()

    def save_dataset(self, path: str, tracks: list[str] = (), intervals: list[str] = ()) -> Database:
        """A new database of the same chromosomes with copies of chosen tracks and interval sets, to be attached elsewhere."""
        out = Database.create(self.spark, path, self.chroms())
        for kind, names in (("track", tracks), ("intervals", intervals)):
            for name in names:
                meta = dict(self._source(kind, name).meta()[kind, name])
                meta.pop("columns")
                out.save(kind, name, self.table(kind, name), **meta)
        return out

    def datasets(self) -> list[str]:
        """Paths of this database and those attached, in the order in which names are looked up."""
        return [db.path for db in self._sources()]

    # making tracks

    def create_track(self, name: str, expr: str, iterator=None, scope: DataFrame | None = None, workspace: Workspace | None = None, **options) -> None:
        """Save an expression's values: a dense track where the iterator is one of bins, else a sparse one without its missing values.

        A number, a dense track's name and an iterator implied by dense tracks are iterators of bins.
        """
        ws = workspace or self.workspace()
        width = ws.iterator_width(iterator, [expr])
        rows = ws.evaluate({"value": expr}, scope, iterator)
        if width:
            bins = rows.groupBy("chrom", F.floor(F.col("start") / width).alias("bin")).agg(F.first("value", ignorenulls=True).alias("value"))
            self.save_dense(name, bins.where("value IS NOT NULL"), width, **options)
        else:
            self.save_sparse(name, rows.where("value IS NOT NULL").select("chrom", "start", "end", "value").distinct(), **options)

    def create_pwm_energy(self, name: str, motif: Motif, width: int, scope: DataFrame | None = None, prior: float = 0.01, **options) -> None:
        """A dense track of a motif's log-sum-exp score over both strands of each bin."""
        ws = Workspace(self.chroms(), sequence=self.sequence())
        ws.vtrack("energy", None, "pwm", {"motif": motif, "prior": prior})
        self.create_track(name, "energy", width, scope, ws, **options)

    def import_track(self, name: str, path: str, kind: str = "bedgraph", bin_size: int = 0, default: float | None = None, **options) -> None:
        """Read bedGraph, WIG or BED scores; with ``bin_size`` as overlap-weighted means of bins, else as sparse records."""
        readers = {"bedgraph": formats.read_bedgraph, "wig": formats.read_wig, "bed": lambda s, p: formats.read_bed(s, p).withColumnRenamed("score", "value")}
        rows = readers[kind](self.spark, path).select("chrom", "start", "end", "value")
        if bin_size:
            self.save_dense(name, create_dense(rows, self.chroms(), bin_size, default=default), bin_size, **options)
        else:
            self.save_sparse(name, create_sparse(rows), **options)

    def import_set(self, paths: dict[str, str], kind: str = "bedgraph", bin_size: int = 0, **options) -> dict[str, str | None]:
        """Import many files, each under its name; tells for each what went wrong, or None."""
        out: dict[str, str | None] = {}
        for name, path in paths.items():
            try:
                self.import_track(name, path, kind, bin_size, **options)
                out[name] = None
            except Exception as error:  # the others are still imported
                out[name] = str(error).splitlines()[0]
        return out

    def save_array(self, name: str, records: DataFrame, columns: list[str], **options) -> None:
        """An array track: ``chrom, start, end, value`` (array<double>), whose elements have names."""
        self.save("track", name, records, type="array", array_columns=list(columns), **options)

    def import_array(self, name: str, *sources: str, **options) -> None:
        """An array track of array tracks, by name, and of files (tab-separated, with a header); see ``merge_arrays``."""
        parts = [(self.table("track", x), self.array_columns(x)) if self.exists("track", x) else formats.read_array(self.spark, x) for x in sources]
        self.save_array(name, *merge_arrays(parts), **options)

    def array_columns(self, name: str) -> list[str]:
        return list(self._source("track", name).meta()["track", name]["array_columns"])

    def set_array_columns(self, name: str, columns: list[str]) -> None:
        held = self.meta()["track", name]
        if len(columns) != len(held["array_columns"]) or len(set(columns)) != len(columns):
            raise ValueError("an array track needs as many distinct names as it has columns")
        held["array_columns"] = list(columns)
        self._save()

    def mv(self, kind: str, name: str, to: str) -> None:
        self.copy(kind, name, to)
        self.rm(kind, name)

    def workspace(self, *tracks: str) -> Workspace:
        """A workspace with the named tracks, or all one-dimensional ones."""
        ws = Workspace(self.chroms())
        for name in tracks or self.ls("track"):
            if self._source("track", name).meta()["track", name].get("type") not in ("rectangles", "array"):
                ws.tracks[name] = self.track(name)
        return ws

    # attributes and variables

    def attribute(self, kind: str, name: str, key: str) -> str | None:
        return self._source(kind, name).meta()[kind, name]["attributes"].get(key)

    def set_attribute(self, kind: str, name: str, key: str, value: str | None) -> None:
        """Set an attribute, or with None take it away."""
        if key in self.readonly:
            raise ValueError(f"attribute {key} is read-only")
        held = self.meta()[kind, name]["attributes"]
        held.pop(key, None)
        if value:
            held[key] = value
        self._save()

    def attributes(self, kind: str = "track") -> DataFrame:
        """Attributes of all entries as a wide table."""
        rows = [(n, a, v) for (k, n), x in self.meta().items() if k == kind for a, v in x.get("attributes", {}).items()]
        return self.spark.createDataFrame(rows, "name string, attribute string, value string").groupBy("name").pivot("attribute").agg(F.first("value"))

    def import_attributes(self, table: DataFrame, kind: str = "track", remove_others: bool = False) -> None:
        for row in table.collect():
            held = row.asDict()
            name = held.pop("name")
            mine = self.meta()[kind, name]
            mine["attributes"] = ({} if remove_others else mine["attributes"]) | {k: v for k, v in held.items() if v and k not in self.readonly}
        self._save()

    def variable(self, name: str, key: str):
        return self._source("track", name).meta()["track", name]["variables"][key]

    def set_variable(self, name: str, key: str, value) -> None:
        """Attach a value that JSON holds to a track; None takes it away."""
        held = self.meta()["track", name]["variables"]
        held.pop(key, None)
        if value is not None:
            held[key] = value
        self._save()

    def variables(self, name: str, pattern: str = "") -> list[str]:
        return sorted(x for x in self._source("track", name).meta()["track", name]["variables"] if re.search(pattern, x))
