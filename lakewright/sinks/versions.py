"""Datasets whose runs count only once they are in a log.

Every run writes to a folder of its own, ``<path>/run=<id>/<partition folders>``, and then adds one record to
``<path>/_commits``, under the next number and never over another. A record names all folders that are live after it, the last
batch and key mark of every writer, and the facts of its run. Readers take the latest record, so a run that dies between its
write and its record leaves the old state readable, a batch that is delivered twice adds nothing, and folders are replaced
without a file being read and overwritten at once.

Records are written aside and renamed to their number, which fails where that exists: the file system must be one whose rename
does not overwrite (HDFS and local ones). A writer that loses looks at the new state and tries again; if the other has
replaced what it had read it fails. The driver handles one entry per live folder and none per file, but for those that a
compaction has left in place.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from py4j.protocol import Py4JJavaError

from lakewright.functions.cleaning import partition_text
from lakewright.functions.columns import col
from lakewright.operators.numbering import with_row_number
from lakewright.session import drop_folder, folders_like
from lakewright.sinks.lake import TARGET_FILE_BYTES, parquet_options, write_partitioned

LOG = "_commits"
ATTEMPTS = 20
# Beyond this many files their list is joined by a shuffle instead of being sent to every task.
LISTED_FILES = 50_000


class ConflictError(RuntimeError):
    """Another run has replaced what this one was based on."""


@dataclass(frozen=True)
class Folder:
    """The files of one partition folder of one run; ``only`` names those that still count, if not all do.

    ``of`` is the number of folders the run wrote.
    """

    run: str
    key: str
    rows: int
    files: int
    bytes: int
    of: int
    only: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Version:
    """One record of the log: what its run did, and the state after it."""

    number: int
    kind: str
    run: str | None
    schema: str
    partition_columns: tuple[str, ...]
    folders: tuple[Folder, ...]
    written: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    marks: dict[str, dict] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
    at: float = 0.0

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "folders": [f.__dict__ for f in self.folders], "complete": True})

    @staticmethod
    def from_json(text: str) -> Version:
        values = json.loads(text)
        values.pop("complete")
        folders = tuple(Folder(**{**f, "only": tuple(f["only"]) if f["only"] is not None else None}) for f in values.pop("folders"))
        return Version(folders=folders, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


class VersionedDataset:
    """A dataset under ``path``. ``date`` is the instant that names the date folders, as in ``write_partitioned``."""

    def __init__(self, spark: SparkSession, path: str, date: Column | None = None, partition_columns: Sequence[str] = ()):
        self.spark, self.path, self.date = spark, path.rstrip("/"), date
        self.partition_columns = (*(("date",) if date is not None else ()), *partition_columns)

    # --- the log

    def _numbers(self) -> list[tuple[int, str]]:
        return [(int(p.rsplit("/", 1)[1].split(".")[0]), p) for p in folders_like(self.spark, f"{self.path}/{LOG}/*.json")]

    def _load(self, file: str) -> Version:
        return Version.from_json(self.spark.read.option("wholetext", True).text(file).first()[0])

    def latest(self) -> Version | None:
        numbers = self._numbers()
        return self._load(numbers[-1][1]) if numbers else None

    def version(self, number: int | None = None) -> Version | None:
        if number is None:
            return self.latest()
        for found, file in self._numbers():
            if found == number:
                return self._load(file)
        raise ValueError(f"{self.path} has no version {number}")

    def log(self) -> DataFrame:
        """One row per version, oldest first: number, kind, run, its folders and facts, and the totals of the state."""
        schema = (
            "number int, kind string, run string, written array<string>, batches map<string,bigint>, marks map<string,struct<text:string,type:string>>,"
            " facts map<string,string>, folders array<struct<run:string,key:string,rows:bigint,files:bigint,bytes:bigint>>"
        )
        if not self._numbers():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/{LOG}/*.json").orderBy("number")

    def manifest(self, number: int | None = None) -> DataFrame:
        """Rows, files and bytes of the folders a version's run has written; of the latest version by default."""
        log = self.log()
        last = self.version(number)
        chosen = log.filter(F.col("number") == (last.number if last else 0)).select("run", F.inline("folders").alias("by", "key", "rows", "files", "bytes"))
        mine = chosen.filter(F.col("by") == F.col("run")).groupBy("key")
        return mine.agg(F.sum("rows").alias("rows_processed"), F.sum("files").alias("files_written"), F.sum("bytes").alias("bytes_written"))

    def _create(self, version: Version) -> bool:
        """Add a record under its number; False if that number is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        hadoop, conf = jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = hadoop.Path(f"{self.path}/{LOG}/{version.number:020d}.json")
        aside = hadoop.Path(f"{self.path}/{LOG}/.{uuid.uuid4().hex}")
        files = target.getFileSystem(conf)
        out = files.create(aside, False)
        out.write(bytearray(version.to_json().encode()))
        out.close()
        try:
            context = hadoop.FileContext.getFileContext(target.toUri(), conf)
            context.rename(aside, target, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
        except (Py4JJavaError, CapturedException) as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            files.delete(aside, False)
            return False
        return True

    def _commit(self, build: Callable[[Version | None], Version | None]) -> Version | None:
        """Add the record that ``build`` makes of the latest one, unless it makes none."""
        for _ in range(ATTEMPTS):
            base = self.latest()
            made = build(base)
            if made is None:
                return base
            if self._create(made):
                return made
        raise ConflictError(f"{self.path}: {ATTEMPTS} other runs came first")

    # --- reading

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the latest version, or of another."""
        version = self.version(number)
        if version is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.rows_of(version, version.folders).drop("run")

    def rows_of(self, version: Version, folders: Sequence[Folder]) -> DataFrame:
        """The rows of some folders, with ``run`` beside them."""
        schema = T.StructType.fromJson(json.loads(version.schema))
        if not folders:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
        live: dict[str, list[Folder]] = {}
        for f in folders:
            live.setdefault(f.run, []).append(f)
        paths = []
        for run, mine in live.items():
            root = f"{self.path}/run={run}"
            if len(mine) == mine[0].of and not any(f.only is not None for f in mine):
                paths.append(root)
                continue
            for f in mine:
                place = f"{root}/{f.key}" if f.key else root
                paths += [place] if f.only is None else [f"{place}/{name}" for name in f.only]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)

    # --- writing

    def _prepared(self, df: DataFrame) -> DataFrame:
        return df.withColumn("date", partition_text(self.date)) if self.date is not None else df

    def _write(self, df: DataFrame, **kwargs) -> tuple[str, list[Folder]]:
        """Rows, ``date`` included, to the folder of a new run; what is in it."""
        run = uuid.uuid4().hex
        root = f"{self.path}/run={run}"
        write_partitioned(df, root, partition_columns=self.partition_columns, **kwargs)
        return run, self._listed(run)

    def _listed(self, run: str) -> list[Folder]:
        root = f"{self.path}/run={run}"
        if not folders_like(self.spark, f"{root}/*=*" if self.partition_columns else f"{root}/*.parquet"):
            return []
        files = _files(self.spark.read.option("basePath", self.path).parquet(root)).groupBy("key")
        counted = files.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).collect()
        return [Folder(run, r.key, r.rows, r.files, r.bytes, len(counted)) for r in sorted(counted, key=lambda r: r.key)]

    def _next(self, base: Version | None, df: DataFrame, kind: str, run: str, added: Sequence[Folder], removed: Sequence[Folder] = (), kept: Sequence[Folder] = (), **changes) -> Version:
        schema = df.schema
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        if base is not None:
            known = T.StructType.fromJson(json.loads(base.schema))
            if base.partition_columns != self.partition_columns or {f.name: f.dataType for f in known} != {f.name: f.dataType for f in schema}:
                raise ValueError(f"{self.path} has other columns or partition columns")
            schema = known
        here = base.folders if base else ()
        if any(f not in here for f in removed):
            raise ConflictError(f"{self.path}: another run has replaced folders of this one")
        folders = (*(f for f in here if f not in removed), *kept, *added)
        values = {"batches": dict(base.batches) if base else {}, "marks": dict(base.marks) if base else {}, "facts": {}}
        for name, change in changes.items():
            values[name].update(change)
        number = base.number + 1 if base else 1
        return Version(number, kind, run, schema.json(), self.partition_columns, folders, tuple(f.key for f in added), at=time.time(), **values)

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None, facts: dict[str, object] | None = None, **kwargs) -> Version | None:
        """Add the rows. With a ``writer`` and its ``batch`` number, only if the log has no such or later batch of it."""

        def done(base: Version | None) -> bool:
            return batch is not None and base is not None and base.batches.get(writer, -1) >= batch

        base = self.latest()
        if done(base):
            return base
        df = self._prepared(df)
        run, added = self._write(df, **kwargs)
        batches = {} if batch is None else {writer: batch}
        return self._commit(lambda now: None if done(now) else self._next(now, df, "append", run, added, batches=batches, facts=facts or {}))

    def append_new(self, df: DataFrame, key: str, writer: str = "append_new", null_keys: str = "raise", **kwargs) -> tuple[Version | None, int]:
        """Add the rows whose key is above the writer's mark in the log, up to the highest there is now.

        A row without a key can have no place above or below a mark: such rows are an error, or left out and counted with
        ``null_keys="count"``. Returns the version and that count. The mark is committed together with the rows.
        """
        if null_keys not in ("raise", "count"):
            raise ValueError("null_keys is 'raise' or 'count'")
        base = self.latest()
        mark = base.marks.get(writer) if base else None
        kind = df.schema[key].dataType.simpleString()
        low = F.lit(mark["text"]).cast(mark["type"]) if mark else None
        above = col(key).isNotNull() if low is None else col(key) > low
        seen = df.agg(F.max(F.when(above, col(key))).cast("string").alias("top"), F.count_if(col(key).isNull()).alias("nulls")).first()
        if seen.nulls and null_keys == "raise":
            raise ValueError(f"{seen.nulls} rows have no {key}")
        if seen.top is None:
            return base, seen.nulls
        top = F.lit(seen.top).cast(kind)
        new = self._prepared(df.filter(above & (col(key) <= top)))
        run, added = self._write(new, **kwargs)

        def build(now: Version | None) -> Version:
            if (now.marks.get(writer) if now else None) != mark:
                raise ConflictError(f"{self.path}: another run of {writer} has moved its mark")
            return self._next(now, new, "append", run, added, marks={writer: {"text": seen.top, "type": kind}})

        return self._commit(build), seen.nulls

    def replace_range(self, df: DataFrame, column: str, start: object, stop: object, facts: dict[str, object] | None = None, **kwargs) -> Version | None:
        """Make the rows with ``start <= column < stop`` those of ``df``, which must have no others.

        Only folders with rows of the range are rewritten, together with their other rows, so a folder the range
        covers in part stays whole; of folders it empties nothing is left.
        """
        base = self.latest()
        inside = F.coalesce((col(column) >= F.lit(start)) & (col(column) < F.lit(stop)), F.lit(False))
        new = self._prepared(df.filter(F.when(inside, True).otherwise(F.raise_error(f"a row lies outside the replaced range of {column}").cast("boolean"))))
        touched: list[Folder] = []
        if base is not None:
            hit = self.rows_of(base, base.folders).filter(inside) if base.folders else None
            named = {tuple(r) for r in hit.select(F.col("_metadata.file_path").alias("path")).distinct().select(*place_of_rows("path")).collect()} if hit is not None else set()
            touched = [f for f in base.folders if (f.run, f.key) in named]
            if touched:
                kept = self.rows_of(base, touched).drop("run").filter(~inside)
                new = new.unionByName(kept)
        run, added = self._write(new, **kwargs)
        if base is None and not added:
            return None
        return self._commit(lambda now: self._next(now, new, "replace", run, added, removed=touched, facts=facts or {}))

    def compact(self, target_file_bytes: int = TARGET_FILE_BYTES, small_share: float = 0.75, sort_by: Sequence[str] = (), options: dict[str, str] | None = None) -> Version | None:
        """Pack the small files of every folder into files of about the target size; large files stay where they are.

        Files are grouped by their sizes alone, group by group in a folder, and a task writes one group: rows of small files are
        written once and those of others not read. Nothing happens to folders with less than two small files.
        """
        base = self.latest()
        if base is None or not base.folders:
            return base
        rows = self.rows_of(base, base.folders)
        small = _files(rows).filter(F.col("size") < small_share * target_file_bytes)
        before = "sum(size) OVER (PARTITION BY key ORDER BY size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        packed = small.withColumns(
            {"group": F.floor(F.coalesce(F.expr(before), F.lit(0)) / F.lit(target_file_bytes)), "n": F.expr("count(*) OVER (PARTITION BY key)")}
        ).filter("n > 1")
        groups = packed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.collect_list("path").alias("paths")).filter("n > 1")
        numbered = with_row_number(groups.select("key", "group", "paths"), ["key", "group"], "task")
        chosen = numbered.select((F.col("task") - 1).cast("int").alias("__task"), F.explode("paths").alias("__path"))
        counts = chosen.agg(F.count(F.lit(1)).alias("files"), F.max("__task").alias("last")).first()
        if not counts.files:
            return base
        listed = F.broadcast(chosen) if counts.files <= LISTED_FILES else chosen
        moved = rows.withColumn("__path", F.col("_metadata.file_path")).drop("run").join(listed, "__path")
        spread = moved.repartitionById(counts.last + 1, F.col("__task")).drop("__task", "__path")
        spread = spread.sortWithinPartitions(*[col(c) for c in [*self.partition_columns, *sort_by]]) if sort_by or self.partition_columns else spread
        run = uuid.uuid4().hex
        writer = spread.write.options(**(options or parquet_options()))
        (writer.partitionBy(*self.partition_columns) if self.partition_columns else writer).parquet(f"{self.path}/run={run}")
        # What is left of the folders: their files that were not moved.
        gone = {r["__path"] for r in chosen.select("__path").collect()}
        left: dict[tuple[str, str], list] = {}
        touched: dict[tuple[str, str], None] = {}
        for r in _files(rows).collect():
            touched.update({(r.run, r.key): None} if r.path in gone else {})
            left.setdefault((r.run, r.key), []).append(r)
        removed, kept = [], []
        for f in base.folders:
            if (f.run, f.key) in touched:
                removed.append(f)
                stays = [r for r in left[f.run, f.key] if r.path not in gone]
                if stays:
                    only = tuple(sorted(r.name for r in stays))
                    kept.append(Folder(f.run, f.key, sum(r.rows for r in stays), len(stays), sum(r.size for r in stays), f.of, only))
        added = self._listed(run)
        same = self.rows_of(base, ()).drop("run")
        return self._commit(lambda now: self._next(now, same, "compact", run, added, removed=removed, kept=kept))

    def drop_unreferenced(self, keep_versions: int = 1, older_than_hours: float = 24.0) -> list[str]:
        """Delete run folders that none of the last versions names and that no run of the last hours can still be writing.

        Older versions can't be read any more; their records stay. Returns the deleted folders.
        """
        numbers = self._numbers()[-keep_versions:]
        live = {f.run for _, file in numbers for f in self._load(file).folders}
        dropped = []
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders_like(self.spark, f"{self.path}/run=*"):
            if folder.rsplit("run=", 1)[1] in live:
                continue
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            age = time.time() - place.getFileSystem(conf).getFileStatus(place).getModificationTime() / 1000
            if age >= older_than_hours * 3600:
                drop_folder(self.spark, folder)
                dropped.append(folder)
        return dropped


def place_of_rows(file_path: str = "_metadata.file_path") -> tuple[Column, Column]:
    """Run and partition folder of a file, from its path, which Spark gives in its URI form.

    Taking a path apart costs far more than reading a row: ask for it once a file, not once a row.
    """
    path = F.url_decode(F.replace(F.col(file_path), F.lit("+"), F.lit("%2B")))
    inside = F.regexp_extract(path, r"/run=([0-9a-f]{32})/(.*)$", 2)
    run = F.regexp_extract(path, r"/run=([0-9a-f]{32})/(.*)$", 1)
    return run.alias("run"), F.regexp_replace(inside, r"/?[^/]*$", "").alias("key")


def _files(rows: DataFrame) -> DataFrame:
    """``run, key, path, name, size, rows`` of the files the rows come from; no column is read for it."""
    counted = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(*place_of_rows("path"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size", "rows")
