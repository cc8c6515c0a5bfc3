"""Versioned tables on plain Parquet: append, overwrite, upsert, time travel, compaction and clustering.

A table is a folder of data segments and of numbered manifests, each of which lists the segments of
one version and those of their files that later merges have replaced. A commit writes new segments first and then creates the next manifest, which fails if
another writer has made it; readers see whole versions only, and a rewrite never touches files that
are being read. Every operation takes the version that it reads once, and commits the one after it: a commit made in between is never
overwritten. Appends then go after it, merges begin again from it, and rewrites (compaction, clustering) raise. A commit is as atomic as the store's create without
overwrite: on a store that lacks it, give each table one writer. All file access goes through Hadoop's FileSystem, so any store that Spark reads will do.

Merges read only files that may hold the source's keys: an index beside each segment has every file's key range and, where a source has few keys for each file, a Bloom filter of its
keys. Of those files a merge rewrites the ones that do hold such a key, and carries all others over by reference. A table that is no larger than one file should be is read without an index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

from millrace.operators.schema import fitted, widened

SEGMENT, FILE_BYTES = "millrace_segment", 128 << 20
# A Bloom filter has HASHES bits of BITS a key, in maps of MAP bits. Beyond TESTS pairs of key and file, ranges alone choose the files.
HASHES, BITS, MAP, TESTS = 3, 16, 1 << 15, 1_000_000_000
# Of so few files all are read: the index would cost as much.
FEW = 8
# With more than so many values of each key column for a file hardly any file is without one, so ranges alone choose the files.
SPREAD = 4
TRIES = 5


class ConcurrentCommit(RuntimeError):
    """Another writer has committed this version."""


class LakeTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def version(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version is None or version not in self.versions():
            raise ValueError(f"no version {version} of {self.path}")
        stream = self._fs.open(self._path(f"{self.path}/_manifests/{version:08d}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {"removed": {}} | json.loads(text) | {"version": version}

    def _commit(self, segments: list[str], partition_by: list[str], schema: StructType, after: int | None, removed: dict[str, list[str]] | None = None, **about: object) -> int:
        """Creates the version after the one given; ``removed`` has files of the segments that the version doesn't have."""
        version = 0 if after is None else after + 1
        target = self._path(f"{self.path}/_manifests/{version:08d}.json")
        body = json.dumps({"segments": segments, "removed": removed or {}, "partition_by": partition_by, "schema": json.loads(schema.json()), **about})
        try:
            out = self._fs.create(target, False)
        except Exception as error:  # the JVM's exception type varies with the store
            raise ConcurrentCommit(f"version {version} of {self.path} exists") from error
        out.write(bytearray(body.encode()))
        out.close()
        return version

    def _write(self, df: DataFrame, partition_by: list[str]) -> str:
        segment = f"data/{SEGMENT}=s{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{segment}")
        return segment

    def _again(self, attempt: Callable[[int | None], int]) -> int:
        """The attempt from the current version on, and anew from the next one if another writer was first."""
        for k in range(TRIES):
            try:
                return attempt(self.version())
            except ConcurrentCommit:
                if k == TRIES - 1:
                    raise
        raise AssertionError

    # Files

    def _files(self, manifest: dict) -> dict[str, int]:
        """Path and size of each file of a version."""
        out = {}
        for segment in manifest["segments"]:
            gone = set(manifest["removed"].get(segment, ()))
            found = self._fs.listFiles(self._path(f"{self.path}/{segment}"), True)
            while found.hasNext():
                status = found.next()
                path = status.getPath().toString()
                path = path[path.index(segment) :]
                if path.endswith(".parquet") and path not in gone:
                    out[path] = status.getLen()
        return out

    def _scan(self, manifest: dict, paths: list[str]) -> DataFrame:
        """Folders or files as one table; a segment's folder is named like a partition's, so that one scan reads any number of them."""
        schema = StructType.fromJson(manifest["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The current or an earlier version; partition filters prune folders."""
        return self._read(self._manifest(version))

    def _read(self, manifest: dict) -> DataFrame:
        whole = [s for s in manifest["segments"] if not manifest["removed"].get(s)]
        parts = list(self._files(manifest | {"segments": [s for s in manifest["segments"] if s not in whole]}))
        return self._scan(manifest, whole + parts).select(*StructType.fromJson(manifest["schema"]).names)

    def matching(self, source: DataFrame, key: str | list[str]) -> DataFrame:
        """Rows of the current version with a key of the source, read from the files that may hold one."""
        keys = [key] if isinstance(key, str) else list(key)
        manifest = self._manifest()
        rows = self._scan(manifest, self._near_files(manifest, keys, source)).select(*StructType.fromJson(manifest["schema"]).names)
        return rows.join(source.select(*keys).distinct(), keys, "left_semi")

    def size_bytes(self) -> int:
        """Bytes of the current version's files."""
        return sum(self._files(self._manifest()).values())

    def file_count(self) -> int:
        return len(self.read().inputFiles())

    def files_by_partition(self) -> DataFrame:
        """partition, files."""
        keys = self._manifest()["partition_by"]
        name = F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys]) if keys else F.lit("")
        return self.read().select(name.alias("partition"), F.input_file_name().alias("file")).distinct().groupBy("partition").agg(F.count("*").alias("files"))

    def rewritten(self, version: int | None = None) -> int:
        """Files that the merge of this version replaced."""
        return self._manifest(version).get("rewritten", 0)

    def made_anew(self) -> bool:
        """Whether an overwrite made the current version, and nothing was merged into it since."""
        manifest = self._manifest()
        return len(manifest["segments"]) == 1 and not manifest.get("rewritten") and not manifest["removed"]

    # The index

    def _made(self, manifest: dict, folder: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """An index of the version's files, made of the key columns for segments that have none yet."""
        at = {s: f"{self.path}/{folder}/{'_'.join(keys)}/{s.partition('=')[2]}" for s in manifest["segments"]}
        for segment in at:
            if not self._fs.exists(self._path(f"{at[segment]}/_SUCCESS")):
                make(self._scan(manifest, [segment]).select(F.struct(*keys).alias("key"), F.col("_metadata.file_path").alias("path"))).write.mode("overwrite").parquet(at[segment])
        found = self.spark.read.parquet(*at.values())
        gone = [f for files in manifest["removed"].values() for f in files]
        return found.join(self.spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti") if gone else found

    def _ranges(self, manifest: dict, keys: list[str]) -> DataFrame:
        """file, low, high: the range of each file's keys."""
        return self._made(manifest, "_ranges", keys, lambda rows: _spans(rows).select(_file(), "low", "high"))

    def _index(self, manifest: dict, keys: list[str]) -> DataFrame:
        """file, low, high, log, bucket, bits: beside each file's range the Bloom filter of 2 ** log bits of its keys."""

        def make(rows: DataFrame) -> DataFrame:
            files = _spans(rows, F.greatest(F.lit(15), F.ceil(F.log2(F.count("*") * BITS))).cast("int").alias("log"))
            bits = rows.join(files.select("path", "log"), "path").select("path", "log", F.explode(_places("key", F.col("log"))).alias("place"))
            maps = bits.groupBy("path", F.floor(F.col("place") / MAP).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(MAP))).alias("bits"))
            return maps.join(files, "path").select(_file(), "low", "high", "log", "bucket", "bits")

        return self._made(manifest, "_index", keys, make)

    def _near_files(self, manifest: dict, keys: list[str], source: DataFrame) -> list[str]:
        """The files to read for the source's keys: all of a small table, for whose bytes the index's jobs would take longer, else those that may hold one."""
        sizes = self._files(manifest)
        return list(sizes) if sum(sizes.values()) <= FILE_BYTES else self._hit_files(manifest, keys, source)

    def _hit_files(self, manifest: dict, keys: list[str], source: DataFrame) -> list[str]:
        """The files that may hold a key of the source: by key ranges and Bloom filters, without reading data. Paths of files reach the driver."""
        files = list(self._files(manifest)) if len(manifest["segments"]) <= FEW else []
        if not manifest["segments"] or 0 < len(files) <= FEW:
            return files
        key = F.struct(*keys)
        rows = source.select(key.alias("key"))
        low, high = _ends(rows)
        asked = rows.agg(low.alias("first"), high.alias("last"), F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.col("key")[k]).alias(f"_{k}") for k in keys])
        ends = asked.first()
        if not ends.n:
            return []
        ends_row = self.spark.createDataFrame([ends], asked.schema).select("first", "last")
        near = lambda index: index.join(F.broadcast(ends_row), (F.col("low") <= F.col("last")) & (F.col("high") >= F.col("first"))).drop("first", "last")
        found = [r.file for r in near(self._ranges(manifest, keys)).select("file").collect()]
        if not found or ends.n * len(found) > TESTS or min(ends[f"_{k}"] for k in keys) > SPREAD * len(found):
            return found
        wanted, index = source.select(key.alias("key")).distinct(), near(self._index(manifest, keys))
        logs = [r.log for r in index.select("log").distinct().collect()]
        asked = wanted.select("key", F.explode(F.array(*[F.lit(x) for x in sorted(logs)])).alias("log"))
        asked = asked.select("key", "log", F.explode(_places("key", F.col("log"))).alias("place")).withColumn("bucket", F.floor(F.col("place") / MAP))
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.pmod("place", F.lit(MAP)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = index.join(asked, ["log", "bucket"]).where((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")))
        bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("place"), F.lit(8)))), F.lit(2)) == 1
        return [r.file for r in held.where(bit).groupBy("file", "key").agg(F.countDistinct("place").alias("n"), F.first("log").alias("log")).where(F.col("n") == F.size(F.array_distinct(_places("key", F.col("log"))))).select("file").distinct().collect()]

    # Writing

    def write(self, df: DataFrame, mode: str = "overwrite", partition_by: list[str] | None = None) -> int:
        """Overwrites (the schema too) or appends; new columns of an append are null in older rows. Columns of an append that don't fit the table's raise before anything is written."""
        now = self.version()
        if mode not in ("overwrite", "append"):
            raise ValueError(f"mode {mode}")
        if mode == "overwrite" or now is None:
            keys = list(partition_by or [])
            return self._commit([self._write(df, keys)], keys, _stored(df, keys), now)
        manifest = self._manifest(now)
        segment = self._write(fitted(df, StructType.fromJson(manifest["schema"])), manifest["partition_by"])

        def after(version: int | None) -> int:
            # An append goes after whatever was committed meanwhile, if that still fits.
            current = manifest if version == now else self._manifest(version)
            schema = widened(StructType.fromJson(current["schema"]), df.schema)
            if current["partition_by"] != manifest["partition_by"]:
                raise ValueError(f"{self.path} has other partitions by now")
            return self._commit([*current["segments"], segment], current["partition_by"], schema, version, current["removed"])

        return self._again(after)

    def upsert(self, source: DataFrame, key: str | list[str], order_by: list[Column] | None = None, partition_by: list[str] | None = None, newer: str | None = None) -> int:
        """Updates rows of the source's keys and inserts the others. The first write creates the table.

        The source is brought to one row a key first, the first by ``order_by`` (default: the greatest row). With ``newer``, a
        stored row stays if its value of that column is greater than the source's.
        """
        keys = [key] if isinstance(key, str) else list(key)
        rows = first_of_key(source, keys, order_by)
        return self._again(lambda version: self._merge(rows, keys, version, partition_by, newer, source.select(*keys)))

    def replace(self, touched: DataFrame, rows: DataFrame, key: str | list[str]) -> int:
        """Takes out all rows with a key of ``touched`` and puts in ``rows``, any number a key, in one version. Keys of rows must be among those touched."""
        keys = [key] if isinstance(key, str) else list(key)
        touched = touched.select(*keys).distinct()
        return self._again(lambda version: self._merge(rows, keys, version, None, None, touched))

    def _merge(self, source: DataFrame, keys: list[str], version: int | None, partition_by: list[str] | None, newer: str | None, touched: DataFrame) -> int:
        if version is None:
            return self._commit([self._write(source, list(partition_by or []))], list(partition_by or []), _stored(source, list(partition_by or [])), None)
        manifest = self._manifest(version)
        schema = widened(StructType.fromJson(manifest["schema"]), source.schema)
        source = fitted(source, StructType.fromJson(manifest["schema"]))
        out = fitted(touched, StructType([f for f in StructType.fromJson(manifest["schema"]) if f.name in keys]))
        near, hit = self._near_files(manifest, keys, out), []
        if near:
            # Rows carry a hash of their file's path; another file of the same hash would be rewritten in vain.
            files, path = self._scan(manifest, near), F.col("_metadata.file_path")
            held = files.select(*keys, *([F.col(newer).alias("_held")] if newer else []), F.xxhash64(path).alias("_at")).join(out, keys, "left_semi")
            if newer:
                source = source.join(held.select(*keys, "_held"), keys, "left").where(F.col("_held").isNull() | (F.col(newer) >= F.col("_held"))).drop("_held")
                out = source.select(*keys)
                held = held.join(out, keys, "left_semi")
            paths = files.select(path.alias("path")).distinct().withColumn("_at", F.xxhash64("path"))
            hit = sorted(r.file for r in paths.join(held.select("_at").distinct(), "_at", "left_semi").select(_file()).collect())
        kept = self._scan(manifest, hit).select(*StructType.fromJson(manifest["schema"]).names).join(out, keys, "left_anti")
        segment = self._write(kept.unionByName(source, allowMissingColumns=True), manifest["partition_by"])
        removed = {s: [*manifest["removed"].get(s, ()), *[f for f in hit if f.startswith(s)]] for s in manifest["segments"]}
        left = self._files(manifest | {"removed": removed})
        segments = [s for s in manifest["segments"] if any(f.startswith(s) for f in left)]
        return self._commit([*segments, segment], manifest["partition_by"], schema, version, {s: f for s, f in removed.items() if f and s in segments}, rewritten=len(hit))

    def insert_new(self, source: DataFrame, key: str | list[str], order_by: list[Column] | None = None, partition_by: list[str] | None = None) -> int:
        """Appends rows whose key isn't there; rows without a key are left out. Keys of another writer that commits meanwhile are there, too."""
        keys = [key] if isinstance(key, str) else list(key)
        source = source.dropna(subset=keys)
        given, source = source.select(*keys), first_of_key(source, keys, order_by)

        def insert(version: int | None) -> int:
            if version is None:
                return self._merge(source, keys, None, partition_by, None, source.select(*keys))
            manifest = self._manifest(version)
            rows = fitted(source, StructType.fromJson(manifest["schema"]))
            asked = fitted(given, StructType([f for f in StructType.fromJson(manifest["schema"]) if f.name in keys]))
            there = self._scan(manifest, self._near_files(manifest, keys, asked)).select(*keys)
            segment = self._write(rows.join(there, keys, "left_anti"), manifest["partition_by"])
            schema = widened(StructType.fromJson(manifest["schema"]), source.schema)
            return self._commit([*manifest["segments"], segment], manifest["partition_by"], schema, version, manifest["removed"])

        return self._again(insert)

    # Maintenance

    def compact(self, files_per_partition: int | None = None, by: str | None = None) -> dict[str, int]:
        """Rewrites small files (below half of FILE_BYTES), where a partition has several, into few of about FILE_BYTES and carries the others over; with
        ``files_per_partition``, all files of each partition into so many; with ``by``, rows of one value of that column into one file. Rows are the same. Raises if another writer commits meanwhile."""
        manifest = self._manifest()
        files, keys = self._files(manifest), manifest["partition_by"]
        folder = lambda path: path.partition("/")[2].partition("/")[2].rpartition("/")[0]
        sizes: dict[str, list[int]] = {}
        for path, size in files.items():
            if files_per_partition or size < FILE_BYTES // 2:
                sizes.setdefault(folder(path), []).append(size)
        several = {f for f, x in sizes.items() if len(x) > 1 or files_per_partition}
        small = [path for path, size in files.items() if folder(path) in several and (files_per_partition or size < FILE_BYTES // 2)]
        if not small:
            return {"before": len(files), "after": len(files)}
        number = files_per_partition or max(-(-sum(sizes[f]) // FILE_BYTES) for f in several)
        df = self._scan(manifest, manifest["segments"] if len(small) == len(files) and not manifest["removed"] else small).select(*StructType.fromJson(manifest["schema"]).names)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in ([by] if by else df.columns)]), F.lit(number)))
        df = (df.repartition(*keys, "_salt") if keys else df.repartition(number, "_salt")).drop("_salt")
        segment = self._write(df, keys)
        gone = set(small)
        removed = {s: [*manifest["removed"].get(s, ()), *[f for f in small if f.startswith(s)]] for s in manifest["segments"]}
        segments = [s for s in manifest["segments"] if any(f.startswith(s) and f not in gone for f in files)]
        self._commit([*segments, segment], keys, StructType.fromJson(manifest["schema"]), manifest["version"], {s: f for s, f in removed.items() if f and s in segments}, rewritten=len(small))
        return {"before": len(files), "after": self.file_count()}

    def zorder(self, columns: list[str], files: int | None = None) -> int:
        """Rewrites the table clustered by the columns: by range for one, by interleaved rank bits for several; by default in files of about FILE_BYTES. Raises if another writer commits meanwhile."""
        manifest = self._manifest()
        df, keys = self._read(manifest), manifest["partition_by"]
        files = files or max(1, -(-sum(self._files(manifest).values()) // FILE_BYTES))
        if len(columns) == 1:
            df = df.repartitionByRange(files, *keys, columns[0]).sortWithinPartitions(*keys, columns[0])
        else:
            df = df.withColumn("_z", z_value(df, columns)).repartitionByRange(files, *keys, "_z").sortWithinPartitions(*keys, "_z").drop("_z")
        return self._commit([self._write(df, keys)], keys, StructType.fromJson(manifest["schema"]), manifest["version"])


def _file() -> Column:
    """The file of a path as a scan gives it, from the table's folder on."""
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, f"(data/{SEGMENT}=.*)$", 1).alias("file")


def _ends(rows: DataFrame) -> tuple[Column, Column]:
    """Least and greatest key. Those of one column are taken by its values, without a struct for each row; its nulls, which match nothing, are left out."""
    names = rows.schema["key"].dataType.names
    if len(names) > 1:
        return F.min("key"), F.max("key")
    value = F.col("key")[names[0]]
    return F.struct(F.min(value).alias(names[0])), F.struct(F.max(value).alias(names[0]))


def _spans(rows: DataFrame, *more: Column) -> DataFrame:
    """The range of each path's keys. Least and greatest values of a fixed width are kept in a map by path. For others alone each task would sort all of its rows by path; beside a set, Spark keeps them in a map, too, if a slower one."""
    low, high = _ends(rows)
    fields = rows.schema["key"].dataType.fields
    if len(fields) == 1 and isinstance(fields[0].dataType, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return rows.groupBy("path").agg(low.alias("low"), high.alias("high"), *more)
    ends = rows.groupBy("path").agg(low.alias("low"), high.alias("high"), *more, F.collect_set(F.lit(0)).alias("_set"))
    return ends.where(F.size("_set") == 1).drop("_set")


def _places(key: str, log: Column) -> Column:
    """The bits of a key in a filter of 2 ** log bits."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.pow(F.lit(2), log).cast("long")) for k in range(HASHES)])


def _stored(df: DataFrame, partition_by: list[str]) -> StructType:
    """The schema as read back: partition columns come last, all may be null."""
    fields = {f.name: f for f in df.schema.fields}
    return StructType([fields[n] for n in df.columns if n not in partition_by] + [fields[n] for n in partition_by])


def first_of_key(df: DataFrame, keys: list[str], order_by: list[Column] | None = None) -> DataFrame:
    """One row a key. Without ``order_by`` the greatest, compared column by column: a struct of them would be sorted and shuffled beside them."""
    order = order_by or [F.desc(c) for c in df.columns if c not in keys] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def z_value(df: DataFrame, columns: list[str], bits: int = 8) -> Column:
    """Bits of each column's approximate quantile bucket, interleaved. Columns must be numeric."""
    buckets = []
    for c in columns:
        cuts = df.stat.approxQuantile(c, [k / 2**bits for k in range(1, 2**bits)], 0.001)
        cuts = sorted(set(cuts))
        edges = F.array(*[F.lit(float(x)) for x in cuts]) if cuts else F.array().cast("array<double>")
        value = F.col(c).cast("double")
        buckets.append(F.size(F.filter(edges, _not_above(value))))
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, bucket in enumerate(buckets):
            out = out + F.shiftleft(F.shiftright(bucket, b).bitwiseAND(F.lit(1)).cast("long"), b * len(columns) + k)
    return out


def _not_above(value: Column):
    return lambda x: x <= value


def maintain(tables: dict[str, LakeTable], cluster: dict[str, list[str]] | None = None, by: dict[str, str] | None = None) -> dict[str, dict[str, int]]:
    """Compacts each table that exists, those in ``by`` with the rows of a key kept in one file, and clusters those that ``cluster`` names."""
    report = {}
    for name, table in tables.items():
        if table.exists():
            report[name] = table.compact(by=(by or {}).get(name))
            if cluster and name in cluster:
                table.zorder(cluster[name])
    return report
