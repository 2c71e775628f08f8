"""Sources and sinks on files, through Spark's readers and Hadoop's file systems only."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.sources.staging import folder, release, shared

TRANSCRIPT = "type string, uuid string, sessionId string, timestamp string, isSidechain boolean, isMeta boolean, message struct<role: string, content: string>, _corrupt_record string"
REGISTRY = "path string, mtime timestamp"
RECEIPT = "receipt"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _plain(column: str):
    """Readers write local paths with one slash or three."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole and then renamed."""
    fs, p = _path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def append_line(spark: SparkSession, path: str, row: dict) -> None:
    """A journal's next line, keys sorted.  A journal is a folder with a file for each line, named by the time it was
    written, so a line costs the same however long the journal is; Spark reads the folder like one file."""
    write_text(spark, f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl", json.dumps(row, sort_keys=True) + "\n")


def append_rows(rows: DataFrame, path: str) -> None:
    """Many of a journal's next lines at once; a reader sees all of an append or none."""
    rows.write.mode("append").json(path)


#: Files that the driver lists at once, and entries of a folder that it looks at to deal them out.
PORTION, ENTRIES = 10_000, 1_000


def append_files(rows: DataFrame, path: str) -> None:
    """A file for each row (value: its lines), in folders of about `PORTION` below path: a folder for each would be listed by
    jobs whose results, a task for each folder, meet at the driver.  No rows leave no file."""
    many = -(-rows.count() // PORTION)
    kind = F.lit("files") if many <= 1 else F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.pmod(F.xxhash64("value"), F.lit(many)))
    rows.select("value", kind.alias("kind")).write.mode("append").option("maxRecordsPerFile", 1).partitionBy("kind").text(path)


def portions(spark: SparkSession, root: str) -> list[list[str]]:
    """root in lists of paths, whole folders, of about `PORTION` files each, for Spark's readers hold all that they read from
    in the driver; root alone where it has no folders or more than `ENTRIES` entries."""
    fs, p = _path(spark, root)
    children, folders, out, held = fs.listStatusIterator(p), [], [[]], 0
    for _ in range(ENTRIES):
        if not children.hasNext():
            break
        x = children.next()
        folders.append((x.getPath(), x.isDirectory()))
    if children.hasNext() or not any(d for _, d in folders):
        return [[root]]
    for path, of_files in folders:
        many = fs.getContentSummary(path).getFileCount() if of_files else 1
        if out[-1] and held + many > PORTION:
            out.append([])
            held = 0
        out[-1].append(path.toString())
        held += many
    return out if len(out) > 1 else [[root]]


def listing(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, mtime, length of all files below root, by portions; contents stay where they are."""
    parts = portions(spark, root)
    if len(parts) == 1:
        return _listed(spark, parts[0], pattern)
    out = folder(spark, "listing")
    for paths in parts:
        (rows := _listed(spark, paths, pattern)).write.mode("append").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def _listed(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(paths).select(_plain("path").alias("path"), F.col("modificationTime").alias("mtime"), "length")


def candidates(spark: SparkSession, root: str, least: int = 32_768, pattern: str = "*.jsonl") -> DataFrame:
    """Main-session transcripts of a size worth sampling, sorted."""
    name = F.element_at(F.split("path", "/"), -1)
    return listing(spark, root, pattern).where((F.col("length") >= least) & ~name.startswith("agent-")).select("path", "length").orderBy("path")


def transcripts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries with their file; a line that can't be parsed keeps its text in _corrupt_record."""
    rows = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(paths)
    return rows.select("*", _plain("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))


def scan(spark: SparkSession, root: str, registry: DataFrame, full: bool = False, pattern: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """Entries of files that are new or newer than the registry says, and the registry afterwards.

    A file with a broken line is skipped whole and stays unrecorded.  Files are taken portion by portion, so that the driver
    holds a portion's names and times and no more."""
    out, recorded = folder(spark, "scan"), folder(spark, "scanned")
    known = registry.select("path", F.col("mtime").alias("seen"))
    for paths in portions(spark, root):
        files = _listed(spark, paths, pattern).select("path", "mtime")
        due = files.join(known, "path", "left").where(F.lit(full) | F.col("seen").isNull() | (F.col("mtime") > F.col("seen"))).select("path", "mtime")
        rows = shared(transcripts(spark, paths).join(due.select("path"), "path", "left_semi"), "scan")
        broken = rows.where("_corrupt_record is not null").select("path").distinct()
        (fine := rows.join(broken, "path", "left_anti").drop("_corrupt_record")).write.mode("append").parquet(out)
        (done := due.join(broken, "path", "left_anti")).write.mode("append").parquet(recorded)
        release(rows)
    entries, done = (spark.read.schema(x.schema).parquet(at) for x, at in ((fine, out), (done, recorded)))
    return entries, registry.join(done.select("path"), "path", "left_anti").unionByName(done)


def findings(spark: SparkSession, root: str, pattern: str = "*issues.jsonl") -> DataFrame:
    """Sidecar findings; blank lines and dismissed rows go, `line` must be a whole number."""
    schema = "file string, line string, message string, dismissed boolean"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
    kept = rows.where("file is not null and not coalesce(dismissed, false)")
    line = F.when(F.col("line").rlike(r"^-?\d+$"), F.col("line").cast("int")).otherwise(F.raise_error(F.concat(F.lit("no line number: "), F.coalesce("line", F.lit("null")))).cast("int"))
    return kept.select("file", line.alias("line"), "message")


def import_batch(spark: SparkSession, path: str, version: int, keys: list[str], labels: list[str]) -> DataFrame:
    """Rows of a versioned batch; unknown keys, another version or label fail."""
    raw = spark.read.option("multiLine", "true").schema("version int, rows array<map<string, string>>").json(path)
    rows = raw.select("version", F.explode("rows").alias("r"))
    extra = F.array_except(F.map_keys("r"), F.array(*map(F.lit, keys)))
    wrong = F.when(F.col("version") != version, F.lit("version")).when(F.size(extra) > 0, F.concat(F.lit("unknown keys "), F.array_join(extra, ","))).when(~F.try_element_at("r", F.lit("label")).isin(labels), F.lit("label"))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("import: "), wrong)).cast("map<string,string>")).otherwise(F.col("r"))
    return rows.select(checked.alias("r")).select(*(F.try_element_at("r", F.lit(k)).alias(k) for k in keys))


def write_views(views: dict[str, DataFrame], root: str, split: str = "split") -> None:
    """A folder for each view and split, empty ones too."""
    for name, df in views.items():
        for s in ("train", "test"):
            df.where(F.col(split) == s).drop(split).write.mode("overwrite").parquet(f"{root}/{name}/{s}")


def write_with_receipt(df: DataFrame, path: str, receipt: dict) -> None:
    """Parquet whose schema metadata carry the receipt, on the first column."""
    first, *rest = df.columns
    marked = F.col(f"`{first}`").alias(first, metadata={RECEIPT: json.dumps(receipt, sort_keys=True)})
    df.select(marked, *(F.col(f"`{c}`") for c in rest)).write.mode("overwrite").parquet(path)


def read_with_receipt(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and their receipt; files without one are refused."""
    df = spark.read.parquet(path)
    held = df.schema.fields[0].metadata.get(RECEIPT)
    if held is None:
        raise ValueError(f"{path} has no receipt")
    return df, json.loads(held)


def _text_digest(lines: DataFrame, column: str = "value") -> str:
    """A digest of the lines whatever their order: sha256 over sha256 of each, sorted, in a tree by leading digits."""
    one = F.sha2(F.col(column), 256)
    joined = lambda h: F.sha2(F.array_join(F.array_sort(F.collect_list(h)), "\n"), 256)
    level = lines.select(one.alias("h")).groupBy(F.substring("h", 1, 4).alias("p")).agg(joined("h").alias("h"))
    level = level.groupBy(F.substring("p", 1, 2).alias("p")).agg(joined(F.concat("p", "h")).alias("h"))
    return level.agg(joined(F.concat("p", "h")).alias("h")).first().h or ""


def freeze(df: DataFrame, path: str) -> str:
    """An evaluation set for good: JSON lines and a manifest with their digest, whatever their order.  Other contents at the
    same path are refused; nothing is brought to the driver but the digest."""
    spark = df.sparkSession
    lines = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))).alias("value"))
    digest = _text_digest(lines)
    if (old := read_text(spark, f"{path}/manifest.json")) is not None:
        if json.loads(old)["sha256"] != digest:
            raise ValueError(f"{path} is frozen with other contents")
        return digest
    lines.write.mode("overwrite").text(f"{path}/rows")
    write_text(spark, f"{path}/manifest.json", json.dumps({"rows": spark.read.text(f"{path}/rows").count(), "sha256": digest}))
    return digest


def read_frozen(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The frozen rows, if their lines still have the manifest's digest."""
    want = json.loads(read_text(spark, f"{path}/manifest.json") or "{}").get("sha256")
    got = _text_digest(spark.read.text(f"{path}/rows"))
    if want != got:
        raise ValueError(f"{path} was changed: {got} is not {want}")
    return spark.read.schema(schema).json(f"{path}/rows")


def covered(frame: DataFrame, store: DataFrame, key: str, p: str) -> DataFrame:
    """frame with its stored probabilities; a missing one, or one that isn't within [0, 1], fails."""
    joined = frame.join(store.select(key, p), key, "left")
    ok = F.col(p).isNotNull() & ~F.isnan(p) & (F.col(p) >= 0) & (F.col(p) <= 1)
    return joined.withColumn(p, F.when(ok, F.col(p)).otherwise(F.raise_error(F.concat(F.lit("no probability for "), F.col(key).cast("string"))).cast("double")))
