"""Scans and file-level operators."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import rulebook as rb
from ..functions import text as tx
from ..schema import SOURCE_FILES, conform
from ..session import settle

CODE_GLOB = "*.{ts,tsx,js,jsx}"
SQL_GLOB = "*.sql"
# With the configurations that hold path aliases; they are no audited files.
AUDIT_GLOB = "{*.ts,*.tsx,*.js,*.jsx,*.sql,tsconfig.json}"


def _pattern(glob: str) -> str:
    """Regular expression of a file name glob with ``*``, ``?`` and ``{a,b}``."""
    out, depth = "", 0
    for ch in glob:
        depth += (ch == "{") - (ch == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(ch, "|" if ch == "," and depth else re.escape(ch))
    return out


# A task lists about so many entries before it hands the folders it has not seen to the next round.
LIST_ENTRIES = 5_000


def scan_files(spark: SparkSession, root: str, project: str | None = None, glob: str = AUDIT_GLOB, read_bytes: int = 8 << 20, list_entries: int = LIST_ENTRIES) -> DataFrame:
    """Every matching file below ``root`` as one ``source_files`` row.

    Without ``project`` the first folder below ``root`` names the project, so one scan audits a whole checkout farm; files directly below ``root`` belong
    to a project named like ``root`` itself. Spark's own file sources hide names that begin with ``_`` and give paths as encoded addresses, so the tree
    is listed and read with Arrow's file systems (local, HDFS, object stores) in the tasks. Folders are rows: each round a task walks down from its
    folders until it has seen ``list_entries`` entries, and the folders left over are the next round's rows, dealt out anew. So a project with a third
    of all files is listed by many tasks. The files found are dealt out by a hash of their path and read in batches of ``read_bytes``.
    """
    from pyarrow import fs

    file_system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/") or "/"
    pattern = re.compile(_pattern(glob))

    def walk(batches):
        for batch in batches:
            files, waiting, seen = [], deque(batch.column("path").to_pylist()), 0
            while waiting and seen < list_entries:
                for entry in file_system.get_file_info(fs.FileSelector(waiting.popleft(), recursive=False)):
                    seen += 1
                    if entry.type == fs.FileType.Directory:
                        waiting.append(entry.path)
                    elif entry.type == fs.FileType.File and pattern.fullmatch(entry.base_name):
                        files.append(entry.path)
            paths = [*files, *waiting]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([k >= len(files) for k in range(len(paths))])], ["path", "is_folder"])

    folders, found = spark.createDataFrame([(base,)], "path STRING"), []
    while True:
        level = settle(folders.mapInArrow(walk, "path STRING, is_folder BOOLEAN"), "listing")
        found.append(level.filter("NOT is_folder").select(F.col("path").alias("file_path")))
        folders = level.filter("is_folder").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(F.xxhash64("path"))
    listed = reduce(DataFrame.unionByName, found)

    def read(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("file_path").to_pylist():
                with file_system.open_input_stream(path) as stream:
                    rows.append((path, stream.read()))
                size += len(rows[-1][1])
                if size >= read_bytes:
                    yield contents(rows)
                    rows, size = [], 0
        yield contents(rows)

    def contents(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["file_path", "content"])

    raw = listed.repartition(F.xxhash64("file_path")).mapInArrow(read, "file_path STRING, content BINARY").select(
        "file_path", F.col("content").cast("string").alias("content"))
    if project is not None:
        return raw.select(F.lit(project).alias("project"), F.lit(base).alias("root"), "file_path", "content")
    top = base.rstrip("/")
    below = F.split(F.substring(F.col("file_path"), len(top) + 2, 1 << 20), "/")
    loose = F.size(below) == 1
    return raw.select(F.when(loose, top.rsplit("/", 1)[-1]).otherwise(below[0]).alias("project"),
                      F.when(loose, top).otherwise(F.concat_ws("/", F.lit(top), below[0])).alias("root"), "file_path", "content")


def source_file_scan(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    return scan_files(spark, root, project, CODE_GLOB)


def sql_file_scan(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    return scan_files(spark, root, project, SQL_GLOB)


# Columns of a stored source table: 128 bits of each file's path, by which its buckets are dealt.
FILE_KEYS = ("leafscan_h1", "leafscan_h2")


def file_keys() -> list[Column]:
    return [F.xxhash64("project", "file_path").alias(FILE_KEYS[0]), F.xxhash64(F.lit("file"), "file_path", "project").alias(FILE_KEYS[1])]


def _keys_in(df: DataFrame) -> list[str]:
    return [k for k in FILE_KEYS if set(FILE_KEYS) <= set(df.columns)]


def source_files(df: DataFrame) -> DataFrame:
    """Any table with ``project, file_path, content`` (and optionally ``root``) as source files; the keys of a stored one stay."""
    return conform(df, SOURCE_FILES, *_keys_in(df))


def buckets_of(df: DataFrame) -> int | None:
    """Number of buckets of the stored table that ``df`` selects from; None for other tables."""
    return df.schema[FILE_KEYS[0]].metadata.get("buckets") if _keys_in(df) else None


def store(files: DataFrame, table: str, path: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write source files as ``table``, one file for each bucket of the file keys, and read it back.

    The text is exchanged here, once; the token job of every audit over the table then finds each file in one bucket and exchanges no text, only tokens.
    A bucket is a task of that job: by default there are ``spark.sql.shuffle.partitions`` of them (bytes of code divided by some 64 MB). Passes that
    need no buckets read the files in splits of their own size. ``path`` is a shared folder; without it the table lies in the warehouse.
    """
    spark = files.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, second = file_keys()
    keyed = source_files(files).drop(*FILE_KEYS).select("*", first.alias(FILE_KEYS[0], metadata={"buckets": buckets}), second)
    rows = keyed.repartition(buckets, *FILE_KEYS)
    writer = rows.write.format("parquet").bucketBy(buckets, *FILE_KEYS).sortBy(*FILE_KEYS)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def is_sql(path: Column) -> Column:
    return path.endswith(".sql")


def is_code(path: Column) -> Column:
    return path.rlike(r"\.(?:ts|tsx|js|jsx)$")


def rel_path() -> Column:
    return F.ltrim(tx.relative_path(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")), F.col("root")), F.lit("/"))


def ignore_paths(df: DataFrame, globs: Iterable[str] = rb.USER_IGNORED_GLOBS) -> DataFrame:
    """Drop hidden paths and those matching the default or the given globs."""
    pattern = tx.globs_pattern((*rb.IGNORED_GLOBS, *globs))
    rel = rel_path()
    return df.filter(~rel.rlike(r"(?:^|/)\.[^/]") & ~rel.rlike(pattern))


def backend_roots(df: DataFrame) -> DataFrame:
    """Per project, the first existing backend folder, else the project root.

    Only projects that have such a folder are listed; the aggregate reads paths, never contents.
    """
    rel = F.col("rel")
    hint_rank = F.coalesce(*[
        F.when(rel.startswith(hint + "/"), F.lit(rank)) for rank, hint in enumerate(rb.BACKEND_HINTS)
    ])
    # A filter on the rank before the grouping would work out the path again for each hint.
    best = df.select("project", rel_path().alias("rel")).groupBy("project").agg(F.min(hint_rank).alias("hint_rank")).filter("hint_rank IS NOT NULL")
    hints = F.array(*[F.lit(h) for h in rb.BACKEND_HINTS])
    return best.select("project", F.element_at(hints, F.col("hint_rank") + 1).alias("backend_dir"))


def select_backend_root(df: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Keep the files below each project's backend root; ``root`` becomes that folder."""
    joined = df.join(backend_roots(df) if roots is None else roots, "project", "left")
    below = F.concat(F.col("backend_dir"), F.lit("/"))
    new_root = F.when(F.col("backend_dir").isNull(), F.col("root")).otherwise(
        F.when(F.length(F.coalesce("root", F.lit(""))) > 0, F.concat_ws("/", F.rtrim("root", F.lit("/")), "backend_dir"))
        .otherwise(F.when(F.col("file_path").startswith("/"), F.concat(F.lit("/"), "backend_dir")).otherwise(F.col("backend_dir"))))
    return (
        joined.filter(F.col("backend_dir").isNull() | F.startswith(rel_path(), below))
        .withColumn("root", new_root)
        .select("project", "root", "file_path", "content", *_keys_in(joined))
    )


def audited_files(df: DataFrame, ignore: Iterable[str] = rb.USER_IGNORED_GLOBS, roots: DataFrame | None = None) -> DataFrame:
    """Backend files of the audited types after the ignore list (S01-S04 together)."""
    kept = select_backend_root(source_files(df), roots)
    kept = kept.filter(is_sql(F.col("file_path")) | is_code(F.col("file_path")))
    kept = kept.withColumn("content", F.make_valid_utf8("content"))
    return ignore_paths(kept, ignore)


def file_roles(df: DataFrame) -> DataFrame:
    """Folder roles of every code file as an array."""
    p = tx.normal_path(F.col("file_path"))
    roles = F.array_compact(F.array(*[F.when(p.contains(f"/{r}/"), F.lit(r)) for r in rb.ROLE_FOLDERS]))
    return df.filter(is_code(F.col("file_path"))).select("project", "file_path", roles.alias("roles"))


def orm_tags(df: DataFrame) -> DataFrame:
    """ORMs hinted at by the code file paths, one row per project and ORM."""
    p = F.lower("file_path")
    hits = []
    for orm, fragments in rb.ORM_FRAGMENTS:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | p.contains(fragment)
        hits.append(F.when(hit, F.lit(orm)))
    return (
        df.filter(is_code(F.col("file_path")))
        .select("project", F.explode(F.array_compact(F.array(*hits))).alias("orm"))
        .distinct()
    )


def candidate_rank() -> Column:
    """Discovery order of a code file: routes, controllers, services, then the rest."""
    p = tx.normal_path(F.col("file_path"))
    return (
        F.when(p.contains("/routes/"), 0).when(p.contains("/controllers/"), 1)
        .when(p.contains("/services/"), 2).otherwise(3)
    )


def discovery_candidates(df: DataFrame) -> DataFrame:
    """Code files with their discovery rank (no cap on their number)."""
    return df.filter(is_code(F.col("file_path"))).select(
        "project", "file_path", candidate_rank().alias("candidate_rank"))


def files_scanned(df: DataFrame) -> DataFrame:
    """Audited files per project."""
    return df.groupBy("project").agg(F.count(F.lit(1)).alias("files_scanned"))


def unreadable_files(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """S13, text part: files that are empty of text, not UTF-8, or above an optional size limit.

    No limit applies unless the caller sets one. Unbalanced files are found by the token job.
    """
    reason = F.when(F.col("content").isNull(), "no content")
    reason = reason.when(~F.is_valid_utf8("content"), "invalid utf-8")
    if max_bytes is not None:
        reason = reason.when(F.octet_length("content") > max_bytes, "over size limit")
    return df.select("project", "file_path", reason.alias("reason")).filter("reason IS NOT NULL")
