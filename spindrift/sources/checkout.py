"""Scanning a checkout: files, skip reasons, patterns, Git output."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.ids import framed_id

#: Largest file that is read, and the folder that is never scanned.
MOST_BYTES = 32 * 1024 * 1024
INTERNAL = r"^\.git(/|$)"
#: Where local state of this library lies in a checkout; never scanned either.
STATE_FOLDER = ".spindrift/local"


def glob_pattern(glob: str) -> str:
    """Regular expression of an ignore pattern, for a path or any of its parents.

    ``*`` and ``?`` stay within a part, ``**`` spans parts, ``[...]`` is a set;
    a pattern with a slash before its end is anchored at the root, others match
    at any depth.
    """
    body = glob.strip("/")
    anchored = glob.startswith("/") or "/" in body
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "(?:^|.*/)") + out + "(?:/.*)?$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether the last matching pattern is not a negated one (``!pattern``)."""
    out = F.lit(False)
    for g in globs:
        negated = g.startswith("!")
        out = F.when(path.rlike(glob_pattern(g[negated:])), F.lit(not negated)).otherwise(out)
    return out


def accepted(path: Column, include: list[str], exclude: list[str], state_folder: str = STATE_FOLDER) -> Column:
    """Included, not excluded, not internal."""
    inside = path.rlike(INTERNAL) | path.rlike(f"^{re.escape(state_folder)}(/|$)")
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude) & ~inside


def skip_reason(content: Column, length: Column) -> Column:
    """Why a file is not read: too_large, binary, invalid_utf8; null if it is."""
    return (
        F.when(length > MOST_BYTES, "too_large").when(F.contains(content, F.lit(b"\0")), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "invalid_utf8")
    )


def empty_files(spark: SparkSession, root: str) -> list[str]:
    """Files without content, which a scan of file contents passes over."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    listing = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    out = []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath())
    return out


def scan(spark: SparkSession, root: str, repository: str, revision: str, include: list[str] = (), exclude: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """Files below ``root`` in any depth.

    Result: repository_id, revision, path, n_bytes, skip_reason, content,
    content_digest. Files of which the name is hidden are scanned too; ``ignore``
    holds the patterns of ignore files. Contents too large are neither read nor
    hashed.
    """
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^(file:)?" + re.escape(root) + "/", "")
    # The bound reaches the reader, which opens no longer file.
    fits = files.filter(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("n_bytes"), "content")
    large = files.filter(F.col("length") > MOST_BYTES).select(path.alias("path"), F.col("length").alias("n_bytes"), F.lit(None).cast("binary").alias("content"))
    read = fits.unionByName(large)
    hollow = spark.createDataFrame([(p[p.index(root) + len(root) + 1 :] if root in p else p, 0, b"") for p in empty_files(spark, root)], read.schema)
    kept = read.unionByName(hollow).filter(accepted(F.col("path"), list(include), list(exclude)) & ~matches_any(F.col("path"), list(ignore)))
    reason = skip_reason(F.col("content"), F.col("n_bytes"))
    return kept.withColumn("skip_reason", reason).select(
        F.lit(repository).alias("repository_id"), F.lit(revision).alias("revision"), "path", "n_bytes", "skip_reason",
        F.when(F.col("skip_reason").isNull(), F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_digest"))


def snapshot_rows(files: DataFrame, generation_id: str) -> DataFrame:
    """Rows of the files table for the files that were read."""
    from spindrift.functions.text import language_of_path

    return files.filter("skip_reason IS NULL").select(
        F.lit(generation_id).alias("generation_id"), framed_id("file", F.col("repository_id"), F.col("path")).alias("file_id"), "repository_id", "revision", "path",
        language_of_path(F.col("path")).alias("language"), "content_digest", "n_bytes")


STATUS = "path string, index_state string, worktree_state string, previous string"


def status_records(raw: str) -> list[tuple[str, str, str, str | None]]:
    """Records of ``status --porcelain -z``: a rename or copy is followed by its old path."""
    parts, out = iter(raw.split("\0")), []
    for p in parts:
        if len(p) < 4:
            continue
        previous = next(parts, None) if p[0] in "RC" or p[1] in "RC" else None
        out.append((p[3:], p[0], p[1], previous))
    return sorted(out)


def status_table(outputs: DataFrame) -> DataFrame:
    """(repository_id, path, ...) of raw status outputs (repository_id, raw)."""

    def run(frames):
        for f in frames:
            rows = [(r.repository_id, *s) for r in f.itertuples() for s in status_records(r.raw)]
            yield pd.DataFrame(rows, columns=["repository_id", "path", "index_state", "worktree_state", "previous"])

    return outputs.mapInPandas(run, f"repository_id string, {STATUS}")


def index_stages(outputs: DataFrame) -> DataFrame:
    """Sorted (stage, oid) of each path of raw ``ls-files --stage -z`` outputs."""
    shape = r"(?s)^[0-9]+ ([0-9a-f]+) ([0-9])\t(.+)$"
    rec = outputs.select("repository_id", F.explode(F.split("raw", "\0")).alias("r")).filter(F.col("r").rlike(shape))
    one = rec.select("repository_id", F.regexp_extract("r", shape, 3).alias("path"), F.regexp_extract("r", shape, 2).cast("int").alias("stage"), F.regexp_extract("r", shape, 1).alias("oid"))
    return one.groupBy("repository_id", "path").agg(F.sort_array(F.collect_list(F.struct("stage", "oid"))).alias("stages"))


def worktree_revision(base: DataFrame, changed: DataFrame, stages: DataFrame, contents: DataFrame) -> DataFrame:
    """``base`` or ``base+dirty.digest`` for each repository.

    The digest covers the changed paths in order, what the index has for them,
    and the digest of what lies in the work tree (null if it is gone).
    """
    key = ["repository_id", "path"]
    part = (
        changed.select(*key).distinct().join(stages, key, "left").join(contents.select(*key, "content_digest"), key, "left")
        .withColumn("line", F.concat_ws("\t", "path", F.to_json("stages"), F.coalesce("content_digest", F.lit("-"))))
    )
    dirty = part.groupBy("repository_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("dirty_digest"))
    return base.join(dirty, "repository_id", "left").select(
        "repository_id", "base_oid", "dirty_digest", F.concat("base_oid", F.coalesce(F.concat(F.lit("+dirty."), "dirty_digest"), F.lit(""))).alias("revision"))
