"""Reading source trees and spools, and publishing views."""

from __future__ import annotations

import json
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import policy
from ..session import importable


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content, size) of the regular files below a folder, by Spark's binary file source, which passes over names
    that begin with a dot or an underscore."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/+", "/")
    path = F.regexp_replace("path", r"^file:/+", "/")
    text = F.decode("content", "UTF-8")
    return raw.select(F.substr(path, F.length(base) + 1).alias("path"), text.alias("content"), F.col("length").alias("size"))


def capture(files: DataFrame, ignore: str = "", max_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captured files with language and digest, configuration files, diagnostics path → reason)."""
    from ..operators.projects import config_kind

    judged = files.withColumn("reason", policy.exclusion(F.col("path"), F.col("content"), F.col("size"), policy.ignore_rules(ignore), max_bytes))
    kind = config_kind(F.col("path"))
    digest = F.sha2(F.col("content").cast("binary"), 256)
    kept = judged.filter("reason is null")
    return (
        kept.filter(kind == "").select("path", "content", "size", policy.language(F.col("path")).alias("language"), digest.alias("blob_id")),
        kept.filter(kind != "").select("path", kind.alias("kind"), "content"),
        judged.filter("reason is not null").select("path", "reason"),
    )


def git_files(root: str) -> list[str]:
    """Tracked and untracked, not ignored files of a work tree, distinct and sorted."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    return sorted({p for p in out.decode().split("\0") if p})


def parse_status(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(state, path, origin) of NUL-separated porcelain output; a rename or copy takes the next entry as its origin."""
    parts, out, i = raw.decode().split("\0"), [], 0
    while i < len(parts):
        p = parts[i]
        i += 1
        if len(p) < 4:
            continue
        origin = None
        if p[0] in "RC" or p[1] in "RC":
            origin = parts[i] if i < len(parts) else None
            i += 1
        out.append((p[:2], p[3:], origin))
    return out


def parse_worktrees(raw: bytes) -> list[dict]:
    """One dictionary per block of NUL-separated worktree output."""
    out: list[dict] = []
    for p in raw.decode().split("\0"):
        key, _, value = p.partition(" ")
        if key == "worktree":
            out.append({"path": value})
        elif key and out:
            out[-1][key.lower()] = value or True
    return out


def git_state(root: str) -> dict:
    def run(*a: str) -> bytes:
        return subprocess.run(["git", "-C", root, *a], capture_output=True).stdout

    return {
        "head": run("rev-parse", "HEAD").decode().strip(), "branch": run("branch", "--show-current").decode().strip(),
        "changes": parse_status(run("status", "--porcelain=v1", "-z")), "worktrees": parse_worktrees(run("worktree", "list", "--porcelain", "-z")),
    }


def snapshot_bundle(snapshot: dict) -> tuple[str, str]:
    """(id, JSON) of a snapshot: the id is the SHA-256 of its canonical JSON."""
    import hashlib

    text = json.dumps(snapshot, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest(), text


def save_spool(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """Appends (id, payload) bundles whose id isn't there yet; a payload that isn't what its id says raises."""
    if not rows.filter(F.sha2(F.col("payload").cast("binary"), 256) != F.col("id")).isEmpty():
        raise ValueError("a bundle does not match its id")
    checked = rows
    try:
        there = spark.read.parquet(path)
        checked = checked.join(there.select("id"), "id", "left_anti")
    except Exception as e:  # the spool's first bundle
        if "PATH_NOT_FOUND" not in str(e):
            raise
    checked.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def pending(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> DataFrame:
    """(id, valid) of the spool's bundles in order of id: within the size bound and true to their id."""
    ok = (F.octet_length("payload") <= max_bytes) & (F.sha2(F.col("payload").cast("binary"), 256) == F.col("id"))
    return spark.read.parquet(path).select("id", ok.alias("valid")).orderBy("id")


def view_files(refs: DataFrame, blobs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The files of a view: references joined with blobs, and with their symbols where they have any; a reference to a
    blob that isn't there raises."""
    by_file = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("name", "kind", "start", "end"))).alias("symbols"))
    out = refs.join(blobs.select("blob_id", "content"), "blob_id", "left").join(by_file, refs.id == by_file.file_id, "left")
    content = F.when(F.col("content").isNotNull(), F.col("content")).otherwise(F.raise_error(F.lit("a blob is missing")))
    none = F.array().cast("array<struct<name:string,kind:string,start:bigint,end:bigint>>")
    return out.drop("file_id").withColumns(
        {"content": content, "symbols": F.coalesce("symbols", none), "test": F.endswith(F.col("path"), F.lit("_test.go")), "generated": F.contains(content, F.lit("Code generated"))}
    )


def publish(spark: SparkSession, base: str, view_id: str, tables: dict[str, DataFrame], expected_head: str | None) -> None:
    """Writes a view's tables under its id and then moves the head, if the head is still the expected one.

    A table is written to a staging folder and renamed into place, so a view's folder is whole or not there. A view that is
    there is never rewritten: publishing the same rows again is idempotent, other rows raise. The head is a chain of
    numbered files, and a number can be created once only, so of two publishers that expect the same head one fails.
    """
    found, seq = _head(spark, base)
    if found != expected_head:
        raise RuntimeError("the head has moved")
    fs, path = _filesystem(spark, base)
    for name, df in tables.items():
        target, staged = f"{base}/{name}/view_id={view_id}", f"{base}/_staging/{uuid.uuid4().hex}"
        if not fs.exists(path(target)):
            df.write.parquet(staged)
            fs.mkdirs(path(f"{base}/{name}"))
            if not fs.exists(path(target)) and fs.rename(path(staged), path(target)):
                continue
            fs.delete(path(staged), True)
        there = spark.read.schema(df.schema).parquet(target)
        if not there.exceptAll(df).isEmpty() or not df.exceptAll(there).isEmpty():
            raise RuntimeError(f"view {view_id} is there with other rows")
    if found == view_id:
        return
    try:
        out = fs.create(path(f"{base}/_head/{seq + 1:012d}"), False)
    except Exception as e:
        raise RuntimeError("the head has moved") from e
    out.write(view_id.encode())
    out.close()


def _filesystem(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(base).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _head(spark: SparkSession, base: str) -> tuple[str | None, int]:
    """(the latest view's id, its number); a number whose file is still empty is being written and does not count yet."""
    fs, path = _filesystem(spark, base)
    if not fs.exists(path(f"{base}/_head")):
        return None, 0
    rows = spark.read.text(f"{base}/_head", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]{12})$", 1).cast("long").alias("seq"))
    last = latest(rows.withColumnRenamed("value", "view_id")).first()
    return (last["view_id"], last["seq"]) if last and last["seq"] else (None, 0)


def latest(heads: DataFrame) -> DataFrame:
    """One row of (view_id, seq): the view with the highest number."""
    return heads.agg(F.max_by("view_id", "seq").alias("view_id"), F.max("seq").alias("seq"))


def head(spark: SparkSession, base: str) -> str | None:
    """The latest view's id."""
    return _head(spark, base)[0]


def artifacts(spark: SparkSession, base: str, name: str, view_id: str) -> DataFrame:
    """A table of one view; the folder's partition is all that is read."""
    return spark.read.parquet(f"{base}/{name}").filter(F.col("view_id") == view_id).drop("view_id")


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; none, or more than one, raises when the plan runs."""
    n = F.count(F.lit(1)).over(Window.partitionBy())  # over the rows of one key
    none = df.sparkSession.createDataFrame([(1,)], "__one int")
    found = none.join(df.filter(F.col(key) == value).withColumn("__n", n), F.lit(True), "left")
    return found.filter(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))).drop("__one", "__n")


def upsert(there: DataFrame, new: DataFrame, key: str, create: bool = False) -> DataFrame:
    """there with the rows of new put in by key; with create a key that is there raises."""
    if create:
        clash = new.join(there.select(key), key, "left_semi").limit(1)
        if not clash.isEmpty():
            raise ValueError(f"{key} exists")
    return there.join(new.select(key), key, "left_anti").unionByName(new)


def status_rows(outputs: DataFrame) -> DataFrame:
    """(id, state, path, origin) of NUL-separated porcelain outputs (id, raw)."""

    @F.pandas_udf("array<struct<state:string,path:string,origin:string>>")
    def parsed(raw):
        return raw.map(lambda r: [dict(zip(("state", "path", "origin"), x)) for x in parse_status(r.encode())])

    return importable(outputs).select("id", F.explode(parsed("raw")).alias("s")).select("id", "s.*")


def worktree_rows(outputs: DataFrame) -> DataFrame:
    """(id, path, head, branch) of NUL-separated worktree outputs (id, raw)."""

    @F.pandas_udf("array<struct<path:string,head:string,branch:string>>")
    def parsed(raw):
        return raw.map(lambda r: [{"path": w["path"], "head": w.get("head"), "branch": w.get("branch")} for w in parse_worktrees(r.encode())])

    return importable(outputs).select("id", F.explode(parsed("raw")).alias("w")).select("id", "w.*")


def bundle_states(bundles: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Spooled bundles (id, payload) with their state: ready, oversize, digest (not what the id says) or json (not JSON)."""
    state = (
        F.when(F.octet_length("payload") > max_bytes, "oversize").when(F.sha2(F.col("payload").cast("binary"), 256) != F.col("id"), "digest")
        .when(F.try_parse_json("payload").isNull(), "json").otherwise("ready")
    )
    return bundles.withColumn("state", state)


def load_bundle(bundles: DataFrame, bundle_id: str, max_bytes: int = 64 << 20) -> DataFrame:
    """The payload of one bundle; one that is missing or not ready raises when the plan runs."""
    one = bundle_states(get(bundles, "id", bundle_id), max_bytes)
    ok = F.when(F.col("state") == "ready", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bundle: "), "state")).cast("boolean"))
    return one.filter(ok).drop("state")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit or offset out of bounds")
    return df.orderBy(key).offset(offset).limit(limit)


def lookup(df: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The rows with the wanted keys; a key without a row raises when the plan runs."""
    asked = df.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{key} string")
    out = F.broadcast(asked).join(df.withColumn("__there", F.lit(True)), key, "left")
    return out.filter(F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col(key))).cast("boolean"))).drop("__there")
