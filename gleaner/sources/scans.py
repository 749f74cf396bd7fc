"""Readers of landed files. Every schema is explicit; bad rows are raised on or set aside.

`strict=True` fails the job on a malformed file; otherwise malformed rows are left out and
can be had from `rejects`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import constants as K
from gleaner import schemas as S
from gleaner.functions.text import present, strip
from gleaner.operators.attempts import stage_events
from gleaner.sources.growing import follow_lines

CORRUPT = "_corrupt_record"


def with_corrupt(schema: str) -> str:
    return f"{schema}, {CORRUPT} string"


def _json(spark: SparkSession, path: str, schema: str, strict: bool, whole_files: bool) -> DataFrame:
    """Parsed documents with `_file`; one per file or one per line.

    The text is parsed by `from_json` rather than by the JSON reader, which refuses to look at
    malformed rows alone and does not parse at all when no column is asked for.
    """
    text = spark.read.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_name").alias("_file"))
    if whole_files:
        text = text.unionAll(_files_without_bytes(spark, path))
    blank = F.trim("value") == ""
    if not whole_files:
        text = text.filter(~blank)   # an empty line is no row
    if strict:
        parsed = F.when(blank, F.raise_error(F.concat(F.lit("empty file "), "_file"))).otherwise(
            F.from_json("value", schema, {"mode": "FAILFAST"}))
        return text.select(parsed.alias("r"), "_file").select("r.*", "_file")
    # the parser makes nothing of a blank text: it is a reject like any other text without an object
    parsed = F.from_json(F.when(blank, "?").otherwise(F.col("value")), with_corrupt(schema), {"mode": "PERMISSIVE"})
    return text.select(parsed.alias("r"), "_file").select("r.*", "_file")


def _files_without_bytes(spark: SparkSession, path: str) -> DataFrame:
    """('', file name) of files of length 0, which Spark's readers pass over: listed, but not among those that are read."""
    files = spark.read.format("binaryFile").load(path)
    short = lambda c: F.url_decode(F.regexp_extract(c, "[^/]+$", 0))
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(short("file").alias("_file"))
    return listed.join(files.select(short("path").alias("_file")), "_file", "left_anti").select(F.lit("").alias("value"), "_file")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects as text)."""
    if CORRUPT not in df.columns:
        return df, df.select(F.lit(None).cast("string").alias(CORRUPT)).limit(0)
    return (df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT),
            df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT))


def scan_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One JSON document per file; the file stem is the id."""
    df = _json(spark, path, S.RECORD, strict, whole_files=True)
    stem = F.regexp_replace("_file", r"\.json$", "")
    df = df.withColumn("id", F.when(present("id"), F.col("id")).otherwise(F.url_decode(stem)))
    return split_corrupt(df)[0].drop("_file")


def record_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the record files a scan that is not strict leaves out, empty ones included."""
    return (_json(spark, path, S.RECORD, False, whole_files=True).filter(F.col(CORRUPT).isNotNull())
            .select(F.col("_file").alias("file"), F.col(CORRUPT).alias("text")))


def scan_manifests(spark: SparkSession, path: str) -> DataFrame:
    df = _json(spark, path, S.MANIFEST, strict=False, whole_files=True)
    return split_corrupt(df)[0].filter(F.col("slug").isNotNull()).drop("_file")


def membership(manifests: DataFrame) -> DataFrame:
    """(slug, pos, record_id) of the manifests' id lists."""
    return manifests.select("slug", F.posexplode("reel_ids").alias("pos", "record_id"))


def scan_attempt_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Append-only JSON lines; lines that do not parse are skipped. As a stream, the whole lines as they are added to the files."""
    if not stream:
        return split_corrupt(_json(spark, path, S.ATTEMPT, strict=False, whole_files=False))[0].drop("_file")
    lines = follow_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", with_corrupt(S.ATTEMPT), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return split_corrupt(parsed)[0]


def attempts_from_log(log: DataFrame) -> DataFrame:
    """attempts(arm, record_id, at, seq, ok, seconds); rows without a sequence number use the time alone."""
    seq = F.col("seq") if "seq" in log.columns else F.lit(0).cast("bigint").alias("seq")
    return log.select(F.col("profile").alias("arm"), F.col("reel_id").alias("record_id"), "at", seq,
                      F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))


def keyed_json(df: DataFrame, value: Column | str, entry: str, key: str = "id", strict: bool = True) -> DataFrame:
    """Rows of a `{key: object}` store held as JSON text: (key, fields…).

    A text that is no such object fails the job; without `strict` it is left out and can be had from `keyed_rejects`.
    """
    text = F.col(value) if isinstance(value, str) else value
    parsed = F.from_json(text, f"map<string,{entry}>")
    if strict:
        parsed = F.when(text.isNotNull() & not_an_object(text), F.raise_error(F.lit("a store that is no JSON object"))).otherwise(parsed)
    rows = df.select(F.explode(parsed).alias(key, "_e"))
    fields = [f.name for f in rows.schema["_e"].dataType.fields] if isinstance(
        rows.schema["_e"].dataType, T.StructType) else None
    if fields is None:
        return rows.withColumnRenamed("_e", "value")
    return rows.select(key, *[F.col("_e")[f].alias(f) for f in fields if f != key])


def not_an_object(text: Column) -> Column:
    return F.coalesce(~F.startswith(F.trim(text), F.lit("{")) | F.json_object_keys(text).isNull(), F.lit(True))


def keyed_rejects(df: DataFrame, value: Column | str) -> DataFrame:
    """The texts `keyed_json` cannot read."""
    text = F.col(value) if isinstance(value, str) else value
    return df.select(text.alias(CORRUPT)).filter(F.col(CORRUPT).isNotNull() & not_an_object(F.col(CORRUPT)))


def scan_keyed_json(spark: SparkSession, path: str, entry: str, key: str = "id", strict: bool = True) -> DataFrame:
    return keyed_json(spark.read.text(path, wholetext=True), "value", entry, key, strict)


def report_outcomes(reports: DataFrame) -> DataFrame:
    """(started_at, record_id, url, stage, status, error) of run reports."""
    per = reports.select("started_at", F.explode("reels").alias("record_id", "o"))
    return (per.select("started_at", "record_id", F.col("o.url").alias("url"), F.col("o.errors").alias("_e"),
                       F.explode("o.stages").alias("stage", "status"))
            .select("started_at", "record_id", "url", "stage", "status",
                    F.try_element_at("_e", F.col("stage")).alias("error")))


def scan_run_report(spark: SparkSession, path: str) -> DataFrame:
    return report_outcomes(split_corrupt(_json(spark, path, S.RUN_REPORT, strict=False, whole_files=True))[0])


def url_lines(lines: DataFrame, value: str = "value", pattern: str = K.PERMALINK) -> tuple[DataFrame, DataFrame]:
    """(valid urls, rejected lines) of a url list; blank lines and # comments are neither."""
    kept = lines.select(strip(value).alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))
    ok = F.col("url").rlike(pattern)
    return kept.filter(ok), kept.filter(~ok)


def scan_url_list(spark: SparkSession, path: str) -> DataFrame:
    """The valid permalinks of a url file; an error when there are none."""
    good, _ = url_lines(spark.read.text(path))
    if good.isEmpty():
        raise ValueError(f"no valid permalinks in {path}")
    return good


def source_rows(registry: DataFrame) -> DataFrame:
    """(name, url, type, enabled, limit) with the defaults of a registry entry."""
    return (registry.select(F.explode("sources").alias("s")).select("s.*")
            .select("name", "url", F.coalesce("type", F.lit("collection")).alias("type"),
                    F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("limit", F.lit(200)).alias("limit")))


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    return source_rows(spark.read.schema(S.SOURCES).option("multiLine", True).option("mode", "FAILFAST").json(path))


def ledger_tables(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, seen(source, id), dead(source, id)) of a ledger's keyed rows."""
    state = entries.select("name", "last_run", "runs", "last_current", "last_new", "last_ingested",
                           F.coalesce(F.array_size("failed_ids"), F.lit(0)).alias("failed"), "error")
    ids = lambda c: entries.select(F.col("name").alias("source"), F.explode(c).alias("id"))
    return state, ids("cumulative_seen"), ids("failed_ids")


def scan_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ledger_tables(scan_keyed_json(spark, path, S.LEDGER_ENTRY, "name"))


def scan_run_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(log_time, stage, done, total) of text logs; as a stream, of the whole lines as they are added to the files."""
    return stage_events(follow_lines(spark, path) if stream else spark.read.text(path))
