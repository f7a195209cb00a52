"""Typed record loading, replay, call logs, report sinks and frozen manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..operators.admission import reason_codes
from ..operators.skew import top_k

# Field types of the record formats; names are the columns of every loaded table.
MATERIAL = T.StructType([T.StructField(n, T.StringType()) for n in (
    "version_id", "url", "content", "retrieved_at", "published_at", "available_at", "availability_basis", "issuer")])
TARGET = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "text", "as_of", "source_version_id", "assessment_mode")] + [T.StructField("evidence_scope", T.ArrayType(T.StringType()))])
EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "claim_id", "url", "publisher_group", "origin_id", "published_at", "retrieved_at", "content", "quote", "stance")])
CALL = T.StructType([T.StructField("stage", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("wall_seconds", T.DoubleType()),
                     T.StructField("input_chars", T.LongType()), T.StructField("usage", T.StructType([
                         T.StructField(n, T.LongType()) for n in ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")]))])


def parse_records(raw: DataFrame, column: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Parse JSON text against a closed schema; unknown and missing fields are reported by name.

    Adds ``record`` (null when not an object) and the two name lists; nothing is dropped.
    """
    keys = F.map_keys(F.from_json(F.col(column), "map<string,string>"))
    known = F.array(*[F.lit(f) for f in schema.fieldNames()])
    need = F.array(*[F.lit(f) for f in required])
    names = F.coalesce(keys, F.array().cast("array<string>"))
    return raw.withColumns({
        "record": F.when(keys.isNotNull(), F.from_json(F.col(column), schema)),
        "unknown_fields": F.array_sort(F.array_except(names, known)), "missing_fields": F.array_sort(F.array_except(need, names))})


def load_records(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files to (accepted records, rejects with reasons)."""
    parsed = parse_records(spark.read.text(path).filter(~is_blank(F.col("value"))), "value", schema, required)
    bad = F.col("record").isNull() | (F.size("unknown_fields") > 0) | (F.size("missing_fields") > 0)
    rejects = parsed.filter(bad).select("value", "unknown_fields", "missing_fields", F.col("record").isNull().alias("not_an_object"))
    return parsed.filter(~bad).select("record.*"), rejects


def replay(returns: DataFrame, round_number: int, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of one recorded round."""
    return top_k(returns.filter(F.col("round") == round_number), ["round"], order, limit, "position").drop("position")


def replay_rounds(returns: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first ``limit`` rows of every recorded round."""
    return top_k(returns, ["round"], order, limit, "position")


def snapshot_pool(materials: DataFrame, seeds: DataFrame) -> DataFrame:
    """Problems of a snapshot pool: repeated version ids (benign or colliding) and unknown seeds."""
    twice = materials.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fingerprint").alias("d")).filter("n > 1").select(
        "version_id", F.when(F.col("d") > 1, "version_id_collision").otherwise("duplicate_version_id").alias("problem"))
    unknown = seeds.select("version_id").join(materials.select("version_id"), "version_id", "left_anti").withColumn("problem", F.lit("unknown_seed"))
    again = seeds.groupBy("version_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("version_id", F.lit("duplicate_seed").alias("problem"))
    return twice.unionByName(unknown).unionByName(again)


def flatten_rounds(snapshots: DataFrame, rounds: Column, *keep: str) -> DataFrame:
    """List of lists to rows with round and position numbers, both from one."""
    outer = snapshots.select(*keep, F.posexplode(rounds).alias("_r", "_items"))
    return outer.select(*keep, (F.col("_r") + 1).alias("round"), F.posexplode("_items").alias("_p", "item")).withColumn(
        "position", F.col("_p") + 1).drop("_p")


def round_ends(snapshots: DataFrame, rounds: Column, *keep: str) -> DataFrame:
    """Rounds numbered from one with their number of items and the last one: what ``flatten_rounds`` grouped by round would give,
    read off the lists, so that no item becomes a row and nothing is shuffled.  Rounds without items have no row.
    """
    outer = snapshots.select(*keep, F.posexplode(rounds).alias("_r", "_items")).filter(F.size("_items") > 0)
    return outer.select(*keep, (F.col("_r") + 1).alias("round"), F.size("_items").alias("items"), F.element_at("_items", -1).alias("last_item"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files ``{"target": .., "rounds": [[material, ..], ..]}`` to material rows."""
    schema = T.StructType([T.StructField("target", TARGET), T.StructField("rounds", T.ArrayType(T.ArrayType(MATERIAL)))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return flatten_rounds(rows, F.col("rounds"), "target").select(F.col("target.id").alias("target_id"), "round", "position", "item.*")


def read_call_logs(spark: SparkSession, path: str) -> DataFrame:
    """Per-case call files named <case>-<arm>-calls.json to one fact table."""
    rows = spark.read.schema(CALL).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pattern = r"^(.*)-([^-]+)-calls\.json$"
    return rows.select(F.regexp_extract(name, pattern, 1).alias("case_id"), F.regexp_extract(name, pattern, 2).alias("arm"),
                       "stage", "success", "wall_seconds", "input_chars", "usage.*")


def finite_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose numbers are all finite, and the others with the names of the bad columns."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = F.lit(float("inf"))
    bad = reason_codes(*[(F.isnan(F.col(n)) | (F.abs(F.col(n)) == inf), n) for n in numbers]) if numbers else F.array().cast("array<string>")
    marked = df.withColumn("non_finite", bad)
    return marked.filter(F.size("non_finite") == 0).drop("non_finite"), marked.filter(F.size("non_finite") > 0)


def write_report(df: DataFrame, path: str, format: str = "json") -> None:
    """Write a report once: existing output is refused, non-finite numbers are an error."""
    _, bad = finite_rows(df)
    if not bad.isEmpty():
        raise ValueError("report holds non-finite numbers")
    df.write.mode("errorifexists").format(format).save(path)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and digest of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(actual: DataFrame, registered: DataFrame) -> DataFrame:
    """Artifacts that are missing, unregistered or changed against the registered manifest."""
    a = actual.select("path", F.struct("bytes", "sha256").alias("_a"))
    b = registered.select("path", F.struct("bytes", "sha256").alias("_b"))
    problem = (F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unregistered")
               .when(F.col("_a.bytes") != F.col("_b.bytes"), "size_differs").when(F.col("_a.sha256") != F.col("_b.sha256"), "digest_differs"))
    return a.join(b, "path", "full_outer").select("path", problem.alias("problem")).filter("problem IS NOT NULL")
