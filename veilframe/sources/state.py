"""Files of state, tasks and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import constants as c
from veilframe import schemas
from veilframe.operators.payload import form_fields



def read_json(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of a JSON file; a missing or corrupt one gives none (`unreadable` tells which). Field order is the schema's, so first-seen orders hold."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("encoding", encoding).json(path)
        df.schema  # noqa: B018
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def unreadable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, record: what read_json leaves out of the files of a path, a row a document that is no JSON of the schema.
    A missing path has none."""
    try:
        raw = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
        # Spark reads the column of bad records only beside others, so they are named too.
        read = F.to_json(F.struct(*(x for x in raw.columns if x != "_bad"))).isNotNull()
        return raw.filter(F.col("_bad").isNotNull() & read).select(F.col("_metadata.file_path").alias("path"), F.col("_bad").alias("record"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, record string")


#: Bytes 0x80 to 0x9F of Windows-1252; five of them mean nothing there.
_HIGH = [bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)]
_KNOWN = [b for b in range(32) if _HIGH[b] != "\ufffd"]
_VOID = "[" + "".join(f"\\x{{{0x80 + b:x}}}" for b in range(32) if b not in _KNOWN) + "]"


def read_text_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document of a file of unknown encoding: UTF-8 with or without a mark, else Windows-1252, else ISO-8859-1."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("content"))
    utf, latin = F.try_validate_utf8(F.expr("cast(content as string)")), F.decode("content", "ISO-8859-1")
    windows = F.translate(latin, "".join(chr(0x80 + b) for b in _KNOWN), "".join(_HIGH[b] for b in _KNOWN))
    text = F.regexp_replace(F.coalesce(utf, F.when(F.regexp_like(latin, F.lit(_VOID)), latin).otherwise(windows)), "^﻿", "")
    return raw.select(F.from_json(text, schema).alias("r")).select("r.*")


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a file with task_prompts; without any it fails."""
    t = read_json(spark, path, f"task_prompts array<struct<{_fields(schemas.TASK)}>>").select(F.inline("task_prompts"))
    if t.isEmpty():
        raise ValueError(f"{path} has no task_prompts")
    return t


def domains(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, f"domains array<struct<{_fields(schemas.DOMAIN)}>>").select(F.inline("domains"))


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def traces(backstory: DataFrame, runtime: DataFrame) -> DataFrame:
    """All traces, backstory first."""
    return backstory.withColumn("part", F.lit(0)).unionByName(runtime.withColumn("part", F.lit(1)), allowMissingColumns=True)


def merged(profile: DataFrame, all_traces: DataFrame, user: str) -> DataFrame:
    """The merged state: a row for each trace with its user's profile (a struct user_profile, null where there is none) and
    contacts (none: an empty array), and a row with null trace columns for each user without traces.

    profile: user, contacts (optional) and the profile's fields, a row a user. Traces of a null user keep their rows. The join
    keeps a user's many traces on its left side, where AQE splits them."""
    fields = [x for x in profile.columns if x not in (user, "contacts")]
    contacts = F.col("contacts") if "contacts" in profile.columns else F.lit(None).cast("array<string>")
    own = profile.select(user, F.struct(*fields).alias("user_profile"), contacts.alias("contacts"))
    told = all_traces.join(own, user, "left")
    silent = own.join(all_traces.select(user).distinct(), user, "left_anti")
    both = told.unionByName(silent, allowMissingColumns=True)
    return both.withColumn("contacts", F.coalesce("contacts", F.array().cast(own.schema["contacts"].dataType)))


def save_runtime(all_traces: DataFrame, path: str) -> None:
    """Runtime traces only: backstory written with them would double at the next load."""
    all_traces.filter("part = 1").drop("part").write.mode("overwrite").json(path)


def append_traces(rows: DataFrame, path: str) -> None:
    """New rows in files of their own; nothing is read or written again."""
    rows.write.mode("append").json(path)


def reset_traces(spark: SparkSession, path: str, schema: str = schemas.TRACE) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def backstory_slice(trace_rows: DataFrame, position: str, n: int) -> DataFrame:
    return trace_rows.filter(F.col(position) < n)


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def summaries(results: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """The metrics of each group as a map, for a compact report."""
    return results.groupBy(*keys).agg(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(F.avg(m).cast("double") for m in metrics))).alias("metrics"))


def task_summaries(rows: DataFrame, task: list[str], method: str = "method", text: str = "sanitized", response: str = "answer", provider: str | None = "provider") -> DataFrame:
    """A row a task: payloads (map of method to text) and clm_responses (map of method to a map of provider to answer, or to
    the one answer where provider is None). rows: by task, method and provider. As many entries as methods and providers."""
    keys = [*task, method]
    if provider is None:
        each = rows.groupBy(*keys).agg(F.first(text, True).alias("_t"), F.first(response, True).alias("_r"))
    else:
        each = rows.groupBy(*keys, provider).agg(F.first(text, True).alias("_t"), F.first(response, True).alias("_r"))
        each = each.groupBy(*keys).agg(F.first("_t", True).alias("_t"), F.map_from_entries(F.collect_list(F.struct(provider, "_r"))).alias("_r"))
    pairs = lambda x: F.map_from_entries(F.collect_list(F.struct(method, F.coalesce(x, F.lit("")) if x == "_t" else F.col(x))))
    return each.groupBy(*task).agg(pairs("_t").alias("payloads"), pairs("_r").alias("clm_responses"))


def write_summary(spark: SparkSession, path: str, metadata: dict[str, str], aggregates: DataFrame, tasks: DataFrame) -> None:
    """The compact report beside the full results: metadata, aggregates and tasks as JSON lines in folders of their own."""
    spark.createDataFrame([(metadata,)], "metadata map<string,string>").write.mode("overwrite").json(f"{path}/metadata")
    aggregates.write.mode("overwrite").json(f"{path}/aggregates")
    tasks.write.mode("overwrite").json(f"{path}/tasks")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-|-$", "")


def registry(services: DataFrame, order: str) -> DataFrame:
    """One service a slug, the last registered."""
    s = services.withColumn("slug", slug(F.col("name")))
    cols = [x for x in s.columns if x != "slug"]
    return s.groupBy("slug").agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select("slug", "r.*")


def service_form(spark: SparkSession, services: DataFrame) -> DataFrame:
    return services.join(F.broadcast(form_fields(spark)), "category")  # 28 rows


def by_category(services: DataFrame, category: str) -> DataFrame:
    return services.filter(F.col("category") == category)


def providers(spark: SparkSession, base_url: str = "http://localhost:8000") -> DataFrame:
    """category, name, address, distance_miles, url of the local lookup (its location argument never mattered)."""
    rows = spark.createDataFrame(c.PROVIDERS, "category string, name string, address string, distance_miles double, path string")
    return rows.select("category", "name", "address", "distance_miles", F.concat(F.lit(base_url), "path").alias("url"))


def location() -> Column:
    return F.lit(c.LOCATION)


def calendar() -> Column:
    """The stored state has no calendar, so there are no entries; contacts likewise."""
    return F.expr("cast(array() as array<string>)")


def booking(doctor: Column) -> Column:
    return F.struct(F.lit("confirmed").alias("status"), doctor.alias("doctor"))
