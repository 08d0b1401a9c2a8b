"""Master data and logs as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTITY_TYPES = ("brand", "model", "license_type", "governorate_city")
_ENTITY = "struct<id:string,canonical_name:string,normalized_name:string,aliases:array<string>,mappings:array<string>,brand_id:string,country:string,motor_type:string>"
_DOCUMENT = ", ".join(f"{t} map<string,{_ENTITY}>" for t in ENTITY_TYPES)
ENTITIES = "entity_type string, entity_id string, canonical_name string, normalized_name string, aliases array<string>, brand_id string, country string, motor_type string"


def load_master(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All entities of master documents, one row each; a missing or unreadable document gives no rows.

    ``lines`` reads what ``save_master`` wrote, a document a line, else each file is one document.
    """
    try:
        documents = spark.read.schema(_DOCUMENT).option("multiLine", not lines).json(path)
    except AnalysisException:
        return spark.createDataFrame([], ENTITIES)
    entities = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("entities")) for t in ENTITY_TYPES])
    each = documents.select(F.explode(entities).alias("t")).select("t.entity_type", F.explode("t.entities").alias("entity_id", "e"))
    return each.select("entity_type", "entity_id", "e.canonical_name", "e.normalized_name", "e.aliases", "e.brand_id", "e.country", "e.motor_type")


def master_entities(dimensions: dict[str, DataFrame], kinds) -> DataFrame:
    """The rows of ``load_master`` from dimension and alias tables; ``kinds`` name the entity type, list, key and aliases of each."""
    out = None
    for kind in kinds:
        dim, aliases = dimensions[kind.table], dimensions[kind.aliases]
        listed = aliases.where("alias is not null").groupBy(F.col(kind.key).alias("_k")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
        have = lambda c: F.col(c) if c in dim.columns and c != kind.key else F.lit(None).cast("string")
        rows = dim.join(listed, F.col(kind.key) == F.col("_k"), "left").select(
            F.lit(kind.name).alias("entity_type"), F.col(kind.key).alias("entity_id"), "canonical_name", have("normalized_name").alias("normalized_name"),
            F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), have("brand_id").alias("brand_id"), have("country").alias("country"), have("motor_type").alias("motor_type"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def save_master(entities: DataFrame, path: str) -> None:
    """Writes entities as documents, one a line, in the form ``load_master`` reads; the old documents are replaced once the new ones are whole.

    Each line holds one entity, so nothing is gathered. A line ``_metadata`` has the next number of each entity type.
    """
    entity = F.struct(
        F.col("entity_id").alias("id"), "canonical_name", "normalized_name", "aliases", F.array().cast("array<string>").alias("mappings"), "brand_id", "country", "motor_type"
    )
    documents = [F.when(F.col("entity_type") == t, F.create_map("entity_id", entity)).alias(t) for t in ENTITY_TYPES]
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).try_cast("bigint")
    following = F.struct(*[(F.coalesce(F.max(F.when(F.col("entity_type") == t, number)), F.lit(0)) + 1).alias(f"next_{t}_id") for t in ENTITY_TYPES])
    lines = entities.select(F.to_json(F.struct(*documents)).alias("value"))
    replace_text(lines.unionByName(entities.agg(F.to_json(F.struct(following.alias("_metadata"))).alias("value"))), path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def remove(spark: SparkSession, path: str) -> None:
    files, at, _ = _file_system(spark, path)
    files.delete(at, True)


def _replace(spark: SparkSession, path: str, write) -> None:
    """Writes beside ``path``, then takes its place; a reader finds the old or the new folder, never a part of one."""
    staged = path.rstrip("/") + ".new"
    write(staged)
    files, at, jvm = _file_system(spark, path)
    files.delete(at, True)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(staged), at):
        raise OSError(f"{staged} could not take the place of {path}")


def replace_text(lines: DataFrame, path: str) -> None:
    _replace(lines.sparkSession, path, lambda to: lines.write.mode("overwrite").text(to))


def replace_log(log: DataFrame, path: str) -> None:
    """Writes a log over the one it may have been read from."""
    _replace(log.sparkSession, path, lambda to: log.write.mode("overwrite").json(to))


def read_log(spark: SparkSession, path: str, schema: str | StructType, lines: bool = False) -> DataFrame:
    """A log of JSON records or arrays; missing or unreadable logs are empty, unreadable records are left out."""
    try:
        log = spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return log.dropna(how="all")


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.write.mode(mode).json(path)
