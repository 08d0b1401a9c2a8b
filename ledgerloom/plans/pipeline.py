"""The whole run: report rows to resolved rows, star schema and logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.functions.text import clean_token, normalize_text, simple_normalize
from ledgerloom.operators import dimensions, provider, reports, resolution
from ledgerloom.operators.sequences import numbered
from ledgerloom.session import cut

#: Answers requests ``phase, entity_type, scope, brand_name, value`` with ``matched, canonical_name, confidence``.
Provider = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Kind:
    """An entity type: the raw column it is named in, its list, the list's key, its aliases."""

    name: str
    raw: str
    table: str
    key: str
    aliases: str


KINDS = (
    Kind("brand", "brand", "dim_brand", "brand_id", "dim_brand_alias"),
    Kind("governorate_city", "governorate", "dim_governorate", "governorate_id", "dim_governorate_alias"),
    Kind("license_type", "license_type", "dim_licensetype", "licensetype_id", "dim_licensetype_alias"),
)
MODEL = Kind("model", "model", "dim_model", "model_id", "dim_model_alias")
FIELDS = tuple(k.name for k in (*KINDS, MODEL))
#: The id column of each field in resolved rows, and the columns of its list that are attached, with their names there.
ROW_IDS = {"brand": "brand_id", "governorate_city": "governorate_id", "license_type": "license_type_id", "model": "model_id"}
ATTACHED = {
    "brand": {"canonical_name": "brand_canonical_name", "country": "brand_country"},
    "governorate_city": {"canonical_name": "governorate_canonical_name"},
    "license_type": {"canonical_name": "license_type_canonical_name"},
    "model": {"canonical_name": "model_canonical_name", "motor_type": "model_motor_type"},
}
LEARNED = ("typo", "fuzzy", "external_match", "created", "exists", "created_earlier", "prefix_variant", "completion")
#: Answers of a run that are sent to all tasks rather than all report rows being shuffled for them.
SENT_ROWS = 100_000
LOG = "entity_type string, scope string, value string, reason string, entity_id string, score double"


def with_alias_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with an empty alias table for every list that has none."""
    out = dict(tables)
    for kind in (*KINDS, MODEL):
        if kind.aliases not in out:
            out[kind.aliases] = out[kind.table].where(F.lit(False)).select(F.col(kind.key).cast("string").alias(kind.key), F.lit(None).cast("string").alias("alias"))
    return out


def _known(tables: dict[str, DataFrame], kinds: Sequence[Kind]) -> tuple[DataFrame, DataFrame]:
    """Entities and aliases of the lists in the shape of the cascade, scoped by entity type (models by brand).

    Entities go by their ids; an entity's own name is the first of its aliases.
    """
    entities, aliases = None, None
    for kind in kinds:
        dim, extra = tables[kind.table].where(F.col(kind.key).isNotNull()), tables[kind.aliases].where(F.col(kind.key).isNotNull())
        scope = F.col("brand_id") if kind is MODEL else F.lit(kind.name)
        own = dim.select(scope.alias("scope"), F.col(kind.key).alias("entity_id"), F.col("canonical_name").alias("name")).where("scope is not null")
        order = F.col("alias_id").cast("bigint") if "alias_id" in extra.columns else F.lit(0).cast("bigint")
        ord_ = lambda i, o: F.struct(F.col("entity_id").alias("e"), F.lit(i).alias("k"), o.alias("o"), F.col("alias").alias("a"))
        named = own.select("scope", "entity_id", F.col("name").alias("alias")).withColumn("ord", ord_(0, F.lit(0).cast("bigint")))
        more = extra.select(F.col(kind.key).alias("entity_id"), "alias", order.alias("_o")).join(own.select("scope", "entity_id").distinct(), "entity_id")
        named = named.unionByName(more.withColumn("ord", ord_(1, F.col("_o"))).select("scope", "entity_id", "alias", "ord"))
        entities = own if entities is None else entities.unionByName(own)
        aliases = named if aliases is None else aliases.unionByName(named)
    return entities, aliases.where(clean_token(F.col("alias")) != "")


def _next(dim: DataFrame, key: str) -> int:
    return (dim.agg(F.max(F.regexp_extract(key, r"(\d+)$", 1).try_cast("bigint"))).first()[0] or 0) + 1


def _lookup(entities: DataFrame, key: str, *scope: str) -> DataFrame:
    """The first id of each normalized name (within a scope)."""
    keyed = entities.select(*scope, F.col(key).alias("_id"), normalize_text(F.col("canonical_name")).alias("_n")).where("_n <> ''")
    return keyed.groupBy(*scope, "_n").agg(F.min("_id").alias("_id"))


def _answered(asked: DataFrame, kind: Kind, phase: str, ask: Provider, gate: float) -> tuple[DataFrame, DataFrame]:
    """``scope, brand_name, value, ord, name`` of the requests with a confident answer that gives a name, and the others with the reason."""
    shown, own = (F.col("scope"), F.col("scope")) if kind is MODEL else (F.lit(""), F.lit(kind.name))
    requests = asked.select(F.lit(phase).alias("phase"), F.lit(kind.name).alias("entity_type"), shown.alias("scope"), "brand_name", "value")
    sure = F.max_by(F.struct(F.trim(F.coalesce("canonical_name", F.lit(""))).alias("name"), resolution.confident(F.col("matched"), F.col("confidence"), gate).alias("sure")), F.struct(F.coalesce("confidence", F.lit(1.0)), F.coalesce("canonical_name", F.lit(""))))
    judged = cut(asked.join(provider.answers(requests, ask).groupBy(own.alias("scope"), "value").agg(sure.alias("b")), ["scope", "value"], "left"))
    confident = F.coalesce(F.col("b.sure"), F.lit(False))
    named = judged.where(confident & (normalize_text(F.col("b.name")) != "")).select("scope", "brand_name", "value", "ord", F.col("b.name").alias("name"))
    reason = F.when(confident, F.lit("identified without a name")).otherwise(F.lit("not identified or of low confidence"))
    failed = judged.where(~confident | (normalize_text(F.col("b.name")) == "")).select("scope", "brand_name", "value", "ord", reason.alias("reason"))
    return named, failed


def _upsert(dim: DataFrame, key: str, made: DataFrame) -> DataFrame:
    """The dimension with new entities ``key, canonical_name`` (and their brand); attributes not known yet are null."""
    row = {c: F.col(c) if c in made.columns else normalize_text(F.col("canonical_name")) if c == "normalized_name" else F.lit(None).cast(t) for c, t in dim.dtypes}
    return cut(dimensions.merge_upsert(dim, made.select(*[x.alias(c) for c, x in row.items()]), key))


def _placed(answered: DataFrame, kind: Kind, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scope, value, entity_id, stage`` of answers, and the dimension with the entities they name that it did not have."""
    met = cut(answered.withColumn("_n", normalize_text(F.col("name"))).join(_lookup(dim, kind.key), "_n", "left"))
    fresh = met.where("_id is null")
    ids = cut(dimensions.surrogate_ids(fresh, "_n", "ord", kind.name, _next(dim, kind.key)))
    names = fresh.groupBy("_n").agg(F.min(F.struct("ord", "name"))["name"].alias("canonical_name"))
    made = ids.join(names, "_n").select(F.col("entity_id").alias(kind.key), "canonical_name")
    stage = F.when(F.col("_id").isNotNull(), F.lit("exists")).otherwise(F.lit("created"))
    hits = met.join(ids, "_n", "left").select("scope", "value", F.coalesce("_id", "entity_id").alias("entity_id"), stage.alias("stage"))
    return cut(hits), _upsert(dim, kind.key, made)


def _placed_models(answered: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``_placed``, within brands and behind the guards against models that are known under another form of their name."""
    known = models.select(F.col("brand_id").alias("scope"), F.col("model_id").alias("entity_id"), F.col("canonical_name").alias("name")).where("scope is not null and name is not null")
    judged = cut(provider.guarded_creation(answered, known).join(answered.select("scope", "value", "ord", normalize_text(F.col("name")).alias("norm")), ["scope", "value"]))
    fresh = judged.where("stage = 'created'").withColumn("_n", F.concat_ws("\x1f", "scope", "norm"))
    ids = dimensions.surrogate_ids(fresh, "_n", "ord", "model", _next(models, "model_id")).join(fresh.select("scope", "norm", "_n").distinct(), "_n")
    ids = cut(ids.select("scope", "norm", "entity_id"))
    by_name = known.select("scope", normalize_text(F.col("name")).alias("norm"), "entity_id").groupBy("scope", "norm").agg(F.min("entity_id").alias("entity_id")).where("norm <> ''")
    # a target is an id, or a name that is known, created in this run, or itself held to be another one
    stands = known.select("scope", F.col("entity_id").alias("target"), "entity_id")
    for named in (by_name, ids):
        stands = stands.unionByName(named.select("scope", F.col("norm").alias("target"), "entity_id"))
    stands = cut(stands.groupBy("scope", "target").agg(F.min("entity_id").alias("entity_id")))
    onward = cut(judged.where("stage in ('prefix_variant', 'completion')").groupBy("scope", F.col("norm").alias("target")).agg(F.min("target").alias("_next")))
    left, found = judged.select("scope", "value", "stage", "target"), []
    while True:  # every step leads to an earlier name or to one with more letters, so this ends
        met = cut(left.join(stands, ["scope", "target"], "left"))
        found.append(met.where("entity_id is not null").select("scope", "value", "entity_id", "stage"))
        left = cut(met.where("entity_id is null").join(onward, ["scope", "target"]).select("scope", "value", "stage", F.col("_next").alias("target")))
        if left.isEmpty():
            break
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits, _upsert(models, "model_id", ids.select(F.col("entity_id").alias("model_id"), F.col("scope").alias("brand_id"), F.col("norm").alias("canonical_name")))


def _external(left: DataFrame, kind: Kind, dim: DataFrame, brand_names: DataFrame, ask: Provider, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of the two outside stages, the dimension after them, and the log of what failed.

    First requests are matched against the known names (models where their brand has any); what an answer does not name is then to be
    identified, and names that no entity has make one. Totals, repeated headers and, for models, names of brands are not asked about.
    """
    scope = ("brand_id",) if kind is MODEL else ()
    asked = left.where(~reports.invalid_name(F.col("value")))
    if kind is MODEL:
        asked = asked.withColumn("_n", normalize_text(F.col("value"))).join(brand_names, "_n", "left_anti").drop("_n")
    asked = cut(asked)
    names = _lookup(dim, kind.key, *scope)
    names = names.withColumnRenamed("brand_id", "scope") if kind is MODEL else names.withColumn("scope", F.lit(kind.name))
    known = asked.join(names.select("scope").distinct(), "scope", "left_semi")
    matched, _ = _answered(known, kind, "match", ask, config.min_confidence)
    first = cut(matched.withColumn("_n", normalize_text(F.col("name"))).join(names, ["scope", "_n"]).select("scope", "value", F.col("_id").alias("entity_id"), F.lit("external_match").alias("stage")))
    named, failed = _answered(asked.join(first, ["scope", "value"], "left_anti"), kind, "identify", ask, config.min_confidence)
    hits, after = _placed_models(named, dim) if kind is MODEL else _placed(named, kind, dim)
    log = failed.select(F.lit(kind.name).alias("entity_type"), "scope", "value", "reason", F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("double").alias("score"))
    return cut(first.unionByName(hits)), after, log


def _uncertain(hits: DataFrame, kind: Column, config: Config) -> DataFrame:
    """Log rows of hits that should be looked over: typos, likeness below the trusted ratio, guards, bare numbers that became models."""
    reason = (
        F.when(F.col("stage") == "typo", F.lit("short value one edit away, likely a typo"))
        .when((F.col("stage") == "fuzzy") & (F.col("score") < config.high_confidence), F.lit("likeness of medium confidence"))
        .when(F.col("stage") == "prefix_variant", F.lit("a known model with or without its brand's name"))
        .when(F.col("stage") == "completion", F.lit("a bare number that one known model completes"))
        .when((F.col("stage") == "created") & (kind == "model") & resolution.is_numeric(F.col("value")), F.lit("a new model of a bare number"))
    )
    return hits.select(kind.alias("entity_type"), "scope", "value", reason.alias("reason"), "entity_id", "score").where("reason is not null")


def _learn(aliases: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The alias table with the normalized values of learned hits; numbered on where its rows are numbered."""
    learned = hits.where(F.col("stage").isin(*LEARNED)).select(F.col("entity_id").alias(key), normalize_text(F.col("value")).alias("alias"))
    fresh = cut(learned.where("alias <> ''").distinct().join(aliases.select(key, "alias"), [key, "alias"], "left_anti"))
    if "alias_id" not in aliases.columns:
        return aliases.unionByName(fresh, allowMissingColumns=True)
    top = aliases.agg(F.max("alias_id")).first()[0] or 0
    return aliases.unionByName(numbered(fresh, [key, "alias"], "alias_id", top + 1).withColumn("alias_id", F.col("alias_id").cast(aliases.schema["alias_id"].dataType)), allowMissingColumns=True)


def enriched(dim: DataFrame, used: DataFrame, key: str, field: str, brand_names: DataFrame, ask: Provider, gate: float) -> DataFrame:
    """The dimension with the missing (null or blank) ``field`` of used entities filled from confident answers; each entity is asked about once."""
    lacking = dim.join(used.distinct(), key, "left_semi").where(F.col(field).isNull() | (F.trim(field) == "")).dropDuplicates([key])
    brand = F.col("brand_id") if "brand_id" in dim.columns else F.lit(None).cast("string")
    requests = lacking.select(F.col(key).alias("value"), brand.alias("scope"), F.col("canonical_name")).join(brand_names, "scope", "left")
    requests = requests.select(F.lit("enrich").alias("phase"), F.lit(field).alias("entity_type"), "scope", F.coalesce("brand_name", F.lit("")).alias("brand_name"), "value", F.col("canonical_name").alias("entity_name"))
    given = provider.answers(requests, ask).where(resolution.confident(F.col("matched"), F.col("confidence"), gate))
    return cut(dimensions.update_fields(dim, given.select(F.col("value").alias(key), F.col("canonical_name").alias(field)), key))


def _named(hits: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Hits with columns of their entities: one row per distinct value, so that report rows are joined once per field."""
    return resolution.text_join(hits, dim.dropDuplicates([key]).select(F.col(key).alias("entity_id"), *[F.col(c).alias(n) for c, n in columns.items()]), ["entity_id"], "left")


def _not_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not blank, with the cleaned text as ``_cleaned``.

    Exploded, as a filter on the column itself would be pushed below a grouping, or over a join, and clean every report row.
    """
    return df.withColumn("_cleaned", F.explode(F.array(clean_token(F.col(column))))).where("_cleaned <> ''")


def resolve_all(
    rows: DataFrame, tables: dict[str, DataFrame], ask: Provider | None = None, enrich: Provider | None = None, config: Config = Config(), learn: bool = True, fields: Sequence[str] = FIELDS, attach: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    """Report rows resolved by the whole cascade, what was found for each distinct value, the log of uncertain hits, and the master data after it.

    Every value goes through exact name, alias, short typo and likeness; what is left is asked of ``ask``, if there is one. Models are
    sought within their brand once brands are settled, number words as digits. Values found by typo, likeness or answer are learned as
    aliases, unless ``learn`` is false (the alias tables are then those that came in). ``enrich`` fills countries and motor types that entities found here lack. Only distinct values are resolved; the report rows
    are read for them and joined once with each field's answers. Only ``fields`` are sought (models need their brands, which are then sought
    too); the resolved rows are without the columns of the others, and without ``attach`` they have ids alone.
    """
    kinds = tuple(k for k in KINDS if k.name in fields or k.name == "brand" and MODEL.name in fields)
    tables = with_alias_tables(tables)
    after = {n: t for n, t in tables.items() if n.startswith("dim_")}
    entry = F.explode(F.array(*[F.struct(F.lit(k.name).alias("scope"), F.col(k.raw).alias("value")) for k in kinds]))
    asked = rows.select("row_id", entry.alias("e")).select("row_id", "e.*").groupBy("scope", "value").agg(F.min("row_id").alias("ord"))
    # blank values are left out once values are distinct, else every report row would be cleaned for it; the cascade writes them, and only requests need them again
    asked = _not_blank(asked if ask is None else cut(asked), "value").drop("_cleaned").withColumn("brand_name", F.lit(""))
    judged = resolution.scored_cascade(asked.select("scope", "value"), *_known(tables, kinds), threshold=config.fuzzy_threshold)
    hits = judged.where("entity_id is not null")
    failures = rows.sparkSession.createDataFrame([], LOG)
    if ask is not None:
        left = cut(asked.join(judged.where("entity_id is null"), ["scope", "value"], "left_semi"))
        for kind in kinds:
            more, after[kind.table], log = _external(left.where(F.col("scope") == kind.name), kind, after[kind.table], None, ask, config)
            hits, failures = hits.unionByName(more.withColumn("score", F.lit(None).cast("double"))), failures.unionByName(log)
        hits = cut(hits)
    for kind in kinds if learn else ():
        after[kind.aliases] = _learn(after[kind.aliases], hits.where(F.col("scope") == kind.name), kind.key)

    few = hits.count() <= SENT_ROWS
    sent = F.broadcast if few else lambda answers: answers
    brand_names = cut(after["dim_brand"].dropDuplicates(["brand_id"]).select(F.col("brand_id").alias("scope"), F.coalesce("canonical_name", F.lit("")).alias("brand_name")))
    model_hits = hits.limit(0)
    if MODEL.name in fields:
        brand_hits = hits.where("scope = 'brand'").select(F.col("value").alias("brand"), F.col("entity_id").alias("scope"))
        brands = brand_names.join(brand_hits, "scope", "left_semi").withColumn("_brand", simple_normalize(F.col("brand_name")))
        # a brand has many spellings, so models are grouped by its id: at once where the brands are sent to the rows, else after a grouping by spelling
        of_brands = rows.select("brand", "model", "row_id") if few else rows.groupBy("brand", "model").agg(F.min("row_id").alias("row_id"))
        pairs = _not_blank(of_brands.join(sent(brand_hits), "brand").groupBy("scope", "model").agg(F.min("row_id").alias("ord")), "model").join(sent(brands), "scope")
        pairs = resolution.with_number_words(pairs, "_cleaned", "_brand", "value").withColumn("_n", normalize_text(F.col("value")))
        # both the cascade and the join back need the value, so it is written with the pairs
        pairs = cut(pairs.select("scope", "model", "value", "_n", *(() if ask is None else ("ord", "brand_name"))))
        found = resolution.scored_cascade(pairs.select("scope", F.col("_n").alias("value")), *_known(tables, (MODEL,)), models=True, threshold=config.fuzzy_threshold, normalized=True)
        found = found.withColumnRenamed("value", "_n")
        model_hits = pairs.select("scope", "value", "_n").distinct().join(found, ["scope", "_n"]).select("scope", "value", "entity_id", "stage", "score")
        if ask is not None:
            wanted = pairs.groupBy("scope", "value").agg(F.min("ord").alias("ord"), F.min("brand_name").alias("brand_name"), F.min("_n").alias("_n"))
            left = cut(wanted.join(found, ["scope", "_n"], "left_anti").drop("_n"))
            spelled = after["dim_brand"].select(normalize_text(F.col("canonical_name")).alias("_n")).unionByName(after["dim_brand_alias"].select(normalize_text(F.col("alias")).alias("_n"))).distinct()
            more, after["dim_model"], log = _external(left, MODEL, after["dim_model"], spelled, ask, config)
            model_hits, failures = model_hits.unionByName(more.withColumn("score", F.lit(None).cast("double"))), failures.unionByName(log)
        if ask is not None or learn:  # used several times
            model_hits = cut(model_hits)
        if learn:
            after["dim_model_alias"] = _learn(after["dim_model_alias"], model_hits, "model_id")

    if enrich is not None:
        used = lambda h, key: h.select(F.col("entity_id").alias(key))
        after["dim_brand"] = enriched(after["dim_brand"], used(hits.where("scope = 'brand'"), "brand_id"), "brand_id", "country", brand_names, enrich, config.min_confidence)
        after["dim_model"] = enriched(after["dim_model"], used(model_hits, "model_id"), "model_id", "motor_type", brand_names, enrich, config.min_confidence)

    attached = ATTACHED if attach else dict.fromkeys(FIELDS, {})
    named = lambda found, kind: _named(found, after[kind.table], kind.key, attached[kind.name]) if attach else found
    full = rows
    for kind in kinds:
        mapped = named(hits.where(F.col("scope") == kind.name), kind)
        mapped = mapped.select(F.col("value").alias(kind.raw), F.col("entity_id").alias(ROW_IDS[kind.name]), *attached[kind.name].values())
        full = full.join(sent(mapped), kind.raw, "left")
        if kind.name == "brand" and MODEL.name in fields:  # models need the brand's id alone, so the rows are shuffled while they are narrow
            by, answers = ("_n", found) if ask is None else ("value", model_hits)
            model_map = resolution.text_join(pairs.select("scope", "model", by), named(answers, MODEL), ["scope", by])
            model_map = model_map.select(F.col("scope").alias("brand_id"), "model", F.col("entity_id").alias("model_id"), *attached[MODEL.name].values())
            full = resolution.text_join(full, model_map, ["brand_id", "model"], "left")
    sought = [k.name for k in kinds] + [MODEL.name] * (MODEL.name in fields)
    resolved = full.select(
        "row_id", F.col("governorate").alias("Governorate"), F.col("license_type").alias("License Type"), F.col("brand").alias("Brand"), F.col("model").alias("Model"),
        F.col("count_value").alias("Count"), F.col("report_year").alias("Year"), F.col("report_month").alias("Month"),
        *[c for n in ("brand", "model", "license_type", "governorate_city") if n in sought for c in (ROW_IDS[n], *attached[n].values())],
    )
    every = hits.select(F.col("scope").alias("entity_type"), F.lit("").alias("scope"), "value", "entity_id", "stage", "score").unionByName(
        model_hits.select(F.lit("model").alias("entity_type"), "scope", "value", "entity_id", "stage", "score")
    )
    log = _uncertain(every, F.col("entity_type"), config).unionByName(failures)
    return resolved, every, log, after


@dataclass
class Outcome:
    """What a run gives; resolved rows are written once when it is built, the rest is lazy over them."""

    resolved: DataFrame
    kept: DataFrame
    review: DataFrame
    missing_metadata: DataFrame
    found: DataFrame
    low_confidence: DataFrame
    dimensions: dict[str, DataFrame]

    def facts(self, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
        """Fact rows numbered from ``first_id``, and the extra attributes of each fact by its id.

        Without a count column or without rows there are none.
        """
        kept = cut(numbered(self.kept, ["row_id"], "Fact_ID", first_id))
        return reports.numbered_facts(kept, F.col("Year"), F.col("Month")), reports.attribute_rows(kept, "Fact_ID", [c for c in kept.columns if c.lower() == "count"])


def run(tables: dict[str, DataFrame], ask: Provider | None = None, enrich: Provider | None = None, config: Config = Config(), learn: bool = True) -> Outcome:
    """All steps over the tables of one data directory; the dimensions are complete before facts are made (their aliases as in ``resolve_all``)."""
    rows = reports.valid_model(tables["report_rows"], "model")
    resolved, found, log, after = resolve_all(rows, tables, ask, enrich, config, learn)
    resolved = cut(resolved)
    kept = reports.essential_ids(resolved)
    kept = reports.count_present(reports.private_only(kept) if config.filter_private else kept)
    return Outcome(
        resolved,
        reports.metadata_complete(kept),
        reports.unmatched_review(resolved, ["Brand", "Model", "License Type", "Governorate"]),
        reports.missing_metadata(kept),
        found,
        log,
        after,
    )
