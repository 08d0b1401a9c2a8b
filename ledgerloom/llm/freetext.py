"""Mapping freely typed values to the closest entry of a reference list.

A partition-based pigeonhole join, in SQL. A reference key of n letters may differ by k(n) edits. It is
cut into k+1 segments; a text within k edits must hold at least one segment unchanged, near its place.
So the typed keys are probed by the substrings at the few positions where a segment may lie, with an
equality join on (scope, length, segment number, substring); the pairs that meet are verified with
``levenshtein``. Only lengths that the scope's entries have are probed. Keys are first sought within two edits, where
segments are long and few; only what no entry is so near to is sought with the whole number of edits. What meets
nothing, or fits two entries equally well, is found by an anti-join and reported.

Values are resolved once for each distinct value, never for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_token
from ledgerloom.llm import names
from ledgerloom.session import cut

#: Edits allowed for a reference key of at least so many letters; names of several words may hold several slips.
EDITS = ((5, 2), (4, 1))
MODEL_EDITS = ((11, 4), (9, 3), (5, 2), (4, 1))
RECORD_EDITS = ((11, 3), (5, 2), (4, 1))
#: Edits within which keys are sought first.
NEAR = 2

NONE = "none"


def _allowed(n: str, most: int) -> str:
    model, record, other = (" ".join(f"when {n} >= {least} then {min(k, most)}" for least, k in edits) for edits in (MODEL_EDITS, RECORD_EDITS, EDITS))
    return f"case when scope like 'model|%' then case {model} else 0 end when scope like 'record|%' then case {record} else 0 end else case {other} else 0 end end"


def _segment_start(n: str, k: str, i: str) -> str:
    return f"({i} * ({n} div ({k} + 1)) + greatest(0, {i} - ({k} + 1 - {n} % ({k} + 1))) + 1)"


def _segment_length(n: str, k: str, i: str) -> str:
    return f"({n} div ({k} + 1) + case when {i} >= {k} + 1 - {n} % ({k} + 1) then 1 else 0 end)"


_MOST = max(k for _, k in EDITS + MODEL_EDITS + RECORD_EDITS)


def _verified(typed: str, refs: str, most: int) -> str:
    """Common table expressions; ``verified`` has the pairs of typed and reference keys within the allowed edits, of which there are ``most`` at most."""
    return f"""
cut_refs as (
  select *, {_allowed('n', most)} as k from (select distinct scope, entity_id, key, trim, length(key) as n from {refs} where key <> '')),
lengths as (select distinct scope, n, k from cut_refs where k > 0),
pieces as (
  select scope, entity_id, key, trim, n, i, k, substring(key, {_segment_start('n', 'k', 'i')}, {_segment_length('n', 'k', 'i')}) as piece
  from (select *, explode(sequence(0, k)) as i from cut_refs where k > 0)),
placed as (
  select t.scope, t.key, t.trims, length(t.key) as m, l.n, l.k, explode(sequence(0, l.k)) as i
  from {typed} t join lengths l on t.scope = l.scope and length(t.key) between l.n - l.k and l.n + l.k where t.key <> ''),
probes as (
  select scope, key, trims, n, i, substring(key, p, l) as piece
  from (
    select *, explode(case when first <= final then sequence(first, final) else array() end) as p
    from (
      select *, greatest(1, s - i, s + (m - n) - (k - i)) as first, least(m - l + 1, s + i, s + (m - n) + (k - i)) as final
      from (select *, {_segment_start('n', 'k', 'i')} as s, {_segment_length('n', 'k', 'i')} as l from placed)))),
verified as (
  select b.scope, b.key, b.trims, p.entity_id, p.key as ref_key, levenshtein(b.key, p.key, p.k) as d
  from probes b join pieces p on b.scope = p.scope and b.n = p.n and b.i = p.i and b.piece = p.piece
  where levenshtein(b.key, p.key, p.k) between 0 and p.k
    and (array_contains(b.trims, p.trim) or p.trim = '' and array_contains(b.trims, '~') and levenshtein(b.key, p.key, 2) between 0 and 2))
"""


_EXACT = """
select t.scope, t.key, t.trims, min(r.entity_id) as low, max(r.entity_id) as high
from {typed} t join {refs} r on t.scope = r.scope and t.key = r.key and (array_contains(t.trims, r.trim) or r.trim = '' and array_contains(t.trims, '~'))
group by t.scope, t.key, t.trims
"""

_CLOSEST = """
with @verified,
ranked as (
  select scope, key, trims, d, min(entity_id) as low, max(entity_id) as high from verified group by scope, key, trims, d),
nearest as (
  select scope, key, trims, min(struct(d, low, high)) as best from ranked group by scope, key, trims)
select scope, key, trims, best.low as low, best.high as high from nearest
"""

_NEAR = f"with {_verified('{typed}', '{refs}', _MOST)} select distinct scope, key, ref_key, d from verified where key < ref_key"


def closest(typed: DataFrame, refs: DataFrame) -> DataFrame:
    """The one closest entry of each typed key: ``scope, key, trims, entity_id``; keys without one are not in the result.

    ``typed(scope, key, trims)`` holds distinct keys, ``refs(scope, entity_id, key, trim)`` the entries under
    all their known keys. Only keys of one scope meet, and only where the entry's trim is among ``trims`` (or, with '~' among them, where an
    entry without a trim is within two edits).
    An equal key comes before any other. Several entries at the least distance give no row. Keys of
    fewer than four letters only match exactly. Null scopes and keys match nothing.
    """
    spark, refs = typed.sparkSession, cut(refs)
    left, on, found = cut(typed), ["scope", "key", "trims"], []
    for most in (0, NEAR, _MOST):
        sql = _CLOSEST.replace("@verified", _verified("{typed}", "{refs}", most)) if most else _EXACT
        met = cut(spark.sql(sql, typed=left, refs=refs))
        found.append(met.where("low = high").select(*on, F.col("low").alias("entity_id")))
        if most < _MOST:
            left = cut(left.join(met, on, "left_anti"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def near_keys(keys: DataFrame) -> DataFrame:
    """All pairs of different keys of one scope within the allowed edits: ``scope, key, ref_key, d``; ``keys(scope, key)``."""
    kept = cut(keys.where("key <> ''").distinct())
    plain = F.lit("")
    return keys.sparkSession.sql(_NEAR, typed=kept.withColumn("trims", F.array(plain)), refs=kept.select("scope", F.col("key").alias("entity_id"), "key", plain.alias("trim")))


def _blank(x: Column) -> Column:
    return clean_token(x) == ""


def _distinct_keys(parts: Column) -> Column:
    return F.explode(F.array_distinct(F.filter(parts, lambda k: k.isNotNull() & (k != ""))))


def brand_refs(brands: DataFrame, aliases: DataFrame) -> DataFrame:
    """All known keys of each brand: canonical and normalized names, aliases and their Arabic writing."""
    spelled = (
        brands.select("brand_id", F.explode(F.array("canonical_name", "normalized_name")).alias("name"))
        .unionByName(aliases.select("brand_id", F.col("alias").alias("name")))
        .where("brand_id is not null and name is not null")
        .withColumn("key", names.brand_key(F.col("name")))
    )
    keys = spelled.select("brand_id", _distinct_keys(F.array("key", names.sound_key(F.col("key")))).alias("key")).distinct()
    return keys.select(F.lit("brand").alias("scope"), F.col("brand_id").alias("entity_id"), "key", F.lit("").alias("trim"))


def place_refs(places: DataFrame, aliases: DataFrame) -> DataFrame:
    spelled = (
        places.select("governorate_id", F.explode(F.array("canonical_name", "normalized_name")).alias("name"))
        .unionByName(aliases.select("governorate_id", F.col("alias").alias("name")))
        .where("governorate_id is not null and name is not null")
        .withColumn("key", names.place_key(F.col("name")))
    )
    keys = spelled.select("governorate_id", _distinct_keys(F.array("key", names.sound_key(F.col("key")))).alias("key")).distinct()
    return keys.select(F.lit("governorate").alias("scope"), F.col("governorate_id").alias("entity_id"), "key", F.lit("").alias("trim"))


def _brand_names(brands: DataFrame, aliases: DataFrame) -> DataFrame:
    """The keys of a brand that may stand before its models' names: ``_names_of, brand_keys``; a brand has a handful."""
    refs = brand_refs(brands, aliases)
    return refs.groupBy(F.col("entity_id").alias("_names_of")).agg(names.brand_keys(F.collect_set("key")).alias("brand_keys"))


def _model_scope() -> Column:
    return F.concat_ws("|", F.lit("model"), F.col("brand_id"), F.col("numbers"))


def model_refs(models: DataFrame, brand_names: DataFrame) -> DataFrame:
    """Keys of each model within its brand and its numbers; the normalized name counts where the canonical one is missing."""
    named = models.where("model_id is not null and brand_id is not null").select("brand_id", "model_id", F.coalesce("canonical_name", "normalized_name").alias("name"))
    known = named.join(brand_names, named.brand_id == brand_names["_names_of"], "left")
    return names.with_trim(names.with_model_parts(known, "name", "brand_keys")).select(_model_scope().alias("scope"), F.col("model_id").alias("entity_id"), "key", "trim").distinct()


def _reported(keyed: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """``columns..., entity_id`` of the keyed values: those that met an entry, and by anti-join those that stand for none."""
    on, met = ["scope", "key", "trims"], cut(found)
    matched = keyed.join(met, on).select(*columns, "entity_id")
    return cut(matched.unionByName(keyed.join(met, on, "left_anti").select(*columns, F.lit(NONE).alias("entity_id"))))


def resolve_rows(rows: DataFrame, brands: DataFrame, brand_aliases: DataFrame, models: DataFrame, places: DataFrame, place_aliases: DataFrame) -> DataFrame:
    """Typed values of ``brand``, ``governorate`` and ``model`` that are no canonical names: ``row_id, field_name, entity_id``.

    Null, blank and nan values give no case, nor do values that are letter for letter a canonical name of
    their list (for a model, of the row's brand); models of rows whose brand stands for no entry give none.
    ``entity_id`` is ``none`` where no entry or several fit. Repeated rows each give their cases; columns
    of ``rows`` beyond those named are ignored. Texts of any length are compared whole.
    """
    rows = rows.select("row_id", "brand", "governorate", "model")
    odd_values, exact = [], {}
    for field, column, entries, id_column in (("brand", "brand", brands, "brand_id"), ("governorate", "governorate", places, "governorate_id")):
        typed = rows.where(~_blank(F.col(column))).select(F.lit(field).alias("scope"), F.col(column).alias("value")).distinct()
        canonical = entries.where("canonical_name is not null").groupBy(F.col("canonical_name").alias("value")).agg(F.min(id_column).alias("_low"), F.max(id_column).alias("_high"))
        exact[field] = canonical.select("value", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("entity_id"), F.lit(False).alias("odd"))
        key = names.brand_key(F.col("value")) if field == "brand" else names.place_key(F.col("value"))
        odd_values.append(typed.join(canonical, "value", "left_anti").select("scope", "value", key.alias("key"), F.array(F.lit("")).alias("trims")))
    keyed_values = cut(odd_values[0].unionByName(odd_values[1]))
    refs = brand_refs(brands, brand_aliases).unionByName(place_refs(places, place_aliases))
    found_values = closest(keyed_values.select("scope", "key", "trims").distinct(), refs)
    resolved = _reported(keyed_values, found_values, ["scope", "value"])

    odd_brands = resolved.where("scope = 'brand'").select("value", "entity_id", F.lit(True).alias("odd"))
    branded = rows.select("row_id", F.col("brand").alias("value"), "model").join(exact["brand"].unionByName(odd_brands), "value")
    brand_cases = branded.where("odd").select("row_id", F.lit("brand").alias("field_name"), "entity_id")
    place_cases = (
        rows.select("row_id", F.col("governorate").alias("value")).join(resolved.where("scope = 'governorate'"), "value").select("row_id", F.lit("governorate").alias("field_name"), "entity_id")
    )

    with_model = branded.where((F.col("entity_id") != NONE) & ~_blank(F.col("model"))).select("row_id", F.col("entity_id").alias("brand_id"), F.col("model").alias("value"))
    pairs = with_model.select("brand_id", "value").distinct()
    canonical_models = models.where("canonical_name is not null").select("brand_id", F.col("canonical_name").alias("value")).distinct()
    odd_models = pairs.join(canonical_models, ["brand_id", "value"], "left_anti")
    brand_names = cut(_brand_names(brands, brand_aliases))
    known = odd_models.join(brand_names, F.col("brand_id") == F.col("_names_of"), "left")
    keyed = cut(names.with_typed_trims(names.with_model_parts(known, "value", "brand_keys")).select("brand_id", "value", _model_scope().alias("scope"), "key", "trims", "numbers"))
    found = closest(keyed.where("key <> '' or numbers <> ''").select("scope", "key", "trims").distinct(), model_refs(models, brand_names))
    model_map = _reported(keyed, found, ["brand_id", "value"])
    model_cases = with_model.join(model_map, ["brand_id", "value"]).select("row_id", F.lit("model").alias("field_name"), "entity_id")
    return brand_cases.unionByName(place_cases).unionByName(model_cases)
