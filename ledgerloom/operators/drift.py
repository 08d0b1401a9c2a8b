"""Files whose fields drift: one consistent table and a report of every change.

The footers (headers and value types) of all files are exploded into a catalogue. An alias table maps
headers to fields. Within a producer (feed), the files form a sequence; for each field, header and type, lag
over that sequence gives the islands of presence, its lifespans. Their starts and endings are the changes: a start and
an ending of one header at the same file are a change of its type, of two headers of one field a renaming. The alias table also generates
the casts that bring every spelling and type of a field into one column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut

PLACEHOLDERS = ("", "nan", "n/a", "na", "null", "none", "-", "--", "?", "??", "???", "unknown", "tbd")


@dataclass(frozen=True)
class Field:
    """A field of the consistent table: its name, its type there, and all headers it is known under."""

    name: str
    kind: str  # text, number or coded (text, or a number or object that stands for it)
    headers: tuple[str, ...]


#: Known headers of the report fields.
REPORT_FIELDS = (
    Field("governorate", "text", ("Governorate", "Governorate/City", "المحافظة")),
    Field("license_type", "coded", ("License Type", "Licence Type", "LicenseType", "license type", "License_Category", "LIC_TYPE", "Plate Class", "نوع الترخيص")),
    Field("brand", "text", ("Brand", "Make", "الماركة")),
    Field("model", "text", ("Model", "الطراز")),
    Field("count_value", "number", ("Count", "COUNT", "count", "Units", "Qty", "Quantity", "Vehicles", "Vehicle_Count", "Total Count", "No. of Vehicles", "العدد")),
)


def _plain(header: Column) -> Column:
    return F.regexp_replace(F.lower(header), r"[^\p{L}\p{N}]+", "")


def field_of(header: Column, fields: Sequence[Field]) -> Column:
    """The field a header stands for: by the alias table, case and punctuation aside, else the header's own plain form."""
    plain = _plain(header)
    known = F.lit(None).cast("string")
    for f in fields:
        spellings = sorted({_spelling(h) for h in f.headers})
        known = F.when(plain.isin(*spellings), F.lit(f.name)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit("other:"), F.when(plain == "", header).otherwise(plain)))


def _spelling(header: str) -> str:
    return "".join(c for c in header.lower() if c.isalnum())


def _json_kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "VOID", F.lit(None).cast("string"))
        .when(shape == "STRING", F.lit("string"))
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .when(shape.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), F.lit("integer"))
        .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit("decimal"))
        .otherwise(F.lit("integer"))
    )


def footers(lines: DataFrame, fields: Sequence[Field] = REPORT_FIELDS) -> DataFrame:
    """The catalogue of footers: one row per file and header, with the JSON type of most of its non-null values.

    Input columns: ``file_id, feed_name, file_month, record_text``. Unreadable lines and lines that are no
    JSON object add nothing; a file without readable lines keeps one row with a null header. A header
    without any non-null value has a null type; ties go to the type first in the alphabet. Repeated lines
    count as often as they occur.
    """
    file = ["file_id", "feed_name", "file_month"]
    parsed = lines.select(*file, F.try_parse_json("record_text").alias("_v"))
    parsed = parsed.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))
    spark = lines.sparkSession
    entries = parsed.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
    counted = entries.select(*file, F.col("key").alias("header"), _json_kind(F.col("value")).alias("kind")).groupBy(*file, "header", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.col("n"), (-F.ascii("kind")).alias("o"), F.col("kind"))))["kind"]
    files = counted.groupBy(*file, "header").agg(best.alias("kind"))
    return cut(files.withColumn("field", F.when(F.col("header").isNotNull(), field_of(F.col("header"), fields))))


def _ordered(catalogue: DataFrame) -> DataFrame:
    """Adds ``ord``, the place of the file in its feed (dense over month, then file id), and ``last``."""
    within = Window.partitionBy("feed_name").orderBy(F.col("file_month").asc_nulls_first(), F.col("file_id").asc_nulls_first())
    placed = catalogue.withColumn("ord", F.dense_rank().over(within))
    return placed.withColumn("last", F.max("ord").over(Window.partitionBy("feed_name")))


def _islands(catalogue: DataFrame) -> DataFrame:
    placed = _ordered(catalogue).where(F.col("header").isNotNull())
    run = Window.partitionBy("feed_name", "field", "header").orderBy("ord")
    new = (F.lag("ord").over(run).isNull() | (F.lag("ord").over(run) < F.col("ord") - 1) | ~F.lag("kind").over(run).eqNullSafe(F.col("kind"))).cast("int")
    numbered = placed.withColumn("_new", new).withColumn("island", F.sum("_new").over(run))
    return numbered.groupBy("feed_name", "field", "header", "island").agg(
        F.max("kind").alias("kind"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.min_by("file_id", "ord").alias("first_file"),
        F.max_by("file_id", "ord").alias("last_file"),
        F.max("last").alias("last"),
    )


def lifespans(catalogue: DataFrame) -> DataFrame:
    """Islands of presence: ``feed_name, field, header, kind, first_ord, last_ord, first_file, last_file``, one for each unbroken run of one header with one type."""
    return _islands(catalogue).drop("last")


def changes(catalogue: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its feed: ``file_id, change_kind, header``.

    Starts and endings of lifespans fall together by field. Where a lifespan of one header ends and another of it starts, its type has changed (if
    both types are known). Of the other headers, one that ends and one that starts are a renaming, and a change of type as well if both
    types are known and differ; several at once are paired in the order of their
    names and the rest are added or removed. A feed's first file has no changes. Null
    feed names form one feed; null months come first.
    """
    spans = cut(_islands(catalogue))
    files = _ordered(catalogue).select("feed_name", "ord", "file_id").distinct()
    here, none = F.struct("header", "kind"), F.lit(None).cast("struct<header:string,kind:string>")
    starts = spans.where("first_ord > 1").select("feed_name", F.col("first_ord").alias("ord"), "field", here.alias("new"), none.alias("old"))
    ends = spans.where("last_ord < last").select("feed_name", (F.col("last_ord") + 1).alias("ord"), "field", none.alias("new"), here.alias("old"))
    # a field has a handful of headers in one file, so these lists are tiny
    met = starts.unionByName(ends).groupBy("feed_name", "ord", "field").agg(F.array_sort(F.collect_list("new")).alias("new"), F.array_sort(F.collect_list("old")).alias("old"))
    goes_on = lambda x, others: F.exists(others, lambda o: o["header"] == x["header"])
    retyped = F.filter("new", lambda n: F.exists("old", lambda o: (o["header"] == n["header"]) & (o["kind"] != n["kind"])))
    met = met.select(
        "feed_name", "ord", retyped.alias("retyped"),
        F.arrays_zip(F.filter("new", lambda n: ~goes_on(n, F.col("old"))).alias("new"), F.filter("old", lambda o: ~goes_on(o, F.col("new"))).alias("old")).alias("pairs"),
    )
    change = lambda kind, header: F.struct(F.lit(kind).alias("change_kind"), header.alias("header"))

    def of_pair(p: Column) -> Column:
        renamed = p["new"].isNotNull() & p["old"].isNotNull()
        return F.array(
            F.when(renamed, change("renamed", p["new"]["header"])),
            F.when(renamed & (p["new"]["kind"] != p["old"]["kind"]), change("type_changed", p["new"]["header"])),
            F.when(p["old"].isNull(), change("added", p["new"]["header"])),
            F.when(p["new"].isNull(), change("removed", p["old"]["header"])),
        )

    every = F.concat(F.transform("retyped", lambda n: change("type_changed", n["header"])), F.filter(F.flatten(F.transform("pairs", of_pair)), lambda k: k.isNotNull()))
    found = met.select(F.col("feed_name").alias("_feed"), F.col("ord").alias("_ord"), F.inline(every))
    return found.join(files, F.col("_feed").eqNullSafe(F.col("feed_name")) & (F.col("_ord") == F.col("ord"))).select("file_id", "change_kind", "header")


def _path(header: str) -> str:
    return '$["' + header.replace('"', "") + '"]'


def _clean(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(~F.lower(trimmed).isin(*PLACEHOLDERS), trimmed)


def _entries() -> Column:
    """Headers and values of the parsed line ``_v``, in the order of the headers."""
    return F.map_entries(F.col("_v").cast("map<string,variant>"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def casts(fields: Sequence[Field], codes: dict[int, str]) -> dict[str, Column]:
    """Column expressions over the parsed line ``_v``, generated from the alias table; the first header with a value wins.

    Headers go in the order of the alias table; then come those that are the field's by ``field_of`` alone, case and punctuation aside.
    """
    out = {}
    names = F.create_map(*[x for code, name in sorted(codes.items()) for x in (F.lit(str(code)), F.lit(name))]) if codes else None

    def read(kind: str, value: Column, path: str) -> list[Column]:
        plain = _clean(F.try_variant_get(value, path, "string"))
        if kind != "coded":
            return [plain]
        # an object's own text form is never the value
        plain = F.when(~plain.startswith("{"), plain)
        return [_clean(F.try_variant_get(value, path + ".name", "string")), F.coalesce(F.try_element_at(names, F.regexp_replace(plain, r"\.0+$", "")), plain) if names is not None else plain]

    def unlisted(f: Field) -> Column:
        found = F.filter(_entries(), lambda e: (field_of(e["key"], fields) == f.name) & ~e["key"].isin(*f.headers))
        return _first(F.transform(found, lambda e: F.coalesce(*read(f.kind, e["value"], "$"))))

    for f in fields:
        options = [x for header in f.headers for x in read(f.kind, F.col("_v"), _path(header))]
        options.append(unlisted(f))
        value = F.coalesce(*options)
        out[f.name] = value.try_cast("double") if f.kind == "number" else value
    return out


def others(fields: Sequence[Field]) -> Column:
    """The fields of the parsed line ``_v`` outside the alias table as a map from ``field_of`` without its mark to the value's text."""
    name = lambda e: F.regexp_replace(field_of(e["key"], fields), "^other:", "")
    entries = F.filter(_entries(), lambda e: field_of(e["key"], fields).startswith("other:"))
    named = F.transform(entries, lambda e: F.struct(name(e).alias("k"), _clean(F.try_variant_get(e["value"], "$", "string")).alias("x")))
    keys = F.array_distinct(F.transform(named, lambda n: n["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _first(F.transform(F.filter(named, lambda n: n["k"] == k), lambda n: n["x"]))))


def consistent_table(lines: DataFrame, fields: Sequence[Field] = REPORT_FIELDS, codes: dict[int, str] | None = None) -> DataFrame:
    """All readable lines of all files in one set of columns, lines sent twice kept once.

    Columns: ``file_id, feed_name, file_month, line_no``, one per field, ``others`` (the fields outside the alias table,
    a map from the field's plain name to its text) and ``extras`` (the raw line as it came). Placeholder words and
    blanks become null; numbers written as text are read; a number that cannot be read is null. ``codes``
    maps the numbers that stand for a coded field's entries to their names.
    """
    parsed = lines.select("file_id", "feed_name", "file_month", "line_no", "record_text", F.try_parse_json("record_text").alias("_v"))
    readable = parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))
    chosen = readable.select("file_id", "feed_name", "file_month", "line_no", *[c.alias(name) for name, c in casts(fields, codes or {}).items()], others(fields).alias("others"), F.col("record_text").alias("extras"))
    return chosen.dropDuplicates(["file_id", "line_no", "extras"])
