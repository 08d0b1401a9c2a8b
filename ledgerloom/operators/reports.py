"""Steps over report rows: projections, filters, logs and fact rows. All of them are lazy and shuffle only where said."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_token, normalize_text
from ledgerloom.operators.sequences import numbered

PRIVATE_NAMES = ("private", "ملاكي")
RAW_AND_ID_COLUMNS = ("brand_id", "model_id", "license_type_id", "governorate_id", "Brand", "Model", "License Type", "Governorate")
ID_COLUMNS = ("brand_id", "model_id", "license_type_id", "governorate_id")
FACT_NAMES = {"brand_id": "Brand_ID", "model_id": "Model_ID", "license_type_id": "LicenseType_ID", "governorate_id": "Governorate_ID"}
INVALID_NAMES = ("total", "grand total", "subtotal", "sub total", "اجمالي", "الاجمالي", "الإجمالي", "اجمالي عام", "brand", "model", "governorate", "license type")


def positional_project(
    df: DataFrame, targets: Sequence[int | str], headers: Sequence[str], extras: Sequence[int | str] = (), extra_headers: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Columns by 0-based place or name, renamed; extras keep their names unless as many headers are given; ``keep`` follows."""
    place = lambda c: df.columns[c] if isinstance(c, int) else c
    named = list(zip([place(c) for c in targets], headers, strict=True))
    extra = [place(c) for c in extras]
    named += list(zip(extra, extra_headers if len(extra_headers) == len(extra) else extra, strict=True))
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in named], *[F.col(f"`{c}`") for c in keep])


def with_report_date(df: DataFrame, day: date) -> DataFrame:
    d = F.lit(day).cast("date")
    return df.withColumns({"Reporting_Date": d, "Year": F.year(d), "Month": F.month(d)})


def reorder_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in columns], *[c for c in columns if c in df.columns])


def filtered_projection(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in RAW_AND_ID_COLUMNS if c in df.columns])


def valid_model(df: DataFrame, column: str) -> DataFrame:
    return df.where(clean_token(F.col(column)) != "")


def essential_ids(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.dropna(subset=present) if present else df


def private_only(df: DataFrame, column: str = "license_type_canonical_name") -> DataFrame:
    return df.where(F.lower(column).isin(*PRIVATE_NAMES)) if column in df.columns else df


def count_present(df: DataFrame) -> DataFrame:
    found = next((c for c in df.columns if c.lower() == "count"), None)
    return df.dropna(subset=[found]) if found else df


def metadata_complete(df: DataFrame, columns: Sequence[str] = ("model_motor_type", "brand_country")) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def unmatched_review(df: DataFrame, columns: Sequence[str], reason: str = "Unmatched brand or model") -> DataFrame:
    """Distinct raw values of rows without a brand or model."""
    return df.where(F.col("brand_id").isNull() | F.col("model_id").isNull()).select(*columns, F.lit(reason).alias("Reason")).dropDuplicates()


def missing_metadata(df: DataFrame) -> DataFrame:
    """Distinct (brand, model, missing attribute) of rows that lack one; one scan, both attributes from one explode."""
    gaps = F.array(F.when(F.col("brand_country").isNull(), F.lit("brand_country")), F.when(F.col("model_motor_type").isNull(), F.lit("model_motor_type")))
    return (
        df.select(F.col("brand_canonical_name").alias("brand"), F.col("model_canonical_name").alias("model"), F.explode(gaps).alias("missing")).where("missing is not null").dropDuplicates()
    )


def invalid_name(x: Column) -> Column:
    """Totals and repeated header lines."""
    return normalize_text(x).isin(*INVALID_NAMES)


def log_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both logs, each distinct record once; columns of one log only are null in the other's rows."""
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def fill_down(df: DataFrame, column: str, block: Sequence[str], order: str) -> DataFrame:
    """Blank cells below a merged cell take the last value above them within their block (a sheet)."""
    above = Window.partitionBy(*block).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(column, F.last(F.when(F.trim(column) != "", F.col(column)), ignorenulls=True).over(above))


def numbered_facts(df: DataFrame, year: Column, month: Column) -> DataFrame:
    """Fact rows of rows that have a ``Fact_ID``; ids of absent columns are null, the date is the first of the month.

    Without a count column there are no facts.
    """
    count = next((c for c in df.columns if c.lower() == "count"), None)
    ids = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(n) for c, n in FACT_NAMES.items()]
    amount = F.col(count) if count else F.lit(None).cast("double")
    facts = df.select("Fact_ID", *ids, amount.alias("Vehicle_Count"), F.make_date(year, month, F.lit(1)).alias("Reporting_Date"))
    return facts if count else facts.limit(0)


def fact_rows(df: DataFrame, year: Column, month: Column, order: Sequence[str], first_id: int = 1) -> DataFrame:
    """Fact rows numbered in order from ``first_id``."""
    return numbered_facts(numbered(df, order, "Fact_ID", first_id), year, month)


def attribute_rows(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per non-null attribute: key, Attribute_Name, Attribute_Value (whole doubles without a point)."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        if types[c] in ("double", "float"):
            return F.when(~F.isnan(x), F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string")))
        return x.cast("string")

    entries = [F.struct(F.lit(c).alias("Attribute_Name"), text(c).alias("Attribute_Value")) for c in columns]
    return df.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*").where("Attribute_Value is not null")
