"""Structured data (JSON-LD) of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.lookup import any_of

SCRIPT = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """Well-formed JSON-LD scripts in page order."""
    blocks = F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))
    rows = pages.select("page_id", F.posexplode(blocks).alias("block", "json"))
    return rows.withColumn("json", F.trim("json")).filter(F.try_parse_json("json").isNotNull())


def _members(json_array: Column) -> Column:
    """Members of a JSON array, each as JSON text; NULL when it is not an array."""
    return F.transform(F.from_json(json_array, "ARRAY<VARIANT>"), lambda v: F.to_json(v))


def _graph(json: Column) -> Column:
    return F.get_json_object(json, "$['@graph']")


def jsonld_objects(blocks: DataFrame, levels: int = 3) -> DataFrame:
    """One row per object: members of arrays and of ``@graph`` are taken out of their holders."""
    rows = blocks.select("page_id", "block", F.array().cast("array<int>").alias("path"), "json")
    for _ in range(levels):
        inner = _members(F.coalesce(_graph(F.col("json")), F.when(F.col("json").startswith("["), F.col("json"))))
        rows = rows.select("page_id", "block", "path", F.posexplode(F.coalesce(inner, F.array("json"))).alias("at", "json"))
        rows = rows.select("page_id", "block", F.concat("path", F.array("at")).alias("path"), "json")
    return rows


def is_product(json: Column, exact: bool = False) -> Column:
    """The type, or one of the types, is Product (or ends in /Product unless ``exact``)."""
    kind = F.get_json_object(json, "$.@type")
    pattern = r'(^|")Product("|$)' if exact else r'(^|"|/)Product("|$)'
    return F.coalesce(kind.rlike(pattern), F.lit(False))


def products(pages: DataFrame) -> DataFrame:
    """First Product of a page that carries a field: a script's own object, or a member of its ``@graph``."""
    rows = jsonld_blocks(pages).select("page_id", "block", F.posexplode(F.concat(
        F.array("json"), F.coalesce(_members(_graph(F.col("json"))), F.array().cast("array<string>")))).alias("pos", "json"))
    carries = any_of(c.isNotNull() for c in field_columns().values())
    found = rows.filter(is_product(F.col("json")) & carries)
    return found.groupBy("page_id").agg(F.min_by("json", F.struct("block", "pos")).alias("json"))


def _text(json: Column, path: str) -> Column:
    return F.nullif(F.get_json_object(json, path), F.lit(""))


def _first_or_only(json: Column, field: str, key: str) -> Column:
    return F.coalesce(_text(json, f"$.{field}[0].{key}"), _text(json, f"$.{field}.{key}"))


def _leading(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), N.LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def normalize_availability(value: Column) -> Column:
    """Schema word for stock, else the last part of the value."""
    low = F.lower(value)
    last = F.element_at(F.split(value, "/"), -1)
    return (F.when(low.contains("instock") | low.contains("in_stock"), "InStock")
            .when(low.contains("outofstock") | low.contains("out_of_stock"), "OutOfStock")
            .when(low.contains("preorder"), "PreOrder").when(low.contains("backorder"), "BackOrder")
            .when(low.contains("limited"), "LimitedAvailability")
            .when(low.contains("soldout") | low.contains("sold_out"), "SoldOut")
            .otherwise(F.coalesce(F.nullif(last, F.lit("")), value)))


def field_columns() -> dict[str, Column]:
    j = F.col("json")
    brand, image, first_image = _text(j, "$.brand"), _text(j, "$.image"), _text(j, "$.image[0]")
    return {
        "name": _text(j, "$.name"),
        "price": _leading(_first_or_only(j, "offers", "price")),
        "currency": _first_or_only(j, "offers", "priceCurrency"),
        "availability": normalize_availability(_first_or_only(j, "offers", "availability")),
        "rating": _leading(_text(j, "$.aggregateRating.ratingValue")),
        "review_count": F.floor(_leading(F.coalesce(_text(j, "$.aggregateRating.reviewCount"),
                                                    _text(j, "$.aggregateRating.ratingCount")))).cast("bigint"),
        "brand": F.when(brand.startswith("{"), _text(j, "$.brand.name")).otherwise(brand),
        "sku": _text(j, "$.sku"),
        "image": F.coalesce(F.when(~image.startswith("[") & ~image.startswith("{"), image),
                            F.when(~first_image.startswith("{"), first_image),
                            _text(j, "$.image[0].url"), _text(j, "$.image.url")),
    }


def product_fields(product_rows: DataFrame) -> DataFrame:
    """``(page_id, json)`` to name, price, currency, availability, rating, reviews, brand, sku, image."""
    return product_rows.select("page_id", *[c.alias(n) for n, c in field_columns().items()])


def schema_price(pages: DataFrame) -> DataFrame:
    """Second reading: first object whose type is exactly Product, price or lowPrice, any number in the text."""
    found = jsonld_objects(jsonld_blocks(pages)).filter(is_product(F.col("json"), exact=True))
    rows = found.groupBy("page_id").agg(F.min_by("json", F.struct("block", "path")).alias("json"))
    j = F.col("json")
    price = F.coalesce(_first_or_only(j, "offers", "price"), _first_or_only(j, "offers", "lowPrice"))
    return rows.select("page_id", N.first_price(price).alias("price"),
                       _first_or_only(j, "offers", "priceCurrency").alias("currency"))
