"""The three-layer facet filter as one predicate.  A null list means no filter; an empty one matches nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIONAL = "国家法律"  # fixed value


def facet_predicate(file_type: Column, region: Column, city: Column, types: Column, provinces: Column, cities: Column) -> Column:
    """Null facets count as ''.

    Types restrict all rows.  Once a province or city is given, national rows stay, rows of a city need that city
    (provinces do not matter to them), and the others need their region among the provinces.
    """
    kind, place, town = (F.coalesce(c, F.lit("")) for c in (file_type, region, city))
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    among = lambda x, c: F.coalesce(F.array_contains(c, x), F.lit(False))
    by_type = F.when(types.isNull(), True).otherwise(among(kind, types))
    by_place = F.when(~has(provinces) & ~has(cities), True).when(kind == NATIONAL, True).when(town != "", among(town, cities)).otherwise(among(place, provinces))
    return by_type & by_place


def literal_list(values: list[str] | None) -> Column:
    return F.lit(None).cast("array<string>") if values is None else F.array(*map(F.lit, values)).cast("array<string>")


def facet_filter(corpus: DataFrame, types: list[str] | None = None, provinces: list[str] | None = None, cities: list[str] | None = None) -> DataFrame:
    """Rows of the corpus that one set of facets lets through; pushed into the scan by Catalyst where it can be."""
    return corpus.filter(facet_predicate(F.col("file_type"), F.col("region"), F.col("city"), *map(literal_list, (types, provinces, cities))))


def facet_candidates(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) for queries with their own lists file_types, provinces, cities.

    Queries of equal facets share one pass: distinct facets are few and bounded by the callers' choices, and the corpus
    is read once for all of them.
    """
    keys = ["file_types", "provinces", "cities"]
    # JSON tells a null list (left out) from an empty one; hashes of both are equal
    distinct = queries.select(*keys).distinct().withColumn("_facet", F.to_json(F.struct(*keys)))
    rows = corpus.select("id", "file_type", "region", "city")
    ok = facet_predicate(F.col("file_type"), F.col("region"), F.col("city"), *[F.col(k) for k in keys])
    matched = rows.join(distinct, ok).select("id", "_facet")
    return queries.withColumn("_facet", F.to_json(F.struct(*keys))).select("query_id", "_facet").join(matched, "_facet").select("query_id", "id")
