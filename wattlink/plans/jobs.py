"""The end-to-end jobs: registry, geocoding, imports and the association preview."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlink import constants as K
from wattlink.operators import association as A, geocode, hull, imports, registry, standardize
from wattlink.session import stored
from wattlink.sources import tables


def registry_from_pages(pages: DataFrame, sources: list[dict], details: DataFrame | None = None,
                        lookup: dict | None = None, now: str | None = None) -> DataFrame:
    """Registry rows of all sources, newest per key. `list_only` sources are read from their
    pages, the others from the detail document of each listed id.

    One pass over the pages of all sources counts their items and finds each source's first gap, one
    row per source; a second one extracts the items ahead of it.
    """
    gaps = stored(registry.first_gaps(registry.sizes_of_sources(pages, sources)), "first-gaps")
    parts = []
    for source in sources:
        mine = pages.where(F.col("source") == source["name"]).join(gaps, "source").where("page < first_gap")
        items = registry.page_items(mine, source)
        if source.get("fetch_mode", "list_then_detail") != "list_only":
            if details is None:
                raise ValueError(f"source {source['name']} needs detail documents")
            ids = registry.item_ids(items, source["list_api"]["id_field"])
            items = registry.with_details(ids, details)
        parts.append(registry.extract_registry(items, source, lookup, now))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return registry.latest_records(rows)


def geocode_registry(rows: DataFrame, cache: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Standardize registry rows and resolve them against the cache, skipping finished rows."""
    structured = standardize.standardize_addresses(rows)
    if done is not None:
        structured = geocode.skip_processed(structured, done)
    return geocode.geocode_resolve(structured, cache)


def import_file(spark: SparkSession, root: str, rows: DataFrame, kind: str, now: str,
                inventory: DataFrame | None = None) -> str:
    """Validate an import file, merge it into its table and write the new snapshot."""
    if kind == "power-fields":
        state = imports.import_farms(tables.read_table(spark, root, "power_fields"), rows, now)
        return tables.write_table(state, root, "power_fields")
    energy = kind.split("-")[0]
    state = imports.import_points(tables.read_table(spark, root, "recognition"), rows, energy, inventory, now)
    return tables.write_table(state, root, "recognition")


@dataclass
class Preview:
    """Results of an association run; all are lazy over one written set of links."""

    farms: DataFrame
    points: DataFrame
    links: DataFrame
    outliers: DataFrame
    summary: DataFrame
    hulls: DataFrame
    images: DataFrame
    unlocated: DataFrame


def association_preview(farms: DataFrame, points: DataFrame, manual: DataFrame | None, energy_type: str = "wind",
                        mode: str = "radius", radius_km: float = K.DEFAULT_RADIUS_KM, province: str | None = None,
                        inventory: DataFrame | None = None, blank_as_zero: bool = False) -> Preview:
    """Link points to farms and derive everything that is reported about the links."""
    f = A.usable_farms(farms, energy_type, province, blank_as_zero)
    p = A.usable_points(points, energy_type, province, blank_as_zero)
    links = stored(A.associate(f, p, manual, energy_type, mode, radius_km), "links")
    shown = A.with_image_url(p, inventory)
    return Preview(
        farms=A.farm_counts(f, links), points=shown, links=links, outliers=A.outliers(shown, links),
        summary=A.association_summary(f, p, links), hulls=hull.farm_hulls(f, links, p),
        images=A.preview_images(links, shown), unlocated=A.unlocated(farms, points, energy_type, province, blank_as_zero),
    )


def farm_documents(preview: Preview) -> DataFrame:
    """One JSON document per farm, whatever the number of its links: farm_id, json. The linked points
    are in `link_documents`."""
    hulls = preview.hulls.select("farm_id", "boundary")
    images = preview.images.groupBy("farm_id").agg(
        F.sort_array(F.collect_list(F.struct("position", F.col("recognition_id").alias("id"), "original_image", "image_url"))).alias(
            "preview_images")
    )  # at most eight each
    farms = preview.farms.withColumnRenamed("id", "farm_id")
    rows = farms.join(hulls, "farm_id").join(images, "farm_id", "left")
    wanted = ["enterprise_name", "site_name", "power_type", "capacity", "province"]
    fields = [c for c in wanted if c in farms.columns]
    body = F.struct(
        F.col("farm_id").alias("id"), *fields, F.col("lng").alias("longitude"), F.col("lat").alias("latitude"),
        "associated_count", "boundary", F.coalesce("preview_images", F.array()).alias("preview_images"),
    )
    return rows.select("farm_id", F.to_json(body).alias("json"))


def link_documents(preview: Preview, chunk: int = A.CHUNK) -> DataFrame:
    """The linked points of each farm with all their columns, in JSON lists of at most `chunk`:
    farm_id, chunk_no, json."""
    lists = A.farm_link_lists(preview.links, chunk, preview.points.drop("lng", "lat"))
    return lists.select("farm_id", "chunk_no", F.to_json(F.struct(F.col("farm_id").alias("id"), F.col("links").alias("associated"))).alias("json"))
