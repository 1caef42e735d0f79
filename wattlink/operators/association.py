"""Linking recognition points to power farms, and what follows from the links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink import constants as K
from wattlink.functions.geo import haversine_km
from wattlink.functions.measure import finite_number
from wattlink.functions.text import normalize_poi, url_component, utf16_length
from wattlink.operators import nearest
from wattlink.operators.containment import containing_pairs
from wattlink.operators.ranking import computed_once, first_per_key, numbered, top_per_key
from wattlink.session import durable, spread, stored
from wattlink.operators.views import energy_match, province_match

LINK_COLUMNS = ["farm_id", "recognition_id", "distance_km", "association_source"]
CHUNK = 10_000  # links in one nested list


def usable_farms(farms: DataFrame, energy_type: str, province: str | None = None,
                 blank_as_zero: bool = False) -> DataFrame:
    """Farms of the energy type and province with finite coordinates, added as lng and lat."""
    rows = farms.where(energy_match(energy_type))
    if province:
        rows = rows.where(province_match("province", province))
    return _located(rows, blank_as_zero)


def usable_points(points: DataFrame, energy_type: str, province: str | None = None,
                  blank_as_zero: bool = False) -> DataFrame:
    return _located(_chosen_points(points, energy_type, province), blank_as_zero)


def _chosen_points(points: DataFrame, energy_type: str, province: str | None) -> DataFrame:
    # any energy type but wind reads the solar points
    rows = points
    if "energy_type" in points.columns:
        rows = points.where(F.col("energy_type") == ("wind" if energy_type == "wind" else "solar"))
    if province:
        rows = rows.where(province_match("province_name", province) | province_match("province_code", province))
    return rows


def _placed(rows: DataFrame, blank_as_zero: bool) -> DataFrame:
    lng, lat = (finite_number(c, blank_as_zero) for c in ("longitude", "latitude"))
    return computed_once(rows, lng=lng, lat=lat)


def _located(rows: DataFrame, blank_as_zero: bool) -> DataFrame:
    return _placed(rows, blank_as_zero).where("lng IS NOT NULL AND lat IS NOT NULL")


def unlocated(farms: DataFrame, points: DataFrame, energy_type: str, province: str | None = None,
              blank_as_zero: bool = False) -> DataFrame:
    """kind (farm or point), id, longitude, latitude of the chosen rows that no link can reach, since
    their coordinates are no finite numbers."""
    chosen = farms.where(energy_match(energy_type))
    if province:
        chosen = chosen.where(province_match("province", province))
    parts = [("farm", chosen), ("point", _chosen_points(points, energy_type, province))]
    lost = [
        _placed(rows.select(F.lit(kind).alias("kind"), "id", "longitude", "latitude"), blank_as_zero)
        .where("lng IS NULL OR lat IS NULL").drop("lng", "lat")
        for kind, rows in parts
    ]
    return lost[0].unionByName(lost[1])


def _sites(farms: DataFrame, *extra) -> DataFrame:
    return farms.select("id", F.col("enterprise_name").alias("name"), "lng", "lat", *extra)


def radius_links(farms: DataFrame, points: DataFrame, radius_km: float = K.DEFAULT_RADIUS_KM,
                 strategy: str = "auto") -> DataFrame:
    """Each point to its nearest farm within the radius; inputs come from `usable_*`."""
    best = nearest.nearest_within(points, _sites(farms), radius_km, strategy)
    return _auto(best.withColumnRenamed("id", "recognition_id"))


def _auto(best: DataFrame) -> DataFrame:
    return best.select(
        F.col("s_id").alias("farm_id"), "recognition_id", F.round("distance", 3).alias("distance_km"),
        F.lit("auto").alias("association_source"),
    )


def poi_links(farms: DataFrame, points: DataFrame) -> DataFrame:
    """Each point to the nearest farm whose address text contains its place name or is contained
    in it; no distance cap.

    Texts are matched once per distinct text. A text holds only a few of the other texts, so the
    containing side is spread over what it contains and searched group by group: points over the
    addresses inside their place name, farms over the place names inside their address.
    """
    long_enough = utf16_length(F.col("t")) >= 2
    sites = _sites(farms, normalize_poi("raw_address").alias("t")).where(long_enough)
    probes = points.select(
        F.col("id").alias("recognition_id"), normalize_poi("poi").alias("t"), "lng", "lat"
    ).where(long_enough)
    # written once: both directions and the sizing of groups read them again
    spots = durable(spread(probes.select("t", "lng", "lat").distinct(), "t", "lng", "lat"))
    held = durable(nearest.distinct_positions(sites, ["t"]))
    addresses = held.select(F.col("t").alias("address")).distinct()
    names = spots.select(F.col("t").alias("poi")).distinct()

    inside_poi = durable(containing_pairs(addresses, names, "address", "poi"))
    asked = spots.join(inside_poi.withColumnRenamed("poi", "t"), "t").withColumnRenamed("address", "g")
    by_address = nearest.nearest_in_groups(asked, held.withColumnRenamed("t", "g"), ["t", "lng", "lat"])

    # equal texts are already paired above
    inside_address = durable(containing_pairs(names, addresses, "poi", "address").where("poi <> address"))
    listed = held.join(inside_address.withColumnRenamed("address", "t"), "t").withColumnRenamed("poi", "g").drop("t")
    listed = durable(nearest.distinct_positions(listed, ["g"]))
    by_name = nearest.nearest_in_groups(spots.withColumn("g", F.col("t")), listed, ["t", "lng", "lat"])

    best = first_per_key(
        by_address.unionByName(by_name), ["t", "lng", "lat"], [F.col("distance"), F.col("s_name"), F.col("s_id")]
    )
    return _auto(probes.join(best, ["t", "lng", "lat"]))


def manual_links(manual: DataFrame, farms: DataFrame, points: DataFrame, auto: DataFrame, energy_type: str) -> DataFrame:
    """Manual links whose farm and point both pass the filters and that are not automatic ones."""
    wanted = manual.where(F.col("energy_type") == energy_type).select("farm_id", "recognition_id").distinct()
    f = farms.select(F.col("id").alias("farm_id"), F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"))
    p = points.select(F.col("id").alias("recognition_id"), "lng", "lat")
    both = wanted.join(f, "farm_id").join(p, "recognition_id")
    new = both.join(auto.select("farm_id", "recognition_id"), ["farm_id", "recognition_id"], "left_anti")
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("f_lat"), F.col("f_lng"))
    return new.select("farm_id", "recognition_id", F.round(km, 3).alias("distance_km"),
                      F.lit("manual").alias("association_source"))


def associate(farms: DataFrame, points: DataFrame, manual: DataFrame | None, energy_type: str, mode: str = "radius",
              radius_km: float = K.DEFAULT_RADIUS_KM, strategy: str = "auto") -> DataFrame:
    """All links of the usable farms and points. Any mode but 'poi' acts as 'radius'."""
    auto = poi_links(farms, points) if mode == "poi" else radius_links(farms, points, radius_km, strategy)
    if manual is None:
        return auto
    # read twice: by the union and to leave out manual links that are automatic ones already
    auto = stored(auto, "auto-links")
    return auto.unionByName(manual_links(manual, farms, points, auto, energy_type))


def outliers(points: DataFrame, links: DataFrame) -> DataFrame:
    """Points without any link."""
    return points.join(links.select(F.col("recognition_id").alias("id")), "id", "left_anti")


def split_links(links: DataFrame, source: str) -> DataFrame:
    return links.where(F.col("association_source") == source)


def union_by_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, one per id; the left one stays where both have it."""
    new = right.join(left.select(key), key, "left_anti")
    return left.dropDuplicates([key]).unionByName(new.dropDuplicates([key]))


def linked_points(links: DataFrame, points: DataFrame) -> DataFrame:
    """Links with the columns of their point."""
    return links.join(points.withColumnRenamed("id", "recognition_id"), "recognition_id")


def farm_counts(farms: DataFrame, links: DataFrame) -> DataFrame:
    """Linked points per farm, 0 for farms without any. Links are unique per farm and point, so
    a plain partial count is exact."""
    counts = links.groupBy("farm_id").agg(F.count("*").alias("n"))
    return farms.join(counts, farms["id"] == counts["farm_id"], "left").drop("farm_id").withColumn(
        "associated_count", F.coalesce("n", F.lit(0))
    ).drop("n")


def association_summary(farms: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    """One row: farms, linked farms, points, linked points, points without a link."""
    # one pass over the links gives both ends of each
    ends = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in (("linked_farm", "farm_id"), ("linked", "recognition_id"))]
    rows = links.select(F.inline(F.array(*ends))).distinct().select("kind")
    for kind, df in (("farm", farms), ("point", points)):
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind")))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.agg(
        count("farm").alias("farm_count"), count("linked_farm").alias("linked_farm_count"),
        count("point").alias("recognition_count"), count("linked").alias("linked_recognition_count"),
        (count("point") - count("linked")).alias("outlier_count"),
    )


def image_url(energy_type: Column, name: Column) -> Column:
    return F.concat(F.lit("/api/recognition/image?type="), energy_type, F.lit("&name="), url_component(name))


def with_image_url(points: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Link to the image of each point that has one; null otherwise.

    Without an inventory (name) the stored `image_exists` flag decides alone; with one, the file
    must exist as well.
    """
    url = image_url(F.col("energy_type"), F.col("original_image"))
    stored = F.col("image_exists") != 0
    if inventory is None:
        return points.withColumn("image_url", F.when(stored, url))
    files = inventory.select(F.col("name").alias("original_image"), F.lit(True).alias("_file")).dropDuplicates()
    return points.join(files, "original_image", "left").withColumn(
        "image_url", F.when(stored & F.col("_file"), url)
    ).drop("_file")


def link_order() -> list[Column]:
    """Automatic links first, then manual ones, each by falling point id."""
    return [F.col("association_source"), F.col("recognition_id").desc()]


def preview_images(links: DataFrame, points: DataFrame, n: int = 8) -> DataFrame:
    """The first n linked points with an image per farm."""
    shown = linked_points(links, points.select("id", "original_image", "image_url").where("image_url IS NOT NULL"))
    return top_per_key(shown, ["farm_id"], link_order(), n).select(
        "farm_id", "position", "recognition_id", "original_image", "image_url"
    )


def farm_link_lists(links: DataFrame, chunk: int = CHUNK, points: DataFrame | None = None) -> DataFrame:
    """Nested list of linked points per farm, in chunks: farm_id, chunk_no, links.

    A farm with more links than `chunk` gets several rows, so no list grows with a hot farm. With
    `points`, an item holds all their columns as well.
    """
    placed, detail = numbered(links, link_order(), ["farm_id"], "position"), []
    if points is not None:
        placed = linked_points(placed, points)
        detail = [c for c in points.columns if c not in ("id", *LINK_COLUMNS, "position")]
    item = F.struct("position", "recognition_id", "distance_km", "association_source", *detail)
    chunk_no = F.floor((F.col("position") - 1) / chunk).cast("int")
    return placed.withColumn("chunk_no", chunk_no).groupBy("farm_id", "chunk_no").agg(
        F.sort_array(F.collect_list(item)).alias("links")
    )
