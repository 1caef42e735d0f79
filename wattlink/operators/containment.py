"""Which texts contain which other texts, over an inverted index of rare q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlink.operators.nearest import BROADCAST_BYTES
from wattlink.session import stored

GRAM = 3             # characters of a q-gram; shorter needles are their own
CROWDED = 1 << 17    # texts with one q-gram from which its listing is spread over several tasks


def _grams(text: Column, size: Column) -> Column:
    """Hashes of the different runs of `size` (at most GRAM) characters. Takes time linear in the text: substring()
    would walk to every place from the beginning."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def hashed(c: Column) -> Column:
        places = F.when(F.size(c) >= size, F.sequence(F.lit(1), F.size(c) - size + 1)).otherwise(F.array().cast("array<int>"))
        piece = lambda i, k: F.when(size > k, F.try_element_at(c, i + k)).otherwise(F.lit(""))
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(*[piece(i, k) for k in range(GRAM)])))

    return F.transform(F.array(chars), hashed)[0]


def rarest_grams(listed: DataFrame, held: DataFrame, needle: str) -> DataFrame:
    """gram, needle, texts: every needle under the one of its q-grams that the fewest hays hold; needles with a q-gram
    that no hay holds are in none."""
    texts = held.groupBy("gram").agg(F.count("*").alias("texts"))
    counted = listed.join(texts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rare = counted.groupBy(needle).agg(F.min(F.struct("texts", "gram")).alias("rare")).where("rare.texts > 0")
    return rare.select("rare.gram", needle, "rare.texts")


def containing_pairs(needles: DataFrame, hays: DataFrame, needle: str = "needle", hay: str = "hay") -> DataFrame:
    """All (needle, hay) with the needle inside the hay. Both inputs hold distinct texts.

    A hay that contains a needle holds all its q-grams, so it is enough to list the needle under one of
    them: the rarest over all hays. A hay meets the needles listed under its own different q-grams, at most
    as many lookups as it has characters, and whether it contains them is verified. A needle is listed once
    and a hay's q-grams are different, so every pair is met once.
    """
    size = F.least(F.length(needle), F.lit(GRAM))
    sized = needles.where(F.length(needle) > 0).select(needle, size.alias("size"))
    stats = sized.agg(F.collect_set("size").alias("sizes"), F.sum(F.octet_length(needle) + 32).alias("bytes")).first()
    small = (stats["bytes"] or 0) <= BROADCAST_BYTES  # and so are its q-grams, of one long a character
    listed = sized.select(needle, F.explode(_grams(F.col(needle), F.col("size"))).alias("gram"))
    wanted = listed.select("gram").distinct()
    grams = [_grams(F.col(hay), F.lit(n)) for n in stats["sizes"]] or [F.array().cast("array<long>")]
    held = hays.select(hay, F.explode(F.concat(*grams)).alias("gram")).join(F.broadcast(wanted) if small else wanted, "gram", "left_semi")
    inside = F.contains(F.col(hay), F.col(needle))
    index = rarest_grams(listed, held, needle)
    if small:
        return held.join(F.broadcast(index.drop("texts")), "gram").where(inside).select(needle, hay)
    index = stored(index, "rare-grams")
    # only hashes are shuffled, the texts of what met are fetched after; a crowded q-gram is dealt over several tasks
    parts = F.ceil(F.col("texts") / CROWDED).cast("int")
    spread = F.broadcast(index.where(F.col("texts") > CROWDED).groupBy("gram").agg(F.first(parts).alias("parts")))
    slim = held.select("gram", F.xxhash64(hay).alias("hay_id")).join(spread, "gram", "left").withColumn(
        "deal", F.pmod(F.col("hay_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    dealt = index.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("texts")
    met = slim.join(dealt, ["gram", "deal"]).select("hay_id", needle)
    return hays.select(hay, F.xxhash64(hay).alias("hay_id")).join(met, "hay_id").where(inside).select(needle, hay).dropDuplicates()
