"""Duplicates across datasets by name keys and by hash distance.

The bits of a hash are cut into pieces. Hashes within d bits of another are within a smaller radius in one piece at least, and a
radius in a piece is an equi-join: one side flips up to that many bits in the piece's lower half, the other in its upper half, and
keys carry how many either flips, so a pair within the radius has one key in common and a pair outside none. With d + 1 pieces
all radii are 0; fewer, longer pieces look at fewer pairs and make more keys (``functions.hashes.pieces`` takes the most pieces
that look at 1 % of unlike pairs at most): on 64 bits 0.39 % at 5 with a key for each of 6 pieces, 0.48 % at 12 with three pieces
and 1,186 and 1,498 keys. Equal hashes are collapsed first, so that a hash shared by many images costs one row in the search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.hashes import hamming, pieces, probes


def by_name(images: DataFrame, key: str = "base") -> DataFrame:
    """Members of the groups of one key that span more than one dataset."""
    groups = images.groupBy(key).agg(F.count("*").alias("n"), F.min("dataset").alias("lo"), F.max("dataset").alias("hi"))
    return images.join(groups.where("n > 1 and lo <> hi").select(key), key, "left_semi")


def near_hashes(left: DataFrame, right: DataFrame, limbs: Sequence[str], distance: int) -> DataFrame:
    """Distinct pairs of hashes (l_<limb>, r_<limb>, distance) of the two sides within the distance."""
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in limbs]).distinct()  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in limbs]).distinct()
    lcols, rcols = [F.col(f"l_{c}") for c in limbs], [F.col(f"r_{c}") for c in limbs]
    cut = pieces(distance, 32 * len(limbs))
    l = l.withColumn("_key", F.explode(probes(lcols, cut, False)))  # noqa: E741
    r = r.withColumn("_key", F.explode(probes(rcols, cut, True)))
    near = hamming(lcols, rcols)
    # by sort-merge at every size: the optimizer takes a side with its keys for as small as the hashes alone, and would broadcast it
    pairs = l.join(r.hint("merge"), "_key").where(near <= distance).withColumn("distance", near)
    return pairs.drop("_key").distinct()


def by_hash(images: DataFrame, limbs: Sequence[str], distance: int = 5) -> DataFrame:
    """left_id, right_id, distance of pairs of images of different datasets, each pair once (ids ascending)."""
    near = near_hashes(images, images, limbs, distance)
    side = lambda s: images.select(*[F.col(c).alias(f"{s}_{c}") for c in ("image_id", "dataset", *limbs)])
    rows = near.join(side("l"), [f"l_{c}" for c in limbs]).join(side("r"), [f"r_{c}" for c in limbs])
    return rows.where("l_dataset <> r_dataset and l_image_id < r_image_id").select(F.col("l_image_id").alias("left_id"), F.col("r_image_id").alias("right_id"), "distance")


def both_sides(pairs: DataFrame) -> DataFrame:
    """Two rows per pair, one for each member."""
    return pairs.select(F.explode(F.array("left_id", "right_id")).alias("image_id"), "left_id", "right_id", "distance")


def against_reference(images: DataFrame, reference: DataFrame, limbs: Sequence[str], distance: int, verify_digest: str | None = None, verify_limbs: Sequence[str] = (), verify_distance: int = 10) -> DataFrame:
    """image_id, reference_id, kind, verified: duplicates by name key or by hash; a name match counts as verified, a
    hash match if the digests agree or the hashes in ``verify_limbs`` are within their distance (or without either)."""
    name = images.select("image_id", "base").join(reference.select(F.col("image_id").alias("reference_id"), "base"), "base")
    out = name.select("image_id", "reference_id", F.lit("name").alias("kind"), F.lit(True).alias("verified"))
    near = near_hashes(images, reference, limbs, distance)
    more = [*([verify_digest] if verify_digest else []), *verify_limbs]
    side = lambda s: [*[F.col(c).alias(f"{s}_{c}") for c in limbs], *[F.col(c).alias(f"_{s}_{c}") for c in more]]
    l = images.select("image_id", *side("l"))  # noqa: E741
    r = reference.select(F.col("image_id").alias("reference_id"), *side("r"))
    rows = near.join(l, [f"l_{c}" for c in limbs]).join(r, [f"r_{c}" for c in limbs])
    sure = F.lit(not more)
    if verify_digest:
        sure |= F.coalesce(F.col(f"_l_{verify_digest}") == F.col(f"_r_{verify_digest}"), F.lit(False))
    if verify_limbs:
        sure |= F.coalesce(hamming([F.col(f"_l_{c}") for c in verify_limbs], [F.col(f"_r_{c}") for c in verify_limbs]) <= verify_distance, F.lit(False))
    return out.unionByName(rows.select("image_id", "reference_id", F.lit("hash").alias("kind"), sure.alias("verified"))).distinct()


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables hold: an intersection that has to be empty for disjoint splits."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def unknown(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys in use that aren't known, once each."""
    return used.select(key).distinct().join(known.select(key), key, "left_anti")
