"""What changed since the last run: listing against the stored manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.carry import FILE


def manifest_diff(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Classify every file.

    Both sides: ``home, path, identity, length, consumed, modified_at``
    (``consumed`` = bytes parsed so far, ignored on the listing side).
    ``identity`` stands for the creation of a file: where the store keeps no
    creation time use thread id and a digest of the head of the file.

    ``unchanged``; ``appended`` (resume at ``consumed``); ``rewritten`` (read
    again); ``renamed`` (same identity and length under another path, keeps its
    state); ``new``; ``deleted``.
    """
    now = listing.select(*FILE, *[F.col(c).alias(f"now_{c}") for c in ("identity", "length", "modified_at")])
    old = stored.select(
        *FILE, *[F.col(c).alias(f"old_{c}") for c in ("identity", "length", "modified_at", "consumed")]
    )
    both = now.join(old, list(FILE), "full_outer")
    here, there = F.col("now_identity").isNotNull(), F.col("old_identity").isNotNull()
    same = F.col("now_identity") == F.col("old_identity")
    longer = F.col("now_length") > F.col("old_length")
    still = (F.col("now_length") == F.col("old_length")) & (F.col("now_modified_at") == F.col("old_modified_at"))
    plain = (
        F.when(here & ~there, "new")
        .when(~here, "deleted")
        .when(same & still & (F.col("now_length") >= F.col("old_consumed")), "unchanged")
        .when(same & longer, "appended")
        .otherwise("rewritten")
    )
    classed = both.withColumn("change", plain)
    # A vanished file whose identity and length turn up elsewhere has moved;
    # the smallest path wins when several qualify on either side.
    gone = classed.where("change = 'deleted'").groupBy("home", F.col("old_identity").alias("identity"), F.col("old_length").alias("length")).agg(
        F.min_by("path", "path").alias("moved_from"), F.min_by("old_consumed", "path").alias("_consumed")
    )
    came = classed.where("change = 'new'").groupBy("home", F.col("now_identity").alias("identity"), F.col("now_length").alias("length")).agg(
        F.min("path").alias("path")
    )
    moves = came.join(gone, ["home", "identity", "length"])
    arrived = moves.select("home", "path", "moved_from", F.col("_consumed").alias("_resume"), F.lit("renamed").alias("_as"))
    left = moves.select("home", F.col("moved_from").alias("path"), F.lit(None).cast("string").alias("moved_from"),
                        F.lit(None).cast("bigint").alias("_resume"), F.lit("moved away").alias("_as"))
    done = classed.join(arrived.unionByName(left), list(FILE), "left")
    return done.select(
        *FILE,
        F.coalesce("_as", "change").alias("change"),
        "moved_from",
        F.when(F.col("change") == "appended", F.col("old_consumed"))
        .when(F.col("_as") == "renamed", F.col("_resume"))
        .when(F.col("change").isin("new", "rewritten"), F.lit(0))
        .cast("bigint")
        .alias("resume_at"),
    )
