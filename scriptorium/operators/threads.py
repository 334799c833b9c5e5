"""Threads of comments: roots and depths of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import settle


def roots(replies: DataFrame, most: int = 40) -> DataFrame:
    """``id, root, depth`` from ``id, parent``: pointers to ancestors double in reach with each round.

    A parent that isn't there makes its reply a root. Replies in a cycle reach no root and are left out.
    ``most`` rounds reach ancestors ``2 ** most`` replies up.
    """
    ids = replies.select(F.col("id").alias("p"))
    start = replies.join(ids, replies.parent == ids.p, "left").select("id", F.coalesce("p", "id").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("depth"))
    now = settle(start)
    for _ in range(most):
        top = now.select(F.col("id").alias("u"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = settle(now.join(top, F.col("up") == F.col("u")).select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("next") != F.col("up")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        now = new.drop("moved")
        if not moved:
            break
    own = now.where("id = up").select(F.col("id").alias("r"))
    return now.join(own, F.col("up") == F.col("r"), "left_semi").select("id", F.col("up").alias("root"), "depth")
