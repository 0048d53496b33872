"""Checks of route requests, and what is said of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILES = ("walk", "bike")
MOST_ALPHA, USUAL_ALPHA = 1000.0, 15.0


def checked(requests: DataFrame) -> DataFrame:
    """``requests(req_id, lat, lon, profile, alpha)`` -> ``(req_id, status, n_routes)``.

    422: a position is missing or out of range, or alpha is; 503: no such profile; else 200.
    A missing profile means walking, a missing alpha the usual one. A sound request gets the plain route, and
    a second one if alpha is above zero.
    """
    alpha = F.coalesce("alpha", F.lit(USUAL_ALPHA))
    sound = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False)) & alpha.between(0, MOST_ALPHA)
    known = F.coalesce("profile", F.lit(PROFILES[0])).isin(*PROFILES)
    status = F.when(~sound, 422).when(~known, 503).otherwise(200)
    return requests.select("req_id", status.cast("long").alias("status"), F.when(status != 200, 0).when(alpha > 0, 2).otherwise(1).cast("long").alias("n_routes"))


def outcomes(checks: DataFrame, snapped: DataFrame, reached: DataFrame) -> DataFrame:
    """``checks(req_id, status, n_routes)``, ``snapped(req_id, node_id)``, ``reached(node_id)``, each once -> ``(req_id, status, why, n_routes)``.

    A sound request is answered with 400 if no node is near (``far``) or none of its routes gets there (``apart``); a request without a
    row in ``snapped`` is far. What the checks refuse stays as it is and is not looked up.
    """
    sound = checks.filter("status = 200").select("req_id").join(snapped.select("req_id", "node_id"), "req_id", "left")
    met = sound.join(reached.select("node_id", F.lit(True).alias("there")), "node_id", "left").select("req_id", F.when(F.col("node_id").isNull(), "far").when(F.col("there").isNull(), "apart").alias("why"))
    told = checks.join(met, "req_id", "left")
    failed = F.col("why").isNotNull()
    return told.select("req_id", F.when(failed, 400).otherwise(F.col("status")).cast("long").alias("status"), "why", F.when(failed, 0).otherwise(F.col("n_routes")).cast("long").alias("n_routes"))


def verdict(alpha: Column, same: Column, plain_exposure: Column, other_exposure: Column) -> Column:
    """In a word how the two routes compare; the same nodes are the same route."""
    off = F.when(plain_exposure > 0, "seen").otherwise("clear")
    return F.when(alpha == 0, off).when(same, "least").when(other_exposure == 0, "unseen").otherwise("detour")
