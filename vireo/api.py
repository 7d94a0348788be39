"""The engine's requests as methods: each takes parameters, checks them, and returns a DataFrame.

Errors carry the status that a service would answer with.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.network import client_network
from .functions.text import is_email
from .operators import accounts, analytics, catalog, frames, pipeline, scenes
from .operators.descriptor import colour_layout

LENGTH = 33


class RequestError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def parse_query(vector: str | Sequence[float]) -> list[float]:
    """A query vector given as numbers or as base64 of its bytes."""
    if isinstance(vector, str):
        try:
            values: list[float] = list(base64.b64decode(vector))
        except ValueError:
            raise RequestError(400, "the vector is not base64") from None
    else:
        values = list(vector)
    if len(values) != LENGTH or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in values):
        raise RequestError(400, f"a vector has {LENGTH} numbers")
    return [float(x) for x in values]


class Engine:
    """frames, files, catalog, logs, users, tiers: the tables of :mod:`vireo.sources.views`."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    def search(self, vectors: Sequence | None = None, image: tuple[bytes, int, int] | None = None, catalog_id: str | int | None = None, with_catalog: bool = False, candidates: int = frames.CANDIDATES) -> DataFrame:
        """Best intervals for one vector, up to ten vectors, or a raw RGB image (bytes, width, height)."""
        if vectors is not None:
            many = [vectors] if isinstance(vectors, str) or (len(vectors) and isinstance(vectors[0], (int, float))) else list(vectors)
            if not 1 <= len(many) <= frames.MAX_QUERIES:
                raise RequestError(400, f"1 to {frames.MAX_QUERIES} vectors")
            queries = [parse_query(v) for v in many]
        elif image is not None:
            queries = [[float(x) for x in colour_layout(*image)]]
        else:
            raise RequestError(405, "no vector and no image")
        whole = all(x.is_integer() for q in queries for x in q)
        kind = "int" if whole else "double"
        q = self.t["frames"].sparkSession.createDataFrame([(i, [int(x) if whole else x for x in v]) for i, v in enumerate(queries)], f"query_id int, qvec array<{kind}>")
        if catalog_id is not None and str(catalog_id).isdigit():  # any other value is ignored
            out = frames.frame_search_filtered(self.t["frames"], q, self.t["files"], int(catalog_id), candidates=candidates)
        else:
            out = frames.frame_search(self.t["frames"], q, self.t["files"], candidates)
        return frames.with_catalog(out, self.t["catalog"]) if with_catalog else out

    def titles(self, query: str) -> DataFrame:
        if not query or not query.strip():
            raise RequestError(400, "the query is empty")
        return catalog.title_search(catalog.catalog_titles(self.t["catalog"]), self.t["catalog"], query)

    def stats(self, kind: str, period: str, as_of: Column) -> DataFrame:
        if period not in analytics.PERIODS:
            raise RequestError(400, f"period must be one of {', '.join(analytics.PERIODS)}")
        if kind == "traffic":
            return analytics.traffic_pivot(self.t["logs"], period, as_of)
        if kind in ("speed", "accuracy"):
            return analytics.percentiles(self.t["logs"], period, {"speed": "search_time", "accuracy": "accuracy"}[kind], as_of)
        raise RequestError(400, "type must be traffic, speed or accuracy")

    def status(self, prefix: str | None = None) -> DataFrame:
        """Totals; with an id, the files below it."""
        if prefix is not None:
            return pipeline.files_by_prefix(self.t["files"], prefix)
        updated = self.t["catalog"].agg(F.max("updated").alias("last_updated"))
        return analytics.status_totals(self.t["files"]).crossJoin(updated)

    def me(self, as_of: Column, api_key: str | None = None, ip: str | None = None) -> DataFrame:
        """Limits and use of a user, or of a guest's network."""
        if api_key is not None:
            user = self.t["users"].filter(F.col("api_key") == api_key)
            if user.isEmpty():
                raise RequestError(403, "unknown key")
            return accounts.users_view(user, self.t["tiers"], self.t["logs"], as_of)
        spark = self.t["logs"].sparkSession
        network = spark.range(1).select(client_network(F.lit(ip))).first()[0]
        logs = self.t["logs"].withColumn("network", client_network(F.col("ip")))
        return accounts.quota_guest(self.t["tiers"], logs, network, as_of)

    def scene(self, path: str, t: float, shortest: float | None = None, longest: float | None = None) -> tuple[float, float, float] | None:
        """The scene around a point of a file."""
        clamp = lambda v, default, high: min(max(v, 0.5), high) if v else default
        row = self.t["files"].filter(F.col("path") == path).select("duration", F.from_json("scene_changes", "array<array<double>>").alias("changes")).first()
        if row is None:
            return None
        changes = None if row["changes"] is None else [(c[0], c[1]) for c in row["changes"]]
        return scenes.scene_window(t, row["duration"], changes, clamp(shortest, 0.5, 2.0), clamp(longest, 5.0, 5.0))

    def new_user(self, email: str, tier: int) -> DataFrame:
        """The row that a new account adds; 409 if there is one with this address."""
        spark = self.t["users"].sparkSession
        if not spark.range(1).select(is_email(F.lit(email))).first()[0]:
            raise RequestError(400, "not an address")
        if not self.t["users"].filter(F.col("email") == email).isEmpty():
            raise RequestError(409, "the address is in use")
        return accounts.with_new_ids(self.t["users"].select("id"), spark.createDataFrame([(email, tier)], "email string, tier int"))
