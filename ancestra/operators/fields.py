"""A field from settings to a snapshot, its recovered citations, and its state between questions."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.operators import clean, recover, stats
from ancestra.sources import settings, snapshots

_WORK = re.compile(r"W[0-9]+")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def build_field(spark: SparkSession, field: settings.Field, nodes: DataFrame, edges: DataFrame, root: str, date: str, recovered: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Clean a field's works and citations by its settings into a dated snapshot.

    Returns its folder and a one-row report: what each step took, seeds that were lost,
    and the summary of the graph."""
    kept, cites, report = clean.clean(
        nodes,
        snapshots.with_recovered(edges.select("source", "target"), recovered),
        exclude=_table(spark, [(x,) for x in field.exclude], "id string"),
        titles=_table(spark, list(field.titles.items()), "id string, new_title string"),
        merge=_table(spark, list(field.merge.items()), "dup string, kept string"),
        start=field.crawl.start,
        end=field.crawl.end,
    )
    seeds = _table(spark, [(x,) for x in dict.fromkeys(field.seed_papers)], "id string")
    lost = seeds.join(kept.select("id"), "id", "left_anti").agg(F.array_sort(F.collect_list("id")).alias("dropped_seeds"))
    folder = snapshots.write(kept, cites, report.crossJoin(lost), f"{root.rstrip('/')}/{field.name}", date)  # one row each
    kept, cites = snapshots.read(spark, folder)
    summary = stats.summary(kept, cites)
    told = spark.read.parquet(f"{folder}/report")
    return folder, told.crossJoin(summary.select(*(F.col(c).alias(f"graph_{c}") for c in summary.columns)))  # one row each


def recover_field(nodes: DataFrame, edges: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Citations that a second catalogue has and edges do not, written as recovered.

    ask: from works (id, foreign_id) that it may know to references by source id."""
    known = nodes.select("id", recover.foreign_id(F.col("id")).alias("foreign_id")).where("foreign_id is not null")
    new = recover.new_only(recover.recovered(nodes, ask(known)), edges)
    new.write.mode("overwrite").parquet(f"{folder}/recovered")
    return nodes.sparkSession.read.parquet(f"{folder}/recovered")


def attributed(nodes: DataFrame, edges: DataFrame, columns: tuple[str, ...] = ("title", "year", "topic", "authors")) -> DataFrame:
    """Works of the graph: those of nodes with the columns they have, and ends of citations that nodes lack, without any."""
    kept = nodes.select("id", *(c for c in columns if c in nodes.columns))
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return kept.unionByName(ends.join(kept.select("id"), "id", "left_anti"), allowMissingColumns=True)


class Unknown(LookupError):
    """No such field or work."""


class NotReady(RuntimeError):
    """The field has no snapshot yet."""


def resolved(work_id: str, top: int, most: int = 50) -> tuple[str, int]:
    """A work's id and a number of results as they must be."""
    if not _WORK.fullmatch(work_id):
        raise ValueError(f"not an id of a work: {work_id}")
    if not 1 <= top <= most:
        raise ValueError(f"top must be 1 to {most}")
    return work_id, top


@dataclass
class State:
    nodes: DataFrame
    edges: DataFrame


class Library:
    """Fields by name, each with its latest snapshot read once."""

    def __init__(self, spark: SparkSession, fields: str, data: str):
        self.spark, self.fields, self.data = spark, fields, data
        self._held: dict[str, State] = {}
        self._lock = threading.Lock()

    def names(self) -> list[str]:
        return sorted({p.stem for p in Path(self.fields).glob("*") if p.suffix in (".yaml", ".yml", ".json")})

    def _ready(self, name: str) -> bool:
        try:
            return bool(snapshots.latest(self.spark, f"{self.data}/{name}"))
        except FileNotFoundError:
            return False

    def health(self) -> dict[str, bool]:
        """Whether each field has a snapshot."""
        return {name: self._ready(name) for name in self.names()}

    def summaries(self) -> list[dict]:
        out = []
        for name in self.names():
            field = settings.load_field(name, self.fields)
            out.append({"name": name, "description": field.description, "seeds": len(field.seed_papers), "ready": self._ready(name)})
        return out

    def state(self, name: str) -> State:
        if name not in self.names():
            raise Unknown(name)
        with self._lock:
            if name not in self._held:
                try:
                    folder = snapshots.latest(self.spark, f"{self.data}/{name}")
                except FileNotFoundError as error:
                    raise NotReady(name) from error
                nodes, edges = snapshots.read(self.spark, folder)
                self._held[name] = State(nodes.persist(), edges.persist())
            return self._held[name]


def allowed_origins(told: str | None, local: str = "http://localhost:5173") -> list[str]:
    """Web origins that may ask, from a list with commas; the local one if none is told."""
    return [x.strip() for x in told.split(",") if x.strip()] if told else [local]


LOOPBACK = ("localhost", "127.0.0.1", "::1")


def checked_base_url(url: str) -> str:
    """An endpoint of a model: https, or http to this machine alone."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an http or https address: {url}")
    if parts.username or parts.password:
        raise ValueError("no credentials in an address")
    if parts.scheme == "http" and parts.hostname not in LOOPBACK:
        raise ValueError(f"http only to this machine: {url}")
    return url.rstrip("/")


def chosen_backend(environment: dict[str, str], keys: dict[str, str], explicit: str, local: str) -> str:
    """The backend that is named in the environment, else the first whose key is there, else the local one.

    keys: each backend's variable, in order of preference."""
    named = environment.get(explicit, "").strip()
    if named:
        if named not in (*keys, local):
            raise ValueError(f"no backend {named}")
        return named
    return next((name for name, variable in keys.items() if environment.get(variable)), local)
