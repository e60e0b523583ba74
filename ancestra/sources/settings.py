"""Settings of a field and known lineages, as files on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SPLITS = ("dev", "test")


class BadSettings(ValueError):
    """A file that does not say what it must."""


@dataclass(frozen=True)
class Crawl:
    hop_depth: int = 2
    forward_depth: int = 0
    fill_cited_by: int = 0
    start: int | None = None
    end: int | None = None
    max_nodes: int | None = None


@dataclass(frozen=True)
class Field:
    name: str
    description: str
    seed_papers: tuple[str, ...]
    topic_id: str | None = None
    exclude: tuple[str, ...] = ()
    titles: dict[str, str] = field(default_factory=dict)
    merge: dict[str, str] = field(default_factory=dict)
    crawl: Crawl = Crawl()


def _read(path: Path) -> Any:
    if path.suffix == ".json":
        return json.loads(path.read_text())
    try:
        import yaml
    except ImportError as error:
        raise BadSettings(f"{path}: YAML cannot be read here, JSON can") from error
    return yaml.safe_load(path.read_text())


def _located(name: str, folder: str) -> Path:
    """The file that a path names, or a name in a folder."""
    options = [Path(name)] if Path(name).suffix else [Path(folder, f"{name}{s}") for s in (".yaml", ".yml", ".json")]
    for path in options:
        if path.is_file():
            return path
    raise FileNotFoundError(f"no settings {name} in {folder}")


def _checked(told: dict, allowed: Any, where: str) -> dict:
    if not isinstance(told, dict):
        raise BadSettings(f"{where} must be a table")
    unknown = set(told) - set(allowed.__dataclass_fields__)
    if unknown:
        raise BadSettings(f"{where} has unknown entries: {', '.join(sorted(unknown))}")
    return told


def load_field(name: str, folder: str = "fields") -> Field:
    """A field's settings by name or path. Its name is that of its file; depths are not
    negative; forward hops need a topic; bounds are inclusive, null is open."""
    path = _located(name, folder)
    told = _checked(_read(path) or {}, Field, str(path))
    if told.get("name") != path.stem:
        raise BadSettings(f"{path}: the name must be {path.stem}")
    if not told.get("seed_papers"):
        raise BadSettings(f"{path}: no seed papers")
    crawl = Crawl(**_checked(told.get("crawl") or {}, Crawl, "crawl"))
    if min(crawl.hop_depth, crawl.forward_depth, crawl.fill_cited_by) < 0 or (crawl.max_nodes is not None and crawl.max_nodes < 1):
        raise BadSettings(f"{path}: depths and counts must not be negative")
    if crawl.forward_depth and not told.get("topic_id"):
        raise BadSettings(f"{path}: forward hops need a topic_id")
    if crawl.start is not None and crawl.end is not None and crawl.start > crawl.end:
        raise BadSettings(f"{path}: the range of years is empty")
    return Field(
        name=path.stem,
        description=" ".join(str(told.get("description", "")).split()),
        seed_papers=tuple(told["seed_papers"]),
        topic_id=told.get("topic_id"),
        exclude=tuple(told.get("exclude") or ()),
        titles=dict(told.get("titles") or {}),
        merge=dict(told.get("merge") or {}),
        crawl=crawl,
    )


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """origin, split, work, ids of known lineages: each originator is a list of ids of one work."""
    rows = []
    for told in _read(Path(path)) or []:
        split, works = told.get("split"), told.get("originators") or []
        if split not in SPLITS:
            raise BadSettings(f"{path}: {told.get('target')} has split {split}")
        if not works or not all(isinstance(w, list) and w for w in works):
            raise BadSettings(f"{path}: {told.get('target')} has an originator without ids")
        rows += [(told["target"], split, k, list(w)) for k, w in enumerate(works)]
    return spark.createDataFrame(rows, "origin string, split string, work long, ids array<string>")
