"""Reading a remote catalogue page by page: pauses, retries, and batches of answers.

The calls themselves are functions that are passed in, so nothing here needs a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses after which the same call may succeed.
PASSING = (429, 500, 502, 503, 504)


class Failed(Exception):
    """An answer with another status than 200."""

    def __init__(self, status: int, headers: dict[str, str] | None = None):
        super().__init__(f"status {status}")
        self.status, self.headers = status, headers or {}


@dataclass
class Caller:
    """Calls at most once a pause, and again after statuses that pass."""

    pause: float = 0.1
    attempts: int = 5
    backoff: float = 1.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float = field(default=float("-inf"), init=False)

    def _delay(self, failed: Failed, attempt: int) -> float:
        told = failed.headers.get("Retry-After", "")
        return float(told) if told.isdigit() else self.backoff * 2**attempt

    def __call__(self, call: Callable, *args, **named):
        for attempt in range(self.attempts + 1):
            wait = self.last + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return call(*args, **named)
            except Failed as failed:
                if failed.status not in PASSING or attempt == self.attempts:
                    raise
                self.sleep(self._delay(failed, attempt))


def pages(fetch: Callable[[str], tuple[list, str | None]], first: str = "*") -> Iterator:
    """All items of a listing: fetch gives a page and the next cursor, until there is no
    cursor or a page is empty."""
    cursor: str | None = first
    while cursor:
        items, cursor = fetch(cursor)
        if not items:
            return
        yield from items


def batches(ids: Iterable[str], size: int) -> Iterator[list[str]]:
    held: list[str] = []
    for x in ids:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


REFERENCES = "source string, references array<struct<title:string,year:int,externalIds:map<string,string>>>"


def references(answers: DataFrame, name: str) -> DataFrame:
    """source, ref_title, ref_year, ref_id of answers (REFERENCES) of a second catalogue;
    name: what it calls our ids. Works it does not know have no references."""
    each = answers.select("source", F.explode("references").alias("r")).where("r is not null")
    return each.select("source", F.col("r.title").alias("ref_title"), F.col("r.year").alias("ref_year"), F.col("r.externalIds")[name].alias("ref_id"))


def asked(ids: list[str], fetch: Callable[[list[str]], list[dict | None]], size: int = 500) -> Iterator[tuple[str, dict]]:
    """Ids with their answers, which come in the order of each batch, null for the unknown."""
    for batch in batches(ids, size):
        answers = fetch(batch)
        if len(answers) != len(batch):
            raise ValueError(f"{len(answers)} answers to {len(batch)} ids")
        yield from ((i, a) for i, a in zip(batch, answers) if a is not None)
