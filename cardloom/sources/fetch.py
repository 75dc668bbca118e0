"""Fetching by plan. The transport is a parameter: (url) -> (status code, body), or an exception where there is no answer."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Transport = Callable[[str], tuple[int, bytes]]
SCHEMA = "card_id string, status string, http_status int, bytes long, sha256 string, error string, body binary, fetched_at string"
#: Answers after which another attempt may help.
TRANSIENT = (429, 500, 502, 503, 504)


def linear(attempt: int) -> float:
    return 0.5 * (attempt + 1)


def doubling(attempt: int) -> float:
    return min(2.0**attempt, 16.0)


def _row(status: str, code: int | None, body: bytes | None = None, error: str | None = None) -> dict:
    return {"status": status, "http_status": code, "bytes": None if body is None else len(body), "sha256": None if body is None else hashlib.sha256(body).hexdigest(), "error": error, "body": body}


def attempt_all(url: str, transport: Transport, retries: int, wait: Callable[[int], float], absent: str, any_error: bool, sleep=time.sleep, check: Callable[[bytes], object] | None = None) -> dict:
    """404 means absent; with any_error every other failure is tried again, else only those that may pass.

    check may raise on a body that can't be used, which counts as no answer.
    """
    error = None
    for n in range(retries + 1):
        try:
            code, body = transport(url)
            if code == 200 and check:
                check(body)
        except Exception as e:  # whatever the transport raises counts as no answer
            code, body, error = None, b"", str(e)[:300]
        if code == 200:
            return _row("ok", 200, body)
        if code == 404:
            return _row(absent, 404)
        if code is not None:
            error = f"HTTP {code}"
            if not any_error and code not in TRANSIENT:
                break
        if n < retries:
            sleep(wait(n))
    return _row("error", None, error=error)


class Pace:
    """Lets at most so many calls a second through."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.next = 1 / rate, clock, sleep, 0.0

    def __call__(self) -> None:
        now = self.clock()
        at = max(now, self.next)
        self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def fetch(plan: DataFrame, transport: Transport, now: str, retries: int = 2, wait: Callable[[int], float] = doubling, absent: str = "missing", any_error: bool = False, rate: float | None = None, workers: int = 6, check: Callable[[bytes], object] | None = None) -> DataFrame:
    """A row of SCHEMA for each of plan(card_id, url); now is the time that is written down.

    rate bounds the attempts a second of all tasks together: the plan is dealt to so many workers, each at its share.
    Bodies stay in the row; written as a table beside card_id and sha256 they are the image store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        pace = Pace(rate / workers) if rate else None

        def paced(url: str) -> tuple[int, bytes]:
            if pace:
                pace()
            return transport(url)

        for batch in batches:
            for i in range(0, batch.num_rows, 100):  # bodies are large
                part = batch.slice(i, 100)
                rows = [{"card_id": c, "fetched_at": now} | attempt_all(u, paced, retries, wait, absent, any_error, check=check) for c, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    jobs = plan.select("card_id", "url")
    return (jobs.repartition(workers) if rate else jobs).mapInArrow(run, SCHEMA)


def fetch_prices(plan: DataFrame, transport: Transport, now: str, retries: int = 2, **more) -> DataFrame:
    """fetch() by the rules of prices: any failure is tried again, with linear waits, and unknown cards are nodata."""
    return fetch(plan, transport, now, retries, linear, "nodata", True, check=json.loads, **more)
