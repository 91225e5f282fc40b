"""A small runner for job graphs: order, retries, inactive jobs, blocked dependants."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from graphlib import TopologicalSorter


@dataclass
class Job:
    name: str
    run: Callable[[], object]
    after: list[str] = field(default_factory=list)
    retries: int = 0
    sla_seconds: float | None = None
    timeout: float | None = None
    active: bool = True


@dataclass
class Outcome:
    status: str
    seconds: float = 0.0
    detail: str = ""
    sla_missed: bool = False


def _within(job: Job) -> None:
    if job.timeout is None:
        job.run()
        return
    pool = ThreadPoolExecutor(1)
    try:
        pool.submit(job.run).result(job.timeout)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def run(jobs: list[Job], alert: Callable[[str], None] = lambda _: None) -> dict[str, Outcome]:
    """Run jobs after those that they need. What follows a failed job is BLOCKED; inactive jobs count as passed over.

    A dependency that is not listed is an error. A job over its ``timeout`` is FAILED without a further try, though what it has
    begun on the cluster ends by itself.
    """
    by_name, out = {j.name: j for j in jobs}, {}
    if absent := sorted({a for j in jobs for a in j.after} - by_name.keys()):
        raise ValueError(f"no such job: {', '.join(absent)}")
    for name in TopologicalSorter({j.name: j.after for j in jobs}).static_order():
        j = by_name[name]
        if not j.active:
            out[name] = Outcome("INACTIVE")
            continue
        if any(out[a].status in ("FAILED", "BLOCKED") for a in j.after if a in out):
            out[name] = Outcome("BLOCKED")
            continue
        began = time.monotonic()
        for attempt in range(j.retries + 1):
            try:
                _within(j)
                out[name] = Outcome("DONE")
                break
            except TimeoutError:
                out[name] = Outcome("FAILED", detail=f"over {j.timeout:g} s")
                break
            except Exception as e:  # a job may fail in any way; the others still run
                out[name] = Outcome("FAILED", detail=f"{type(e).__name__}: {e}"[:300])
        out[name].seconds = time.monotonic() - began
        out[name].sla_missed = j.sla_seconds is not None and out[name].seconds > j.sla_seconds
        if out[name].status == "FAILED" or out[name].sla_missed:
            alert(f"{name}: {out[name].status} after {out[name].seconds:.0f} s {out[name].detail}")
    return out
