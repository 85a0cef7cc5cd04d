"""Passes over several sources: retries with growing waits, a time limit, and no source that stops another."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import FIRST_WAIT_S, LONGEST_WAIT_S

FORCED = {"manual", "foreground", "settings"}  # reasons that don't wait for the end of a backoff
REFRESH_S = 4 * 3600  # a refresh in the background comes at most so often


def wait_after(failures: int) -> int:
    """Seconds until the next attempt after so many failures in a row."""
    return min(LONGEST_WAIT_S, FIRST_WAIT_S * 2 ** max(0, min(failures, 30) - 1)) if failures > 0 else 0


class Supervisor:
    """Runs the query of each source; a failed one waits, the others go on.

    Sources of a pass run side by side, ``together`` at a time. Passes follow one another: ``run`` is not for several
    threads. A source fails with any exception, whatever it is.
    """

    def __init__(self, starts: dict[str, Callable[[], StreamingQuery]], clock: Callable[[], float] = time.monotonic, together: int = 4) -> None:
        self.starts, self.clock, self.together = starts, clock, together
        self.failures = dict.fromkeys(starts, 0)
        self.due = dict.fromkeys(starts, 0.0)
        self.refreshed: float | None = None

    def _one(self, name: str, limit_s: float) -> str:
        query = None
        try:
            query = self.starts[name]()
            return "done" if query.awaitTermination(limit_s) else "timeout"
        except Exception:  # what ends one source must not end the pass
            return "failed"
        finally:
            if query is not None and query.isActive:
                query.stop()

    def run(self, reason: str = "background", limit_s: float = 25.0) -> dict[str, str]:
        """One pass: for each source done, failed, waiting or timeout; nothing for a refresh that comes too early."""
        now = self.clock()
        if reason == "refresh":
            if self.refreshed is not None and now < self.refreshed + REFRESH_S:
                return {}
            self.refreshed = now
        ready = [n for n in self.starts if reason in FORCED or now >= self.due[n]]
        out = {n: "waiting" for n in self.starts if n not in ready}
        with ThreadPoolExecutor(max(1, min(self.together, len(ready)))) as pool:
            out |= dict(zip(ready, pool.map(lambda n: self._one(n, limit_s), ready), strict=True))
        for name in ready:
            self.failures[name] = self.failures[name] + 1 if out[name] == "failed" else 0
            self.due[name] = self.clock() + wait_after(self.failures[name])
        return {n: out[n] for n in self.starts}
