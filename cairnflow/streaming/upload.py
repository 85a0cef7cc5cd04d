"""Batches sent to a receiver: a sink that stops at the first failure, so that the same batch is sent again."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Seconds of a request, bytes of an answer that are kept.
TIMEOUT_S, SNIPPET = 30, 300


@dataclass(frozen=True)
class Sent:
    """What came of a request: status (0 if there was no answer), the beginning of the answer, and seconds."""

    status: int
    snippet: str
    duration_s: float

    @property
    def is_success(self) -> bool:
        return 200 <= self.status < 300


def send(body: bytes, url: str, token: str | None = None, timeout_s: float = TIMEOUT_S) -> Sent:
    """Sends a JSON body gzipped. A refused or broken connection is a failure like any other status."""
    head = {"Content-Type": "application/json", "Content-Encoding": "gzip"}
    if token:
        head["Authorization"] = f"Bearer {token}"
    began = time.monotonic()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, gzip.compress(body), head, method="POST"), timeout=timeout_s) as answer:
            status, text = answer.status, answer.read(SNIPPET)
    except urllib.error.HTTPError as x:
        status, text = x.code, x.read(SNIPPET)
    except (urllib.error.URLError, OSError) as x:
        status, text = 0, str(x).encode()[:SNIPPET]
    return Sent(status, text.decode("utf-8", "ignore"), time.monotonic() - began)


class Refused(RuntimeError):
    """A batch that the receiver didn't take."""


def uploading(url: str, token: str | None = None, order: str = "batch_seq", post: Callable[..., Sent] = send) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: sends the rows (``order``, body text) of a micro-batch one by one in order.

    The first failure raises, which stops the query; its checkpoint stays before the batch, so all of it is sent again,
    and the receiver drops what it has by its ids. Rows come to the driver one at a time. Null bodies are left out.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        for row in rows.where("body is not null").select(order, "body").orderBy(order).toLocalIterator():
            sent = post(row["body"].encode(), url, token)
            if not sent.is_success:
                raise Refused(f"batch {row[order]} of micro-batch {batch_id}: status {sent.status}, {sent.snippet[:120]}")

    return run
