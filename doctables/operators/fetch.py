"""Fetching documents. The client is the caller's: ``fetch(url) -> bytes``, raising on failure.

A task has several requests in flight, few of them to one host (``functions.polite``); a client that
must not be called from several threads needs ``Politeness(in_flight=1)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions import urls
from doctables.functions.batches import batched
from doctables.functions.polite import Politeness, in_order

_FETCHED = [
    T.StructField("content", T.BinaryType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
]


def _host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc
    except ValueError:
        return ""


def _outcome(fetch: Callable[[str], bytes], url: str) -> tuple:
    """Content, size, status and reason."""
    try:
        data = fetch(url)
        return data, len(data), "ok", None
    except Exception as e:  # noqa: BLE001 - recorded and skipped, the job goes on
        return None, None, "error", f"{type(e).__name__}: {e}"


def fetch_documents(
    plan: DataFrame, fetch: Callable[[str], bytes], tasks: int, tasks_per_host: int = 4, polite: Politeness = Politeness()
) -> DataFrame:
    """Fetch every ``link_url`` of a plan; a failure is a row with ``status='error'``.

    Links of one host go to at most ``tasks_per_host`` tasks: few enough to be polite, more than
    one so that a host with most of the links does not become one task. The slice of a host is a
    hash of the link, the same on every retry. ``tasks`` is explicit because plan rows are tiny.
    """
    keys = plan.columns
    url_at = keys.index("link_url")
    schema = T.StructType(list(plan.schema.fields) + _FETCHED)
    slice_of_host = F.pmod(F.xxhash64("link_url"), F.lit(tasks_per_host))
    spread = plan.repartition(tasks, urls.authority(F.col("link_url")), slice_of_host)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planned = (row for frame in frames for row in frame.itertuples(index=False, name=None))
        fetched = in_order(planned, lambda row: _host(row[url_at]), lambda row: _outcome(fetch, row[url_at]), polite)
        rows = ((*row, *outcome) for row, outcome in fetched)
        for out in batched(rows, schema.names, lambda row: row[len(keys) + 1] or 0):
            yield out.astype({"n_bytes": "Int64", "content": object, "reason": object})

    return spread.mapInPandas(run, schema)


def fetch_with_fallback(
    candidates: DataFrame, fetch: Callable[[str], bytes], tasks: int, tasks_per_host: int = 4, polite: Politeness = Politeness()
) -> DataFrame:
    """Fetch each publication's links in their order until one succeeds or none is left.

    ``candidates`` has a row per link (``candidate_links``) or lists (``download_candidates``).
    One row per attempt with ``attempt`` from 1; the last one of a publication is ``ok`` unless all
    its links failed. A publication's rows are sorted in one task and stream through it, so their
    number is not limited; several publications are under way at once, each with one request.
    Publications are spread like links in ``fetch_documents``, by the host of the first link.
    """
    if "links" in candidates.columns:
        listed = candidates.select("publication_id", "file_path", F.posexplode("links"), F.col("links")[0]["link_url"].alias("first_url"))
        candidates = listed.select("publication_id", "file_path", "col.*", (-F.col("pos")).alias("position"), "first_url")
    slice_of_host = F.pmod(F.xxhash64("publication_id"), F.lit(tasks_per_host))
    spread = candidates.repartition(tasks, urls.authority(F.col("first_url")), slice_of_host)
    ordered = spread.sortWithinPartitions("publication_id", F.desc("position"), F.desc("link_url"))
    rows_of = ordered.select("publication_id", "file_path", "link_pos", "link_url")
    keys = [candidates.schema["publication_id"], candidates.schema["file_path"]]
    own = [
        T.StructField("attempt", T.IntegerType()),
        T.StructField("link_pos", T.IntegerType()),
        T.StructField("link_url", T.StringType()),
    ]
    schema = T.StructType(keys + own + _FETCHED)

    def publication_of(row: tuple) -> tuple:
        return () if row[0] is None or row[0] != row[0] else (row[0],)  # nulls can come as NaN

    def attempts(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, n = None, 0
        tried = in_order(
            rows, lambda row: _host(row[3]), lambda row: _outcome(fetch, row[3]), polite, publication_of, lambda outcome: outcome[2] == "ok"
        )
        for row, outcome in tried:
            n = n + 1 if publication_of(row) == last else 1
            last = publication_of(row)
            yield *row[:2], n, *row[2:], *outcome

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = attempts(row for frame in frames for row in frame.itertuples(index=False, name=None))
        for out in batched(rows, schema.names, lambda row: row[6] or 0):
            yield out.astype({"n_bytes": "Int64", "content": object, "reason": object})

    return rows_of.mapInPandas(run, schema)
