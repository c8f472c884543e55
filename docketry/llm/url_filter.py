"""URL rules in a sorted digest array.

Rules are strings ``host/path``. Their 64-bit xxhash keys are sorted and memory-mapped by
the tasks; a url probes the array with every domain suffix of its host, joined with the
leading parts of its path that have the length of some rule's path, in one binary search
per batch. A hit counts only if the stored string equals the probed one, so colliding
digests never decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.shipping import mapped, ship_arrays

#: Digests, strings and verdicts together, as sent to every executor.
MAX_BYTES = 1 << 30


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def digest_arrays(rules: Iterable[Rule]) -> dict[str, np.ndarray]:
    """Keys in order with the strings they stand for; equal rules count once, the first wins."""
    unique = {r.host + r.path: r for r in reversed(list(rules))}
    texts = [t.encode() for t in unique]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.argsort(keys, kind="stable")
    ordered = [texts[i] for i in order]
    listed = list(unique.values())
    chosen = [listed[i] for i in order]
    return {
        "keys": keys[order],
        "ends": np.cumsum([len(t) for t in ordered] or [0]).astype(np.int64),
        "strings": np.frombuffer(b"".join(ordered) or b"\0", np.uint8),
        "allow": np.array([r.verdict == "allow" for r in chosen], np.uint8),
        "path_sizes": np.unique(np.array([len(r.path) for r in chosen], np.int64)),
    }


def _suffixes(host: str) -> list[str]:
    found, at = [host], host.find(".")
    while at >= 0:
        found.append(host[at + 1:])
        at = host.find(".", at + 1)
    return found


def _judge(hosts: list[str], paths: list[str], table: dict[str, np.ndarray]) -> tuple[list[str | None], list[str | None]]:
    """Longest matching rule of each url and its verdict, or nulls."""
    sizes = table["path_sizes"].tolist()
    owner: list[int] = []
    probes: list[bytes] = []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for suffix in _suffixes(host):
            for size in sizes:
                if size <= len(path):
                    owner.append(i)
                    probes.append((suffix + path[:size]).encode())
    best: list[tuple[int, str, bool] | None] = [None] * len(hosts)
    keys = table["keys"]
    if probes and len(keys):
        wanted = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        ends, strings = table["ends"], table["strings"]
        for j in np.flatnonzero(high > low):
            for k in range(int(low[j]), int(high[j])):
                start = int(ends[k - 1]) if k else 0
                if strings[start:int(ends[k])].tobytes() == probes[j]:
                    i, text = owner[j], probes[j].decode()
                    if best[i] is None or len(text) > best[i][0]:
                        best[i] = (len(text), text, bool(table["allow"][k]))
    rules = [b and b[1] for b in best]
    return rules, [None if b is None else "allow" if b[2] else "block" for b in best]


def url_filter(pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end. Both are empty for a null url or one
    without ``://``; those and all urls that no rule fits get ``otherwise``. Of fitting
    rules the longest wins. Repeated pages are judged one by one, an empty table gives no
    rows, no rules give ``otherwise`` for all. Rules travel to every executor and are
    refused beyond ``MAX_BYTES``.
    """
    names = ship_arrays(pages.sparkSession, "urls", digest_arrays(rules), MAX_BYTES)
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    parsed = pages.select(F.col(id_col).alias("page_id"), lowered.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = mapped(names)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = _judge(hosts, paths, table)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(rule, pa.string()), pa.array([v or otherwise for v in verdict], pa.string()),
            ], names=["page_id", "host", "path", "rule", "verdict"])

    kind = dict(parsed.dtypes)["page_id"]
    return parsed.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
