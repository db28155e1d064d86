"""URL filter by a sorted digest array."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.common import kept_bytes

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")
#: Rules of a list at most, some gigabyte in the driver.
MOST_RULES = 4_000_000
#: (verdict, host, path), the rule list of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    tail = rest[end:]
    return rest[:end].translate(_LOWER), tail[: m.start()] if (m := _PATH_END.search(tail)) else tail


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file of a rule list: count, number of path lengths, sorted digests, string offsets, verdicts, path lengths, strings.

    A key is host + path. Keys with one digest stand side by side; a probe compares the strings of all of them.
    Of repeated rules the last holds. A list of rules is held in the driver's memory; more than MOST_RULES are refused.
    """
    rules = list(islice(rules, MOST_RULES + 1))
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    last = {(h.translate(_LOWER) + p).encode(): (v, len(p.encode())) for v, h, p in rules}
    rows = sorted((xxhash.xxh64_intdigest(k), k, v == "block", n) for k, (v, n) in last.items())
    lengths = sorted({r[3] for r in rows})
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    parts = [
        np.array([len(rows), len(lengths)], "<u8"),
        np.array([r[0] for r in rows], "<u8"),
        offsets,
        np.array([r[2] for r in rows], "<u8"),
        np.array(lengths, "<u8"),
    ]
    return b"".join(p.tobytes() for p in parts) + b"".join(r[1] for r in rows)


class DigestArray:
    """A rule file, memory-mapped: pages are read as probes touch them and shared by a machine's workers."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = (int(x) for x in raw[:16].view("<u8"))
        take = lambda at, count: raw[at : at + 8 * count].view("<u8")
        self.keys, self.offsets, self.block = take(16, n), take(16 + 8 * n, n + 1), take(24 + 16 * n, n)
        self.lengths = [int(x) for x in take(24 + 24 * n, k)]
        self.strings = raw[24 + 24 * n + 8 * k :]

    def probe(self, candidates: Sequence[bytes]) -> np.ndarray:
        """The place of each candidate, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), "<u8", len(candidates))
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def text(self, j: int) -> str:
        return self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes().decode()


def judge(urls: Sequence[str | None], table: DigestArray) -> tuple[list, list, list, list]:
    """Host, path, rule and verdict of each url; the longest rule wins, of equally long ones that with the longer host."""
    split = [host_and_path(u) for u in urls]
    candidates, owner, rank = [], [], []
    for i, (host, path) in enumerate(split):
        whole, labels, at = path.encode(), host.encode(), 0
        paths = [whole[:n] for n in table.lengths if n <= len(whole)]
        while True:
            suffix = labels[at:]
            for p in paths:
                candidates.append(suffix + p)
                owner.append(i)
                rank.append((len(suffix) + len(p), len(suffix)))
            if (dot := labels.find(b".", at)) < 0:
                break
            at = dot + 1
    best: dict[int, tuple] = {}
    hits = table.probe(candidates)
    for c in np.flatnonzero(hits >= 0):
        if owner[c] not in best or rank[c] > best[owner[c]][0]:
            best[owner[c]] = (rank[c], int(hits[c]))
    rules = [table.text(best[i][1]) if i in best else None for i in range(len(split))]
    verdicts = ["block" if i in best and table.block[best[i][1]] else "allow" for i in range(len(split))]
    return [h for h, _ in split], [p for _, p in split], rules, verdicts


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    A null url, and one without "://", have an empty host and path. A url that no rule fits is allowed, rule null.
    Repeated rows are judged one by one; columns of pages named like an output give way to it; an empty table stays empty.
    The rule file is written to the shared folder and goes to every machine by addFile, so executors that start later fetch it too.
    """
    blob = build(rules)
    name = f"urls-{hashlib.sha256(blob).hexdigest()[:24]}.digests"
    context = pages.sparkSession.sparkContext
    if not any(f.endswith(f"/{name}") for f in context.listFiles):
        context.addFile(kept_bytes(pages.sparkSession, blob, name))
    outputs = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in outputs]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in outputs])

    def run(batches):
        table = DigestArray(SparkFiles.get(name))
        for batch in batches:
            made = judge(batch.column("__url").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x, pa.string()) for x in made], [*kept, *outputs])

    return pages.select(*kept, pages[url].alias("__url")).mapInArrow(run, schema)
