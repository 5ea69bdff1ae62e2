"""URL filters: a memory-mapped file of sorted digests, probed by binary search for many URLs at once.

A rule is a host and the start of a path; it fits its host and all subdomains if the URL's path starts with the
rule's. The rules' file holds the sorted 64-bit digests of the rules, their verdicts and the rules
themselves. Spark sends it to every executor, new ones included, where all workers map the same copy.

For each URL the possible rules are its host and the ends of it after a dot, each with the starts of the path of
those lengths that some rule has. Their digests are searched in one vectorised pass, and a digest that is found
counts only if the stored rule is the same text. The longest rule wins, of equally long ones the one with the longer host.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which only rules with an empty host
fit; an empty table gives no rows; equal rows are judged alike; only the id and the URL are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import map_arrow, write_shared
from tarnlake.session import scratch_dir

# The rules of the registered query.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]
DEFAULT = "allow"
# The rules are built on the driver, up to so many bytes.
MOST_BYTES = 512 << 20
# Letters A to Z only; other letters keep their case.
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host, rest[:end]


def build(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file of the rules, sorted by digest. Of equal rules, ``block`` counts."""
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {verdict!r}")
        host, slash, path = rule.partition("/")
        rule = host.translate(_LOWER) + slash + path
        verdicts[rule] = "block" if "block" in (verdict, verdicts.get(rule)) else "allow"
    texts = [rule.encode() for rule in verdicts]
    digests = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.argsort(digests, kind="stable")
    texts = [texts[k] for k in order]
    blocks = np.array([v == "block" for v in verdicts.values()], np.uint8)[order]
    lengths = np.unique([len(rule) - rule.find("/") if "/" in rule else 0 for rule in verdicts]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<u8")
    longest = max((len(rule.partition("/")[0]) for rule in verdicts), default=0)
    return b"".join([np.array([len(texts), len(lengths), longest], "<u8").tobytes(), lengths.tobytes(),
                     digests[order].astype("<u8").tobytes(), offsets.tobytes(), blocks.tobytes(), *texts])


class RuleFile:
    """The mapped file; only the pages that searches touch are read."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k, self.longest = (int(x) for x in raw[:24].view("<u8"))
        self.lengths = raw[24:24 + 8 * k].view("<u8").tolist()
        at = 24 + 8 * k
        self.digests = raw[at:at + 8 * n].view("<u8")
        self.offsets = raw[at + 8 * n:at + 16 * n + 8].view("<u8")
        self.blocks = raw[at + 16 * n + 8:at + 17 * n + 8]
        self.texts = raw[at + 17 * n + 8:]

    def candidates(self, host: str, path: str) -> Iterator[str]:
        """The rules that would fit, the longest first; no host is tried that is longer than any rule's."""
        if len(host) > self.longest:
            # Domains begin after a dot; the first that is short enough.
            dot = host.find(".", len(host) - self.longest - 1)
            if dot < 0:
                return
            host = host[dot + 1:]
        hosts = [host]
        while "." in hosts[-1]:
            hosts.append(hosts[-1].partition(".")[2])
        starts = [path[:k] for k in self.lengths if k <= len(path)]
        yield from (h + p for h, p in sorted(
            ((h, p) for h in hosts for p in starts), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0]))))

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """Host, path, the rule that counts and its verdict, for each URL."""
        split = [parts(url) for url in urls]
        tried = [list(self.candidates(*x)) for x in split]
        flat = [rule.encode() for rules in tried for rule in rules]
        keys = np.fromiter((xxhash.xxh64_intdigest(t) for t in flat), np.uint64, len(flat))
        first = np.searchsorted(self.digests, keys, "left")
        last = np.searchsorted(self.digests, keys, "right")
        out, at = [], 0
        for (host, path), rules in zip(split, tried):
            found: tuple[str | None, str | None] = (None, None)
            for k, rule in enumerate(rules, at):
                same = [i for i in range(first[k], last[k])
                        if self.texts[int(self.offsets[i]):int(self.offsets[i + 1])].tobytes() == flat[k]]
                if same:
                    found = (rule, "block" if self.blocks[same[0]] else "allow")
                    break
            at += len(rules)
            out.append((host, path, *found))
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> RuleFile:
    return RuleFile(SparkFiles.get(name))


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write the rules' file to the shared folder and have every executor fetch it; its name there."""
    data = build(rules)
    if len(data) > MOST_BYTES:
        raise ValueError("too many rules for one file")
    name = f"rules-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, scratch_dir(spark, "url-rules", keep=True), name, data))
    return name


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every URL in ``pages`` (columns page_id and url)."""
    name = ship(pages.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = _opened(name).judge(batch.column("url").to_pylist())
            host, path, rule, verdict = (list(x) for x in zip(*judged)) if judged else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, pa.string()) for x in (host, path, rule)),
                 pa.array([v or default for v in verdict], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return map_arrow(
        pages.select(F.col("page_id").cast("long"), "url"), run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), f AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1
"""
