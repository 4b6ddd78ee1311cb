"""URL filters by a sorted sweep over prefix intervals.

A rule names a host and the start of a path; it holds for the host and all its subdomains. Hosts are rewritten to
canonical keys with reversed labels (``www.example.org`` -> ``org.example.www.``), so that a host rule becomes the
interval of keys that begin with the rule's key. Keys and rules are sorted and merged in one sweep that keeps a stack
of the nested rules still open; under each host the same sweep runs over the paths of the rules that are open for it.

The sorted rules are a file that every executor gets once and every worker maps into memory: no worker holds them, and
the sweep passes over stretches of rules that cannot fit by a search, so rules may be of any number. Pages are judged where
they are, batch by batch; nothing is shuffled, so that a host may have any share of them.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, start of the path, verdict


def parse(rules: Iterable[tuple[str, str]]) -> list[Rule]:
    """(verdict, ``host/path``) pairs as rules; hosts are lower-cased A-Z, a rule without ``/`` holds for any path."""
    out = {}
    for verdict, text in rules:
        host, slash, path = text.partition("/")
        out[_lower(host), slash + path] = verdict
    return sorted((h, p, v) for (h, p), v in out.items())


def _lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def host_key(host: str) -> str:
    """Labels from the last to the first, each closed by a point."""
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Strings(Sequence):
    """A range of a mapped string column."""

    def __init__(self, column: pa.Array, first: int = 0, last: int | None = None):
        self.column, self.first = column, first
        self.size = (len(column) if last is None else last) - first

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k: int) -> str:
        return self.column[self.first + k].as_py()


def sweep(points: Iterable[str], starts: Sequence[str]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Each of the sorted points with those of the sorted starts that it begins with, shortest first: the start and the
    range of places at which it stands."""
    stack: list[tuple[str, int, int]] = []
    at, n = 0, len(starts)
    for p in points:
        while stack and not p.startswith(stack[-1][0]):
            stack.pop()
        while at < n and (s := starts[at]) <= p:
            if p.startswith(s):
                end = bisect_right(starts, s, at)
                stack.append((s, at, end))
                at = end
            else:
                # The next start that p can begin with agrees with p for one more character than this one does.
                at = bisect_left(starts, p[: len(os.path.commonprefix((s, p))) + 1], at)
        yield p, stack


class Rules:
    """Sorted rules: key, host, path and verdict as Arrow columns."""

    def __init__(self, table: pa.Table):
        self.keys, self.hosts, self.paths, self.verdicts = (table.column(c).combine_chunks() for c in ("key", "host", "path", "verdict"))
        if isinstance(self.keys, pa.ChunkedArray):
            self.keys, self.hosts, self.paths, self.verdicts = (pa.array([], pa.string()) for _ in range(4))

    def match(self, pairs: Iterable[tuple[str, str]]) -> dict[tuple[str, str], Rule]:
        """The longest fitting rule of each (host, path); ties go to the longer host."""
        paths: dict[str, set[str]] = {}
        for host, path in pairs:
            if host:
                paths.setdefault(host, set()).add(path)
        found: dict[tuple[str, str], Rule] = {}
        hosts = sorted((host_key(h), h) for h in paths)
        for (_, host), (_, stack) in zip(hosts, sweep((k for k, _ in hosts), Strings(self.keys)), strict=True):
            for _, first, last in stack:  # from the shortest host to the longest
                for path, fits in sweep(sorted(paths[host]), Strings(self.paths, first, last)):
                    if fits:
                        rules = [(self.hosts[k].as_py(), self.paths[k].as_py(), self.verdicts[k].as_py()) for k in range(first + fits[-1][1], first + fits[-1][2])]
                        best = max([*rules, *filter(None, [found.get((host, path))])], key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r))
                        found[host, path] = best
        return found


def rule_table(rules: Iterable[Rule]) -> pa.Table:
    """The rules in the order of the sweep; those without a host fit nothing and are left out."""
    rows = sorted({(host_key(h), p, v, h) for h, p, v in rules if h})
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(c, pa.string()) for c in columns], names=["key", "path", "verdict", "host"])


@lru_cache(maxsize=2)
def _mapped(path: str) -> Rules:
    return Rules(pa.ipc.open_file(pa.memory_map(path)).read_all())


def _ship(df: DataFrame, rules: Iterable[Rule]) -> str:
    """The name of a file of the rules that the driver serves to the executors."""
    folder = tempfile.mkdtemp(prefix="lacuna-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name, table = f"rules-{uuid.uuid4().hex}.arrow", rule_table(rules)
    with pa.OSFile(f"{folder}/{name}", "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max(1, len(table)))  # one batch, so that columns stay mapped
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_filter(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (``host/path`` of the longest fitting rule, else null), verdict (the rule's, else default).

    Defined cases: a null url or one without ``://`` has empty host and path and fits no rule; a rule without a host fits
    nothing; user and port count as part of the host, and so does a point at its end; repeated rows are each judged; empty
    tables and empty rule sets give their defined rows; other columns are ignored whatever their names; urls are read
    whole. No shuffle, and one method for any number of rules.
    """
    url = F.col("__url")
    host, path = host_and_path(url)
    cells = df.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host.alias("host"), path.alias("path"))
    file = _ship(df, rules)

    def judge(batches):
        known = _mapped(SparkFiles.get(file))
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            found = known.match(pairs)
            hits = [found.get(p) for p in pairs]
            names = pa.array([r and r[0] + r[1] for r in hits], pa.string())
            verdicts = pa.array([r[2] if r else default for r in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, verdicts], names=["__id", "host", "path", "rule", "verdict"])

    kind = cells.schema["__id"].dataType.simpleString()
    return cells.mapInArrow(judge, f"__id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("__id", id_col)
