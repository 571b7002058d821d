"""URL rules by a sorted range join: prefixes become intervals, a sweep keeps a stack of open rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import given_back, renamed, without

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a dot.

    A host and its subdomains are then the keys from `key` up to `key` with its last dot replaced
    by the next character, a slash: one interval per rule, nested or apart, never crossing.
    """
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Scope:
    """Rules of one host, with the chain of longer to shorter paths that start each other."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.paths: list[str] = []
        self.verdicts: dict[str, str] = {}

    def add(self, path: str, verdict: str) -> None:
        """Paths come in order; of two verdicts for one rule, block wins."""
        if path not in self.verdicts:
            self.paths.append(path)
            self.verdicts[path] = verdict
        elif verdict == "block":
            self.verdicts[path] = verdict

    def longest(self, path: str) -> str | None:
        """Longest rule path that `path` starts with: step back from its place in the order."""
        probe, paths = path, self.paths
        while paths:
            at = bisect_right(paths, probe)
            if not at:
                return None
            found = paths[at - 1]
            if path.startswith(found):
                return found
            common = 0
            while common < min(len(found), len(path)) and found[common] == path[common]:
                common += 1
            probe = path[:common]
        return None


def sweep(batches: Iterator[pa.RecordBatch], names: list[str], default: str) -> Iterator[pa.RecordBatch]:
    """Go over the sorted rows of a partition; open rules are a stack of nested hosts."""
    stack: list[Scope] = []
    n = len(names) - 2
    for batch in batches:
        keys, kinds = batch.column("_key").to_pylist(), batch.column("_kind").to_pylist()
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        verdicts = batch.column("_verdict").to_pylist()
        pages, rules, decided = [], [], []
        for i, key in enumerate(keys):
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kinds[i] == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Scope(key, hosts[i]))
                stack[-1].add(paths[i], verdicts[i])
                continue
            rule, verdict = None, default
            for scope in reversed(stack):
                found = scope.longest(paths[i])
                if found is not None and (rule is None or len(scope.host) + len(found) > len(rule)):
                    rule, verdict = scope.host + found, scope.verdicts[found]
            pages.append(i)
            rules.append(rule)
            decided.append(verdict)
        if pages:
            kept = batch.take(pa.array(pages, pa.int64()))
            columns = [kept.column(c) for c in names[:n]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rules, pa.string()), pa.array(decided, pa.string())], names=names)


def split_points(keys: DataFrame, parts: int, per_part: int = 20) -> list[str]:
    """Keys that cut the rows into even parts, from a random sample of a bounded number of rows.

    As in a range partitioning, they decide where rows are worked on and not what comes out.
    """
    total = keys.count()
    if parts < 2 or not total:
        return []
    drawn = keys.sample(min(1.0, parts * per_part / total), seed=7).orderBy("_key").limit(2 * parts * per_part)
    values = [r["_key"] for r in drawn.collect()]
    return [values[len(values) * i // parts] for i in range(1, parts)] if values else []


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", parts: int | None = None,
) -> DataFrame:
    """Add host, path, rule and verdict to every page.

    `rules` has verdict, host and path. A rule fits its host and all subdomains if the page's path
    starts with the rule's; the longest text of host and path wins, of equal ones the longer host.
    Equal rules with both verdicts block; rules with a null field are left out. Pages and rules are
    dealt by key ranges; a rule goes to each range its interval touches, and equal keys that fill
    several ranges are spread over them, so one host may hold any share of the pages. A task holds
    the stack of open rules and one batch. Null URLs and URLs without :// have empty host and path
    and get `default`, unless a rule has an empty host. Very long URLs are rows like others; repeated rows
    are judged each; an empty table stays empty. Columns of the added names are replaced, others stay.
    """
    spark, added = pages.sparkSession, ["host", "path", "rule", "verdict"]
    base, names_given = renamed(without(pages, added), keep=("page_id", url))
    located = base.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).withColumn(
        "_key", host_key(F.col("host")))
    wanted = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = split_points(located.select("_key"), wanted)
    bounds = F.array(*[F.lit(p) for p in points]) if points else F.array().cast("array<string>")
    below = lambda key: F.size(F.filter(bounds, lambda b: b < key))
    up_to = lambda key: F.size(F.filter(bounds, lambda b: b <= key))
    low, high = below(F.col("_key")), up_to(F.col("_key"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in base.columns if c in ("page_id", url)]), high - low + 1)
    dealt = located.withColumns({
        "_part": (low + salt).cast("int"), "_kind": F.lit(1), "_verdict": F.lit(None).cast("string")})

    scoped = rules.select("host", "path", F.col("verdict").alias("_verdict")).dropna().distinct()
    scoped = scoped.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn(
        "_key", host_key(F.col("host")))
    end = F.concat(F.expr("left(_key, length(_key) - 1)"), F.lit("/"))
    opened = scoped.withColumn("_part", F.explode(F.sequence(below(F.col("_key")), up_to(end)))).withColumn(
        "_kind", F.lit(0))
    both = dealt.unionByName(opened, allowMissingColumns=True)
    ranged = both.repartition(len(points) + 1, "_part").sortWithinPartitions("_part", "_key", "_kind", "path")
    names = [*base.columns, "host", "path", "rule", "verdict"]
    fields = ", ".join(f"{'`' + f.name + '`'} {f.dataType.simpleString()}" for f in base.schema)
    schema = f"{fields}, host string, path string, rule string, verdict string"
    judged = ranged.mapInArrow(lambda batches: sweep(batches, names, default), schema)
    return given_back(judged, names_given, added)
