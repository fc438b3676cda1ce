"""Allow and block rules on hosts and paths, joined with urls in a sorted sweep.

A host's key is its labels in reverse, each with a full stop: m.example.org is org.example.m. (canonical, so that a host
and all its subdomains are one interval of keys). Urls are range-partitioned and sorted by key; the sweep goes through
rules in the same order and keeps a stack of those whose interval holds the current key. Intervals of prefixes nest, so
the stack is the chain of the rule hosts above a url's host. A host's paths are intervals as well: the last one in order
that isn't after a url's path is found by bisection, and the chain of the paths around it leads to the longest that fits.
"""

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): the rules of the query, fixed values.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
#: Rules of one sweep; more are swept in so many blocks over the same sorted rows.
RULES_AT_ONCE = 100_000


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Paths:
    """The rules of one host: paths in order, each with the longest other one that is its prefix."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        best: dict[str, tuple] = {}
        for host, path, verdict in rules:
            best[path] = max(best.get(path, ()), (len(host) + len(path), f"{host}{path}", verdict))
        self.paths = sorted(best)
        self.rules = [best[p] for p in self.paths]
        self.around, stack = [], []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.around.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str):
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.around[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """One block of rules, swept in the order of keys."""

    def __init__(self, rules):
        by_key: dict[str, list] = {}
        for rule in rules:
            by_key.setdefault(key_of(rule[0]), []).append(rule)
        self.rules = {k: Paths(v) for k, v in by_key.items()}
        self.keys = sorted(self.rules)
        self.at, self.stack, self.began = 0, [], False

    def judge(self, key: str, path: str):
        """The longest rule that fits: (length, name, verdict), or None. Keys must not descend."""
        if not self.began:  # in the middle of all keys: rules that opened in earlier partitions are prefixes of this key
            self.began = True
            self.at = bisect_left(self.keys, key)
            parts = key.split(".")[:-1]
            self.stack = [k for i in range(len(parts)) if (k := "".join(f"{x}." for x in parts[: i + 1])) != key and k in self.rules]
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()
        while self.at < len(self.keys) and self.keys[self.at] <= key:
            if key.startswith(self.keys[self.at]):
                self.stack.append(self.keys[self.at])
            self.at += 1
        return max((x for k in self.stack if (x := self.rules[k].longest(path))), default=None)


def _sweeper(rules, default):
    def sweep(batches):
        blocks = [Sweep(rules[i : i + RULES_AT_ONCE]) for i in range(0, len(rules), RULES_AT_ONCE)]
        for batch in batches:
            names, verdicts = [], []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = [x for b in blocks if (x := b.judge(key, path))] if key else []
                best = max(found, default=None)
                names.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return sweep


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path, or null) and verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the longest wins, then the
    last in text order. No rule: the default. A null url, or one without ://, has empty host and path, which no rule
    fits. Rules are a list of the caller, so the driver's memory bounds them; they are swept in blocks. Rows are sorted by
    key, path and page_id, so the pages of a large host are dealt to many partitions. Rows that repeat are judged alike, a
    null page_id is kept, an empty table gives no rows, other columns are ignored.
    """
    reverse = F.concat(F.array_join(F.reverse(F.split(F.col("host"), r"\.")), "."), F.lit("."))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = rows.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(reverse))
    order = ["key", "path", "page_id"]
    swept = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return swept.mapInArrow(_sweeper(list(rules), default), "page_id long, host string, path string, rule string, verdict string")


def url_sql(table: str = "pages", rules=RULES, default: str = DEFAULT) -> str:
    """DuckDB SQL for op8's rows."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_no FROM {table}),
rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
fits AS (
  SELECT row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM parts LEFT JOIN fits USING (row_no)"""
