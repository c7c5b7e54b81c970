"""Reachability over commit parents, and tumbling windows by count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreseek.sources.shared import Scratch


#: Rows that are broadcast to meet a table; more of them are sorted and merged, so the driver holds no part of a history.
FEW = 10_000


def _held(rows: DataFrame, many: int) -> DataFrame:
    return F.broadcast(rows) if many <= FEW else rows.hint("merge")


class _Walks:
    """Walks over one history, each without what those before it found.

    One parent of each commit (that of the least ordinal, else the least) makes a forest, whose links are doubled:
    link k leads 2**k commits back. A round takes link after link: with all ancestors less than 2**k commits back,
    link k gives those less than twice as far. It ends where a link leads to nothing new, as at a root or in a circle;
    then the walk crosses to the other parents. So the number of steps follows the logarithm of the generations and
    how deep branches are nested, and each commit is found once. Every step is a written table of at most two joins.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.scratch = Scratch(edges.sparkSession, "walk")
        known = edges.filter("child is not null and parent is not null and child <> parent")
        first = F.min(F.struct("ordinal", "parent")).getField("parent") if "ordinal" in edges.columns else F.min("parent")
        forest = self.scratch.table(known.groupBy("child").agg(first.alias("up")), "link-0")
        rest = known.join(forest.hint("merge"), (known.child == forest.child) & (known.parent == forest.up), "left_anti").select("child", "parent").distinct()
        self.rest = self.scratch.table(rest, "rest")
        self.straight, self.links, self.before = self.rest.isEmpty(), [forest], {}
        self.schema = forest.select(F.col("up").alias("commit")).schema

    def _link(self, k: int) -> DataFrame:
        if k == len(self.links):
            last = self.links[-1]
            longer = last.select("child", F.col("up").alias("by")).join(last.select(F.col("child").alias("by"), "up").hint("merge"), "by").select("child", "up")
            self.links.append(self.scratch.table(longer, f"link-{k}"))
        return self.links[k]

    def _read(self, parts: dict[str, int]) -> DataFrame:
        """Several tables by one scan."""
        return self.scratch.spark.read.schema(self.schema).parquet(*(f"{self.scratch.path}/{name}" for name in parts))

    def walk(self, tips: DataFrame) -> DataFrame:
        """(commit) of ``tips`` (commit) and all that they lead to."""
        no, rounds, steps = len(self.before), 0, 0
        found: dict[str, int] = {}  # rows of each table
        now: dict[str, int] = {}  # those of this round

        def add(commits: DataFrame) -> int:
            nonlocal steps
            steps += 1
            name, seen = f"found-{no}-{steps}", self.before | found
            if seen:
                commits = commits.join(_held(self._read(seen), sum(seen.values())), "commit", "left_anti")
            many = self.scratch.table(commits, name).count()
            if many or not found:
                found[name] = now[name] = many
            return many

        fresh = tips.select(F.col("commit").cast(self.schema["commit"].dataType).alias("commit")).filter("commit is not null").distinct()
        while add(fresh):
            k, more = 0, 1
            while more:
                met = self._link(k).join(_held(self._read(now), sum(now.values())), F.col("child") == F.col("commit"))
                k, more = k + 1, add(met.select(F.col("up").alias("commit")).distinct())
            if self.straight:
                break
            across = self.rest.join(_held(self._read(now), sum(now.values())), F.col("child") == F.col("commit"))
            fresh, rounds = across.select(F.col("parent").alias("commit")).distinct(), rounds + 1
            if len(found) > 30:
                merged = f"merged-{no}-{rounds}"
                self.scratch.table(self._read(found), merged)
                found = {merged: sum(found.values())}
            now = {}
        self.before |= found
        return self._read(found)

    def end(self) -> None:
        for name in ("rest", *(f"link-{k}" for k in range(len(self.links)))):
            self.scratch.drop(name)


def reachable(edges: DataFrame, tips: DataFrame) -> DataFrame:
    """(commit) reachable from ``tips`` (commit) over ``edges`` (child, parent[, ordinal])."""
    walks = _Walks(edges)
    found = walks.walk(tips)
    walks.end()
    return found


def commit_range(edges: DataFrame, ref: DataFrame, since: DataFrame) -> DataFrame:
    """Commits reachable from ``ref`` and not from ``since``: all parents of the latter are among them, so no way to the others leads through them."""
    walks = _Walks(edges)
    walks.walk(since)
    found = walks.walk(ref)
    walks.end()
    return found


def count_windows(rows: DataFrame, order: Column, n: int, within: list[str] | None = None) -> DataFrame:
    """``rows`` with window_no: each n rows, in order, make a window; the rest makes the last one.

    ``within`` names columns whose groups are windowed one by one. Rows are ranged by group and order and written;
    the sizes of a group's ranges give each range its first number, so a group of any size is numbered by many tasks.
    """
    if n < 1:
        raise ValueError(f"a window holds at least one row, not {n}")
    groups = list(within or [])
    ranged = rows.withColumn("_order", order).repartitionByRange(*groups, "_order").withColumn("_range", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "windows").table(ranged, "ranged")
    sizes = ranged.groupBy(*groups, "_range").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col("_range").alias("_r"), F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(groups)), F.col("_range") == F.col("_r"))
    number = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_order")) - 1 + F.col("_first")
    return ranged.join(firsts, same).withColumn("window_no", F.floor(number / n)).select(*rows.columns, "window_no")
