"""Expanded codes: all codes below some roots of a code hierarchy (inventory P5).

The hierarchy is a table of (parent, child) edges of any size, depth and
shape: a code may have several parents, and edges may run in circles. The
codes below a root are found a level at a time by joins; a code that a root has
reached is not followed again, so circles end. Each level is written, so it is
computed once and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.plans.criteria import Leaf
from cohortfold.session import delete_path, write_intermediate


class CodeHierarchy:
    """(parent, child) edges between codes; both are taken as text, NULLs are no edge."""

    def __init__(self, edges: DataFrame, parent: str = "parent", child: str = "child"):
        named = edges.select(F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child"))
        self.edges = named.where("parent IS NOT NULL AND child IS NOT NULL")
        self._release: list[Callable[[], None]] = []

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = write_intermediate(df, name)
        self._release.append(lambda: delete_path(df.sparkSession, path))
        return out

    def expand(self, roots: DataFrame) -> DataFrame:
        """(group, code): for ``roots`` (group, code), every code at or below one of a group's roots.

        A root that no edge names stands for itself alone. As many rounds as
        the hierarchy is deep below the roots.
        """
        known = frontier = self._written(roots.select("group", F.col("code").cast("string").alias("code")).where("code IS NOT NULL").distinct(), "codes_0")
        depth = 0
        while not frontier.isEmpty():
            depth += 1
            below = frontier.join(self.edges, F.col("code") == F.col("parent")).select("group", F.col("child").alias("code")).distinct()
            frontier = self._written(below.join(known, ["group", "code"], "left_anti"), f"codes_{depth}")
            known = known.unionByName(frontier)
        return known

    def leaves(self, spark: SparkSession, entity_type: str, roots: Mapping[str, Sequence[str]], code_column: str = "code") -> list[Leaf]:
        """A leaf for each uid, that takes every record whose code is at or below one of its ``roots``."""
        rows = [(uid, code) for uid, codes in roots.items() for code in codes]
        expanded = self.expand(spark.createDataFrame(rows, "group string, code string"))
        return [Leaf(uid, entity_type, code_table=expanded.where(F.col("group") == uid).select("code"), code_column=code_column) for uid in roots]

    def release(self) -> None:
        """Delete the written levels; leaves made from them are of no use then."""
        while self._release:
            self._release.pop()()
