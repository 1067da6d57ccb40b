"""Counts of the stages of a run, taken by Spark while it computes them: no clocks around actions, no counting jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Stages:
    """Watches DataFrames by name. What is watched has to be computed in full by some action before its counts are asked for.

    The counts are those of the first action over a watched DataFrame; an action that takes only some rows counts only those that it
    came by. A task that runs again after a loss counts once.
    """

    def __init__(self):
        self.watched: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, **conditions: Column) -> DataFrame:
        """The same rows; counted are all rows and those that meet each condition (a null is no)."""
        if name in self.watched:
            raise ValueError(f"stage {name} is watched already")
        self.watched[name] = Observation(name)
        return df.observe(self.watched[name], F.count(F.lit(1)).alias("rows"), *(F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()))

    def counts(self, name: str) -> dict[str, int]:
        """rows and the conditions' counts. Waits for the first action if there was none yet."""
        return dict(self.watched[name].get)

    def report(self) -> dict[str, dict[str, int]]:
        return {name: self.counts(name) for name in self.watched}


def watch_recalculation(stages: Stages, result: DataFrame, name: str = "recalculate") -> DataFrame:
    """Watches what ``recalculate`` returns: rows, errors, texts, blanks, and cells whose number is another one than before."""
    moved = ~F.col("new").eqNullSafe(F.col("old"))
    return stages.watch(name, result, errors=F.col("kind") == "e", texts=F.col("kind") == "t", blanks=F.col("kind") == "z", moved=moved)
