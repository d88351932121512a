"""Runs of registered strategies over a table, with progress callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Strategies:
    """Named ways to produce a table from another. A strategy is a function of a DataFrame; what it needs before and after
    a run are two optional functions without arguments. Names are unique and keep their order."""

    def __init__(self):
        self.known: dict[str, tuple[Callable, Callable | None, Callable | None]] = {}

    def add(self, name: str, run: Callable[[DataFrame], DataFrame], before: Callable | None = None, after: Callable | None = None) -> None:
        if name in self.known:
            raise ValueError(f"strategy {name} is known")
        self.known[name] = (run, before, after)

    def run(self, rows: DataFrame, names: list[str] | None = None, progress: Callable[[int, int, str], None] | None = None) -> DataFrame:
        """The union of the strategies' results with a column `strategy`. progress(done, of, name) is called before each
        strategy and once at the end. What `after` cleans up must not be what the lazy result still reads."""
        chosen = list(self.known) if names is None else [n for n in names if n in self.known]
        out = None
        for i, name in enumerate(chosen):
            make, before, after = self.known[name]
            if progress:
                progress(i, len(chosen), name)
            if before:
                before()
            try:
                one = make(rows).withColumn("strategy", F.lit(name))
            finally:
                if after:
                    after()
            out = one if out is None else out.unionByName(one)
        if progress:
            progress(len(chosen), len(chosen), "")
        if out is None:
            raise ValueError("no strategy to run")
        return out
