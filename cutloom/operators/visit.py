"""Hooks of one's own over the adjacency records of each part, in order of their vertices."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from .metrics import adjacency


class Visitor(Protocol):
    """What is called for a part: once before its records, for each of them in order, and once after. Each returns rows of the result."""

    def before_refine(self, part: int) -> Iterable[tuple]: ...

    def refine(self, part: int, rank: int, nbrs: list[int]) -> Iterable[tuple]: ...

    def after_refine(self, part: int, n: int) -> Iterable[tuple]: ...


def visit_parts(edges: DataFrame, assignment: DataFrame, make: Callable[[], Visitor], schema: str) -> DataFrame:
    """Calls a new visitor for every part, over its records (rank, nbrs) by rank.

    The records of a part are read one by one, in a table function over the table partitioned by part and
    ordered by vertex; a visitor's memory is its own. A part without records is not visited.
    """

    class Visit:
        def __init__(self) -> None:
            self.visitor: Visitor | None = None
            self.part, self.n = 0, 0

        def eval(self, row):  # noqa: ANN001, ANN202
            if self.visitor is None:
                self.visitor, self.part = make(), row["part"]
                yield from self.visitor.before_refine(self.part)
            self.n += 1
            yield from self.visitor.refine(self.part, row["rank"], row["nbrs"])

        def terminate(self):  # noqa: ANN202
            if self.visitor is not None:
                yield from self.visitor.after_refine(self.part, self.n)

    records = adjacency(edges).join(assignment.withColumnRenamed("v", "rank"), "rank").select("part", "rank", "nbrs")
    return udtf(Visit, returnType=schema)(records.asTable().partitionBy("part").orderBy("rank"))
