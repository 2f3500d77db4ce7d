"""Registry helpers: each entry pairs a Spark job over the given tables with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a Spark job and, where SQL can express it, the SQL that must give the same rows."""

    def add(job: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return add


@dataclass(frozen=True)
class Spec:
    """Named SQL expressions.  Text form: one ``kind NAME = expression`` per line.

    Kinds: ``i`` bigint, ``f`` double rounded to six digits, ``t`` as is.
    """

    items: tuple[tuple[str, str, str], ...]

    @classmethod
    def parse(cls, text: str) -> Spec:
        items = []
        for line in text.strip().splitlines():
            line = line.strip()
            if not line or line.startswith("--"):
                continue
            head, expr = line.split(" = ", 1)
            kind, name = head.split()
            items.append((kind, name, expr))
        return cls(tuple(items))

    def select(self) -> str:
        """Raw expressions, for an inner query."""
        return ",\n    ".join(f"{expr} AS {name}" for _, name, expr in self.items)

    def present(self, prefix: str = "") -> str:
        """Typed and rounded references, for the outermost query."""
        return ",\n    ".join(present(kind, f"{prefix}{name}", name) for kind, name, _ in self.items)


def present(kind: str, expr: str, name: str) -> str:
    if kind == "i":
        return f"CAST({expr} AS BIGINT) AS {name}"
    if kind == "f":
        return f"{r6(expr)} AS {name}"
    return f"{expr} AS {name}"


def r6(expr: str) -> str:
    """The rounding of ``functions.expressions.tidy`` in SQL."""
    value = f"CAST({expr} AS DOUBLE)"
    return f"round({value} * 1e6 + 0.0001e0) / 1e6"
