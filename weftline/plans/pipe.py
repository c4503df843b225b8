"""Typed stages: a stage names the columns it needs, and joining stages that don't fit fails before anything runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Stage:
    def __init__(self, needs: dict[str, str], f: Callable[[DataFrame], DataFrame], gives: dict[str, str] | None = None):
        self.needs, self.f, self.gives = needs, f, gives

    def __or__(self, other: Stage | None) -> Stage:
        if other is None:
            return self
        if self.gives is not None:
            misfit({n: t for n, t in self.gives.items()}, other.needs)
        return Stage(self.needs, lambda df: other(self(df)), other.gives)

    def __call__(self, df: DataFrame) -> DataFrame:
        misfit(dict(df.dtypes), self.needs)
        return self.f(df)


def misfit(has: dict[str, str], needs: dict[str, str]) -> None:
    wrong = [f"{n} {t} (there is {has.get(n, 'none')})" for n, t in needs.items() if has.get(n) != t]
    if wrong:
        raise TypeError("the stage needs " + ", ".join(wrong))
