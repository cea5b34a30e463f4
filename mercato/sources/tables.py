"""The star schema every operator reads: eight source tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace
from functools import partial, reduce

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """customers C, orders O, order items I, payments P, reviews R,
    products PR, category translation T, sellers S."""

    customers: DataFrame
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    translation: DataFrame
    sellers: DataFrame

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def with_(self, **frames: DataFrame) -> "Tables":
        """Copy with some tables swapped (e.g. silver items for raw ones)."""
        return replace(self, **frames)


class LazyTables:
    """A bundle whose tables are made when first asked for.

    Offers what :class:`Tables` offers.  It may also hold derived tables
    under further names; ``names`` tells which.
    """

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def names(self) -> list[str]:
        return list(self._makers)

    @classmethod
    def of_parts(cls, parts: Sequence["LazyTables"], shared: "LazyTables") -> "LazyTables":
        """A bundle whose facts are cut into ``parts`` that share no order (kept as
        ``parts``); each fact is the union of its parts, all else comes from ``shared``.
        A copy with other tables has no parts."""
        def whole(name: str) -> DataFrame:
            return reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

        facts = {n for p in parts for n in p.names()}
        bundle = cls({n: partial(getattr, shared, n) for n in shared.names() if n not in facts}
                     | {n: partial(whole, n) for n in facts})
        bundle.parts = [LazyTables({n: partial(getattr, bundle, n) for n in bundle.names()
                                    if n not in facts}
                                   | {n: partial(getattr, p, n) for n in p.names()})
                        for p in parts]
        return bundle

    def with_(self, **frames: DataFrame) -> "LazyTables":
        own = {n: partial(getattr, self, n) for n in self._makers}
        return LazyTables(own | {n: (lambda f=f: f) for n, f in frames.items()})

    def deriving(self, **makers: Callable[[], DataFrame]) -> "LazyTables":
        """Copy with further tables, or other makers of the same."""
        return LazyTables({n: partial(getattr, self, n) for n in self._makers} | makers)
