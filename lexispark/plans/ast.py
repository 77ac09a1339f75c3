"""The query algebra. Nodes are plain values; `compile` turns a tree into one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field


class Query:
    def __and__(self, other: Query) -> Bool:
        return Bool(must=(self, other))

    def __or__(self, other: Query) -> Bool:
        return Bool(should=(self, other))


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str


@dataclass(frozen=True)
class Prefix(Query):
    """Any term that begins so; scores 1."""

    field: str
    prefix: str


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within `max_edits` of the term that share its first characters, the nearest `max_expansions` of them.

    With transpositions a swap of neighbours is one edit.
    """

    field: str
    term: str
    max_edits: int = 2
    prefix_length: int = 3
    max_expansions: int = 50
    transpositions: bool = True


@dataclass(frozen=True)
class Phrase(Query):
    """Terms in order, with up to `slop` moves in all."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class Range(Query):
    """Values between low and high, None being open; scores 1."""

    field: str
    low: float | None = None
    high: float | None = None
    include_low: bool = False
    include_high: bool = False


@dataclass(frozen=True)
class In(Query):
    """A keyword field's value, or one of its items if it is multi-valued, is one of these; scores 1."""

    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Bool(Query):
    """must and filter clauses all hold, of should clauses at least `minimum`; scores of must and should add up."""

    should: tuple[Query, ...] = ()
    must: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    minimum: int | None = None

    def needed(self) -> int:
        if self.minimum is not None:
            return self.minimum
        return 0 if self.must or self.filter or not self.should else 1


@dataclass(frozen=True)
class DisMax(Query):
    """Any clause; the score is the greatest, and `tie` times the others."""

    clauses: tuple[Query, ...] = ()
    tie: float = 0.0


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    reason: str = field(default="", compare=False)


def current_minimum(n: int) -> int:
    """All of up to five clauses, else all but one."""
    return n if n <= 5 else n - 1


def legacy_minimum(n: int) -> int:
    """All of up to five, all but two of up to eight, else four fifths, halves up."""
    return n if n <= 5 else n - 2 if n <= 8 else (8 * n + 5) // 10
