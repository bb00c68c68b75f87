"""What a request would cost, and pages' sizes."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.scalars import ValueProblem, natural

#: Rows of a page: most, and where none are asked for. Neighbours of a vector: the same.
MAX_PAGE, DEFAULT_PAGE = 100, 100
MAX_NEIGHBOURS, DEFAULT_NEIGHBOURS = 100, 20
MAX_DEPTH = 5
_SIZES = ("limit", "first", "last")
_FREE = frozenset(["pageInfo", "totalCount", "aggregate"])


class TooCostly(ValueError):
    """A request beyond the limits."""


class BadWindow(ValueError):
    """Page arguments that contradict each other."""


@dataclass(frozen=True)
class Window:
    size: int
    backward: bool
    after: str | None
    before: str | None


def window(first: object = None, after: str | None = None, last: object = None, before: str | None = None, default: int = DEFAULT_PAGE, most: int = MAX_PAGE) -> Window:
    """Checked page arguments. Sizes over the most are cut to it; an empty cursor is none."""
    after, before = after or None, before or None
    if first is not None and last is not None:
        raise BadWindow("first and last exclude each other")
    if after is not None and before is not None:
        raise BadWindow("after and before exclude each other")
    if before is not None and last is None:
        raise BadWindow("before needs last")
    if last is not None and after is not None:
        raise BadWindow("last and after exclude each other")
    try:
        size = natural(last if last is not None else first if first is not None else default, "first" if last is None else "last")
    except ValueProblem as e:
        raise BadWindow(str(e)) from None
    return Window(min(size, most), last is not None, after, before)


@dataclass(frozen=True)
class Selection:
    """A selected field: its arguments, and what is selected under it."""

    name: str
    arguments: dict
    selections: tuple[Selection, ...] = ()

    def size(self, default: int) -> int:
        """How many items the field stands for: 1 unless a size is given."""
        for k in _SIZES:
            if k in self.arguments:
                v = self.arguments[k]
                return v if isinstance(v, int) and not isinstance(v, bool) and v >= 0 else default
        return 1

    def data(self) -> tuple[Selection, ...]:
        """What is selected of the items themselves: a connection's wrappers are seen through, and what costs nothing is left out."""
        if not {s.name for s in self.selections} & {"edges", "nodes", "pageInfo", "totalCount", "aggregate"}:
            return self.selections
        out: list[Selection] = []
        for s in self.selections:
            if s.name == "nodes":
                out += s.selections
            elif s.name == "edges":
                out += [x for e in s.selections if e.name == "node" for x in e.selections]
            elif s.name not in _FREE:
                out.append(s)
        return tuple(out)


@dataclass(frozen=True)
class Cost:
    depth: int
    rows: int
    complexity: int


def cost(s: Selection, default: int = DEFAULT_PAGE) -> Cost:
    """Depth counts levels below the root; rows and complexity multiply by the sizes on the way down."""
    n = s.size(default)
    below = [cost(x, default) for x in s.data()]
    if not below:
        return Cost(1, n, n)
    return Cost(1 + max(c.depth for c in below), n + n * sum(c.rows for c in below), 1 + n * sum(c.complexity for c in below))


@dataclass(frozen=True)
class Limits:
    """Zero is no limit."""

    depth: int = MAX_DEPTH
    rows: int = 0
    complexity: int = 0

    def check(self, s: Selection, default: int = DEFAULT_PAGE) -> Cost:
        c = cost(s, default)
        for what, got, most in (("depth", c.depth, self.depth), ("rows", c.rows, self.rows), ("complexity", c.complexity, self.complexity)):
            if most and got > most:
                raise TooCostly(f"{what} {got} is over {most}")
        return c
