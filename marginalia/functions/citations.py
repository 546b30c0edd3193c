"""Numbers of an article's citations."""

from __future__ import annotations


class Citations:
    """Numbers references by first citation.

    As long as every newly cited reference is printed with its own place in the list, the list's order is kept: those
    before it, cited or not, get their numbers too. The first other one ends that for good. References that got no number
    are left out of the result.
    """

    def __init__(self, ids: list[str]) -> None:
        self.ids = ids
        self.first = {rid: i for i, rid in reversed(list(enumerate(ids)))}
        self.used: list[int] = []
        self.numbers: dict[str, int] = {}
        self.in_order = True

    def knows(self, rid: str | None) -> bool:
        return bool(rid) and rid in self.first

    def number(self, rid: str, printed: int | None) -> int | None:
        """The number of a citation; None if there is no such reference."""
        if rid in self.numbers:
            return self.numbers[rid]
        if rid not in self.first:
            return None
        place = self.first[rid]
        self.in_order = self.in_order and printed == place + 1
        for i in [*(range(len(self.used), place) if self.in_order else ()), place]:
            self.used.append(i)
            self.numbers.setdefault(self.ids[i], len(self.used))
        return self.numbers[rid]

    def id_of(self, number: int) -> str:
        return self.ids[self.used[number - 1]]
