"""A parsed query: groups of keywords joined by OR, exclusions, filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field


def distinct(items: Iterable[str]) -> list[str]:
    """Without repetitions, in the order of first occurrence."""
    return list(dict.fromkeys(items))


@dataclass
class KeywordGroup:
    """All of its clauses must hold: title terms in the title, content terms anywhere."""

    title: list[str] = field(default_factory=list)
    content: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        return not (self.title or self.content)


@dataclass
class DateFilter:
    """kind: y, my, dmy with a value, or between_y, between_my, between_dmy with start and end."""

    kind: str
    value: str | None = None
    start: str | None = None
    end: str | None = None


@dataclass
class FilterSet:
    rubrique: str | None = None
    date: DateFilter | None = None
    has_image: bool | None = None


@dataclass
class ParsedQuery:
    groups: list[KeywordGroup] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    filters: FilterSet = field(default_factory=FilterSet)

    def all_content_terms(self) -> list[str]:
        return distinct(t for g in self.groups for t in g.content)

    def all_title_terms(self) -> list[str]:
        return distinct(t for g in self.groups for t in g.title)

    def clauses(self) -> list[tuple[int, int, str, str, int]]:
        """(group, clause, kind, term, clauses of the group), for the query table."""
        out = []
        for number, group in enumerate(self.groups):
            own = [("title", t) for t in distinct(group.title)] + [("content", t) for t in distinct(group.content)]
            out += [(number, k, kind, term, len(own)) for k, (kind, term) in enumerate(own)]
        return out
