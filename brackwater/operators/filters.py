"""The filter language: boolean expressions over tags, documents and metadata.

``tag:NAME``, ``doc:N``, ``meta.KEY:VALUE``, ``AND``, ``OR``, ``NOT`` and parentheses;
AND binds tighter than OR. A quoted part of a word may hold spaces and parentheses,
and joins what it touches. An expression compiles to one predicate, every leaf of
which is true or false and never null, so that NOT is the complement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that can't be read."""


@dataclass(frozen=True)
class Tag:
    name: str


@dataclass(frozen=True)
class Doc:
    id: int


@dataclass(frozen=True)
class Meta:
    key: str
    value: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


def split(text: str) -> list[str | tuple[str, str]]:
    """Parentheses and operators as such, terms as (field, value)."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] in "()":
            out.append(text[at])
            at += 1
        else:
            word = ""
            while at < len(text) and not text[at].isspace() and text[at] not in "()":
                if text[at] == '"':
                    close = text.find('"', at + 1)
                    if close < 0:
                        raise FilterError("a quote is not closed")
                    word, at = word + text[at + 1 : close], close + 1
                else:
                    word, at = word + text[at], at + 1
            upper = "".join(c.upper() if c.isascii() else c for c in word)
            if upper in ("AND", "OR", "NOT"):
                out.append(upper)
            elif ":" in word:
                out.append(tuple(word.split(":", 1)))
            else:
                raise FilterError(f"{word!r} is no field:value")
    return out


def _leaf(field: str, value: str) -> object:
    low = field.lower()
    if low == "tag":
        return Tag(value)
    if low == "doc":
        digits = value.removeprefix("+")
        if not (digits.isascii() and digits.isdigit() and int(digits) < 1 << 64):
            raise FilterError(f"doc takes a number, not {value!r}")
        return Doc(int(digits))
    if low.startswith("meta."):
        if len(field) == 5:
            raise FilterError("meta. takes a key")
        return Meta(field[5:], value)
    raise FilterError(f"{field!r} is none of tag, doc and meta.KEY")


def parse(text: str) -> object:
    """The expression of a filter."""
    words = split(text)
    if not words:
        raise FilterError("the filter is empty")
    at = 0

    def look() -> object:
        return words[at] if at < len(words) else None

    def chain(operator: str, operand: Callable, make: Callable) -> object:
        nonlocal at
        parts = [operand()]
        while look() == operator:
            at += 1
            parts.append(operand())
        return reduce(make, parts)

    def either() -> object:
        return chain("OR", both, Either)

    def both() -> object:
        return chain("AND", one, Both)

    def one() -> object:
        nonlocal at
        word = look()
        if word is None or word in (")", "AND", "OR"):
            raise FilterError(f"{word or 'the end'} stands where a term should")
        at += 1
        if word == "NOT":
            return Not(one())
        if word == "(":
            inner = either()
            if look() != ")":
                raise FilterError("a parenthesis is not closed")
            at += 1
            return inner
        return _leaf(*word)

    expression = either()
    if at < len(words):
        raise FilterError(f"{words[at]!r} follows a whole filter")
    return expression


def predicate(expression: object, tag_ids: dict[str, int]) -> Column:
    """The condition on document_id, tags and metadata; a tag name that isn't known holds for none."""
    match expression:
        case Tag(name):
            return F.coalesce(F.array_contains("tags", F.lit(tag_ids[name]).cast("long")), F.lit(False)) if name in tag_ids else F.lit(False)
        case Doc(number):
            return F.coalesce(F.col("document_id") == F.lit(number), F.lit(False)) if number < 1 << 63 else F.lit(False)
        case Meta(key, value):
            return F.coalesce(F.col("metadata")[F.lit(key)] == F.lit(value), F.lit(False))
        case Not(of):
            return ~predicate(of, tag_ids)
        case Both(left, right):
            return predicate(left, tag_ids) & predicate(right, tag_ids)
        case Either(left, right):
            return predicate(left, tag_ids) | predicate(right, tag_ids)
    raise TypeError(expression)


def compile_filter(text: str, tag_ids: dict[str, int]) -> Column:
    """parse() and predicate()."""
    return predicate(parse(text), tag_ids)


def request_filter(
    tags: list[str] | None = None, match_all: bool = False, document_ids: list[int] | None = None, subdomain_id: int | None = None,
    subdomain_known: bool = True, filter_text: str | None = None, tag_ids: dict[str, int] | None = None,
) -> Column | None:
    """All that a request restricts, as one condition; none if it restricts nothing.

    A label that isn't known holds for none: with match_all there are no hits, else
    the known ones count.
    """
    tag_ids, parts = tag_ids or {}, []
    if tags:
        known = [tag_ids[t] for t in tags if t in tag_ids]
        has = [F.coalesce(F.array_contains("tags", F.lit(i).cast("long")), F.lit(False)) for i in known]
        if match_all:
            parts.append(reduce(lambda a, b: a & b, has) if len(known) == len(tags) else F.lit(False))
        else:
            parts.append(reduce(lambda a, b: a | b, has) if has else F.lit(False))
    if document_ids:
        parts.append(F.coalesce(F.col("document_id").isin(document_ids), F.lit(False)))
    if not subdomain_known:
        parts.append(F.lit(False))
    elif subdomain_id is not None:
        parts.append(F.coalesce(F.col("subdomain_id") == subdomain_id, F.lit(False)))
    if filter_text is not None:
        parts.append(compile_filter(filter_text, tag_ids))
    return reduce(lambda a, b: a & b, parts) if parts else None
