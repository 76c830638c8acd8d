"""Who may see a row: tenant fences of both axes, sessions and expiry. One predicate each, null-aware."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class _Global:
    def __repr__(self) -> str:
        return "GLOBAL"


#: The view of the shared tier only.
GLOBAL = _Global()


class ScopeRequired(ValueError):
    """A scope was left out where it must be stated."""


@dataclass(frozen=True)
class Fence:
    """see_all: every row; else the shared tier and, if owner is given, that owner's rows."""

    see_all: bool = True
    owner: str | None = None
    session: str | None = None
    now: int | None = None


def fence_of(scope=None, strict: bool = False, session: str | None = None, now: int | None = None) -> Fence:
    """A string: that tenant and the shared tier; GLOBAL: the shared tier; None: all, or an error if strict."""
    if scope is None:
        if strict:
            raise ScopeRequired("state a scope, or GLOBAL for the shared tier")
        return Fence(True, None, session, now)
    if scope is GLOBAL:
        return Fence(False, None, session, now)
    if not isinstance(scope, str) or not scope:
        raise ValueError("a scope is a non-empty string or GLOBAL")
    return Fence(False, scope, session, now)


def owned(owner: Column, f: Fence) -> Column:
    if f.see_all:
        return F.lit(True)
    return owner.isNull() | (F.lit(False) if f.owner is None else F.coalesce(owner == f.owner, F.lit(False)))


def in_session(session: Column, f: Fence) -> Column:
    return F.lit(True) if f.session is None else session.isNull() | (session == f.session)


def live(expires_at: Column, now: int | None) -> Column:
    """A row that expires at now is dead already."""
    return F.lit(True) if now is None else expires_at.isNull() | (expires_at > now)


def by_id(id_: Column, want: str) -> Column:
    return id_ == want


def by_prefix(id_: Column, base: str) -> Column:
    """The id itself or one of its segments."""
    return (id_ == base) | id_.startswith(base + "#")
