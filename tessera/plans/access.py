"""Declared access: which columns of which regions a function reads, writes and reduces, checked before it runs."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tessera.operators.depend import NO_ACCESS, READ_ONLY, READ_WRITE, REDUCE


class AccessError(Exception):
    """A requirement that can't be granted."""


class UnknownField(AccessError): ...


class DuplicateField(AccessError): ...


class InstanceOutsidePrivilege(AccessError): ...


class PrivilegeExceeded(AccessError): ...


class AliasedWrite(AccessError): ...


class ReadOnlyResult(AccessError): ...


def covers(parent: int, child: int) -> bool:
    return child & ~parent == 0


@dataclass(frozen=True)
class Region:
    """An immutable handle: a table, its pointer column and what the holder may do with each field."""

    name: str
    table: DataFrame
    ptr: str
    grants: dict[str, int] = field(default_factory=dict)

    def grant(self, column: str) -> int:
        return self.grants.get(column, READ_WRITE)

    def fields(self) -> list[str]:
        return [c for c in self.table.columns if c != self.ptr and self.grant(c) != NO_ACCESS]


@dataclass(frozen=True)
class Requirement:
    region: str
    privilege: int
    fields: tuple[str, ...]
    instance: tuple[str, ...] | None = None
    projected: bool = False  # one part of a partition for each point
    disjoint: bool = True

    def check(self, region: Region) -> None:
        for f in self.fields:
            if f not in region.table.columns:
                raise UnknownField(f"{region.name} has no field {f}")
        if len(set(self.fields)) < len(self.fields) or (self.instance and len(set(self.instance)) < len(self.instance)):
            raise DuplicateField(f"a field of {region.name} is named twice")
        if self.instance and not set(self.instance) <= set(self.fields):
            raise InstanceOutsidePrivilege(f"instance fields of {region.name} go beyond its privilege fields")
        for f in self.fields:
            if not covers(region.grant(f), self.privilege):
                raise PrivilegeExceeded(f"{region.name}.{f}: 0x{self.privilege:03x} is not within 0x{region.grant(f):03x}")
        if self.projected and not self.disjoint and self.privilege & ~REDUCE & ~READ_ONLY:
            raise AliasedWrite(f"{region.name} is written through a partition that is not disjoint")


def access(reads: dict | None = None, writes: dict | None = None, reduces: dict | None = None):
    """A function of regions by name that returns {name: table}; it is given only the columns that it declares.

    >>> @access(reads={"r": ["x"]}, writes={"r": ["y"]})
    ... def task(r): ...
    """
    wanted: dict[str, dict[str, int]] = {}
    for given, privilege in ((reads, READ_ONLY), (writes, READ_WRITE), (reduces, REDUCE)):
        for name, fields in (given or {}).items():
            for f in fields:
                own = wanted.setdefault(name, {})
                own[f] = own.get(f, NO_ACCESS) | privilege

    def wrap(f):
        @functools.wraps(f)
        def run(**regions: Region):
            views = {}
            for name, region in regions.items():
                own = wanted.get(name, {})
                for column, privilege in own.items():
                    Requirement(region.name, privilege, (column,)).check(region)
                views[name] = region.table.select(region.ptr, *[c for c in own if own[c] & READ_ONLY])
            out = f(**views)
            for name, table in (out or {}).items():
                own = wanted.get(name, {})
                for c in table.columns:
                    if c != regions[name].ptr and not own.get(c, NO_ACCESS) & (READ_WRITE & ~READ_ONLY) and not own.get(c, NO_ACCESS) & READ_ONLY:
                        raise ReadOnlyResult(f"{name}.{c} is returned but not declared")
            return out

        run.requirements = wanted
        return run

    return wrap
