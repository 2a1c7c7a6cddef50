"""Authorization segments compiled into Catalyst predicates, hits, readable fields and masks.

A segment is a conjunction of one atom per dimension. A list shows the rows of any view segment, and for another
operation those of any of its segments too; since the whole is one Column, Catalyst pushes it into the scan.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDINARY, RESTRICTED, SECRET = "ordinary", "restricted", "secret"
MASKED = "_masked"


class NotCompletable(ValueError):
    """A segment that can't be compiled into the query; it is never dropped silently."""


@dataclass(frozen=True)
class Dimension:
    column: str
    currency_column: str | None = None
    pushable: bool = True


@dataclass(frozen=True)
class Resource:
    """Dimensions and field classes of a kind of record, and the operation that makes it visible."""

    dimensions: dict[str, Dimension]
    fields: dict[str, str]
    view: str = "view"


@dataclass(frozen=True)
class Atom:
    """Condition on one dimension: ``all``, ``in``, ``self``, ``tree`` (paths with subtree flags) or ``interval``."""

    kind: str
    values: tuple[str, ...] = ()
    items: tuple[tuple[str, bool], ...] = ()
    currency: str | None = None
    low: str | None = None
    low_closed: bool = True
    high: str | None = None
    high_closed: bool = True


@dataclass(frozen=True)
class Segment:
    operation: str
    atoms: dict[str, Atom]
    read_fields: tuple[str, ...]
    since: str
    until: str | None = None

    def active_at(self, at: datetime) -> bool:
        """Whether the window, closed on the left and open on the right, holds the instant; malformed: no."""
        try:
            return datetime.fromisoformat(self.since) <= at and (self.until is None or at < datetime.fromisoformat(self.until))
        except ValueError:
            return False

    def digest(self) -> str:
        canonical = asdict(self) | {"atoms": {k: asdict(a) | {"values": sorted(set(a.values)), "items": sorted(set(a.items))} for k, a in sorted(self.atoms.items())}}
        canonical["read_fields"] = sorted(set(self.read_fields))
        return hashlib.sha256(json.dumps(canonical, sort_keys=True).encode()).hexdigest()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _in_tree(column: Column, items: tuple[tuple[str, bool], ...]) -> Column:
    return any_of([(column == path) | column.startswith(path + "/") if below else column == path for path, below in items])


def _in_interval(amount: Column, atom: Atom) -> Column:
    parts = []
    if atom.low is not None:
        low = F.lit(atom.low).cast("decimal(38,18)")
        parts.append(amount >= low if atom.low_closed else amount > low)
    if atom.high is not None:
        high = F.lit(atom.high).cast("decimal(38,18)")
        parts.append(amount <= high if atom.high_closed else amount < high)
    return all_of(parts)


def atom_condition(resource: Resource, dimension: str, atom: Atom, principal: str) -> Column:
    """Predicate of an atom over a row; null where the row's value is null."""
    d = resource.dimensions[dimension]
    if atom.kind != "all" and not d.pushable:
        raise NotCompletable(f"dimension {dimension} can't be decided in a query")
    column = F.col(d.column)
    if atom.kind == "all":
        return F.lit(True)
    if atom.kind == "in":
        return column.isin(*atom.values) if atom.values else F.lit(False)
    if atom.kind == "self":
        return column == principal
    if atom.kind == "tree":
        return _in_tree(column, atom.items)
    if atom.kind == "interval":
        return column.isNotNull() & (F.col(d.currency_column) == atom.currency) & _in_interval(column, atom)
    raise NotCompletable(f"atom kind {atom.kind} on {dimension}")


def segment_condition(resource: Resource, segment: Segment, principal: str) -> Column:
    return all_of([atom_condition(resource, name, segment.atoms[name], principal) for name in sorted(segment.atoms)])


@dataclass(frozen=True)
class Plan:
    """Which rows a list shows, one hit per segment whose fields count, and what each of these segments reads."""

    where: Column
    hits: list[Column]
    reads: list[tuple[str, ...]]
    digest: str
    fields: dict[str, str] = field(default_factory=dict)

    def readable_where(self, name: str) -> Column:
        """Rows in which a field is readable."""
        return any_of([hit for hit, reads in zip(self.hits, self.reads, strict=True) if name in reads])

    def readable_everywhere(self, name: str) -> bool:
        return bool(self.reads) and all(name in reads for reads in self.reads)

    def hit_array(self) -> Column:
        return F.array(*self.hits) if self.hits else F.array().cast("array<boolean>")

    def readable(self) -> Column:
        """Sorted names of the fields that a row's hits make readable."""
        sets = [F.when(hit, F.array(*[F.lit(x) for x in reads]) if reads else F.array().cast("array<string>")) for hit, reads in zip(self.hits, self.reads, strict=True)]
        if not sets:
            return F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*sets)))))


def compile_plan(resource: Resource, segments: list[Segment], operation: str, principal: str, at: datetime) -> Plan:
    """The list plan of an operation from the segments active at an instant; without any, no row is shown."""
    active = {name: [s for s in segments if s.operation == name and s.active_at(at)] for name in {resource.view, operation}}
    where = any_of([segment_condition(resource, s, principal) for s in active[resource.view]])
    if operation != resource.view:
        where = where & any_of([segment_condition(resource, s, principal) for s in active[operation]])
    own = active[operation]
    reads = [tuple(x for x in s.read_fields if resource.fields.get(x, SECRET) != SECRET) for s in own]
    hits = [F.coalesce(segment_condition(resource, s, principal), F.lit(False)) for s in own]
    used = sorted(s.digest() for name in active for s in active[name])
    digest = hashlib.sha256("\n".join([*used, json.dumps(resource.fields, sort_keys=True), operation]).encode()).hexdigest()[:32]
    return Plan(where, hits, reads, digest, resource.fields)


def masked(rows: DataFrame, resource: Resource, readable: Column) -> DataFrame:
    """Declared fields of ``rows``: readable ones as they are, other ordinary and restricted ones null and named in
    MASKED (sorted; null if none). Secret and undeclared fields do not pass; key columns must be declared."""
    names = sorted(n for n in rows.columns if resource.fields.get(n, SECRET) != SECRET)
    held = rows.withColumn("_readable", readable)
    hidden = F.array_compact(F.array(*[F.when(~F.array_contains("_readable", n), F.lit(n)) for n in names]))
    shown = [F.when(F.array_contains("_readable", n), F.col(n)).alias(n) for n in names]
    return held.select(*shown, F.when(F.size(hidden) > 0, hidden).alias(MASKED))


# Facts of one record: struct(state, value, currency) for each dimension; state is 'value', 'null' or 'unobtained'.


def fact_condition(atom: Atom, fact: Column, principal: Column | str) -> Column:
    """Three-valued truth of an atom on a fact: null is unknown (not obtained), a known null is false."""
    value = fact["value"]
    if atom.kind == "all":
        return F.lit(True)
    if atom.kind == "in":
        known = value.isin(*atom.values) if atom.values else F.lit(False)
    elif atom.kind == "self":
        known = value == principal
    elif atom.kind == "tree":
        known = (value != "") & _in_tree(value, atom.items)
    elif atom.kind == "interval":
        amount = value.try_cast("decimal(38,18)")
        known = F.when(~fact["currency"].eqNullSafe(F.lit(atom.currency)), F.lit(False)).when(amount.isNotNull(), _in_interval(amount, atom))
    else:
        return F.lit(None).cast("boolean")
    return F.when(fact["state"] == "null", F.lit(False)).when(fact["state"] == "value", known)


def evaluate(resource: Resource, segments: list[Segment], operation: str, facts: dict[str, Column], principal: Column | str, at: datetime) -> dict[str, Column]:
    """``visible, action, fields`` of one record per row, in Kleene logic (null: unknown)."""

    def entitled(name: str) -> tuple[Column, list[tuple[Column, Segment]]]:
        own = [s for s in segments if s.operation == name and s.active_at(at)]
        truths = [(all_of([fact_condition(a, facts[d], principal) for d, a in sorted(s.atoms.items())]), s) for s in own]
        return any_of([t for t, _ in truths]), truths

    visible, truths = entitled(resource.view)
    action = visible
    if operation != resource.view:
        allowed, truths = entitled(operation)
        action = visible & allowed
    sets = [
        F.when(t, F.array(*[F.lit(x) for x in sorted(s.read_fields) if resource.fields.get(x, SECRET) != SECRET]))
        for t, s in truths
        if any(resource.fields.get(x, SECRET) != SECRET for x in s.read_fields)
    ]
    union = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*sets))))) if sets else F.array().cast("array<string>")
    return {"visible": visible, "action": action, "fields": F.when(visible, union).otherwise(F.array().cast("array<string>"))}


def decision_error(visible: Column, action: Column) -> Column:
    """Why a record is refused, null if it isn't: not visible, then not allowed, then not provable."""
    return (
        F.when(~visible, "NOT_FOUND")
        .when(~action, "PERMISSION_DENIED")
        .when(visible.isNull() | action.isNull(), "AUTHORIZATION_UNPROVABLE")
    )


def fitting(resource: Resource, segments: list[Segment]) -> list[Segment]:
    """The segments that fit a declaration: exactly its dimensions, known kinds, declared fields."""
    kinds = {"all", "in", "self", "tree", "interval"}
    return [s for s in segments if set(s.atoms) == set(resource.dimensions) and all(a.kind in kinds for a in s.atoms.values()) and set(s.read_fields) <= set(resource.fields)]
