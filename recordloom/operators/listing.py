"""Pages of record lists: filters, search, total orders, keyset cursors and field visibility.

A page is one declarative plan: the policy, the filters and the keyset condition (an OR of ANDs, which reaches the
Parquet scan) end in TakeOrderedAndProject, so no page sorts or counts the whole list.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.search import matches, query_text
from recordloom.operators.policy import ORDINARY, SECRET, Plan, all_of, any_of

LEAST, MOST, DEFAULT = 1, 200, 50
COMPARE = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


class BadRequest(ValueError):
    """A request that the list does not take."""


class CursorInvalid(ValueError):
    """A cursor that can't be read or belongs to another filter, search or sort."""


class PlanChanged(ValueError):
    """The authorization changed since the cursor was made."""


@dataclass(frozen=True)
class Listed:
    """A column of a list: its Spark type, and what it may be used for."""

    column: str
    kind: str
    filterable: bool = True
    sortable: bool = True


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Spec:
    columns: dict[str, Listed]
    id_column: str
    id_kind: str = "string"
    search: dict[str, tuple[str, ...]] = field(default_factory=dict)  # search column: the fields it is made of


@dataclass(frozen=True)
class Request:
    filters: tuple[Filter, ...] = ()
    query: str = ""
    sort: tuple[tuple[str, bool], ...] = ()  # field, descending
    limit: int = DEFAULT
    cursor: str | None = None
    readable_only: tuple[str, ...] = ()


def filter_condition(listed: Listed, f: Filter) -> Column:
    column = F.col(listed.column)
    values = [F.lit(v).cast(listed.kind) for v in f.values]
    if f.op == "in":
        return column.isin(*values) if values else F.lit(False)
    if f.op not in COMPARE or len(values) != 1:
        raise BadRequest(f"filter {f.field}: one value with eq, gt, gte, lt or lte, or a list with in")
    return COMPARE[f.op](column, values[0])


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=list).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Page:
    """A compiled page: its rows are those of ``plan_rows`` in order, one more than the limit if there are more."""

    spec: Spec
    request: Request
    plan: Plan
    where: Column
    order: list[Column]
    limit: int
    filter_digest: str

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows of the page and one beyond, with the hits of the plan as ``hits`` and ``readable``."""
        found = df.where(self.where).orderBy(*self.order).limit(self.limit + 1)
        return found.withColumn("hits", self.plan.hit_array()).withColumn("readable", self.plan.readable())

    def shown(self, df: DataFrame) -> DataFrame:
        """Without the row beyond."""
        return self.rows(df).orderBy(*self.order).limit(self.limit)

    def next_cursor(self, last: dict) -> str:
        keys = [str(last[self.spec.columns[name].column]) for name, _ in self.request.sort]
        body = {"v": 1, "k": keys, "id": str(last[self.spec.id_column]), "f": self.filter_digest, "p": self.plan.digest}
        return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")


def keyset(spec: Spec, sort: tuple[tuple[str, bool], ...], keys: list[str], last_id: str) -> Column:
    """Rows strictly after a place in the order: the first differing key is beyond, or all are equal and the id is."""
    columns = [(F.col(spec.columns[name].column), F.lit(v).cast(spec.columns[name].kind), desc) for (name, desc), v in zip(sort, keys, strict=True)]
    columns.append((F.col(spec.id_column), F.lit(last_id).cast(spec.id_kind), False))
    branches = []
    for i, (column, value, desc) in enumerate(columns):
        same = [c == v for c, v, _ in columns[:i]]
        branches.append(all_of([*same, column < value if desc else column > value]))
    return any_of(branches)


def build(spec: Spec, plan: Plan, request: Request) -> Page:
    """Compile one page, or refuse the request."""
    if not LEAST <= request.limit <= MOST:
        raise BadRequest(f"limit: the page size must be {LEAST}-{MOST}")
    narrowed = sorted(set(request.readable_only))
    for name in narrowed:
        if plan.fields.get(name, SECRET) == SECRET:
            raise BadRequest(f"readable_only {name}: not a field of this list")

    def usable(name: str) -> bool:
        return plan.fields.get(name, ORDINARY) == ORDINARY or name in narrowed or plan.readable_everywhere(name)

    def listed(name: str, use: str) -> Listed:
        column = spec.columns.get(name)
        if column is None or not (column.filterable if use == "filter" else column.sortable):
            raise BadRequest(f"{use} {name}: not a field for this")
        if not usable(name):
            raise BadRequest(f"{use} {name}: the field is not readable in every row")
        return column

    conditions = [plan.where, *[plan.readable_where(n) for n in narrowed], *[filter_condition(listed(f.field, "filter"), f) for f in request.filters]]
    if query_text(request.query):
        conditions.append(any_of([matches(F.col(c), request.query) for c, fields in spec.search.items() if all(usable(f) for f in fields)]))
    order = [F.col(listed(name, "sort").column).desc() if desc else F.col(listed(name, "sort").column).asc() for name, desc in request.sort]
    told = _digest({"filters": [[f.field, f.op, f.values] for f in request.filters], "q": query_text(request.query), "sort": request.sort, "readable_only": narrowed})
    if request.cursor:
        try:
            body = json.loads(base64.urlsafe_b64decode(request.cursor + "=" * (-len(request.cursor) % 4)))
            keys, last_id, its_filter, its_plan = body["k"], body["id"], body["f"], body["p"]
        except (ValueError, KeyError, TypeError) as error:
            raise CursorInvalid("the cursor can't be read") from error
        if body.get("v") != 1 or its_filter != told or len(keys) != len(request.sort):
            raise CursorInvalid("the cursor belongs to another filter, search or sort")
        if its_plan != plan.digest:
            raise PlanChanged("the authorization changed; query again")
        conditions.append(keyset(spec, request.sort, keys, last_id))
    return Page(spec, request, plan, all_of(conditions), [*order, F.col(spec.id_column).asc()], request.limit, told)
