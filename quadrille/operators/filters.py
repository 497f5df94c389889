"""Filter requests: the request tree, its validation against a shape, and its DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.naming import XSD
from quadrille.functions.xsd import DIALECTS, NUMERIC, TEMPORAL, short_xsd
from quadrille.operators.shapes import ShapeTable

Op = Enum("Op", "EQ NEQ GT GTE LT LTE LIKE NOT_LIKE ILIKE IN NOT_IN BETWEEN NOT_BETWEEN IS_NULL IS_NOT_NULL")
LOGICAL, DIRECTIONS = ("AND", "OR"), ("ASC", "DESC")
UNARY, LISTS, RANGES = {Op.IS_NULL, Op.IS_NOT_NULL}, {Op.IN, Op.NOT_IN}, {Op.BETWEEN, Op.NOT_BETWEEN}
LIKES, ORDERED = {Op.LIKE, Op.NOT_LIKE, Op.ILIKE}, {Op.GT, Op.GTE, Op.LT, Op.LTE, Op.BETWEEN, Op.NOT_BETWEEN}


class FilterError(ValueError):
    """All that is wrong with a request."""

    def __init__(self, errors: list[str]):
        super().__init__("Filter validation failed: " + "; ".join(errors))
        self.errors = errors


@dataclass
class Criterion:
    column: str
    op: Op
    value: str | None = None
    value_to: str | None = None
    values: list[str] = field(default_factory=list)
    param: str | None = None


@dataclass
class Group:
    operator: str = "AND"
    criteria: list[Criterion] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)

    def empty(self) -> bool:
        return not self.criteria and all(g.empty() for g in self.groups)

    def walk(self):
        """Criteria of a group before those of its nested groups."""
        yield from self.criteria
        for g in self.groups:
            yield from g.walk()


@dataclass
class Request:
    table: str
    dialect: str = "ANSI"
    select: list[str] = field(default_factory=list)
    where: Group | None = None
    order_by: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None

    @staticmethod
    def parse(raw: dict) -> Request:
        """From the JSON form: tableName, dialect, selectColumns, filterGroup, orderBy, limit, offset."""

        errors: list[str] = []

        def one_of(value: str | None, known: tuple[str, ...], what: str) -> str:
            """The value, or the first known one where there is none; names are exact, as is their case."""
            if value is not None and value not in known:
                errors.append(f"unknown {what} '{value}', expected one of {', '.join(known)}")
            return known[0] if value is None else value

        def criterion(c: dict) -> Criterion | None:
            bad = [f"a filter criterion needs '{k}'" for k in ("column", "operator") if not c.get(k)]
            if not bad and c["operator"] not in Op.__members__:
                bad = [f"unknown operator '{c['operator']}' on column '{c['column']}'"]
            errors.extend(bad)
            return None if bad else Criterion(c["column"], Op[c["operator"]], c.get("value"), c.get("valueTo"), list(c.get("values") or []))

        def group(g: dict) -> Group:
            criteria = [x for c in g.get("criteria") or [] if (x := criterion(c)) is not None]
            return Group(one_of(g.get("operator"), LOGICAL, "logical operator"), criteria, [group(x) for x in g.get("groups") or []])

        if not raw.get("tableName"):
            errors.append("tableName is required")
        if raw.get("limit") is not None and raw["limit"] <= 0:
            errors.append("limit must be positive")
        dialect, tree = one_of(raw.get("dialect"), DIALECTS, "dialect"), raw.get("filterGroup")
        where = group(tree) if tree else None
        order = [(o.get("column"), one_of(o.get("direction"), DIRECTIONS, "direction")) for o in raw.get("orderBy") or []]
        errors += ["an ORDER BY entry needs 'column'" for c, _ in order if not c]
        if errors:
            raise FilterError(errors)
        return Request(raw["tableName"], dialect, list(raw.get("selectColumns") or []), where, order, raw.get("limit"), raw.get("offset"))


def resolve(name: str, tables: list[ShapeTable]) -> ShapeTable:
    """By name, ignoring case; the first match counts."""
    for t in tables:
        if name.upper() in (t.name.upper(), (t.physical or t.name).upper()):
            return t
    raise LookupError(f"No SHACL shape found for table '{name}'. Available tables: [{', '.join(t.name for t in tables)}]")


def _blank(x: str | None) -> bool:
    return x is None or not str(x).strip()


def validate(request: Request, shape: ShapeTable) -> None:
    """Raise with every error: projection, then criteria (value, type, nullability), then ordering."""
    groups = [request.where] if request.where else []
    for g in groups:
        groups.extend(g.groups)
    errors = [f"unknown logical operator '{g.operator}'" for g in groups if g.operator not in LOGICAL] + [f"unknown direction '{d}'" for _, d in request.order_by if d not in DIRECTIONS]
    errors += [f"SELECT column '{c}' does not exist in shape for table '{shape.name}'" for c in request.select if shape.column(c) is None]
    for c in request.where.walk() if request.where else ():
        col = shape.column(c.column)
        if col is None:
            errors.append(f"Filter column '{c.column}' does not exist in the shape")
            continue
        about = f"Operator {c.op.name} on column '{c.column}'"
        if c.op in LISTS:
            errors += [f"{about} requires a non-empty 'values' list"] * (not c.values)
        elif c.op in RANGES:
            errors += [f"{about} requires 'value' (lower bound)"] * _blank(c.value) + [f"{about} requires 'valueTo' (upper bound)"] * _blank(c.value_to)
        elif c.op not in UNARY:
            errors += [f"{about} requires a non-null 'value'"] * _blank(c.value)
        if not col.is_foreign_key and col.xsd_datatype:
            kind = col.xsd_datatype.removeprefix(XSD)
            if c.op in LIKES and kind != "string":
                errors.append(f"{about} requires a string (xsd:string) column, but column type is {short_xsd(col.xsd_datatype)}")
            if c.op in ORDERED and kind not in NUMERIC | TEMPORAL:
                errors.append(f"{about} requires a numeric or date/time column, but column type is {short_xsd(col.xsd_datatype)}")
        if c.op is Op.IS_NULL and not col.nullable:
            errors.append(f"{about} is always false — the column is declared NOT NULL in the shape")
    errors += [f"ORDER BY column '{c}' does not exist in shape for table '{shape.name}'" for c, _ in request.order_by if shape.column(c) is None]
    if errors:
        raise FilterError(errors)


def _literal(value: str, df: DataFrame, column: str) -> Column:
    """A request's string as a literal of the column's type; foldable, so it reaches the scan as a pushed filter."""
    return F.lit(value).cast(df.schema[column].dataType)


def condition(c: Criterion, df: DataFrame, column: str) -> Column:
    x = F.col(f"`{column}`")
    lit = lambda v: _literal(v, df, column)
    match c.op:
        case Op.EQ: return x == lit(c.value)
        case Op.NEQ: return x != lit(c.value)
        case Op.GT: return x > lit(c.value)
        case Op.GTE: return x >= lit(c.value)
        case Op.LT: return x < lit(c.value)
        case Op.LTE: return x <= lit(c.value)
        case Op.LIKE: return x.like(c.value)
        case Op.NOT_LIKE: return ~x.like(c.value)
        case Op.ILIKE: return x.ilike(c.value)
        case Op.IN: return x.isin(*[lit(v) for v in c.values])
        case Op.NOT_IN: return ~x.isin(*[lit(v) for v in c.values])
        case Op.BETWEEN: return x.between(lit(c.value), lit(c.value_to))
        case Op.NOT_BETWEEN: return ~x.between(lit(c.value), lit(c.value_to))
        case Op.IS_NULL: return x.isNull()
        case Op.IS_NOT_NULL: return x.isNotNull()


def predicate(group: Group | None, df: DataFrame, shape: ShapeTable) -> Column | None:
    """The condition of a tree; a tree without criteria is no filter."""
    if group is None or group.empty():
        return None
    parts = [condition(c, df, shape.column(c.column).physical or c.column) for c in group.criteria]
    parts += [p for g in group.groups if (p := predicate(g, df, shape)) is not None]
    return reduce(Column.__and__ if group.operator == "AND" else Column.__or__, parts)


def check_literals(request: Request, df: DataFrame, shape: ShapeTable) -> None:
    """Values that don't fit their column's type are errors of the request, not of the job."""
    wanted = [(c, v, df.schema[shape.column(c.column).physical or c.column].dataType.simpleString()) for c in (request.where.walk() if request.where else ()) if c.op not in UNARY | LIKES for v in ([*c.values] if c.op in LISTS else [c.value, c.value_to] if c.op in RANGES else [c.value])]
    wanted = [w for w in wanted if w[2] != "string"]
    if not wanted:
        return
    one = df.sparkSession.range(1).select(*[F.lit(v).try_cast(kind).isNull().alias(f"c{i}") for i, (_, v, kind) in enumerate(wanted)]).first()
    bad = [f"Value '{v}' of column '{c.column}' is no {kind}" for i, (c, v, kind) in enumerate(wanted) if one[i]]
    if bad:
        raise FilterError(bad)


def run(request: Request, df: DataFrame, shape: ShapeTable) -> DataFrame:
    """Validate, then filter, order (nulls last), skip, limit and project; the offset comes before the limit."""
    validate(request, shape)
    check_literals(request, df, shape)
    physical = lambda name: shape.column(name).physical or name
    out = df
    where = predicate(request.where, df, shape)
    if where is not None:
        out = out.where(where)
    if request.order_by:
        out = out.orderBy(*[F.col(physical(c)).desc_nulls_last() if d == "DESC" else F.col(physical(c)).asc_nulls_last() for c, d in request.order_by])
    if request.offset and request.offset > 0:
        out = out.offset(request.offset)
    if request.limit is not None:
        out = out.limit(request.limit)
    return out.select(*[physical(c) for c in request.select] or [c.physical or c.name for c in shape.columns])
