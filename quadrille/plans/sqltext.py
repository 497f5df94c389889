"""SQL text of statements and filter requests in three dialects, with the names of bind parameters."""

from __future__ import annotations

from dataclasses import dataclass

from quadrille.functions.naming import XSD
from quadrille.functions.xsd import DDL_STRING_PREFIXES, sql_name
from quadrille.operators.filters import LISTS, RANGES, UNARY, Criterion, Group, Op, Request, validate
from quadrille.operators.shapes import ShapeColumn, ShapeTable

KINDS = ("CREATE_TABLE", "SELECT_ALL", "SELECT_BY_PK", "INSERT", "UPDATE_BY_PK", "DELETE_BY_PK")
SYMBOLS = {Op.EQ: "=", Op.NEQ: "!=", Op.GT: ">", Op.GTE: ">=", Op.LT: "<", Op.LTE: "<=", Op.LIKE: "LIKE", Op.NOT_LIKE: "NOT LIKE"}


@dataclass
class Statement:
    kind: str
    table: str
    dialect: str
    sql: str
    params: list[str]


def quote(name: str, dialect: str) -> str:
    """Bare for Snowflake; else in double quotes, with those inside doubled."""
    return name if dialect == "SNOWFLAKE" else '"' + name.replace('"', '""') + '"'


def _definition(c: ShapeColumn, dialect: str) -> str:
    kind = sql_name(XSD + "long" if c.is_foreign_key else c.xsd_datatype, dialect)
    if not c.is_foreign_key and (c.max_length or 0) > 0 and kind.startswith(DDL_STRING_PREFIXES):
        kind += f"({c.max_length})"
    return f"{quote(c.name, dialect)} {kind}" + " NOT NULL" * (not c.nullable)


def statement(kind: str, t: ShapeTable, dialect: str = "ANSI") -> Statement:
    q = lambda name: quote(name, dialect)
    block = lambda lines: ",\n".join("    " + x for x in lines)
    names = [c.name for c in t.columns]
    where = "\nWHERE " + "\n  AND ".join(f"{q(k)} = :{k}" for k in t.primary_key)
    select = f"SELECT\n{block(map(q, names))}\nFROM {q(t.name)}"
    params: list[str] = []
    if kind == "CREATE_TABLE":
        lines = [_definition(c, dialect) for c in t.columns]
        if t.primary_key:
            lines.append(f"CONSTRAINT pk_{t.name} PRIMARY KEY ({', '.join(map(q, t.primary_key))})")
        lines += [f"CONSTRAINT fk_{t.name}_{c.referenced_table} FOREIGN KEY ({q(c.name)}) REFERENCES {q(c.referenced_table)} ({q(c.name)})" for c in t.columns if c.is_foreign_key and c.referenced_table]
        sql = f"CREATE TABLE {q(t.name)} (\n{block(lines)}\n);"
    elif kind == "SELECT_ALL":
        sql = select + ";"
    elif kind == "SELECT_BY_PK":
        params = list(t.primary_key)
        sql = select + (where if params else "\nWHERE /* no primary key defined */") + ";"
    elif kind == "INSERT":
        params = names
        sql = f"INSERT INTO {q(t.name)} (\n{block(map(q, names))}\n) VALUES (\n{block(':' + n for n in names)}\n);"
    elif kind == "UPDATE_BY_PK":
        free = [n for n in names if n not in t.primary_key]
        params = free + list(t.primary_key)
        if not free:
            sql = f"-- No updatable columns for table {t.name}"
        else:
            sql = f"UPDATE {q(t.name)} SET\n{block(f'{q(n)} = :{n}' for n in free)}" + (where if t.primary_key else "\nWHERE /* no primary key defined */") + ";"
    elif kind == "DELETE_BY_PK":
        params = list(t.primary_key)
        sql = f"DELETE FROM {q(t.name)}" + (where if params else "\nWHERE /* no primary key defined — DELETE ALL */") + ";"
    else:
        raise ValueError(f"unknown statement kind {kind}")
    return Statement(kind, t.name, dialect, sql, params)


def statements(tables: list[ShapeTable], kinds: list[str] | None = None, dialect: str = "ANSI", include: list[str] | None = None) -> dict[str, list[Statement]]:
    """By table, in the order of the requested kinds; the include list ignores case, of tables with one name the last counts."""
    wanted = {n.upper() for n in include or []}
    return {t.name: [statement(k, t, dialect) for k in kinds or KINDS] for t in tables if not wanted or t.name.upper() in wanted or (t.physical or "").upper() in wanted}


def number_params(group: Group | None) -> None:
    """COLUMN_N for every criterion that takes a value, in the order of the walk."""
    n = 0
    for c in group.walk() if group else ():
        if c.op not in UNARY:
            c.param, n = f"{c.column.upper()}_{n}", n + 1


def param_names(c: Criterion) -> list[str]:
    if c.op in UNARY:
        return []
    if c.op in RANGES:
        return [c.param, c.param + "_TO"]
    return [f"{c.param}_{i}" for i in range(len(c.values))] if c.op in LISTS else [c.param]


def _criterion(c: Criterion, dialect: str) -> str:
    x, p = quote(c.column.upper(), dialect), [":" + n for n in param_names(c)]
    if c.op in SYMBOLS:
        return f"{x} {SYMBOLS[c.op]} {p[0]}"
    if c.op is Op.ILIKE:
        return f"{x} ILIKE {p[0]}" if dialect == "POSTGRESQL" else f"LOWER({x}) LIKE LOWER({p[0]})"
    if c.op in LISTS:
        return f"{x} {'IN' if c.op is Op.IN else 'NOT IN'} ({', '.join(p)})"
    if c.op in RANGES:
        return f"{x} {'BETWEEN' if c.op is Op.BETWEEN else 'NOT BETWEEN'} {p[0]} AND {p[1]}"
    return f"{x} IS {'NULL' if c.op is Op.IS_NULL else 'NOT NULL'}"


def _group(g: Group, dialect: str) -> str:
    parts = [_criterion(c, dialect) for c in g.criteria] + [_group(x, dialect) for x in g.groups if not x.empty()]
    return parts[0] if len(parts) == 1 else "(\n  " + f"\n  {g.operator} ".join(parts) + "\n)"


def filter_select(request: Request, shape: ShapeTable) -> Statement:
    """The text of a validated request; values are bound by name."""
    validate(request, shape)
    number_params(request.where)
    d = request.dialect
    columns = [c.upper() for c in request.select] or [c.name for c in shape.columns]
    sql = "SELECT\n" + ",\n".join("    " + quote(c, d) for c in columns) + f"\nFROM {quote(shape.name, d)}"
    if request.where and not request.where.empty():
        sql += f"\nWHERE {_group(request.where, d)}"
    if request.order_by:
        sql += "\nORDER BY " + ", ".join(f"{quote(c.upper(), d)} {x}" for c, x in request.order_by)
    if request.limit is not None:
        sql += f"\nLIMIT {request.limit}"
    if request.offset and request.offset > 0:
        sql += f"\nOFFSET {request.offset}"
    params = [n for c in (request.where.walk() if request.where else ()) for n in param_names(c)]
    return Statement("SELECT_ALL", shape.name, d, sql + ";", params)


def bind_values(request: Request) -> dict[str, str]:
    """The value of each parameter of filter_select, for spark.sql(text, args=...)."""
    out: dict[str, str] = {}
    for c in request.where.walk() if request.where else ():
        out |= dict(zip(param_names(c), c.values if c.op in LISTS else [c.value, c.value_to], strict=False))
    return out
