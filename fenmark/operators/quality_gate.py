"""Declarative data-quality rules: a table's own counts in one pass, all failures reported together.

Key uniqueness and each reference to another table are passes of their own, as they group and join.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.functions import geometry as st


@dataclass
class Rules:
    """key: columns, or attributes.NAME for JSON attributes. ranges: column -> (least, most). allowed: column -> values. references:
    column -> (frame, or the name of a table; column there; whether nulls pass)."""

    key: list[str] = field(default_factory=list)
    unique: bool = False
    non_null: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    geometry_types: list[str] = field(default_factory=list)
    srid: int | None = None
    row_floor_percent: float = 90.0
    references: dict[str, tuple[DataFrame | str, str, bool]] = field(default_factory=dict)


def value(name: str) -> Column:
    """A column, or a JSON attribute as text for attributes.NAME."""
    return F.get_json_object("attributes", f"$.{name.split('.', 1)[1]}") if name.startswith("attributes.") else F.col(name)


def check(table: str, df: DataFrame, rules: Rules, previous: DataFrame | None = None, lookup: Callable[[str], DataFrame] | None = None) -> list[str]:
    """What fails, as `table=.. rule=.. detail=..`; empty if nothing does. Null values pass ranges, allowed values and geometry rules.
    lookup reads the tables that references name."""

    def bad(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    counts = {"rows": F.count(F.lit(1))}
    for c in dict.fromkeys([*rules.key, *rules.non_null]):
        counts[f"null {c}"] = bad(value(c).isNull())
    for c, (least, most) in rules.ranges.items():
        x = value(c).try_cast("double")
        counts[f"range {c}"] = bad((x < least) | (x > most) | F.isnan(x) | (F.abs(x) == float("inf")))
        counts[f"number {c}"] = bad(x.isNull() & value(c).isNotNull())
    for c, values in rules.allowed.items():
        counts[f"allowed {c}"] = bad(~value(c).isin(values))
    if rules.geometry_types:
        counts["geometry type"] = bad(~st.geometry_type("geom").isin(rules.geometry_types))
        counts["geometry invalid"] = bad(~st.is_valid(st.make_valid("geom")))
    if rules.srid is not None:
        counts["geometry srid"] = bad(F.col("srid") != rules.srid)
    found = df.agg(*[c.alias(n) for n, c in counts.items()]).first().asDict()
    n = found.pop("rows")
    out = [f"table={table} rule={k.replace(' ', '_', 1)} detail={v} rows" for k, v in found.items() if v]
    if not n:
        out.append(f"table={table} rule=row_count detail=empty")
    elif previous is not None and n < (floor := math.ceil(previous.count() * rules.row_floor_percent / 100)):
        out.append(f"table={table} rule=row_count detail={n} below {floor}")
    if rules.unique and rules.key:
        twice = df.groupBy(*[value(c).alias(f"k{i}") for i, c in enumerate(rules.key)]).count().where("count > 1").count()
        if twice:
            out.append(f"table={table} rule=unique_key detail={twice} keys")
    for c, (target, column, allow_null) in rules.references.items():
        if isinstance(target, str):
            target = lookup(target)
        # values that are no numbers refer to nothing, and are not nulls
        mine = df.select(value(c).try_cast("double").alias("v"), value(c).isNull().alias("none"))
        lost = mine.join(target.select(F.col(column).try_cast("double").alias("v")).where("v is not null").distinct(), "v", "left_anti")
        lost = (lost.where("not none") if allow_null else lost).count()
        if lost:
            out.append(f"table={table} rule=reference_{c} detail={lost} rows")
    return out


def gate(rules: dict[str, Rules]) -> Callable[[str, DataFrame, DataFrame | None, Callable[[str], DataFrame]], list[str]]:
    """A check for Catalog.promote(): each table by its rules. References that name tables see the new versions of the same load."""
    return lambda table, new, old, lookup: check(table, new, rules[table], old, lookup) if table in rules else []


RULE_KEYS = {f.name for f in fields(Rules)}


def load_rules(text: str, references: dict[str, DataFrame] | None = None, by_name: bool = False) -> dict[str, Rules]:
    """Rules by table from YAML (where a YAML library is there) or JSON text: {tables: {name: {key: [..], unique: true, ranges:
    {column: [least, most]}, allowed: {column: [..]}, references: {column: {table: .., column: .., allow_null: ..}}, ..}}}.

    by_name: tables that rules refer to stay names, for gate(). Unknown keys, a table without a key, and else a reference to a table
    that is not among `references` are errors that name the table.
    """
    try:
        import yaml
    except ImportError:
        doc = json.loads(text)
    else:
        doc = yaml.safe_load(text)
    tables = (doc or {}).get("tables")
    if not isinstance(tables, dict) or not tables:
        raise ValueError("rules: no tables")
    out = {}
    for name, given in tables.items():
        given = dict(given or {})
        if unknown := sorted(set(given) - RULE_KEYS):
            raise ValueError(f"rules of {name}: unknown {unknown}")
        if not given.get("key"):
            raise ValueError(f"rules of {name}: no key")
        given["key"] = [given["key"]] if isinstance(given["key"], str) else list(given["key"])
        given["ranges"] = {c: (float(a), float(b)) for c, (a, b) in given.get("ranges", {}).items()}
        targets = {}
        for c, r in given.get("references", {}).items():
            if not by_name and r["table"] not in (references or {}):
                raise ValueError(f"rules of {name}: {c} refers to unknown table {r['table']}")
            targets[c] = (r["table"] if by_name else references[r["table"]], r.get("column", "id"), bool(r.get("allow_null", True)))
        out[name] = Rules(**given | {"references": targets})
    return out


FAILURE = re.compile(r"table=(\S+) rule=(\S+) detail=(.*)", re.S)


def parse_failure(text: str) -> dict[str, str]:
    """table, rule and detail of a failure's text; other texts are the detail of an unknown rule."""
    m = FAILURE.fullmatch(text.strip())
    return dict(zip(("table", "rule", "detail"), m.groups(), strict=True)) if m else {"table": "", "rule": "unknown", "detail": text.strip()}


def failures_by_table(failures: DataFrame, column: str = "failure") -> DataFrame:
    """table, n and detail (`rule: detail` of each failure, joined by `; ` in order) of failure texts, for any number of runs."""
    part = lambda i: F.regexp_extract(column, r"(?s)^table=(\S+) rule=(\S+) detail=(.*)$", i)
    rows = failures.where(F.col(column).isNotNull()).select(part(1).alias("table"), F.when(part(2) == "", F.concat(F.lit("unknown: "), column)).otherwise(F.concat(part(2), F.lit(": "), part(3))).alias("d"))
    return rows.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("d")), "; ").alias("detail"))
