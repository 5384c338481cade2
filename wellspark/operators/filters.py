"""Filters over catalogue and measurement tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspark.functions.text import normalize_well


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value as text holds a match anywhere; null never matches."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    if not pattern:
        raise ValueError("empty pattern")
    re.compile(pattern)
    return df.filter(F.col(f"`{column}`").cast("string").rlike(pattern))


def apply_filters(df: DataFrame, entries: list[tuple[str | None, str | None]]) -> DataFrame:
    """All (column, pattern) entries together; entries with an empty part are skipped."""
    return reduce(lambda d, e: filter_regex(d, *e) if e[0] and e[1] else d, entries, df)


_WORDS = {"and": "AND", "or": "OR", "not": "NOT", "in": "IN", "True": "true", "False": "false", "None": "NULL"}
_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|`[^`]*`|==|!=|<=|>=|[A-Za-z_]\w*|\d+\.?\d*(?:[eE][+-]?\d+)?|[&|~\[\]]|.|\n""")


def translate_expression(text: str) -> str:
    """A row expression in Python operators as SQL; strings keep their content."""
    out = []
    for t in _TOKEN.findall(text):
        if t[0] in "'\"":
            out.append("'" + t[1:-1].replace("\\", "\\\\").replace("'", "\\'") + "'")
        else:
            out.append({"==": "=", "&": " AND ", "|": " OR ", "~": " NOT ", "[": "(", "]": ")"}.get(t, _WORDS.get(t, t)))
    return "".join(out)


def filter_expression(df: DataFrame, text: str | None) -> tuple[DataFrame, str | None]:
    """The rows that satisfy an expression, and an error message instead of an exception; blank keeps all."""
    if not text or not text.strip():
        return df, None
    try:
        out = df.filter(F.expr(translate_expression(text)))
        out.schema  # noqa: B018  resolves names now
        return out, None
    except (ParseException, Exception) as e:  # noqa: BLE001  any failure is reported to the caller
        return df, next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)


def lookup_rows(df: DataFrame, wells: list[str] = (), fields: list[str] = (), stacks: list[str] = (), timepoints: list[str] = ()) -> DataFrame:
    """Rows of the asked wells, fields, stacks and timepoints (an empty list asks for all), in the lists' nested order."""
    order: list[Column] = []
    for name, values in (("well", wells), ("field", fields), ("stack", stacks), ("timepoint", timepoints)):
        if not values:
            continue
        c = normalize_well(F.col(name)) if name == "well" else F.col(name).cast("string")
        asked = [str(v) for v in values]
        literals = F.array(*(normalize_well(F.lit(v)) if name == "well" else F.lit(v) for v in asked))
        place = F.array_position(literals, c)
        df = df.filter(place > 0)
        order.append(place)
    return df.orderBy(*order) if order else df


def filter_extra(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """All value lists together; unknown columns and empty lists are ignored."""
    for name, values in chosen.items():
        if name in df.columns and values:
            df = df.filter(F.col(f"`{name}`").cast("string").isin([str(v) for v in values]))
    return df


def scope_by_directory(df: DataFrame, scopes: list[str], column: str = "directory") -> DataFrame:
    """Rows in one of the folders or below; if no row is, all rows.  ``.`` stands for all."""
    scopes = [s.rstrip("/") or "/" for s in scopes if s]
    if not scopes or "." in scopes:
        return df
    c = F.col(column)
    inside = F.coalesce(reduce(lambda a, b: a | b, ((c == s) | c.startswith(f"{s}/") for s in scopes)), F.lit(False))
    if df.filter(inside).limit(1).count():
        return df.filter(inside)
    return df


def in_scope(df: DataFrame, scope: str, label: int | None = None) -> Column:
    """A condition on a row with ``states`` (map of label to 0 or 1) for a queue scope.

    ``undecided`` (for the label, or for any), ``with``, ``without`` (undecided or 0), ``negative``,
    ``decided``, ``all``.
    """
    states = F.col("states")
    state = F.try_element_at(states, F.lit(label)) if label is not None else None
    positives = F.exists(F.map_values(states), lambda v: v == 1)
    cases = {
        "all": F.lit(True),
        "undecided": state.isNull() if state is not None else F.size(states) == 0,
        "with": F.coalesce(state == 1, F.lit(False)) if state is not None else positives,
        "without": F.coalesce(state != 1, F.lit(True)) if state is not None else ~positives,
        "negative": F.coalesce(state == 0, F.lit(False)) if state is not None else F.exists(F.map_values(states), lambda v: v == 0),
        "decided": state.isNotNull() if state is not None else F.size(states) > 0,
    }
    return cases[scope]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BooleanType)]


def without_binary(df: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Without binary and array columns, and the named ones; Parquet never reads them then."""
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.BinaryType | T.ArrayType) and f.name not in hidden))


def color_is_continuous(df: DataFrame, column: str) -> bool:
    """Probabilities always, cluster columns never, else all values are numbers and more than 20 differ."""
    if column.startswith("prob_"):
        return True
    if column.startswith("cluster_res_"):
        return False
    c = F.col(f"`{column}`")
    r = df.agg(F.count(c).alias("n"), F.count(c.cast("string").try_cast("double")).alias("m"), F.count_distinct(c).alias("d")).first()
    return r["n"] > 0 and r["n"] == r["m"] and r["d"] > 20


def reorder_columns(df: DataFrame, metadata: list[str]) -> DataFrame:
    """Metadata, label, edge ratio, parents in order, then the rest."""
    names = df.columns
    front = [m for m in metadata if m in names] + [c for c in ("label", "edge_pixel_ratio") if c in names] + sorted(c for c in names if c.startswith("parent_"))
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(front + names)))
