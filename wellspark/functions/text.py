"""Column functions on names, paths and wells; all stay inside Spark's generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(c: Column) -> Column:
    """An array that sorts text naturally: digit runs are padded, so ``A2`` comes before ``A10``."""
    parts = F.regexp_extract_all(F.coalesce(c.cast("string"), F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 20, "0")).otherwise(p))


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern with named groups as a positional Java pattern, and the groups' numbers."""
    names = re.compile(pattern).groupindex
    positional = re.sub(r"\(\?P<\w+>", "(", pattern)
    by_number = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", positional)
    return by_number, dict(names)


def captures(c: Column, pattern: str) -> dict[str, Column]:
    """Named groups of a match at the text's beginning; null where the pattern doesn't match."""
    java, names = java_pattern(pattern)
    anchored = f"^(?:{java})"
    return {n: F.when(c.rlike(anchored), F.regexp_extract(c, anchored, k)) for n, k in names.items()}


def channel_column(c: Column) -> Column:
    """A channel value as a column name: values that begin with a digit get ``ch`` in front."""
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("ch"), c)).otherwise(c)


def row_letter(c: Column) -> Column:
    """A row number as letters (1 is A, 27 is AA, up to ZZZ); letters become upper case; other text stays."""
    text = c.cast("string")
    n = F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))
    letter = lambda x: F.char((x + 65).cast("long"))
    k = n - 1
    made = (
        F.when(n <= 26, letter(k))
        .when(n <= 702, F.concat(letter(F.floor((k - 26) / 26)), letter((k - 26) % 26)))
        .when(n <= 18278, F.concat(letter(F.floor((k - 702) / 676)), letter(F.floor((k - 702) / 26) % 26), letter((k - 702) % 26)))
    )
    return F.when(text.rlike("^[A-Za-z]+$"), F.upper(text)).when(n > 0, F.coalesce(made, text)).otherwise(text)


def derive_well(row: Column, col: Column) -> Column:
    """``A1`` from a row and a whole column number; null if the column is no whole number."""
    whole = F.when(F.trim(col.cast("string")).rlike("^[0-9]+$"), F.trim(col.cast("string")).cast("long"))
    return F.concat(row_letter(row), whole.cast("string"))


def normalize_well(c: Column) -> Column:
    """``a01`` as ``A1``; other text unchanged."""
    shape = r"^([A-Za-z]+)([0-9]{1,18})$"
    return F.when(c.rlike(shape), F.concat(F.upper(F.regexp_extract(c, shape, 1)), F.regexp_extract(c, shape, 2).cast("long").cast("string"))).otherwise(c)


def shared_key(names: list[str]) -> Column:
    """``name=value`` parts joined by ``|``, names in order; null values are left out."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{n}="), F.col(f"`{n}`").cast("string")) for n in sorted(names)))


def null_strings(c: Column) -> Column:
    """Null for the words null and none in any case."""
    return F.when(F.lower(c).isin("null", "none"), None).otherwise(c)


def portable_path(c: Column) -> Column:
    """Forward slashes, without a final one."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "(?<=.)/+$", "")


def parent(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def source_directory(paths: list[Column]) -> Column:
    """The folder of the first path that isn't null."""
    return parent(F.coalesce(*paths))


def truth_from_directory(directory: Column, mapped: Column) -> Column:
    """The mapped label, else the folder's own name."""
    return F.coalesce(mapped, base_name(portable_path(directory)))


def split_labels(c: Column) -> Column:
    """Parts between semicolons, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def splice(c: Column, start: Column, length: Column, new: Column) -> Column:
    """``c`` with ``length`` letters from the 1-based ``start`` replaced."""
    return F.concat(F.substr(c, F.lit(1), start - 1), new, F.substr(c, start + length))


def tile_name(field: Column, tile: Column) -> Column:
    """The field of a tile: 10000 plus its number, then the field."""
    return F.concat((F.lit(10000) + tile).cast("string"), field)


def group_label(cols: list[Column]) -> Column:
    return F.concat_ws(" | ", *(c.cast("string") for c in cols))


def unique_name(name: str, taken: set[str], stem_: str, table: str, separator: str = "/") -> str:
    """A column name that isn't taken: with the source's stem, then its table too, then a number."""
    tries = [name, f"{stem_}{separator}{name}", f"{stem_}{separator}{table}{separator}{name}"]
    for t in tries:
        if t not in taken:
            return t
    k = 2
    while f"{tries[-1]} ({k})" in taken:
        k += 1
    return f"{tries[-1]} ({k})"


def resolution_tag(r: float) -> str:
    return f"{r:g}"


def infer_db_name(model: str) -> str:
    return f"infer_{model}.db"


def model_of_infer_db(name: str) -> str | None:
    m = re.fullmatch(r"infer_(.+)\.db", name)
    return m[1] if m else None


def reduction_table(method: str) -> str:
    return f"reduction_{method}"


def mask_column(mask: str) -> str:
    return mask if mask.startswith("mask_") else f"mask_{mask}"


def bare_mask(column: str) -> str:
    return column.removeprefix("mask_")


def shorten_paths(names: list[str]) -> list[str]:
    """Names without the path parts that all share in front and behind; at least one part stays."""
    parts = [n.strip("/").split("/") for n in names]
    if len(parts) < 2:
        return [p[-1] for p in parts]
    least = min(map(len, parts))
    a = 0
    while a < least - 1 and len({p[a] for p in parts}) == 1:
        a += 1
    b = 0
    while b < least - 1 - a and len({p[-1 - b] for p in parts}) == 1:
        b += 1
    return ["/".join(p[a : len(p) - b]) for p in parts]
