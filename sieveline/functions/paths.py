"""Paths and module specifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def resolve_relative(file: Column, spec: Column) -> Column:
    """The path that a relative specifier means from a file, without a suffix; null beyond the root or if it isn't relative."""
    steps = F.filter(F.split(F.concat(parent(file), F.lit("/"), spec), "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    walked = F.aggregate(
        steps,
        F.array(F.lit("")),  # the first element marks a path within the root
        lambda acc, s: F.when(F.size(acc) == 0, acc).when(s == up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(spec.rlike(r"\A\.\.?(/|\z)"), F.element_at(F.transform(F.array(walked), lambda w: F.when(F.size(w) > 0, F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), "/"))), 1))


def resolve_dotted(file: Column, module: Column) -> Column:
    """The path that a dotted Python module with leading dots means from a file; null beyond the root or without leading dots."""
    dots = F.length(F.regexp_extract(module, r"\A(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"\A\.+", ""), F.lit("."), F.lit("/"))
    ups = F.concat(F.lit("./"), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))))
    return F.when(dots > 0, resolve_relative(file, F.concat(ups, rest)))


def under_aliases(spec: Column, aliases: dict[str, str]) -> Column:
    """A specifier with the longest alias prefix (`@/` -> `src/`) replaced; null if none fits."""
    found = F.lit(None).cast("string")
    for prefix in sorted(aliases, key=len):
        found = F.when(spec.startswith(prefix), F.concat(F.lit(aliases[prefix]), F.substring(spec, F.lit(len(prefix) + 1), F.length(spec)))).otherwise(found)
    return found
