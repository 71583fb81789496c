"""The filter language: scopes, structural filters and the typed expression tree, compiled to one Column.

The whole predicate is a Column, so Catalyst pushes to the Parquet scan what the scan can take."""

from __future__ import annotations

import datetime as dt
import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_CONDITIONS, MAX_CHILDREN, MAX_VALUES, MAX_TEXT = 8, 100, 20, 100, 1024
# The fields of the language, their columns and kinds.
FIELDS = {
    "id": ("id", "string"), "content": ("content", "string"), "memory_type": ("memory_type", "string"), "subject": ("subject", "string"),
    "attribute": ("attribute", "string"), "importance": ("importance", "number"), "access_count": ("access_count", "number"),
    "created_at": ("created_at", "date"), "updated_at": ("updated_at", "date"), "event_date": ("event_date", "date"), "last_accessed_at": ("last_accessed_at", "date"),
}
UNSAFE_SEGMENTS = {"__proto__", "prototype", "constructor"}


class InvalidFilter(ValueError):
    """A filter that the language does not allow."""


def scope_wildcard(**scope: str | None) -> Column:
    """Reads: a field that is not given matches anything."""
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in scope.items() if v is not None), F.lit(True))


def scope_exact(**scope: str | None) -> Column:
    """State and evidence: a field that is not given must be null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in scope.items()), F.lit(True))


def visible() -> Column:
    return ~F.coalesce(F.col("forgotten"), F.lit(False))


def structural(memory_type: str | None = None, metadata: dict[str, Any] | None = None, event_date: tuple | None = None, created_at: tuple | None = None, last_accessed_at: tuple | None = None, accessed: bool | None = None, subject: str | None = None, attribute: str | None = None) -> Column:
    """AND of the structural filters; ranges are (from, to), inclusive, either may be None; a row without the date fails."""
    parts = [F.lit(True)]
    if memory_type is not None:
        parts.append(F.col("memory_type") == memory_type)
    for key, value in (metadata or {}).items():
        parts.append(compile_filter({"field": f"metadata.{key}", "op": "eq", "value": value}))
    for name, bounds in (("event_date", event_date), ("created_at", created_at), ("last_accessed_at", last_accessed_at)):
        if bounds is not None:
            parts.append(F.col(name).isNotNull())
            parts += [F.col(name) >= bounds[0]] if bounds[0] is not None else []
            parts += [F.col(name) <= bounds[1]] if bounds[1] is not None else []
    if accessed is not None:
        parts.append(F.col("access_count") > 0 if accessed else F.col("access_count") == 0)
    for name, value in (("subject", subject), ("attribute", attribute)):
        if value is not None:
            parts.append(F.lower(name) == value.lower())
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def validate(tree: dict, depth: int = 1, seen: list[int] | None = None) -> None:
    """Limits of the wire format: depth, conditions, children, values, text lengths and operators by field."""
    seen = seen if seen is not None else [0]
    logical = [k for k in ("and", "or", "not") if k in tree]
    if logical:
        if depth > MAX_DEPTH or len(tree) != 1:
            raise InvalidFilter("too many levels, or more than one key")
        children = [tree["not"]] if "not" in tree else tree[logical[0]]
        if not 1 <= len(children) <= MAX_CHILDREN:
            raise InvalidFilter("a logical node has 1 to 20 children")
        for child in children:
            validate(child, depth + 1, seen)
        return
    seen[0] += 1
    if seen[0] > MAX_CONDITIONS:
        raise InvalidFilter("more than 100 conditions")
    field, op, value = tree.get("field"), tree.get("op"), tree.get("value")
    kind = "any" if str(field).startswith("metadata.") else FIELDS.get(str(field), ("", ""))[1]
    allowed = {"exists", "eq", "ne", "in", "nin"} | ({"contains", "icontains"} if kind in ("string", "any") else set()) | ({"gt", "gte", "lt", "lte"} if kind != "" else set())
    if not kind or op not in allowed:
        raise InvalidFilter(f"{op} can't be applied to {field}")
    if op == "exists" and not isinstance(value, bool):
        raise InvalidFilter("exists takes a boolean")
    values = value if isinstance(value, (list, tuple)) else [value]
    if op in ("in", "nin") and not isinstance(value, (list, tuple)) or len(values) > MAX_VALUES:
        raise InvalidFilter("in and nin take up to 100 values")
    if any(isinstance(v, str) and len(v) > MAX_TEXT for v in values):
        raise InvalidFilter("a text is longer than 1024 characters")


def _date(value: Any) -> dt.datetime:
    try:
        found = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError as e:
        raise InvalidFilter(f"{value} is not an ISO date") from e
    return found.astimezone(dt.timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def _literal(value: Any, kind: str) -> Column:
    return F.lit(_date(value)) if kind == "date" else F.lit(value)


def _metadata(path: str, value: Any) -> tuple[Column, Column]:
    """(present, typed value) of a dotted path of the variant column; a value of another type than the operand's is null."""
    segments = path.split(".")
    if any(s in UNSAFE_SEGMENTS or not s for s in segments):
        return F.lit(False), F.lit(None)
    if any("'" in s or "\\" in s for s in segments):
        raise InvalidFilter("a metadata path has no quotes and no backslashes")
    where = "$" + "".join(f"['{s}']" for s in segments)
    any_ = F.try_variant_get("metadata", where, "variant")
    kind = F.schema_of_variant(any_)
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    if isinstance(sample, bool):
        typed = F.when(kind == "BOOLEAN", F.try_variant_get("metadata", where, "boolean"))
    elif isinstance(sample, (int, float)):
        typed = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get("metadata", where, "double"))
    else:
        typed = F.when(kind == "STRING", F.try_variant_get("metadata", where, "string"))
    return any_.isNotNull() & (kind != "VOID"), typed


def _array_test(path: str, op: str, value: Any) -> Column:
    """The test of a metadata field that is an array: equal as a whole, or with an element that is equal (``icontains``: but for case). False if the
    field is no array; elements of another type than the operand's are not equal to it."""
    where = "$" + "".join(f"['{s}']" for s in path.split("."))
    items = F.try_variant_get("metadata", where, "array<variant>")
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    texts = F.transform(items, lambda x: F.to_json(x))
    wanted = F.array(*[F.lit(json.dumps(v, ensure_ascii=False)) for v in values]).cast("array<string>")
    if op == "icontains":
        test = F.exists(texts, lambda x: F.lower(x).isin(*[json.dumps(v, ensure_ascii=False).lower() if isinstance(v, str) else json.dumps(v) for v in values]))
    elif op in ("eq", "ne"):
        test = (texts == wanted) if isinstance(value, (list, tuple)) else F.lit(False)
    else:
        test = F.arrays_overlap(texts, wanted)
    return F.coalesce(test, F.lit(False))


def compile_filter(tree: dict) -> Column:
    """The expression tree as a two-valued Column: a condition on a null or missing field is false (but for exists),
    so ``not`` of it is true."""
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(compile_filter, tree["and"]), F.lit(True))
    if "or" in tree:
        return reduce(lambda a, b: a | b, map(compile_filter, tree["or"]), F.lit(False))
    if "not" in tree:
        return ~compile_filter(tree["not"])
    field, op, value = tree["field"], tree["op"], tree.get("value")
    if field.startswith("metadata."):
        path = field.removeprefix("metadata.")
        present, actual = _metadata(path, value)
        kind = "any"
        if op in ("eq", "ne", "in", "nin", "contains", "icontains") and not UNSAFE_SEGMENTS & set(path.split(".")):
            hit = _array_test(path, op, value)
            if isinstance(value, (list, tuple)) and op in ("eq", "ne"):
                return F.coalesce(present, F.lit(False)) & (hit if op == "eq" else ~hit)
            plain = {"field": field, "op": {"ne": "eq", "nin": "in"}.get(op, op), "value": value}
            same = (_scalar_test(present, actual, plain, kind) if value != [] else F.lit(False)) | hit
            return F.coalesce(present, F.lit(False)) & (~same if op in ("ne", "nin") else same)
    else:
        name, kind = FIELDS[field]
        actual = F.col(name)
        present = actual.isNotNull()
    return _scalar_test(present, actual, tree, kind)


def _scalar_test(present: Column, actual: Column, tree: dict, kind: str) -> Column:
    op, value = tree["op"], tree.get("value")
    if op == "exists":
        return F.coalesce(present == F.lit(value), F.lit(False))
    if op in ("in", "nin"):
        among = F.coalesce(actual.isin([_date(v) if kind == "date" else v for v in value]), F.lit(False)) if value else F.lit(False)
        return present & (among if op == "in" else ~among)
    if op in ("contains", "icontains"):
        test = actual.contains(value) if op == "contains" else F.lower(actual).contains(str(value).lower())
        return F.coalesce(present & test, F.lit(False))
    if op in ("eq", "ne"):
        same = F.coalesce(actual == _literal(value, kind), F.lit(False))
        return F.coalesce(present, F.lit(False)) & (same if op == "eq" else ~same)
    other = _literal(value, kind)
    test = {"gt": actual > other, "gte": actual >= other, "lt": actual < other, "lte": actual <= other}[op]
    return F.coalesce(present & test, F.lit(False))
