"""Canonical JSON and recursive-JSON helpers (Arrow UDFs).

VARIANT re-renders numbers, so content hashes need the exact tokens; these helpers parse the
text once per distinct value inside an Arrow batch.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from pactlane.functions import constants as C
from pactlane.functions.text import per_text


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _canonical(text: str) -> str | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Sorted keys, compact separators, non-ASCII kept; NULL when the text is not JSON."""
    return per_text(_canonical)(values)


@F.pandas_udf(StringType())
def spaced_json(values: pd.Series) -> pd.Series:
    """Sorted keys with the default separators (the line format of row files)."""

    def render(text: str) -> str | None:
        value = _load(text)
        return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)

    return per_text(render)(values)


@F.pandas_udf(StringType())
def lenient_root(values: pd.Series) -> pd.Series:
    """Re-render a root object that uses duplicate keys (last wins); NULL when not an object."""

    def render(text: str) -> str | None:
        value = _load(text)
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return per_text(render)(values)


def settle_duplicate_keys(raw: Column) -> Column:
    """Text whose duplicate keys are settled; only suspicious rows travel to Python."""
    suspicious = (
        F.try_parse_json(raw).isNull() & raw.rlike(r"^\s*\{") & raw.rlike(r"\}\s*$") & F.json_object_keys(raw).isNotNull()
    )
    return F.when(suspicious, F.coalesce(lenient_root(F.when(suspicious, raw)), raw)).otherwise(raw)


def _scalar(value) -> tuple[str, str | None]:
    if isinstance(value, bool):
        return "BOOLEAN", "True" if value else "False"
    if value is None:
        return "NULL", None
    if isinstance(value, str):
        return "STRING", value
    return "NUMBER", str(value)


def _nodes(root):
    """(path of keys and positions, node) of every value below ``root``, without recursion."""
    open_ = [((), root)]
    while open_:
        path, node = open_.pop()
        yield path, node
        inner = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        open_ += [((*path, step), below) for step, below in inner]


def _shown(path: tuple) -> str:
    return "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path).removeprefix(".")


def _leaf_events(root: dict) -> list[dict]:
    leaves = ((_shown(path), *_scalar(node)) for path, node in _nodes(root) if not isinstance(node, dict | list))
    return [dict(zip(("path", "kind", "text"), leaf, strict=True)) for leaf in sorted(leaves, key=lambda e: e[0])]


SLOT_EVENTS = ArrayType(
    StructType([StructField("path", StringType()), StructField("kind", StringType()), StructField("text", StringType())])
)


@F.pandas_udf(SLOT_EVENTS)
def _flatten_nested(values: pd.Series) -> pd.Series:
    def flat(text: str):
        value = _load(text)
        return _leaf_events(value) if isinstance(value, dict) else None

    return values.map(lambda t: None if t is None else flat(t))


def slot_events(slots_text: Column, slot_str: Column, slot_types: Column) -> Column:
    """Slots as sorted (path, kind, text) rows. Flat slots stay in the JVM; nested ones use Arrow."""
    nested = F.exists(F.map_values(slot_types), lambda t: t.isin("OBJECT", "ARRAY"))
    flat = F.array_sort(
        F.transform(
            F.map_entries(slot_types),
            lambda e: F.struct(
                e["key"].alias("path"),
                e["value"].alias("kind"),
                F.when(e["value"] != "NULL", F.element_at(slot_str, e["key"])).alias("text"),
            ),
        )
    )
    return F.when(nested, _flatten_nested(F.when(nested, slots_text))).otherwise(flat)


def _names_ancestor(path: tuple, text: str) -> bool:
    """A text that is an ancestor itself, or an identifying field of one, at any depth of ``derived_from`` lists."""
    own = 1  # steps from the list to the item, then from an item to one of its own ancestors
    while path[own : own + 1] == ("derived_from",) and isinstance(path[own + 1], int):
        own += 2
    field = path[own:]
    if not field:
        return True
    names = C.ANCESTOR_PROVENANCE_KEYS if field[0] == "provenance" and len(field) == 2 else C.ANCESTOR_KEYS if len(field) == 1 else ()
    return text != "" and field[-1] in names


@F.pandas_udf(ArrayType(StringType()))
def ancestor_ids(values: pd.Series) -> pd.Series:
    """Flatten a recursive ancestry JSON list into identifiers and category words."""

    def flat(text: str):
        value = _load(text)
        if not isinstance(value, list):
            return []
        return [node for path, node in _nodes(value) if isinstance(node, str) and _names_ancestor(path, node)]

    return values.map(lambda t: None if t is None else flat(t))


@F.pandas_udf(StringType())
def row_hash_payload(values: pd.Series) -> pd.Series:
    """Canonical text of a held-out row without its hash, its ancestry list put in a fixed order."""

    def payload(text: str) -> str | None:
        row = _load(text)
        if not isinstance(row, dict):
            return None
        row.pop("content_hash", None)
        if isinstance(row.get("derived_from"), list):
            row["derived_from"] = sorted(
                row["derived_from"], key=lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)
            )
        return json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return per_text(payload)(values)


@F.pandas_udf(BooleanType())
def has_key_fragment(values: pd.Series) -> pd.Series:
    """True when any key at any depth holds one of the gold-only fragments."""

    def found(value) -> bool:
        if isinstance(value, dict):
            return any(any(f in k.lower() for f in C.GOLD_FRAGMENTS) or found(v) for k, v in value.items())
        return isinstance(value, list) and any(found(v) for v in value)

    return values.map(lambda t: None if t is None else found(_load(t)))


def stable_hash_text(col: Column) -> Column:
    """SHA-256 over the JSON literal of a text, as the published value hashes are built."""
    from pactlane.functions.contract import json_literal

    return F.sha2(json_literal(col), 256)
