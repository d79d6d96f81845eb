"""Criteria of segments: validation of what users send."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "not_in", "contiene")
ORDERED = ("lt", "lte", "gt", "gte")


@dataclass(frozen=True)
class Criterion:
    """One condition on an attribute. `values` has one element but for in and not_in."""

    dimension: str
    operator: str
    values: tuple

    @property
    def value(self):
        return self.values[0]


def normalise(raw: Mapping, dimensions: Iterable[str], numeric: Iterable[str] = ()) -> Criterion:
    """A valid criterion, or ValueError: known dimension and operator, non-empty list, numbers for numeric dimensions."""
    dimension, operator = str(raw.get("dimension", "")).strip(), str(raw.get("operador", "eq")).strip()
    if dimension not in set(dimensions):
        raise ValueError(f"unknown dimension {dimension!r}")
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    value = raw.get("valor")
    many = operator in ("in", "not_in")
    values = tuple(value if isinstance(value, (list, tuple, set)) else [value]) if many else (value,)
    if not values or any(v is None or v == "" for v in values):
        raise ValueError("a criterion needs a value")
    if not many and isinstance(value, (list, tuple, set, dict)):
        raise ValueError(f"{operator} takes one value")
    is_number = dimension in set(numeric)
    if operator in ORDERED and not is_number:
        raise ValueError(f"{operator} needs a numeric dimension")
    if operator == "contiene" and is_number:
        raise ValueError("contiene needs a text dimension")
    try:
        values = tuple(float(v) if is_number else str(v) for v in values)
    except (TypeError, ValueError) as e:
        raise ValueError(f"{dimension} takes numbers") from e
    return Criterion(dimension, operator, values)


def from_catalogue(filters: Mapping, kinds: Mapping[str, str], categories: Mapping[str, Iterable[str]] | None = None) -> list[Criterion]:
    """Criteria of a filter {attribute: {en, min, max, desde, hasta}}: alternatives within an attribute's `en`, all parts together.

    kinds: categorico, numerico, fecha or derivado by attribute. Unknown attributes, operators for the kind, and categories are errors.
    """
    allowed = {"categorico": {"en"}, "numerico": {"min", "max"}, "derivado": {"en", "min", "max"}, "fecha": {"desde", "hasta"}}
    names = {"min": "gte", "desde": "gte", "max": "lte", "hasta": "lte", "en": "in"}
    out = []
    for attribute, parts in filters.items():
        if attribute not in kinds:
            raise ValueError(f"unknown attribute {attribute!r}")
        for part, value in parts.items():
            if part not in allowed[kinds[attribute]]:
                raise ValueError(f"{part} isn't an operator of {kinds[attribute]} attributes")
            if part == "en":
                unknown = set(value) - set((categories or {}).get(attribute, value))
                if unknown or not value:
                    raise ValueError(f"unknown categories {sorted(unknown)} of {attribute}")
            out.append(Criterion(attribute, names[part], tuple(value) if part == "en" else (value,)))
    return out
