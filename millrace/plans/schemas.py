"""Schemas of what the operators give: ordered names with their types."""

from __future__ import annotations

Types = dict[str, str]


def qualified(schema: Types, alias: str) -> Types:
    """A table's columns under an alias."""
    return {f"{alias}.{name}": kind for name, kind in schema.items()}


def joined(left: Types, right: Types) -> Types:
    """Left columns, then right ones."""
    return left | right


def projected(schema: Types, names: tuple[str, ...] | list[str]) -> Types:
    """Some columns, in the order of the names."""
    return {name: schema[name] for name in names}


def summed(kind: str) -> Types:
    return {"SUM": kind}


def grouped(schema: Types, kind: str, keys: tuple[str, ...]) -> Types:
    """SUM, then the keys."""
    return summed(kind) | projected(schema, keys)
