"""JSON Schema 2020-12 of a shape, for readers outside Spark."""

from __future__ import annotations

from tidemark.shapes import FLOATS, INTEGERS, PROFILES, Shape

DIALECT = "https://json-schema.org/draft/2020-12/schema"


def schema_of(shape: Shape) -> dict:
    k = shape.kind
    if k in INTEGERS:
        least, largest, _ = INTEGERS[k]
        return {"type": "integer", "minimum": least, "maximum": largest}
    if k in FLOATS:
        return {"type": "number", "x-profile": k}
    if k in ("bool", "string"):
        return {"type": {"bool": "boolean"}.get(k, k)}
    if k in PROFILES:
        return {"type": "string", "x-profile": k}
    if k == "bytes":
        return {"type": "array", "items": {"type": "integer", "minimum": 0, "maximum": 255}}
    if k == "option":
        return {"anyOf": [schema_of(shape.item), {"type": "null"}]}
    if k == "map":
        return {"type": "object", "additionalProperties": schema_of(shape.item)}
    if k in ("list", "array", "set"):
        out = {"type": "array", "items": schema_of(shape.item)}
        if k == "array":
            out |= {"minItems": shape.size, "maxItems": shape.size}
        return out | ({"x-membership": shape.rule} if k == "set" else {})
    if k == "tuple":
        n = len(shape.items)
        return {"type": "array", "prefixItems": [schema_of(s) for s in shape.items], "minItems": n, "maxItems": n}
    if k == "record":
        members = sorted(shape.members, key=lambda m: m.name)
        return {"type": "object", "properties": {m.name: schema_of(m.shape) for m in members}, "required": [m.name for m in members if not m.optional], "additionalProperties": False}
    units = [t for t, kind, _ in shape.variants if kind == "unit"]
    others = [{"type": "object", "properties": {t: schema_of(s)}, "required": [t], "additionalProperties": False} for t, _, s in shape.variants if s is not None]
    return {"oneOf": ([{"enum": sorted(units)}] if units else []) + others}


def document(shape: Shape, title: str) -> dict:
    return {"$schema": DIALECT, "title": title} | schema_of(shape)
