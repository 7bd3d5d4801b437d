"""Typed predicate trees: the row-free half of filtering.

A tree is small and lives on the driver. It is read from JSON, checked against a
catalog of fields, and compiled to a Spark ``Column`` (``columns.py``) or to
filter text (``filter_text.py``). Nothing here looks at data.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

Scalar = bool | int | float | str

# The operators a leaf may have, and which field kinds take them.
OPERATORS = ("exists", "eq", "ne", "lt", "le", "gt", "ge", "contains", "in", "in_subnet")
ORDERED = ("lt", "le", "gt", "ge")
KINDS = ("protocol", "boolean", "integer", "float", "string", "bytes", "ipv4", "ipv6", "unsupported")
VERSION = "1.0"
NAME = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_-]*(?:\.[A-Za-z0-9_][A-Za-z0-9_-]*)*")
NAME_BYTES, REPLY_BYTES = 256, 64 * 1024
# Slots that a question may leave open.
SLOTS = ("address", "direction", "field", "port", "protocol", "value")
BYTES = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})*")


class Refused(ValueError):
    """A tree, reply or value that is refused; ``code`` is stable."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Scalar | tuple[Scalar, ...] | None = None


@dataclass(frozen=True)
class Both:
    """All of two or more."""

    parts: tuple[Tree, ...]


@dataclass(frozen=True)
class Either:
    """Any of two or more."""

    parts: tuple[Tree, ...]


@dataclass(frozen=True)
class Neither:
    """Not."""

    part: Tree


Tree = Leaf | Both | Either | Neither
GROUPS = {"all": Both, "any": Either}


def children(tree: Tree) -> tuple[Tree, ...]:
    return tree.parts if isinstance(tree, Both | Either) else (tree.part,) if isinstance(tree, Neither) else ()


def rebuilt(tree: Tree, parts: Sequence[Tree]) -> Tree:
    """The same node over other children."""
    return Neither(parts[0]) if isinstance(tree, Neither) else type(tree)(tuple(parts))


def leaf(field: str, op: str, value: object = None) -> Leaf:
    """A leaf whose shape has been checked."""
    if not isinstance(field, str) or not NAME.fullmatch(field) or len(field.encode()) > NAME_BYTES:
        raise Refused("malformed", f"not a field name: {field!r}")
    if op not in OPERATORS:
        raise Refused("malformed", f"not an operator: {op!r}")
    if op == "exists":
        if value is not None:
            raise Refused("malformed", "exists takes no value")
    elif op == "in":
        if not isinstance(value, list | tuple) or not value:
            raise Refused("malformed", "in takes a list of one or more values")
        value = tuple(value)
    elif op == "in_subnet" and not isinstance(value, str):
        raise Refused("malformed", "in_subnet takes an address with a prefix")
    for v in value if isinstance(value, tuple) else () if value is None else (value,):
        if not isinstance(v, bool | int | float | str):
            raise Refused("malformed", f"not a scalar: {v!r}")
    if op not in ("exists", "in") and (value is None or isinstance(value, tuple)):
        raise Refused("malformed", f"{op} takes one value")
    return Leaf(field, op, value)


def from_object(node: object) -> Tree:
    """A tree from decoded JSON; keys other than the expected are refused."""
    if not isinstance(node, dict):
        raise Refused("malformed", "a node is an object")
    kind = node.get("kind")
    keys = set(node) - {"kind"}
    if kind == "predicate" and keys <= {"field", "operator", "value"} and {"field", "operator"} <= keys:
        return leaf(node["field"], node["operator"], node.get("value"))
    if kind == "not" and keys == {"child"}:
        return Neither(from_object(node["child"]))
    if kind in GROUPS and keys == {"children"} and isinstance(node["children"], list) and len(node["children"]) >= 2:
        return GROUPS[kind](tuple(map(from_object, node["children"])))
    raise Refused("malformed", f"not a node: {kind!r} with {sorted(keys)}")


def to_object(tree: Tree) -> dict:
    if isinstance(tree, Leaf):
        out = {"kind": "predicate", "field": tree.field, "operator": tree.op}
        return out if tree.value is None else out | {"value": list(tree.value) if isinstance(tree.value, tuple) else tree.value}
    if isinstance(tree, Neither):
        return {"kind": "not", "child": to_object(tree.part)}
    return {"kind": "all" if isinstance(tree, Both) else "any", "children": [to_object(p) for p in tree.parts]}


def from_json(text: str) -> Tree:
    """A tree from a document ``{"ir_schema_version", "scope": "packet", "expression"}``."""
    try:
        document = json.loads(text)
    except ValueError:
        raise Refused("malformed", "not JSON") from None
    if not isinstance(document, dict) or set(document) != {"ir_schema_version", "scope", "expression"}:
        raise Refused("malformed", "not an intent document")
    if document["ir_schema_version"] != VERSION or document["scope"] != "packet":
        raise Refused("malformed", "another version or scope")
    return from_object(document["expression"])


def canonical_json(value: object) -> str:
    """Sorted keys, no white space, Unicode kept; numbers that JSON lacks are refused."""

    def finite(v: object) -> None:
        if isinstance(v, float) and not math.isfinite(v):
            raise Refused("malformed", "not a finite number")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, list | tuple) else ():
            finite(x)

    finite(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_json(tree: Tree) -> str:
    return canonical_json({"ir_schema_version": VERSION, "scope": "packet", "expression": to_object(tree)})


def canonical(tree: Tree) -> Tree:
    """Nested groups of one kind flattened, children and ``in`` lists in order of their JSON; repeats stay."""
    if isinstance(tree, Leaf):
        return Leaf(tree.field, tree.op, tuple(sorted(tree.value, key=canonical_json))) if isinstance(tree.value, tuple) else tree
    parts = [canonical(p) for p in children(tree)]
    if isinstance(tree, Neither):
        return Neither(parts[0])
    flat = [q for p in parts for q in (p.parts if type(p) is type(tree) else (p,))]
    return rebuilt(tree, sorted(flat, key=lambda p: canonical_json(to_object(p))))


def key(tree: Tree) -> str:
    """The digest of the canonical form: equal for trees that differ in order and nesting only."""
    return hashlib.sha256(canonical_json(to_object(canonical(tree))).encode()).hexdigest()


def depth(tree: Tree) -> int:
    """Logical nodes on the longest path."""
    return 0 if isinstance(tree, Leaf) else 1 + max(map(depth, children(tree)))


def leaves(tree: Tree, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Leaf]]:
    """The leaves in preorder, with their child numbers from the root."""
    if isinstance(tree, Leaf):
        yield path, tree
    for i, part in enumerate(children(tree)):
        yield from leaves(part, (*path, i))


@dataclass(frozen=True)
class Field:
    """A catalog entry: what a field is, and the column of the frames table that holds it."""

    name: str
    kind: str
    column: str | None = None
    raw: str | None = None
    many: bool = False
    protocol: str = ""
    display: str = ""


def value_fits(value: Scalar, field: Field) -> bool:
    """Whether a value is of the field's type. Booleans are never numbers."""
    kind = field.kind
    if kind == "boolean":
        return isinstance(value, bool)
    if kind == "integer":
        if isinstance(value, bool) or not isinstance(value, int):
            return False
        m = re.fullmatch(r"FT_(U?)INT(\d+)", field.raw or "FT_INT64")
        unsigned, bits = (m[1], int(m[2])) if m else ("", 64)
        low, high = (0, (1 << bits) - 1) if unsigned else (-(1 << bits - 1), (1 << bits - 1) - 1)
        return low <= value <= high
    if kind == "float":
        return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
    if kind == "string":
        return isinstance(value, str)
    if kind == "bytes":
        return isinstance(value, str) and BYTES.fullmatch(value) is not None
    if kind in ("ipv4", "ipv6"):
        try:
            return isinstance(value, str) and ipaddress.ip_address(value).version == int(kind[-1])
        except ValueError:
            return False
    return False


def code_of(x: Leaf, catalog: Mapping[str, Field]) -> str | None:
    """Why this leaf is refused, or None: unknown_field, unsupported_type, unsupported_operator, type_mismatch."""
    field = catalog.get(x.field)
    if field is None:
        return "unknown_field"
    if field.kind == "unsupported":
        return "unsupported_type"
    if x.op == "exists":
        return None
    if field.kind == "protocol":
        return "unsupported_operator"
    if x.op in ORDERED and field.kind not in ("integer", "float") or x.op == "contains" and field.kind not in ("string", "bytes"):
        return "unsupported_operator"
    if x.op == "in_subnet":
        if field.kind not in ("ipv4", "ipv6"):
            return "unsupported_operator"
        try:
            return None if ipaddress.ip_network(x.value, strict=False).version == int(field.kind[-1]) else "type_mismatch"
        except ValueError:
            return "type_mismatch"
    values = x.value if isinstance(x.value, tuple) else (x.value,)
    return None if all(value_fits(v, field) for v in values) else "type_mismatch"


def refusal(tree: Tree, catalog: Mapping[str, Field]) -> str | None:
    """The code of the first leaf, in preorder, that is refused."""
    return next((c for _, x in leaves(tree) if (c := code_of(x, catalog))), None)


@dataclass(frozen=True)
class Reply:
    """What a reply holds. ``status``: ready, needs_clarification or not_expressible."""

    status: str
    tree: Tree | None = None
    question: str | None = None
    missing: tuple[str, ...] = ()
    assumptions: tuple[str, ...] = ()


def read_reply(text: str) -> Reply:
    """The envelope of a reply, read strictly: no extraction from prose, no repair, at most 64 KiB."""
    if len(text.encode("utf-8", "surrogatepass")) > REPLY_BYTES:
        raise Refused("malformed", "the reply is too long")
    try:
        x = json.loads(text)
    except (ValueError, RecursionError):
        raise Refused("malformed", "not JSON") from None
    if not isinstance(x, dict) or not set(x) <= {"schema_version", "status", "assumptions", "clarifying_question", "missing_slots", "intent_ir"}:
        raise Refused("malformed", "not an envelope")
    status, ir = x.get("status"), x.get("intent_ir")
    question, missing, assumptions = x.get("clarifying_question"), x.get("missing_slots", []), x.get("assumptions", [])
    if x.get("schema_version", VERSION) != VERSION or not isinstance(missing, list) or not isinstance(assumptions, list) or not isinstance(question, str | None):
        raise Refused("malformed", "a member of another type or version")
    if not all(isinstance(s, str) for s in (*missing, *assumptions)) or not set(missing) <= set(SLOTS) or len(set(missing)) < len(missing):
        raise Refused("malformed", "slots and assumptions are text, and slots are known and told once")
    ready, asks = status == "ready", status == "needs_clarification"
    if status not in ("ready", "needs_clarification", "not_expressible") or ready != (ir is not None) or asks != bool(question) or asks != (question is not None) or missing and not asks:
        raise Refused("malformed", "the payload does not go with the status")
    tree = from_json(json.dumps(ir)) if ready else None
    return Reply(status, tree, question, tuple(missing), tuple(assumptions))


def reply_schema() -> dict:
    """The JSON Schema of the envelope."""
    scalar = {"type": ["boolean", "number", "string"]}
    text = {"type": "string"}
    node = {"$ref": "#/$defs/node"}
    group = {"type": "object", "additionalProperties": False, "required": ["kind", "children"],
             "properties": {"kind": {"enum": list(GROUPS)}, "children": {"type": "array", "minItems": 2, "items": node}}}
    negation = {"type": "object", "additionalProperties": False, "required": ["kind", "child"], "properties": {"kind": {"const": "not"}, "child": node}}
    predicate = {"type": "object", "additionalProperties": False, "required": ["kind", "field", "operator"],
                 "properties": {"kind": {"const": "predicate"}, "field": text | {"pattern": f"^{NAME.pattern}$", "maxLength": NAME_BYTES},
                                "operator": {"enum": list(OPERATORS)}, "value": {"anyOf": [scalar, {"type": "array", "minItems": 1, "items": scalar}]}}}
    intent = {"type": "object", "additionalProperties": False, "required": ["ir_schema_version", "scope", "expression"],
              "properties": {"ir_schema_version": {"const": VERSION}, "scope": {"const": "packet"}, "expression": node}}
    strings = {"type": "array", "items": text}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {"node": {"anyOf": [predicate, group, negation]}}, "type": "object",
            "additionalProperties": False, "required": ["status"],
            "properties": {"status": {"enum": ["ready", "needs_clarification", "not_expressible"]}, "assumptions": strings,
                           "clarifying_question": text, "missing_slots": strings, "intent_ir": intent}}
