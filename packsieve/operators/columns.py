"""Predicate trees as Spark columns.

Logic is two-valued: a leaf over an absent field is false, so its negation is
true. Every leaf is therefore coalesced to false before it is combined. A field
that occurs several times in a frame is an array; a leaf holds if some occurrence
does, but ``ne`` means present and every occurrence differs.

Coalesced leaves do not reach a Parquet scan. ``pushable`` gives what may be
added as a plain ``where`` before them: conjuncts that are implied by the tree.
"""

from __future__ import annotations

import functools
import ipaddress
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsieve.operators.predicates import Both, Either, Field, Leaf, Neither, Refused, Scalar, Tree, children, refusal


def literal(value: Scalar, field: Field) -> Column:
    """A value as the frames table stores this kind: addresses as numbers (v4) or 16 bytes (v6), bytes as binary."""
    if field.kind == "ipv4":
        return F.lit(int(ipaddress.IPv4Address(value))).cast("long")
    if field.kind == "ipv6":
        return F.lit(bytearray(ipaddress.IPv6Address(value).packed))
    if field.kind == "bytes":
        return F.lit(bytearray.fromhex(value.replace(":", "")))
    if field.kind == "integer":
        return F.lit(value) if abs(value) < 1 << 63 else F.lit(str(value)).cast("decimal(20,0)")
    return F.lit(value)


def bounds(network: str, field: Field) -> tuple[Column, Column]:
    """First and last address of a network; host bits are allowed."""
    net = ipaddress.ip_network(network, strict=False)
    return literal(str(net.network_address), field), literal(str(net.broadcast_address), field)


def holds(x: Leaf, field: Field, col: Column) -> Column:
    """The leaf on one occurrence; null where the occurrence is."""
    if x.op == "in_subnet":
        low, high = bounds(x.value, field)
        return (col >= low) & (col <= high)
    if x.op == "in":
        return col.isin(*[literal(v, field) for v in x.value])
    v = literal(x.value, field)
    return {
        "eq": lambda: col == v, "ne": lambda: col != v, "lt": lambda: col < v, "le": lambda: col <= v,
        "gt": lambda: col > v, "ge": lambda: col >= v, "contains": lambda: F.contains(col, v),
    }[x.op]()


def leaf_column(x: Leaf, catalog: Mapping[str, Field]) -> Column:
    field = catalog[x.field]
    col = F.col(f"`{field.column or x.field}`")
    no = F.lit(False)
    if field.kind == "protocol":
        return F.coalesce(col, no)
    if not field.many:
        return col.isNotNull() if x.op == "exists" else F.coalesce(holds(x, field, col), no)
    if x.op == "exists":
        return F.coalesce(F.size(F.filter(col, lambda o: o.isNotNull())) > 0, no)
    if x.op == "ne":
        return F.coalesce((F.size(col) > 0) & F.forall(col, lambda o: holds(x, field, o)), no)
    return F.coalesce(F.exists(col, lambda o: holds(x, field, o)), no)


def column(tree: Tree, catalog: Mapping[str, Field]) -> Column:
    """The tree as a boolean column that is never null."""
    if code := refusal(tree, catalog):
        raise Refused(code, f"the catalog refuses the tree: {code}")
    return _column(tree, catalog)


def _column(tree: Tree, catalog: Mapping[str, Field]) -> Column:
    if isinstance(tree, Leaf):
        return leaf_column(tree, catalog)
    parts = [_column(p, catalog) for p in children(tree)]
    if isinstance(tree, Neither):
        return ~parts[0]
    return functools.reduce(lambda a, b: a & b if isinstance(tree, Both) else a | b, parts)


def pushable(tree: Tree, catalog: Mapping[str, Field]) -> Column | None:
    """A condition that the tree implies and that a scan can use, or None: bare leaves of single-valued fields."""
    if isinstance(tree, Leaf):
        field = catalog[tree.field]
        if field.many or field.kind in ("protocol", "ipv6", "bytes"):
            return None
        col = F.col(f"`{field.column or tree.field}`")
        return col.isNotNull() if tree.op == "exists" else holds(tree, field, col)
    parts = [pushable(p, catalog) for p in children(tree)]
    if isinstance(tree, Both):
        some = [p for p in parts if p is not None]
        return functools.reduce(lambda a, b: a & b, some) if some else None
    if isinstance(tree, Either) and all(p is not None for p in parts):
        return functools.reduce(lambda a, b: a | b, parts)
    return None
