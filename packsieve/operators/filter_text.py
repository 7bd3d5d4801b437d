"""Predicate trees as display-filter text, and what a filter's text mentions.

The text is the join key of recorded executions: fully parenthesised, so equal
trees give equal text.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsieve.operators.predicates import Both, Field, Leaf, Neither, Refused, Scalar, Tree, children, refusal

# How the comparisons are spelled.
SPELLING = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "contains": "contains"}
# Words of the filter language that are not field names.
KEYWORDS = ("all", "and", "any", "contains", "eq", "false", "ge", "gt", "in", "le", "lt", "matches", "ne", "not", "or", "true", "xor")


def spelled(value: Scalar, field: Field) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if field.kind in ("ipv4", "ipv6"):
        return str(ipaddress.ip_address(value))
    if field.kind == "string":
        if any(ord(c) < 0x20 for c in value):
            raise Refused("type_mismatch", "control characters have no spelling")
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return value if isinstance(value, str) else repr(value)


def text(tree: Tree, catalog: Mapping[str, Field]) -> str:
    """The tree as filter text."""
    if code := refusal(tree, catalog):
        raise Refused(code, f"the catalog refuses the tree: {code}")

    def of(t: Tree) -> str:
        if isinstance(t, Leaf):
            field = catalog[t.field]
            if t.op == "exists":
                return f"({t.field})"
            if t.op == "in":
                return f"({t.field} in {{{', '.join(spelled(v, field) for v in t.value)}}})"
            if t.op == "in_subnet":
                return f"({t.field} == {ipaddress.ip_network(t.value, strict=False)})"
            return f"({t.field} {SPELLING[t.op]} {spelled(t.value, field)})"
        if isinstance(t, Neither):
            return f"(!{of(t.part)})"
        return "(" + (" && " if isinstance(t, Both) else " || ").join(map(of, children(t))) + ")"

    return of(tree)


def exactly(facts: Mapping[str, object], shown: Mapping[str, Field]) -> Column:
    """A frame with just these facts: each has the value in every occurrence, every other shown field is absent."""
    is_value = lambda v: lambda o: o == F.lit(v)
    out = F.lit(True)
    for name, field in shown.items():
        col = F.col(f"`{field.column or name}`")
        if name not in facts:
            test = col.isNull()
        elif field.many:
            test = F.coalesce((F.size(col) > 0) & F.forall(col, is_value(facts[name])), F.lit(False))
        else:
            test = F.coalesce(col == F.lit(facts[name]), F.lit(False))
        out = out & test
    return out


# What a filter's text mentions (B9), as columns over a text column. Text in quotes
# counts for literals only. The spellings of the filter language.
QUOTED = r"""r?"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,2})?"
MAC = r"[0-9A-Fa-f]{1,2}([:.-])[0-9A-Fa-f]{1,2}(?:\1[0-9A-Fa-f]{1,2}){4}|[0-9A-Fa-f]{4}([:.-])[0-9A-Fa-f]{4}\2[0-9A-Fa-f]{4}"
INTEGER = r"0[xX][0-9A-Fa-f]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*"
FIELD = r"[A-Za-z0-9_][A-Za-z0-9_.-]*"
WORD = r"[A-Za-z0-9_.:/-]+"
# Names that the generated captures use; such a name is a string literal without quotes too.
GENERATED_NAME = r"(?i)((?:probe|witness)-\d+-\d+)"


def bare(filter_text: Column) -> Column:
    """The text with what is quoted blanked out."""
    return F.regexp_replace(filter_text, QUOTED, " ")


def words(filter_text: Column) -> Column:
    """Words outside quotes; a set range ``a..b`` gives two."""
    found = F.regexp_extract_all(bare(filter_text), F.lit(WORD), F.lit(0))
    return F.filter(F.flatten(F.transform(found, lambda w: F.split(w, r"\.\."))), lambda p: p != "")


def strings(filter_text: Column) -> Column:
    """What stands in quotes, without them."""
    return F.transform(
        F.regexp_extract_all(filter_text, F.lit(QUOTED), F.lit(0)),
        lambda s: F.when(s.startswith("r"), F.substr(s, F.lit(3), F.length(s) - 3)).otherwise(F.substr(s, F.lit(2), F.length(s) - 2)),
    )


def whole(x: Column, pattern: str) -> Column:
    return x.rlike(f"^(?:{pattern})$")


def references(filter_text: Column) -> Column:
    """A struct of arrays: fields (each once, in order), addresses, macs, numbers, strings (in quotes, or generated names without), and disjunctions (a count)."""
    loose, quoted = words(filter_text), strings(filter_text)
    both = F.concat(quoted, loose)
    is_literal = lambda w: whole(w, IPV4) | whole(w, MAC) | whole(w, INTEGER)
    generated = F.filter(loose, lambda w: ~is_literal(w) & w.rlike(GENERATED_NAME))
    named = F.filter(loose, lambda w: ~is_literal(w) & ~w.rlike(GENERATED_NAME) & whole(w, FIELD) & w.rlike("[A-Za-z_]") & ~F.lower(w).isin(*KEYWORDS))
    ors = F.size(F.filter(loose, lambda w: F.lower(w) == "or")) + F.regexp_count(bare(filter_text), F.lit(r"\|\|"))
    return F.struct(
        F.array_distinct(named).alias("fields"),
        F.filter(both, lambda w: whole(w, IPV4)).alias("addresses"),
        F.filter(both, lambda w: ~whole(w, IPV4) & whole(w, MAC)).alias("macs"),
        F.filter(both, lambda w: ~whole(w, IPV4) & ~whole(w, MAC) & whole(w, INTEGER)).alias("numbers"),
        F.concat(F.filter(quoted, lambda w: ~is_literal(w)), generated).alias("strings"),
        ors.alias("disjunctions"),
    )
