"""Relation rules as rows of one table, and the two small tables that walks join with.

A namespace is a list of rules: relation, kind, and up to two arguments. Several rules of one
relation are a union, and a relation without any is granted by its own tuples. What holds
between relations is computed on the rows: ``implies`` is the closure of the computed rules
under composition, ``ttu`` joins it with the containment rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The kinds of rules, and the names of their arguments in JSON.
DIRECT, COMPUTED, CONTAINED, UNION = "this", "computed_userset", "tuple_to_userset", "union"
ARGUMENTS = {DIRECT: (), COMPUTED: ("relation",), CONTAINED: ("tupleset", "computed_relation", "both_directions")}


class Rule(NamedTuple):
    """``relation`` of an object is granted by its own tuples (``DIRECT``), by ``arguments[0]`` of the same
    object (``COMPUTED``), or by ``arguments[1]`` of the objects that its ``arguments[0]`` tuples name
    (``CONTAINED``; ``arguments[2]``: containment is read both ways)."""

    relation: str
    kind: str
    arguments: tuple = ()


def rule(relation: str, kind: str, *arguments: Any) -> Rule:
    if kind not in ARGUMENTS:
        raise ValueError(f"unknown kind of rule: {kind!r}")
    if kind == CONTAINED and len(arguments) == 2:
        arguments = (*arguments, True)
    if len(arguments) != len(ARGUMENTS[kind]):
        raise ValueError(f"{kind} takes {ARGUMENTS[kind]}, not {arguments!r}")
    return Rule(relation, kind, arguments)


def rules_of_json(relation: str, spec: dict) -> list[Rule]:
    """The rules that a JSON description of one relation stands for; unions lie flat, whatever their
    depth. An unknown kind raises; it is never read as ``DIRECT``."""
    found, todo = [], [spec]
    while todo:
        d = todo.pop()
        kind = d.get("kind")
        if kind == UNION:
            todo.extend(reversed(d["children"]))
            continue
        names = ARGUMENTS.get(kind, ())
        found.append(rule(relation, kind, *(d[n] for n in names if n in d or n != "both_directions")))
    return found


class Namespace(NamedTuple):
    name: str
    rules: tuple[Rule, ...] = ()

    def to_json(self) -> dict:
        """A plain dump of the rows, by relation."""
        dumped: dict[str, list[dict]] = {}
        for r in self.rules:
            dumped.setdefault(r.relation, []).append({"kind": r.kind, **dict(zip(ARGUMENTS[r.kind], r.arguments))})
        return {"name": self.name, "relations": {k: v[0] if len(v) == 1 else {"kind": UNION, "children": v} for k, v in dumped.items()}}

    @staticmethod
    def from_json(d: dict) -> Namespace:
        return Namespace(d["name"], tuple(r for relation, spec in d["relations"].items() for r in rules_of_json(relation, spec)))

    def declared(self) -> list[str]:
        return list(dict.fromkeys(r.relation for r in self.rules))

    def computed(self, relation: str) -> set[str]:
        """Relations that one rule makes grant ``relation``."""
        return {r.arguments[0] for r in self.rules if r.relation == relation and r.kind == COMPUTED}


def default_namespaces(both_directions: bool = False) -> dict[str, Namespace]:
    """``doc`` and ``folder``: owner, editor (and owner), viewer (and editor, and viewer of a parent);
    ``group``: member and owner, of which neither implies the other.

    Containment is read one way, from an object's ``parent`` tuples; with ``both_directions`` also
    from tuples in which it is named as the parent's principal.
    """
    node = (
        rule("owner", DIRECT), rule("editor", DIRECT), rule("editor", COMPUTED, "owner"),
        rule("viewer", DIRECT), rule("viewer", COMPUTED, "editor"), rule("viewer", CONTAINED, "parent", "viewer", both_directions),
        rule("parent", DIRECT),
    )
    group = (rule("member", DIRECT), rule("owner", DIRECT))
    return {n: Namespace(n, rules) for n, rules in (("doc", node), ("folder", node), ("group", group))}


def implies_rows(namespaces: dict[str, Namespace]) -> list[tuple[str, str, str]]:
    """``(ns, held_rel, target_rel)``: identities of the declared relations, and the closure of the
    computed rules under composition."""
    held = {(n, r, r) for n, ns in namespaces.items() for r in ns.declared()}
    one = {(n, r.arguments[0], r.relation) for n, ns in namespaces.items() for r in ns.rules if r.kind == COMPUTED}
    while more := {(n, low, high) for n, low, mid in one for m, start, high in held if (m, start) == (n, mid)} - held:
        held |= more
    return sorted(held)


def ttu_rows(namespaces: dict[str, Namespace]) -> list[tuple[str, str, str, str, bool]]:
    """``(ns, rel, tupleset, computed_rel, both)``: the containment rules of a relation and of those that
    imply it."""
    rules = [(n, r.relation, r.arguments) for n, ns in namespaces.items() for r in ns.rules if r.kind == CONTAINED]
    return sorted({(n, target, *arguments) for n, relation, arguments in rules for m, low, target in implies_rows(namespaces) if (m, low) == (n, relation)})


def _frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """The rows, as many as rules are declared, as literals of the plan."""
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], schema)
    literal = lambda v: ("true" if v else "false") if isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def implies_table(spark: SparkSession, namespaces: dict[str, Namespace]) -> DataFrame:
    return _frame(spark, implies_rows(namespaces), "ns string, held_rel string, target_rel string")


def ttu_table(spark: SparkSession, namespaces: dict[str, Namespace]) -> DataFrame:
    return _frame(spark, ttu_rows(namespaces), "ns string, rel string, tupleset string, computed_rel string, both boolean")
