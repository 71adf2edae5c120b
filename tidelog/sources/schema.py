"""Schema as data: attributes are entities described by six bootstrap attributes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from tidelog.functions.values import ASSERT, STR, U64_TAG, Value, datom, text, u64, value_of

ONE, MANY = 0, 1
IDENT, CARDINALITY, TYPE, DOC, UNIQUE, TX_TIME = 1, 2, 3, 4, 5, 6
#: Id, name, type, documentation, unique.
BOOTSTRAP = [
    (IDENT, "db/attr/ident", STR, "Human readable name of attribute", True),
    (CARDINALITY, "db/attr/cardinality", U64_TAG, "Cardinality of attribyte", False),
    (TYPE, "db/attr/type", U64_TAG, "Data type of attribute", False),
    (DOC, "db/attr/doc", STR, "Documentation of attribute", False),
    (UNIQUE, "db/attr/unique", U64_TAG, "Indicates this attribute is unique", False),
    (TX_TIME, "db/tx/time", U64_TAG, "Transaction's wall clock time", False),
]


def bootstrap_rows() -> list[tuple]:
    """The 26 datoms that every log begins with."""
    rows = [datom(0, TX_TIME, u64(0), 0)]
    for i, ident, tag, doc, unique in BOOTSTRAP:
        parts = {IDENT: text(ident), DOC: text(doc), TYPE: u64(tag), CARDINALITY: u64(ONE)} | ({UNIQUE: u64(1)} if unique else {})
        rows += [datom(i, a, v, 0) for a, v in parts.items()]
    return rows


@dataclass(frozen=True)
class AttributeDefinition:
    """A new attribute: one-valued, not unique and without documentation unless said otherwise."""

    ident: str
    type: int
    card: int = ONE
    doc_text: str | None = None
    is_unique: bool = False

    def with_doc(self, doc: str) -> AttributeDefinition:
        return replace(self, doc_text=doc)

    def many(self) -> AttributeDefinition:
        return replace(self, card=MANY)

    def unique(self) -> AttributeDefinition:
        return replace(self, is_unique=True)

    def facts(self) -> list[tuple[str, Value]]:
        rows = [("db/attr/ident", text(self.ident)), ("db/attr/cardinality", u64(self.card)), ("db/attr/type", u64(self.type))]
        rows += [("db/attr/doc", text(self.doc_text))] if self.doc_text is not None else []
        return rows + ([("db/attr/unique", u64(1))] if self.is_unique else [])


@dataclass(frozen=True)
class Attribute:
    id: int
    ident: str
    type: int
    card: int
    unique: bool
    version: int


class IdentNotFound(Exception):
    """No attribute has this name at the basis."""


class Catalog:
    """The attributes as of a basis; small, and kept on the driver."""

    def __init__(self, attributes: Iterable[Attribute]):
        self.by_id = {x.id: x for x in attributes}
        self.by_ident = {x.ident: x for x in self.by_id.values()}

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> Catalog:
        """From the visible datoms of the schema attributes; one without name, type or cardinality is left out."""
        found: dict[int, dict] = {}
        for r in sorted(rows, key=lambda r: r[8]):
            if IDENT <= r[1] <= UNIQUE and r[9] == ASSERT:
                x = found.setdefault(r[0], {"version": 0})
                x[r[1]] = value_of(r).content
                x["version"] = max(x["version"], r[8])
        return cls(
            Attribute(e, x[IDENT], int(x[TYPE]), int(x[CARDINALITY]), x.get(UNIQUE) == 1, x["version"])
            for e, x in found.items()
            if {IDENT, TYPE, CARDINALITY} <= set(x) and 1 <= int(x[TYPE]) <= 5 and int(x[CARDINALITY]) in (ONE, MANY)
        )

    def resolve(self, name: str | int) -> Attribute | None:
        """By name, which must exist, or by id, which need not."""
        if isinstance(name, str):
            if name not in self.by_ident:
                raise IdentNotFound(name)
            return self.by_ident[name]
        return self.by_id.get(name)
