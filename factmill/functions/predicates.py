"""Predicates over the columns of a table, and their algebra.

A predicate is an immutable tree of leaves, And, Or and Not. Comparisons know their
domain, the set of values they accept as a union of intervals; implication between them
is inclusion of domains, from which subsumption, contradiction and tautology follow.
Trees compile to Spark columns; membership leaves (`In`) become joins in
`factmill.operators.execute`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Set
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructType

#: The column that holds an entity's tags: an unsigned 64-bit word, kept in a long.
TAG_WORD = "mask"

#: A point of the value line: (value, 0) lies just before the value, (value, 1) just behind.
_LOW, _HIGH = (-math.inf, -1), (math.inf, 2)


class Matcher:
    """Base of all predicates. Own leaves override to_column, and what they know of the algebra."""

    is_static = True

    def __and__(self, other: Matcher) -> Matcher:
        return And(self, other)

    def __or__(self, other: Matcher) -> Matcher:
        return Or(self, other)

    def __invert__(self) -> Matcher:
        return Not(self)

    def to_column(self, schema: StructType | None = None, strict_ieee: bool = False) -> Column:
        raise NotImplementedError

    def implies_(self, other: Matcher) -> bool:
        return False

    def negate_(self) -> Matcher:
        return Not(self)

    def simplify_(self) -> Matcher:
        return self

    def required_bits_(self) -> int:
        return 0


@dataclass(frozen=True)
class Always(Matcher):
    def to_column(self, schema=None, strict_ieee=False):
        return F.lit(True)

    def negate_(self):
        return Never()


@dataclass(frozen=True)
class Never(Matcher):
    def to_column(self, schema=None, strict_ieee=False):
        return F.lit(False)

    def negate_(self):
        return Always()


@dataclass(frozen=True)
class _Compare(Matcher):
    field: str
    value: Any

    def domain(self) -> list[tuple[tuple, tuple]]:
        raise NotImplementedError

    def _same_line(self, other: Matcher) -> bool:
        return isinstance(other, _Compare) and self.field == other.field and isinstance(self.value, str) == isinstance(other.value, str)

    def implies_(self, other):
        if isinstance(other, Prefix):
            return isinstance(self, Eq) and self.field == other.field and isinstance(self.value, str) and self.value.startswith(other.prefix)
        if not self._same_line(other):
            return False
        return all(any(a <= low and high <= b for a, b in other.domain()) for low, high in self.domain())

    def _sides(self, schema: StructType | None) -> tuple[Column, Column, bool]:
        kind = schema[self.field].dataType if schema is not None and self.field in schema.fieldNames() else None
        column, value = F.col(self.field), self.value
        if self.field == TAG_WORD and isinstance(value, int) and isinstance(kind, (LongType, type(None))):
            literal = F.lit(signed(value % (1 << 64)))
            if isinstance(self, (Lt, Ge)):  # words are unsigned: the sign bit turned over gives longs their order
                column, literal = (x.bitwiseXOR(F.lit(signed(1 << 63))) for x in (column, literal))
            return column, literal, False
        literal = F.lit(value)
        if isinstance(kind, FloatType):
            literal = literal.cast("float")
        return column, literal, isinstance(kind, (FloatType, DoubleType))


def _ends(value: Any) -> tuple[tuple, tuple]:
    """The line's ends for numbers; text is a line of its own, below which nothing is."""
    return (("", -1), (_TextEnd(), 2)) if isinstance(value, str) else (_LOW, _HIGH)


class _TextEnd:
    """Greater than any text."""

    def __lt__(self, other):
        return False

    def __gt__(self, other):
        return not isinstance(other, _TextEnd)

    def __le__(self, other):
        return isinstance(other, _TextEnd)

    def __ge__(self, other):
        return True

    def __eq__(self, other):
        return isinstance(other, _TextEnd)

    __hash__ = object.__hash__


class Eq(_Compare):
    def domain(self):
        return [((self.value, 0), (self.value, 1))]

    def negate_(self):
        return Ne(self.field, self.value)

    def to_column(self, schema=None, strict_ieee=False):
        column, literal, floating = self._sides(schema)
        return (column == literal) & ~F.isnan(column) if strict_ieee and floating else column == literal

    def required_bits_(self):
        return self.value % (1 << 64) if self.field == TAG_WORD and isinstance(self.value, int) else 0


class Ne(_Compare):
    def domain(self):
        low, high = _ends(self.value)
        return [(low, (self.value, 0)), ((self.value, 1), high)]

    def negate_(self):
        return Eq(self.field, self.value)

    def to_column(self, schema=None, strict_ieee=False):
        column, literal, floating = self._sides(schema)
        return (column != literal) | F.isnan(column) if strict_ieee and floating else column != literal


class Lt(_Compare):
    def domain(self):
        return [(_ends(self.value)[0], (self.value, 0))]

    def negate_(self):
        return Ge(self.field, self.value)

    def to_column(self, schema=None, strict_ieee=False):
        column, literal, _ = self._sides(schema)
        return column < literal


class Ge(_Compare):
    def domain(self):
        return [((self.value, 0), _ends(self.value)[1])]

    def negate_(self):
        return Lt(self.field, self.value)

    def to_column(self, schema=None, strict_ieee=False):
        column, literal, floating = self._sides(schema)
        return (column >= literal) & ~F.isnan(column) if strict_ieee and floating else column >= literal


@dataclass(frozen=True)
class Prefix(Matcher):
    """Text that begins with `prefix`, by characters; an empty prefix takes every text."""

    field: str
    prefix: str

    def to_column(self, schema=None, strict_ieee=False):
        return F.col(self.field).startswith(self.prefix)

    def implies_(self, other):
        return isinstance(other, Prefix) and self.field == other.field and self.prefix.startswith(other.prefix)


@dataclass(frozen=True)
class HasTags(Matcher):
    """Tag words that hold all of `bits`, whatever else they hold."""

    bits: int
    field: str = TAG_WORD

    def to_column(self, schema=None, strict_ieee=False):
        bits = F.lit(signed(self.bits))
        return F.col(self.field).bitwiseAND(bits) == bits

    def implies_(self, other):
        return isinstance(other, HasTags) and self.field == other.field and self.bits & other.bits == other.bits

    def required_bits_(self):
        return self.bits if self.field == TAG_WORD else 0


@dataclass(frozen=True, eq=False)
class Kernel(Matcher):
    """A vectorised predicate of the user's own: a function of pandas Series, one to each field, to a boolean Series.

    Runs as a Pandas UDF beside the built-in conditions, which still reach the scan.
    """

    names: tuple[str, ...]
    function: Callable

    def to_column(self, schema=None, strict_ieee=False):
        return F.pandas_udf(self.function, "boolean")(*map(F.col, self.names))


@dataclass(frozen=True, eq=False)
class In(Matcher):
    """The field's value is among `values`, the single column of a DataFrame. A null is in no set."""

    field: str
    values: DataFrame

    is_static = False


class _Many(Matcher):
    """And, Or: flat, with operands in the order given."""

    def __init__(self, *parts: Matcher):
        flat: list[Matcher] = []
        for p in parts:
            flat.extend(p.parts if type(p) is type(self) else (p,))
        self.parts = tuple(flat)

    @property
    def is_static(self) -> bool:
        return all(p.is_static for p in self.parts)

    def __eq__(self, other):
        return type(self) is type(other) and all(p in other.parts for p in self.parts) and all(p in self.parts for p in other.parts)

    def __hash__(self):
        return hash((type(self), frozenset(map(hash, self.parts))))

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(map(repr, self.parts))})"


class And(_Many):
    @staticmethod
    def from_list(parts: Iterable[Matcher]) -> Matcher:
        parts = list(parts)
        return Always() if not parts else parts[0] if len(parts) == 1 else And(*parts)

    def to_column(self, schema=None, strict_ieee=False):
        return reduce(lambda a, b: a & b, (p.to_column(schema, strict_ieee) for p in self.parts))

    def required_bits_(self):
        return reduce(lambda a, b: a | b, map(required_bits, self.parts), 0)


class Or(_Many):
    @staticmethod
    def from_list(parts: Iterable[Matcher]) -> Matcher:
        parts = list(parts)
        return Never() if not parts else parts[0] if len(parts) == 1 else Or(*parts)

    def to_column(self, schema=None, strict_ieee=False):
        return reduce(lambda a, b: a | b, (p.to_column(schema, strict_ieee) for p in self.parts))

    def required_bits_(self):
        return reduce(lambda a, b: a & b, map(required_bits, self.parts))


@dataclass(frozen=True)
class Not(Matcher):
    part: Matcher

    @property
    def is_static(self) -> bool:
        return self.part.is_static

    def to_column(self, schema=None, strict_ieee=False):
        return ~self.part.to_column(schema, strict_ieee)

    def negate_(self):
        return self.part


def signed(bits: int) -> int:
    """A 64-bit word as Spark's long holds it."""
    if not 0 <= bits < 1 << 64:
        raise ValueError("a tag word has 64 bits")
    return bits - (1 << 64) if bits >> 63 else bits


def negate(m: Matcher) -> Matcher:
    """The complement in one step: comparisons flip, what has no opposite leaf is wrapped."""
    return m.negate_()


def implies(a: Matcher, b: Matcher) -> bool:
    """Whether every row that a accepts is accepted by b, as far as the trees tell; never a false yes."""
    if isinstance(a, Never) or isinstance(b, Always) or a == b:
        return True
    if isinstance(a, Always) or isinstance(b, Never):
        return False
    if isinstance(b, And):
        return all(implies(a, p) for p in b.parts)
    if isinstance(a, Or):
        return all(implies(p, b) for p in a.parts)
    if isinstance(a, Not) and isinstance(b, Not):
        return implies(b.part, a.part)
    if isinstance(a, And) and any(implies(p, b) for p in a.parts):
        return True
    if isinstance(b, Or) and any(implies(a, p) for p in b.parts):
        return True
    return a.implies_(b)


def excludes(a: Matcher, b: Matcher) -> bool:
    """Whether no row can be accepted by both."""
    return implies(a, negate(b)) or implies(b, negate(a))


def exhausts(a: Matcher, b: Matcher) -> bool:
    """Whether every row is accepted by one of the two."""
    return implies(negate(a), b) or implies(negate(b), a)


def _minimal(parts: list[Matcher], redundant: Callable[[Matcher, Matcher], bool]) -> list[Matcher]:
    """parts without those that another, kept one makes redundant; of equals the first stays."""
    kept: list[Matcher] = []
    for p in parts:
        if any(redundant(k, p) for k in kept):
            continue
        kept = [k for k in kept if not redundant(p, k)] + [p]
    return kept


def simplify(m: Matcher, nullable: Set[str] = frozenset()) -> Matcher:
    """An equal, smaller tree.

    Fields in `nullable` may hold values that neither a comparison nor its opposite accepts.
    Operands that another one implies go from an And, those that imply another go from an
    Or; an And of excluding operands is Never, an Or of exhausting ones Always. The last
    would let in such rows, so it is left undone for those fields.
    """
    if isinstance(m, Not):
        return negate(simplify(m.part, nullable))
    if isinstance(m, And):
        parts = And(*(simplify(p, nullable) for p in m.parts)).parts
        parts = _minimal([p for p in parts if not isinstance(p, Always)], implies)
        if any(isinstance(p, Never) for p in parts) or any(excludes(a, b) for i, a in enumerate(parts) for b in parts[i + 1 :]):
            return Never()
        return And.from_list(parts)
    if isinstance(m, Or):
        parts = Or(*(simplify(p, nullable) for p in m.parts)).parts
        parts = _minimal([p for p in parts if not isinstance(p, Never)], lambda k, p: implies(p, k))
        whole = any(isinstance(p, Always) for p in parts)
        if whole or any(exhausts(a, b) and not fields(a) & nullable for i, a in enumerate(parts) for b in parts[i + 1 :]):
            return Always()
        return Or.from_list(parts)
    return m.simplify_()


def fields(m: Matcher) -> set[str]:
    """The columns that a predicate reads."""
    if isinstance(m, _Many):
        return set().union(*map(fields, m.parts))
    if isinstance(m, Not):
        return fields(m.part)
    return {m.field} if hasattr(m, "field") else set(getattr(m, "names", ()))


def push_not(m: Matcher) -> Matcher:
    """Negations moved down to the leaves by De Morgan's rules."""
    if isinstance(m, _Many):
        return type(m)(*map(push_not, m.parts))
    if not isinstance(m, Not):
        return m
    inner = m.part
    if isinstance(inner, _Many):
        return (Or if isinstance(inner, And) else And)(*(push_not(Not(p)) for p in inner.parts))
    if isinstance(inner, Not):
        return push_not(inner.part)
    return negate(inner)


def to_dnf(m: Matcher) -> Matcher:
    """A sum of products. It can be exponentially larger, so execution never asks for it."""
    m = push_not(m)
    if isinstance(m, Or):
        return Or.from_list(map(to_dnf, m.parts))
    if isinstance(m, And):
        products: list[list[Matcher]] = [[]]
        for part in map(to_dnf, m.parts):
            terms = part.parts if isinstance(part, Or) else (part,)
            products = [p + [t] for p in products for t in terms]
        return Or.from_list(map(And.from_list, products))
    return m


def required_bits(m: Matcher) -> int:
    """Tag bits that every accepted row has; 0 where nothing can be said."""
    return m.required_bits_()


def one_of(field: str, values: Iterable[Any]) -> Matcher:
    """A literal value list."""
    return Or.from_list(Eq(field, v) for v in values)
