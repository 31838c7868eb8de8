"""Stratified Datalog over DataFrames, with derived relations of one column.

Rules have the standard meaning: shared variables join, repeated ones are equal, atoms
that share none must only be satisfiable, negated atoms (of derived or base relations)
are anti-joins, constants filter. Strata follow the components of the rule graph, so a
rule that isn't part of a cycle is one lazy DataFrame. Cycles run semi-naively with a
delta for each recursive atom; a cycle that only follows one pointer per value doubles it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.predicates import Matcher
from factmill.operators.closure import reach
from factmill.operators.execute import execute
from factmill.sources.checkpoints import cut, cut_union, release


@dataclass(frozen=True)
class Const:
    """A constant in an atom. Plain text is always a variable's name."""

    value: Any


@dataclass(frozen=True)
class Atom:
    relation: str
    vars: tuple[str | Const, ...]
    negated: bool = False

    def __init__(self, relation: str, *variables: str | Const, negated: bool = False):
        object.__setattr__(self, "relation", relation)
        object.__setattr__(self, "vars", tuple(variables))
        object.__setattr__(self, "negated", negated)

    def __invert__(self) -> Atom:
        return Atom(self.relation, *self.vars, negated=not self.negated)

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(v for v in self.vars if not isinstance(v, Const)))


@dataclass(frozen=True)
class Rule:
    head: str
    head_var: str
    body: tuple[Atom, ...]
    filter: Matcher | Callable[[DataFrame], Column] | None = None
    filter_body: int = 0


@dataclass
class _Derived:
    universe: int | None
    seeds: list[DataFrame] = field(default_factory=list)


class Program:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base: dict[str, DataFrame] = {}
        self.derived: dict[str, _Derived] = {}
        self.rules: list[Rule] = []
        self.results: dict[str, DataFrame] | None = None

    def _new(self, name: str) -> None:
        if name in self.base or name in self.derived:
            raise ValueError(f"there is a relation {name!r} already")

    def add_edb(self, name: str, df: DataFrame, columns: list[str]) -> Program:
        """A base relation: the columns stand for an atom's variables, in order."""
        self._new(name)
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"{name!r} has no columns {missing}")
        self.base[name] = df
        self._columns = getattr(self, "_columns", {}) | {name: list(columns)}
        return self

    def add_idb(self, name: str, universe: int | None = None) -> Program:
        """A derived relation of values from 0 to universe - 1; others are left out."""
        self._new(name)
        self.derived[name] = _Derived(universe)
        return self

    def seed(self, name: str, df: DataFrame) -> Program:
        """Values that a derived relation has beside those of its rules."""
        self.derived[name].seeds.append(df.toDF("v"))
        return self

    def rule(self, head: str, head_vars: list[str], *body: Atom, filter: Any = None, filter_body: int = 0) -> Program:
        if len(head_vars) != 1:
            raise ValueError("derived relations have one column")
        self.rules.append(Rule(head, head_vars[0], tuple(body), filter, filter_body))
        return self

    # planning

    def _check(self) -> None:
        for r in self.rules:
            if r.head not in self.derived:
                raise ValueError(f"the head {r.head!r} is not declared")
            for a in r.body:
                arity = len(self._columns[a.relation]) if a.relation in self.base else 1 if a.relation in self.derived else None
                if arity is None:
                    raise ValueError(f"unknown relation {a.relation!r}")
                if len(a.vars) != arity:
                    raise ValueError(f"{a.relation!r} has {arity} columns")
            bound = {v for a in r.body if not a.negated for v in a.names}
            loose = ({r.head_var} | {v for a in r.body if a.negated for v in a.names}) - bound
            if loose - ({r.head_var} if self._complement_of(r) else set()):
                raise ValueError(f"variables {sorted(loose)} of a rule for {r.head!r} stand in no positive atom")
            if r.filter is not None and (not 0 <= r.filter_body < len(r.body) or r.body[r.filter_body].relation not in self.base):
                raise ValueError("a filter applies to a base atom of the body")

    def _complement_of(self, r: Rule) -> bool:
        """Whether the body is nothing but negated derived atoms of the head's variable, within a universe."""
        return self.derived[r.head].universe is not None and bool(r.body) and all(a.negated and a.relation in self.derived and a.names == [r.head_var] for a in r.body)

    def components(self) -> list[list[str]]:
        """Derived relations in order of evaluation, those of a cycle together; a negative cycle is an error."""
        needs = {n: {a.relation for r in self.rules if r.head == n for a in r.body if a.relation in self.derived} for n in self.derived}
        reaches: dict[str, set[str]] = {}
        for n in needs:
            seen, todo = set(), list(needs[n])
            while todo:
                if (m := todo.pop()) not in seen:
                    seen.add(m)
                    todo += needs[m]
            reaches[n] = seen
        groups: list[list[str]] = []
        for n in needs:
            for g in groups:
                if g[0] in reaches[n] and n in reaches[g[0]]:
                    g.append(n)
                    break
            else:
                groups.append([n])
        for g in groups:
            for r in self.rules:
                if r.head in g and any(a.negated and a.relation in g for a in r.body):
                    raise ValueError(f"{r.head!r} depends on its own negation")
        ordered: list[list[str]] = []
        done: set[str] = set()
        while len(ordered) < len(groups):
            for g in groups:
                if g not in ordered and all(m in done or m in g for n in g for m in needs[n]):
                    ordered.append(g)
                    done.update(g)
        return ordered

    # evaluation

    def _atom(self, r: Rule, k: int, relations: dict[str, DataFrame]) -> DataFrame:
        """An atom's rows as a DataFrame of its variables."""
        a = r.body[k]
        if a.relation in self.base:
            df, columns = self.base[a.relation], self._columns[a.relation]
            if r.filter is not None and k == r.filter_body:
                df = execute(df, r.filter) if isinstance(r.filter, Matcher) else df.where(r.filter(df))
        else:
            df, columns = relations[a.relation], ["v"]
        first: dict[str, str] = {}
        for c, v in zip(columns, a.vars, strict=True):
            if isinstance(v, Const):
                df = df.where(F.col(c) == F.lit(v.value))
            elif v in first:
                df = df.where(F.col(c) == F.col(first[v]))
            else:
                first[v] = c
        return df.select(*[F.col(c).alias(f"_{v}") for v, c in first.items()], *([F.lit(1).alias("_any")] if not first else []))

    def _fire(self, r: Rule, relations: dict[str, DataFrame], instead: tuple[int, DataFrame] | None = None) -> DataFrame:
        """The rule's head values; instead gives one atom other rows, as a delta does."""
        frames = [instead[1].toDF("v") if instead and k == instead[0] else None for k in range(len(r.body))]
        parts = []
        for k, a in enumerate(r.body):
            own = relations | {a.relation: frames[k]} if frames[k] is not None else relations
            parts.append((a, self._atom(r, k, own)))
        groups = self._groups(r)
        home = next((g for g in groups if r.head_var in g), None)
        if home is None:
            out = self.spark.range(self.derived[r.head].universe).toDF(f"_{r.head_var}")
            home = {r.head_var}
        else:
            out = self._joined(r, home, parts)
        for g in groups:
            if g is not home:
                # unrelated atoms: it only matters whether any row satisfies them together
                some = self._joined(r, g, parts).limit(1).select(F.lit(True).alias("_some"))
                out = out.join(some, F.col("_some"), "left_semi")
        for a, df in parts:
            if not a.names:
                out = out.join(df.limit(1).select(F.lit(True).alias("_some")), F.col("_some"), "left_anti" if a.negated else "left_semi")
            elif a.negated and not any(set(a.names) <= g for g in [*groups, home]):
                raise ValueError(f"a negated atom of a rule for {r.head!r} ties unrelated atoms, which would be a cross product")
            elif a.negated and home == {r.head_var} and home not in groups:
                out = out.join(df, df.columns, "left_anti")
        head = out.select(F.col(f"_{r.head_var}").cast("long").alias("v")).where("v is not null")
        universe = self.derived[r.head].universe
        return head if universe is None else head.where((F.col("v") >= 0) & (F.col("v") < universe))

    @staticmethod
    def _groups(r: Rule) -> list[set[str]]:
        """The variables of the positive atoms, in sets that no atom joins to each other."""
        groups: list[set[str]] = []
        for a in r.body:
            if not a.negated and a.names:
                own = set(a.names)
                for g in [g for g in groups if g & own]:
                    own |= g
                    groups.remove(g)
                groups.append(own)
        return groups

    @staticmethod
    def _joined(r: Rule, group: set[str], parts: list[tuple[Atom, DataFrame]]) -> DataFrame:
        """The rows that satisfy all atoms over a set of variables, with the columns that the head may need."""
        positive = [(a, df) for a, df in parts if not a.negated and set(a.names) & group]
        negative = [(a, df) for a, df in parts if a.negated and a.names and set(a.names) <= group]
        start = next((i for i, (a, _) in enumerate(positive) if r.head_var in a.names and len(a.names) > 1), None)
        start = next((i for i, (a, _) in enumerate(positive) if r.head_var in a.names), 0) if start is None else start
        _, out = positive.pop(start)
        while positive:
            shared = [[v for v in df.columns if v in out.columns] for _, df in positive]
            k = max(range(len(positive)), key=lambda i: len(shared[i]))
            _, df = positive.pop(k)
            on = shared[k]
            later = {f"_{v}" for b, _ in [*positive, *negative] for v in b.names} | {f"_{r.head_var}"}
            if set(df.columns) & later - set(out.columns):
                out = out.join(df.select(*[c for c in df.columns if c in on or c in later]).distinct(), on)
            else:
                out = out.join(df.select(*on), on, "left_semi")
        for _, df in negative:
            out = out.join(df, df.columns, "left_anti")
        return out

    def _start(self, name: str, rules: list[Rule], relations: dict[str, DataFrame]) -> DataFrame:
        """Seeds and rules outside any cycle."""
        universe = self.derived[name].universe
        parts = [self._fire(r, relations) for r in rules]
        for s in self.derived[name].seeds:
            s = s.select(F.col("v").cast("long").alias("v"))
            parts.append(s if universe is None else s.where((F.col("v") >= 0) & (F.col("v") < universe)))
        if not parts:
            return self.spark.createDataFrame([], "v long")
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def _as_edges(self, name: str, rules: list[Rule], relations: dict[str, DataFrame]) -> DataFrame | None:
        """(src, dst) of a relation whose recursive rules all follow one base atom from one recursive atom."""
        edges = None
        for r in rules:
            own = [a for a in r.body if a.relation == name]
            others = [k for k, a in enumerate(r.body) if a.relation != name]
            if len(own) != 1 or len(others) != 1 or not own[0].names or r.body[others[0]].negated or r.body[others[0]].relation not in self.base:
                return None
            source = own[0].names[0]
            step = r.body[others[0]]
            if source == r.head_var or not {source, r.head_var} <= set(step.names):
                return None
            each = self._atom(r, others[0], relations).select(F.col(f"_{source}").alias("src"), F.col(f"_{r.head_var}").cast("long").alias("dst"))
            universe = self.derived[name].universe
            if universe is not None:
                each = each.where((F.col("dst") >= 0) & (F.col("dst") < universe))
            edges = each if edges is None else edges.union(each)
        return edges

    def evaluate(self) -> Program:
        """Computes all derived relations anew from base relations and seeds."""
        self._check()
        done: dict[str, DataFrame] = {}
        for group in self.components():
            cyclic = {r for r in self.rules if r.head in group and any(a.relation in group for a in r.body)}
            starts = {n: self._start(n, [r for r in self.rules if r.head == n and r not in cyclic], done) for n in group}
            if not cyclic:
                done |= starts
                continue
            if len(group) == 1 and (edges := self._as_edges(group[0], [r for r in self.rules if r in cyclic], done)) is not None:
                done[group[0]] = reach(edges, starts[group[0]])
                continue
            done |= self._fixpoint(group, [r for r in self.rules if r in cyclic], starts, done)
        self.results = done
        return self

    def _fixpoint(self, group: list[str], rules: list[Rule], starts: dict[str, DataFrame], done: dict[str, DataFrame]) -> dict[str, DataFrame]:
        total = {n: cut(starts[n]) for n in group}
        delta = dict(total)
        while any(not d.isEmpty() for d in delta.values()):
            found: dict[str, DataFrame] = {}
            for r in rules:
                for k, a in enumerate(r.body):
                    if a.relation in group and not a.negated:
                        new = self._fire(r, done | total, (k, delta[a.relation]))
                        found[r.head] = found[r.head].union(new) if r.head in found else new
            empty = self.spark.createDataFrame([], "v long")
            old = [t for n in found for t in (total[n], delta[n])]
            delta = {n: cut(found[n].distinct().join(total[n], "v", "left_anti")) if n in found else empty for n in group}
            total = {n: cut_union(total[n], delta[n]) if n in found else total[n] for n in group}
            release(*old)
        return total

    def result(self, name: str) -> DataFrame:
        """The values v of a derived relation, after evaluate()."""
        if self.results is None:
            raise ValueError("evaluate() comes first")
        return self.results[name]
