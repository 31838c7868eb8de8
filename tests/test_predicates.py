import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from factmill.functions.predicates import (
    Always, And, Eq, Ge, HasTags, Lt, Ne, Never, Not, Or, Prefix, excludes, implies, negate, one_of, push_not, required_bits, simplify, to_dnf,
)

A, B = Lt("x", 10), Lt("x", 20)


def test_identities():
    assert simplify(A & Always()) == A and simplify(A | Never()) == A
    assert simplify(A & Never()) == Never() and simplify(A | Always()) == Always()
    assert simplify(~~A) == A and negate(negate(A)) == A
    assert negate(Eq("x", 1)) == Ne("x", 1) and negate(A) == Ge("x", 10) and negate(Always()) == Never()
    assert negate(A & Eq("y", 1)) == Not(A & Eq("y", 1))


def test_subsumption():
    assert simplify(A & B) == A and simplify(A | B) == B
    assert simplify(Eq("x", 5) & A) == Eq("x", 5) and simplify(Eq("x", 5) | A) == A
    assert simplify(A & Ne("x", 40)) == A
    assert simplify(Ge("x", 10) & Ge("x", 20)) == Ge("x", 20)
    assert simplify((Eq("x", 5) | Eq("x", 3)) & A) == Or(Eq("x", 5), Eq("x", 3))
    assert simplify(A & (A | Eq("y", 1))) == A
    assert simplify(Or.from_list(Lt("x", k) for k in (20, 50, 10, 100))) == Lt("x", 100)


def test_contradictions_and_tautologies():
    assert simplify(Eq("x", 5) & Ne("x", 5)) == Never() and simplify(Eq("x", 5) & Eq("x", 7)) == Never()
    assert simplify(A & Ge("x", 20)) == Never()
    assert simplify(A | Ge("x", 10)) == Always() and simplify(B | Ge("x", 10)) == Always()
    assert simplify(A | Ge("x", 10), nullable={"x"}) == Or(A, Ge("x", 10))
    assert excludes(A, Ge("x", 10)) and not excludes(A, Eq("y", 3))


def test_prefixes_and_contrapositives():
    long, short = Prefix("p", "sensor/temp"), Prefix("p", "sensor")
    assert simplify(long & short) == long and simplify(long | short) == short
    assert implies(Not(short), Not(long)) and not implies(Not(long), Not(short))
    assert implies(long, Prefix("p", ""))
    assert implies(Eq("p", "sensor/x"), short) and not implies(Eq("p", "motor"), short)


def test_lists_and_normal_form():
    assert And.from_list([]) == Always() and Or.from_list([]) == Never() and one_of("x", []) == Never()
    a, b, c, d = (Eq(f, 1) for f in "abcd")
    assert to_dnf((a | b) & (c | d)) == Or(a & c, a & d, b & c, b & d)
    assert to_dnf(~(a & b)) == Or(Ne("a", 1), Ne("b", 1))
    assert push_not(~(a | ~b)) == And(Ne("a", 1), b)


def test_required_bits():
    assert required_bits(Eq("mask", 3) & A) == 3
    assert required_bits(Eq("mask", 3) | Eq("mask", 6)) == 2
    assert required_bits(Eq("mask", 3) | A) == 0
    assert required_bits(HasTags(5) & Eq("mask", 2)) == 7
    assert required_bits(~Eq("mask", 3)) == 0


def holds(m, row):
    """A predicate evaluated in plain Python."""
    kind = type(m).__name__
    if kind in ("And", "Or"):
        return (all if kind == "And" else any)(holds(p, row) for p in m.parts)
    if kind == "Not":
        return not holds(m.part, row)
    if kind in ("Always", "Never"):
        return kind == "Always"
    v = row[m.field]
    return {"Eq": v == m.value, "Ne": v != m.value, "Lt": v < m.value, "Ge": v >= m.value}[kind]


leaf = st.builds(lambda k, f, v: k(f, v), st.sampled_from([Eq, Ne, Lt, Ge]), st.sampled_from("xy"), st.integers(0, 3))
tree = st.recursive(leaf | st.sampled_from([Always(), Never()]), lambda t: st.builds(And, t, t) | st.builds(Or, t, t) | st.builds(Not, t), max_leaves=8)
ROWS = [dict(zip("xy", v, strict=True)) for v in itertools.product((-1, 0, 0.5, 1, 2, 2.5, 3, 4), repeat=2)]


@settings(max_examples=400, deadline=None)
@given(tree, tree)
def test_algebra_is_sound(a, b):
    for row in ROWS:
        assert holds(simplify(a), row) == holds(a, row) == holds(push_not(a), row) == holds(to_dnf(a), row)
        assert holds(negate(a), row) != holds(a, row)
    if implies(a, b):
        assert all(holds(b, row) for row in ROWS if holds(a, row))


def test_simplify_is_stable():
    rnd = random.Random(1)
    for _ in range(200):
        m = And(*(Or(*(rnd.choice([Eq, Ne, Lt, Ge])("x", rnd.randint(0, 3)) for _ in range(2))) for _ in range(3)))
        assert simplify(simplify(m)) == simplify(m)
