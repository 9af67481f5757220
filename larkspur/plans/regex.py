"""From a regular expression to the grams that every match must hold: a boolean plan that may keep too much, never too little."""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as c
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import Extractor

MOST_LITERALS, MOST_CLASS = 64, 4


@dataclass(frozen=True)
class All:
    """No requirement: every text may match."""


@dataclass(frozen=True)
class Gram:
    gram: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


Plan = All | Gram | And | Or


def conj(parts: list[Plan]) -> Plan:
    flat: dict[Plan, None] = {}
    for p in parts:
        for q in p.parts if isinstance(p, And) else (p,):
            if not isinstance(q, All):
                flat[q] = None
    return All() if not flat else next(iter(flat)) if len(flat) == 1 else And(tuple(flat))


def disj(parts: list[Plan]) -> Plan:
    flat: dict[Plan, None] = {}
    for p in parts:
        if isinstance(p, All):
            return All()
        for q in p.parts if isinstance(p, Or) else (p,):
            flat[q] = None
    return All() if not flat else next(iter(flat)) if len(flat) == 1 else Or(tuple(flat))


def cover(literal: str, extractor: Extractor) -> Plan:
    return conj([Gram(g) for g in extractor.cover(literal)])


class _Reader:
    """Reads a parsed pattern. A node's value is the complete set of its literals, or else a Plan that its matches meet."""

    def __init__(self, extractor: Extractor, fold: bool):
        self.extractor, self.fold = extractor, fold

    def plan(self, value) -> Plan:
        return disj([cover(s, self.extractor) for s in sorted(value)]) if isinstance(value, frozenset) else value

    def cases(self, ch: str) -> frozenset:
        """All that a character stands for. Foldings of more than one character, as ß, narrow nothing."""
        if not self.fold:
            return frozenset([ch])
        forms = {ch, ch.lower(), ch.upper()}
        return frozenset(forms) if ch.isascii() and ch.lower() not in "ksi" else frozenset()

    def one(self, options: list[str]):
        """A character out of a few."""
        out: set[str] = set()
        for ch in options:
            if not (forms := self.cases(ch)):
                return All()
            out |= forms
        return frozenset(out) if 0 < len(out) <= 2 * MOST_CLASS else All()

    def members(self, items) -> list[str] | None:
        out: list[str] = []
        for op, arg in items:
            if op is c.LITERAL:
                out.append(chr(arg))
            elif op is c.RANGE and arg[1] - arg[0] < MOST_CLASS:
                out += [chr(x) for x in range(arg[0], arg[1] + 1)]
            else:
                return None
        return out if len(out) <= MOST_CLASS else None

    def sequence(self, nodes):
        run, held = frozenset([""]), []
        for node in nodes:
            value = self.node(node)
            if isinstance(value, frozenset) and len(run) * len(value) <= MOST_LITERALS:
                run = frozenset(a + b for a in run for b in value)
                continue
            held.append(self.plan(run))  # what stands together so far must stand somewhere
            run = value if isinstance(value, frozenset) else frozenset([""])
            if not isinstance(value, frozenset):
                held.append(value)
        return conj([*held, self.plan(run)]) if held else run

    def node(self, node):
        op, arg = node
        if op is c.LITERAL:
            return self.one([chr(arg)])
        if op is c.IN:
            members = self.members(arg)
            return All() if members is None else self.one(members)
        if op is c.SUBPATTERN:
            _, add, cut, inner = arg
            if add or cut:
                raise ValueError("flags inside a pattern can't be planned")
            return self.sequence(inner)
        if op is c.ATOMIC_GROUP:
            return self.sequence(arg)
        if op is c.BRANCH:
            values = [self.sequence(b) for b in arg[1]]
            if all(isinstance(v, frozenset) for v in values) and len(union := frozenset().union(*values)) <= MOST_LITERALS:
                return union
            return disj([self.plan(v) for v in values])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, inner = arg
            value = self.sequence(inner)
            if least == most == 1:
                return value
            return self.plan(value) if least else All()
        if op is c.AT:
            return frozenset([""])
        if op in (c.ASSERT, c.ASSERT_NOT, c.GROUPREF, c.GROUPREF_EXISTS):
            raise ValueError("look-around and references can't be planned")
        return All()


def plan_pattern(pattern: str, extractor: Extractor | None = None) -> Plan:
    """The plan of a pattern; ValueError if it isn't one, or uses look-around or references."""
    flags = re.match(r"\(\?([imsxU]+)\)", pattern)
    own = flags[1] if flags else ""
    try:
        parsed = _parser.parse(pattern[flags.end() :] if flags else pattern, re.VERBOSE if "x" in own else 0)
    except re.error as e:
        raise ValueError(str(e)) from e
    reader = _Reader(extractor or Extractor(), "i" in own)
    return reader.plan(reader.sequence(parsed))


def plan_literal(literal: str, extractor: Extractor | None = None) -> Plan:
    return cover(literal, extractor or Extractor())


def grams_of(plan: Plan) -> list[str]:
    if isinstance(plan, Gram):
        return [plan.gram]
    return [] if isinstance(plan, All) else list(dict.fromkeys(g for p in plan.parts for g in grams_of(p)))


def holds(plan: Plan, grams: set[str]) -> bool:
    if isinstance(plan, All):
        return True
    if isinstance(plan, Gram):
        return plan.gram in grams
    return (all if isinstance(plan, And) else any)(holds(p, grams) for p in plan.parts)


def to_column(plan: Plan, grams: Column) -> Column:
    """The plan as a condition on an array of grams."""
    if isinstance(plan, All):
        return F.lit(True)
    if isinstance(plan, Gram):
        return F.array_contains(grams, plan.gram)
    out = to_column(plan.parts[0], grams)
    for p in plan.parts[1:]:
        out = out & to_column(p, grams) if isinstance(plan, And) else out | to_column(p, grams)
    return out
