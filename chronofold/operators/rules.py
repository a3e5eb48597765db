"""JSON-logic rules compiled to columns.

A rule is {"id", "effect": filter|derive|trigger, "deps": [...], "on_types": [...], "expr": ...}.
Expressions are JSON: literals, or {"op": [arguments]}.  Every value compiles to
a column of one of the kinds number, string, boolean or list; a kind that an
operator cannot take makes an error, and errors are a column of their own, so a
failing filter rejects and a failing derivation is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ARITY = {"==": (2, 2), "!=": (2, 2), "<": (2, 2), "<=": (2, 2), ">": (2, 2), ">=": (2, 2), "+": (1, None), "-": (1, None), "*": (1, None), "/": (2, 2), "%": (2, 2), "and": (1, None), "or": (1, None), "!": (1, 1), "in": (2, 2), "cat": (1, None), "count": (1, 1), "if": (3, None), "var": (1, 2), "cand": (1, 1), "write": (1, 1), "pass": (0, 0), "reject": (0, 1), "return": (1, 1), "emit": (1, 2), "noop": (0, 0)}
TERMINALS = {"filter": ("pass", "reject"), "derive": ("return", "noop"), "trigger": ("emit", "noop")}


@dataclass
class Value:
    """A compiled value: column, kind (number, int, string, boolean, list, null), error flag."""

    column: Column
    kind: str
    error: Column | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("number", "int")


class RuleError(ValueError):
    """A rule that cannot be compiled."""


def _errors(*values: Value) -> Column | None:
    found = [v.error for v in values if v.error is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def truthy(v: Value) -> Column:
    """null, false, 0 and the empty string are false, all else is true."""
    if v.kind == "boolean":
        return F.coalesce(v.column, F.lit(False))
    if v.numeric:
        return F.coalesce(v.column != 0, F.lit(False))
    if v.kind == "string":
        return F.coalesce(v.column != "", F.lit(False))
    return F.lit(False) if v.kind == "null" else v.column.isNotNull()


def text(v: Value) -> Column:
    return F.coalesce(v.column.cast("string"), F.lit(""))


class Compiler:
    """Compiles expressions over variables (name -> Value), candidate fields and written values."""

    def __init__(self, variables: dict[str, Value], candidate: dict[str, Value] | None = None, written: dict[str, Value] | None = None):
        self.variables, self.candidate, self.written = variables, candidate or {}, written or {}

    def compile(self, e) -> Value:
        if e is None:
            return Value(F.lit(None), "null")
        if isinstance(e, bool):
            return Value(F.lit(e), "boolean")
        if isinstance(e, int):
            return Value(F.lit(e).cast("bigint"), "int")
        if isinstance(e, float):
            return Value(F.lit(e), "number")
        if isinstance(e, str):
            return Value(F.lit(e), "string")
        if isinstance(e, list):
            return Value(F.array(*[self.compile(x).column for x in e]), "list")
        (op, args), = e.items()
        args = args if isinstance(args, list) else [args]
        least, most = ARITY.get(op, (None, None))
        if least is None:
            raise RuleError(f"unknown operator {op}")
        if len(args) < least or most is not None and len(args) > most:
            raise RuleError(f"{op} takes {least} to {most or 'any'} arguments, not {len(args)}")
        if op in ("var", "cand", "write"):
            source = {"var": self.variables, "cand": self.candidate, "write": self.written}[op]
            return source.get(args[0], Value(F.lit(None), "null"))
        return self.apply(op, [self.compile(x) for x in args])

    def apply(self, op: str, a: list[Value]) -> Value:
        bad = _errors(*a)
        if op in ("==", "!="):
            if a[0].numeric and a[1].numeric:
                same = a[0].column.cast("double").eqNullSafe(a[1].column.cast("double"))
            elif "null" in (a[0].kind, a[1].kind):
                other = a[1] if a[0].kind == "null" else a[0]
                same = other.column.isNull()
            elif a[0].kind == a[1].kind:
                same = a[0].column.eqNullSafe(a[1].column)
            else:  # different kinds are equal only where both are missing
                same = a[0].column.isNull() & a[1].column.isNull()
            return Value(same if op == "==" else ~same, "boolean", bad)
        if op in ("<", "<=", ">", ">="):
            if not (a[0].numeric and a[1].numeric or a[0].kind == a[1].kind == "string"):
                return Value(F.lit(None).cast("boolean"), "boolean", F.lit(True))
            left, right = a[0].column, a[1].column
            made = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
            missing = left.isNull() | right.isNull()
            return Value(made, "boolean", missing if bad is None else bad | missing)
        if op in ("+", "-", "*"):
            if op == "+" and any(v.kind == "string" for v in a):
                return Value(F.concat(*map(text, a)), "string", bad)
            if not all(v.numeric or v.kind == "null" for v in a):
                return Value(F.lit(None).cast("double"), "number", F.lit(True))
            kind = "int" if all(v.kind != "number" for v in a) else "number"
            as_ = "bigint" if kind == "int" else "double"
            numbers = [F.coalesce(v.column.cast(as_), F.lit(0).cast(as_)) for v in a]
            if op == "-" and len(a) == 1:
                return Value(-numbers[0], kind, bad)
            step = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
            return Value(reduce(step, numbers), kind, bad)
        if op in ("/", "%"):
            if not all(v.numeric or v.kind == "null" for v in a):
                return Value(F.lit(None).cast("double"), "number", F.lit(True))
            as_ = "double" if op == "/" else "bigint"
            x, y = (F.coalesce(v.column.cast(as_), F.lit(0).cast(as_)) for v in a)
            zero = y == 0
            made = F.when(~zero, x / y if op == "/" else x % y)
            return Value(made, "number" if op == "/" else "int", zero if bad is None else bad | zero)
        if op in ("and", "or"):
            # the operand that decides is the result; its error counts only if it is reached
            out, error = a[-1].column, a[-1].error if a[-1].error is not None else F.lit(False)
            kinds = {v.kind for v in a if v.kind != "null"}
            kind = kinds.pop() if len(kinds) == 1 else "int" if kinds == {"int"} else "number" if kinds <= {"int", "number"} else "boolean"
            if kind == "boolean" and any(v.kind != "boolean" for v in a):
                out = truthy(a[-1])
            for v in reversed(a[:-1]):
                stop = ~truthy(v) if op == "and" else truthy(v)
                own = truthy(v) if kind == "boolean" and v.kind != "boolean" else v.column
                out = F.when(stop, own).otherwise(out)
                error = (v.error if v.error is not None else F.lit(False)) | (~stop & error)
            return Value(out, kind, error if any(v.error is not None for v in a) else None)
        if op == "!":
            return Value(~truthy(a[0]), "boolean", bad)
        if op == "in":
            if a[1].kind == "list":
                return Value(F.coalesce(F.array_contains(a[1].column, a[0].column), F.lit(False)), "boolean", bad)
            return Value(F.contains(text(a[1]), text(a[0])), "boolean", bad)
        if op == "cat":
            return Value(F.concat(*map(text, a)), "string", bad)
        if op == "count":
            size = F.size(a[0].column) if a[0].kind == "list" else F.length(text(a[0])) if a[0].kind == "string" else F.lit(0)
            return Value(F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")), "int", bad)
        if op == "if":
            if len(a) % 2 == 0:
                raise RuleError("if takes an odd number of arguments")
            out, error = a[-1].column, a[-1].error if a[-1].error is not None else F.lit(False)
            for test, then in zip(a[-3::-2], a[-2::-2], strict=True):
                out = F.when(truthy(test), then.column).otherwise(out)
                error = (test.error if test.error is not None else F.lit(False)) | F.when(truthy(test), then.error if then.error is not None else F.lit(False)).otherwise(error)
            kinds = [v.kind for v in [*a[1::2], a[-1]] if v.kind != "null"]
            kind = kinds[0] if kinds and len(set(kinds)) == 1 else "number" if kinds and set(kinds) <= {"int", "number"} else kinds[0] if kinds else "null"
            return Value(out, kind, error if any(v.error is not None for v in a) else None)
        if op == "pass":
            return Value(F.lit(True), "boolean", bad)
        if op == "reject":
            return Value(F.lit(False), "boolean", bad)
        if op in ("return", "emit"):
            return a[0]
        return Value(F.lit(None), "null", bad)


def operators(e) -> list[str]:
    """All operators of an expression."""
    if isinstance(e, dict):
        (op, args), = e.items()
        return [op, *operators(args if isinstance(args, list) else [args])]
    return [x for y in e for x in operators(y)] if isinstance(e, list) else []


def used(e) -> set[str]:
    """Variables that an expression reads."""
    if isinstance(e, dict):
        (op, args), = e.items()
        args = args if isinstance(args, list) else [args]
        return {args[0]} if op == "var" else set().union(*map(used, args))
    return set().union(*map(used, e)) if isinstance(e, list) else set()


def check(rule: dict, registered: set[str]) -> list[str]:
    """Faults of a rule: unregistered or undeclared variables, unknown operators, arity, terminals of another effect."""
    faults = [f"unregistered dependency {d}" for d in rule.get("deps", []) if d not in registered]
    faults += [f"undeclared variable {v}" for v in sorted(used(rule["expr"]) - set(rule.get("deps", [])))]
    terminals = {t for kinds in TERMINALS.values() for t in kinds}
    faults += [f"terminal {t} in a {rule['effect']} rule" for t in operators(rule["expr"]) if t in terminals and t not in TERMINALS[rule["effect"]]]

    def walk(e):
        if isinstance(e, dict):
            (op, args), = e.items()
            args = args if isinstance(args, list) else [args]
            least, most = ARITY.get(op, (None, None))
            if least is None:
                faults.append(f"unknown operator {op}")
            elif len(args) < least or most is not None and len(args) > most or op == "if" and len(args) % 2 == 0:
                faults.append(f"arity of {op}")
            for x in args if op not in ("var", "cand", "write") else []:
                walk(x)
        elif isinstance(e, list):
            for x in e:
                walk(x)

    walk(rule["expr"])
    return faults


def applies(rule: dict, owned: Column) -> Column:
    """Whether all dependencies are among the owned keys (array<string>)."""
    return F.size(F.array_except(F.array(*[F.lit(d) for d in rule.get("deps", [])]).cast("array<string>"), owned)) == 0


def on_type(rule: dict, kind: Column) -> Column:
    """A rule without types is for all of them."""
    return kind.isin(rule["on_types"]) if rule.get("on_types") else F.lit(True)


def rejects(rule: dict, variables: dict[str, Value], present: dict[str, Column], side: str, **more) -> Column:
    """Whether a filter rule rejects a row.

    On the read side a rule is skipped where a dependency is missing; on the
    write side missing dependencies are null.  Errors reject.
    """
    made = Compiler(variables, **more).compile(rule["expr"])
    bad = ~truthy(made) if made.error is None else F.coalesce(made.error, F.lit(False)) | ~truthy(made)
    if side == "read":
        return reduce(lambda a, b: a & b, [present.get(d, F.lit(False)) for d in rule.get("deps", [])], F.lit(True)) & bad
    return bad


def derived(rule: dict, variables: dict[str, Value], **more) -> Column:
    """The value of a derive rule, null where it fails."""
    made = Compiler(variables, **more).compile(rule["expr"])
    return made.column if made.error is None else F.when(~F.coalesce(made.error, F.lit(False)), made.column)
