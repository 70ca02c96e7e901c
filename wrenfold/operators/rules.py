"""The tenants' rule language: JSON rules, checked on the driver and compiled to columns."""

from __future__ import annotations

import logging
import math
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FractionalType, LongType, NumericType, StringType

from ..functions.vocab import MAX_DEPTH, MAX_LIST, MAX_NODES, MAX_PATTERN, MAX_QUANTIFIERS, MAX_RULES, MAX_SUBJECT, NESTED_QUANTIFIERS, RULE_ACTIONS, RULE_FIELDS, RULE_OPERATORS, Tenant

log = logging.getLogger(__name__)


class RuleError(ValueError):
    """A rule that is not well formed."""


@dataclass(frozen=True)
class Test:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Logic:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Action:
    kind: str
    field: str | None
    value: object
    mask: str
    queue: str | None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    root: Test | Logic
    actions: tuple[Action, ...]


def safe_pattern(p: object) -> bool:
    """RUL14: a short pattern that compiles, without nested quantifiers and with few of any."""
    if not isinstance(p, str) or not 0 < len(p) <= MAX_PATTERN or p.count("(") != p.count(")"):
        return False
    if any(x in p for x in NESTED_QUANTIFIERS) or sum(map(p.count, "*+{")) > MAX_QUANTIFIERS:
        return False
    try:
        re.compile(p)
    except re.error:
        return False
    return True


def _ask(fine: bool, said: str) -> None:
    if not fine:
        raise RuleError(said)


def _node(raw: object, depth: int, seen: list[int]) -> Test | Logic:
    seen[0] += 1
    _ask(seen[0] <= MAX_NODES, "too many nodes")
    _ask(depth <= MAX_DEPTH, "too deep")
    _ask(isinstance(raw, dict), "a node is an object")
    kind = raw.get("type")
    if kind in ("AND", "OR"):
        parts = raw.get("children")
        _ask(isinstance(parts, list) and bool(parts), f"{kind} needs children")
        return Logic(kind, tuple(_node(x, depth + 1, seen) for x in parts))
    if kind == "NOT":
        _ask(isinstance(raw.get("child"), dict), "NOT needs a child")
        return Logic(kind, (_node(raw["child"], depth + 1, seen),))
    _ask(kind == "CONDITION", f"unknown node {kind}")
    field, op, value = raw.get("field"), raw.get("operator"), raw.get("value")
    _ask(isinstance(field, str) and field in RULE_FIELDS, f"field {field} is not allowed")
    _ask(op in RULE_OPERATORS, f"operator {op} is not known")
    _ask(op != "IN_LIST" or isinstance(value, list) and len(value) <= MAX_LIST, "IN_LIST needs a list within its limit")
    _ask(op != "REGEX_MATCH" or safe_pattern(value), "the pattern is not safe")
    return Test(field, op, value)


def _action(raw: dict) -> Action:
    kind, field, queue, mask = raw.get("action_type"), raw.get("field"), raw.get("queue_name"), raw.get("mask_char", "*")
    _ask(kind in RULE_ACTIONS, f"unknown action {kind}")
    _ask(kind not in ("MASK_FIELD", "OVERWRITE_FIELD") or field in RULE_FIELDS, f"field {field} is not allowed")
    _ask(kind != "ROUTE_TO_QUEUE" or isinstance(queue, str) and bool(re.match(r"^[A-Za-z0-9_-]{1,64}$", queue)), "the queue's name is not allowed")
    return Action(kind, field if isinstance(field, str) else None, raw.get("value"), mask if isinstance(mask, str) and len(mask) == 1 else "*", queue if isinstance(queue, str) else None)


def parse_rules(rules: object) -> tuple[Rule, ...]:
    """RUL15: the rules that are well formed, of the first 100; others are logged and left out."""
    out = []
    for i, raw in enumerate(rules[:MAX_RULES] if isinstance(rules, list) else ()):
        name = raw.get("rule_id", f"rule_{i}") if isinstance(raw, dict) else f"rule_{i}"
        try:
            _ask(isinstance(raw, dict) and isinstance(raw.get("condition"), dict), "a rule needs a condition")
            _ask(isinstance(raw.get("actions"), list) and bool(raw["actions"]), "a rule needs actions")
            _ask(all(isinstance(a, dict) for a in raw["actions"]), "an action is an object")
            out.append(Rule(name, _node(raw["condition"], 0, [0]), tuple(map(_action, raw["actions"]))))
        except RuleError as e:
            log.warning("rule %s is left out: %s", name, e)
    return tuple(out)


def _number(v: object) -> float | None:
    """The value as GREATER_THAN and LESS_THAN read it."""
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    try:
        return float(v)
    except ValueError:
        return None


_FLOAT = r"(?i)^\s*[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*\.?(e[+-]?\d+(_\d+)*)?|\d+(_\d+)*\.(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def _equal(c: Column, kind: DataType | None, value: object) -> Column:
    """RUL1: never null; values of unlike types differ, but numbers and booleans compare as numbers."""
    if value is None:
        return c.isNull()
    if isinstance(value, str):
        return c.eqNullSafe(F.lit(value)) if isinstance(kind, StringType) else F.lit(False)
    if isinstance(value, (bool, int, float)) and isinstance(kind, (NumericType, BooleanType)):
        return F.lit(False) if isinstance(value, float) and math.isnan(value) else c.cast("double").eqNullSafe(F.lit(float(value)))
    return F.lit(False)


_GROUP = re.compile(r"\(\?(?:P<(\w+)>|P=(\w+)\)|#[^)]*\)|([a-zA-Z]*)(-[a-zA-Z]+)?[:)]|(<[=!]|[=!>]))")
_TIMES = re.compile(r"\{(?:(\d+)(,\d*)?|,(\d*))\}")
#: Escapes that differ, outside and inside a class.
_ESCAPES, _CLASS_ESCAPES = {"Z": r"\z", "v": r"\x0B"}, {"b": r"\x08", "v": r"\x0B"}


def translated(pattern: str) -> str | None:
    """The pattern in Java's syntax, with Unicode classes and \n alone as an end of line; None where Java has no such syntax."""
    out, names, k, inside = ["(?Ud)"], {}, 0, -1  # inside: where the class began that k is in
    while k < len(pattern):
        c, rest = pattern[k], pattern[k:]
        if c == "\\":
            n = pattern[k + 1 : k + 2]
            if n in ("N", "U") or n == "0" or re.match(r"\\[0-7]{3}", rest):
                return None
            out.append((_ESCAPES if inside < 0 else _CLASS_ESCAPES).get(n, c + n))
            k += 2
            continue
        if inside >= 0:
            first = k == inside + 1 or k == inside + 2 and pattern[k - 1] == "^"
            if c == "]" and not first:
                inside = -1
                out.append(c)
            else:
                out.append(f"\\{c}" if c in "[]&" else c)
        elif c == "[":
            inside = k
            out.append(c)
        elif c == "{" and (m := _TIMES.match(rest)):
            out.append("{0," + m[3] + "}" if m[1] is None else m[0])
            k += len(m[0]) - 1
        elif c in "{}":
            out.append(f"\\{c}")
        elif rest.startswith("(?"):
            m = _GROUP.match(rest)
            if not m or set((m[3] or "") + (m[4] or "")) - set("ims-"):
                return None  # a condition, or flags that Java lacks or reads otherwise
            if m[1]:
                names[m[1]] = f"g{len(names)}"
                out.append(f"(?<{names[m[1]]}>")
            elif m[2]:
                out.append(rf"\k<{names[m[2]]}>")
            elif not m[0].startswith("(?#"):
                out.append(m[0])
            k += len(m[0]) - 1
        else:
            out.append(c)
        k += 1
    return "".join(out)


def _compiles(pattern: str) -> bool:
    """Whether the JVM that will run the pattern takes it."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def matches(c: Column, pattern: str) -> Column:
    """REGEX_MATCH of text: by the JVM where it has the pattern's syntax, else by Python in Arrow batches."""
    subject, java = F.substring(c, 1, MAX_SUBJECT), translated(pattern)
    if java is not None and _compiles(java):
        return subject.rlike(java)
    log.info("pattern %r has no Java form and is matched by Python", pattern)

    @F.pandas_udf(BooleanType())
    def search(s: pd.Series) -> pd.Series:
        find = re.compile(pattern).search
        return s.map(lambda v: v is not None and find(v) is not None).astype(bool)

    return search(subject)


def leaf(test: Test, columns: dict[str, tuple[Column, DataType]]) -> Column:
    """SUP1: a test as a boolean column that is never null. A field the table lacks is null."""
    c, kind = columns.get(test.field, (F.lit(None).cast("string"), None))
    v, text = test.value, isinstance(kind, StringType)
    never = lambda x, otherwise=False: F.coalesce(x, F.lit(otherwise))
    match test.operator:
        case "EQUALS":
            return _equal(c, kind, v)
        case "NOT_EQUALS":
            return ~_equal(c, kind, v)
        case "CONTAINS":
            return never(F.contains(F.lower(c), F.lit(v.lower()))) if text and isinstance(v, str) else F.lit(False)
        case "NOT_CONTAINS":
            return never(~F.contains(F.lower(c), F.lit(v.lower())), True) if text and isinstance(v, str) else F.lit(True)
        case "GREATER_THAN" | "LESS_THAN":
            n = _number(v)
            if n is None or math.isnan(n) or not (text or isinstance(kind, NumericType)):
                return F.lit(False)
            x = F.when(c.rlike(_FLOAT), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double")) if text else c.cast("double")
            return never(~F.isnan(x) & ((x > n) if test.operator == "GREATER_THAN" else (x < n)))
        case "IN_LIST":
            words = [x for x in v if isinstance(x, str)]
            tests = ([never(c.isin(*words))] if words and text else []) + [_equal(c, kind, x) for x in v if not isinstance(x, str)]
            return reduce(lambda a, b: a | b, tests, F.lit(False))
        case "REGEX_MATCH":
            return never(matches(c, v)) if text else F.lit(False)
    raise RuleError(test.operator)


def condition(node: Test | Logic, columns: dict[str, tuple[Column, DataType]]) -> Column:
    """RUL9."""
    if isinstance(node, Test):
        return leaf(node, columns)
    parts = [condition(x, columns) for x in node.parts]
    return ~parts[0] if node.kind == "NOT" else reduce((lambda a, b: a & b) if node.kind == "AND" else (lambda a, b: a | b), parts)


def _typed(df: DataFrame) -> dict[str, tuple[Column, DataType]]:
    return {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}


def _holds(kind: DataType, value: object) -> bool:
    """Whether a column of this type can hold the literal as it is."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    if isinstance(value, int):
        return isinstance(kind, NumericType)
    return isinstance(kind, FractionalType) if isinstance(value, float) else isinstance(kind, StringType)


def apply_rule(df: DataFrame, rule: Rule) -> DataFrame:
    """RUL10-13, SUP2: one rule: what it matches, and its actions in their order.

    A column has one type: a literal of another type that overwrites a field makes the field's column text.
    """
    df = df.withColumn("_match", ~F.col("is_dropped") & condition(rule.root, _typed(df)))
    m, new, kinds = F.col("_match"), {}, {f.name: f.dataType for f in df.schema.fields}
    flags, queue = F.col("rule_flags"), F.col("routed_queue")
    dropped = F.col("is_dropped")
    for a in rule.actions:
        now = new.get(a.field, F.col(f"`{a.field}`")) if a.field in kinds or a.field in new else None
        if a.kind == "DROP_RECORD":
            dropped = dropped | m
        elif a.kind == "FLAG_RECORD":
            flags = F.when(m, F.concat(flags, F.array(F.lit(a.value if isinstance(a.value, str) else "FLAGGED")))).otherwise(flags)
        elif a.kind == "MASK_FIELD" and now is not None and isinstance(kinds.get(a.field), StringType):
            new[a.field] = F.when(m & (F.length(now) > 0), F.repeat(F.lit(a.mask), F.length(now))).otherwise(now)
        elif a.kind == "OVERWRITE_FIELD":
            if now is None:
                value = F.lit(a.value) if a.value is not None else F.lit(None).cast("string")
                kinds[a.field] = StringType() if a.value is None or isinstance(a.value, str) else BooleanType() if isinstance(a.value, bool) else DoubleType() if isinstance(a.value, float) else LongType()
                new[a.field] = F.when(m, value.cast(kinds[a.field]))
            else:
                if not _holds(kinds[a.field], a.value):
                    now, kinds[a.field] = now.cast("string"), StringType()
                new[a.field] = F.when(m, F.lit(a.value).cast(kinds[a.field])).otherwise(now)
        elif a.kind == "ROUTE_TO_QUEUE":
            queue = F.when(m, F.lit(a.queue)).otherwise(queue)
    ids = F.when(m, F.concat("matched_rule_ids", F.array(F.lit(str(rule.rule_id))))).otherwise(F.col("matched_rule_ids"))
    return df.withColumns({**new, "is_dropped": dropped, "rule_flags": flags, "routed_queue": queue, "matched_rule_ids": ids}).drop("_match")


def run_rules(df: DataFrame, rules: object, tenant_id: str, keep_dropped: bool = False) -> DataFrame:
    """RUL16: rules in turn, each on what those before made of a record; dropped records go."""
    Tenant(tenant_id)
    none = F.array().cast("array<string>")
    df = df.withColumns({"is_dropped": F.lit(False), "rule_flags": none, "routed_queue": F.lit(None).cast("string"), "matched_rule_ids": none})
    for rule in parse_rules(rules):
        df = apply_rule(df, rule)
    df = df.withColumn("_meta_rules_evaluated", F.lit(True))
    return df if keep_dropped else df.where(~F.col("is_dropped"))
