"""Each record to exactly one action: drop, tombstone, pass or project, or fail with an error's text.

Three tiers. Identity: no expression and no validation is a column expression. Interpreter: one Arrow function holding the
whole chain, as Spark would call Python functions inside CASE for all rows. Native (``native=True``): what
``functions.native`` can express runs as column expressions on the rows for which it can prove them equal, and the
interpreter gets the others. The native tier is off by default: parsing values to VARIANT costs more than it saves (100,000
small objects, one predicate: 6.0 s native, 3.8 s interpreted, on four threads).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interpreter import Expression
from ..functions.values import UNDEF, ExpressionError, ParseError, json_text, kind_of, parse_json
from ..schema import ACTION

INVALID, EVALUATION = "InvalidJson", "Evaluation"


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Policies:
    invalid_json: str = "fail"
    evaluation: str = "fail"

    def __post_init__(self):
        if self.invalid_json not in ("fail", "drop", "tombstone", "pass") or self.evaluation not in ("fail", "drop", "tombstone"):
            raise PlanError("unknown error policy")


@dataclass(frozen=True)
class TransformPlan:
    """Sources of expressions; parsing them is ``validate``'s."""

    drops: tuple[str, ...] = ()
    tombstones: tuple[str, ...] = ()
    drop_tombstones: bool = False
    projection: str | None = None
    variables: str | None = None
    force_json: bool = False
    policies: Policies = field(default_factory=Policies)

    @property
    def has_expressions(self) -> bool:
        return bool(self.drops or self.tombstones or self.projection is not None)

    @property
    def parses_json(self) -> bool:
        return self.force_json or self.has_expressions

    def validate(self) -> None:
        if self.variables is not None:
            try:
                value = parse_json(self.variables)
            except ValueError as error:
                raise PlanError(f"variables are not JSON: {error}") from None
            if type(value) is not dict:
                raise PlanError("variables must be a JSON object")
        for category, sources in (("drop predicate", self.drops), ("tombstone predicate", self.tombstones)):
            for i, source in enumerate(sources, 1):
                _compiled(source, f"{category} #{i}")
        if self.projection is not None:
            _compiled(self.projection, "projection")


def _compiled(source: str, category: str) -> Expression:
    try:
        return Expression(source)
    except ParseError as error:
        raise PlanError(f"{category} JSONata parse error: {error}") from None


class Worker:
    """The interpreter tier for one plan, in one process."""

    def __init__(self, plan: TransformPlan, embeds_json: bool = False):
        self.plan, self.embeds_json = plan, embeds_json
        self.drops = [_compiled(s, "drop predicate") for s in plan.drops]
        self.tombstones = [_compiled(s, "tombstone predicate") for s in plan.tombstones]
        self.projection = None if plan.projection is None else _compiled(plan.projection, "projection")
        self.variables = plan.variables

    def execute(self, payload: bytes | None) -> tuple:
        """(action, payload, payload_length, issue, error)."""
        plan = self.plan
        if payload is None:
            return ("drop" if plan.drop_tombstones else "tombstone", None, None, None, None)
        if not plan.parses_json:
            return ("pass", payload, len(payload), None, None)
        try:
            document = parse_json(payload)
        except ValueError as error:
            return self._by_policy(plan.policies.invalid_json, payload, INVALID, f"invalid JSON: {error}")
        try:
            return self._evaluate(document, payload)
        except ExpressionError as error:
            return self._by_policy(plan.policies.evaluation, payload, EVALUATION, str(error))

    @staticmethod
    def _by_policy(policy: str, payload: bytes, issue: str, message: str) -> tuple:
        # tombstones that a policy makes are kept whatever drop_tombstones says
        kept = payload if policy == "pass" else None
        return (policy, kept, None if kept is None else len(kept), issue, message if policy == "fail" else None)

    def _evaluate(self, document, payload: bytes) -> tuple:
        for i, predicate in enumerate(self.drops, 1):
            if self._predicate(predicate, document, f"drop predicate #{i}"):
                return ("drop", None, None, None, None)
        for i, predicate in enumerate(self.tombstones, 1):
            if self._predicate(predicate, document, f"tombstone predicate #{i}"):
                return ("drop" if self.plan.drop_tombstones else "tombstone", None, None, None, None)
        if self.projection is not None:
            out = self._run(self.projection, document, "projection")
            try:
                if out is UNDEF:
                    raise ExpressionError("result is Undefined")
                text = json_text(out).encode()
            except (ExpressionError, UnicodeEncodeError, RecursionError) as error:
                raise ExpressionError(f"projection evaluation error: {error}") from None
            return ("project", text, len(text), None, None)
        if self.embeds_json:
            return ("pass", json_text(document).encode(), len(payload), None, None)
        return ("pass", payload, len(payload), None, None)

    def _run(self, expression: Expression, document, category: str):
        # variables are read anew for each evaluation, so that none can change another's
        variables = UNDEF if self.variables is None else parse_json(self.variables) if "|" in expression.source else self._parsed()
        try:
            return expression.evaluate(document, variables)
        except ExpressionError as error:
            raise ExpressionError(f"{category} evaluation error: {error}") from None

    def _parsed(self):
        if not hasattr(self, "_variables"):
            self._variables = parse_json(self.variables)
        return self._variables

    def _predicate(self, expression: Expression, document, category: str) -> bool:
        out = self._run(expression, document, category)
        if type(out) is not bool:
            kind = "Undefined" if out is UNDEF else kind_of(out)
            raise ExpressionError(f"{category} evaluation error: result must be a Boolean, received {kind}")
        return out


@lru_cache(maxsize=16)
def worker(plan: TransformPlan, embeds_json: bool) -> Worker:
    """Compiled once in each Python worker."""
    return Worker(plan, embeds_json)


_ARROW = pa.struct([("action", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("issue", pa.string()), ("error", pa.string())])


def interpreted(plan: TransformPlan, embeds_json: bool, value: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        execute = worker(plan, embeds_json).execute
        columns = list(zip(*map(execute, values.to_pylist()), strict=True)) or [()] * 5
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], fields=list(_ARROW))

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, ACTION)
    text = " ".join([*plan.drops, *plan.tombstones, plan.projection or ""])
    if any(f"${name}" in text for name in ("random", "shuffle", "now", "millis")):
        made = made.asNondeterministic()
    return made(value)


def identity(plan: TransformPlan, value: Column) -> Column:
    none = F.lit(None)
    return F.struct(
        F.when(value.isNotNull(), "pass").otherwise("drop" if plan.drop_tombstones else "tombstone").alias("action"),
        value.alias("payload"), F.octet_length(value).cast("long").alias("payload_length"), none.cast("string").alias("issue"), none.cast("string").alias("error"),
    )


def transform(log: DataFrame, plan: TransformPlan, *, embeds_json: bool = False, native: bool = False) -> DataFrame:
    """``log`` with the fields of ``schema.ACTION``. Every record keeps its row; drops are rows with the action drop."""
    from ..functions.native import native_action

    plan.validate()
    value, fields = F.col("value"), [f"_action.{f}" for f in ACTION.fieldNames()]
    if not plan.parses_json:
        return log.withColumn("_action", identity(plan, value)).select(*log.columns, *fields)
    fast = native_action(plan, embeds_json, log) if native else None
    if fast is None:
        return log.withColumn("_action", interpreted(plan, embeds_json, value)).select(*log.columns, *fields)
    columns = log.columns
    log, proven, action = fast
    # two branches of one scan: Python sees only rows that the native tier can't answer for
    left = log.where(proven).withColumn("_action", action).select(*columns, *fields)
    right = log.where(~proven).withColumn("_action", interpreted(plan, embeds_json, value)).select(*columns, *fields)
    return left.unionByName(right)


def before_failures(acted: DataFrame) -> DataFrame:
    """Each partition's records before its first failure."""
    failed = acted.where(F.col("action") == "fail").groupBy(F.col("partition").alias("_p")).agg(F.min("offset").alias("_first"))
    joined = acted.join(F.broadcast(failed), F.col("partition") == F.col("_p"), "left")
    return joined.where(F.col("_first").isNull() | (F.col("offset") < F.col("_first"))).drop("_p", "_first")


def failure_text() -> Column:
    return F.concat(F.col("topic"), F.lit("/"), F.col("partition"), F.lit("/"), F.col("offset"), F.lit(": "), F.col("error"))


def raising(acted: DataFrame) -> DataFrame:
    """The same records; the query fails with the place and text of a failure when it meets one."""
    return acted.withColumn("action", F.when(F.col("action") == "fail", F.raise_error(failure_text())).otherwise(F.col("action")))


def emitted(acted: DataFrame) -> DataFrame:
    return acted.where(F.col("action") != "drop")
