"""Read-only entry for free-form SQL over registered views."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from martwright.operators.rows import cap

# Functions that leave SQL.
BLOCKED_FUNCTIONS = ("reflect", "java_method", "try_reflect", "identifier")
# Functions that may stand in place of a table.
TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}

# What a parsed query may be made of. Anything else is refused, known or not: scripts,
# commands, time travel, parameters, and names that are put together while running.
QUERY_NODES = set(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint
    UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith
    WithWindowDefinition""".split()
)
VALUE_NODES = set(
    """Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Concat
    CreateNamedStruct Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists First GreaterThan GreaterThanOrEqual GroupingSets In
    InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll
    LikeAny ListQuery Literal Lower MultiAlias Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup
    ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimBoth StringTrimLeft StringTrimRight Substring Subtract
    TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute
    UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar
    UnresolvedStarExceptOrReplace UnresolvedWindowExpression UnspecifiedFrame$ Upper WindowExpression WindowSpecDefinition""".split()
)

MAX_ROWS = 500
QUESTION_LENGTH = (5, 500)

_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", re.DOTALL)
_FENCE = re.compile(r"```(?:sql)?", re.IGNORECASE)


@dataclass(frozen=True)
class Answer:
    """Rows of a statement, or the reason there are none."""

    rows: DataFrame | None
    truncated: bool = False
    error: str | None = None


def check_question(text: str) -> str | None:
    """Why a question can not be taken, or None."""
    length = len(text.strip())
    if length < QUESTION_LENGTH[0]:
        return "question too short"
    if length > QUESTION_LENGTH[1]:
        return f"question too long (at most {QUESTION_LENGTH[1]} characters)"
    return None


def extract_statement(text: str) -> str:
    """First SELECT or WITH statement of a text, without code fences."""
    bare = _FENCE.sub("", text).strip()
    start = re.search(r"\b(SELECT|WITH)\s", bare, re.IGNORECASE)
    return re.split(r";", bare[start.start():], maxsplit=1)[0].strip() if start else ""


def refusal(text: str) -> str | None:
    """Why a text is not one plain SELECT statement, or None. Quoted text does not count."""
    bare = _QUOTED.sub("''", text).strip()
    if "--" in bare or "/*" in bare:
        return "comments are not allowed"
    bare = bare.removesuffix(";").strip()
    if ";" in bare:
        return "only one statement is allowed"
    if not re.match(r"(SELECT|WITH)\b", bare, re.IGNORECASE):
        return "only SELECT statements are allowed"
    if any(re.search(r"[\[\]\n,]", name) for name in re.findall(r"`([^`]*)`", bare)):
        return "odd name"
    for name in re.findall(r"(\w+)`?\s*\(", bare):
        if name.lower() in BLOCKED_FUNCTIONS:
            return f"blocked function {name}"
    return None


class _Walk:
    """Visits every part of a parsed statement: nodes, what they hold, subqueries at any depth.

    A part that is no node (a list, a pair, an option) is only looked into, so nothing can
    hide in a field that a list of children leaves out.
    """

    def __init__(self, session: SparkSession):
        kind = session._jvm.java.lang.Class.forName
        self.node, self.many, self.record = (
            kind(name)
            for name in ("org.apache.spark.sql.catalyst.trees.TreeNode", "scala.collection.Iterable", "scala.Product")
        )

    def refusal(self, part: Any, known: frozenset[str]) -> str | None:
        """Why a part may not run, or None; ``known`` are the tables in sight."""
        if not isinstance(part, JavaObject):
            return None
        if self.node.isInstance(part):
            name = part.getClass().getName().rsplit(".", 1)[-1]
            if name not in QUERY_NODES and name not in VALUE_NODES:
                return f"not a plain query ({name})"
            if name == "UnresolvedWith":
                return self._definitions(part, known)
            reason = self._named(name, part, known)
            if reason:
                return reason
        elif self.many.isInstance(part):
            return next(filter(None, (self.refusal(item, known) for item in self._items(part))), None)
        if not self.record.isInstance(part):
            return None
        fields = (part.productElement(i) for i in range(part.productArity()))
        return next(filter(None, (self.refusal(field, known) for field in fields)), None)

    @staticmethod
    def _items(many: Any) -> Iterator[Any]:
        each = many.iterator()
        while each.hasNext():
            yield each.next()

    def _definitions(self, part: Any, known: frozenset[str]) -> str | None:
        """WITH: a definition is in sight of the later ones and of the query, of itself if it may recur."""
        for pair in self._items(part.cteRelations()):
            name = frozenset([pair.productElement(0).lower()])
            reason = self.refusal(pair.productElement(1), known | name if part.allowRecursion() else known)
            if reason:
                return reason
            known = known | name
        return self.refusal(part.child(), known)

    def _named(self, kind: str, part: Any, known: frozenset[str]) -> str | None:
        if kind == "UnresolvedRelation":
            names = list(self._items(part.multipartIdentifier()))
            if len(names) != 1 or names[0].lower() not in known:
                return f"unknown table {'.'.join(names)}"
        if kind == "UnresolvedTableValuedFunction":
            names = list(self._items(part.name()))
            if names[-1].lower() not in TABLE_FUNCTIONS or len(names) > 1:
                return f"blocked function {'.'.join(names)}"
        if kind == "UnresolvedFunction":
            names = list(self._items(part.nameParts()))
            if names[-1].lower() in BLOCKED_FUNCTIONS:
                return f"blocked function {names[-1]}"
        return None


def plan_refusal(session: SparkSession, text: str, allowed: Iterable[str]) -> str | None:
    """Why a statement may not run, or None; it is parsed and looked at node by node, and nothing of it runs.

    It may read the allowed views and, where they are in sight, the tables it defines by
    WITH, and be made of nothing but ``QUERY_NODES`` and ``VALUE_NODES``.
    """
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
    return _Walk(session).refusal(plan, frozenset(name.lower() for name in allowed))


def guarded_sql(spark: SparkSession, text: str, max_rows: int = MAX_ROWS, inclusive: bool = False, views: Iterable[str] | None = None) -> Answer:
    """Run one read-only statement over the allowed views, at most ``max_rows`` rows.

    ``views`` are those made known by ``register_views`` unless given. Problems come
    back as text. Unknown tables or columns are found before any task starts.
    """
    reason = refusal(text)
    if reason:
        return Answer(None, error=reason)
    statement = text.strip().removesuffix(";")
    try:
        reason = plan_refusal(spark, statement, _registered if views is None else views)
        if reason:
            return Answer(None, error=reason)
        rows, truncated = cap(spark.sql(statement), max_rows, inclusive)
        return Answer(rows, truncated)
    except (PySparkException, ValueError) as problem:
        lines = [line for line in str(problem).splitlines() if line.strip() and not line.startswith(("==", "Error occurred"))]
        return Answer(None, error=(lines or ["no such statement"])[0])


_registered: set[str] = set()


def register_views(tables: dict[str, DataFrame], names: Iterable[str] | None = None) -> None:
    """Make tables known to free-form statements."""
    for name in names or tables:
        tables[name].createOrReplaceTempView(name)
        _registered.add(name)
