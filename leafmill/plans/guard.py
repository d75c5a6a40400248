"""What one question in SQL may do: a single SELECT over the loaded tables with known functions.

Spark's own parser makes the plan; this walks it, subqueries in expressions included, and refuses every node,
relation or function that is not on the list. Nothing is executed for the check.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .lenient import Unsupported, spelled, words

MAX_LENGTH = 8000
# Functions of the SQL surface (aggregates, scalars, dates, window functions), and Spark's names for those that it spells differently.
FUNCTIONS = frozenset(
    "count sum avg min max total group_concat "
    "round abs coalesce nullif ifnull iif lower upper trim ltrim rtrim substr substring length replace instr typeof like glob printf format floor ceil ceiling sqrt power sign "
    "strftime date datetime time julianday "
    "row_number rank dense_rank lag lead first_value last_value ntile".split()
)
SPARK_FORMS = frozenset("if listagg string_agg concat greatest least try_divide div format_string date_format to_date try_to_timestamp year month day dayofweek dayofyear date_add date_sub datediff trunc date_trunc unix_date ilike isnull isnotnull between".split())
#: Plan nodes of a SELECT; a local relation is what VALUES becomes.
NODES = frozenset("Project Filter Aggregate Sort OrderBy GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable OneRowRelation UnresolvedHaving WithWindowDefinition Window LocalRelation".split())
DENIED_EXPRESSIONS = frozenset("RLike CurrentDate CurrentTimestamp CurrentUser CurrentCatalog CurrentDatabase UnresolvedGenerator Generator LambdaFunction ScalarPythonUDF".split())
DENIED_NAMES = frozenset("current_date current_timestamp current_user current_catalog current_database current_schema session_user user now localtimestamp current_time".split())


class NotAllowed(ValueError):
    """The statement is refused; the message says why."""


@dataclass
class Checked:
    sql: str
    tables: list[str] = field(default_factory=list)
    #: ``sql`` as Spark runs it, with the calls that it spells differently
    spark_sql: str = ""


def statement(sql: str) -> str:
    """The trimmed statement: comments before it and a closing semicolon removed; it starts with SELECT or WITH."""
    text = sql.strip()
    while m := re.match(r"\s*(?:--[^\n]*(?:\n|$)|/\*.*?\*/)", text, re.S):
        text = text[m.end() :]
    text = text.strip().rstrip(";").strip()
    if not text:
        raise NotAllowed("The statement is empty")
    if len(text) > MAX_LENGTH:
        raise NotAllowed(f"The statement is longer than {MAX_LENGTH:,} characters")
    if not re.match(r"(?i)(select|with)\b", text):
        raise NotAllowed("Only SELECT statements are allowed")
    return text


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check(spark: SparkSession, sql: str, tables: Iterable[str], table_functions: Iterable[str] = ()) -> Checked:
    """Parse ``sql`` and refuse what is not a SELECT over ``tables``. Returns it with the tables that it reads, also in Spark's spelling.

    ``table_functions`` may stand in FROM, also laterally; by default there are none.
    """
    text, globbed = words(statement(sql))
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise NotAllowed(f"The statement cannot be read: {str(e).strip().splitlines()[0][:300]}") from None
    allowed, used = {t.lower() for t in tables}, {}
    functions = {f.lower() for f in table_functions}
    nodes = NODES | {"LateralJoin", "UnresolvedTableValuedFunction"} if functions else NODES
    calls: set[tuple[int, str]] = set()
    likes: set[int] = set()
    globs: dict[int, tuple[int, int]] = {}

    def place(e) -> int:
        at = e.origin().startIndex()
        return at.get() if at.isDefined() else -1

    def expression(e, ctes: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName().strip("$")
        if kind in DENIED_EXPRESSIONS:
            raise NotAllowed(f"Not allowed: {e.prettyName()}")
        if kind == "UnresolvedFunction":
            name = ".".join(_each(e.nameParts())).lower()
            if name not in FUNCTIONS | SPARK_FORMS:
                raise NotAllowed(f"Not allowed: function {name}")
            if place(e) >= 0:
                calls.add((place(e), name))
        elif kind == "Like" and place(e) >= 0:
            likes.add(place(e))
            word = re.compile(r"(?i)\s*(?:not\s+)?").match(text, place(e)).end()
            if word in globbed:  # the parser gives a pattern's place, but not that of brackets around it
                pattern = e.right().origin()
                globs[place(e)] = (pattern.startIndex().get(), pattern.stopIndex().get() + 1)
        elif kind == "UnresolvedAttribute":
            parts = _each(e.nameParts())
            if len(parts) == 1 and parts[0].lower() in DENIED_NAMES:
                raise NotAllowed(f"Not allowed: {parts[0]}")
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            node(e.plan(), ctes)
        elif kind == "InSubquery":
            node(e.query().plan(), ctes)
        for c in _each(e.children().toSeq()):
            expression(c, ctes)

    def node(p, ctes: frozenset[str]) -> None:
        kind = p.getClass().getSimpleName().strip("$")
        if kind not in nodes:
            raise NotAllowed(f"Not allowed: {p.nodeName()}")
        if kind == "UnresolvedTableValuedFunction" and (name := ".".join(_each(p.name())).lower()) not in functions:
            raise NotAllowed(f"Not allowed: table function {name}")
        if kind == "UnresolvedRelation":
            parts = _each(p.multipartIdentifier())
            name = parts[0].lower()
            if len(parts) > 1 or (name not in ctes and name not in allowed):
                raise NotAllowed(f"Not allowed: table {'.'.join(parts)}")
            if name not in ctes:
                used[name] = parts[0]
        if kind == "UnresolvedWith":
            if p.allowRecursion():
                raise NotAllowed("Not allowed: recursion")
            for relation in _each(p.cteRelations()):
                node(relation._2(), ctes)
                ctes = ctes | {relation._1().lower()}
            node(p.child(), ctes)
            return
        for e in _each(p.expressions().toSeq()):
            expression(e, ctes)
        for c in _each(p.children().toSeq()):
            node(c, ctes)

    node(plan, frozenset())
    try:
        return Checked(text, sorted(used), spelled(text, calls, likes, globs))
    except Unsupported as e:
        raise NotAllowed(f"Not allowed: {e}") from None
