"""The dialect of an embedded SQL engine, spelled in Spark SQL.

It is spelled in three steps. Before parsing, words that Spark's parser lacks get its own (``words``): ``GLOB``, ``COLLATE NOCASE``, names
of types in casts, and names in double quotes. Then the parser says where each call stands in the statement (``spelled``). At last the analysed plan says
what types operands have (``typed``): two whole numbers are divided as such, a text is cast to a number by its numeric prefix. What
is put in place is text in Spark's own SQL, so that everything stays in the JVM and Catalyst plans it like any other
expression. Whatever both dialects spell and mean alike stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from ..functions.dialect import glob_pattern


class Unsupported(ValueError):
    """A call that cannot be spelled in Spark SQL; the message says why."""


def _close(sql: str, at: int) -> int:
    """Index of the bracket that closes the one at ``at``; quoted text does not count."""
    depth = 0
    for m in re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[()]", re.S).finditer(sql, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    raise Unsupported("brackets are not balanced")


def arguments(inner: str) -> list[str]:
    """The arguments of a call, split at commas outside brackets and quotes."""
    out, depth, last = [], 0, 0
    for m in re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[(),]", re.S).finditer(inner):
        if m[0] == "," and not depth:
            out.append(inner[last : m.start()].strip())
            last = m.end()
        depth += {"(": 1, ")": -1}.get(m[0], 0)
    rest = inner[last:].strip()
    return [*out, rest] if rest or out else []


def _text(argument: str, what: str) -> str:
    m = re.fullmatch(r"'((?:[^']|'')*)'", argument)
    if not m:
        raise Unsupported(f"{what} must be a text in quotes")
    return m[1].replace("''", "'")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Before parsing ---------------------------------------------------------------------------------

_TOKENS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?|.", re.S)
#: Names of types in casts and of collations, and Spark's for them.
TYPES = {"text": "STRING", "varchar": "STRING", "char": "STRING", "clob": "STRING", "integer": "BIGINT", "int": "BIGINT", "real": "DOUBLE", "float": "DOUBLE", "numeric": "DOUBLE"}
COLLATIONS = {"nocase": "UTF8_LCASE", "binary": "UTF8_BINARY", "rtrim": "UTF8_BINARY_RTRIM"}


def words(sql: str) -> tuple[str, frozenset[int]]:
    """``sql`` with the words that Spark's parser lacks replaced, and where a LIKE of it stands for GLOB."""
    out, globs, casts, depth, before = [], set(), [], 0, ["", ""]
    size = 0
    for m in _TOKENS.finditer(sql):
        token, low = m[0], m[0].lower()
        if low == "(":
            depth += 1
            if before[-1] == "cast":
                casts.append(depth)
        elif low == ")":
            if casts and casts[-1] == depth:
                casts.pop()
            depth -= 1
        elif low == "glob" and not re.match(r"\s*\(", sql[m.end() :]):
            globs.add(size)
            token = "LIKE"
        elif low[0] == '"' and len(low) > 1:  # a name, never a text
            token = "`" + token[1:-1].replace('""', '"').replace("`", "``") + "`"
        elif before[-1] == "collate" and low in COLLATIONS:
            token = COLLATIONS[low]
        elif before[-1] == "as" and casts and casts[-1] == depth and low in TYPES:
            token = TYPES[low]
        elif re.fullmatch(r"[0-9]*\.[0-9]*", low) and low != "." and not re.match(r"\w", sql[m.end() :]):
            token += "D"  # a literal with a point is a real number
        out.append(token)
        size += len(token)
        if not (low.isspace() or low.startswith(("--", "/*"))):
            before = [before[-1], low]
    return "".join(out), frozenset(globs)


def glob_expression(pattern: str) -> str:
    """A regular expression, as SQL, for the glob that an expression gives."""
    if re.fullmatch(r"'((?:[^']|'')*)'", pattern.strip()):
        return _quoted(glob_pattern(_text(pattern.strip(), "a glob")))
    escaped = f"regexp_replace({pattern}, '([\\\\\\\\.+$(){{}}|])', '\\\\\\\\$1')"
    return f"concat('(?s)^', replace(replace({escaped}, '*', '.*'), '?', '.'), '$')"


# Dates ------------------------------------------------------------------------------------------


def _moment(args: list[str]) -> str:
    """A time without a zone from a date's text and modifiers; NULL where it is none."""
    t = f"try_cast(CAST({args[0]} AS STRING) AS TIMESTAMP_NTZ)"
    for modifier in (_text(a, "a modifier").strip().lower() for a in args[1:]):
        day = f"CAST({t} AS DATE)"
        if m := re.fullmatch(r"start of (month|year|day)", modifier):
            t = f"CAST({day if m[1] == 'day' else f'trunc({day}, {_quoted(m[1])})'} AS TIMESTAMP_NTZ)"
        elif m := re.fullmatch(r"([+-]?\d+) (day|hour|minute|second)s?", modifier):
            t = f"timestampadd({m[2].upper()}, {int(m[1])}, {t})"
        elif m := re.fullmatch(r"([+-]?\d+) (month|year)s?", modifier):  # days overflow into the next month
            months = int(m[1]) * (12 if m[2] == "year" else 1)
            t = f"(CAST(date_add(add_months(trunc({day}, 'month'), {months}), day({t}) - 1) AS TIMESTAMP_NTZ) + ({t} - CAST({day} AS TIMESTAMP_NTZ)))"
        else:
            raise Unsupported(f"date modifier {modifier!r}")
    return t


def _days(t: str) -> str:
    return f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {t}) / 86400000000D + 2440587.5D)"


#: Format letters and the expressions that they stand for.
_LETTERS: dict[str, Callable[[str], str]] = {
    **{k: (lambda t, p=p: f"date_format({t}, '{p}')") for k, p in {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "ss.SSS"}.items()},
    "j": lambda t: f"lpad(CAST(dayofyear({t}) AS STRING), 3, '0')",
    "w": lambda t: f"CAST(dayofweek({t}) - 1 AS STRING)",
    "W": lambda t: f"lpad(CAST((dayofyear({t}) + 6 - (dayofweek({t}) + 5) % 7) DIV 7 AS STRING), 2, '0')",
    "s": lambda t: f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {t}) AS STRING)",
    "J": lambda t: f"CAST({_days(t)} AS STRING)",
}


def _strftime(args: list[str]) -> str:
    t, parts = _moment(args[1:]), []
    if not re.fullmatch(r"'((?:[^']|'')*)'", args[0]):  # a format that rows bring along: each letter in turn
        out = f"replace(CAST({args[0]} AS STRING), '%%', chr(1))"
        for letter, form in _LETTERS.items():
            out = f"replace({out}, '%{letter}', {form(t)})"
        return f"if({t} IS NULL, NULL, replace({out}, chr(1), '%'))"
    form = _text(args[0], "a format")
    for m in re.finditer(r"%(.)|[^%]+|%$", form, re.S):
        if m[1] is None or m[1] == "%":
            parts.append(_quoted("%" if m[1] else m[0]))
        elif m[1] in _LETTERS:
            parts.append(_LETTERS[m[1]](t))
        else:
            raise Unsupported(f"strftime does not know %{m[1]}")
    return f"if({t} IS NULL, NULL, concat({', '.join(parts) or _quoted('')}))"


# Calls ------------------------------------------------------------------------------------------


def _extreme(name: str, args: list[str]) -> str:
    null = " OR ".join(f"({a}) IS NULL" for a in args)
    return f"CASE WHEN {null} THEN NULL ELSE {name}({', '.join(args)}) END"


def _typeof(args: list[str]) -> str:
    kind = f"typeof({args[0]})"
    return f"CASE WHEN ({args[0]}) IS NULL THEN 'null' WHEN {kind} IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN {kind} IN ('float', 'double') OR {kind} LIKE 'decimal%' THEN 'real' WHEN {kind} = 'binary' THEN 'blob' ELSE 'text' END"


def _group_concat(args: list[str], tail: str) -> str:
    value, separator = args[0], args[1] if len(args) > 1 else "','"
    distinct = re.match(r"(?i)distinct\b", value)
    gathered = f"collect_set(CAST({value[distinct.end() :]} AS STRING))" if distinct else f"collect_list(CAST({value} AS STRING))"
    rows = f"sort_array({gathered}{tail})"  # in the order of the values, so that the result is defined
    return f"if(size({rows}) > 0, array_join({rows}, {separator}), NULL)"


def _total(args: list[str], tail: str) -> str:
    distinct = re.match(r"(?i)distinct\b", args[0])
    value = args[0][distinct.end() :] if distinct else args[0]
    return f"coalesce(sum({'DISTINCT ' if distinct else ''}CAST({value} AS DOUBLE)){tail}, 0.0D)"


#: Conversions of a format and the type of what they print.
_CONVERSIONS = {"d": "BIGINT", "i": "BIGINT", "u": "BIGINT", "x": "BIGINT", "X": "BIGINT", "o": "BIGINT", "f": "DOUBLE", "e": "DOUBLE", "E": "DOUBLE", "s": "STRING", "c": "STRING"}


def _printf(args: list[str]) -> str:
    """Arguments take the types that the conversions ask for; what is missing or NULL prints as 0 or nothing."""
    if not re.fullmatch(r"'((?:[^']|'')*)'", args[0]):
        return f"format_string({', '.join(args)})"  # a format that rows bring along
    form, rest, out, given = _text(args[0], "a format"), args[1:], "", []
    for m in re.finditer(r"%([-+ 0,#]*)(\d*)(\.\d+)?l{0,2}(.)|[^%]+|%$", form, re.S):
        kind = m[4]
        if kind is None or kind == "%":
            out += m[0].replace("%", "%%") if kind is None else "%%"
            continue
        if kind not in _CONVERSIONS:
            raise Unsupported(f"printf does not know %{kind}")
        value = rest[len(given)] if len(given) < len(rest) else "NULL"
        cast = f"CAST({value} AS {_CONVERSIONS[kind]})"
        empty = {"BIGINT": "0L", "DOUBLE": "0.0D", "STRING": "''"}[_CONVERSIONS[kind]]
        given.append(f"substr(coalesce({cast}, {empty}), 1, 1)" if kind == "c" else f"coalesce({cast}, {empty})")
        flags = m[1] if _CONVERSIONS[kind] != "STRING" else "-" if "-" in m[1] else ""
        java = {"i": "d", "u": "d", "c": "s", "E": "E"}.get(kind, kind)
        if _CONVERSIONS[kind] == "BIGINT" and m[3]:
            raise Unsupported(f"printf with a precision for %{kind}")
        out += f"%{flags}{m[2]}{m[3] or ''}{java}"
    return f"format_string({', '.join([_quoted(out), *given])})"


#: name -> (fewest, most arguments, how it is spelled)
SCALAR: dict[str, tuple[int, int, Callable[[list[str]], str]]] = {
    "iif": (3, 3, lambda a: f"if({', '.join(a)})"),
    "min": (2, 99, lambda a: _extreme("least", a)),
    "max": (2, 99, lambda a: _extreme("greatest", a)),
    "typeof": (1, 1, _typeof),
    "glob": (2, 2, lambda a: f"(({a[1]}) RLIKE {glob_expression(a[0])})"),
    "like": (2, 2, lambda a: f"(({a[1]}) ILIKE {a[0]})"),
    "printf": (1, 99, _printf),
    "format": (1, 99, _printf),
    "strftime": (2, 9, _strftime),
    "date": (1, 9, lambda a: f"date_format({_moment(a)}, 'yyyy-MM-dd')"),
    "datetime": (1, 9, lambda a: f"date_format({_moment(a)}, 'yyyy-MM-dd HH:mm:ss')"),
    "time": (1, 9, lambda a: f"date_format({_moment(a)}, 'HH:mm:ss')"),
    "julianday": (1, 9, lambda a: _days(_moment(a))),
    "sqrt": (1, 1, lambda a: f"if(({a[0]}) >= 0, sqrt({a[0]}), NULL)"),
    "trim": (2, 2, lambda a: f"trim(BOTH {a[1]} FROM {a[0]})"),
    "ltrim": (2, 2, lambda a: f"trim(LEADING {a[1]} FROM {a[0]})"),
    "rtrim": (2, 2, lambda a: f"trim(TRAILING {a[1]} FROM {a[0]})"),
}
AGGREGATES: dict[str, Callable[[list[str], str], str]] = {"total": _total, "group_concat": _group_concat}


def spelled(sql: str, calls: Iterable[tuple[int, str]], likes: Iterable[int], globs: dict[int, tuple[int, int]] | None = None) -> str:
    """``sql`` with the calls (start, lower-cased name), the LIKEs, and the GLOBs (start -> ends of their pattern) in Spark's spelling.

    What stands last goes first, so that the places before it stay right, and arguments are done before their call.
    """
    globs, moved = globs or {}, []  # places of edits, and by how much they lengthen the text
    for at, name in sorted({*calls, *((k, "") for k in likes)}, reverse=True):
        before = len(sql)
        if name:
            sql = _respelled(sql, at, name)
        elif at in globs:
            start, end = globs[at]
            end += sum(by for place, by in moved if place < end)  # what stands in the pattern may have been respelled
            sql = sql[:at] + re.sub(r"(?i)\blike\b", "RLIKE", sql[at:start], count=1) + glob_expression(sql[start:end]) + sql[end:]
        else:
            sql = sql[:at] + re.sub(r"(?i)^(\s*(?:not\s+)?)like\b", r"\1ILIKE", sql[at:], count=1)
        moved.append((at, len(sql) - before))
    return sql


def _respelled(sql: str, at: int, name: str) -> str:
    """``sql`` with the call of ``name`` at a place in Spark's spelling."""
    opening = sql.find("(", at)
    if opening < 0 or (name not in SCALAR and name not in AGGREGATES):
        return sql
    closing = _close(sql, opening)
    args = arguments(sql[opening + 1 : closing])
    if name in AGGREGATES:
        tail, end = "", closing + 1
        while m := re.compile(r"(?i)\s*(filter|over)\s*\(").match(sql, end):
            stop = _close(sql, m.end() - 1) + 1
            tail, end = tail + sql[end:stop], stop
        return sql[:at] + AGGREGATES[name](args, tail) + sql[end:]
    fewest, most, form = SCALAR[name]
    return sql[:at] + form(args) + sql[closing + 1 :] if fewest <= len(args) <= most else sql


# By types ---------------------------------------------------------------------------------------

_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: The numeric prefix of a text, as whole number and as real.
_PREFIX = {"BIGINT": r"^\s*([+-]?[0-9]+)", "DOUBLE": r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"}


def _slash(sql: str, start: int, end: int) -> int:
    """Place of the last ``/`` between two places that stands in no bracket, quotes, CASE or comment; -1 if none."""
    depth, found = 0, -1
    for m in _TOKENS.finditer(sql[start:end]):
        low = m[0].lower()
        depth += {"(": 1, "case": 1, ")": -1, "end": -1}.get(low, 0)
        if low == "/" and not depth:
            found = start + m.start()
    return found


def _prefix(text: str, kind: str) -> str:
    """A text's numeric prefix as a number: 0 without one, NULL for NULL; whole numbers stop at the ends of 64 bits."""
    digits = f"regexp_extract({text}, {_quoted(_PREFIX[kind])}, 1)"
    if kind == "DOUBLE":
        return f"if(({text}) IS NULL, NULL, coalesce(try_cast({digits} AS DOUBLE), 0.0D))"
    ends = f"CASE WHEN {digits} = '' THEN 0L WHEN {digits} LIKE '-%' THEN -9223372036854775807L - 1L ELSE 9223372036854775807L END"
    return f"if(({text}) IS NULL, NULL, coalesce(try_cast({digits} AS BIGINT), {ends}))"


def typed(sql: str, analysed: Callable[[str], object], user_cast) -> str:
    """``sql`` with divisions of whole numbers and casts of texts to numbers spelled by the types that the analysed plan shows.

    Types follow from each other, so innermost places are changed and the statement is analysed again, until nothing is left.
    """
    if not re.search(r"(?i)/|\bcast\b", sql):
        return sql
    for _ in range(50):
        edits: dict[tuple[int, int], str] = {}
        for e in _expressions(analysed(sql)):
            kind, origin = e.getClass().getSimpleName(), e.origin()
            if kind not in ("Divide", "Cast") or not origin.startIndex().isDefined() or not (origin.sqlText().isDefined() and origin.sqlText().get() == sql):
                continue
            start, end = origin.startIndex().get(), origin.stopIndex().get() + 1
            if kind == "Divide":
                if all(_own_type(x, user_cast) in _WHOLE for x in (e.left(), e.right())) and (at := _slash(sql, start, end)) >= 0:
                    edits[at, at + 1] = " DIV "
            elif e.getTagValue(user_cast).isDefined() and e.evalMode().toString() != "TRY" and _own_type(e.child(), user_cast).split(" ")[0] == "string":
                to = e.dataType().simpleString()
                m = re.match(r"(?is)cast\s*\((.*)\bas\s+\w+(?:\s*\([^)]*\))?\s*\)$", sql[start:end])
                if m and (to in _WHOLE or to in ("float", "double") or to.startswith("decimal")):
                    edits[start, end] = _prefix(m[1].strip(), "BIGINT" if to in _WHOLE else "DOUBLE")
        inner = [r for r in edits if not any(r != o and r[0] <= o[0] and o[1] <= r[1] for o in edits)]
        if not inner:
            return sql
        for start, end in sorted(inner, reverse=True):
            sql = sql[:start] + edits[start, end] + sql[end:]
    raise Unsupported("the statement nests too deeply")


def _own_type(e, user_cast) -> str:
    """The type of an operand before the analyser's own casts."""
    while e.getClass().getSimpleName() == "Cast" and not e.getTagValue(user_cast).isDefined():
        e = e.child()
    return e.dataType().simpleString()


def _expressions(plan) -> Iterable:
    """All expressions of a plan, those of its subqueries included."""
    plans, found = [plan], []
    while plans:
        p = plans.pop()
        for seq, into in ((p.expressions().toSeq(), found), (p.children().toSeq(), plans)):
            into += [seq.apply(i) for i in range(seq.size())]
        while found:
            e = found.pop()
            yield e
            kind = e.getClass().getSimpleName()
            if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(e.plan())
            elif kind == "InSubquery":
                plans.append(e.query().plan())
            children = e.children().toSeq()
            found += [children.apply(i) for i in range(children.size())]
