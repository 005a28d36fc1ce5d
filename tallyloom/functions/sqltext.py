"""SQL text of logged queries, read with built-in string expressions.

Comments are removed first and literals masked next, so that what stands inside a literal
is never taken for syntax.
Known limit: raw and triple-quoted strings are not recognised as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive quantifiers: long literals and comments are matched in a loop, not by recursion.
QUOTED = r"""'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
COMMENT = r"--[^\n]*+|#[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
# Patterns of many branches look at one character first: most characters begin no branch.
LITERAL_OR_COMMENT = rf"""(?=['"#/-])(?:({QUOTED})|{COMMENT})"""
# Hex, decimal and ``.5``.  Digits that a dotted name goes on from (my-project-12.d.t) are no number.
NUMBER = (r"(?=[0-9.])(?:\b0[xX][0-9a-fA-F]+|\b[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
          r"|(?<![\w.)\]])\.[0-9]+(?:[eE][+-]?[0-9]+)?)\b(?!(?:-[\w-]*)?\.[A-Za-z_])")
# What is no single space already, and spaces beside signs: plain text has few matches.
SPACES = r"[^\S ]\s*+| \s++"
AROUND_SIGNS = r" ++(?=[(),=<>+*/;-])|(?<=[(),=<>+*/;-]) ++"
TAIL = r"[; ]+$"
DATE_TEXT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

# The aggregate functions a signature lists.
AGGREGATES = ("count", "sum", "avg", "min", "max", "approx_count_distinct")


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, LITERAL_OR_COMMENT, "$1 ")


def _tidy(text: Column) -> Column:
    text = F.regexp_replace(F.lower(text), SPACES, " ")
    text = F.regexp_replace(text, AROUND_SIGNS, "")
    return F.trim(F.regexp_replace(text, TAIL, ""))


def canonical(sql: Column, stripped: bool = False) -> Column:
    """Comment-free, lower-case, evenly spaced text with its literals kept; ``stripped`` says that
    comments are gone already."""
    return _tidy(sql if stripped else strip_comments(sql))


def mask(canonical_text: Column) -> Column:
    """Canonical text with every string and number replaced by ``?``; back-quoted names stay."""
    parts = F.split(F.regexp_replace(canonical_text, QUOTED, "?"), "`")
    # Every second part stands between back quotes.
    return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, part).otherwise(
        F.regexp_replace(part, NUMBER, "?"))), "`")


def shape_text(sql: Column) -> Column:
    return mask(canonical(sql))


def shape_id(sql: Column, shape: Column | None = None) -> Column:
    """SHA-256 of the shape; text with nothing left after masking is hashed as it came."""
    raw = F.coalesce(sql, F.lit(""))
    shape = shape_text(raw) if shape is None else shape
    return F.sha2(F.when(shape == "", raw).otherwise(shape), 256)


def _count(shape: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(shape, F.lit(pattern)), F.lit(0)).cast("long")


def join_count(shape: Column) -> Column:
    return _count(shape, r"\bjoin\b")


def cte_count(shape: Column) -> Column:
    return _count(shape, r"\bas\((?:select|with)\b")


def window_function_count(shape: Column) -> Column:
    return _count(shape, r"\bover(?:\(| [a-z_])")


def subquery_count(shape: Column) -> Column:
    return F.greatest(_count(shape, r"\bselect\b") - 1, F.lit(0).cast("long"))


def has_group_by(shape: Column) -> Column:
    return F.coalesce(shape.rlike(r"\bgroup by\b"), F.lit(False))


def raw_complexity(joins: Column, ctes: Column, windows: Column, subqueries: Column,
                   grouped: Column) -> Column:
    return joins + 2 * ctes + 3 * windows + subqueries + grouped.cast("long")


# ---- signature parts ----------------------------------------------------------------
#
# A text is cut into marks (brackets, clause words, table heads, calls, dates) by one pattern, and the
# marks are folded from left to right over a stack of scopes.

_PART = r"[\w-]+"
_NAME = rf"(?!(?:{'|'.join(AGGREGATES)})\(){_PART}(?:\.{_PART})*+"
_NO_ALIAS = (r"(?!(?:as|on|using|where|group|order|having|limit|qualify|window|join|left|right|full|inner"
             r"|cross|natural|union|intersect|except|select|with|set|when|then|for|tablesample|pivot"
             r"|unpivot|values|and|or|offset|fetch|lateral|from|is|in|not|between|like)\b)")
_ALIAS = rf"(?: ?as\b)? ?({_NO_ALIAS}[a-z_]\w*+)"
_DAY = rf"'({DATE_TEXT})'[?]"
_DATE = rf"(?:(?:date |timestamp |datetime )?{_DAY}|(?:date|timestamp|datetime|cast)\({_DAY}(?: as \w+)?\))"
_JOIN = r"(?:(?:left|right|full|inner|cross)(?: outer)? )?join"
_SET = (r"(?:union|intersect|except)(?: all| distinct)?(?= (?:select|with|values|from|table)\b"
        r"|\(+(?:select|with|values|from|table)\b)")
_CLAUSE = (r"where|group by|having|qualify|window(?= \w+ as\()|order by|limit (?:[?]|@\w+|[0-9]+)"
           r"|select|with(?! offset| ordinality| ties)")
# What a mark is made of: groups of the alternatives below, in the order of _FIELDS.
_MARK = r"(?=[(),<>a-w])(?:(?=[(),<>])|\b)(?:" + "|".join([
    rf"(>=|<=|\bbetween ){_DATE}(?: ?and {_DATE})?",
    r"\bdistinct from\b",
    # Table heads: FROM, JOIN or a comma, a name with its alias or the bracket of its arguments.
    rf"(?:(\bfrom|\b{_JOIN})\b|(,))(?: ?lateral\b)?(?: ?({_NO_ALIAS}{_NAME})(?:(\()|{_ALIAS})?)?",
    rf"\b((?:{'|'.join(AGGREGATES)})\((?:distinct\b)?)",
    rf"(\()(?:(select|with)\b|({_NO_ALIAS}{_NAME})(?!\()(?:{_ALIAS})?)?",
    rf"(\))(?:{_ALIAS})?",
    rf"\b({_SET})|\b({_CLAUSE})",
]) + ")"
_FIELDS = {"compared": "$1", "first": "$2$3", "last": "$4$5", "head": "$6$7", "name": "$8$14", "call": "$9",
           "alias": "$10$15$17", "aggregate": "$11", "bracket": "$12$16", "query": "$13", "set": "$18",
           "clause": "$19"}
# A field ends with _ENDS; those that are also read without their order begin with _TOLD.
_ENDS, _TOLD = "\x01", "\x02"
_SIGNS = f"[`{_ENDS}{_TOLD}]"
_CUT = _ENDS + "".join((_TOLD if name in ("aggregate", "set", "clause") else "") + groups + _ENDS
                       for name, groups in _FIELDS.items())
AGGREGATE = f"{_TOLD}([^{_ENDS}(]++\\([^{_ENDS}]*+)"
SET_OPERATOR = f"{_TOLD}((?:union|intersect|except)[^{_ENDS}]*+)"
LIMIT, ORDER_BY = f"{_TOLD}limit ", f"{_TOLD}order by{_ENDS}"


def _with_one(acc: Column, value: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a state and a value that is computed once: a fold of one step, which unlike an item
    of a transformed array does not work out the type of ``body`` again in every row."""
    return F.aggregate(F.array(value), acc, body)


def dated(canonical_text: Column) -> Column:
    """Canonical text with literals masked, dates beside their masks: what else a literal holds is
    never read."""
    return F.regexp_replace(canonical_text, f"('{DATE_TEXT}')|{QUOTED}", "$1?")


def shape_of_dated(dated_text: Column) -> Column:
    """:func:`mask` of the text that :func:`dated` was made from."""
    return mask(F.regexp_replace(dated_text, rf"'{DATE_TEXT}'[?]", "?"))


def marks(dated_text: Column) -> Column:
    """The text with the pieces that its signature is made of, found in one pass, written as _FIELDS.

    The functions below read this text; give it a column of its own.
    """
    return F.regexp_replace(F.regexp_replace(dated_text, _SIGNS, ""), _MARK, _CUT)


def fields(found: Column) -> Column:
    """The texts between :func:`marks` and the fields of each, in order."""
    return F.split(found, _ENDS)


_FRAME = "struct<kind:string,clause:string,last:string,live:boolean,names:array<string>>"
_TEXTS, _WINDOW = "array<string>", "struct<low:string,high:string>"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _with(value: Column | None, fields: tuple[str, ...], changes: dict[str, Column]) -> Column:
    """A struct with some of its fields changed."""
    return F.struct(*[(changes[name] if name in changes else value[name]).alias(name) for name in fields])


def _frame(value: Column | None, **changes: Column) -> Column:
    return _with(value, ("kind", "clause", "last", "live", "names"), changes)


def _state(value: Column | None, **changes: Column) -> Column:
    return _with(value, ("below", "top", "expects", "tables", "edges", "lows", "highs", "windows", "whole"),
                 {"expects": F.lit(False)} | changes)


def scopes(cut: Column, keep_catalog: bool = False) -> Column:
    """(tables, edges, windows, whole) from a fold of :func:`fields`, a column of its own, over a stack of scopes.

    A scope is a bracket: a query, a group of joins, the arguments of a table function, or anything
    else; it knows its clause, the table named last, its aliases, and whether it is part of the final
    result (``live``).  tables: qualified names after FROM, JOIN or a comma of a FROM clause; a name
    whose first part is an alias of its scopes is a path into a row, and a name without a dot is a CTE
    or unknown.  edges: ``a|b|type`` of a table and the one named right before it in the same FROM, if
    both are tables.  windows: the lowest lower and highest upper date of the WHERE of each final
    SELECT.  whole: whether all brackets match.
    """
    none, text = F.array().cast(_TEXTS), F.lit("")
    start = _state(
        None, below=F.array().cast(f"array<{_FRAME}>"),
        top=_frame(None, kind=F.lit("query"), clause=F.lit("start"), last=text, live=F.lit(True), names=none),
        tables=none, edges=none, lows=none, highs=none, windows=F.array().cast(f"array<{_WINDOW}>"),
        whole=F.lit(True))

    def table(acc: Column, m: dict[str, Column]) -> Column:
        """The qualified name of a mark, empty if it is none or a path."""
        first = F.substring_index(m["name"], ".", 1)
        path = F.array_contains(acc["top"]["names"], first) | F.exists(
            acc["below"], lambda f: F.array_contains(f["names"], first))
        return F.when((m["call"] == "") & m["name"].contains(".") & ~path,
                      m["name"] if keep_catalog else F.substring_index(m["name"], ".", -2)).otherwise("")

    def alias(m: dict[str, Column]) -> Column:
        return F.when(m["alias"] != "", m["alias"]).otherwise(F.substring_index(m["name"], ".", -1))

    def more(texts: Column, one: Column) -> Column:
        return F.when(one != "", F.concat(texts, F.array(one))).otherwise(texts)

    def inner(top: Column) -> Column:
        """The clause of a bracket that is no query: conditions go on in it."""
        return F.when(top["clause"].isin("where", "start"), top["clause"]).otherwise("")

    def headed(acc: Column, m: dict[str, Column], name: Column) -> Column:
        top = acc["top"]
        word = F.substring_index(m["head"], " ", 1)
        kind = F.when(word.isin("left", "right", "full", "cross"), word).otherwise("inner")
        edge = F.when((m["head"] != "from") & (name != "") & (top["last"] != ""), F.concat_ws(
            "|", F.least(top["last"], name), F.greatest(top["last"], name), kind)).otherwise("")
        here = _frame(top, clause=F.lit("from"), last=name, names=F.when(
            m["call"] == "", more(top["names"], alias(m))).otherwise(top["names"]))
        seen = {"tables": more(acc["tables"], name), "edges": more(acc["edges"], edge)}
        called = _state(acc, below=F.concat(acc["below"], F.array(here)), top=_frame(
            top, kind=F.lit("call"), clause=text, last=text, names=none), **seen)
        return F.when(m["call"] != "", called).otherwise(
            _state(acc, top=here, expects=m["name"] == "", **seen))

    def opened(acc: Column, m: dict[str, Column]) -> Column:
        top, query = acc["top"], m["query"] != ""
        new = F.when(query, _frame(top, kind=F.lit("query"), clause=F.lit("select"), last=text,
                                   live=top["live"] & (top["clause"] == "start"), names=none)).otherwise(
            _frame(top, kind=F.lit("other"), clause=inner(top), last=text, names=none))
        # A derived table is no table that a join could be told of.
        here = F.when(acc["expects"], _frame(top, last=text)).otherwise(top)
        return _state(acc, below=F.concat(acc["below"], F.array(here)), top=new)

    def grouped(acc: Column, m: dict[str, Column], name: Column) -> Column:
        group = _frame(acc["top"], kind=F.lit("group"), clause=F.lit("from"), last=name, live=F.lit(False),
                       names=more(none, alias(m)))
        return _state(acc, below=F.concat(acc["below"], F.array(acc["top"])), top=group,
                      expects=m["name"] == "", tables=more(acc["tables"], name))

    def closed(acc: Column, m: dict[str, Column], under: Column) -> Column:
        top, group = acc["top"], acc["top"]["kind"] == "group"
        relation = (top["kind"] != "other") & (under["clause"] == "from")
        # The aliases inside a group of joins are seen outside of it.
        names = F.concat(under["names"], F.when(group, top["names"]).otherwise(none))
        back = _frame(under, last=F.when(group, top["last"]).otherwise(under["last"]),
                      names=F.when(relation, more(names, m["alias"])).otherwise(under["names"]))
        return _state(acc, below=F.slice(acc["below"], 1, F.size(acc["below"]) - 1), top=back)

    def dates(acc: Column, m: dict[str, Column]) -> Column:
        to, from_ = m["compared"] == "<=", m["compared"] == ">="
        last = F.when(m["last"] != "", m["last"]).when(to, m["first"]).otherwise("")
        return _state(acc, lows=F.when(to, acc["lows"]).otherwise(more(acc["lows"], m["first"])),
                      highs=F.when(from_, acc["highs"]).otherwise(more(acc["highs"], last)))

    def parted(acc: Column) -> Column:
        top = acc["top"]
        here = _frame(top, clause=F.lit("start"), last=text)
        return F.when(top["live"], _state(acc, top=here, lows=none, highs=none, windows=F.concat(
            acc["windows"], F.array(_window(acc))))).otherwise(_state(acc, top=here))

    def step(acc: Column, at: Column) -> Column:
        m = {name: F.get(cut, at + k) for k, name in enumerate(_FIELDS)}
        top = acc["top"]
        is_head = (m["head"] != "") & F.when(m["head"] == "from", top["kind"] == "query").otherwise(
            top["clause"] == "from")
        opens = (m["bracket"] == "(") | (m["aggregate"] != _TOLD) | (m["call"] != "")
        return (F.when(is_head, _with_one(acc, table(acc, m), lambda acc, name: headed(acc, m, name)))
                 .when(opens, F.when(acc["expects"] & (m["bracket"] == "(") & (m["query"] == ""), _with_one(
                     acc, table(acc, m), lambda acc, name: grouped(acc, m, name))).otherwise(opened(acc, m)))
                 .when(m["bracket"] == ")", F.when(F.size(acc["below"]) > 0, _with_one(
                     acc, F.element_at(acc["below"], -1), lambda acc, under: closed(acc, m, under)))
                       .otherwise(_state(acc, whole=F.lit(False))))
                 .when(m["clause"] != _TOLD, _state(acc, top=_frame(top, clause=F.when(
                     m["clause"] == _TOLD + "where", "where").otherwise(""))))
                 .when((m["compared"] != "") & top["live"] & (top["clause"] == "where"), dates(acc, m))
                 .when(m["set"] != _TOLD, parted(acc))
                 .otherwise(acc))

    # Each mark's fields begin behind the text before it.
    places = (F.when(F.size(cut) > 1, F.sequence(F.lit(1), F.size(cut) - 1, F.lit(len(_FIELDS) + 1)))
               .when(F.size(cut) == 1, F.array().cast("array<int>")))
    return F.aggregate(places, start, step, lambda acc: F.struct(
        F.sort_array(F.array_distinct(acc["tables"])).alias("tables"),
        F.sort_array(F.array_distinct(acc["edges"])).alias("edges"),
        F.concat(acc["windows"], F.array(_window(acc))).alias("windows"),
        (acc["whole"] & (F.size(acc["below"]) == 0)).alias("whole")))


def _window(acc: Column) -> Column:
    return F.struct(F.array_min(acc["lows"]).alias("low"), F.array_max(acc["highs"]).alias("high"))


def aggregate_functions(found: Column) -> Column:
    """Sorted distinct ``name`` or ``name distinct`` of the aggregates called."""
    return F.sort_array(F.array_distinct(F.transform(
        _all(found, AGGREGATE, 1), lambda m: F.rtrim(F.translate(m, "(", " ")))))


def set_operators(found: Column) -> Column:
    """Sorted set operators, repeats kept, in upper case."""
    return F.sort_array(F.transform(_all(found, SET_OPERATOR, 1), lambda m: F.upper(F.replace(
        m, F.lit(" distinct"), F.lit("")))))


def has_limit(found: Column) -> Column:
    return found.contains(LIMIT)


def has_order_by(found: Column) -> Column:
    return found.contains(ORDER_BY)


def intersect_windows(windows: Column) -> Column:
    """``low..high`` common to an array of (low, high); null when one is open or none is left.

    ``windows`` should be a column already computed: it is read several times.
    """
    open_end = F.exists(windows, lambda w: w["low"].isNull() | w["high"].isNull())
    low = F.array_max(F.transform(windows, lambda w: w["low"]))
    high = F.array_min(F.transform(windows, lambda w: w["high"]))
    return F.when(~open_end & (low <= high), F.concat(low, F.lit(".."), high))


def is_date_text(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"^{DATE_TEXT}$"), F.lit(False))


def tokens(sql: Column, stripped: bool = False) -> Column:
    """Words, literals and signs of comment-free text; only literals keep their case."""
    found = _all(sql if stripped else strip_comments(sql), rf"([\w.]++|{QUOTED}|[^\s\w])", 1)
    return F.transform(found, lambda t: F.when(t.startswith("'") | t.startswith('"'), t).otherwise(F.lower(t)))
