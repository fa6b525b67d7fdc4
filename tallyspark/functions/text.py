"""Text helpers as built-in Column expressions (JVM-side, codegen; no Python UDF).

Regex dialect: fixed patterns are written in Python ``re`` syntax and turned
into Java patterns with the same meaning by :func:`java_regex`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace set of Python's str.strip()/str.isspace() (fixed value).
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(col_(c), F.lit(PY_WS_CHARS))


def lines(c: Column | str) -> Column:
    """``s.split('\\n')``: array of lines, empty string gives one empty line."""
    return F.split(col_(c), "\n", -1)


def unlines(arr: Column) -> Column:
    return F.array_join(arr, "\n")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions referenced inside a higher-order function's lambda are
    re-evaluated per element; binding them first keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


# Python ``re`` character classes (str patterns), spelled for Java regex.
PY_WORD = "\\p{L}\\p{N}_"        # str.isalnum() or '_'
PY_SPACE = ("\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
            "\\u2028\\u2029\\u202f\\u205f\\u3000")   # str.isspace()


def java_regex(pattern: str, dotall: bool = False) -> str:
    """A Python ``re`` pattern with Python semantics on Java regex (Spark).

    ``\\w \\s \\d`` become explicit classes with Python's (Unicode) members,
    ``\\b`` a lookaround on Python's word class, ``(?P<n>`` a Java named group;
    ``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a line end, as Python does.
    """
    word_b = f"(?:(?<=[{PY_WORD}])(?![{PY_WORD}])|(?<![{PY_WORD}])(?=[{PY_WORD}]))"
    inside = {"w": PY_WORD, "s": PY_SPACE, "d": "\\p{Nd}"}
    outside = {"w": f"[{PY_WORD}]", "s": f"[{PY_SPACE}]", "d": "\\p{Nd}", "W": f"[^{PY_WORD}]",
               "S": f"[^{PY_SPACE}]", "D": "\\P{Nd}", "b": word_b}
    out, in_class, i = [], False, 0
    # Java group names are letters and digits only
    p = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + re.sub(r"[^A-Za-z0-9]", "", m.group(1)) + ">", pattern)
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            e = p[i + 1]
            table = inside if in_class else outside
            if e in table:
                out.append(table[e])
            elif in_class and e in "WSDb":
                raise ValueError(f"unsupported escape \\{e} in a class: {pattern}")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            # a ']' right after '[' or '[^' is literal
            if p[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if p[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
            i += 1
            continue
        if c == "]" and in_class:
            in_class = False
        if c == "{" and not in_class and not re.match(r"\{\d+(,\d*)?\}", p[i:]):
            out.append("\\{")          # Python reads a bare '{' literally, Java needs it escaped
            i += 1
            continue
        out.append(c)
        i += 1
    return ("(?s)" if dotall else "") + "(?d)" + "".join(out)


def java_replacement(rep: str) -> str:
    """A Python ``re.sub`` replacement (``\\1``, ``\\g<1>``) as a Java replacement (``$1``)."""
    out, i = [], 0
    while i < len(rep):
        c = rep[i]
        if c == "\\" and i + 1 < len(rep) and rep[i + 1].isdigit():
            out.append("$" + rep[i + 1])
            i += 2
        elif c == "\\" and rep[i + 1:i + 3] == "g<":
            j = rep.index(">", i)
            out.append("${" + rep[i + 3:j] + "}" if not rep[i + 3:j].isdigit() else "$" + rep[i + 3:j])
            i = j + 1
        elif c == "$":
            out.append("\\$")
            i += 1
        elif c == "\\" and i + 1 < len(rep):
            out.append("\\" + rep[i + 1])
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def py_sub(c: Column | str, pattern: str, rep: str, dotall: bool = False) -> Column:
    """``re.sub(pattern, rep, s)`` (every match) with Python regex semantics."""
    return F.regexp_replace(col_(c), java_regex(pattern, dotall), java_replacement(rep))


def py_sub_first(c: Column | str, pattern: str, rep: str) -> Column:
    """``re.sub(pattern, rep, s, count=1)``; ``pattern`` without back-references."""
    return F.regexp_replace(col_(c), "(?s)^(.*?)" + java_regex(pattern)[len("(?d)"):],
                            "$1" + java_replacement(rep))
