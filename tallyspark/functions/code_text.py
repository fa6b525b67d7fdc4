"""Column functions over source text, build logs and prompts.

All are built-in expressions; templates are caller input and are split on the
driver into literal parts, so rendering is one ``concat`` per row.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, java_regex, let, py_strip, py_sub

# ---------------------------------------------------------------------------
# Fixed values (patterns and literals that must equal the reference's)
LINE_DIRECTIVE = r"^# \d+ "
VISIBILITY_HIDDEN = '__attribute__((visibility("hidden")))'
VISIBILITY_DEFAULT = '__attribute__((visibility("default")))'
VISIBILITY_HIDDEN_SHORT = '__visibility__("hidden")'
VISIBILITY_DEFAULT_SHORT = '__visibility__("default")'
UNDEF_LINE = r"#undef\s.*"
EXTERN_LINE = r"^extern\s+"
EXTERN_WORD = "extern"
WARNING_FLAG = r"\[-W(.*)\]"
NO_WARNING_PREFIX = "-Wno-"
REFINED_FENCE = r"```refined\n(.*?)\n```"          # searched with DOTALL
OUTPUT_FLAG = "-o"
# Python str.splitlines() boundaries
PY_LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def py_splitlines(c: Column | str) -> Column:
    """Python ``str.splitlines()``: no trailing empty line, empty text -> []."""
    x = col_(c)
    parts = F.split(x, PY_LINE_BREAKS, -1)
    ends_with_break = x.rlike(f"(?:{PY_LINE_BREAKS})$")
    trimmed = F.when(ends_with_break, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(trimmed)


# B8 ------------------------------------------------------------------------
def symbol_address(line: Column | str, name: Column | str) -> Column:
    """``"<hex> T name"`` -> int address when the line ends with ``" name"``."""
    ln, nm = col_(line), col_(name)
    hexpart = F.split_part(ln, F.lit(" "), F.lit(1))
    val = F.conv(hexpart, 16, 10).try_cast("bigint")
    return F.when(ln.endswith(F.concat(F.lit(" "), nm)) & hexpart.rlike("^[0-9a-fA-F]+$"), val)


# B9 ------------------------------------------------------------------------
def address_hex(addr: Column | str) -> Column:
    """Python ``hex(addr)`` for a non-negative address."""
    return F.concat(F.lit("0x"), F.lower(F.hex(col_(addr))))


# B10 -----------------------------------------------------------------------
def clean_preprocessed(text: Column | str) -> Column:
    """Drop ``# <n> `` line markers, then make hidden visibility default."""
    directive = java_regex(LINE_DIRECTIVE)
    kept = F.filter(py_splitlines(text), lambda x: ~x.rlike(directive))
    joined = F.array_join(kept, "\n")
    return F.replace(joined, F.lit(VISIBILITY_HIDDEN), F.lit(VISIBILITY_DEFAULT))


def default_visibility(text: Column | str) -> Column:
    """B10 (output file): the short attribute form, every occurrence."""
    return F.replace(col_(text), F.lit(VISIBILITY_HIDDEN_SHORT), F.lit(VISIBILITY_DEFAULT_SHORT))


# B11 -----------------------------------------------------------------------
def clean_arguments(args: Column | str) -> Column:
    """Drop the compiler (first element), then the first ``-o`` and its operand."""
    a = F.slice(col_(args), 2, 1 << 30)

    def cut(arr: Column) -> Column:
        i = F.array_position(arr, OUTPUT_FLAG).cast("int")
        return F.when(i > 0, F.concat(F.slice(arr, 1, i - 1), F.slice(arr, i + 2, 1 << 30))).otherwise(arr)

    return let(a, cut)


def flag_arguments(args: Column | str) -> Column:
    """Only the flags (arguments starting with ``-``)."""
    return F.filter(col_(args), lambda x: x.startswith("-"))


# B12 -----------------------------------------------------------------------
def span_text(text: Column | str, sl: Column | str, sc: Column | str, el: Column | str,
              ec: Column | str) -> Column:
    """Text of a (line, column) span; zero-width -> null.

    One line: bytes ``[sc-1, ec)`` of that line. Several lines: the whole
    lines ``sl..el``, each followed by ``\\n`` (the reference's column
    branches never fire).
    """
    t, a, b, c, d = (col_(x) for x in (text, sl, sc, el, ec))
    lines_b = F.split(t, "\r\n|\n|\r", -1)

    def one(ls: Column) -> Column:
        line = F.get(ls, a - 1)
        raw = F.substring(F.encode(line, "UTF-8"), b, d - b + 1).cast("string")
        # a cut through a multi-byte character does not decode: null
        return F.when(F.is_valid_utf8(raw), raw)

    def many(ls: Column) -> Column:
        part = F.slice(ls, a, c - a + 1)
        return F.concat(F.array_join(part, "\n"), F.lit("\n"))

    return (F.when((a == c) & (b == d), F.lit(None).cast("string"))
            .when(a == c, let(lines_b, one))
            .otherwise(let(lines_b, many)))


# B13 -----------------------------------------------------------------------
def remove_first(text: Column, piece: Column) -> Column:
    """Literal ``str.replace(piece, '', 1)``."""
    pos = F.instr(text, piece)
    return F.when((pos > 0) & (F.length(piece) > 0),
                  F.concat(F.substring(text, 1, pos - 1),
                           F.substring(text, pos + F.length(piece), 1 << 30))).otherwise(text)


def split_prelude(content: Column | str, declarations: Column | str, body: Column | str) -> Column:
    """Remove each declaration body once (in order), locate the body, and
    return the prelude = text before + text after (``#undef`` lines blanked in
    the tail only)."""
    c = F.aggregate(col_(declarations), col_(content), lambda acc, d: remove_first(acc, d))

    def split(txt: Column) -> Column:
        pos = F.instr(txt, col_(body))
        head = F.substring(txt, 1, pos - 1)
        tail = F.substring(txt, pos + F.length(col_(body)), 1 << 30)
        return F.when(pos > 0, F.concat(head, py_sub(tail, UNDEF_LINE, "")))

    return let(c, split)


# B14 -----------------------------------------------------------------------
def refined_code(output: Column | str) -> Column:
    """First ```refined block (lazy, DOTALL) stripped, else the whole output; stripped."""
    o = col_(output)
    fence = java_regex(REFINED_FENCE, dotall=True)
    inner = F.regexp_extract(o, fence, 1)
    return py_strip(F.when(o.rlike(fence), py_strip(inner)).otherwise(o))


# B15 / B16 -------------------------------------------------------------------
def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """``template.format(**values)`` as one ``concat`` (``{{``/``}}`` are literal braces)."""
    parts = []
    for lit_text, field, spec, conv in string.Formatter().parse(template):
        if lit_text:
            parts.append(F.lit(lit_text))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported")
            parts.append(values[field].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def model_family(model: Column | str) -> Column:
    """``mlm`` / ``llm4decompile`` / ``general`` by case-insensitive substring."""
    m = F.lower(col_(model))
    return (F.when(m.contains("mlm"), F.lit("mlm"))
            .when(m.contains("llm4decompile"), F.lit("llm4decompile"))
            .otherwise(F.lit("general")))


def render_refine_prompt(model: Column | str, code: Column | str, completion_template: str,
                         system_prompt: str, user_template: str) -> Column:
    """struct(kind, system, prompt) for one request; the caller's templates hold ``{code}``.

    ``mlm`` requests fail in the reference (the request is built under a key
    the caller never reads), so their kind is ``error`` and they store ERROR.
    ``llm4decompile`` is a completion over the stripped code; the rest chat.
    """
    fam = model_family(model)
    c = col_(code)
    completion = render_template(completion_template, {"code": py_strip(c)})
    chat = render_template(user_template, {"code": c})
    kind = (F.when(fam == "mlm", F.lit("error")).when(fam == "llm4decompile", F.lit("completion"))
            .otherwise(F.lit("chat")))
    return F.struct(kind.alias("kind"),
                    F.when(fam == "general", F.lit(system_prompt)).alias("system"),
                    F.when(fam == "llm4decompile", completion).when(fam == "general", chat).alias("prompt"))


# B18 -----------------------------------------------------------------------
def strip_extern(source: Column | str) -> Column:
    """On lines starting with ``extern<space>``, remove every ``extern``."""
    ext = java_regex(EXTERN_LINE)
    return F.array_join(F.transform(F.split(col_(source), "\n", -1),
                                    lambda x: F.when(x.rlike(ext), F.replace(x, F.lit(EXTERN_WORD), F.lit("")))
                                    .otherwise(x)), "\n")


# B19 / B20 -------------------------------------------------------------------
def warnings(stderr: Column | str) -> Column:
    """Every ``[-W...]`` (greedy within a line, as the reference)."""
    return F.regexp_extract_all(col_(stderr), F.lit(java_regex(WARNING_FLAG)), 1)


def suppress_flags(warns: Column | str) -> Column:
    """``-Wno-<w>`` for each warning of the failed first attempt."""
    return F.transform(col_(warns), lambda w: F.concat(F.lit(NO_WARNING_PREFIX), w))


# B21 -----------------------------------------------------------------------
def compile_unit(prelude: Column | str, code: Column | str, item: Column | str, header: str,
                 trailer_template: str) -> Column:
    """Header + prelude + newline + cleaned code + trailer rendered with ``{function}``."""
    return F.concat(F.lit(header), col_(prelude), F.lit("\n"), col_(code),
                    render_template(trailer_template, {"function": col_(item)}))


# B22 -----------------------------------------------------------------------
def encode_payload(data: Column | str) -> Column:
    """base64 text of a binary payload, one line (no MIME line breaks)."""
    return F.replace(F.base64(col_(data)), F.lit("\r\n"), F.lit(""))


def decode_payload(text: Column | str) -> Column:
    return F.unbase64(col_(text))
