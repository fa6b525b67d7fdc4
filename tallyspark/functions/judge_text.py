"""Column functions for judge replies: lenient JSON read in one pass, also where it is cut off, and winner normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_SPACE, java_regex, let, py_strip

#: categories of a reply in its order: whether it is an object, and its entries in order. An entry's ``state`` is
#: 'ok', 'skip' (an object without a winner) or 'end' (no object, or a winner that is neither text nor empty).
PARSED_TYPE = ("array<struct<category: string, is_object: boolean, entries: array<struct<aspect: string, state: string, "
               "is_object: boolean, winner: string>>>>")

JSON5_OPTIONS = {
    "allowComments": "true",
    "allowUnquotedFieldNames": "true",
    "allowSingleQuotes": "true",
    "allowNonNumericNumbers": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "allowUnquotedControlChars": "true",
    "mode": "PERMISSIVE",
}

# Fixed values that must match the judge-output conventions:
# fenced block markers tried in order, the characters stripped around a JSON
# body before it is parsed, and the winner spellings.
FENCE_JSON = r"```json(.*)```"        # searched with DOTALL
FENCE_ANY = r"```(.*)```"
OPEN_FENCE = r"```(?:json)?([^`]*)\z"  # a fence that the reply does not close
JSON_EDGE_CHARS = " \n\r\t`"
WINNER_A = "a"
WINNER_B = "b"

# Tokens of a reply: texts in either quotes (the end of the reply closes them), comments, structural characters, words. The
# quantifiers are possessive, so a long text needs no stack.
_SPACE = PY_SPACE + "\\ufeff"
TOKEN = (r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)' r"|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)" r"|/\*.*?(?:\*/|\z)|//[^\n\r]*+"
         r"|[{}\[\]:,]|[^" + _SPACE + r"""{}\[\]:,"'/]++|/""")
NUMBER = r"^[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)$"
ZERO = r"^[+-]?(?:0[xX]0+|(?:0+\.?0*|\.0+)(?:[eE][+-]?\d+)?)$"
NAME = r"^[$_\p{L}\p{Nl}][$_\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}\x{200c}\x{200d}]*$"
#: what a reply that holds JSON can begin with; others are not scanned
BEGIN = r"""^(?:[{\["'/+\-.0-9]|true|false|null|Infinity|NaN)"""


def _text_of(token: Column) -> Column:
    """What a quoted text says (an unclosed one: as far as it goes), and any other token as it is."""
    quote = F.left(token, F.lit(1))
    quoted = quote.isin('"', "'")
    plain = F.substring(token, F.lit(2), F.length(token) - F.when((F.length(token) > 1) & (F.right(token, F.lit(1)) == quote), 2).otherwise(1))
    # with escapes the last quote may be one of them
    closed = token.rlike(r'''(?s)^(?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')$''')
    whole = F.when(closed, token).otherwise(F.concat(F.regexp_replace(token, r"(?s)((?:[^\\]|\\.)*+)\\\z", "$1"), quote))
    escaped = let(whole, lambda w: F.coalesce(
        F.get(F.from_json(F.concat(F.lit("["), w, F.lit("]")), "array<string>", JSON5_OPTIONS), 0), F.substring(w, F.lit(2), F.length(w) - 2)))
    return F.when(~quoted, token).when(token.contains("\\"), escaped).otherwise(plain)


def _number_text(token: Column) -> Column:
    """A number in decimal digits, without a plus sign."""
    t = F.ltrim(token, F.lit("+"))
    return F.when(t.rlike("^-?0[xX]"), F.concat(F.when(t.startswith("-"), "-").otherwise(""), F.conv(F.regexp_extract(t, "0[xX](.*)", 1), 16, 10))
                  ).otherwise(t)


def _tokens(body: Column) -> Column:
    """``kind, text`` of the tokens: a structural character itself, (s)tring, (n)umber, (l)iteral, (i)dentifier or (?)."""
    def kind(t):
        c = F.left(t, F.lit(1))
        word = (F.when(t.isin("true", "false", "null", "NaN", "Infinity"), "l").when(t.rlike(NUMBER), "n")
                .when(t.rlike(NAME), "i").otherwise("?"))
        return F.when(c.isin('"', "'"), "s").when(c.isin("{", "}", "[", "]", ":", ","), c).otherwise(word)

    found = F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*"))
    return F.transform(found, lambda t: F.struct(kind(t).alias("k"), t.alias("v")))


_HOLDER = "the reply"
_WHOLE = f"struct<`{_HOLDER}`: map<string, map<string, struct<winner: variant>>>, _odd: string>"
_RECORD = "array<struct<q:int,c:string,o:boolean,a:string,e:boolean,w:string,t:string>>"


def _scan(body: Column, lenient: bool) -> Column:
    """One fold over the tokens of ``body`` with a stack of open brackets: the records of categories and entries.

    ``st`` says what may follow: (V)alue, (K)ey or end of object, (C)olon, (E)nd of a value, (A) value or end of array,
    (D)one; '?' something else came last, and 'X' more followed it. ``stk`` holds the open brackets.
    """
    def lit_null(kind="string"):
        return F.lit(None).cast(kind)

    start = F.struct(F.lit("V").alias("st"), F.lit("").alias("stk"), F.lit(0).alias("q"), lit_null().alias("c"), lit_null().alias("a"),
                     F.lit(False).alias("kw"), F.lit("skip").alias("w"), lit_null().alias("t"), F.lit(False).alias("iw"),
                     F.lit(False).alias("odd"), F.array().cast(_RECORD).alias("out"))

    def record(q, c, o, a, e, w, t):
        return F.struct(q.alias("q"), c.alias("c"), o.alias("o"), a.alias("a"), e.alias("e"), w.alias("w"), t.alias("t"))

    def step(s, x):
        k, st, stk = x["k"], s["st"], s["stk"]
        top, depth = F.right(stk, F.lit(1)), F.length(stk)
        here = st.isin("V", "A") | ((st == "E") & (top == "["))
        act = (F.when(st.isin("D", "X"), "stay").when(st == "?", "fail")
               .when(here & k.isin("s", "n", "l"), "scalar").when(here & k.isin("{", "["), "open")
               .when(st.isin("K", "E") & (top == "{") & k.isin("s", "i", "l"), "key")
               .when((st == "C") & (k == ":"), "colon").when((st == "E") & (k == ","), "comma")
               .when((st.isin("K", "E") & (top == "{") & (k == "}")) | (st.isin("A", "E") & (top == "[") & (k == "]")), "close")
               .otherwise("odd"))
        return let(F.struct(act.alias("act"), top.alias("top"), depth.alias("d")), lambda y: moved(s, x, y["act"], y["top"], y["d"]))

    def moved(s, x, act, top, depth):
        k, v, stk = x["k"], x["v"], s["stk"]
        value, opens, closes, key = act.isin("scalar", "open"), act == "open", act == "close", act == "key"
        entry_opens = opens & (k == "{") & (stk == "{{")
        winner = value & s["kw"] & (stk == "{{{")
        scalar_state = F.when((k == "s") | v.isin("null", "false") | ((k == "n") & v.rlike(ZERO)), "ok").otherwise("end")
        scalar_text = F.when(k == "s", _text_of(v)).when(k == "n", _number_text(v)).when(v != "null", v)
        w = (F.when(entry_opens, "skip").when(winner & opens, "open").when(winner, scalar_state)
             .when(s["iw"] & (s["w"] == "open"), F.when(closes & (depth == 4), "ok").otherwise("end")).otherwise(s["w"]))
        t = (F.when(entry_opens, lit_null()).when(winner & opens, k).when(winner, scalar_text)
             .when(s["iw"] & ~act.isin("odd", "fail"), F.concat(s["t"], v)).otherwise(s["t"]))
        category = value & (stk == "{")
        q = s["q"] + F.when(category, 1).otherwise(0)
        new = (F.when(category, record(q, s["c"], opens & (k == "{"), lit_null(), lit_null("boolean"), lit_null(), lit_null()))
               .when(value & (stk == "{{") & ~entry_opens, record(q, s["c"], F.lit(True), s["a"], F.lit(False), F.lit("end"), lit_null()))
               .when(closes & (stk == "{{{"), record(q, s["c"], F.lit(True), s["a"], F.lit(True), s["w"], s["t"])))
        emits = category | (value & (stk == "{{") & ~entry_opens) | (closes & (stk == "{{{"))
        return F.struct(
            F.when(act == "stay", s["st"]).when(act == "fail", "X").when(act == "odd", "?").when(key, "C").when(act == "colon", "V")
            .when(opens, F.when(k == "{", "K").otherwise("A")).when(act == "comma", F.when(top == "{", "K").otherwise("A"))
            .when(act == "scalar", F.when(depth == 0, "D").otherwise("E")).otherwise(F.when(depth == 1, "D").otherwise("E")).alias("st"),
            F.when(opens, F.concat(stk, k)).when(closes, F.left(stk, depth - 1)).otherwise(stk).alias("stk"),
            q.alias("q"),
            F.when(key & (stk == "{"), _text_of(v)).otherwise(s["c"]).alias("c"),
            F.when(key & (stk == "{{"), _text_of(v)).otherwise(s["a"]).alias("a"),
            F.when(key & (stk == "{{{"), _text_of(v) == "winner").otherwise(s["kw"]).alias("kw"),
            w.alias("w"), t.alias("t"),
            F.when(winner & opens, True).when(closes & (depth == 4), False).otherwise(s["iw"]).alias("iw"),
            (s["odd"] | ((key | value) & (s["st"] == "E"))).alias("odd"),
            F.when(emits, F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"))

    def finish(s):
        left_open = s["stk"].startswith("{{{")
        w = F.when(s["iw"] & (s["w"] == "open"), "ok").otherwise(s["w"])
        out = F.when(left_open, F.concat(s["out"], F.array(record(s["q"], s["c"], F.lit(True), s["a"], F.lit(True), w, s["t"])))
                     ).otherwise(s["out"])
        bad = (s["st"] == "X") | ((s["stk"] == "") & (s["st"] != "D"))
        if not lenient:
            bad = bad | (s["st"] != "D") | s["odd"]
        return F.when(~bad, out)

    return F.aggregate(_tokens(body), start, step, finish)


def _last_of_each(items: Column, name: str, build) -> Column:
    """``build`` of the last item of every name, in the order in which the names come first."""
    names = F.array_distinct(F.transform(items, lambda r: r[name]))
    return let(names, lambda ns: F.when(F.size(ns) == F.size(items), F.transform(items, build)).otherwise(
        F.transform(ns, lambda n: build(F.element_at(F.filter(items, lambda r: r[name].eqNullSafe(n)), -1)))))


def _grouped(records: Column) -> Column:
    """Records of a scan as categories with their entries; the last value of a repeated key counts, where it came first."""
    def entry(r):
        return F.struct(r["a"].alias("aspect"), r["w"].alias("state"), r["e"].alias("is_object"), r["t"].alias("winner"))

    def category(all_, m):
        own = F.filter(all_, lambda r: (r["q"] == m["q"]) & r["a"].isNotNull())
        return F.struct(m["c"].alias("category"), m["o"].alias("is_object"),
                        F.when(m["o"], let(own, lambda rs: _last_of_each(rs, "a", entry))).alias("entries"))

    return let(records, lambda all_: F.when(all_.isNotNull(), let(
        F.filter(all_, lambda r: r["a"].isNull()), lambda ms: _last_of_each(ms, "c", lambda m: category(all_, m)))))


def _plain(body: Column) -> Column:
    """A whole and plain reply by the JSON reader: objects of objects whose winners are texts, null or missing, no key twice. Null
    for every other text, which is left to the scan (also one whose only fault is what follows the object)."""
    # inside a struct the reader reports whatever it could not read; the line end closes a last comment
    whole = F.from_json(F.concat(F.lit('{"' + _HOLDER + '":'), body, F.lit("\n}")), _WHOLE, {**JSON5_OPTIONS, "columnNameOfCorruptRecord": "_odd"})

    def distinct(m):
        return F.size(F.array_distinct(F.map_keys(m))) == F.size(m)

    def text_or_null(w):
        return F.coalesce(F.schema_of_variant(w).isin("STRING", "VOID"), F.lit(True))

    def entry(e):
        w = e["value"]["winner"]
        return F.struct(e["key"].alias("aspect"), F.when(e["value"].isNull(), "end").when(w.isNull(), "skip").otherwise("ok").alias("state"),
                        e["value"].isNotNull().alias("is_object"), F.try_variant_get(w, "$", "string").alias("winner"))

    def category(c):
        return F.struct(c["key"].alias("category"), c["value"].isNotNull().alias("is_object"),
                        F.when(c["value"].isNotNull(), F.transform(F.map_entries(c["value"]), entry)).alias("entries"))

    def read(r):
        m = r[_HOLDER]
        plain = r["_odd"].isNull() & distinct(m) & F.forall(F.map_values(m), lambda c: c.isNull() | (
            distinct(c) & F.forall(F.map_values(c), lambda e: text_or_null(e["winner"]))))
        return F.when(plain, F.transform(F.map_entries(m), category))

    return let(whole, read)


def parse_judgement(raw: Column, lenient: bool = True, open_fence: bool = False) -> Column:
    """Whole text as JSON, else the greedy ```json fence, else the greedy ``` fence.

    Whole and plain replies are read by Spark's JSON reader; all others once, token by token. JSON5 forms are taken (comments, either quotes, bare keys, signs, hexadecimal numbers,
    trailing commas); what follows the first whole value is not read. ``lenient``: a comma may be missing, and a reply that is
    cut off counts as far as it goes - texts and brackets are closed, a pair without its value is dropped, as is one odd
    word at the end; odd text with more behind it makes the reply unreadable. ``open_fence``: also takes a fence that is not closed
    (a reply cut off within its fence), which is otherwise rejected.

    Returns the categories and entries of :data:`PARSED_TYPE`; an empty list
    when the reply is JSON but no object, null when nothing parses. One odd
    value never loses the rest of a reply. Null gives null.
    """
    def read(body):
        return let(F.btrim(body, F.lit(JSON_EDGE_CHARS)), lambda b: F.when(
            b.rlike(BEGIN), F.coalesce(_plain(b), _grouped(_scan(b, lenient)).cast(PARSED_TYPE))))

    def cascade(t):
        fences = [FENCE_JSON, FENCE_ANY] + [OPEN_FENCE] * open_fence
        bodies = F.array(t, *[F.regexp_extract(t, java_regex(p, dotall=True), 1) for p in fences])
        # one fold, so that the readers stand in the plan once; the first body that is readable is the last one read
        return F.aggregate(bodies, F.lit(None).cast(PARSED_TYPE), lambda found, b: F.coalesce(found, read(b)).cast(PARSED_TYPE))

    return let(py_strip(raw), cascade)


def normalise_winner(w: Column) -> Column:
    """null/empty -> tie; 'a'/'b' in any case -> model_a/model_b; else tie."""
    lw = F.lower(w)
    return (F.when(w.isNull() | (w == ""), F.lit("tie"))
            .when(lw == WINNER_A, F.lit("model_a"))
            .when(lw == WINNER_B, F.lit("model_b"))
            .otherwise(F.lit("tie")))
