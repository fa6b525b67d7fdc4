"""Judge replies that are cut off or not quite JSON: every prefix of many shapes against a plain recursive parser."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.judge_text import parse_judgement
from tallyspark.operators import judgements as J

SHAPES = [
    '{"R": {"t": {"A_score": 3, "B_score": -1.5e+2, "winner": "A"}, "u": {"winner": "Tie"}}, "H": {"x": {"winner": "b"}}}',
    '{R: {t: {A_score: 0x1F, winner: \'B\'}, "u": {"winner": ""},},} // done',
    '{"R": {"t": {"winner": "A" "A_score": 1} "u": {"winner": "B"}} "H": {"x": {"winner": "a"}}}',
    '{"R": {"t": {"why": "says \\"A\\" {[,:]} \\\\", "winner": "a\\u0041\\n"}}, "text": "x", "n": [1, {"a": [2, 3,],}, "q"]}',
    '{"R": {"t": {"winner": ["A", {"k": null}], "x": 1}, "u": {"winner": []}, "v": {"winner": {}}, "w": {"winner": 0x00}}}',
    '[{"R": {"t": {"winner": "A"}}}, 1, [true]]',
    '{"R": {"t": {"winner": "A"}, "t": {"winner": "B"}, "u": "no"}, "S": 5, "R": {"z": {"winner": null}, "y": {"s": +1}}}',
    'I think A. ```json\n{"R": {"t": {"winner": "A"}}}\n``` and more ``` text',
    '```\n{"R": {"t": {/* a note */ "winner": "A" // b\n}}}\n```',
    '  \n{"overall": {"winner": "A"}, "R": {"t": {"winner": true}, "u": {"winner": false}, "v": {"winner": -0.0}}} trailing {"x": 1}',
    '{"R": {"t": {"winner": NaN}, "u": {"winner": 12.}, "v": {"winner": .5}}, "R2": [], "R3": {}, "R4": {"a": {}}}',
    '{"R": {"t": {"winner": tru, "u": 1}}}',
    '{"R": {"t": {"winner": "A"}}, , "H": {}}',
    '"just text, {not} an object"',
    "{'it\\'s': {\"ünï\": {winner: 'Ä\U0001f600'}}}",
]


# ---------------------------------------------------------------- plain parser: characters, recursion, exceptions

class End(Exception):
    """The text is over."""


class Odd(Exception):
    """Something that may not stand here."""


class Plain:
    def __init__(self, text):
        self.toks, i = [], 0
        while i < len(text):
            c = text[i]
            if c.isspace() or c == "﻿":
                i += 1
            elif text.startswith("//", i):
                while i < len(text) and text[i] not in "\r\n":
                    i += 1
            elif text.startswith("/*", i):
                at = text.find("*/", i + 2)
                i = len(text) if at < 0 else at + 2
            elif c in "{}[]:,":
                self.toks.append((c, c))
                i += 1
            elif c in "\"'":
                j = i + 1
                while j < len(text) and text[j] != c:
                    j += 2 if text[j] == "\\" else 1
                j = min(j, len(text))
                closed = j < len(text)
                inner = text[i + 1:j]
                if not closed and len(re.search(r"\\*$", inner).group()) % 2:
                    inner = inner[:-1]
                self.toks.append(("text", (self.unescaped(inner), text[i:j + closed])))
                i = j + closed
            elif c == "/":
                self.toks.append(("odd", c))
                i += 1
            else:
                j = i
                while j < len(text) and not text[j].isspace() and text[j] not in "{}[]:,\"'/﻿":
                    j += 1
                self.toks.append(("word", text[i:j]))
                i = j
        self.at = 0

    @staticmethod
    def unescaped(s):
        try:
            return re.sub(r"\\(u.{0,4}|.)", lambda m: json.loads('"' + m[0] + '"') if m[1][0] in 'nrtbfu"\\/' else m[1], s, flags=re.S)
        except ValueError:
            return s

    def next(self):
        if self.at == len(self.toks):
            raise End
        self.at += 1
        return self.toks[self.at - 1]

    def peek(self):
        return self.toks[self.at] if self.at < len(self.toks) else (None, None)

    def value(self, put):
        """Read a value; ``put`` is called with it as soon as it counts: containers when they open."""
        kind, v = self.next()
        if kind == "{":
            pairs = []
            put(("object", pairs, self.at - 1))
            self.object(pairs)
        elif kind == "[":
            items = []
            put(("list", items, self.at - 1))
            self.list(items)
        elif kind == "text":
            put(("text", v[0], None))
        elif kind == "word" and v in ("true", "false", "null", "NaN", "Infinity"):
            put(("word", v, None))
        elif kind == "word" and re.fullmatch(r"[+-]?(0[xX][0-9a-fA-F]+|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|Infinity|NaN)", v):
            put(("number", v, None))
        else:
            raise Odd

    def object(self, pairs):
        first = True
        while True:
            kind, v = self.next()
            if kind == "}":
                return
            if kind == "," and not first:
                kind, v = self.next()
                if kind == "}":
                    return
            if kind == "text":
                key = v[0]
            elif kind == "word" and re.fullmatch(r"[^\W\d][\w]*|\$\w*", v):
                key = v
            else:
                raise Odd
            if self.next()[0] != ":":
                raise Odd
            self.value(lambda x: pairs.append((key, x)))
            first = False

    def list(self, items):
        first = True
        while True:
            kind, _ = self.peek()
            if kind is None:
                raise End
            if kind == "]":
                self.at += 1
                return
            if kind == "," and not first:
                self.at += 1
                if self.peek()[0] == "]":
                    self.at += 1
                    return
            self.value(items.append)
            first = False

    def read(self):
        """The first value, as far as it goes; None if there is none or something odd has more behind it."""
        got = []
        try:
            self.value(got.append)
        except End:
            pass
        except Odd:
            if self.at < len(self.toks):
                return None
            self.toks.pop()
        return got[0] if got else None


def shown(p, v):
    """(state, text) of a winner."""
    kind, x, at = v
    if kind in ("object", "list"):
        depth, out = 0, []
        for k, t in p.toks[at:p.at]:
            out.append(t[1] if k == "text" else t)
            depth += (k in "{[") - (k in "}]") if len(k) == 1 else 0
            if depth == 0:
                break
        return ("end" if x or len(out) > 2 else "ok"), "".join(out)
    if kind == "text":
        return "ok", x
    if kind == "word":
        return ("ok" if x in ("null", "false") else "end"), None if x == "null" else x
    n = x.lstrip("+")
    h = re.fullmatch(r"(-?)0[xX](.*)", n)
    n = h[1] + str(int(h[2], 16)) if h else n
    return ("ok" if re.fullmatch(r"-?(0+\.?0*|\.0+)(e.*)?", n, re.I) else "end"), n


def last_of_each(pairs):
    return [(k, [v for n, v in pairs if n == k][-1]) for k in dict.fromkeys(k for k, _ in pairs)]


def plain(raw):
    """Categories of a reply as parse_judgement gives them, or None."""
    t = raw.strip()
    for pattern in (None, r"```json(.*)```", r"```(.*)```"):
        if pattern:
            m = re.search(pattern, t, re.S)
            body = m[1] if m else ""
        else:
            body = t
        p = Plain(body.strip(" \n\r\t`"))
        v = p.read()
        if v is None:
            continue
        out = []
        for c, (kind, pairs, _) in last_of_each(v[1]) if v[0] == "object" else []:
            entries = []
            for a, (k, inner, _) in last_of_each(pairs) if kind == "object" else []:
                winners = [x for n, x in inner if n == "winner"] if k == "object" else []
                state, text = shown(p, winners[-1]) if winners else ("skip" if k == "object" else "end", None)
                entries.append((a, state, k == "object", text))
            out.append((c, kind == "object", entries if kind == "object" else None))
        return out
    return None


def scanned(spark, raws, **options):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k long, raw string")
    rows = df.select("k", parse_judgement(F.col("raw"), **options).alias("p")).collect()
    return {r.k: None if r.p is None else [(c.category, c.is_object, None if c.entries is None else [tuple(e) for e in c.entries])
                                           for c in r.p] for r in rows}


def test_every_prefix_equals_the_plain_parser(spark):
    raws = [s[:n] for s in SHAPES for n in range(len(s) + 1)]
    got = scanned(spark, raws)
    wrong = [(r, got[k], plain(r)) for k, r in enumerate(raws) if got[k] != plain(r)]
    assert not wrong, wrong[:5]
    assert sum(v is not None for v in got.values()) > 800


def test_long_texts_and_many_escapes(spark):
    long = "x" * 200_000 + '\\"' * 20_000
    raws = [f'{{"R": {{"t": {{"why": "{long}", "winner": "A"}}}}}}', f'{{"R": {{"t": {{"winner": "A", "why": "{long}',
            '{"R": {' + ", ".join(f'"a{k}": {{"winner": "A"}}' for k in range(400)), "[" * 3000]
    got = scanned(spark, raws)
    assert got[0] == got[1] == [("R", True, [("t", "ok", True, "A")])]
    assert len(got[2][0][2]) == 400 and got[3] == []


@pytest.mark.parametrize("raw", ['{"R": {"t": {"winner": "A"}}', '{"R": {"t": {"winner": "A" "x": 1}}}', '{"R": {"t": {"winner": tru'])
def test_strict_takes_whole_replies_only(spark, raw):
    assert scanned(spark, [raw], lenient=False)[0] is None
    assert scanned(spark, [raw])[0] is not None
    assert scanned(spark, ['{"R": {"t": {"winner": "A"},},}'], lenient=False)[0] == [("R", True, [("t", "ok", True, "A")])]


def test_open_fence_is_an_option(spark):
    raw = 'Reasons.\n```json\n{"R": {"t": {"winner": "A"}, "u": {"win'
    assert scanned(spark, [raw])[0] is None
    assert scanned(spark, [raw], open_fence=True)[0] == [("R", True, [("t", "ok", True, "A"), ("u", "skip", True, None)])]


def test_battles_of_a_cut_reply(spark):
    raw = '{"R": {"t": {"winner": "A"}, "u": {"winner": "B"}}, "H": {"x": {"winner": "a'
    df = spark.createDataFrame([(1, "s1", "s2", raw)], "battle_id long, model_a string, model_b string, raw string")
    parsed = J.parse_judgements(df)
    assert [(r.category, r.aspect, r.winner) for r in J.explode_battles(parsed).collect()] == \
        [("R", "t", "model_a"), ("R", "u", "model_b"), ("H", "x", "model_a")]
    assert [(r.entry_pos, r.winner_raw) for r in J.online_battles(parsed).collect()] == [(0, "A"), (1, "B"), (2, "a")]
    plan = parsed._sc._jvm.PythonSQLUtils.explainString(J.explode_battles(parsed)._jdf.queryExecution(), "formatted")
    assert "from_json(raw" not in plan.lower() and "EvalPython" not in plan
