"""Judge-reply parsing (lenient JSON, fences) and winner normalisation."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.judge_text import normalise_winner, parse_judgement
from tallyspark.operators import judgements as J


def parse(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    p = df.select(parse_judgement(F.col("raw")).alias("p")).first()["p"]
    return p and {c.category: {e.aspect: {"winner": e.winner} for e in c.entries} for c in p}


@pytest.mark.parametrize("raw", [
    '{"R": {"t": {"winner": "A"}}}',
    '  \n{"R": {"t": {"winner": "A"}}}\n ',
    'Thinking...\n```json\n{"R": {"t": {"winner": "A"}}}\n```\nbye',
    'x ```\n{"R": {"t": {"winner": "A"}}}\n``` y',
    '```json\n{"R": {"t": {"winner": "A",},},}\n```',          # trailing commas
    "```json\n{R: {'t': {winner: 'A'}}} // note\n```",          # unquoted keys, single quotes, comment
])
def test_parse_variants(spark, raw):
    assert parse(spark, raw) == {"R": {"t": {"winner": "A"}}}


def test_unparseable_is_null(spark):
    assert parse(spark, "no json here") is None
    assert parse(spark, '```json\n{"R": {"t": {"winner": "A"}') is None        # the fence is not closed
    assert parse(spark, '{"R": {"t" {"winner": "A"}}}') is None                # odd in the middle


def test_cut_off_replies_count_as_far_as_they_go(spark):
    assert parse(spark, '```json\n{"R": {"t": {"winner": "A"}\n```') == {"R": {"t": {"winner": "A"}}}


def test_duplicate_key_last_wins(spark):
    assert parse(spark, '{"R": {"t": {"winner": "A"}, "t": {"winner": "B"}}}') == {"R": {"t": {"winner": "B"}}}


@pytest.mark.parametrize("w,exp", [(None, "tie"), ("", "tie"), ("A", "model_a"), ("a", "model_a"), ("b", "model_b"),
                                   ("Tie", "tie"), ("both", "tie")])
def test_winner(spark, w, exp):
    df = spark.createDataFrame([(w,)], "w string")
    assert df.select(normalise_winner(F.col("w"))).first()[0] == exp


def battles(spark, raw, fn=J.explode_battles):
    df = spark.createDataFrame([(1, "s1", "s2", raw)], "battle_id long, model_a string, model_b string, raw string")
    return [(r.category, r.aspect, r.winner_raw) for r in fn(J.parse_judgements(df)).collect()]


def test_odd_values_end_only_their_category(spark):
    raw = ('{"R": {"t1": {"winner": "A"}, "t2": "oops", "t3": {"winner": "B"}}, "summary": "A is better", '
           '"overall": {"winner": "A"}, "H": {"x": {"winner": 3}, "y": {"winner": "B"}}, '
           '"Z": {"n": {"winner": null}, "o": {"s": 1}, "z": {"winner": 0}, "l": {"winner": ["A"]}, "m": {"winner": "b"}}}')
    assert battles(spark, raw) == [("R", "t1", "A"), ("Z", "n", None), ("Z", "z", "0")]


def test_online_list_ends_the_reply(spark):
    raw = '{"R": {"t1": {"winner": "A"}}, "H": {"x": {"winner": 3}, "y": "oops"}, "Z": {"n": {"winner": "B"}}}'
    assert battles(spark, raw, J.online_battles) == [("R", "t1", "A"), ("H", "x", "3")]
    raw = '{"R": {"t1": {"winner": "A"}, "t2": {"score": 1}}, "Z": {"n": {"winner": "B"}}}'
    assert battles(spark, raw, J.online_battles) == [("R", "t1", "A")]
    assert battles(spark, '{"R": {"t1": {"winner": "A"}}, "s": "x", "Z": {"n": {"winner": "B"}}}', J.online_battles) == \
        [("R", "t1", "A")]


def test_plus_signs_and_key_order(spark):
    assert battles(spark, '{"z": {"b": {"A_score": +1, "winner": "A"}, "a": {"winner": "B"}}, "c": {"d": {"winner": "a"}}}') == \
        [("z", "b", "A"), ("z", "a", "B"), ("c", "d", "a")]


def test_a_text_that_looks_like_an_object_is_none(spark):
    assert battles(spark, '{"R": "{\\"t\\": {\\"winner\\": \\"A\\"}}", "H": {"x": {"winner": "b"}}}') == [("H", "x", "b")]


def test_parse_states(spark):
    raws = ['{"R": {}}', "[1]", "{}", "no", '{"R" {"t": {"winner": "A"}', '"text"', "```\n{'R': {'t': {winner: 'A'}}}\n```"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "battle_id long, raw string")
    got = [r.parse_state for r in J.parse_state(J.parse_judgements(df)).orderBy("battle_id").collect()]
    assert got == ["parsed", "no_object", "no_object", "rejected", "rejected", "no_object", "parsed"]


def test_explode_skips_entries_without_winner(spark):
    raw = '{"R": {"t1": {"winner": "a"}, "t2": {"A_score": 1}, "t3": {"winner": null}}, "H": {}}'
    df = spark.createDataFrame([(1, "s1", "s2", raw), (2, "s1", "s2", "garbage")],
                               "battle_id long, model_a string, model_b string, raw string")
    parsed = J.parse_judgements(df)
    got = sorted((r.aspect, r.winner) for r in J.explode_battles(parsed).collect())
    assert got == [("t1", "model_a"), ("t3", "tie")]
    assert J.rejected(parsed).count() == 1


def test_online_battles_cut_at_missing_winner(spark):
    raw = '{"R": {"t1": {"winner": "a"}, "t2": {"x": 1}, "t3": {"winner": "b"}}, "H": {"t4": {"winner": "B"}}}'
    df = spark.createDataFrame([(1, "p", "q", raw)], "battle_id long, model_a string, model_b string, raw string")
    got = [(r.entry_pos, r.aspect, r.winner_raw) for r in J.online_battles(J.parse_judgements(df)).collect()]
    assert got == [(0, "t1", "a")]
