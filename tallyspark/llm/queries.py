"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import let
from ..session import scratch_path
from ..sources.tables import read_table
from . import common

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return deco


@register("op4_token_counts")
def op4(spark, sf_dir):
    """Tokens of every document by the 32k piece model, through a digest cache that an earlier run over one part of the documents
    has begun; ``cached``: whether a count came from there."""
    from .token_counts import count_tokens
    # the length is taken before the join, so that texts stay where they are and only their digests meet the counts
    docs = common.documents(spark, sf_dir).select(
        "doc_id", "text", F.octet_length(common.text_or_empty()).cast("long").alias("n_bytes"))
    cache = scratch_path(spark, "token-count-cache")
    earlier = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0  # what the earlier run met; all documents are counted below
    count_tokens(docs.filter(earlier), "piece_bpe_32k.model", cache=cache)
    return count_tokens(docs, "piece_bpe_32k.model", cache=cache, known="cached").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "cached")


_CONTROL = r"<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE\]|\[AS\]|\[/ROLE\]"
_CHAT_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, len(regexp_extract_all(text, '{_CONTROL}')) controls,
             length(text) - length(replace(text, chr(92), '')) slashes, regexp_matches(text, '(?s)\\\\.') pairs from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::BIGINT loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) loss_sha256,
       (3 + sum(case role when 'assistant' then 5 else 15 end + length(text)
                + case when controls > 0 or pairs then controls + slashes else 0 end))::BIGINT formatted_chars
from e group by conv_id"""


@register("op9_chat_format", sql=_CHAT_SQL)
def op9(spark, sf_dir):
    """Every conversation, formatted and read back, with one whose texts hold control strings."""
    from .chat_format import format_conversations, read_back
    hard = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                 "conv_id long, turn int, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return read_back(format_conversations(rows))


_WARC_SQL = """
with p as (select page_id, coalesce(html, '') payload, strlen(coalesce(html, '')) n from pages),
k as (select *, max(page_id) over (partition by payload) keeper from p)
select page_id, n payload_bytes, sha1(payload) payload_digest,
       case when n >= 1000 and page_id <> keeper then 'revisit' else 'response' end record_type,
       case when n >= 1000 and page_id <> keeper then keeper end refers_to
from k"""


@register("op8_warc", sql=_WARC_SQL)
def op8(spark, sf_dir):
    """Every page written to Zstandard WARC archives and read back from them."""
    from .warc import read_archives, write_archives
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = read_archives(write_archives(pages))
    return back.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LEAKS_SQL = f"""
with d as (select doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from documents),
i as (select item_id::VARCHAR item, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} w from benchmark),
iw as (select distinct item, least(len(w), 10) k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') win
       from i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) where len(w) > 0),
sizes as (select distinct k from iw),
dw as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') win
       from d, sizes, unnest(range(1, len(w) - k + 2)) t(p) where len(w) >= k),
h as (select dw.doc_id, dw.p, dw.k, iw.item from dw join iw using (k, win)),
n as (select doc_id, count(distinct q) n_hit from h, unnest(range(p, p + k)) t(q) group by doc_id),
m as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from h group by doc_id)
select d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, n_hit is not null contaminated
from d left join n using (doc_id) left join m using (doc_id)"""


@register("op7_decontaminate", sql=_LEAKS_SQL)
def op7(spark, sf_dir):
    """Every document scanned for 10-word windows of every benchmark item."""
    from .decontaminate import find_contamination
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["word_end"] - x["word_start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


@register("op2_packing")
def op2(spark, sf_dir):
    """Every document packed into sequences of at most 2048 tokens."""
    from .packing import pack
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return pack(docs, "byte_bpe_50k.json", keep=["doc_id"], derive={"ids_crc32": F.crc32("ids")})


@register("op10_quality")
def op10(spark, sf_dir):
    """Base rules on every document, and robust outliers per language and source among those that pass."""
    from .quality import quality
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op6_toxicity")
def op6(spark, sf_dir):
    """Every document scored by compression with dictionaries learnt from the labelled rows that are not held out."""
    from .toxicity import score, train
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.filter(third != 1), labels.filter(third != 1))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id", (F.coalesce(third, F.lit(-1)) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op5_jaccard_join")
def op5(spark, sf_dir):
    """Every document with the component of documents whose 3-word shingle sets have a Jaccard similarity of 0.9."""
    from .jaccard_join import similar_groups
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return similar_groups(docs, keep=["doc_id"])


@register("op3_repeats")
def op3(spark, sf_dir):
    """Every document without the bytes of 400-byte strings that occur elsewhere too."""
    from .repeats import repeated_spans
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = repeated_spans(docs, keep=["doc_id"])
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        "kept_sha256")


@register("op1_suffix_lm")
def op1(spark, sf_dir):
    """Every document scored by a suffix tree learnt from the nine tenths that are not held out."""
    from .suffix_lm import score
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    tenth = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    return score(docs, tenth != 0).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                                          "train_tokens", "base_score", "score")


@register("op12_suffix_groups")
def op12(spark, sf_dir):
    """Every document without the words that a 20-word window covers which also starts earlier."""
    from .suffix_groups import remove_repeated_windows
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _periodic_tail(key: str, text: str):
    """``text``, in which a tenth of the documents repeat a stretch of words up to their end (none where the key is null)."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        return let(F.struct(w.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            v["w"], lambda x, i: F.when(i < v["a"], x).otherwise(F.get(v["w"], (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))

    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col(text))


@register("op11_periodic_runs")
def op11(spark, sf_dir):
    """Every document's periodic runs of words, and its text without their repetitions."""
    from .periodic_runs import find_runs
    docs = common.documents(spark, sf_dir).select("doc_id", _periodic_tail("doc_id", "text").alias("text"))
    found = find_runs(docs, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    first = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = found.withColumn("r", F.when(F.size("runs") > 0, first))
    length = -F.col("r.order")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("r.start").alias("start"), length.alias("length"),
        F.col("r.period").alias("period"), F.expr("1000 * -r.order div r.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))), 256)
        .alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op13_whitening")
def op13(spark, sf_dir):
    """Every whole embedding, whitened along the first eight components."""
    from .whitening import whiten
    out = whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained",
                      "identity_error")
