"""Registered ingest / text-utility queries: A1-A3, A7, A13, B1, B8-B16, B18-B22, G2, J2, J6, J7, P2-P4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code_text as CT
from ..operators import listings as L
from ..operators import status as STS
from ..session import scratch_path
from ..sources import ingest as I
from ..sources.merged_table import MergedTable
from ..sources.named_files import write_named_files
from ..sources.tables import read_table
from . import fixtures as fx, q_arena
from .registry import register


def _nl(*parts):
    out = []
    for k, p in enumerate(parts):
        if k:
            out.append(F.lit("\n"))
        out.append(p)
    return F.concat(*out)


# ---------------------------------------------------------------- A1 manifests
_LANGS = ["c", "c++", "python", None, "C", "rust"]


def _manifests(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("source").distinct()
    k = F.substring("source", 4, 3).cast("int") % len(_LANGS)
    lang = F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (k + 1).cast("int"))
    return d.select(F.col("source").alias("suite"), lang.alias("language"))


@register("a1_c_suites", sql="""
with m as (select distinct source suite,
             ['c', 'c++', 'python', null, 'C', 'rust'][cast(substring(source, 4, 3) as int) % 6 + 1] language
           from documents)
select suite, language from m where language in ('c', 'c++')""")
def a1_c_suites(spark, sf_dir):
    """Suites whose manifest language is c or c++ (missing language fails the gate)."""
    return I.c_suites(_manifests(spark, sf_dir))


@register("a1_manifest_scan", sql="""
with m as (select distinct source suite, cast(substring(source, 4, 3) as int) % 6 k from documents)
select suite, ['c', 'c++', 'c', 'c++', null, 'rust'][k + 1] language from m where k in (0, 1, 2, 3)""")
def a1_manifest_scan(spark, sf_dir):
    """Manifest files written as <suite>/project.yaml and scanned back; suites in c or c++ are kept."""
    d = read_table(spark, sf_dir, "documents").select(F.col("source").alias("suite")).distinct()
    texts = ['homepage: "x"\nlanguage: c\n', "language: \"c++\"  # main\nmain_repo: y\n", "language: c # old\nlanguages: python\n",
             "# language: rust\nlanguage:   'c++'\n", "homepage: z\nnested:\n  language: c\n", "language: rust\n"]
    k = F.substring("suite", 4, 3).cast("int") % len(texts)
    path = scratch_path(spark, "projects")
    write_named_files(d, path, F.concat("suite", F.lit("/project.yaml")), F.element_at(F.array(*[F.lit(t) for t in texts]), (k + 1).cast("int")))
    return I.c_suites(I.read_manifests(spark, path))


# ---------------------------------------------------------------- B1 / A2 coverage exports
_B1_SQL = f"""{fx.COVERAGE_EXPORT_SQL},
f as (select *, list_filter([f0, f1], lambda x: ends_with(x, '.c')) c from cx),
k as (select suite, probe, name, c[1] path, id from f
      where cnt >= 10 and len(c) > 0 and not contains(name, ':') and name <> 'LLVMFuzzerTestOneInput'
        and len(list_filter(c, lambda x: contains(x, probe))) = 0
        and len(list_filter(c, lambda x: contains(x, suite))) > 0),
cov as (select suite, probe, name, arg_max(path, id) path from k group by all)"""


@register("b1_covered_items", sql=f"with {_B1_SQL} select * from cov")
def b1_covered_items(spark, sf_dir):
    """Items each probe covers, with the first .c file (last entry per name wins)."""
    cx = fx.coverage_export(spark, sf_dir)
    fns = cx.select("suite", "probe", "name", F.array("f0", "f1").alias("filenames"),
                    F.col("cnt").cast("bigint").alias("count"), F.col("id").alias("pos"))
    return I.covered_items(fns)


@register("a2_coverage_report_scan", sql=f"with {_B1_SQL} select * from cov")
def a2_coverage_report_scan(spark, sf_dir):
    """Coverage exports written as nested JSON documents, one of at most 100 functions a line and many to a file, with
    their place in the document; scanned back, then B1."""
    path = scratch_path(spark, "coverage")
    cx = fx.coverage_export(spark, sf_dir).withColumn("chunk", F.floor(F.col("id") / 100).cast("bigint"))
    doc = (cx.groupBy("suite", "probe", "chunk")
           .agg(F.array_sort(F.collect_list(F.struct("id", "name", F.array("f0", "f1").alias("filenames"),
                                                       F.col("cnt").cast("bigint").alias("count")))).alias("fs")))
    doc = doc.select("suite", "probe", "chunk", F.to_json(F.struct(F.array(F.struct(F.transform(
        "fs", lambda x: F.struct(x["name"].alias("name"), x["filenames"].alias("filenames"),
                                 x["count"].alias("count"))).alias("functions"))).alias("data"))).alias("value"))
    doc.write.parquet(path)
    scanned = I.parse_coverage_reports(spark.read.parquet(path), ["suite", "probe", "chunk"])
    return I.covered_items(scanned.withColumn("pos", F.struct("chunk", "pos")))


@register("j6_extract_grid", sql=f"with {_B1_SQL} select suite, name, arg_min(path, probe) path, min(probe) probe "
                                 "from cov group by suite, name")
def j6_extract_grid(spark, sf_dir):
    """One extraction per (suite, item name) over all probes; lowest probe's path chosen."""
    return I.extract_grid(b1_covered_items(spark, sf_dir))


# ---------------------------------------------------------------- A3 / J2 compile commands
_CMDS_SQL = """cmds as (
  select concat('/src/suite', doc_id % 4, '/lib', doc_id % 3, '.c') file, concat('/work/', doc_id) directory,
         ['clang', '-O' || (doc_id % 3), '-o', 'out_' || doc_id || '.o', '-I/src/' || source,
          concat('/src/suite', doc_id % 4, '/lib', doc_id % 3, '.c')] arguments,
         doc_id // 50 grp, doc_id pos
  from documents)"""


def _commands(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    file = F.concat(F.lit("/src/suite"), (i % 4).cast("string"), F.lit("/lib"), (i % 3).cast("string"), F.lit(".c"))
    args = F.array(F.lit("clang"), F.concat(F.lit("-O"), (i % 3).cast("string")), F.lit("-o"),
                   F.concat(F.lit("out_"), i.cast("string"), F.lit(".o")), F.concat(F.lit("-I/src/"), F.col("source")),
                   file)
    return d.select(file.alias("file"), F.concat(F.lit("/work/"), i.cast("string")).alias("directory"),
                    args.alias("arguments"), F.floor(i / 50).cast("bigint").alias("grp"), i.alias("pos"))


@register("a3_compile_commands", sql=f"""
with {_CMDS_SQL}
select grp, file, arg_max(directory, pos) directory, arg_max(arguments, pos) arguments from cmds group by grp, file""")
def a3_compile_commands(spark, sf_dir):
    """Compile-command arrays of at most 50 entries, many to a file, scanned back;
    the last entry for a source file wins within its array."""
    path = scratch_path(spark, "commands")
    c = _commands(spark, sf_dir)
    arr = (c.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "file", "directory", "arguments")))
                                .alias("xs"))
           .select("grp", F.to_json(F.transform("xs", lambda x: F.struct(x["file"].alias("file"),
                                                                          x["directory"].alias("directory"),
                                                                          x["arguments"].alias("arguments"))))
                   .alias("value")))
    arr.write.parquet(path)  # many arrays to a file
    return I.last_commands(I.parse_compile_commands(spark.read.parquet(path), ["grp"]), ["grp"])


@register("j2_item_commands", sql=f"""
with {_B1_SQL}, {_CMDS_SQL},
last as (select file, arg_max(directory, pos) directory, arg_max(arguments, pos) arguments from cmds group by file)
select cov.suite, cov.probe, cov.name, cov.path, last.directory,
       list_filter(last.arguments[2:], lambda x: starts_with(x, '-')) flags
from cov join last on last.file = cov.path""")
def j2_item_commands(spark, sf_dir):
    """Covered items joined to their file's last compile command; flags of the cleaned arguments."""
    c = _commands(spark, sf_dir)
    last = c.groupBy("file").agg(F.max_by("directory", "pos").alias("directory"),
                                 F.max_by("arguments", "pos").alias("arguments"))
    matched, _missing = I.attach_commands(b1_covered_items(spark, sf_dir), last)
    return matched.select("suite", "probe", "name", "path", "directory",
                          CT.flag_arguments(F.slice("arguments", 2, 1 << 30)).alias("flags"))


@register("j2_items_without_command", sql=f"""
with {_B1_SQL}, {_CMDS_SQL}
select suite, probe, name, path from cov where path not in (select file from cmds)""")
def j2_items_without_command(spark, sf_dir):
    """Report of covered items whose file has no compile command."""
    c = _commands(spark, sf_dir)
    last = c.groupBy("file").agg(F.max_by("directory", "pos").alias("directory"), F.max_by("arguments", "pos").alias("arguments"))
    return I.attach_commands(b1_covered_items(spark, sf_dir), last)[1].select("suite", "probe", "name", "path")


@register("b11_clean_arguments", sql=f"""
with {_CMDS_SQL},
a as (select pos, case when pos % 4 = 0 then list_filter(arguments, lambda x: x <> '-o')
                       when pos % 4 = 1 then arguments || ['-o'] else arguments end arguments from cmds),
b as (select pos, arguments[2:] a from a),
c as (select pos, a, list_position(a, '-o') i from b)
select pos, case when i is not null and i > 0 then a[1:i - 1] || a[i + 2:] else a end cleaned,
       list_filter(case when i is not null and i > 0 then a[1:i - 1] || a[i + 2:] else a end,
                   lambda x: starts_with(x, '-')) flags
from c""")
def b11_clean_arguments(spark, sf_dir):
    """Drop the compiler and the first -o with its operand; keep the flags."""
    c = _commands(spark, sf_dir)
    k = F.col("pos") % 4
    args = (F.when(k == 0, F.filter("arguments", lambda x: x != "-o"))
            .when(k == 1, F.concat("arguments", F.array(F.lit("-o")))).otherwise(F.col("arguments")))
    cleaned = CT.clean_arguments(args)
    return c.select("pos", cleaned.alias("cleaned"), CT.flag_arguments(cleaned).alias("flags"))


# ---------------------------------------------------------------- A7 headered JSONL
# task ids from the grid: as many tasks as documents x variants
_JSONL_SQL = """r as (
  select ['angr', 'ghidra', 'hexrays', 'retdec'][user_id % 4 + 1] system, event_id seq,
         event_id % (select count(*) * 5 from documents) task_id, event_type, props from events),
v as (select system, task_id, seq, props code from r where event_type not in ('error', 'signup'))"""


def _result_lines(spark, sf_dir):
    n_tasks = max(1, read_table(spark, sf_dir, "documents").count() * 5)
    sysc = F.element_at(F.array(*[F.lit(s) for s in ["angr", "ghidra", "hexrays", "retdec"]]),
                        (F.col("user_id") % 4 + 1).cast("int"))
    return read_table(spark, sf_dir, "events").select(
        sysc.alias("system"), F.col("event_id").alias("seq"), (F.col("event_id") % n_tasks).alias("task_id"),
        "event_type", F.col("props").alias("code"))


@register("a7_headered_jsonl", sql=f"""
with {_JSONL_SQL}
select case when system = 'retdec' then 'no header' else system end system, task_id, arg_max(code, seq) code
from v group by all""")
def a7_headered_jsonl(spark, sf_dir):
    """Files of {idx, code} lines in one folder, all but one system's with a header; broken lines and lines without
    idx are skipped, the last line of a repeated idx wins by its place in the file."""
    r = _result_lines(spark, sf_dir)
    line = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"idx": '), F.col("task_id").cast("string"),
                                                            F.lit(', "code": ')))
            .when(F.col("event_type") == "signup", F.to_json(F.struct(F.col("code").alias("note"))))
            .otherwise(F.to_json(F.struct(F.col("task_id").alias("idx"), "code"))))
    files = max(4, -(-r.count() // 250_000))  # as many rows a file as the sink has
    part = F.pmod(F.xxhash64("task_id"), F.lit(files)).alias("part")
    body = r.select("system", part, F.lit(1).alias("body"), "seq", line.alias("value"))
    path = scratch_path(spark, "jsonl")
    for system in ["angr", "ghidra", "hexrays", "retdec"]:  # files of several systems side by side in one folder
        own = body.filter(F.col("system") == system)
        if system != "retdec":
            head = own.select("part").distinct().select(
                F.lit(system).alias("system"), "part", F.lit(0).alias("body"), F.lit(0).cast("long").alias("seq"),
                F.to_json(F.struct(F.lit(system).alias("model"))).alias("value"))
            own = head.unionByName(own)
        own.repartition("part").sortWithinPartitions("part", "body", "seq").select("value").write.mode("append").text(path)
    out = I.read_headered_jsonl(spark, path)
    # a file without a header is named by its stem, which Spark's writer chooses
    system = F.when(F.col("system").startswith("part-"), F.lit("no header")).otherwise(F.col("system"))
    return out.select(system.alias("system"), "task_id", "code")


@register("a9_result_sink", sql=f"""
with {_JSONL_SQL}
select system, task_id, arg_max(props, seq) code from r where event_type <> 'signup' group by all""")
def a9_result_sink(spark, sf_dir):
    """Results appended as {idx, code} lines under one header per file, read back by place in the file."""
    path = scratch_path(spark, "results")
    I.write_headered_jsonl(_result_lines(spark, sf_dir).filter("event_type <> 'signup'"), path)
    return I.read_headered_jsonl(spark, path).select("system", "task_id", "code")


@register("a9_named_results", sql=f"""
with {_JSONL_SQL}
select system, task_id, arg_max(props, seq) code from r where event_type <> 'signup' group by all""")
def a9_named_results(spark, sf_dir):
    """Results written to files named by their system, one header a file and none for one system, and read back."""
    path = scratch_path(spark, "named-results")
    I.write_result_files(_result_lines(spark, sf_dir).filter("event_type <> 'signup'"), path, without_header=["retdec"])
    return I.read_headered_jsonl(spark, path).select("system", "task_id", "code")


# ---------------------------------------------------------------- A8 task queues
@register("a8_queue_scan", sql="""
with q as (select event_id pos, event_id % (select count(*) * 5 from documents) task_id, ['angr', 'ghidra'][event_id % 2 + 1] system, event_type, props from events),
ok as (select * from q where event_type in ('purchase', 'click'))
select task_id, arg_max(props, pos) filter (where system = 'angr') angr,
       arg_max(props, pos) filter (where system = 'ghidra') ghidra from ok group by task_id""")
def a8_queue_scan(spark, sf_dir):
    """Saved task queues, JSON arrays of at most 100 entries and many to a file, scanned back: the first value of a
    completed entry's result map, the later entry wins; errors and empty results give nothing."""
    e = read_table(spark, sf_dir, "events")
    n_tasks = max(1, read_table(spark, sf_dir, "documents").count() * 5)
    system = F.when(F.col("event_id") % 2 == 0, "angr").otherwise("ghidra")
    done = F.col("event_type").isin("purchase", "click")
    result = F.when(done, F.create_map(F.lit("0x10"), F.col("props"), F.lit("0x20"), F.lit("int later;"))) \
        .when(F.col("event_type") == "view", F.create_map().cast("map<string,string>"))
    entry = F.struct(F.col("event_id").alias("pos"), F.struct(
        F.col("event_id").cast("string").alias("uuid"), F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        F.struct((F.col("event_id") % n_tasks).alias("idx"), system.alias("decompiler")).alias("metadata"), result.alias("result")).alias("t"))
    path = scratch_path(spark, "queues")
    (e.groupBy(F.floor(F.col("event_id") / 100).alias("grp")).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("xs"))
     .select("grp", F.to_json(F.transform("xs", lambda x: x["t"])).alias("value")).write.parquet(path))
    queue = I.parse_task_queue(spark.read.parquet(path), ["grp"])
    return I.queue_results(queue.withColumn("pos", F.struct("grp", "pos")), ["angr", "ghidra"])


# ---------------------------------------------------------------- A13 config dims
@register("a13_selected_systems", sql=f"""
with {fx.RUNS_SQL}
select system, count(*) n from runs where system in (1, 3, 5) group by system""")
def a13_selected_systems(spark, sf_dir):
    """Configured systems intersected with a requested list (unknown names dropped); runs kept per system."""
    sel = I.select_systems(spark, list(range(12)), [1, 3, 5, 42])
    runs = fx.runs(spark, sf_dir)
    return (runs.join(F.broadcast(sel.select(F.col("system").cast("int"))), "system", "left_semi")
            .groupBy("system").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- B8 / B9 / J7 symbols
@register("b8_symbol_address", sql="""
select p_partkey,
       case when ends_with(line, ' ' || name) then ('0x' || split_part(line, ' ', 1))::BIGINT end addr
from (select p_partkey, concat('fn_', p_partkey) name,
             concat(lower(hex(p_partkey * 16 + 4096)), ' T ',
                    case when p_size % 10 = 0 then concat('fn_x', p_partkey) else concat('fn_', p_partkey) end) line
      from part)""")
def b8_symbol_address(spark, sf_dir):
    """Symbol lines '<hex> T name' parsed to an address when the name matches."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("fn_"), k.cast("string"))
    line = F.concat(F.lower(F.hex(k * 16 + 4096)), F.lit(" T "),
                    F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("fn_x"), k.cast("string"))).otherwise(name))
    return p.select("p_partkey", CT.symbol_address(line, name).alias("addr"))


@register("b9_address_hex", sql="select l_orderkey, l_linenumber, '0x' || lower(hex(l_orderkey * 4096 + l_linenumber)) "
                                "addr from lineitem")
def b9_address_hex(spark, sf_dir):
    """Addresses rendered as Python hex text."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     CT.address_hex(F.col("l_orderkey") * 4096 + F.col("l_linenumber")).alias("addr"))


@register("j7_relocation_map", sql="""
with rel as (select o_custkey % 50 binary_id, o_orderkey * 8 so_offset,
                    case when o_orderkey % 13 = 0 then '' else concat('f', o_orderkey % 300) end so_func from orders),
sym as (select s_suppkey % 50 binary_id, t.ord table_ord, concat('f', (s_suppkey * 7 + t.ord) % 300) name,
               case when s_suppkey % 9 = 0 then 0 else s_suppkey * 16 + t.ord end value
        from supplier, range(3) t(ord)),
s as (select binary_id, name, arg_max(value, table_ord) value from sym where name <> '' and value <> 0 group by all)
select r.binary_id, '0x' || lower(hex(s.value)) binary_offset, '0x' || lower(hex(r.so_offset)) so_offset
from rel r join s on s.binary_id = r.binary_id and s.name = r.so_func
where r.so_func <> ''""")
def j7_relocation_map(spark, sf_dir):
    """Relocations matched to binary symbols (last symbol table wins, zero values ignored)."""
    o = read_table(spark, sf_dir, "orders")
    rel = o.select((F.col("o_custkey") % 50).alias("binary_id"), (F.col("o_orderkey") * 8).alias("so_offset"),
                   F.when(F.col("o_orderkey") % 13 == 0, F.lit(""))
                   .otherwise(F.concat(F.lit("f"), (F.col("o_orderkey") % 300).cast("string"))).alias("so_func"))
    s = read_table(spark, sf_dir, "supplier")
    t = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("table_ord")
    sym = s.select((F.col("s_suppkey") % 50).alias("binary_id"), "s_suppkey", t)
    sym = sym.select("binary_id", "table_ord",
                     F.concat(F.lit("f"), ((F.col("s_suppkey") * 7 + F.col("table_ord")) % 300).cast("string")).alias("name"),
                     F.when(F.col("s_suppkey") % 9 == 0, F.lit(0).cast("bigint"))
                     .otherwise(F.col("s_suppkey") * 16 + F.col("table_ord")).alias("value"))
    return I.relocation_map(rel, sym, key="binary_id")


# ---------------------------------------------------------------- B10 preprocessed text
def _pre_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    t = _nl(F.concat(F.lit("# "), i, F.lit(' "file.c"')), F.col("text"),
            F.lit('__attribute__((visibility("hidden"))) int x;'), F.lit("#  2 kept"), F.lit("# 12x kept"),
            F.concat(F.lit("# 7 "), i), F.lit('int y __visibility__("hidden");'))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(t, F.lit("\n"))).otherwise(t).alias("t"))


@register("b10_clean_preprocessed", sql="""
with d as (select doc_id, concat_ws(chr(10), '# ' || doc_id || ' "file.c"', text,
                  '__attribute__((visibility("hidden"))) int x;', '#  2 kept', '# 12x kept', '# 7 ' || doc_id,
                  'int y __visibility__("hidden");') t from documents),
e as (select doc_id, case when doc_id % 3 = 0 then t || chr(10) else t end t from d),
l as (select doc_id, regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]') ls,
             regexp_matches(t, '(?:\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}])$') eb from e),
m as (select doc_id, case when eb then ls[1:len(ls) - 1] else ls end ls from l)
select doc_id, replace(replace(array_to_string(list_filter(ls, lambda x: not regexp_matches(x, '^# \\d+ ')), chr(10)),
       '__attribute__((visibility("hidden")))', '__attribute__((visibility("default")))'),
       '__visibility__("hidden")', '__visibility__("default")') t
from m""")
def b10_clean_preprocessed(spark, sf_dir):
    """Line markers dropped and hidden visibility made default over whole documents."""
    d = _pre_text(spark, sf_dir)
    return d.select("doc_id", CT.default_visibility(CT.clean_preprocessed("t")).alias("t"))


# ---------------------------------------------------------------- B12 / B13 source spans
_SRC_SQL = """src as (
  select p_partkey k, concat_ws(chr(10), p_name, p_type, p_brand, 'int f_' || p_partkey || '(int);',
                                'int f_' || p_partkey || '(int a) { return a + ' || p_size || '; }',
                                '#undef X', 'int tail_' || p_partkey || ';') content,
         1 + p_partkey % 7 sl, 1 + p_partkey % 5 sc,
         case when p_partkey % 3 = 0 then 1 + p_partkey % 7 else least(7, 1 + p_partkey % 7 + p_partkey % 4) end el,
         case when p_partkey % 11 = 0 then 1 + p_partkey % 5 else 1 + p_partkey % 5 + p_partkey % 9 end ec
  from part)"""


def _src(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    content = F.concat_ws("\n", "p_name", "p_type", "p_brand",
                          F.concat(F.lit("int f_"), k.cast("string"), F.lit("(int);")),
                          F.concat(F.lit("int f_"), k.cast("string"), F.lit("(int a) { return a + "),
                                   F.col("p_size").cast("string"), F.lit("; }")),
                          F.lit("#undef X"), F.concat(F.lit("int tail_"), k.cast("string"), F.lit(";")))
    sl = 1 + k % 7
    sc = 1 + k % 5
    el = F.when(k % 3 == 0, sl).otherwise(F.least(F.lit(7), sl + k % 4))
    ec = F.when(k % 11 == 0, sc).otherwise(sc + k % 9)
    return p.select(k.alias("k"), content.alias("content"), sl.alias("sl"), sc.alias("sc"), el.alias("el"),
                    ec.alias("ec"))


@register("b12_span_text", sql=f"""
with {_SRC_SQL},
l as (select k, string_split(content, chr(10)) ls, sl, sc, el, ec from src)
select k, case when sl = el and sc = ec then null
               when sl = el then substring(ls[sl], sc, ec - sc + 1)
               else array_to_string(ls[sl:el], chr(10)) || chr(10) end body
from l""")
def b12_span_text(spark, sf_dir):
    """Text of a line/column span of each source file (single-line slice or whole lines)."""
    s = _src(spark, sf_dir)
    return s.select("k", CT.span_text("content", "sl", "sc", "el", "ec").alias("body"))


@register("b13_split_prelude", sql=f"""
with {_SRC_SQL},
d as (select k, content, 'int f_' || k || '(int);' decl,
             (string_split(content, chr(10)))[5] body from src),
r as (select k, body, case when instr(content, decl) > 0
                          then substring(content, 1, instr(content, decl) - 1) || substring(content, instr(content, decl) + length(decl))
                          else content end c from d)
select k, case when instr(c, body) > 0 then substring(c, 1, instr(c, body) - 1)
               || regexp_replace(substring(c, instr(c, body) + length(body)), '#undef\\s.*', '', 'g') end prelude
from r""")
def b13_split_prelude(spark, sf_dir):
    """Prelude of each file: declarations removed once, the body cut out, #undef blanked after it."""
    s = _src(spark, sf_dir)
    decl = F.array(F.concat(F.lit("int f_"), F.col("k").cast("string"), F.lit("(int);")))
    body = F.get(F.split("content", "\n"), 4)
    return s.select("k", CT.split_prelude(F.col("content"), decl, body).alias("prelude"))


# ---------------------------------------------------------------- B14 refine outputs
@register("b14_refined_code", sql="""
with o as (select doc_id, case when doc_id % 3 = 0 then concat('Sure.', chr(10), '```refined', chr(10), '  int f', doc_id,
                                  '(void);  ', chr(10), text, chr(10), '```', chr(10), 'more ```refined', chr(10), 'x', chr(10), '```')
                              when doc_id % 3 = 1 then concat('  plain ', doc_id, ' ', text, chr(10))
                              else concat('```refined', chr(10), chr(10), '```') end out from documents)
select doc_id, case when regexp_matches(out, '(?s)```refined\\n(.*?)\\n```')
                    then trim(regexp_extract(out, '(?s)```refined\\n(.*?)\\n```', 1), ' ' || chr(9) || chr(10) || chr(13))
                    else trim(out, ' ' || chr(9) || chr(10) || chr(13)) end code
from o""")
def b14_refined_code(spark, sf_dir):
    """Code inside the first ```refined fence (stripped), else the whole reply."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    nl = F.lit("\n")
    out = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sure."), nl, F.lit("```refined"), nl, F.lit("  int f"), i,
                                                     F.lit("(void);  "), nl, F.col("text"), nl, F.lit("```"), nl, F.lit("more ```refined"),
                                                     nl, F.lit("x"), nl, F.lit("```")))
           .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  plain "), i, F.lit(" "), F.col("text"), nl))
           .otherwise(F.concat(F.lit("```refined"), nl, nl, F.lit("```"))))
    return d.select("doc_id", CT.refined_code(out).alias("code"))


# ---------------------------------------------------------------- B15 / B16 prompts
COMPLETION_TEMPLATE = "# Pseudo code:\n{code}\n# Source:\n"
SYSTEM_PROMPT = "Rewrite the decompiled function as readable C."
JUDGE_TEMPLATE = "Reference:\n{reference}\n---\n{first}\n---\n{second}\n"
_MODELS = ["mlm-7b", "LLM4Decompile-Ref", "gpt-4o"]


@register("b15_refine_prompts", sql=f"""
with d as (select doc_id, ['mlm-7b', 'LLM4Decompile-Ref', 'gpt-4o'][doc_id % 3 + 1] model, text from documents)
select doc_id,
       case when contains(lower(model), 'mlm') then 'error' when contains(lower(model), 'llm4decompile') then 'completion'
            else 'chat' end kind,
       case when not contains(lower(model), 'mlm') and not contains(lower(model), 'llm4decompile')
            then '{SYSTEM_PROMPT}' end system,
       case when contains(lower(model), 'mlm') then null
            when contains(lower(model), 'llm4decompile')
            then concat('# Pseudo code:', chr(10), trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)),
                        chr(10), '# Source:', chr(10))
            else concat('Please tidy this listing.', chr(10), text) end prompt
from d""")
def b15_refine_prompts(spark, sf_dir):
    """Requests per model family over whole documents: completion, chat, or the failing mlm branch."""
    d = read_table(spark, sf_dir, "documents")
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("doc_id") % 3 + 1).cast("int"))
    p = CT.render_refine_prompt(model, F.col("text"), COMPLETION_TEMPLATE, SYSTEM_PROMPT, "Please tidy this listing.\n{code}")
    return d.select("doc_id", p.alias("p")).select("doc_id", "p.kind", "p.system", "p.prompt")


@register("b16_judge_prompts", sql=f"""
with {fx.CANDIDATE_CODE_RICH_SQL}
select r.task_id, concat('Reference:', chr(10), r.text, chr(10), '---', chr(10), r.code, chr(10), '---', chr(10),
                         '{{x}} ' || r.item, chr(10)) prompt
from rich r""")
def b16_judge_prompts(spark, sf_dir):
    """Judge prompt rendered from source, output A and output B (braces in values kept literally)."""
    r = fx.candidate_code_rich(spark, sf_dir)
    prompt = CT.render_template(JUDGE_TEMPLATE, {"reference": F.col("text"), "first": F.col("code"),
                                                 "second": F.concat(F.lit("{x} "), F.col("item"))})
    return r.select("task_id", prompt.alias("prompt"))


# ---------------------------------------------------------------- B18-B21 build inputs and logs
@register("b18_strip_extern", sql="""
with s as (select doc_id, concat_ws(chr(10), 'extern int x_' || doc_id || '; /* extern */', '  extern int y;',
                                    'externalize(1);', 'extern' || chr(9) || 'void z(void);', text) src from documents)
select doc_id, array_to_string(list_transform(string_split(src, chr(10)),
       lambda x: case when regexp_matches(x, '^extern\\s+') then replace(x, 'extern', '') else x end), chr(10)) src
from s""")
def b18_strip_extern(spark, sf_dir):
    """Every 'extern' removed on lines that start with 'extern '."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    src = F.concat_ws("\n", F.concat(F.lit("extern int x_"), i, F.lit("; /* extern */")), F.lit("  extern int y;"),
                      F.lit("externalize(1);"), F.lit("extern\tvoid z(void);"), F.col("text"))
    return d.select("doc_id", CT.strip_extern(src).alias("src"))


_STDERR_SQL = """logs as (
  select doc_id, doc_id % 4 a1, doc_id % 8 = 1 a2_ok,
         case when doc_id % 4 = 1 then regexp_replace(text, '([A-Za-z]+)[.]', 'x.c: warning: use [-W\\1].', 'g')
              when doc_id % 4 = 2 then 'a.c:3: error: no warnings here' || chr(10) || text else text end stderr
  from documents)"""


def _logs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    # a word that ends a sentence is a warning's name
    stderr = (F.when(k == 1, F.regexp_replace("text", "([A-Za-z]+)[.]", "x.c: warning: use [-W$1]."))
              .when(k == 2, F.concat(F.lit("a.c:3: error: no warnings here\n"), "text")).otherwise(F.col("text")))
    return d.select("doc_id", k.alias("a1"), (F.col("doc_id") % 8 == 1).alias("a2_ok"), stderr.alias("stderr"))


@register("b19_warnings", sql=f"""
with {_STDERR_SQL}
select doc_id, regexp_extract_all(stderr, '\\[-W(.*)\\]', 1) warnings from logs""")
def b19_warnings(spark, sf_dir):
    """Warning names from compiler stderr (greedy within a line)."""
    return _logs(spark, sf_dir).select("doc_id", CT.warnings("stderr").alias("warnings"))


_ATTEMPTS_SQL = f"""{_STDERR_SQL},
attempts as (
  select doc_id task_id, 1 attempt, ['ok', 'fail', 'fail', 'timeout'][a1 + 1] status, stderr from logs
  union all
  select doc_id, 2, case when a2_ok then 'ok' else 'fail' end, '' from logs where a1 = 1)"""


@register("b20_attempt_triage", sql=f"""
with {_ATTEMPTS_SQL},
p as (select task_id, max(case when attempt = 1 then status end) s1, max(case when attempt = 1 then stderr end) e1,
             max(case when attempt = 2 then status end) s2 from attempts group by task_id),
w as (select *, case when s1 = 'timeout' then []::VARCHAR[] else regexp_extract_all(e1, '\\[-W(.*)\\]', 1) end ws from p)
select task_id,
       case when s1 = 'ok' then 1 when s1 = 'fail' and len(ws) > 0 then cast(coalesce(s2, 'fail') = 'ok' as int) else 0 end flag,
       case when s1 = 'fail' and len(ws) > 0 then list_transform(ws, lambda x: '-Wno-' || x) end retry_flags
from w""")
def b20_attempt_triage(spark, sf_dir):
    """Final compile flag per task from an attempt log (retry with -Wno-<w> after a failure with warnings)."""
    return STS.triage_attempts(_attempts(spark, sf_dir))


def _attempts(spark, sf_dir):
    lg = _logs(spark, sf_dir)
    st = F.element_at(F.array(*[F.lit(s) for s in ["ok", "fail", "fail", "timeout"]]), (F.col("a1") + 1).cast("int"))
    a1 = lg.select(F.col("doc_id").alias("task_id"), F.lit(1).alias("attempt"), st.alias("status"), "stderr")
    a2 = lg.filter(F.col("a1") == 1).select(F.col("doc_id").alias("task_id"), F.lit(2).alias("attempt"),
                                            F.when(F.col("a2_ok"), "ok").otherwise("fail").alias("status"),
                                            F.lit("").alias("stderr"))
    return a1.unionByName(a2)


HEADER = "#include <defs.h>\n"
TRAILER = "\n/* entry */\nvoid *entry_{function} = (void *){function};\n"


_RSR_SYSTEMS = ["angr", "ghidra", "hexrays", "retdec", "func"]
_RSR_VARIANTS = ["O0", "O1", "O2"]


@register("g1_end_to_end_rate", sql=f"""
with {_ATTEMPTS_SQL}, {fx.CANDIDATE_CODE_SQL},
k as (select task_id, {_RSR_SYSTEMS!r}[task_id % 5 + 1] system, {_RSR_VARIANTS!r}[task_id // 5 % 3 + 1] variant,
             case when task_id % 7 = 0 then '' when task_id % 11 = 0 then code || 'Failed to decompile the function'
                  else code end code from cand),
e as (select *, code <> '' and not contains(code, 'Failed to decompile the function') eligible from k),
p as (select task_id, max(case when attempt = 1 then status end) s1, max(case when attempt = 1 then stderr end) e1,
             max(case when attempt = 2 then status end) s2 from attempts group by task_id),
f as (select e.system, e.variant, eligible,
             case when not eligible then 0 when s1 = 'ok' then 1
                  when s1 = 'fail' and len(regexp_extract_all(e1, '\\[-W(.*)\\]', 1)) > 0
                  then cast(coalesce(s2, 'fail') = 'ok' as int) else 0 end flag
      from e left join p using (task_id))
select system, variant, avg(flag::DOUBLE) rate, count(*) n, count(*) filter (where eligible) units from f group by all""")
def g1_end_to_end_rate(spark, sf_dir):
    """Eligibility, fixer, compile unit, attempts and rate in one plan: candidates that are not eligible get no unit and
    no attempt, and count as failures."""
    from ..functions import fixers as FX
    from ..operators import scoring
    i = F.col("task_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k + 1).cast("int"))
    cand = fx.candidate_code(spark, sf_dir)
    code = (F.when(i % 7 == 0, F.lit("")).when(i % 11 == 0, F.concat("code", F.lit(FX.FAIL_MARKER))).otherwise(F.col("code")))
    cand = cand.select("task_id", pick(_RSR_SYSTEMS, i % 5).alias("system"),
                       pick(_RSR_VARIANTS, F.floor(i / 5) % 3).alias("variant"),
                       F.concat(F.lit("fn_"), i.cast("string")).alias("item"), code.alias("code"))
    units = (cand.filter(FX.compilable("code"))
             .withColumn("code", FX.apply_fixers("system", "code", "item"))
             .select("task_id", CT.compile_unit(F.lit("int prelude;"), "code", "item", HEADER, TRAILER).alias("unit")))
    # a unit is attempted where there is one; the log of attempts is the compiler's
    attempted = _attempts(spark, sf_dir).join(units.filter(F.length("unit") > 0).select("task_id"), "task_id", "left_semi")
    flags = STS.triage_attempts(attempted)
    rows = cand.select("task_id", "system", "variant", FX.compilable("code").alias("eligible")).join(flags, "task_id", "left")
    rate = scoring.recompile_rate(rows)
    return rate.join(rows.groupBy("system", "variant").agg(F.count_if("eligible").alias("units")), ["system", "variant"])


@register("b21_compile_unit", sql=f"""
with {_SRC_SQL}, {fx.CANDIDATE_CODE_RICH_SQL}
select r.task_id, concat('#include <defs.h>', chr(10), s.content, chr(10), r.code,
                         chr(10), '/* entry */', chr(10), 'void *entry_', r.item, ' = (void *)', r.item, ';', chr(10)) unit
from rich r join src s on s.k = r.task_id""")
def b21_compile_unit(spark, sf_dir):
    """Compile unit: header + prelude + code + trailer naming the function."""
    r = fx.candidate_code_rich(spark, sf_dir)
    s = _src(spark, sf_dir).select(F.col("k").alias("task_id"), "content")
    return r.join(s, "task_id").select("task_id", CT.compile_unit("content", "code", "item", HEADER, TRAILER).alias("unit"))


@register("b22_base64_payload", sql="""
select page_id, to_base64(encode(html)) payload, true roundtrip from pages""")
def b22_base64_payload(spark, sf_dir):
    """Page bytes as base64 text, and the decode round trip."""
    p = read_table(spark, sf_dir, "pages")
    enc = CT.encode_payload(F.encode("html", "UTF-8"))
    return p.select("page_id", enc.alias("payload"),
                    (CT.decode_payload(enc) == F.encode("html", "UTF-8")).alias("roundtrip"))


# ---------------------------------------------------------------- G2 outcomes map
_SYS_DASH = ["gpt-4o-mini", "gpt-4o", "angr", "llm4decompile", "claude", "qwen"]


@register("g2_flatten_outcomes", sql=f"""
with {fx.RUNS_SQL},
r as (select probe, item_id, concat({_SYS_DASH}[system % 6 + 1], '-', ['O0','O1','O2','O3','Os'][variant + 1]) key,
             bool_and(ok) ok from runs group by all)
select probe, item_id, regexp_extract(key, '^(.*)-([^-]*)$', 1) system,
       regexp_extract(key, '^(.*)-([^-]*)$', 2) variant, ok from r""")
def g2_flatten_outcomes(spark, sf_dir):
    """Per-(probe, item) outcome maps keyed 'system-variant' flattened; split at the last '-'."""
    runs = fx.runs(spark, sf_dir)
    key = F.concat(F.element_at(F.array(*[F.lit(s) for s in _SYS_DASH]), (F.col("system") % 6 + 1).cast("int")),
                   F.lit("-"), F.element_at(F.array(*[F.lit(v) for v in fx.VARIANTS]), (F.col("variant") + 1).cast("int")))
    cells = runs.groupBy("probe", "item_id", key.alias("key")).agg(F.bool_and("ok").alias("ok"))
    raw = cells.groupBy("probe", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "ok"))).alias("outcomes"))
    return I.flatten_outcomes(raw).select("probe", "item_id", "system", "variant", "ok")


# ---------------------------------------------------------------- P2-P4 decompiler outputs
def _listings(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    h = lambda k: F.lower(F.hex(i * 64 + k))
    # whole texts as bodies: some of their points and commas become braces, which may or may not balance
    text = F.replace(F.replace("text", F.lit(". "), F.lit(" {\n")), F.lit(", "), F.lit(" }\n"))
    code = F.concat(F.lit("// "), h(0), F.lit(": f0\nint f0(void)\n{\n  if (x) { y(); }\n"), text, F.lit("\n}\n"),
                    F.lit("// "), h(1), F.lit(": f1\nint f1(void) { return 1; }\n"),
                    F.lit("// "), h(2), F.lit(": open\nvoid g(void)\n{\n  "), text)
    addrs = F.array(F.concat(F.lit("0x"), h(0)), F.concat(F.lit("0x"), h(2)),
                    F.when(i % 2 == 0, F.concat(F.lit("0x"), h(1))).otherwise(F.lit("0x0")))
    return d.select(i.alias("listing_id"), code.alias("code"), addrs.alias("addresses"))


_LISTINGS_SQL = """lst as (
  select doc_id listing_id,
         concat('// ', lower(hex(doc_id * 64)), ': f0', chr(10), 'int f0(void)', chr(10), '{', chr(10),
                '  if (x) { y(); }', chr(10), t, chr(10), '}', chr(10),
                '// ', lower(hex(doc_id * 64 + 1)), ': f1', chr(10), 'int f1(void) { return 1; }', chr(10),
                '// ', lower(hex(doc_id * 64 + 2)), ': open', chr(10), 'void g(void)', chr(10), '{', chr(10), '  ', t) code,
         ['0x' || lower(hex(doc_id * 64)), '0x' || lower(hex(doc_id * 64 + 2)),
          case when doc_id % 2 = 0 then '0x' || lower(hex(doc_id * 64 + 1)) else '0x0' end] addresses
  from (select doc_id, replace(replace(text, '. ', ' {' || chr(10)), ', ', ' }' || chr(10)) t from documents))"""


# per character, the depth; a comment's body ends where a closing brace first comes down to the comment's depth. Only comments' colons and
# braces are joined.
@register("p2_listing_bodies", sql=f"""
with {_LISTINGS_SQL},
c as (select listing_id, unnest(string_split(code, '')) ch, generate_subscripts(string_split(code, ''), 1) i from lst),
d as (select *, sum(case when ch = '{{' then 1 when ch = '}}' then -1 else 0 end)
                  over (partition by listing_id order by i) depth from c where ch in ('{{', '}}', ':', chr(10))),
m as (select listing_id, i s, depth ds, regexp_extract(substring(code, greatest(1, i - 40), least(i, 41)), '// ([0-9A-Fa-f]+):$', 1) addr, code, addresses
      from d join lst using (listing_id) where ch = ':'),
w as (select * from m where addr <> '' and list_contains(list_transform(addresses, lambda a: a::BIGINT), ('0x' || addr)::BIGINT)),
e as (select w.listing_id, w.s, min(d.i) close from w left join d
        on d.listing_id = w.listing_id and d.i > w.s and d.ch = '}}' and d.depth = w.ds group by all),
b as (select e.listing_id, e.s, e.close, min(d.i) nl from e left join d
        on d.listing_id = e.listing_id and d.i > e.s and d.ch = chr(10) and (e.close is null or d.i < e.close) group by all)
select listing_id, '0x' || lower(hex(('0x' || addr)::BIGINT)) address,
       arg_max(trim(substring(code, coalesce(nl + 1, s + 1),
                              coalesce(close, length(code) - 1) - coalesce(nl + 1, s + 1) + 1),
                    ' ' || chr(9) || chr(10) || chr(13)), s) body
from b join w using (listing_id, s) group by all""")
def p2_listing_bodies(spark, sf_dir):
    """Function bodies cut from address-commented listings, block by block (also checked against a brute-force test)."""
    return L.listing_bodies(_listings(spark, sf_dir), block_chars=1 << 14)


_TOKENS_SQL = """tok as (
  select doc_id listing_id, w.pos, case when w.pos % 40 = 1 then 'cmnt' else 'text' end kind,
         case when w.pos % 40 = 1 then concat('// Address range: 0x', lower(hex(doc_id * 1000 + w.pos)), ' - 0xff')
              when w.pos % 40 = 3 then '{' when w.pos % 40 = 9 then '{' when w.pos % 40 = 12 then '}'
              when w.pos % 40 = 25 then '}' when w.pos % 40 = 30 then null else w.word end val
  from (select doc_id, unnest(string_split(text, ' ')) word, generate_subscripts(string_split(text, ' '), 1) pos
        from documents) w),
req as (select listing_id, substring(val, 19, position(' - ' in val) - 19) address from tok
        where kind = 'cmnt' and (listing_id + pos) % 3 <> 0)"""


def _tokens(spark, sf_dir):
    """Documents as token lists: every 40th word starts a function, some words are braces, some are missing."""
    d = read_table(spark, sf_dir, "documents")

    def token(word, i):
        m = (i + 1) % 40
        mark = F.concat(F.lit("// Address range: 0x"), F.lower(F.hex(F.col("doc_id") * 1000 + i + 1)), F.lit(" - 0xff"))
        val = (F.when(m == 1, mark).when(m.isin(3, 9), F.lit("{")).when(m.isin(12, 25), F.lit("}"))
               .when(m == 30, F.lit(None).cast("string")).otherwise(word))
        return F.struct(F.when(m == 1, F.lit("cmnt")).otherwise(F.lit("text")).alias("kind"), val.alias("val"))

    tokens = F.transform(F.split("text", " "), token)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(F.split("text", " ")), F.lit(1)), F.lit(40)),
                      lambda p: (F.col("doc_id") + p) % 3 != 0)
    addresses = F.transform(places, lambda p: F.concat(F.lit("0x"), F.lower(F.hex(F.col("doc_id") * 1000 + p))))
    return d.select(F.col("doc_id").alias("listing_id"), tokens.alias("tokens"), addresses.alias("addresses"))


_TOKEN_BODIES_SQL = f"""
with {_TOKENS_SQL},
m as (select t.*, r.address is not null st, r.address from tok t left join req r
        on r.listing_id = t.listing_id and t.kind = 'cmnt'
       and r.address = regexp_extract(t.val, '0x\\w+', 0) and contains(t.val, '// Address range:')),
s as (select *, sum(cast(st as int)) over (partition by listing_id order by pos) seg,
             last(address ignore nulls) over (partition by listing_id order by pos) seg_addr from m),
b as (select * from s where seg > 0 and not st),
d as (select *, sum(case when val = '{{' then 1 when val = '}}' then -1 else 0 end)
                  over (partition by listing_id, seg order by pos) depth,
             max(case when val = '{{' then 1 else 0 end) over (partition by listing_id, seg order by pos) opened from b),
c as (select *, min(case when depth = 0 and opened = 1 then pos end) over (partition by listing_id, seg) close from d),
g as (select listing_id, seg, seg_addr, string_agg(val, '' order by pos) body from c
      where close is not null and pos <= close and val is not null group by all)
select listing_id, seg_addr address, arg_max(trim(body, ' ' || chr(9) || chr(10) || chr(13)), seg) body
from g group by all"""


@register("p3_token_bodies", sql=_TOKEN_BODIES_SQL)
def p3_token_bodies(spark, sf_dir):
    """Function bodies from token streams: tokens between a requested address comment and the
    balancing brace."""
    return L.token_list_bodies(_tokens(spark, sf_dir))


@register("p3_token_stream_bodies", sql=_TOKEN_BODIES_SQL)
def p3_token_stream_bodies(spark, sf_dir):
    """The same from streams of token rows, in blocks, whatever the length of a stream."""
    t = _tokens(spark, sf_dir)
    rows = t.select("listing_id", F.posexplode("tokens").alias("pos", "t")).select("listing_id", F.col("pos").cast("long"), "t.*")
    return L.token_bodies(rows, t.select("listing_id", F.explode("addresses").alias("address")))


@register("p4_outcome_reasons", sql="""
with r as (select ['angr', 'ghidra', 'hexrays', 'reko', 'retdec'][user_id % 5 + 1] system, event_type = 'error' timed_out,
                  case when event_type in ('click', 'view') then 0 else 1 end returncode,
                  case when event_type = 'view' then '' when event_type = 'click' then props
                       when event_type = 'purchase' then 'Failed to decompile the function.' else '' end stdout
           from events),
c as (select system, case when timed_out then 'time_limit'
                          when returncode = 0 and coalesce(length(stdout), 0) = 0 then 'empty_result'
                          when returncode <> 0 then 'error'
                          when stdout in ('Failed to find the function at the given address.', 'Failed to decompile the function.')
                          then 'runner_failure' else 'ok' end reason from r)
select system, reason, count(*) runs from c group by all""")
def p4_outcome_reasons(spark, sf_dir):
    """Runs per (system, outcome reason): time limit, empty result, error, runner failure, ok."""
    return L.reason_counts(L.classify_runs(_runs(spark, sf_dir)))


def _runs(spark, sf_dir, *more):
    et = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        F.element_at(F.array(*[F.lit(s) for s in ["angr", "ghidra", "hexrays", "reko", "retdec"]]),
                     (F.col("user_id") % 5 + 1).cast("int")).alias("system"),
        (et == "error").alias("timed_out"),
        F.when(et.isin("click", "view"), F.lit(0)).otherwise(F.lit(1)).alias("returncode"),
        F.when(et == "view", F.lit("")).when(et == "click", F.col("props"))
        .when(et == "purchase", F.lit("Failed to decompile the function.")).otherwise(F.lit("")).alias("stdout"),
        F.lit("").alias("stderr"), *more)


@register("p4_run_times", sql="""
with r as (select ['angr', 'ghidra', 'hexrays', 'reko', 'retdec'][user_id % 5 + 1] system, event_type = 'error' timed_out,
                  case when event_type in ('click', 'view') then 0 else 1 end returncode,
                  case when event_type = 'view' then '' when event_type = 'click' then props
                       when event_type = 'purchase' then 'Failed to decompile the function.' else '' end stdout, value as seconds
           from events),
c as (select system, seconds, case when timed_out then 'time_limit'
                          when returncode = 0 and coalesce(length(stdout), 0) = 0 then 'empty_result'
                          when returncode <> 0 then 'error'
                          when stdout in ('Failed to find the function at the given address.', 'Failed to decompile the function.')
                          then 'runner_failure' else 'ok' end reason from r)
select system, reason, count(*) runs, round(sum(seconds), 6) as seconds, min(seconds) as least, max(seconds) as most, q.rank::DOUBLE as rank, true as near
from c, (values (0.5), (0.9), (0.99)) q(rank) where seconds is not null group by system, reason, q.rank""")
def p4_run_times(spark, sf_dir):
    """Run times per system and reason, sketched per batch, stored and merged; every quantile's rank is within the stated error."""
    runs = _runs(spark, sf_dir, "value")
    classified = L.classify_runs(runs).withColumnRenamed("value", "seconds")
    path = scratch_path(spark, "run-times")
    table = MergedTable(spark, path, L.RUN_TIMES, L.merge_run_times)
    for batch in range(3):
        table.append(L.run_times(classified.filter(F.pmod(F.xxhash64("seconds"), F.lit(3)) == batch)), batch)
        if batch == 1:
            table.compact()
    times = table.current().checkpoint()
    q = L.run_time_quantiles(times)
    # the rank of a value that stands several times is a range
    # as many rows as systems, reasons and ranks, whatever the runs
    seen = classified.filter("seconds is not null").select("system", "reason", "seconds").join(F.broadcast(q), ["system", "reason"])
    ranks = seen.groupBy("system", "reason", "rank", "value").agg(
        F.avg((F.col("seconds") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("seconds") <= F.col("value")).cast("int")).alias("upto"),
        F.count(F.lit(1)).alias("n"))
    slack = 2 * L.RANK_ERROR + 1 / F.col("n")
    near = ranks.select("system", "reason", "rank", ((F.col("below") <= F.col("rank") + slack) & (F.col("upto") >= F.col("rank") - slack)).alias("near"))
    return (times.select("system", "reason", "runs", F.round("seconds", 6).alias("seconds"), "least", "most")
            .join(near, ["system", "reason"]))


# ---------------------------------------------------------------- A6 / A10-A12 sinks, U2 inference
from ..sources import sinks as SK  # noqa: E402


@register("a6_candidates_roundtrip", sql=f"""
with {fx.CANDIDATE_CODE_SQL}
select task_id, ['angr', 'ghidra', 'hexrays'][task_id % 3 + 1] system, code from cand
where ['angr', 'ghidra', 'hexrays'][task_id % 3 + 1] in ('angr', 'hexrays')""")
def a6_candidates_roundtrip(spark, sf_dir):
    """Long candidates written partitioned by system and read back for two systems (partition pruning)."""
    c = fx.candidate_code(spark, sf_dir)
    sysc = F.element_at(F.array(*[F.lit(s) for s in ["angr", "ghidra", "hexrays"]]), (F.col("task_id") % 3 + 1).cast("int"))
    path = scratch_path(spark, "candidates")
    SK.write_candidates(c.withColumn("system", sysc), path)
    return SK.read_candidates(spark, path, ["angr", "hexrays"]).select("task_id", "system", "code")


@register("a10_cer_results_nested", sql=f"""
with {fx.RUNS_SQL},
l3 as (select suite, item_id item, system, variant, list(struct_pack(probe := probe, ok := ok) order by probe, ok) runs
       from runs group by all),
l2 as (select suite, item, system,
              map_from_entries(list(struct_pack(k := cast(variant as varchar), v := runs) order by cast(variant as varchar))) v
       from l3 group by all),
l1 as (select suite, item,
              map_from_entries(list(struct_pack(k := cast(system as varchar), v := v) order by cast(system as varchar))) s
       from l2 group by all)
select suite, item, cast(to_json(s) as varchar) json from l1""")
def a10_cer_results_nested(spark, sf_dir):
    """CER outcomes stored long (partitioned by suite) and rendered as nested JSON per item on demand."""
    runs = fx.runs(spark, sf_dir)
    path = scratch_path(spark, "cer")
    SK.write_cer_results(runs.withColumnRenamed("item_id", "item"), path)
    return I.nested_results_json(spark.read.parquet(path))


@register("a11_scores_csv_roundtrip", sql=q_arena._ROUND_SCORES_SQL + "select system, median, arena from med")
def a11_scores_csv_roundtrip(spark, sf_dir):
    """Median scores written as CSV per aspect and read back with a schema."""
    from ..operators import rating as R
    med = R.median_scores(q_arena._round_scores(spark, sf_dir), value="score")
    path = scratch_path(spark, "scores")
    SK.write_scores_csv(med, path)
    return SK.read_scores_csv(spark, path, "system string, median double, arena string")


@register("a12_battle_chunks_pending", sql=f"""
with {fx.BATTLES_SQL},
ev as (select event_id battle_id, event_type from events),
chunks as (select distinct battle_id // 5 chunk_id from battles),
stored as (select distinct b.battle_id // 5 chunk_id from battles b join ev using (battle_id)
           where ev.event_type in ('purchase', 'click'))
select chunk_id from chunks where chunk_id not in (select chunk_id from stored)""")
def a12_battle_chunks_pending(spark, sf_dir):
    """Battles of completed judge calls stored per chunk; chunks with no stored battle are pending."""
    ev = read_table(spark, sf_dir, "events")
    b = fx.battles(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("battle_id") / 5).cast("bigint"))
    done = b.join(ev.select(F.col("event_id").alias("battle_id"), "event_type"), "battle_id") \
        .filter(F.col("event_type").isin("purchase", "click")).drop("event_type")
    path = scratch_path(spark, "battle-chunks")
    SK.write_battle_chunks(done, path)
    from ..operators import grids as G
    return G.pending_chunks(b.select("chunk_id").distinct(), SK.stored_chunks(spark, path))


async def _slow_length(text):
    """A call over a network, as far as its waiting goes; texts of some lengths fail or come back empty."""
    import asyncio
    await asyncio.sleep(0.0005)
    if len(text) % 10 == 3:
        raise ValueError("refused")
    return "" if len(text) % 10 == 4 else str(len(text))


@register("u2_calls_in_flight", sql="""
select doc_id, case when length(text) % 10 in (3, 4) then 'ERROR' else cast(length(text) as varchar) end output,
       case length(text) % 10 when 3 then 'ValueError: refused' when 4 then 'no result' end error from documents""")
def u2_calls_in_flight(spark, sf_dir):
    """Up to 32 calls in flight per task; failures and empty answers become ERROR, row by row."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.infer_in_flight(d, _slow_length, "text", in_flight=32, time_limit=60).select("doc_id", "output", "error")


def _text_length(s):
    return s.str.len().astype(str)


@register("u2_infer", sql="select doc_id, cast(length(text) as varchar) output, cast(null as varchar) error from documents")
def u2_infer(spark, sf_dir):
    """Batch inference surface: a caller function applied to whole documents in Arrow batches."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return L.infer(d, _text_length).select("doc_id", "output", "error")


# ---------------------------------------------------------------- A4 + B12 + B13: items from sources and spans
_SPANS_SQL = f"""{_SRC_SQL},
files as (select concat('/src/suite', k % 4, '/f_', k, '.c') path, content, k from src),
spans as (
  select path, 'f_' || k name, false is_definition, 4 sl, 1 sc, 4 el,
         case when k % 5 = 0 then 1 else length(string_split(content, chr(10))[4]) end ec, 1 ord from files
  union all
  select path, 'f_' || k, true, 5, 1, 5, length(string_split(content, chr(10))[5]), 2 from files
  union all
  select path, 'tail_' || k, true, 7, 1, 7, 10, 3 from files)"""


def _files_spans(spark, sf_dir):
    s = _src(spark, sf_dir)
    files = s.select(F.concat(F.lit("/src/suite"), (F.col("k") % 4).cast("string"), F.lit("/f_"),
                              F.col("k").cast("string"), F.lit(".c")).alias("path"), "content", "k")
    line = lambda n: F.length(F.get(F.split("content", "\n"), n - 1))
    name = F.concat(F.lit("f_"), F.col("k").cast("string"))
    d = files.select("path", name.alias("name"), F.lit(False).alias("is_definition"), F.lit(4).alias("sl"),
                     F.lit(1).alias("sc"), F.lit(4).alias("el"),
                     F.when(F.col("k") % 5 == 0, F.lit(1)).otherwise(line(4)).alias("ec"), F.lit(1).alias("ord"))
    f = files.select("path", name.alias("name"), F.lit(True).alias("is_definition"), F.lit(5).alias("sl"),
                     F.lit(1).alias("sc"), F.lit(5).alias("el"), line(5).alias("ec"), F.lit(2).alias("ord"))
    o = files.select("path", F.concat(F.lit("tail_"), F.col("k").cast("string")).alias("name"),
                     F.lit(True).alias("is_definition"), F.lit(7).alias("sl"), F.lit(1).alias("sc"),
                     F.lit(7).alias("el"), F.lit(10).alias("ec"), F.lit(3).alias("ord"))
    spans = d.unionByName(f).unionByName(o).withColumn("ord", F.col("ord").cast("bigint"))
    return files.select("path", "content"), spans


@register("a4_extract_items", sql=f"""
with {_SPANS_SQL},
j as (select s.*, f.content from spans s join files f using (path)
      where s.name = regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1)),
b as (select *, case when sl = el and sc = ec then null
                     when sl = el then substring(string_split(content, chr(10))[sl], sc, ec - sc + 1)
                     else array_to_string(string_split(content, chr(10))[sl:el], chr(10)) || chr(10) end body from j),
v as (select * from b where body is not null and body <> ''),
d as (select path, body decl from v where not is_definition),
r as (select v.path, v.name, v.body, v.content,
             case when d.decl is not null and instr(v.content, d.decl) > 0
                  then substring(v.content, 1, instr(v.content, d.decl) - 1) || substring(v.content, instr(v.content, d.decl) + length(d.decl))
                  else v.content end c
      from v left join d using (path) where v.is_definition)
select path, name item, body func,
       case when instr(c, body) > 0 then substring(c, 1, instr(c, body) - 1)
            || regexp_replace(substring(c, instr(c, body) + length(body)), '#undef\\s.*', '', 'g') end include
from r""")
def a4_extract_items(spark, sf_dir):
    """Items from source files + function spans: body, and prelude with declarations removed."""
    files, spans = _files_spans(spark, sf_dir)
    return I.extract_items(files, spans)


@register("a4_function_files", sql="""
select case when doc_id % 9 = 0 then 'other' else source end suite, concat('fn_', doc_id) item,
       text || case when doc_id % 7 = 0 then chr(65533) || '//' else '' end source
from documents where doc_id % 11 <> 3""")
def a4_function_files(spark, sf_dir):
    """One file per function, written by name and scanned back; bytes that are no UTF-8 are replaced, a suite is skipped."""
    d, i = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    suite = F.when(i % 11 == 3, I.SKIPPED_SUITES[0]).when(i % 9 == 0, "other").otherwise(F.col("source"))
    tail = F.when(i % 7 == 0, F.lit(b"\xff//")).otherwise(F.lit(b""))
    path = scratch_path(spark, "functions")
    I.write_function_files(d.select(suite.alias("suite"), F.concat(F.lit("fn_"), i.cast("string")).alias("item"),
                                    F.concat(F.encode("text", "UTF-8"), tail).alias("source")), path)
    return I.read_function_files(spark, path).select("suite", "item", "source")


# ---------------------------------------------------------------- A5 probe discovery
# one build folder per 20 parts, each with a symbolizer and a patched copy
_PROBES_SQL = """pr as (
  select concat('suite', p_partkey // 20) suite,
         case when p_partkey % 20 = 0 then 'llvm-symbolizer' when p_partkey % 20 = 1 then concat('fuzz_', p_partkey, '_patched')
              else concat('fuzz_', p_partkey) end probe, p_partkey % 3 <> 0 elf
  from part)"""


@register("a5_discover_probes", sql=f"""
with {_PROBES_SQL}
select suite, probe from pr where elf and probe <> 'llvm-symbolizer' and not ends_with(probe, '_patched')""")
def a5_discover_probes(spark, sf_dir):
    """Build outputs by file name (ELF header or a script) in one folder per suite; only four bytes of each are read."""
    p, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    probe = (F.when(k % 20 == 0, F.lit("llvm-symbolizer")).when(k % 20 == 1, F.concat(F.lit("fuzz_"), k.cast("string"), F.lit("_patched")))
             .otherwise(F.concat(F.lit("fuzz_"), k.cast("string"))))
    content = F.concat(F.when(k % 3 != 0, F.lit(I.ELF_MAGIC + b"\x02\x01")).otherwise(F.lit(b"#!/bin/sh ")), F.encode("p_name", "UTF-8"))
    path = scratch_path(spark, "probes")
    suite = F.concat(F.lit("suite"), F.floor(k / 20).cast("string"))
    write_named_files(p, path, F.concat(suite, F.lit("/"), probe), content, folder=suite)
    return I.discover_probes(spark, path).select("suite", "probe")
