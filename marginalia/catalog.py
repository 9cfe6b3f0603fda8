"""One query per operator over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fixtures as fx
from .functions import templates as tp, text as tx
from .operators import code, detect, lines, model, prompts, records, reports, reviews, walk
from .plans.ordered_text import ROW_BYTES
from .session import tune
from .sinks import files as sinks, record_store
from .sources import tree
from .storage import materialize, posix_path, run_dir
from .streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHUNK_BYTES = 512
PART_BYTES = 4096


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query under its function's name, with its SQL behind the views it needs."""

    def register(fn: Query) -> Query:
        name = fn.__name__.removeprefix("q_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The SQL of the queries labels times in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fx.with_views(sql, *views, recursive=recursive) if views else sql
        return fn

    return register


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- lines and chunks

SQL_LINES = r"""
select *, case when a[-1] = '' then a[:-2] else a end as lns
from (select *, regexp_split_to_array(content, '\r?\n') as a from code_files)
"""
SQL_NUMBERED = f"""
select project, path, line_no, line, printf('%6d: %s', line_no, line) || chr(10) as numbered
from (select project, path, unnest(range(1, len(lns) + 1)) as line_no, unnest(lns) as line from ({SQL_LINES}))
"""


def sql_chunks(max_bytes: int) -> str:
    return f"""
n as materialized ({SQL_NUMBERED}),
folded as (
  select project, path, line_no, strlen(numbered)::bigint as size, 0::bigint as chunk_no from n where line_no = 1
  union all
  select n.project, n.path, n.line_no,
    case when f.size + strlen(n.numbered) > {max_bytes} then strlen(n.numbered) else f.size + strlen(n.numbered) end,
    case when f.size + strlen(n.numbered) > {max_bytes} then f.chunk_no + 1 else f.chunk_no end
  from folded f join n on n.path = f.path and n.line_no = f.line_no + 1),
chunks as (
  select f.project, f.path, f.chunk_no, count(*) over (partition by f.project, f.path) as n_chunks,
    min(f.line_no) as first_line, max(f.line_no) as last_line, string_agg(n.numbered, '' order by f.line_no) as content
  from folded f join n on n.path = f.path and n.line_no = f.line_no
  group by f.project, f.path, f.chunk_no)
"""


def chunk_sql(select: str, max_bytes: int = CHUNK_BYTES) -> str:
    """A query over the chunks; the chunk views continue the WITH list."""
    return fx.with_views("", "code_files", recursive=True).rstrip() + "," + sql_chunks(max_bytes) + select


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.view(spark, sf_dir, "code_files").select("project", "path", "content")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.chunk_lines(_files(spark, sf_dir), CHUNK_BYTES)


@query(
    "select doc_id, project, path, n_lines from code_files where regexp_matches(path, "
    "'\\.(" + "|".join(tx.SOURCE_EXTENSIONS) + ")$')", "code_files",
)
def q_source_file_filter(spark, sf_dir):
    return tree.source_file_filter(fx.view(spark, sf_dir, "code_files")).select(
        "doc_id", "project", "path", F.col("n_lines").cast("bigint").alias("n_lines")
    )


@query("select doc_id, text as content from documents where doc_id % 17 <> 0")
def q_decode_text(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 17 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.lit("").cast("binary"))
    raw = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.encode("text", "UTF-8"), tail).alias("content")
    )
    return tree.decode_text(raw)


@query(f"select project, path, line_no, line from ({SQL_NUMBERED})", "code_files")
def q_split_lines(spark, sf_dir):
    return lines.split_lines(_files(spark, sf_dir))


@query(f"select project, path, line_no, numbered from ({SQL_NUMBERED})", "code_files")
def q_number_lines(spark, sf_dir):
    return lines.number_lines(lines.split_lines(_files(spark, sf_dir))).drop("line")


@query(chunk_sql("select * from chunks"))
def q_chunk_lines(spark, sf_dir):
    return _chunks(spark, sf_dir)


@query(chunk_sql("""
select c.project, c.path, c.chunk_no, c.path = l.m.path and c.chunk_no = l.m.chunk_no as is_last
from chunks c join (select project, max(struct_pack(path := path, chunk_no := chunk_no)) as m from chunks group by project) l
  on c.project = l.project"""))
def q_mark_last_chunk(spark, sf_dir):
    marked = lines.mark_last_chunk(_chunks(spark, sf_dir), _files(spark, sf_dir))
    return marked.select("project", "path", "chunk_no", "is_last")


# ---------------------------------------------------------------- completions and records

SQL_CLEAN = r"""
select *, trim(case when starts_with(f, '[') and ends_with(f, ']') then f[2:-2] else f end, chr(32) || chr(10)) as cleaned
from (select *, trim(case when starts_with(response, '```json' || chr(10)) and ends_with(response, '```')
  then response[9:-4] else response end, chr(32) || chr(10)) as f from completions)
"""
SQL_RECORDS = f"""
select doc_id, project, path, record_no, record from (
  select doc_id, project, path, unnest(range(0, len(x))) as record_no,
    rtrim(trim(unnest(x), chr(32)), ',') as record
  from (select *, string_split(cleaned, chr(10)) as x from ({SQL_CLEAN})))
where record <> ''
"""
SQL_PARSED = r"""
select doc_id, project, record_no, g.name as name, g.path as path,
  try_cast(g.s as bigint) as start_line, try_cast(g.e as bigint) as end_line
from (select *, regexp_extract(record, '\{\s*"([^"]+)",\s*"([^"]+)",\s*(\d+),\s*(\d+)\s*\}', ['name', 'path', 's', 'e']) as g
  from (""" + SQL_RECORDS + r""")) where g.name <> ''
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.explode_records(
        records.clean_completion(fx.view(spark, sf_dir, "completions"), "response").drop("response")
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_records(_records(spark, sf_dir))


@query("""
select doc_id, project, path, case when doc_id % 10 <> 0 then
  json_extract_string(to_json({choices: [{message: {role: 'assistant', content: response}}]}),
  '$.choices[0].message.content') end as content from completions""", "completions")
def q_completion_content(spark, sf_dir):
    message = F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content"))
    body = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    wrapped = fx.view(spark, sf_dir, "completions").withColumn(
        "response", F.when(F.col("doc_id") % 20 == 0, '{"error": "busy"}').when(F.col("doc_id") % 10 == 0, "not json")
        .otherwise(body)
    )
    return records.completion_content(wrapped).drop("response")


@query(f"select doc_id, project, path, cleaned from ({SQL_CLEAN})", "completions")
def q_clean_completion(spark, sf_dir):
    return records.clean_completion(fx.view(spark, sf_dir, "completions"), "response").drop("response")


@query(SQL_RECORDS, "completions")
def q_explode_records(spark, sf_dir):
    return _records(spark, sf_dir)


@query(SQL_PARSED, "completions")
def q_parse_records(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query(r"""
select project, first(name order by doc_id) as name, first(path order by doc_id) as path,
  first(s order by doc_id)::bigint as start_line, first(e order by doc_id)::bigint as end_line
from (select doc_id, project, unnest(regexp_extract(response, '\{\s*"([^"]+)",\s*"([^"]+)",\s*(\d+),\s*(\d+)\s*\}',
  ['name', 'path', 's', 'e'])) from completions) where name <> '' group by project""", "completions")
def q_seed_function(spark, sf_dir):
    return records.seed_function(fx.view(spark, sf_dir, "completions"), "response", ("doc_id",))


@query(f"select distinct project, path || ':' || name as key, path from ({SQL_PARSED})", "completions")
def q_function_index(spark, sf_dir):
    return records.function_index(_parsed(spark, sf_dir).drop("record_no"))


@query("select project, path, k, name, string_split(name, ':')[-1] as base_name from functions", "functions")
def q_base_name(spark, sf_dir):
    return records.with_base_name(fx.view(spark, sf_dir, "functions").select("project", "path", "k", "name"))


# ---------------------------------------------------------------- functions in files

SQL_CONTENT = f"""
select r.*, case when r.start_line >= 1 and r.start_line <= r.end_line and r.end_line <= len(l.lns)
  then array_to_string(l.lns[r.start_line:r.end_line], chr(10)) end as content
from %s r left join ({SQL_LINES}) l on l.project = r.project and l.path = r.path
"""


@query(
    "select project, path, name, start_line, end_line, content, case when content is null then 'bad_range' else 'ok' end "
    f"as status from ({SQL_CONTENT % 'functions'})", "functions",
)
def q_function_content(spark, sf_dir):
    wanted = fx.view(spark, sf_dir, "functions").select("project", "path", "name", "start_line", "end_line")
    return code.function_content(wanted, _files(spark, sf_dir))


@query(
    f"select project, path, name, start_line, end_line, content from ({SQL_CONTENT % ('(' + SQL_PARSED + ')')}) "
    "where content is not null", "completions",
)
def q_code_functions(spark, sf_dir):
    return code.code_functions(_parsed(spark, sf_dir), _files(spark, sf_dir))


@query("""
select project, path, name, start_line, end_line, record_no::bigint as record_no, 'found' as status from (
  select project, path, 'top_' || doc_id as name, 2 as start_line, n_lines + 3 as end_line, 0 as record_no
    from source_code where doc_id % 2 = 0
  union all select project, path, 'C' || doc_id || ':m_' || doc_id, n_lines + 7, n_lines + 9, 1 from source_code where doc_id % 2 = 0
  union all select project, path, 'C' || doc_id || ':last_' || doc_id, n_lines + 11, n_lines + 12, 2 from source_code where doc_id % 2 = 0
  union all select project, path, 'top_' || doc_id, 2, n_lines + 5, 0 from source_code where doc_id % 2 = 1
  union all select project, path, 'C' || doc_id || ':m_' || doc_id, n_lines + 8, n_lines + 10, 1 from source_code where doc_id % 2 = 1)
""", "source_code")
def q_detect_functions(spark, sf_dir):
    return detect.detect_functions(fx.view(spark, sf_dir, "source_code"))


# ---------------------------------------------------------------- reviews and routing

SQL_REVIEW = r"""
select *, len(q)::bigint as n_parts, coalesce(trim(q[2], chr(32) || chr(10)), 'Unknown') as severity,
  coalesce(trim(q[3], chr(32) || chr(10)), 'No review provided') as review, trim(q[4], chr(32) || chr(10)) as continue_flag,
  trim(q[5], chr(32) || chr(10)) as next_name, trim(q[6], chr(32) || chr(10)) as next_path
from (select *, string_split(trim(trim(trim(review_message, '{'), '}'), chr(32) || chr(10)), '``') as q from %s)
"""
SQL_INDEX = "select distinct project, path || ':' || name as key, path from %s"


def sql_signal(source: str, row_key: str) -> str:
    """All (record, candidate key) pairs ranked by preference, reduced to the best one."""
    return f"""
p as materialized ({SQL_REVIEW % source}),
idx as materialized ({SQL_INDEX % source}),
cand as materialized (
  select p.project, {row_key}, 0 as rk, i.key, i.path as key_path from p
    join idx i on i.project = p.project and i.key = p.next_path || ':' || p.next_name
  union all
  select p.project, {row_key}, 1, i.key, i.path from p
    join idx i on i.project = p.project and ends_with(i.key, ':' || p.next_name)),
best as (select project, {row_key}, min(struct_pack(rk := rk, key := key, path := key_path)) as b
  from cand group by project, {row_key}),
signals as (
  select p.* exclude (q, next_path),
    case when p.n_parts < 6 then 'malformed' when p.continue_flag <> '1' then 'done'
      when b.b.rk = 0 then 'exact' when b.b.rk = 1 then 'suffix' else 'not_found' end as status,
    case when p.n_parts >= 6 and p.continue_flag = '1' then b.b.key end as key,
    case when p.n_parts >= 6 and p.continue_flag = '1' and b.b.key is not null then p.next_name end as next_key,
    case when p.n_parts >= 6 and p.continue_flag = '1' then b.b.path end as next_path
  from p left join best b using (project, {row_key}))
"""


def signal_sql(select: str, source: str = "reviews", row_key: str = "doc_id, k", recursive: bool = False) -> str:
    return fx.with_views("", source, recursive=recursive).rstrip() + "," + sql_signal(source, row_key) + select


def _reviews(spark: SparkSession, sf_dir: str, name: str = "reviews") -> DataFrame:
    return fx.view(spark, sf_dir, name)


@query(
    "select project, path, doc_id, k, severity, review, continue_flag, next_name, next_path, n_parts "
    f"from ({SQL_REVIEW % 'reviews'})", "reviews",
)
def q_parse_reviews(spark, sf_dir):
    return reviews.parse_reviews(_reviews(spark, sf_dir)).drop("name", "start_line", "end_line", "review_message")


SQL_LABEL = (
    "case severity " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in tx.SEVERITY_SPANS.items())
    + f" else {quoted(tx.SEVERITY_UNKNOWN)} end"
)
SQL_DISPLAY = "case when contains(name, ':') then string_split(name, ':')[2] else name end"


@query(f"select doc_id, k, severity, {SQL_LABEL} as label from ({SQL_REVIEW % 'reviews'})", "reviews")
def q_severity_label(spark, sf_dir):
    return reviews.parse_reviews(_reviews(spark, sf_dir)).select(
        "doc_id", "k", "severity", tx.severity_label(F.col("severity")).alias("label")
    )


@query(f"select doc_id, k, name, {SQL_DISPLAY} as display_name from functions", "functions")
def q_display_name(spark, sf_dir):
    return fx.view(spark, sf_dir, "functions").select(
        "doc_id", "k", "name", tx.display_name(F.col("name")).alias("display_name")
    )


def _pick(df: DataFrame) -> DataFrame:
    return df.select("project", "doc_id", "k", "next_name", "key", "key_path")


@query(signal_sql("""select p.project, p.doc_id, p.k, p.next_name, c.key, c.key_path
from p join cand c using (project, doc_id, k) where c.rk = 0"""))
def q_next_exact(spark, sf_dir):
    source = _reviews(spark, sf_dir)
    return _pick(reviews.next_exact(reviews.parse_reviews(source), records.function_index(source)))


@query(signal_sql("""select p.project, p.doc_id, p.k, any_value(p.next_name) as next_name, min(c.key) as key,
arg_min(c.key_path, c.key) as key_path from p join cand c using (project, doc_id, k) where c.rk = 1 group by all"""))
def q_next_by_suffix(spark, sf_dir):
    source = _reviews(spark, sf_dir)
    return _pick(reviews.next_by_suffix(reviews.parse_reviews(source), records.function_index(source)))


@query(signal_sql("select project, doc_id, k, status, key, next_key, next_path from signals"))
def q_next_signal(spark, sf_dir):
    source = _reviews(spark, sf_dir)
    routed = reviews.next_signal(reviews.parse_reviews(source), records.function_index(source))
    return routed.select("project", "doc_id", "k", "status", "key", "next_key", "next_path")


def _walk_signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    source = _reviews(spark, sf_dir, "walk_reviews")
    index = records.function_index(source)
    return source, index, reviews.next_signal(reviews.parse_reviews(source).drop("name", "path"), index)


@query(signal_sql("""
select s.project, s.record_no, s.next_key, s.next_path, arg_min(r.record_no, r.rank) as found_record_no,
  arg_min(r.name, r.rank) as found_name
from (select * from signals where key is not null) s left join lateral (
  select w.record_no, w.name, case when w.name = s.next_key then 0 else 1000000000000 end + w.record_no as rank
  from walk_reviews w where w.project = s.project and w.path = s.next_path
    and string_split(w.name, ':')[-1] = string_split(s.next_key, ':')[-1]) r on true
group by all""", "walk_reviews", "record_no"))
def q_find_function(spark, sf_dir):
    source, _, signals = _walk_signals(spark, sf_dir)
    asked = signals.filter(F.col("key").isNotNull()).select("project", "record_no", "next_key", "next_path")
    return code.find_function(asked, source)


@query(signal_sql("""select i.* from idx i
where not exists (select 1 from signals s where s.project = i.project and s.key = i.key)""", "walk_reviews", "record_no"))
def q_remaining_functions(spark, sf_dir):
    _, index, signals = _walk_signals(spark, sf_dir)
    return reviews.remaining_functions(index, signals.filter(F.col("key").isNotNull()))


@query(signal_sql("""
,f as materialized (select c.*, p.next_name, (
    select arg_min(w.record_no, case when w.name = p.next_name then 0 else 1000000000000 end + w.record_no)
    from walk_reviews w where w.project = c.project and w.path = c.key_path
      and string_split(w.name, ':')[-1] = string_split(p.next_name, ':')[-1]) as found
  from cand c join p using (project, record_no) where p.n_parts >= 6 and p.continue_flag = '1'),
visit as (
  select project, 0::bigint as step, min(record_no) as record_no, []::varchar[] as taken from walk_reviews group by project
  union all
  select v.project, v.step + 1, n.found, list_append(v.taken, n.key) from visit v, lateral (
    select found, key from f where f.project = v.project and f.record_no = v.record_no
      and not list_contains(v.taken, f.key) order by rk, key limit 1) n where n.found is not null)
select project, step, record_no from visit""", "walk_reviews", "record_no", recursive=True))
def q_review_walk(spark, sf_dir):
    return walk.review_walk(_reviews(spark, sf_dir, "walk_reviews"))


@query("select project, name, path, start_line, end_line, review_message from reviews", "reviews")
def q_archive_reviews(spark, sf_dir):
    return reviews.archive_reviews(_reviews(spark, sf_dir))


# ---------------------------------------------------------------- reports

SQL_ERROR = "'Error: Failed to get metadata: '"
SQL_PATH_PARTS = "list_filter(string_split(path, '/'), lambda x: x not in ('', '.', '..'))"
SQL_REPORT_PATH = (
    r"'review_output/' || regexp_replace(array_to_string(" + SQL_PATH_PARTS + r", '/'), '([^/])\.[^./]*$', '\1') || '.md'"
)
SQL_MODIFIED = (
    f"coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), {SQL_ERROR} || path)"
)
SQL_SECTIONS = f"""
select r.*, {SQL_REPORT_PATH} as report_path,
  '## Function: `' || {SQL_DISPLAY} || '`' || chr(10) || chr(10)
  || '| **Aspect**        | **Details** |' || chr(10) || '|-------------------|------------|' || chr(10)
  || '| **Severity**      | ' || {SQL_LABEL} || ' |' || chr(10)
  || '| **Description**   | ' || review || ' |' || chr(10)
  || '| **File Location** | ' || path || ' (Lines ' || start_line || '-' || end_line || ') |' || chr(10)
  || '| **Last Modified** | ' || {SQL_MODIFIED} || ' |' || chr(10) as section
from ({SQL_REVIEW % 'reviews'}) r left join orders on o_orderkey = doc_id
"""
SQL_REPORTS = f"""
select report_path, string_agg(section, chr(10) || '---' || chr(10) || chr(10) order by doc_id, k) as markdown
from ({SQL_SECTIONS}) group by report_path
"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the time of their file, for which an order date stands in."""
    dated = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("modified"))
    seen = fx.view(spark, sf_dir, "code_files").join(dated, "doc_id").select("project", "path", "modified")
    return reports.with_modified_time(_reviews(spark, sf_dir), seen)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.render_markdown(_labelled(spark, sf_dir))


@query(f"""
select o_orderkey, coalesce(strftime(modified, '%Y-%m-%d %H:%M:%S'), {SQL_ERROR} || '/orders/' || o_orderkey) as modified_label
from (select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderdate end as modified from orders)""")
def q_modified_time_label(spark, sf_dir):
    dated = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("/orders/"), "o_orderkey").alias("path"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("modified"),
    )
    return reports.modified_time_label(dated).select("o_orderkey", "modified_label")


@query(f"select project, path, doc_id, k, section from ({SQL_SECTIONS})", "reviews")
def q_render_markdown(spark, sf_dir):
    return _sections(spark, sf_dir).select("project", "path", "doc_id", "k", "section")


# The same text in both engines: names with several, leading and no dots, and parts to leave out.
ODD_PATHS = """
select doc_id, case doc_id % 6 when 0 then concat('//srv/./', source, '/../f', doc_id, '.tar.gz')
  when 1 then concat('/', source, '/d.x/Makefile') when 2 then concat('/', source, '/.bashrc')
  when 3 then concat(source, '/f', doc_id, '.') when 4 then concat('/', source, '/..conf', doc_id, '.d/x..y')
  else concat('/repo/', source, '/f', doc_id, '.py') end as path from documents
"""


@query(f"select doc_id, path, {SQL_REPORT_PATH} as report_path from ({ODD_PATHS})")
def q_report_path(spark, sf_dir):
    return reports.with_report_path(fx.derive(spark, sf_dir, ODD_PATHS))


@query(f"select report_path, 0::bigint as part_no, markdown from ({SQL_REPORTS})", "reviews")
def q_assemble_reports(spark, sf_dir):
    return reports.assemble_reports(_sections(spark, sf_dir), ["doc_id", "k"])


# ---------------------------------------------------------------- prompts and the model


def sql_settings(system: str, tokens: int) -> str:
    return f"{quoted(system)} as system, {tokens}::bigint as max_tokens, 0.0::double as temperature"


SQL_EXTRACT = f"{quoted(tp.EXTRACT_HEAD)} || path || {quoted(tp.EXTRACT_MIDDLE)} || content"


def sql_parts(rows: str, keys: str, order: str) -> str:
    """Texts cut into parts by the weight of what stands before them."""
    return f"""
select {keys}, part_no, string_agg(text, '' order by {order}, text) as text from (
  select *, coalesce(sum(strlen(text) + {ROW_BYTES}) over (partition by {keys} order by {order}, text
    rows between unbounded preceding and 1 preceding), 0)::bigint // {PART_BYTES} as part_no from ({rows}))
group by {keys}, part_no
"""


SQL_SEED_ROWS = f"""
select project, 1 as rank, doc_id, record_no, record || chr(10) as text from ({SQL_RECORDS})
union all select distinct project, 0, null, null, {quoted(tp.SEED_HEAD)} from completions
"""
SQL_SEED_PARTS = sql_parts(SQL_SEED_ROWS, "project", "rank, doc_id, record_no")


@query(chunk_sql(f"select project, path, chunk_no, n_chunks, first_line, last_line, {SQL_EXTRACT} as prompt, "
                 f"{sql_settings(tp.EXTRACT_SYSTEM, tp.EXTRACT_TOKENS)} from chunks"))
def q_extract_prompt(spark, sf_dir):
    return prompts.extract_prompt(_chunks(spark, sf_dir))


@query(f"select project, part_no, text, {sql_settings(tp.SEED_SYSTEM, tp.SEED_TOKENS)} from ({SQL_SEED_PARTS})", "completions")
def q_seed_prompt(spark, sf_dir):
    return prompts.seed_prompt(_records(spark, sf_dir), ["doc_id", "record_no"], PART_BYTES)


def digest_model(texts: list[str], settings: list[dict]) -> list:
    """A stand-in for the model that answers with a digest of its prompt and settings and refuses some."""
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()

    def one(text: str, given: dict):
        if digest(text).startswith("0"):
            return ValueError("refused")
        content = f"{len(text)}:{digest(text)}:{digest(given['system'])}:{given['max_tokens']}:{given['temperature']:g}"
        return json.dumps({"choices": [{"message": {"content": content}}]}, separators=(",", ":"))

    return [one(t, s) for t, s in zip(texts, settings)]


def sql_digest(system: str, tokens: int) -> str:
    """What ``digest_model`` answers to ``prompt``."""
    settings = f"{hashlib.md5(system.encode()).hexdigest()}:{tokens}:{tp.TEMPERATURE:g}"
    return f"length(prompt) || ':' || md5(prompt) || ':{settings}'"


@query(chunk_sql(f"""
select project, path, chunk_no, case when left(md5(prompt), 1) <> '0' then
  '{{"choices":[{{"message":{{"content":"' || {sql_digest(tp.EXTRACT_SYSTEM, tp.EXTRACT_TOKENS)} || '"}}}}]}}' end as response,
  case when left(md5(prompt), 1) = '0' then 'refused' end as error
from (select *, {SQL_EXTRACT} as prompt from chunks)""", 2048))
def q_complete_prompts(spark, sf_dir):
    asked = prompts.extract_prompt(lines.chunk_lines(_files(spark, sf_dir), 2048))
    return model.complete_prompts(asked.select("project", "path", "chunk_no", "prompt", *model.SETTINGS), digest_model)


def _due(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first function of each project, and the keys of all."""
    source = fx.view(spark, sf_dir, "functions")
    first = source.groupBy("project").agg(F.min(F.struct("doc_id", "k", "path", "name", "start_line", "end_line")).alias("s"))
    due = first.select("project", "s.path", "s.name", "s.start_line", "s.end_line")
    return code.code_functions(due, _files(spark, sf_dir)), records.function_index(source)


SQL_DUE = f"""
select project, path, name, start_line, end_line, content from ({SQL_CONTENT % '''(
  select project, s.path as path, s.name as name, s.start_line as start_line, s.end_line as end_line from (
    select project, min(struct_pack(d := doc_id, k := k, path := path, name := name, start_line := start_line, end_line := end_line)) as s
    from functions group by project))'''}) where content is not null
"""
SQL_REVIEW_ROWS = f"""
select project, path, name, start_line, end_line, 0 as rank, null as key,
  {quoted(tp.REVIEW_HEAD)} || content || {quoted(tp.REVIEW_PATH)} || path || {quoted(tp.REVIEW_LIST)} as text from due
union all select d.project, d.path, d.name, d.start_line, d.end_line, 1, i.key, i.key || chr(10)
  from due d join ({SQL_INDEX % 'functions'}) i on i.project = d.project
union all select project, path, name, start_line, end_line, 2, null, {quoted(tp.REVIEW_TAIL)} from due
"""
SQL_FUNCTION_KEY = "project, path, name, start_line, end_line"
SQL_DUE_VIEW = fx.with_views("", "functions").rstrip() + f", due as materialized ({SQL_DUE})"


@query(SQL_DUE_VIEW + f"select *, {sql_settings(tp.REVIEW_SYSTEM, tp.REVIEW_TOKENS)} from "
       f"({sql_parts(SQL_REVIEW_ROWS, SQL_FUNCTION_KEY, 'rank, key')})")
def q_review_prompt(spark, sf_dir):
    return prompts.review_prompt(*_due(spark, sf_dir), PART_BYTES)


@query(SQL_DUE_VIEW + f"""
select {SQL_FUNCTION_KEY}, case when left(md5(prompt), 1) <> '0' then {sql_digest(tp.REVIEW_SYSTEM, tp.REVIEW_TOKENS)} end as review_message,
  case when left(md5(prompt), 1) = '0' then 'refused' end as error
from (select {SQL_FUNCTION_KEY}, string_agg(text, '' order by rank, key) as prompt from ({SQL_REVIEW_ROWS}) group by all)""")
def q_review_functions(spark, sf_dir):
    return model.review_functions(*_due(spark, sf_dir), digest_model)


# ---------------------------------------------------------------- files and streams

SQL_TREE = "select path[2:] as path, strlen(content)::bigint as length, content from code_files"


def _write_tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a source tree in the shared folder."""
    root = posix_path(run_dir(spark, "tree"))
    sinks.write_reports(
        _files(spark, sf_dir).select(
            F.substring("path", 2, 1 << 20).alias("report_path"), F.lit(0).cast("bigint").alias("part_no"),
            F.col("content").alias("markdown"),
        ), root,
    )
    return root


def _below(root: str, path: str = "path"):
    return F.substring(path, len(root) + 2, 1 << 20)


def _report_texts(spark: SparkSession, root: str) -> DataFrame:
    return tree.decode_text(tree.source_tree_scan(spark, root)).select(
        _below(root).alias("report_path"), F.col("content").alias("markdown")
    )


@query(SQL_TREE, "code_files")
def q_source_tree_scan(spark, sf_dir):
    root = _write_tree(spark, sf_dir)
    return tree.source_tree_scan(spark, root).select(
        _below(root).alias("path"), "length", F.col("content").cast("string").alias("content")
    )


@query(f"select record from ({SQL_RECORDS})", "completions")
def q_append_records(spark, sf_dir):
    store = run_dir(spark, "records")
    rows = _records(spark, sf_dir)
    sinks.append_records(rows.filter(F.col("doc_id") % 2 == 0), store, "even")
    sinks.append_records(rows.filter(F.col("doc_id") % 2 == 1), store, "odd")
    return spark.read.text(store).select(F.col("value").alias("record"))


@query(f"select project, name, path, start_line, end_line from ({SQL_PARSED})", "completions")
def q_read_record_file(spark, sf_dir):
    store = run_dir(spark, "records")
    rows = _records(spark, sf_dir)
    for run, rest in (("even", 0), ("odd", 1)):
        sinks.append_records(rows.filter(F.col("doc_id") % 2 == rest), store, run, ("doc_id", "record_no"))
    return records.parse_records(record_store.read_records(spark, store)).select("project", "name", "path", "start_line", "end_line")


@query("select unnest(string_split(review_message, chr(10))) as line from reviews", "reviews")
def q_append_review_log(spark, sf_dir):
    log = run_dir(spark, "log")
    rows = _reviews(spark, sf_dir)
    sinks.append_review_log(rows.filter(F.col("k") == 0), log)
    sinks.append_review_log(rows.filter(F.col("k") != 0), log)
    return spark.read.text(log).select(F.col("value").alias("line"))


@query(f"select 'Key: ' || key || ' | Value: ' || path as line from ({SQL_INDEX % 'functions'})", "functions")
def q_dump_index(spark, sf_dir):
    dump = run_dir(spark, "index")
    sinks.dump_index(records.function_index(fx.view(spark, sf_dir, "functions")), dump)
    return spark.read.text(dump).select(F.col("value").alias("line"))


@query(SQL_REPORTS, "reviews")
def q_write_reports(spark, sf_dir):
    root = posix_path(run_dir(spark, "reports"))
    sinks.write_reports(reports.assemble_reports(_sections(spark, sf_dir), ["doc_id", "k"], PART_BYTES), root)
    return _report_texts(spark, root)


@query(chunk_sql("select path[2:] as path, chunk_no, first_line, last_line, content from chunks where regexp_matches(path, "
                 "'\\.(" + "|".join(tx.SOURCE_EXTENSIONS) + ")$')"))
def q_stream_source_chunks(spark, sf_dir):
    root, out = _write_tree(spark, sf_dir), run_dir(spark, "chunks")
    stream = flows.stream_source_chunks(spark, root, CHUNK_BYTES).select(
        _below(root).alias("path"), "chunk_no", "first_line", "last_line", "content"
    )
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}.state").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(SQL_REPORTS, "reviews")
def q_stream_reviews_to_reports(spark, sf_dir):
    root, state = posix_path(run_dir(spark, "reports")), run_dir(spark, "report-state")
    source = run_dir(spark, "archived")
    rows = _labelled(spark, sf_dir)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    flow = flows.stream_reviews_to_reports(stream, root, state, ["doc_id", "k"])
    flow.trigger(availableNow=True).option("checkpointLocation", f"{state}.offsets").start().awaitTermination()
    return _report_texts(spark, root)


@query(signal_sql("""
,line as materialized (
  select p.project, p.record_no, p.n_parts, p.continue_flag, p.next_name,
    row_number() over (partition by p.project order by p.record_no) as pos,
    coalesce((select list(c.key order by c.rk, c.key) from cand c where c.project = p.project and c.record_no = p.record_no
      and p.n_parts >= 6 and p.continue_flag = '1'), []) as keys,
    p.next_path || ':' || p.next_name as probe
  from p),
serve as (
  select project, 0::bigint as pos, []::varchar[] as taken, null::varchar as key from (select distinct project from line)
  union all
  select l.project, l.pos, case when l.pick is null then l.taken else list_append(l.taken, l.pick) end, l.pick from (
    select l.*, s.taken, list_filter(l.keys, lambda x: not list_contains(s.taken, x))[1] as pick
    from serve s join line l on l.project = s.project and l.pos = s.pos + 1) l)
select l.project, l.record_no as seq, case when n_parts < 6 then 'malformed' when continue_flag <> '1' then 'done'
    when s.key = probe then 'exact' when s.key is not null then 'suffix' else 'not_found' end as status,
  s.key, case when s.key is not null then l.next_name end as next_key, i.path as next_path
from serve s join line l using (project, pos) left join idx i on i.project = s.project and i.key = s.key
""", "walk_reviews", "record_no", recursive=True))
def q_stream_review_state(spark, sf_dir):
    source, out = run_dir(spark, "messages"), run_dir(spark, "signals")
    rows = _reviews(spark, sf_dir, "walk_reviews")
    index = materialize(records.function_index(rows), "index")
    sent = rows.select("project", F.col("record_no").alias("seq"), "review_message")
    sent.write.parquet(source)
    flow = flows.stream_review_state(spark.readStream.schema(sent.schema).parquet(source), index, out)
    flow.trigger(availableNow=True).option("checkpointLocation", f"{out}.offsets").start().awaitTermination()
    return spark.read.parquet(f"{out}/signals").drop("batch")
