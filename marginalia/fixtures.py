"""Files, functions, completions and reviews derived from the ``documents`` table.

The text of every view is the same in Spark and DuckDB, so a query and its oracle start from equal
rows; only making three rows of one is written differently, so that Spark explodes and does not
join. The views only derive; nothing is generated outside the given tables.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "code_files": """
select doc_id, source as project,
  concat('/repo/', source, '/f', doc_id, '.', case doc_id % 8 when 0 then 'py' when 1 then 'rs' when 2 then 'js'
    when 3 then 'tsx' when 4 then 'PY' when 5 then 'md' when 6 then 'h' else 'go' end) as path,
  text as content,
  length(text) - length(replace(text, chr(10), '')) + 1 as n_lines
from documents
""",
    "functions": """
select project, path, doc_id, k.k as k,
  concat(case when doc_id % 3 = 0 then 'Cls:' else '' end, 'fn_', doc_id, '_', k.k) as name,
  cast(3 * k.k + 1 as bigint) as start_line,
  cast(case when doc_id % 13 = 0 and k.k = 1 then n_lines + 5 else least(3 * k.k + 3, n_lines) end as bigint) as end_line
from code_files join (values (0), (1), (2)) as k(k) on 3 * k.k < n_lines
""",
    "completions": """
select doc_id, project, path,
  concat(case when doc_id % 2 = 0 then concat('```json', chr(10)) else '' end,
    case when doc_id % 3 = 0 then concat('[', chr(10)) else '' end,
    '  {"fn_', doc_id, '_0", "', path, '", 1, 3},', chr(10), chr(10),
    '{"Cls:fn_', doc_id, '_1","', path, '",4,6},,', chr(10),
    case when doc_id % 5 = 0 then concat('note: not a record', chr(10)) else '' end,
    case when doc_id % 3 = 0 then ']' else '' end,
    case when doc_id % 2 = 0 then '```' else '' end) as response
from code_files
""",
    "reviews": """
select project, path, doc_id, k, name, start_line, end_line,
  case when doc_id % 11 = 0 then concat('{', name, '``1``short}')
  else concat('{', name, '``', doc_id % 5, ' `` step ', k, ' of ', project, ' ``',
    case when doc_id % 29 = 0 then 0 else 1 end, '``',
    case when doc_id % 4 = 0 then concat('fn_', doc_id, '_', (k + 1) % 3) else name end, '``',
    case when doc_id % 2 = 0 then path else '/nowhere.py' end, '}',
    case when doc_id % 7 = 0 then chr(10) else '' end) end as review_message
from functions
""",
    "walk_reviews": """
select concat('p', p) as project, concat('/repo/p', p, '/f', doc_id % 3, '.py') as path, doc_id as record_no,
  concat(case when doc_id % 3 = 0 then 'Cls:' else '' end,
    case when doc_id % 7 = 0 then 'main' else concat('fn_', doc_id) end) as name,
  case when doc_id % 143 = 142 then concat('{fn_', doc_id, '``2``short}')
  else concat('{fn_', doc_id, '``', doc_id % 5, '``step ', doc_id, '``', case when doc_id % 97 = 96 then 0 else 1 end, '``',
    case when nd % 7 = 0 then 'main' else concat('fn_', nd) end, '``',
    case when doc_id % 2 = 0 then concat('/repo/p', p, '/f', nd % 3, '.py') else '/nowhere.py' end, '}') end as review_message
from (select doc_id, doc_id % 20 as p,
    case when doc_id % 41 = 40 then doc_id - 20 else doc_id + 20 * (1 + doc_id % 3) end as nd
  from documents)
""",
    # Code around the text of each document, which becomes comment lines inside the first function.
    "source_code": """
select doc_id, source as project, n_lines,
  concat('/repo/', source, '/s', doc_id, case when doc_id % 2 = 0 then '.py' else '.rs' end) as path,
  case when doc_id % 2 = 0 then concat(
    'import os', chr(10), 'def top_', doc_id, '(a):', chr(10),
    '    # ', replace(text, chr(10), concat(chr(10), '    # ')), chr(10),
    '    return ', doc_id, chr(10), chr(10), '# trailing comment', chr(10),
    'class C', doc_id, ':', chr(10), '    def m_', doc_id, '(self):', chr(10),
    '        if self:', chr(10), '            return 1', chr(10), chr(10),
    '    async def last_', doc_id, '(self):', chr(10), '        return 2', chr(10))
  else concat(
    'struct S;', chr(10), 'pub fn top_', doc_id, '(a: i32)', chr(10), '{', chr(10),
    '    // ', replace(text, chr(10), concat(chr(10), '    // ')), chr(10),
    '    return ', doc_id, ';', chr(10), '}', chr(10), chr(10),
    'impl C', doc_id, ' {', chr(10), '    fn m_', doc_id, '(&self) -> i32 {', chr(10),
    '        if true { 1 } else { 2 }', chr(10), '    }', chr(10), '}', chr(10)) end as content
from (select *, length(text) - length(replace(text, chr(10), '')) + 1 as n_lines from documents)
""",
}

THREE_ROWS = "join (values (0), (1), (2)) as k(k) on 3 * k.k < n_lines"
THREE_ROWS_SPARK = "lateral view explode(array(0, 1, 2)) k as k where 3 * k.k < n_lines"

_NEEDS = {"functions": ["code_files"], "completions": ["code_files"], "reviews": ["code_files", "functions"]}


def with_views(query: str, *views: str, documents: str | None = None, recursive: bool = False) -> str:
    """Put the views a query uses in front of it, as a WITH list."""
    names: list[str] = []
    for view in views:
        names += [n for n in (*_NEEDS.get(view, []), view) if n not in names]
    parts = [f"{n} as ({VIEWS[n].strip()})" for n in names]
    if documents:
        parts.insert(0, f"documents as (select * from {documents})")
    return f"with {'recursive ' if recursive else ''}" + ", ".join(parts) + "\n" + query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One that comes in fewer pieces than there are cores is dealt out by its first column."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, df.columns[0])


def derive(spark: SparkSession, sf_dir: str, query: str, *views: str) -> DataFrame:
    """A query over ``documents`` of ``sf_dir`` and the views named."""
    source = "documents_" + hashlib.md5(sf_dir.encode()).hexdigest()
    table(spark, sf_dir, "documents").createOrReplaceTempView(source)
    return spark.sql(with_views(query, *views, documents=source).replace(THREE_ROWS, THREE_ROWS_SPARK))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark, sf_dir, f"select * from {name}", name)
