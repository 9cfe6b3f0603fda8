"""Finding functions without a model.

Each file is scanned in place by a fold over its lines, so nothing is shuffled. It is a heuristic: headers are
recognised by pattern, and braces, parentheses, keywords or indentation close them. Strings and comments are
emptied in the whole text before it is split, so that what they hold over any number of lines is not read as code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_NOT_CONTROL = r"(?!(?:if|for|while|switch|catch|return|else|do|function|new|throw|case|await|typeof|sizeof)\b)"
# Every repeated group is bounded, so that no line can make matching deep or slow.
_C_FUNCTION = (
    r"^\s*(?:[A-Za-z_@][\w:<>,\[\]@~?.]*[\s*&]+){1,12}" + _NOT_CONTROL
    + r"((?:" + _NAME + r"::){0,8}~?" + _NAME + r")\s*\([^;{]*(?:\{.*)?$"
)
_JS_FUNCTION = (
    r"^\s*(?:(?:export|default|async|static|public|private|protected|readonly|override|get|set)\s+){0,6}"
    r"(?:function\b\s*\*?\s*"
    r"|(?:const|let|var)\s+(?=[\w$]+\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|\w+\s*=>))"
    r"|(?=[\w$#]+\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*){0,20}\)[^;()]*\{))" + _NOT_CONTROL + r"([\w$#]+)"
)
_CLASS = (
    r"^\s*(?:(?:export|default|abstract|public|private|protected|final|static|sealed|data|open|internal|inner)\s+){0,6}"
)

# How strings and comments look, by language. A comment is one that begins with a mark of _COMMENTS.
_LINE_STRINGS = r""""[^"\n]*+"|'[^'\n]*+'"""
_C_COMMENTS = r"//[^\n]*+|/\*(?s:.*?)\*/|/\*(?s:.*)\z"
_HASH = r"(?<![$\w{])#[^\n]*+"
_TEXT_BLOCK = r'"{3}(?s:.*?)"{3}'
_CHARACTER = r"'[^'\n]{1,2}'"
TOKENS = {
    "//": _C_COMMENTS + "|" + _TEXT_BLOCK + r'|"[^"\n]*+"|' + _CHARACTER,
    "rs": _C_COMMENTS + r'|r#"(?s:.*?)"#|"[^"]*+"|' + _CHARACTER,
    "js": _C_COMMENTS + "|`[^`]*+`|" + _LINE_STRINGS,
    "go": _C_COMMENTS + r'|`[^`]*+`|"[^"\n]*+"|' + _CHARACTER,
    "php": _C_COMMENTS + "|" + _HASH + "|" + _LINE_STRINGS,
    "#": _HASH + "|" + _LINE_STRINGS,
    "py": _TEXT_BLOCK + r"|'{3}(?s:.*?)'{3}|#[^\n]*+|" + _LINE_STRINGS,
    "rb": r"(?m:^)=begin\b(?s:.*?)\n=end\b|" + _HASH + "|" + _LINE_STRINGS,
    "pas": r"\{[^}]*+\}|\(\*(?s:.*?)\*\)|//[^\n]*+|'[^'\n]*+'",
    "f90": r"![^\n]*+|" + _LINE_STRINGS,
    "cbl": r"(?m:^)(?:.{6})?[ \t]*\*[^\n]*+|\*>[^\n]*+|" + _LINE_STRINGS,
    "lisp": r';[^\n]*+|#\|(?s:.*?)\|#|"[^"]*+"',
}
_COMMENTS = r"^(?:[ \t0-9]*\*|//|/\*|#|=begin|\{|\(\*|!|;)"
# Languages in which a backslash is a character like others.
_NO_ESCAPES = ("pas", "f90", "cbl")

# Extensions by family: how a function and its container start, and the key of their strings and comments.
INDENT_FAMILY = {
    "py": (r"^\s*(?:async\s+)?def\s+(\w+)\s*[(\[]", r"^\s*class\s+(\w+)\s*[(\[:]", "py"),
    # Paragraphs and sections of the procedure division; their statements stand further in.
    "cbl": (r"(?i)^\s*(?!(?:exit|goback|continue|end|stop|declaratives|file-control|i-o-control|special-names|repository|file|working-storage"
            r"|local-storage|linkage|report|screen|communication|input-output|configuration|source-computer|object-computer|end-[\w-]+)\b(?!-))"
            r"([A-Za-z0-9][\w-]*)(?:\s+section)?\s*\.\s*$", None, "cbl"),
}
# Blocks by keywords: how a function and its container start, strings and comments, what opens a block, what closes one, and
# lines at which functions that are only declared are forgotten.
_F90_KINDS = r"(?:if|do|select|where|forall|associate|block|critical|enum|interface|module|submodule|program|subroutine|function|type|procedure)"
_F90_BEFORE = (r"(?:(?:recursive|pure|elemental|impure|module|integer|real|logical|complex|character|double\s+precision|type)\b"
               r"(?:\s*\([^)]*\)|\s*\*\s*\d+)?\s*){0,5}")
KEYWORD_FAMILY = {
    "rb": (r"^\s*(?:(?:private|protected|public|module_function)\s+)?def\s++(?![^\s(;]+(?:\([^)]*\))?\s+=\s)(?:\w+\.)?([A-Za-z_]\w*[?!=]?|[+\-*/<>=!~%&|^\[\]]+)",
           r"^\s*(?:class|module)\s+(?:\w+::){0,8}(\w+)", "rb",
           r"(?:^|[;=(]|\|\||&&)\s*(?:if|unless|while|until|for|case|begin|class|module)\b(?!:)"
           r"|(?:^\s*|\s)def\s++(?![^\s(;]+(?:\([^)]*\))?\s+=\s)|^(?!\s*(?:while|until|for)\b).*\bdo\b(?!:)",
           r"(?<![.:@$\w])end\b(?![:?!=])", "(?!)"),
    "pas": (r"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor|operator)\s+(?:\w+\.)?(\w+)(?!.*;\s*(?:forward|external)\b)",
            r"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor|operator)\s+(\w+)\.", "pas",
            r"(?i)\b(?:begin|case|try|asm)\b|=\s*(?:packed\s+)?(?:record|object|interface|class(?!\s+of\b))\b(?!\s*(?:\([^)]*\))?\s*;)", r"(?i)\bend\b",
            r"(?i)^\s*(?:implementation|initialization|finalization)\b"),
    "f90": (r"(?i)^\s*+(?!end\b)" + _F90_BEFORE + r"(?:subroutine|function)\s+(\w+)", None, "f90",
            r"(?i)^\s*+(?!end)(?!else)(?:\w+\s*:\s*)?(?:do\b(?!\s*=)|select\s+(?:case|type)\b|associate\s*\(|block\s*$|critical\s*$|enum\s*,|interface\b"
            r"|module\s+(?!procedure\b)\w+\s*$|submodule\b|program\s+\w+|type\s*(?:,|::|\s+\w)(?!.*\()|(?:where|forall)\s*\([^=]*\)\s*$|.*\)\s*then\s*$"
            r"|" + _F90_BEFORE + r"(?:subroutine|function)\s+\w+)",
            r"(?i)^\s*end\s*" + _F90_KINDS + r"?\b(?!\s*(?:=|\())", "(?!)"),
    "lisp": (r"(?i)^\s*\(\s*(?:defun|defmacro|defmethod|defgeneric|defsubst|define)\s+\(?(?:setf\s+)?([^\s()]+)", None, "lisp", r"\(", r"\)", "(?!)"),
}
BRACE_FAMILY = {
    "rs": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+){0,4}fn\s+(\w+)",
           r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl\b(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?(?:\w+::){0,8}|trait\s+|mod\s+)(\w+)", "rs"),
    "go": (r"^\s*func\s+(?:\(\s*\w*\s*\*?[\w\[\], ]+\)\s*)?(\w+)", r"^\s*func\s+\(\s*(?:\w+\s+)?\*?(\w+)", "go"),
    "zig": (r"^\s*(?:(?:pub|export|inline|extern)\s+){0,4}fn\s+(\w+)", r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|union|enum)\b", "//"),
    "swift": (r"^\s*(?:[\w@]+\s+){0,8}?func\s+(\w+)", r"^\s*(?:\w+\s+){0,8}?(?:class|struct|enum|extension|protocol)\s+(\w+)", "//"),
    "kt": (r"^\s*(?:\w+\s+){0,8}?fun\s+(?:<[^>]*>\s*)?(?:\w+\.){0,8}(\w+)", _CLASS + r"(?:class|interface|object)\s+(\w+)", "//"),
    "php": (r"^\s*(?:\w+\s+){0,8}?function\s+&?(\w+)", _CLASS + r"(?:class|interface|trait)\s+(\w+)", "php"),
    "pl": (r"^\s*sub\s+(\w+)", r"^\s*package\s+(\w+)\s*\{", "#"),
    "sh": (r"^\s*(?:function\s+(?=[\w:-]+)|(?=[\w:-]+\s*\(\s*\)))([\w:-]+)", None, "#"),
    "r": (r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b", None, "#"),
    "js": (_JS_FUNCTION, _CLASS + r"class\s+(\w+)", "js"),
    "java": (_C_FUNCTION, _CLASS + r"(?:class|interface|enum|record)\s+(\w+)", "//"),
    "c": (_C_FUNCTION, r"^\s*(?:class|struct|namespace)\s+(\w+)[^;(]*$", "//"),
}
_SAME_AS = {
    "kts": "kt", "pm": "pl", "jsx": "js", "ts": "js", "tsx": "js",
    "cpp": "c", "hpp": "c", "cc": "c", "cxx": "c",
}
BRACE_FAMILY |= {alias: BRACE_FAMILY[base] for alias, base in _SAME_AS.items() if base in BRACE_FAMILY}
_FOUND = "array<struct<name:string,start_line:bigint,end_line:bigint>>"


def _specs(spark: SparkSession) -> DataFrame:
    """One row per extension; a fixed table, joined so that no line evaluates the choice again."""
    rows = []
    for family, of in (("indent", INDENT_FAMILY), ("brace", BRACE_FAMILY), ("keyword", KEYWORD_FAMILY)):
        for ext, (fn, container, tokens, *blocks) in of.items():
            opens, closes, reset = blocks or ("(?!)", "(?!)", "(?!)")
            rows.append((ext, fn, container or "(?!)()", TOKENS[tokens], tokens not in _NO_ESCAPES, family, ext == "pas", opens, closes, reset))
    return spark.createDataFrame(
        rows, "_ext string, _function_re string, _class_re string, _token_re string, _escapes boolean, _family string, "
        "_one_opens boolean, _open_re string, _close_re string, _reset_re string"
    )


def _match(line: Column, pattern: Column) -> Column:
    """First group of the pattern; empty when it does not match or there is no pattern."""
    return F.coalesce(F.call_function("regexp_extract", line, pattern, F.lit(1)), F.lit(""))


def _bare(content: Column) -> Column:
    """The text with comments emptied and strings as a pair of quotes; line breaks stay, so lines keep their numbers.

    A string over several lines ends far to the right, so that its last line is code of the block it stands in.
    """
    text = F.when(F.col("_escapes"), F.regexp_replace(content, r"\\[^\n]", "__")).otherwise(content)
    tokens = F.call_function("regexp_extract_all", text, F.col("_token_re"), F.lit(0))

    def emptied(token):
        breaks = F.regexp_replace(token, r"[^\n]+", "")
        far = F.when(breaks == "", "").otherwise(F.lit(" " * 200))
        return F.when(token.rlike(_COMMENTS), breaks).otherwise(F.concat(breaks, far, F.lit('""')))

    between = F.call_function("split", text, F.col("_token_re"), F.lit(-1))
    rest = F.slice(between, F.lit(2), F.size(between))
    joined = F.array_join(F.zip_with(F.transform(tokens, emptied), rest, lambda token, code: F.concat(token, code)), "")
    return F.concat(F.element_at(between, 1), joined)


def _code_lines(lines: Column) -> Column:
    """Lines that hold code, with what the fold needs of them."""

    def read(line, i):
        return F.struct(
            (i + 1).cast("bigint").alias("no"), F.rtrim(line, F.lit(" \t\r")).alias("code"),
            F.replace(line, F.lit("\t"), F.lit("        ")).alias("raw"),
        )

    def number(code, mark, pattern):
        marks = F.length(code) - F.length(F.replace(code, F.lit(mark), F.lit("")))
        return F.when(F.col("_family") == "keyword", F.call_function("regexp_count", code, F.col(pattern))).otherwise(marks)

    def shape(x):
        is_class = _match(x["code"], F.col("_class_re"))
        name = _match(x["code"], F.col("_function_re"))
        opens, closes = number(x["code"], "{", "_open_re"), number(x["code"], "}", "_close_re")
        ends = x["code"].endswith(";") & (opens == 0) & (F.col("_family") != "keyword")
        return F.struct(
            x["no"].alias("no"),
            (F.length(x["raw"]) - F.length(F.ltrim(x["raw"]))).alias("indent"),
            F.when(ends, "").otherwise(name).alias("name"),
            F.when(ends, "").otherwise(is_class).alias("container"),
            opens.alias("opens"), closes.alias("closes"), ends.alias("ends"),
            F.left(F.ltrim(x["code"], F.lit(" \t")), F.lit(1)).isin(")", "]", "}").alias("closer"),
            F.when(F.col("_family") == "keyword", F.call_function("rlike", x["code"], F.col("_reset_re"))).otherwise(False).alias("reset"),
        )

    return F.transform(F.filter(F.transform(lines, read), lambda x: x["code"] != ""), shape)


def _qualified(stack: Column, x: Column) -> Column:
    """The name with its nearest container in front of it."""
    containers = F.filter(stack, lambda e: e["is_class"])
    owner = F.when(F.size(containers) > 0, F.element_at(containers, -1)["name"])
    own = F.when((x["name"] != "") & (x["container"] != ""), x["container"])
    holder = F.coalesce(own, owner)
    return F.when(holder.isNull(), x["name"]).otherwise(F.concat(holder, F.lit(":"), x["name"]))


def _entry(stack: Column, x: Column, level: Column) -> Column:
    is_class = x["name"] == ""
    return F.struct(
        F.when(is_class, x["container"]).otherwise(_qualified(stack, x)).alias("name"),
        is_class.alias("is_class"), x["no"].alias("start"), level.cast("int").alias("level"), F.lit(False).alias("opened"),
    )


_STACK = "array<struct<name:string,is_class:boolean,start:bigint,level:int,opened:boolean>>"


def _is_header(x: Column) -> Column:
    return (x["name"] != "") | (x["container"] != "")


def _pushed(stack: Column, x: Column, level: Column) -> Column:
    return F.when(_is_header(x), F.array_append(stack, _entry(stack, x, level))).otherwise(stack)


def _collected(found: Column, closed: Column, end) -> Column:
    """Append the functions among the closed entries; the array is copied only when there is one."""
    functions = F.filter(closed, lambda e: ~e["is_class"])
    rows = F.transform(
        functions,
        lambda e: F.struct(e["name"].alias("name"), e["start"].alias("start_line"), end.alias("end_line")),
    )
    return F.when(F.size(functions) > 0, F.concat(found, rows)).otherwise(found)


def _indent_spans(code: Column) -> Column:
    """A function ends at the last line of code before one that is not indented deeper than it."""
    start = F.struct(
        F.array().cast(_STACK).alias("stack"), F.lit(0).cast("bigint").alias("last"), F.array().cast(_FOUND).alias("found")
    )

    def step(acc, x):
        going = x["closer"]
        over = lambda e: (e["level"] >= x["indent"]) & ~going
        kept = F.filter(acc["stack"], lambda e: ~over(e))
        idle = ~_is_header(x) & ~F.exists(acc["stack"], over)
        return F.struct(
            F.when(idle, acc["stack"]).otherwise(_pushed(kept, x, x["indent"])).alias("stack"),
            x["no"].alias("last"),
            F.when(idle, acc["found"])
            .otherwise(_collected(acc["found"], F.filter(acc["stack"], over), acc["last"])).alias("found"),
        )

    return F.aggregate(code, start, step, lambda acc: _collected(acc["found"], acc["stack"], acc["last"]))


def _block_spans(code: Column) -> Column:
    """A function ends where the depth of blocks is back at its start and a block has opened since.

    A block opens all functions that wait for one, in Pascal the last of them: there the functions inside one come first.
    """
    start = F.struct(
        F.array().cast(_STACK).alias("stack"), F.lit(0).alias("depth"), F.array().cast(_FOUND).alias("found")
    )

    def step(acc, x):
        depth = acc["depth"] + x["opens"] - x["closes"]
        pushed = _pushed(F.when(x["reset"], F.filter(acc["stack"], lambda e: e["opened"])).otherwise(acc["stack"]), x, acc["depth"])
        opened = F.transform(
            pushed,
            lambda e, i: e.withField("opened", e["opened"] | (x["opens"] > 0) & (~F.col("_one_opens") | (i == F.size(pushed) - 1))),
        )
        over = lambda e: e["opened"] & (depth <= e["level"])
        # A declaration without a body is forgotten at its semicolon or when its block closes.
        void = lambda e: ~e["opened"] & (x["ends"] | (depth < e["level"]))
        idle = (
            ~_is_header(x) & (x["opens"] == 0) & (x["closes"] == 0)
            & ~(x["ends"] & F.exists(acc["stack"], lambda e: ~e["opened"])) & ~x["reset"]
        )
        return F.struct(
            F.when(idle, acc["stack"]).otherwise(F.filter(opened, lambda e: ~over(e) & ~void(e))).alias("stack"),
            depth.alias("depth"),
            F.when(idle, acc["found"]).otherwise(_collected(acc["found"], F.filter(opened, over), x["no"])).alias("found"),
        )

    return F.aggregate(code, start, step, lambda acc: acc["found"])


def detect_functions(files: DataFrame) -> DataFrame:
    """Function records of each file: ``project, path, name, start_line, end_line, record_no, status``.

    Methods are named ``Class:method``. A file whose extension belongs to no family gives one
    row with status ``uncovered`` and no name.
    """
    known = files.select("project", "path", "content", tx.extension(F.col("path")).alias("_ext"))
    # One pass over the contents: a file without functions, or of another language, gives one row without a span.
    ready = known.join(F.broadcast(_specs(files.sparkSession)), "_ext", "left").withColumn(
        "_covered", F.col("_function_re").isNotNull()
    )
    plain = ready.withColumn("_text", F.when(F.col("_covered"), _bare(F.col("content"))))
    code = plain.select(
        "project", "path", "_covered", "_family", "_one_opens", _code_lines(tx.text_lines(F.col("_text"))).alias("_code")
    )
    spans = code.select(
        "project", "path", "_covered",
        F.when(F.col("_covered"), F.when(F.col("_family") == "indent", _indent_spans(F.col("_code"))).otherwise(_block_spans(F.col("_code"))))
        .alias("_spans"),
    )
    # By start line; of two functions on one line the outer one first.
    ordered = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start_line"], -s["end_line"], s["name"], s["end_line"].alias("end_line")))
    )
    return spans.select("project", "path", "_covered", F.posexplode_outer(ordered).alias("record_no", "_s")).filter(
        F.col("_s").isNotNull() | ~F.col("_covered")
    ).select(
        "project", "path", F.replace(F.col("_s.name"), F.lit("::"), F.lit(":")).alias("name"), F.col("_s.start_line").alias("start_line"),
        F.col("_s.end_line").alias("end_line"), F.col("record_no").cast("bigint").alias("record_no"),
        F.when(F.col("_covered"), "found").otherwise("uncovered").alias("status"),
    )


def uncovered_files(files: DataFrame) -> DataFrame:
    """The rows of ``files`` whose extension belongs to no family, by ``path`` alone."""
    known = F.broadcast(_specs(files.sparkSession).select("_ext"))
    return files.withColumn("_ext", tx.extension(F.col("path"))).join(known, "_ext", "left_anti").drop("_ext")
