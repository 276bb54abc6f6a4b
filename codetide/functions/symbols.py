"""Symbol extraction as regular-expression columns, one narrow projection per file.

Comments and string literals are blanked first, so names in prose are not taken for code.
The patterns avoid look-around and back-references, so any RE2-style engine gives the same
matches; possessive groups (`)*+`, `)++`) only keep the matcher's stack flat on long inputs.
"""

from pyspark.sql import Column, DataFrame, functions as F

from . import paths

ID = r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*"
DOTTED = rf"{ID}(?:\.{ID})*+"
WS = r"[ \t]"
GAP = r"[ \t\r\n]*"
PARENS = r"\([^()]*(?:\([^()]*\)[^()]*)*+\)"
FLAT_PARENS = r"\([^()]*\)"
GENERICS = r"(?:<[^<>]*(?:<[^<>]*>[^<>]*)*+>)?"

_DOUBLE = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*+"'
_SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*+'"
_CHAR = r"'(?:[^'\\\n]|\\[^'\n]+|\\')'"
_BACKTICK = r"`[^`\\]*(?:\\[\s\S][^`\\]*)*+`"
_SLASH_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"

# (string literal alternatives, comment alternatives)
LEXICAL = {
    "python": (rf'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|{_DOUBLE}|{_SINGLE}', r"#[^\n]*"),
    "script": (rf"{_DOUBLE}|{_SINGLE}|{_BACKTICK}", _SLASH_COMMENT),
    "java": (rf'"""[\s\S]*?"""|{_DOUBLE}|{_CHAR}', _SLASH_COMMENT),
    "c": (rf"{_DOUBLE}|{_CHAR}", _SLASH_COMMENT),
    "go": (rf"{_DOUBLE}|`[^`]*`|{_CHAR}", _SLASH_COMMENT),
    "rust": (rf'"[^"\\]*(?:\\[\s\S][^"\\]*)*+"|{_CHAR}', _SLASH_COMMENT),
}
FAMILY = {
    "python": "python", "javascript": "script", "typescript": "script", "java": "java",
    "c": "c", "cpp": "c", "go": "go", "rust": "rust",
}

_MODIFIERS = rf"(?:(?:async|static|public|private|protected|readonly|override|get|set){WS}+)*"
_METHOD = rf"^{WS}*{_MODIFIERS}({ID}){WS}*{PARENS}[^;{{}}()\n=]*\{{"

# Words that may stand before a call without declaring the name that follows.
EXPRESSION_WORDS = {
    "python": ("return", "else", "await", "yield", "in", "not", "and", "or", "is", "if", "elif", "while", "for",
               "assert", "raise", "except", "with", "del", "case"),
    "script": ("return", "else", "throw", "await", "yield", "case", "in", "of", "do", "typeof", "void",
               "instanceof", "delete", "extends"),
    "java": ("return", "else", "throw", "case", "assert", "yield", "do"),
    "c": ("return", "else", "throw", "case", "do", "co_await", "co_return", "co_yield"),
    "go": ("return", "else", "if", "for", "switch", "case", "range", "go", "defer"),
    "rust": ("return", "else", "if", "while", "for", "in", "match", "move"),
}
# Further words followed by a bracket that are not calls.
BRACKET_WORDS = {
    "python": ("lambda", "import", "from", "def", "class"),
    "script": ("if", "for", "while", "switch", "catch", "with", "function", "async"),
    "java": ("if", "for", "while", "switch", "catch", "try", "synchronized", "super", "this"),
    "c": ("if", "for", "while", "switch", "catch", "sizeof", "alignof", "decltype", "defined"),
    "go": ("func", "import", "var", "const", "type", "interface", "map", "chan", "struct", "select"),
    "rust": ("fn", "pub", "impl", "let", "where", "use"),
}
JAVA_STATEMENTS = "return|throw|new|else|case|assert|yield|package|import"
JAVA_MODIFIERS = "public|private|protected|static|final|abstract|synchronized|native|default|strictfp"
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "with", "function", "return")

PATTERNS = {
    "python_import": rf"(?m)^{WS}*import{WS}+([^\n;]+)",
    "python_from": rf"(?m)^{WS}*from{WS}+({DOTTED}){WS}+import{WS}*(\([^)]*\)|[^\n;(]+)",
    "python_def": rf"(?m)^{WS}*(?:async{WS}+)?def{WS}+({ID})",
    "python_class": rf"(?m)^{WS}*class{WS}+({ID})",
    "script_import": rf"""(?m)^{WS}*import\b[^'";(]*['"]([^'"\n]+)['"]""",
    "script_function": (
        rf"(?m)(?:[=(,:?&|!]{WS}*|\breturn{WS}+)(?:async{WS}+)?function\b"
        rf"|\bfunction{WS}+({ID})"
        rf"|\b(?:const|let|var){WS}+({ID}){WS}*(?::[^=\n]*)?={WS}*(?:async{WS}*)?{GENERICS}"
        rf"(?:{PARENS}{WS}*(?::[^=\n{{]*)?|{ID}{WS}*)=>"
        rf"|{_METHOD}"
    ),
    "script_class": rf"\babstract{WS}+class{WS}+{ID}|[=(,:]{WS}*class\b|\bclass{WS}+({ID})",
    "java_import": rf"(?m)^{WS}*import{WS}+(?:static{WS}+)?({ID}(?:\.{ID})++){WS}*(?:\.\*)?{WS}*;",
    "java_method": rf"(?m)^{WS}*(?:@{ID}{WS}+)*([\p{{L}}_][\p{{L}}\p{{N}}_.<>\[\],?& \t]*[ \t>\]])({ID}){WS}*{PARENS}[^;{{}}()=\n]*[{{;]",
    "java_class": rf"@interface{WS}+{ID}|\b(?:class|interface){WS}+({ID})",
    "c_include": rf'(?m)^{WS}*#{WS}*include{WS}*[<"]([^>"\n]+)[>"]',
    "c_function": rf"(?m)^[\p{{L}}_][\p{{L}}\p{{N}}_ \t:<>,]*{WS}({ID}){WS}*{PARENS}{GAP}(?:(?:const|noexcept|override|final){GAP})*\{{",
    "c_class": rf"template{WS}*<[^{{}};()]*?>|\benum{WS}+(?:class|struct){WS}+{ID}|\b(?:class|struct){WS}+({ID})",
    "go_import_block": rf"(?m)^import{WS}*\([^)]*\)|^import{WS}+[^\n]*",
    "go_import": r'"([^"\n]+)"',
    "go_function": rf"(?m)^func{WS}+(?:\([^)]*\){WS}*)?({ID})",
    "go_type": rf"(?m)^{WS}*type{WS}+({ID})(?:\[[^\]\n]*\])?{WS}+[^= \t\n]",
    "rust_use": rf"(?m)^{WS}*(?:pub(?:\([^)]*\))?{WS}+)?use{WS}+({ID}(?:::{ID})*+){WS}*;",
    "rust_fn": rf"\bfn{WS}+({ID}){GENERICS}{WS}*{PARENS}[^{{;]*[{{;]",
    "rust_type": (
        rf"(?m)\bstruct{WS}+({ID})"
        rf"|^{WS}*(?:unsafe{WS}+)?impl{GENERICS}{WS}+(?:({ID}){WS}+for\b"
        rf"|[^{{;]*?\bfor{WS}+({ID}){GAP}(?:\{{|where\b)|({ID}){GAP}(?:\{{|where\b))"
    ),
    # An optional word before the callee tells declarations ("def f(", "int main(") from calls.
    "call": (
        rf"(?m)(?:\bfunc{WS}*\([^()\n]*\){WS}*(?:{ID}{WS}*)?\("
        rf"|(?:{ID}[*&>\]]*{WS}+[*&]*)?(?:\??\.|::|->)?{ID}(?:(?:\??\.|::|->){ID})*+{WS}*\()"
    ),
    "braced_call": (
        rf"(?m)(?:{_METHOD.replace(f'({ID})', ID).replace(PARENS, FLAT_PARENS)}"
        rf"|(?:{ID}[*&>\]]*{WS}+[*&]*)?(?:\??\.|::|->)?{ID}(?:(?:\??\.|::|->){ID})*+{WS}*\()"
    ),
    "callee_split": rf"^(?:({ID})[*&>\]]*{WS}+[*&]*)?((?:\??\.|::|->)?{ID}(?:(?:\??\.|::|->){ID})*+){WS}*\($",
}

# The call patterns for a backtracking matcher, with the same matches. No match starts right after a letter, as it would have
# started one character earlier; and no shorter name, run or gap is tried, as what must follow cannot stand inside a longer one.
_WHOLE_ID = r"(?:[\p{L}_$][\p{L}\p{M}\p{N}_$]*+)"
_CALLEE = (
    rf"(?<![\p{{L}}_$])(?:{_WHOLE_ID}[*&>\]]*+{WS}++[*&]*+)?(?:\??\.|::|->)?{_WHOLE_ID}(?:(?:\??\.|::|->){_WHOLE_ID})*+{WS}*+\("
)
CALL_SCANS = {
    "call": rf"(?m)(?:\bfunc{WS}*+\([^()\n]*+\){WS}*+(?:{_WHOLE_ID}{WS}*+)?\(|{_CALLEE})",
    "braced_call": rf"(?m)(?:{_METHOD.replace(f'({ID})', ID).replace(PARENS, FLAT_PARENS)}|{_CALLEE})",
}


def strip_patterns(family: str) -> str:
    """One alternation: group 1 is a string literal, otherwise the match is a comment."""
    strings, comments = LEXICAL[family]
    return f"({strings})|{comments}"


def _scan_pattern(family: str) -> str:
    """`strip_patterns` that looks at the next character first: every literal and comment starts with one of five."""
    return f"(?=[\"'`#/])(?:{strip_patterns(family)})"


def _by_family(lang: Column, make) -> Column:
    out = None
    for family in LEXICAL:
        names = [name for name, fam in FAMILY.items() if fam == family]
        cond = lang.isin(*names)
        out = F.when(cond, make(family)) if out is None else out.when(cond, make(family))
    return out


def _all(text: Column, key: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?d)" + PATTERNS[key]), F.lit(group))


def _names(text: Column, key: str) -> Column:
    return F.filter(_all(text, key), lambda name: name != "")


def _first_group(text: Column, key: str, groups: int) -> Column:
    """All matches, each as its first non-empty group, in document order."""

    def pick(match: Column) -> Column:
        return F.concat(*[F.regexp_extract(match, "(?d)" + PATTERNS[key], g) for g in range(1, groups + 1)])

    return F.filter(F.transform(_all(text, key, 0), pick), lambda name: name != "")


def _listed(names: Column) -> Column:
    """Comma-separated plain names of an import list; aliased and wildcard entries drop out."""
    parts = F.transform(F.split(F.translate(names, "()\r\n\\", "     "), ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part.rlike(f"^{DOTTED}$"))


def _python_imports(code: Column) -> Column:
    return F.flatten(F.transform(_all(code, "python_import"), _listed))


def _python_from_imports(code: Column) -> Column:
    def entries(match: Column) -> Column:
        module = F.regexp_extract(match, "(?d)" + PATTERNS["python_from"], 1)
        names = _listed(F.regexp_extract(match, "(?d)" + PATTERNS["python_from"], 2))
        return F.transform(names, lambda name: F.struct(module.alias("module"), name.alias("name")))

    found = F.flatten(F.transform(_all(code, "python_from", 0), entries))
    return F.filter(found, lambda entry: entry["module"] != "__future__")


def _go_imports(text: Column) -> Column:
    return F.flatten(F.transform(_all(text, "go_import_block", 0), lambda block: _all(block, "go_import")))


def _script_functions(code: Column) -> Column:
    return F.filter(_first_group(code, "script_function", 3), lambda name: ~name.isin(*CONTROL_WORDS))


def _java_functions(code: Column) -> Column:
    pattern = "(?d)" + PATTERNS["java_method"]

    def is_method(m: Column) -> Column:
        before = F.regexp_extract(m, pattern, 1)  # modifiers and return type; constructors have no type
        return ~before.rlike(rf"^(?:{JAVA_STATEMENTS})\b") & ~before.rlike(rf"^(?:(?:{JAVA_MODIFIERS}){WS}+)+$")

    declared = F.filter(_all(code, "java_method", 0), is_method)
    return F.transform(declared, lambda m: F.regexp_extract(m, pattern, 2))


def _rust_functions(code: Column) -> Column:
    bodies = F.filter(_all(code, "rust_fn", 0), lambda m: F.endswith(m, F.lit("{")))
    return F.transform(bodies, lambda m: F.regexp_extract(m, "(?d)" + PATTERNS["rust_fn"], 1))


def _calls(code: Column, family: str) -> Column:
    key = "braced_call" if family in ("script", "java", "c") else "call"
    java = family == "java"
    split = "(?d)" + PATTERNS["callee_split"]
    pairs = F.transform(
        F.regexp_extract_all(code, F.lit("(?d)" + CALL_SCANS[key]), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, split, 1).alias("word"), F.regexp_extract(m, split, 2).alias("callee")),
    )
    kept = F.filter(
        pairs,
        lambda p: (p["callee"] != "")
        & (F.lit(java) | p["callee"].rlike(r"^[\p{L}_$]"))
        & p["word"].isin("", *EXPRESSION_WORDS[family])
        & ~p["callee"].isin(*EXPRESSION_WORDS[family], *BRACKET_WORDS[family]),
    )
    return F.transform(kept, lambda p: _java_callee(p["callee"]) if java else p["callee"])


def _java_callee(callee: Column) -> Column:
    """The identifier nearest to the front of a Java call: `a.b(` is `a`, `a.b.c(` and `.c(` are `c`."""
    first, last = F.substring_index(callee, ".", 1), F.substring_index(callee, ".", -1)
    receiver = (F.length(callee) - F.length(F.replace(callee, F.lit("."), F.lit(""))) == 1)
    return F.when(receiver & ~first.isin("", "this", "super"), first).otherwise(last)


def with_symbols(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """Add language, imports, from_imports, functions, classes and calls to a table of sources.

    Arrays keep document order and duplicates. Files of other types get a NULL language and
    empty arrays. Narrow: no shuffle.
    """
    lang = F.col("language")
    text = F.coalesce(F.col(content), F.lit(""))
    lexed = (
        files.withColumn("language", paths.language(F.col(path)))
        .withColumn("_code", _by_family(lang, lambda fam: F.regexp_replace(text, _scan_pattern(fam), " ")))
        # Comments removed but strings kept: only import targets written as strings need it.
        .withColumn(
            "_quoted",
            F.when(lang.isin("javascript", "typescript", "c", "cpp", "go"),
                   _by_family(lang, lambda fam: F.regexp_replace(text, _scan_pattern(fam), "$1"))),
        )
    )
    code, quoted = F.col("_code"), F.col("_quoted")
    none = F.expr("cast(array() as array<string>)")
    script = lang.isin("javascript", "typescript")
    c_like = lang.isin("c", "cpp")
    return (
        lexed.withColumn(
            "imports",
            F.when(lang == "python", _python_imports(code))
            .when(script, _names(quoted, "script_import"))
            .when(lang == "java", _names(code, "java_import"))
            .when(c_like, _names(quoted, "c_include"))
            .when(lang == "go", _go_imports(quoted))
            .when(lang == "rust", _names(code, "rust_use"))
            .otherwise(none),
        )
        .withColumn(
            "from_imports",
            F.when(lang == "python", _python_from_imports(code))
            .otherwise(F.expr("cast(array() as array<struct<module:string,name:string>>)")),
        )
        .withColumn(
            "functions",
            F.when(lang == "python", _names(code, "python_def"))
            .when(script, _script_functions(code))
            .when(lang == "java", _java_functions(code))
            .when(c_like, F.filter(_names(code, "c_function"), lambda name: ~name.isin(*CONTROL_WORDS)))
            .when(lang == "go", _names(code, "go_function"))
            .when(lang == "rust", _rust_functions(code))
            .otherwise(none),
        )
        .withColumn(
            "classes",
            F.when(lang == "python", _names(code, "python_class"))
            .when(script, F.filter(_names(code, "script_class"), lambda name: name != "extends"))
            .when(lang == "java", _names(code, "java_class"))
            .when(c_like, _names(code, "c_class"))
            .when(lang == "go", _names(code, "go_type"))
            .when(lang == "rust", _first_group(code, "rust_type", 4))
            .otherwise(none),
        )
        .withColumn(
            "calls",
            F.coalesce(F.when(F.contains(code, F.lit("(")), _by_family(lang, lambda fam: _calls(code, fam))), none),
        )
        .drop("_code", "_quoted")
    )


def structure_summary() -> Column:
    """Compact text over the columns of `with_symbols`; empty kinds are left out."""

    def line(label: str, names: Column, limit: int) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(F.slice(names, 1, limit), ", ")))

    dotted = F.transform(F.col("from_imports"), lambda e: F.concat(e["module"], F.lit("."), e["name"]))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Language: "), F.coalesce(F.col("language"), F.lit("unknown"))),
        line("Imports: ", F.col("imports"), 10),
        line("From Imports: ", dotted, 10),
        line("Classes/Types: ", F.col("classes"), 10),
        line("Functions: ", F.col("functions"), 15),
        line("Calls: ", F.array_distinct(F.col("calls")), 15),
    )
