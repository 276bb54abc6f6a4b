"""Symbols of changes and the files that mention them."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codetide.functions import paths, symbols

PR = ["repo", "pr_id"]
FILE = ["repo", "file_path"]

# How much of a change is searched for.
TOP_FUNCTIONS, TOP_CLASSES, HITS_PER_SYMBOL = 3, 2, 5


def changed_sources(pr_files: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Current sources of changed files, each once however many changes touch it."""
    keys = pr_files.where(paths.language(F.col("file_path")).isNotNull()).select(*FILE).distinct()
    return repo_files.select(*FILE, "content").join(keys, FILE, "left_semi")


def symbol_table(sources: DataFrame) -> DataFrame:
    """Symbol lists per file, without the text: the small input of everything below."""
    return symbols.with_symbols(sources.select(*FILE, "content")).drop("content")


def file_structures(wide: DataFrame) -> DataFrame:
    """Structure summary per parseable file of a symbol table."""
    return wide.where(F.col("language").isNotNull()).select(*FILE, symbols.structure_summary().alias("structure"))


def symbol_rows(wide: DataFrame) -> DataFrame:
    """Long form: one row per symbol occurrence, `pos` counting from 0 inside (file, kind)."""
    as_entry = lambda kind, col: F.transform(
        F.col(col),
        lambda name, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("module"), name.alias("name"), i.alias("pos")),
    )
    from_entries = F.transform(
        F.col("from_imports"),
        lambda e, i: F.struct(
            F.lit("from_import").alias("kind"), e["module"].alias("module"), e["name"].alias("name"), i.alias("pos")),
    )
    entries = F.concat(
        as_entry("import", "imports"), from_entries, as_entry("function", "functions"),
        as_entry("class", "classes"), as_entry("call", "calls"),
    )
    # Outer: a plain explode would add a filter on the array, evaluating the extraction twice.
    return (
        wide.select(*FILE, "language", F.explode_outer(entries).alias("s"))
        .where(F.col("s").isNotNull())
        .select(*FILE, "language", "s.kind", "s.module", "s.name", "s.pos")
    )


def pr_symbols(pr_files: DataFrame, wide: DataFrame) -> DataFrame:
    """Distinct functions, classes and imports (with from-modules) per change, one row each."""
    entry = lambda kind, names: F.transform(
        names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))
    per_file = wide.select(*FILE, F.array_distinct(F.concat(
        entry("function", F.col("functions")),
        entry("class", F.col("classes")),
        entry("import", F.col("imports")),
        entry("import", F.transform("from_imports", lambda e: e["module"])),
    )).alias("defined"))
    return (
        pr_files.select(*PR, "file_path").join(per_file, FILE)
        .select(*PR, F.explode_outer("defined").alias("s"))
        .where(F.col("s").isNotNull())
        .select(*PR, "s.kind", "s.name")
        .distinct()
    )


def first_symbols(symbols_per_pr: DataFrame, functions: int, classes: int) -> DataFrame:
    """The first functions and classes of each change by name, numbered from 0, functions first."""
    ranked = symbols_per_pr.where(F.col("kind").isin("function", "class")).withColumn(
        "rn", F.row_number().over(Window.partitionBy(*PR, "kind").orderBy("name")))
    ranked = ranked.where(F.col("rn") <= max(functions, classes))
    is_function = F.col("kind") == "function"
    return ranked.where(
        (is_function & (F.col("rn") <= functions)) | (~is_function & (F.col("rn") <= classes))
    ).select(
        *PR, "kind", "name",
        F.when(is_function, F.col("rn") - 1).otherwise(F.col("rn") - 1 + functions).alias("symbol_ord"),
    )


def token_counts(text_col: str) -> Column:
    """Distinct identifiers of a text as (symbol, mentions) structs, counted inside the row.

    Equal tokens become neighbours by sorting; a back-reference then takes each run of lines whole.
    """
    tokens = F.regexp_extract_all(text_col, F.lit(symbols.ID), F.lit(0))
    sorted_lines = F.concat(F.array_join(F.array_sort(tokens), "\n"), F.lit("\n"))
    runs = F.regexp_extract_all(sorted_lines, F.lit(r"([^\n]++)\n(?:\1\n)*+"), F.lit(0))

    def entry(run: Column) -> Column:
        token = F.substring_index(run, "\n", 1)
        count = (F.length(run) / (F.length(token) + 1)).cast("bigint")
        return F.struct(token.alias("symbol"), count.alias("mentions"))

    return F.transform(runs, entry)


def token_postings(repo_files: DataFrame) -> DataFrame:
    """repo, file_path, symbol, mentions: identifiers of each Python file, without a shuffle."""
    return (
        repo_files.where(paths.extension(F.col("file_path")) == "py")
        .select(*FILE, F.explode_outer(token_counts("content")).alias("t"))
        .where(F.col("t").isNotNull())
        .select(*FILE, "t.symbol", "t.mentions")
    )


def mentioning_files(repo_files: DataFrame, wanted: DataFrame) -> DataFrame:
    """`most_mentions` of the tokens of all Python files."""
    return most_mentions(token_postings(repo_files), wanted)


def most_mentions(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per (repo, symbol), the Python files that mention it most, at most HITS_PER_SYMBOL.

    Independent of the asking changes, so each symbol is searched once. Tokens are counted inside
    their file's row and the limit prunes inside every task, so the one shuffle carries a few rows
    per task and symbol however popular a symbol is. Tokens that no change asks for are dropped by a
    semi-join first; whether the names are broadcast for it is left to the run-time sizes.
    """
    names = wanted.select("repo", F.col("name").alias("symbol")).distinct()
    mentions = postings.join(names, ["repo", "symbol"], "left_semi")
    order = Window.partitionBy("repo", "symbol").orderBy(F.col("mentions").desc(), "file_path")
    return mentions.withColumn("hit_ord", F.row_number().over(order)).where(F.col("hit_ord") <= HITS_PER_SYMBOL)


def impact_analysis(
    pr_files: DataFrame, repo_files: DataFrame, symbols_per_pr: DataFrame, keep=lambda df, _: df, postings_of=None,
) -> DataFrame:
    """Files outside each change that mention its first symbols; one row per (change, file).

    `impact_ord` keeps the order of discovery: symbol by symbol, best hit first. `keep(df, name)`
    may materialise the searched symbols, which are counted before they are used. With
    `postings_of(searched)` stored postings are read (`sources.postings`) in place of all sources.
    """
    searched = keep(first_symbols(symbols_per_pr, TOP_FUNCTIONS, TOP_CLASSES), "searched")
    hits = most_mentions(postings_of(searched), searched) if postings_of else mentioning_files(repo_files, searched)
    found = searched.withColumnRenamed("name", "symbol").join(hits, ["repo", "symbol"])
    outside = found.join(pr_files.select(*PR, "file_path"), [*PR, "file_path"], "left_anti")
    first = Window.partitionBy(*PR, "file_path").orderBy("symbol_ord", "hit_ord")
    return (
        outside.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") == 1)
        .select(
            *PR, F.col("file_path").alias("file"), "symbol",
            F.concat(F.lit("May use '"), F.col("symbol"), F.lit("'")).alias("reason"),
            (F.col("symbol_ord") * HITS_PER_SYMBOL + F.col("hit_ord") - 1).alias("impact_ord"),
        )
    )
