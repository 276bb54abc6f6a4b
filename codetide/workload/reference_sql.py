"""SQL for the checking engine: the same results, stated independently of the Spark plans."""

from codetide.functions import paths, rules, symbols
from codetide.functions.text import BLOCK_LINES, WHOLE_FILE_CHARS
from codetide.workload.views import with_clause, view_sql

_NL = "chr(10)"


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_str(v) for v in values) + ")"


def _plain(pattern: str) -> str:
    """Pattern without possessive marks, which this engine does not need."""
    return pattern.replace(")*+", ")*").replace(")++", ")+")


def _rx(key: str) -> str:
    return _str(_plain(symbols.PATTERNS[key]))


# ---- paths -------------------------------------------------------------------

_EXT = "CASE WHEN contains(file_path, '.') THEN lower(list_last(string_split(file_path, '.'))) END"
_LANGUAGE = "CASE {} {} END".format(
    _EXT, " ".join(f"WHEN {_str(ext)} THEN {_str(lang)}" for ext, lang in paths.LANGUAGE_BY_EXTENSION.items()))
_DIRS = "string_split(file_path, '/')"
_SKIPPED_DIR = (
    f"len(list_filter({_DIRS}[1:len({_DIRS})-1], lambda d: d IN {_list(paths.SKIPPED_DIRECTORIES)})) > 0")
_TYPE_OK = f"coalesce({_EXT} IN {_list((*paths.LANGUAGE_BY_EXTENSION, *paths.TEXT_EXTENSIONS))}, false)"
_OUTCOME = (
    f"CASE WHEN {_SKIPPED_DIR} THEN 'pruned' WHEN NOT {_TYPE_OK} THEN 'skipped_type'"
    f" WHEN size_bytes > {paths.MAX_FILE_BYTES} THEN 'skipped_size' ELSE 'eligible' END")
_BASE = "list_last(string_split(file_path, '/'))"
_SENSITIVE = (
    f"({_BASE} IN {_list(rules.SENSITIVE_NAMES)} OR "
    + " OR ".join(f"ends_with(file_path, {_str(s)})" for s in rules.SENSITIVE_SUFFIXES) + " OR "
    + " OR ".join(f"regexp_matches(file_path, {_str(p)}, 'i')" for p in rules.SENSITIVE_PATH_PATTERNS) + ")")
_IS_TEST = "contains(lower(file_path), 'test')"
_HASH = "substring(sha256({}), 1, 16)"

# ---- symbols -----------------------------------------------------------------

_BRACED = ("javascript", "typescript", "java", "c", "cpp")


def _per_language(make) -> str:
    return "CASE " + " ".join(f"WHEN language = {_str(lang)} THEN {make(fam)}" for lang, fam in symbols.FAMILY.items()) + " END"


def _strip(replacement: str) -> str:
    return _per_language(lambda fam: "regexp_replace(content, {}, {}, 'g')".format(
        _str(_plain(symbols.strip_patterns(fam))), _str(replacement)))


def _found(text: str, key: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {_rx(key)}, {group})"


def _nonempty(text: str, key: str) -> str:
    return f"list_filter({_found(text, key)}, lambda x: x <> '')"


def _first_group(text: str, key: str, groups: int) -> str:
    parts = ", ".join(f"regexp_extract(m, {_rx(key)}, {g})" for g in range(1, groups + 1))
    return f"list_filter(list_transform({_found(text, key, 0)}, lambda m: concat({parts})), lambda x: x <> '')"


def _listed(text: str) -> str:
    cleaned = f"translate({text}, concat('()\\', chr(13), chr(10)), '     ')"
    return (
        f"list_filter(list_transform(string_split({cleaned}, ','), lambda p: trim(p)),"
        f" lambda p: regexp_matches(p, {_str('^' + _plain(symbols.DOTTED) + '$')}))")


def _without_control(names: str) -> str:
    return f"list_filter({names}, lambda x: x NOT IN {_list(symbols.CONTROL_WORDS)})"


_STRINGS = "CAST([] AS VARCHAR[])"
_FROMS = "CAST([] AS STRUCT(module VARCHAR, name VARCHAR)[])"
_FROM_MODULE = f"regexp_extract(m, {_rx('python_from')}, 1)"
_FROM_NAMES = _listed(f"regexp_extract(m, {_rx('python_from')}, 2)")
_PY_FROM = (
    f"list_filter(flatten(list_transform({_found('code', 'python_from', 0)}, lambda m: list_transform({_FROM_NAMES},"
    f" lambda n: {{'module': {_FROM_MODULE}, 'name': n}}))), lambda e: e.module <> '__future__')")
_JAVA_BEFORE = f"regexp_extract(m, {_rx('java_method')}, 1)"
_JAVA_METHODS = (
    f"list_transform(list_filter({_found('code', 'java_method', 0)}, lambda m:"
    f" NOT regexp_matches({_JAVA_BEFORE}, {_str(f'^(?:{symbols.JAVA_STATEMENTS})\\b')})"
    f" AND NOT regexp_matches({_JAVA_BEFORE}, {_str(f'^(?:(?:{symbols.JAVA_MODIFIERS})[ \\t]+)+$')})),"
    f" lambda m: regexp_extract(m, {_rx('java_method')}, 2))")
_RUST_FNS = (
    f"list_transform(list_filter({_found('code', 'rust_fn', 0)}, lambda m: ends_with(m, '{{')),"
    f" lambda m: regexp_extract(m, {_rx('rust_fn')}, 1))")


def _calls(family: str) -> str:
    key = "braced_call" if family in ("script", "java", "c") else "call"
    pairs = (
        f"list_transform({_found('code', key, 0)}, lambda m: {{'word': regexp_extract(m, {_rx('callee_split')}, 1),"
        f" 'callee': regexp_extract(m, {_rx('callee_split')}, 2)}})")
    words = symbols.EXPRESSION_WORDS[family]
    starts = "true" if family == "java" else r"regexp_matches(p.callee, '^[\p{L}_$]')"
    kept = (
        f"list_filter({pairs}, lambda p: p.callee <> '' AND {starts} AND p.word IN {_list(('', *words))}"
        f" AND p.callee NOT IN {_list((*words, *symbols.BRACKET_WORDS[family]))})")
    if family != "java":
        return f"list_transform({kept}, lambda p: p.callee)"
    parts = "string_split(p.callee, '.')"
    return (
        f"list_transform({kept}, lambda p: CASE WHEN len({parts}) = 2 AND {parts}[1] NOT IN ('', 'this', 'super')"
        f" THEN {parts}[1] ELSE list_last({parts}) END)")


def _symbols_cte(source: str) -> str:
    """CTEs ending in `wide`: the symbol lists of every file of `source` (repo, file_path, content)."""
    return f"""lang AS (SELECT repo, file_path, {_LANGUAGE} AS language, coalesce(content, '') AS content FROM {source}),
lexed AS (SELECT repo, file_path, language, content, {_strip(' ')} AS code,
  CASE WHEN language IN ('javascript', 'typescript', 'c', 'cpp', 'go') THEN {_strip(chr(92) + '1')} END AS quoted FROM lang),
wide AS (SELECT repo, file_path, language, content,
  coalesce(CASE WHEN language = 'python' THEN flatten(list_transform({_found('code', 'python_import')}, lambda m: {_listed('m')}))
    WHEN language IN ('javascript', 'typescript') THEN {_nonempty('quoted', 'script_import')}
    WHEN language = 'java' THEN {_nonempty('code', 'java_import')}
    WHEN language IN ('c', 'cpp') THEN {_nonempty('quoted', 'c_include')}
    WHEN language = 'go' THEN flatten(list_transform({_found('quoted', 'go_import_block', 0)}, lambda b: {_found('b', 'go_import')}))
    WHEN language = 'rust' THEN {_nonempty('code', 'rust_use')} END, {_STRINGS}) AS imports,
  coalesce(CASE WHEN language = 'python' THEN {_PY_FROM} END, {_FROMS}) AS from_imports,
  coalesce(CASE WHEN language = 'python' THEN {_nonempty('code', 'python_def')}
    WHEN language IN ('javascript', 'typescript') THEN {_without_control(_first_group('code', 'script_function', 3))}
    WHEN language = 'java' THEN {_JAVA_METHODS}
    WHEN language IN ('c', 'cpp') THEN {_without_control(_nonempty('code', 'c_function'))}
    WHEN language = 'go' THEN {_nonempty('code', 'go_function')}
    WHEN language = 'rust' THEN {_RUST_FNS} END, {_STRINGS}) AS functions,
  coalesce(CASE WHEN language = 'python' THEN {_nonempty('code', 'python_class')}
    WHEN language IN ('javascript', 'typescript') THEN list_filter({_nonempty('code', 'script_class')}, lambda x: x <> 'extends')
    WHEN language = 'java' THEN {_nonempty('code', 'java_class')}
    WHEN language IN ('c', 'cpp') THEN {_nonempty('code', 'c_class')}
    WHEN language = 'go' THEN {_nonempty('code', 'go_type')}
    WHEN language = 'rust' THEN {_first_group('code', 'rust_type', 4)} END, {_STRINGS}) AS classes,
  coalesce({_per_language(_calls)}, {_STRINGS}) AS calls FROM lexed)"""


def _summary_line(label: str, names: str, limit: int) -> str:
    return f"CASE WHEN len({names}) > 0 THEN concat({_str(label)}, array_to_string(({names})[1:{limit}], ', ')) END"


_DOTTED_FROMS = "list_transform(from_imports, lambda e: concat(e.module, '.', e.name))"
_FIRST_CALLS = "list_transform(list_filter(list_transform(range(1, len(calls) + 1), lambda i: {'n': calls[i], 'new': list_position(calls, calls[i]) = i}), lambda e: e.new), lambda e: e.n)"
_STRUCTURE = "concat_ws(chr(10), concat('Language: ', coalesce(language, 'unknown')), {}, {}, {}, {}, {})".format(
    _summary_line("Imports: ", "imports", 10), _summary_line("From Imports: ", _DOTTED_FROMS, 10),
    _summary_line("Classes/Types: ", "classes", 10), _summary_line("Functions: ", "functions", 15),
    _summary_line("Calls: ", _FIRST_CALLS, 15))

# ---- chunks ------------------------------------------------------------------


def _chunks_cte(source: str, structured: bool) -> str:
    """CTE `chunked` over `source`, which has language (and the symbol lists if `structured`)."""
    text = f"concat('File: ', file_path, chr(10), chr(10), {_STRUCTURE})" if structured else "CAST(NULL AS VARCHAR)"
    return f"""split AS (SELECT *, string_split(content, {_NL}) AS ls FROM {source}),
pieces AS (
  SELECT repo, file_path, 0 AS o, 'file_summary' AS chunk_type, file_path AS name, {text} AS content FROM split WHERE language IS NOT NULL
  UNION ALL SELECT repo, file_path, 1, 'full_file', file_path, content FROM split WHERE length(content) < {WHOLE_FILE_CHARS}
  UNION ALL SELECT repo, file_path, 1 + b, 'code_chunk',
    concat(file_path, ':L', CAST(b * {BLOCK_LINES} + 1 AS VARCHAR), '-', CAST(least((b + 1) * {BLOCK_LINES}, len(ls)) AS VARCHAR)),
    array_to_string(ls[b * {BLOCK_LINES} + 1:(b + 1) * {BLOCK_LINES}], {_NL})
  FROM (SELECT repo, file_path, ls, unnest(range(0, CAST(ceil(len(ls) / {BLOCK_LINES}.0) AS BIGINT))) AS b
        FROM split WHERE length(content) >= {WHOLE_FILE_CHARS})),
chunked AS (SELECT repo, file_path, row_number() OVER (PARTITION BY repo, file_path ORDER BY o) - 1 AS seq, chunk_type, name, content FROM pieces)"""


_REPO_LANG = f"withlang AS (SELECT repo, file_path, content, {_LANGUAGE} AS language FROM repo_files WHERE content IS NOT NULL)"
_EMBEDDED = """numbered AS (
  SELECT c.repo, c.file_path, c.seq, c.chunk_type, c.name, e.embedding IS NOT NULL AS valid
  FROM chunked c LEFT JOIN embeddings e
    ON e.vec_id = (CAST(regexp_extract(c.file_path, 'doc_([0-9]+)', 1) AS BIGINT) * 31 + c.seq * 17) % (SELECT CAST(floor((max(vec_id) + 1) * 1.2) AS BIGINT) FROM embeddings)),
valid AS (SELECT repo, file_path, row_number() OVER (PARTITION BY repo, file_path ORDER BY seq) - 1 AS chunk_index, chunk_type, name
  FROM numbered WHERE valid)"""
_CHANGED = f"""changed AS (SELECT f.repo, f.file_path, {_HASH.format('f.content')} AS content_hash FROM repo_files f
  LEFT JOIN hash_ledger l ON l.repo = f.repo AND l.file_path = f.file_path
  WHERE f.content IS NOT NULL AND {_HASH.format('f.content')} IS DISTINCT FROM l.content_hash)"""
_NEW = f"""new_chunks AS (SELECT v.* FROM valid v JOIN changed c USING (repo, file_path)
  JOIN (SELECT repo, file_path, {_OUTCOME} AS outcome FROM repo_files) o USING (repo, file_path) WHERE outcome = 'eligible')"""
_EMBEDDED_FULL = _EMBEDDED.replace("AS valid\n", "AS valid, substring(c.content, 1, 500) AS content, e.embedding\n").replace(
    "chunk_type, name\n  FROM numbered", "chunk_type, name, content, embedding\n  FROM numbered")
_INDEX_FULL = (f"{with_clause('hash_ledger')},\nreadable AS (SELECT * FROM repo_files WHERE content IS NOT NULL),\n{_symbols_cte('readable')},\n"
               f"{_chunks_cte('wide', True)},\n{_EMBEDDED_FULL},\n{_CHANGED}")
def _cte(name: str) -> str:
    return f"{name} AS ({view_sql(name, 'duckdb')})"


_INDEX = f"{with_clause('hash_ledger')},\n{_REPO_LANG},\n{_chunks_cte('withlang', False)},\n{_EMBEDDED},\n{_CHANGED}"

# ---- risk --------------------------------------------------------------------

_ADDED = f"array_to_string(list_filter(string_split(patch, {_NL}), lambda l: starts_with(l, '+')), {_NL})"


def _category_hits(pack: str) -> list[tuple[str, int, str, str]]:
    return [
        (cat, pts, label, "(" + " OR ".join(f"regexp_matches(added, {_str(p)}, 'i')" for p, _ in patterns) + ")")
        for cat, pts, label, patterns in rules.rule_pack(pack)
    ]


def _issues_cte(pack: str = "default") -> str:
    tick = "concat('`', file_path, '`')"
    rows = [(0, "sensitive_file", rules.SENSITIVE_POINTS, _SENSITIVE, f"concat('🔴 Sensitive file modified: ', {tick})")]
    for i, (cat, pts, label, hit) in enumerate(_category_hits(pack), 1):
        rows.append((i, cat, pts, hit, f"concat({_str(label + ' in ')}, {tick})"))
    order = len(rows)
    for files, names in ((("requirements.txt", "Pipfile"), rules.VULNERABLE_PYTHON), (("package.json",), rules.VULNERABLE_JAVASCRIPT)):
        for name in names:
            rows.append((order, "vulnerable_package", rules.PACKAGE_POINTS,
                         f"(file_path IN {_list(files)} AND contains(lower(patch), {_str(name)}))",
                         _str(f"📦 Potentially vulnerable package: `{name}`")))
            order += 1
    selects = "\n  UNION ALL ".join(
        f"SELECT repo, pr_id, file_ord, file_path, {o} AS issue_ord, {_str(kind)} AS kind, {pts} AS points, {txt} AS text FROM scanned WHERE {hit}"
        for o, kind, pts, hit, txt in rows)
    return f"scanned AS (SELECT *, {_ADDED} AS added FROM {{files}}),\nissues AS ({selects})"


def _issues(files: str, pack: str = "default") -> str:
    return _issues_cte(pack).replace("{files}", files)


def _risk_cte(files: str, impact: str = "(SELECT NULL AS repo, NULL AS pr_id, 0 AS n)") -> str:
    return f"""totals AS (SELECT repo, pr_id, CAST(count(*) AS BIGINT) AS changed_files_count,
  CAST(sum(coalesce(additions, 0)) AS BIGINT) AS total_additions, CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS total_deletions,
  bool_or({_IS_TEST}) AS tests_modified, bool_or(NOT {_IS_TEST}) AND NOT bool_or({_IS_TEST}) AS missing_tests FROM {files} GROUP BY ALL),
points AS (SELECT repo, pr_id, CAST(sum(points) AS BIGINT) AS points, CAST(count(*) AS BIGINT) AS n FROM issues GROUP BY ALL),
base AS (SELECT t.*, coalesce(p.points, 0) AS points, CAST(coalesce(p.n, 0) AS BIGINT) AS issue_count, CAST(coalesce(i.n, 0) AS BIGINT) AS impacted_files,
    total_additions + total_deletions AS lines
  FROM totals t LEFT JOIN points p USING (repo, pr_id) LEFT JOIN {impact} i ON i.repo = t.repo AND i.pr_id = t.pr_id),
raw AS (SELECT *,
    CASE WHEN changed_files_count > 10 THEN 25 WHEN changed_files_count > 5 THEN 10 ELSE 0 END
    + CASE WHEN lines > 500 THEN 20 WHEN lines > 200 THEN 10 ELSE 0 END + CASE WHEN missing_tests THEN 25 ELSE 0 END
    + CASE WHEN impacted_files > 5 THEN 15 WHEN impacted_files > 0 THEN 5 ELSE 0 END + points AS total FROM base),
risk AS (SELECT *, CAST(least(total, 100) AS BIGINT) AS score,
    CASE WHEN total >= 70 THEN 'Critical' WHEN total >= 50 THEN 'High' WHEN total >= 30 THEN 'Medium' ELSE 'Low' END AS level,
    list_filter([
      CASE WHEN changed_files_count > 10 THEN concat('Large PR (', changed_files_count, ' files)')
           WHEN changed_files_count > 5 THEN concat('Medium-sized PR (', changed_files_count, ' files)') END,
      CASE WHEN lines > 500 THEN concat('Many lines changed (', lines, ')') WHEN lines > 200 THEN concat('Moderate lines changed (', lines, ')') END,
      CASE WHEN missing_tests THEN 'No tests modified' END,
      CASE WHEN impacted_files > 5 THEN concat('High impact (', impacted_files, ' files may be affected)')
           WHEN impacted_files > 0 THEN concat('Some impact (', impacted_files, ' files may be affected)') END], lambda r: r IS NOT NULL) AS reasons FROM raw),
gated AS (SELECT *, CASE WHEN score >= 70 THEN 'failure' ELSE 'success' END AS state,
    CASE WHEN score >= 70 THEN concat('High risk PR (score: ', score, '/100). Please address concerns.')
         ELSE concat('AI review passed (risk: ', score, '/100)') END AS description FROM risk)"""


_BADGE = (
    "concat('## ', CASE WHEN score >= 70 THEN '🔴' WHEN score >= 40 THEN '🟡' ELSE '🟢' END, ' Risk Score: ', score, '/100 (', level, ')',"
    " CASE WHEN issue_count > 0 THEN concat(chr(10), '⚠️ **', issue_count, ' security issue(s) detected**') ELSE '' END)")
_PR_RISK = f"{with_clause('pr_files')},\n{_issues('pr_files')},\n{_risk_cte('pr_files')}"

# Totals that the host states in the documents.
_HOSTS = """hosts AS (SELECT repo, pr_id, CAST(count(*) + pr_id % 3 AS BIGINT) AS host_files, CAST(2 * sum(additions) AS BIGINT) AS host_additions,
  CAST(sum(deletions) + pr_id % 5 AS BIGINT) AS host_deletions FROM pr_files GROUP BY repo, pr_id)"""

# ---- similarity ----------------------------------------------------------------


def _unit(vector: str) -> str:
    return f"list_transform({vector}, lambda x: x / (sqrt(list_sum(list_transform({vector}, lambda y: y * y))) + 1e-8))"


def _top5(chunks: str, queries: str, order: str, condition: str = "true", k: int = 5) -> str:
    """CTE `hits`: exact search per repository; `queries` and `chunks` have repo, id, u (unit vector)."""
    return f"""hits AS (SELECT * FROM (
  SELECT repo, query_id, id, similarity, row_number() OVER (PARTITION BY repo, query_id ORDER BY similarity DESC, {order}) AS rank
  FROM (SELECT q.repo, q.id AS query_id, c.id, c.ord, round(list_inner_product(q.u, c.u), 12) AS similarity
        FROM {queries} q JOIN {chunks} c ON q.repo = c.repo WHERE {condition})) WHERE rank <= {k})"""


_VECTORS = f"{with_clause('vector_chunks')},\nunits AS (SELECT *, vec_id AS ord, {_unit('embedding')} AS u FROM vector_chunks)"

# ---- composite -------------------------------------------------------------------

_CODE = with_clause("code_prs", "code_chunks", "code_queries")
_CODE_SYMBOLS = f"{_CODE},\n{_symbols_cte('code_files')}"
_ID_RX = _str(symbols.ID)
_PR_SYMBOLS = """pr_names AS (SELECT DISTINCT repo, pr_id, kind, name FROM (
    SELECT p.repo, p.pr_id, 'function' AS kind, unnest(functions) AS name FROM code_prs p JOIN wide USING (repo, file_path)
    UNION ALL SELECT p.repo, p.pr_id, 'class', unnest(classes) FROM code_prs p JOIN wide USING (repo, file_path)
    UNION ALL SELECT p.repo, p.pr_id, 'import', unnest(imports) FROM code_prs p JOIN wide USING (repo, file_path)
    UNION ALL SELECT p.repo, p.pr_id, 'import', unnest(list_transform(from_imports, lambda e: e.module)) FROM code_prs p JOIN wide USING (repo, file_path)) s
  WHERE name IS NOT NULL)"""
_IMPACT = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY repo, pr_id, kind ORDER BY name) AS rn FROM pr_names WHERE kind <> 'import'),
searched AS (SELECT repo, pr_id, name AS symbol, CASE kind WHEN 'function' THEN rn - 1 ELSE rn + 2 END AS symbol_ord FROM ranked
  WHERE (kind = 'function' AND rn <= 3) OR (kind = 'class' AND rn <= 2)),
mentions AS (SELECT repo, symbol, file_path, count(*) AS n FROM (
    SELECT repo, file_path, unnest(regexp_extract_all(content, {_ID_RX}, 0)) AS symbol FROM code_files WHERE ends_with(file_path, '.py')) t GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, symbol ORDER BY n DESC, file_path) AS hit_ord FROM mentions) WHERE hit_ord <= 5),
impact AS (SELECT repo, pr_id, file, symbol, concat('May use ''', symbol, '''') AS reason, impact_ord FROM (
    SELECT s.repo, s.pr_id, b.file_path AS file, s.symbol, CAST(s.symbol_ord * 5 + b.hit_ord - 1 AS BIGINT) AS impact_ord,
      row_number() OVER (PARTITION BY s.repo, s.pr_id, b.file_path ORDER BY symbol_ord, hit_ord) AS rn
    FROM searched s JOIN best b USING (repo, symbol)
    WHERE NOT EXISTS (SELECT 1 FROM code_prs p WHERE p.repo = s.repo AND p.pr_id = s.pr_id AND p.file_path = b.file_path)) WHERE rn = 1)"""
_CONTEXT = f"""cu AS (SELECT repo, concat(file_path, ':', chunk_index) AS id, chunk_index AS ord, {_unit('embedding')} AS u FROM code_chunks),
qu AS (SELECT repo, CAST(pr_id AS VARCHAR) AS id, {_unit('embedding')} AS u FROM code_queries),
{_top5('cu', 'qu', 'ord, id')},
context AS (SELECT repo, pr_id, rank, file, content, relevance FROM (
  SELECT h.repo, CAST(h.query_id AS BIGINT) AS pr_id, c.file_path AS file, c.content, h.similarity AS relevance,
    row_number() OVER (PARTITION BY h.repo, h.query_id ORDER BY h.rank) AS rank
  FROM hits h JOIN code_chunks c ON c.repo = h.repo AND concat(c.file_path, ':', c.chunk_index) = h.id
  WHERE NOT EXISTS (SELECT 1 FROM code_prs p WHERE p.repo = h.repo AND CAST(p.pr_id AS VARCHAR) = h.query_id AND p.file_path = c.file_path)) WHERE rank <= 3)"""


def _summaries_cte(files: str, structured: bool) -> str:
    structures = f"SELECT repo, file_path, {_STRUCTURE} AS structure FROM wide WHERE language IS NOT NULL" if structured else (
        "SELECT NULL AS repo, NULL AS file_path, NULL AS structure WHERE false")
    return f"""structures AS ({structures}),
sized AS (SELECT p.repo, p.pr_id, p.file_ord, p.file_path, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions,
    length(coalesce(patch, '')) > 2000 AS truncated, substring(coalesce(patch, ''), 1, 2000) AS patch, coalesce(s.structure, '') AS structure,
    CASE WHEN coalesce(additions, 0) + coalesce(deletions, 0) < 10 THEN 'small' ELSE 'large' END AS size_class
  FROM {files} p LEFT JOIN structures s ON s.repo = p.repo AND s.file_path = p.file_path),
summaries AS (SELECT *, concat('**', file_path, '** (+', additions, '/-', deletions, ')', chr(10), chr(10), 'Diff content:', chr(10), '```', chr(10),
    patch, chr(10), '```', CASE WHEN structure <> '' THEN concat(chr(10), chr(10), 'Context: ', structure) ELSE '' END) AS summary FROM sized)"""


# Search text of every change.
_QUERY_TEXTS = """rn AS (SELECT *, row_number() OVER (PARTITION BY repo, pr_id, kind ORDER BY name) AS r FROM pr_names),
query_texts AS (SELECT repo, pr_id, concat_ws(chr(10), fns, cls, heads) AS query_text FROM
  (SELECT repo, pr_id, string_agg(substring(summary, 1, 200), chr(10) ORDER BY file_ord) AS heads FROM summaries WHERE file_ord < 3 GROUP BY ALL)
  LEFT JOIN (SELECT repo, pr_id, concat('Functions: ', string_agg(name, ', ' ORDER BY name)) AS fns FROM rn WHERE kind = 'function' AND r <= 5 GROUP BY ALL) USING (repo, pr_id)
  LEFT JOIN (SELECT repo, pr_id, concat('Classes: ', string_agg(name, ', ' ORDER BY name)) AS cls FROM rn WHERE kind = 'class' AND r <= 5 GROUP BY ALL) USING (repo, pr_id))"""


def _digest_vector(text: str) -> str:
    """64 token counts, placed by the token's digest."""
    tokens = f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}_]+')"
    places = f"list_transform({tokens}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64)"
    return f"list_transform([{places}], lambda ps: list_transform(range(0, 64), lambda d: CAST(len(list_filter(ps, lambda p: p = d)) AS DOUBLE)))[1]"


def _report(files: str, with_code: bool) -> str:
    impact_text = (
        "(SELECT repo, pr_id, string_agg(concat('- `', file, '` may be affected by changes to `', symbol, '`'), chr(10) ORDER BY impact_ord) AS impact_text"
        " FROM (SELECT *, row_number() OVER (PARTITION BY repo, pr_id ORDER BY impact_ord) AS rn FROM impact) WHERE rn <= 5 GROUP BY ALL)"
        if with_code else "(SELECT NULL AS repo, NULL AS pr_id, NULL AS impact_text WHERE false)")
    context_text = (
        "(SELECT repo, pr_id, concat('The following related code was found in the codebase:', chr(10), string_agg(concat(chr(10), '**`', file,"
        " '`** (relevance: ', printf('%.2f', relevance), ')', chr(10), '```', chr(10), substring(content, 1, 300), chr(10), '```'), chr(10) ORDER BY rank)) AS context_text"
        " FROM context GROUP BY ALL)"
        if with_code else "(SELECT NULL AS repo, NULL AS pr_id, NULL AS context_text WHERE false)")
    missing = (
        "CASE WHEN r.repo NOT IN (SELECT repo FROM code_chunks) THEN '⚠️ Codebase not indexed yet. Run indexing for better context.'"
        " ELSE 'No additional context found.' END" if with_code else "'No additional context found.'")
    return f"""SELECT r.repo, r.pr_id, CAST(0 AS BIGINT) AS part, summaries_text,
  coalesce(issues_text, '✅ No security issues detected.') AS issues_text,
  coalesce(impact_text, 'No cross-file impacts detected.') AS impact_text,
  coalesce(context_text, {missing}) AS context_text,
  concat('## PR Review (Fallback Mode)', chr(10), chr(10), '**Risk Level**: ', level, chr(10), chr(10),
    '### Files Changed', chr(10), files_text, CASE WHEN missing_tests THEN
    concat(chr(10), '⚠️ **Warning**: No tests were modified. Consider adding tests for the new code.') ELSE '' END) AS body
FROM risk r
JOIN (SELECT repo, pr_id, string_agg(summary, concat(chr(10), chr(10)) ORDER BY file_ord) AS summaries_text,
    string_agg(concat('- ', file_path, ' (+', additions, '/-', deletions, ')', chr(10)), '' ORDER BY file_ord) AS files_text
  FROM summaries GROUP BY ALL) s USING (repo, pr_id)
LEFT JOIN (SELECT repo, pr_id, concat('⚠️ **SECURITY ISSUES FOUND:**', chr(10), string_agg(concat('- ', text), chr(10) ORDER BY file_ord, issue_ord)) AS issues_text
  FROM issues GROUP BY ALL) i USING (repo, pr_id)
LEFT JOIN {impact_text} m USING (repo, pr_id)
LEFT JOIN {context_text} c USING (repo, pr_id)"""


_REVIEW = ",\n".join((
    _CODE_SYMBOLS, _PR_SYMBOLS, _IMPACT, _CONTEXT, _issues("code_prs"),
    _risk_cte("code_prs", "(SELECT repo, pr_id, count(*) AS n FROM impact GROUP BY ALL)"), _summaries_cte("code_prs", True)))

# ---- events --------------------------------------------------------------------

_STATUS = (
    "CASE WHEN event = 'pull_request' AND action IN ('opened', 'synchronize') THEN 'processing'"
    " WHEN (event = 'installation' AND action = 'created') OR (event = 'installation_repositories' AND action = 'added') THEN 'indexing'"
    " ELSE 'ignored' END")
_HOOKS = with_clause("webhooks")


def _hmac(body: str, secret: str) -> str:
    key = secret.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"concat('sha256=', sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({body})))))"


def statements() -> dict[str, str]:
    from codetide.workload.registry import WEBHOOK_SECRET

    routed = f"{_HOOKS} SELECT event_id, event, action, {_STATUS} AS status FROM webhooks"
    return {
        "corpus_scan": f"{with_clause('repo_files')} SELECT repo, file_path, size_bytes, CAST(length(content) AS BIGINT) AS n_chars FROM repo_files",
        "detect_language": f"{with_clause('repo_files')} SELECT repo, file_path, {_LANGUAGE} AS language, ({_LANGUAGE}) IS NOT NULL AS parseable FROM repo_files",
        "index_eligibility": f"{with_clause('repo_files')} SELECT repo, file_path, {_OUTCOME} AS outcome FROM repo_files",
        "content_hash": f"SELECT doc_id, {_HASH.format('text')} AS content_hash FROM documents",
        "needs_update": f"{with_clause('hash_ledger')}, {_CHANGED} SELECT * FROM changed",
        "chunk_lines": (
            "WITH docs AS (SELECT source AS repo, concat('doc_', doc_id, '.md') AS file_path, text AS content, CAST(NULL AS VARCHAR) AS language FROM documents),\n"
            f"{_chunks_cte('docs', False)} SELECT * FROM chunked"),
        "chunk_code": f"{with_clause('code_files')},\n{_symbols_cte('code_files')},\n{_chunks_cte('wide', True)} SELECT * FROM chunked",
        "valid_chunks": f"{_INDEX} SELECT * FROM valid",
        "upsert_chunks": (
            f"{_INDEX},\n{_NEW} SELECT repo, file_path, CAST(0 AS BIGINT) AS chunk_index, 'full_file' AS chunk_type, file_path AS name FROM hash_ledger"
            " WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM new_chunks) UNION ALL SELECT * FROM new_chunks"),
        "upsert_hashes": (
            f"{_INDEX}, done AS (SELECT * FROM changed WHERE (repo, file_path) IN (SELECT (repo, file_path) FROM valid))"
            " SELECT * FROM hash_ledger WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM done) UNION ALL SELECT * FROM done"),
        "delete_files": (
            f"{with_clause('hash_ledger', 'pr_files')}, removed AS (SELECT file_path FROM pr_files WHERE status = 'removed')"
            " SELECT repo, count(*) AS chunks_left, count(*) AS files_left FROM hash_ledger l"
            " WHERE NOT EXISTS (SELECT 1 FROM removed x JOIN repo_files f USING (file_path) WHERE f.repo = l.repo AND f.file_path = l.file_path) GROUP BY repo"),
        "index_stats": (
            f"{_INDEX},\n{_NEW} SELECT repo, coalesce(c.n, 0) AS total_chunks, coalesce(l.n, 0) AS indexed_files"
            " FROM (SELECT repo, count(*) AS n FROM new_chunks GROUP BY repo) c FULL JOIN (SELECT repo, count(*) AS n FROM hash_ledger GROUP BY repo) l USING (repo)"),
        "index_run_stats": (
            f"{_INDEX},\n{_NEW}, labelled AS (SELECT f.repo, CASE WHEN o <> 'eligible' THEN 'skipped' WHEN content IS NULL THEN 'errors'"
            " WHEN (f.repo, f.file_path) IN (SELECT (repo, file_path) FROM new_chunks) THEN 'indexed' ELSE 'skipped' END AS outcome"
            f" FROM (SELECT *, {_OUTCOME} AS o FROM repo_files) f WHERE o <> 'pruned')"
            " SELECT repo, count(*) FILTER (outcome = 'indexed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped,"
            " count(*) FILTER (outcome = 'errors') AS errors FROM labelled GROUP BY repo"),
        "index_load": (
            f"{with_clause('code_chunks')} SELECT repo, coalesce(c.n, 0) AS total_chunks, l.n AS indexed_files"
            " FROM (SELECT repo, count(*) AS n FROM code_files GROUP BY repo) l LEFT JOIN (SELECT repo, count(*) AS n FROM code_chunks GROUP BY repo) c USING (repo)"),
        "index_update": (
            f"{_INDEX_FULL},\n{_NEW} SELECT repo, file_path, CAST(0 AS BIGINT) AS chunk_index, 'full_file' AS chunk_type, file_path AS name, md5(content_hash) AS content_md5,"
            " CAST(0 AS BIGINT) AS width, CAST(0 AS DOUBLE) AS vector_sum FROM hash_ledger WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM new_chunks)"
            " UNION ALL SELECT repo, file_path, chunk_index, chunk_type, name, md5(content), len(embedding),"
            " round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) FROM new_chunks"),
        "index_remove": (
            f"{_INDEX},\n{_NEW},\n{_cte('pr_files')}, gone AS (SELECT DISTINCT f.repo, f.file_path FROM pr_files x JOIN repo_files f USING (file_path) WHERE x.status = 'removed'),"
            " done AS (SELECT DISTINCT repo, file_path FROM new_chunks),"
            " kept AS (SELECT repo, file_path FROM hash_ledger WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM done)),"
            " c AS (SELECT repo, count(*) AS n FROM (SELECT repo, file_path FROM kept UNION ALL SELECT repo, file_path FROM new_chunks)"
            "   WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM gone) GROUP BY repo),"
            " l AS (SELECT repo, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT * FROM done) WHERE (repo, file_path) NOT IN (SELECT (repo, file_path) FROM gone) GROUP BY repo)"
            " SELECT repo, coalesce(c.n, 0) AS total_chunks, coalesce(l.n, 0) AS indexed_files FROM c FULL JOIN l USING (repo)"),
        "embed_chunks": (
            f"{with_clause('code_files')},\n{_symbols_cte('code_files')},\n{_chunks_cte('wide', True)} SELECT repo, file_path, seq,"
            r" CASE WHEN n > 0 THEN 64 ELSE 0 END AS dimensions, CAST(n AS DOUBLE) AS token_count FROM"
            r" (SELECT *, len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS n FROM chunked)"),
        "event_scan": (
            f"{_HOOKS} SELECT event_id, received_at, event, action, installation_id, repo,"
            " CASE WHEN event_id % 19 <> 5 THEN sha END AS sha FROM webhooks"),
        "event_scan_files": (
            f"{_HOOKS} SELECT event_id, received_at, event, action, installation_id, repo,"
            " CASE WHEN event_id % 19 <> 5 THEN sha END AS sha FROM webhooks"),
        "route_events": routed,
        "route_events_stream": routed,
        "index_worklist": (
            f"{_HOOKS} SELECT event_id, installation_id, concat(CASE event WHEN 'installation' THEN 'org/a' ELSE 'org/b' END, event_id) AS repo"
            f" FROM webhooks WHERE {_STATUS} = 'indexing'"),
        "review_requests": (
            f"{_HOOKS} SELECT event_id, repo, CASE WHEN event_id % 17 <> 3 THEN event_id END AS pr_id, CASE WHEN event_id % 19 <> 5 THEN sha END AS sha,"
            f" CASE WHEN event_id % 17 = 3 OR event_id = 0 OR installation_id = 0 THEN 'Missing context data' END AS error FROM webhooks WHERE {_STATUS} = 'processing'"),
        "verify_signature": (
            f"{_HOOKS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'sha256=00' ELSE {_hmac('body', WEBHOOK_SECRET)} END AS signature,"
            " CASE event_id % 4 WHEN 0 THEN 'missing_signature' WHEN 1 THEN 'invalid_signature' ELSE 'ok' END AS verdict FROM webhooks"),
        "latest_status": (
            f"{_HOOKS} SELECT repo, sha, arg_max(state, event_id) AS state, arg_max(concat(state, ' by ', event), event_id) AS description"
            " FROM (SELECT *, ['pending', 'success', 'failure'][event_id % 3 + 1] AS state FROM webhooks) GROUP BY repo, sha"),
        "latest_status_stream": (
            f"{_HOOKS} SELECT repo, sha, arg_max(state, event_id) AS state, arg_max(concat(state, ' by ', event), event_id) AS description"
            " FROM (SELECT *, ['pending', 'success', 'failure'][event_id % 3 + 1] AS state FROM webhooks) GROUP BY repo, sha"),
        "pr_files_scan": (
            f"{with_clause('pr_files')} SELECT repo, pr_id, file_path, status, patch, additions, deletions, CAST(NULL AS VARCHAR) AS error FROM pr_files WHERE pr_id % 7 <> 3 AND pr_id <> 0"
            " UNION ALL SELECT repo, pr_id, NULL, NULL, NULL, NULL, NULL, 'Missing context data' FROM pr_files WHERE pr_id % 7 = 3 OR pr_id = 0"),
        "pr_documents_scan": (
            f"{with_clause('pr_files')},\n{_HOSTS} SELECT repo, pr_id, file_path, status, md5(patch) AS patch_md5, additions, deletions, host_files, host_additions, host_deletions,"
            " CAST(NULL AS VARCHAR) AS error FROM pr_files JOIN hosts USING (repo, pr_id) WHERE pr_id % 7 <> 3 AND pr_id <> 0"
            " UNION ALL SELECT repo, pr_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Missing context data' FROM hosts WHERE pr_id % 7 = 3 OR pr_id = 0"),
        "pr_risk_host_totals": (
            f"{with_clause('pr_files')},\n{_HOSTS}, complete AS (SELECT * FROM pr_files WHERE pr_id % 7 <> 3 AND pr_id <> 0),\n{_issues('complete')},\n"
            + _risk_cte("complete").replace("FROM totals t LEFT JOIN", "FROM (SELECT o.* REPLACE (h.host_files AS changed_files_count, h.host_additions AS total_additions,"
                                            " h.host_deletions AS total_deletions) FROM totals o JOIN hosts h ON o.repo = h.repo AND o.pr_id = h.pr_id) t LEFT JOIN")
            + " SELECT repo, pr_id, changed_files_count, total_additions, total_deletions, issue_count, score, level, array_to_string(reasons, '; ') AS reasons FROM risk"),
        "rule_table_findings": (
            f"{with_clause('pr_files')}, scanned AS (SELECT *, {_ADDED} AS added FROM pr_files), matched AS ("
            + " UNION ALL ".join(
                f"SELECT repo, pr_id, file_ord, file_path, {_str(cat)} AS category, CAST({pts} AS BIGINT) AS points, CAST("
                + " + ".join(f"CAST(regexp_matches(added, {_str(p)}, 'i') AS INTEGER)" for p, _ in patterns) + " AS BIGINT) AS patterns FROM scanned"
                for cat, pts, _, patterns in rules.rule_pack("extended"))
            + ") SELECT * FROM matched WHERE patterns > 0"),
        "pr_totals": f"{_PR_RISK} SELECT repo, pr_id, total_additions, total_deletions, changed_files_count FROM totals",
        "test_impact": f"{_PR_RISK} SELECT repo, pr_id, tests_modified, missing_tests FROM totals",
        "added_lines": f"{with_clause('pr_files')} SELECT repo, pr_id, file_ord, {_ADDED} AS added_code FROM pr_files",
        "sensitive_files": f"{with_clause('pr_files')} SELECT repo, pr_id, file_ord, file_path FROM pr_files WHERE {_SENSITIVE}",
        "security_findings": (
            f"{_PR_RISK} SELECT repo, pr_id, file_ord, file_path, kind AS category, points, text FROM issues WHERE kind NOT IN ('sensitive_file', 'vulnerable_package')"),
        "security_findings_extended": (
            f"{with_clause('pr_files')}, {_issues('pr_files', 'extended')} SELECT repo, pr_id, file_ord, kind AS category, points FROM issues"
            " WHERE kind NOT IN ('sensitive_file', 'vulnerable_package')"),
        "findings_summary": (
            f"{_PR_RISK} SELECT kind AS category, count(*) AS findings, CAST(sum(points) AS BIGINT) AS points FROM issues"
            " WHERE kind NOT IN ('sensitive_file', 'vulnerable_package') GROUP BY kind"),
        "vulnerable_packages": f"{_PR_RISK} SELECT repo, pr_id, file_ord, text FROM issues WHERE kind = 'vulnerable_package'",
        "security_issues": (
            f"{_PR_RISK} SELECT repo, pr_id, CAST(0 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY file_ord, issue_ord) AS issues FROM issues GROUP BY repo, pr_id"),
        "pr_risk": (
            f"{_PR_RISK} SELECT repo, pr_id, changed_files_count, total_additions, total_deletions, tests_modified, missing_tests, issue_count,"
            " score, level, array_to_string(reasons, '; ') AS reasons FROM risk"),
        "risk_factors": (
            f"{_PR_RISK} SELECT repo, pr_id, CAST(-1 AS BIGINT) AS file_ord, CAST(NULL AS VARCHAR) AS file_path, CAST(i - 1 AS INTEGER) AS ord, 'reason' AS factor, reasons[i] AS text"
            " FROM (SELECT *, unnest(range(1, len(reasons) + 1)) AS i FROM risk)"
            " UNION ALL SELECT repo, pr_id, file_ord, file_path, issue_ord, kind, text FROM issues"),
        "gate_status": f"{_PR_RISK} SELECT repo, pr_id, score, state, description FROM gated",
        "risk_badge": f"{_PR_RISK} SELECT repo, pr_id, {_BADGE} AS badge FROM risk",
        "status_rows": (
            f"{_PR_RISK}, req AS (SELECT repo, pr_id, concat('c', pr_id) AS sha, pr_id % 11 = 5 AS failed, state, description FROM gated WHERE pr_id % 7 <> 3)"
            " SELECT repo, pr_id, sha, CAST(0 AS BIGINT) AS seq, 'pending' AS state, 'AI review in progress...' AS description, 'code-review' AS context FROM req"
            " UNION ALL SELECT repo, pr_id, sha, 1, CASE WHEN failed THEN 'error' ELSE state END,"
            " CASE WHEN failed THEN 'Failed: Missing context data' ELSE description END, 'code-review' FROM req"),
        "fix_candidates": (
            f"{_PR_RISK} SELECT repo, pr_id, file_ord, concat('### ', file_path, chr(10), '```diff', chr(10), substring(patch, 1, 1000), chr(10), '```') AS snippet"
            " FROM pr_files p WHERE file_ord < 3 AND patch <> '' AND EXISTS (SELECT 1 FROM issues i WHERE i.repo = p.repo AND i.pr_id = p.pr_id)"),
        "fix_requests": (
            f"{_PR_RISK}, code AS (SELECT repo, pr_id, string_agg(concat('### ', file_path, chr(10), '```diff', chr(10), substring(patch, 1, 1000), chr(10), '```'), chr(10) ORDER BY file_ord) AS snippets"
            " FROM pr_files WHERE file_ord < 3 AND patch <> '' GROUP BY ALL)"
            " SELECT repo, pr_id, CAST(0 AS BIGINT) AS part, concat('## Files Changed', chr(10), snippets, chr(10), chr(10), '## Security Issues', chr(10), bullets) AS request"
            " FROM code JOIN (SELECT repo, pr_id, string_agg(concat('- ', text), chr(10) ORDER BY file_ord, issue_ord) AS bullets FROM issues GROUP BY ALL) USING (repo, pr_id)"),
        "similar_chunks": f"{_VECTORS},\n{_top5('units', 'units', 'ord')} SELECT repo, query_id, id, rank, round(similarity, 6) AS similarity FROM hits",
        "similar_filtered": (
            f"{_VECTORS},\n{_top5('units', 'units', 'ord', condition=_str('code_chunk') + ' = c.chunk_type')}"
            " SELECT repo, query_id, id, rank, round(similarity, 6) AS similarity FROM hits"),
        "similar_one_query": (
            f"{_VECTORS} SELECT vec_id, repo, round(u[1] / (1 + 1e-8), 6) AS similarity, round(1 - round(u[1] / (1 + 1e-8), 12), 6) AS distance"
            " FROM units ORDER BY round(u[1] / (1 + 1e-8), 12) DESC, vec_id LIMIT 5"),
        "symbol_extract": f"{_CODE_SYMBOLS} {_symbol_rows()}",
        "symbol_counts": f"{_CODE_SYMBOLS} SELECT language, kind, count(*) AS n FROM ({_symbol_rows()}) GROUP BY language, kind",
        "structure_summary": f"{_CODE_SYMBOLS} SELECT repo, file_path, {_STRUCTURE} AS structure FROM wide WHERE language IS NOT NULL",
        "pr_symbols": f"{_CODE_SYMBOLS},\n{_PR_SYMBOLS} SELECT * FROM pr_names",
        "impact_analysis": f"{_CODE_SYMBOLS},\n{_PR_SYMBOLS},\n{_IMPACT} SELECT * FROM impact",
        "impact_from_postings": f"{_CODE_SYMBOLS},\n{_PR_SYMBOLS},\n{_IMPACT} SELECT * FROM impact",
        "context_retrieval": f"{_CODE},\n{_CONTEXT} SELECT repo, pr_id, rank, file, content, round(relevance, 6) AS relevance FROM context",
        "retrieval_status": (
            f"{_CODE} SELECT DISTINCT repo, pr_id, CASE WHEN repo NOT IN (SELECT repo FROM code_chunks) THEN 'needs_indexing'"
            " WHEN (repo, pr_id) NOT IN (SELECT (repo, pr_id) FROM code_queries) THEN 'no_vector' ELSE 'searched' END AS status FROM code_prs"),
        "retrieval_query_text": (
            f"{_CODE_SYMBOLS},\n{_PR_SYMBOLS},\n{_summaries_cte('code_prs', True)},\n"
            "rn AS (SELECT *, row_number() OVER (PARTITION BY repo, pr_id, kind ORDER BY name) AS r FROM pr_names)\n"
            "SELECT repo, pr_id, concat_ws(chr(10), fns, cls, heads) AS query_text FROM"
            " (SELECT repo, pr_id, string_agg(substring(summary, 1, 200), chr(10) ORDER BY file_ord) AS heads FROM summaries WHERE file_ord < 3 GROUP BY ALL)"
            " LEFT JOIN (SELECT repo, pr_id, concat('Functions: ', string_agg(name, ', ' ORDER BY name)) AS fns FROM rn WHERE kind = 'function' AND r <= 5 GROUP BY ALL) USING (repo, pr_id)"
            " LEFT JOIN (SELECT repo, pr_id, concat('Classes: ', string_agg(name, ', ' ORDER BY name)) AS cls FROM rn WHERE kind = 'class' AND r <= 5 GROUP BY ALL) USING (repo, pr_id)"),
        "context_from_text": (
            f"{_CODE_SYMBOLS},\n{_PR_SYMBOLS},\n{_summaries_cte('code_prs', True)},\n{_QUERY_TEXTS},\n{_chunks_cte('wide', True)},\n"
            f"vc AS (SELECT repo, file_path, seq, chunk_type, name, substring(content, 1, 500) AS content, {_digest_vector('content')} AS v FROM chunked),\n"
            f"cu AS (SELECT *, concat(file_path, ':', ord) AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path ORDER BY seq) - 1 AS ord, {_unit('v')} AS u FROM vc WHERE list_sum(v) > 0)),\n"
            f"vq AS (SELECT repo, CAST(pr_id AS VARCHAR) AS id, {_digest_vector('query_text')} AS v FROM query_texts WHERE query_text <> ''),\n"
            f"qu AS (SELECT *, {_unit('v')} AS u FROM vq WHERE list_sum(v) > 0),\n{_top5('cu', 'qu', 'ord, id')}\n"
            "SELECT repo, CAST(query_id AS BIGINT) AS pr_id, row_number() OVER (PARTITION BY repo, query_id ORDER BY hit) AS rank, file, chunk_type, name, content_md5,"
            " round(similarity, 6) AS relevance, round(1 - similarity, 6) AS distance FROM (SELECT h.repo, h.query_id, h.rank AS hit, h.similarity, c.file_path AS file, c.chunk_type, c.name, md5(c.content) AS content_md5"
            " FROM hits h JOIN cu c ON c.repo = h.repo AND c.id = h.id"
            " WHERE NOT EXISTS (SELECT 1 FROM code_prs p WHERE p.repo = h.repo AND CAST(p.pr_id AS VARCHAR) = h.query_id AND p.file_path = c.file_path)) QUALIFY rank <= 3"),
        "change_size_class": f"{with_clause('pr_files')}, {_summaries_cte('pr_files', False)} SELECT repo, pr_id, file_ord, size_class, truncated FROM summaries",
        "file_summaries": f"{_CODE_SYMBOLS},\n{_summaries_cte('code_prs', True)} SELECT repo, pr_id, file_ord, summary FROM summaries",
        "review_with_texts": (
            f"{_CODE_SYMBOLS},\n{_summaries_cte('code_prs', True)} SELECT repo, pr_id, file_ord, CASE WHEN size_class <> 'large' THEN summary ELSE"
            " concat('**', file_path, '** (+', additions, '/-', deletions, ')', chr(10), 'Answer ', md5(concat('File: ', file_path, ' (+', additions, '/-', deletions, ')',"
            " CASE WHEN truncated THEN ' (truncated)' ELSE '' END, chr(10), chr(10), 'Code Structure:', chr(10), CASE WHEN structure <> '' THEN structure ELSE 'N/A' END,"
            " chr(10), chr(10), 'Diff:', chr(10), '```', chr(10), patch, chr(10), '```'))) END AS summary FROM summaries"),
        "summary_requests": (
            f"{_CODE_SYMBOLS},\n{_summaries_cte('code_prs', True)} SELECT repo, pr_id, file_ord, concat('File: ', file_path, ' (+', additions, '/-', deletions, ')',"
            " CASE WHEN truncated THEN ' (truncated)' ELSE '' END, chr(10), chr(10), 'Code Structure:', chr(10), CASE WHEN structure <> '' THEN structure ELSE 'N/A' END,"
            " chr(10), chr(10), 'Diff:', chr(10), '```', chr(10), patch, chr(10), '```') AS request FROM summaries WHERE size_class = 'large'"),
        "pr_report": f"{_REVIEW}\n{_report('code_prs', True)}",
        "pr_report_patches": f"{_PR_RISK},\n{_summaries_cte('pr_files', False)}\n{_report('pr_files', False)}",
        "pr_bodies": (
            f"{_PR_RISK},\n{_summaries_cte('pr_files', False)}\nSELECT repo, pr_id, string_agg(body, '' ORDER BY part) AS body FROM ({_report('pr_files', False)}) GROUP BY repo, pr_id"),
        "pr_review": (
            f"{_REVIEW} SELECT g.repo, g.pr_id, changed_files_count, total_additions, total_deletions, tests_modified, missing_tests, impacted_files, issue_count,"
            " coalesce(c.n, 0) AS context_chunks, score, level, state, description FROM gated g"
            " LEFT JOIN (SELECT repo, pr_id, count(*) AS n FROM context GROUP BY ALL) c USING (repo, pr_id)"),
    }


def _symbol_rows() -> str:
    def rows(kind: str, column: str) -> str:
        return (
            f"SELECT repo, file_path, language, {_str(kind)} AS kind, CAST(NULL AS VARCHAR) AS module, unnest({column}) AS name,"
            f" unnest(range(0, len({column}))) AS pos FROM wide")

    froms = (
        "SELECT repo, file_path, language, 'from_import', unnest(list_transform(from_imports, lambda e: e.module)),"
        " unnest(list_transform(from_imports, lambda e: e.name)), unnest(range(0, len(from_imports))) FROM wide")
    return " UNION ALL ".join(
        (rows("import", "imports"), froms, rows("function", "functions"), rows("class", "classes"), rows("call", "calls")))
