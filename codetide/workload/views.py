"""Input tables of the registered queries, derived from whole driver tables.

The driver tables hold prose, vectors and events; these views give them the shape of
repositories, change requests and webhooks. Each view is one SELECT whose text is the same
for Spark and for the SQL engine that checks the results, up to three function names.
"""

from pyspark.sql import DataFrame, SparkSession


BASE_TABLES = ("documents", "embeddings", "events")

_PATH = """concat(CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'app' WHEN 2 THEN 'node_modules/lib' WHEN 3 THEN 'tests'
    WHEN 4 THEN 'config/secrets' WHEN 5 THEN 'build' ELSE 'lib' END, '/doc_', CAST(doc_id AS VARCHAR(20)),
  CASE doc_id % 13 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.tsx' WHEN 3 THEN '.java' WHEN 4 THEN '.c' WHEN 5 THEN '.cpp'
    WHEN 6 THEN '.go' WHEN 7 THEN '.rs' WHEN 8 THEN '.md' WHEN 9 THEN '.json' WHEN 10 THEN '.png' WHEN 11 THEN '.pem' ELSE '' END)"""

# Repositories with every eligibility case; some contents could not be decoded.
REPO_FILES = f"""
SELECT doc_id, concat('org/', source) AS repo, {_PATH} AS file_path,
  CAST(@BYTES(text) AS BIGINT) AS size_bytes,
  CASE WHEN doc_id % 31 = 30 THEN NULL ELSE text END AS content
FROM documents"""

# Hashes of an earlier index: renamed (absent), stale and current entries.
HASH_LEDGER = """
SELECT repo, CASE doc_id % 3 WHEN 0 THEN concat(file_path, '.old') ELSE file_path END AS file_path,
  CASE WHEN doc_id % 5 = 0 THEN '0000000000000000' ELSE @HASH(coalesce(content, '')) END AS content_hash
FROM repo_files"""

# Change requests of 1 to 12 files (78 documents make 12 of them), about a third with a finding.
PR_FILES = f"""
SELECT concat('org/src', CAST(pr_id % 20 AS VARCHAR(20))) AS repo, pr_id, file_ord,
  CASE doc_id % 29 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' ELSE {_PATH} END AS file_path,
  CASE doc_id % 11 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS status,
  CASE WHEN doc_id % 41 = 40 THEN NULL ELSE
  concat(CASE doc_id % 29 WHEN 0 THEN '+pycrypto>=2,<3' WHEN 1 THEN '-"event-stream": "3.3.6",' ELSE
    CASE doc_id % 37 WHEN 0 THEN '+db_password = "tr0ub4dor-77"' WHEN 1 THEN '+conn.execute(stmt + where)'
      WHEN 2 THEN '+price = eval("1.2 * " + factor)' WHEN 3 THEN '+tag = md5(row)' WHEN 4 THEN '+state = pickle.loads(frame)'
      WHEN 5 THEN '+return redirect(request.args)' WHEN 6 THEN '+f = open(f"{{name}}")' WHEN 7 THEN '+el.innerHTML = a + b'
      WHEN 8 THEN '+render_template_string(t)' WHEN 9 THEN '+db.find({{"$gt": 1}})' WHEN 10 THEN '+decode(t, verify=False)'
      WHEN 11 THEN '-price = eval("1.2 * " + factor)' WHEN 12 THEN '+cursor.execute(q)'
      WHEN 13 THEN '+OPENAI_KEY = k0qwertyuiopasdfghjklzx9' WHEN 14 THEN '+APP_SECRET = q1w2e3r4t5y6' WHEN 15 THEN '+CI_TOKEN = zxcvbnmasdfghjklqwerty'
      WHEN 16 THEN '+SLACK_TOKEN = later' WHEN 17 THEN '+requests.get("http://" + peer)' WHEN 18 THEN '+requests.post(f"{{peer}}/hook")'
      WHEN 19 THEN '+urllib.request.urlopen("http://" + peer)' WHEN 20 THEN '+httpx.get(f"{{peer}}")' ELSE '+limit = min(width, 80)' END END,
    chr(10), ' context line', chr(10), '+', replace(text, chr(10), concat(chr(10), '+'))) END AS patch,
  CAST(1 + doc_id % 97 AS BIGINT) AS additions, CAST(doc_id % 9 AS BIGINT) AS deletions
FROM (
  SELECT doc_id, text, CAST(floor(doc_id / 78) AS BIGINT) * 12 + t AS pr_id,
    doc_id % 78 - CAST(t * (t + 1) / 2 AS BIGINT) AS file_ord
  FROM (SELECT doc_id, text, CAST(floor((sqrt(CAST(8 * (doc_id % 78) + 1 AS DOUBLE)) - 1) / 2) AS BIGINT) AS t FROM documents) d
) p"""


def _source(slash: bool, *code: str) -> str:
    """Concatenation of code lines and the whole document as a line comment."""
    mark = "// " if slash else "# "
    lines = ", chr(10), ".join(code)
    return f"concat({lines}, chr(10), '{mark}', replace(text, chr(10), concat(chr(10), '{mark}')), chr(10))"


_D = {
    "fn": "CAST(k % 10 AS VARCHAR(20))",
    "callee": "CAST((k + 4) % 10 AS VARCHAR(20))",
    "cls": "CAST(k % 40 AS VARCHAR(20))",
    "mod": "CAST(doc_id % 10 AS VARCHAR(20))",
}
_PY = _source(
    False, "'import os, sys'", "concat('from pkg.m', {mod}, ' import helper, other as o')", "concat('class C_', {cls}, '(Base):')",
    "concat('    def fn_', {fn}, '(self):')", "concat('        return fn_', {callee}, '(self.load(1))')",
    "'    TEXT = \"def not_code(): pass\"'")
_GO = _source(
    True, "'package main'", "'import ('", "'    \"fmt\"'", "'    \"net/http\"'", "')'", "concat('type T_', {cls}, ' struct {}')",
    "concat('func (t *T_', {cls}, ') fn_', {fn}, '() {')", "concat('  fmt.Println(fn_', {callee}, '(1))')", "'}'")
_JS = _source(
    True, "'import x from \"lib\";'", "concat('class K_', {cls}, ' extends Base {')", "'  render() {'",
    "concat('    return fn_', {callee}, '(this.state);')", "'  }'", "'}'",
    "concat('function fn_', {fn}, '() { return 1; }')", "'const go = async (x) => run(x);'")
_TS = _source(
    True, "'import { a } from ''./lib'';'", "concat('export class K_', {cls}, ' {')",
    "concat('  async fn_', {fn}, '(id: number): Promise<User> {')", "concat('    return await fn_', {callee}, '(id);')", "'  }'", "'}'")
_JAVA = _source(
    True, "'import java.util.List;'", "concat('public class J_', {cls}, ' {')", "concat('    public int fn_', {fn}, '(List<Integer> xs) {')",
    "concat('        return xs.size() + fn_', {callee}, '(xs);')", "'    }'", "'}'")
_C = _source(
    True, "'#include <stdio.h>'", "'#include \"user.h\"'", "concat('struct S_', {cls}, ' { int v; };')",
    "concat('int fn_', {fn}, '(int a) {')", "concat('    return fn_', {callee}, '(a);')", "'}'")
_CPP = _source(
    True, "'#include <vector>'", "concat('class M_', {cls}, ' {};')", "concat('int fn_', {fn}, '(int a) {')",
    "concat('    return std::max(a, fn_', {callee}, '(a));')", "'}'")
_RS = _source(
    True, "'use std::collections::HashMap;'", "concat('struct R_', {cls}, ' { id: u32 }')", "concat('impl R_', {cls}, ' {')",
    "concat('    fn fn_', {fn}, '(id: u32) -> u32 { fn_', {callee}, '(id) }')", "'}'")


def _filled(template: str) -> str:
    for name, sql in _D.items():
        template = template.replace("{" + name + "}", sql)
    return template


_LANGS = ((".py", _PY), (".go", _GO), (".js", _JS), (".ts", _TS), (".java", _JAVA), (".c", _C), (".cpp", _CPP), (".rs", _RS))

# Sources in eight languages whose symbols are used by other files of the repository.
CODE_FILES = f"""
SELECT doc_id, k, concat('org/r', CAST(doc_id % 20 AS VARCHAR(20))) AS repo,
  concat(CASE k % 9 WHEN 0 THEN 'tests' ELSE 'src' END, '/m', CAST(k % 10 AS VARCHAR(20)), '/f_', CAST(doc_id AS VARCHAR(20)),
    CASE k % 8 {' '.join(f"WHEN {i} THEN '{ext}'" for i, (ext, _) in enumerate(_LANGS))} END) AS file_path,
  CASE k % 8 {' '.join(f'WHEN {i} THEN {_filled(code)}' for i, (_, code) in enumerate(_LANGS))} END AS content
FROM (SELECT doc_id, text, CAST(floor(doc_id / 20) AS BIGINT) AS k FROM documents) d"""

# Change requests of five files of one repository; every source file is changed once.
CODE_PRS = """
SELECT repo, CAST(floor(doc_id / 100) AS BIGINT) * 20 + doc_id % 20 AS pr_id, k % 5 AS file_ord, file_path,
  'modified' AS status, concat('+', replace(content, chr(10), concat(chr(10), '+'))) AS patch,
  CAST(doc_id % 13 AS BIGINT) AS additions, CAST(doc_id % 3 AS BIGINT) AS deletions
FROM code_files"""

# Ids to look vectors up by: all that exist, and a fifth more, which stand for failed embeddings.
VECTOR_IDS = "CAST(floor((max(vec_id) + 1) * 1.2) AS BIGINT)"

# Vectors of chunks: chunk number `seq` of a document has a given vector or, where the id is not there, failed.
CODE_VECTORS = """
SELECT c.repo, c.file_path, c.doc_id, CAST(e.embedding AS @DOUBLES) AS embedding
FROM (SELECT repo, file_path, doc_id, (doc_id * 31) % (SELECT @VECTORS FROM embeddings) AS wanted FROM code_files) c
LEFT JOIN embeddings e ON e.vec_id = c.wanted"""

# One index row per source file that has a vector.
CODE_CHUNKS = """
SELECT repo, file_path, CAST(0 AS BIGINT) AS chunk_index, 'full_file' AS chunk_type, file_path AS name,
  substring(v.content, 1, 500) AS content, embedding
FROM (SELECT c.repo, c.file_path, c.content, x.embedding FROM code_files c
      JOIN code_vectors x ON c.repo = x.repo AND c.file_path = x.file_path) v
WHERE embedding IS NOT NULL"""

# A change is searched with the vector of its first file.
CODE_QUERIES = """
SELECT p.repo, p.pr_id, x.embedding
FROM code_prs p JOIN code_vectors x ON p.repo = x.repo AND p.file_path = x.file_path
WHERE p.file_ord = 0 AND x.embedding IS NOT NULL"""

# Vectors as an index of ten repositories.
VECTOR_CHUNKS = """
SELECT concat('org/r', CAST(label AS VARCHAR(20))) AS repo, vec_id, CAST(vec_id AS VARCHAR(20)) AS id,
  CASE vec_id % 3 WHEN 0 THEN 'file_summary' ELSE 'code_chunk' END AS chunk_type, CAST(embedding AS @DOUBLES) AS embedding
FROM embeddings"""

# Webhooks with every routing case, some without a number or a sha.
WEBHOOKS = """
SELECT event_id, received_at, event, action, repo, sha, installation_id,
  concat('{"action":"', action, '","installation":{"id":', CAST(installation_id AS VARCHAR(20)), '},"repository":{"full_name":"', repo,
    '"},"repositories":[{"full_name":"org/a', CAST(event_id AS VARCHAR(20)), '"},{"id":1}],"repositories_added":[{"full_name":"org/b',
    CAST(event_id AS VARCHAR(20)), '"},{"full_name":""}],"pull_request":{',
    CASE event_id % 17 WHEN 3 THEN '' ELSE concat('"number":', CAST(event_id AS VARCHAR(20)), ',') END,
    '"title":"t","head":{', CASE event_id % 19 WHEN 5 THEN '' ELSE concat('"sha":"', sha, '"') END, '}},"extra":', props, '}') AS body
FROM (
  SELECT event_id, ts AS received_at, user_id AS installation_id, props,
    concat('org/r', CAST(user_id % 20 AS VARCHAR(20))) AS repo, concat('c', CAST(user_id AS VARCHAR(20))) AS sha,
    CASE event_type WHEN 'view' THEN 'pull_request' WHEN 'click' THEN 'installation' WHEN 'signup' THEN 'installation_repositories' ELSE 'push' END AS event,
    CASE event_id % 5 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'created' WHEN 3 THEN 'added' ELSE 'closed' END AS action
  FROM events
) e"""

VIEWS = {
    "repo_files": (REPO_FILES, ()),
    "hash_ledger": (HASH_LEDGER, ("repo_files",)),
    "pr_files": (PR_FILES, ()),
    "code_files": (CODE_FILES, ()),
    "code_prs": (CODE_PRS, ("code_files",)),
    "code_vectors": (CODE_VECTORS, ("code_files",)),
    "code_chunks": (CODE_CHUNKS, ("code_files", "code_vectors")),
    "code_queries": (CODE_QUERIES, ("code_files", "code_prs", "code_vectors")),
    "vector_chunks": (VECTOR_CHUNKS, ()),
    "webhooks": (WEBHOOKS, ()),
}
_ENGINES = {
    "spark": (("@BYTES(", "octet_length("), ("@HASH(coalesce(content, ''))", "substring(sha2(coalesce(content, ''), 256), 1, 16)"),
              ("@DOUBLES", "ARRAY<DOUBLE>"), ("@VECTORS", VECTOR_IDS)),
    "duckdb": (("@BYTES(", "strlen("), ("@HASH(coalesce(content, ''))", "substring(sha256(coalesce(content, '')), 1, 16)"),
               ("@DOUBLES", "DOUBLE[]"), ("@VECTORS", VECTOR_IDS)),
}


def view_sql(name: str, engine: str) -> str:
    sql = VIEWS[name][0]
    for mark, text in _ENGINES[engine]:
        sql = sql.replace(mark, text)
    return sql


def _needed(names) -> list[str]:
    wanted = set()

    def visit(name):
        for parent in VIEWS[name][1]:
            visit(parent)
        wanted.add(name)

    for name in names:
        visit(name)
    return [name for name in VIEWS if name in wanted]


def with_clause(*names: str) -> str:
    """WITH clause of the views for the checking engine."""
    return "WITH " + ",\n".join(f"{name} AS ({view_sql(name, 'duckdb')})" for name in _needed(names))


class Tables:
    """Views over one data directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {
            name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE_TABLES}

    def __getattr__(self, name: str) -> DataFrame:
        views = self.__dict__["_views"]
        if name not in views:
            if name not in VIEWS:
                raise AttributeError(name)
            # Temporary names only have to live until the SELECT is analysed.
            for parent in (*BASE_TABLES, *VIEWS[name][1]):
                getattr(self, parent).createOrReplaceTempView(parent)
            views[name] = self.spark.sql(view_sql(name, "spark"))
        return views[name]
