"""Registered queries: each runs one operator or plan over whole tables."""

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codetide import hooks, schemas
from codetide.functions import paths, signing, text
from codetide.operators import events, impact, indexing, retrieval, review, risk, similarity
from codetide.plans import index_run, pr_review as review_plan
from codetide.session import materialise, shared_folder
from codetide.sources import answers, index_store, postings, readers
from codetide.streaming import events as event_streams, status as status_streams
from codetide.workload import views
from codetide.workload.views import Tables

PR, FILE = ["repo", "pr_id"], ["repo", "file_path"]
WEBHOOK_SECRET = "webhook-secret"
# Unit vector along the first axis of the 64-wide vectors.
AXIS_VECTOR = [1.0] + [0.0] * 63

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def _query(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[make.__name__] = make
    return make


# ---- corpus and index ------------------------------------------------------


@_query
def corpus_scan(t):
    return t.repo_files.select(*FILE, "size_bytes", F.length("content").cast("bigint").alias("n_chars"))


@_query
def detect_language(t):
    lang = paths.language(F.col("file_path"))
    return t.repo_files.select(*FILE, lang.alias("language"), lang.isNotNull().alias("parseable"))


@_query
def index_eligibility(t):
    return indexing.label_eligibility(t.repo_files).select(*FILE, F.coalesce("outcome", F.lit("pruned")).alias("outcome"))


@_query
def content_hash(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@_query
def needs_update(t):
    return indexing.changed_keys(indexing.hashed_keys(t.repo_files), t.hash_ledger)


@_query
def chunk_lines(t):
    files = t.documents.select(
        F.col("source").alias("repo"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.col("text").alias("content"))
    return indexing.chunk_files(files)


@_query
def chunk_code(t):
    return indexing.chunk_files(t.code_files.select(*FILE, "content"))


def _given_vectors(t):
    """Embedder that looks vectors up by document and chunk number; ids without a vector fail."""
    vectors = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    doc_id = F.regexp_extract("file_path", "doc_([0-9]+)", 1).cast("bigint")

    def embed(chunks):
        ids = vectors.agg(F.expr(views.VECTOR_IDS)).first()[0] or 1
        keyed = chunks.withColumn("vec_id", (doc_id * 31 + F.col("seq") * 17) % ids)
        return keyed.join(vectors, "vec_id", "left").drop("vec_id")

    return embed


def _index_run(t):
    files = t.repo_files.select(*FILE, "size_bytes", "content")
    return index_run.plan_run(files, t.hash_ledger, _given_vectors(t), keep=materialise)


def _old_chunks(t):
    """One chunk per file of the earlier index."""
    return t.hash_ledger.select(
        *FILE, F.lit(0).cast("bigint").alias("chunk_index"), F.lit("full_file").alias("chunk_type"),
        F.col("file_path").alias("name"), F.col("content_hash").alias("content"),
        F.expr("cast(array() as array<double>)").alias("embedding"))


@_query
def valid_chunks(t):
    files = t.repo_files.where(F.col("content").isNotNull()).select(*FILE, "content")
    embedded = materialise(indexing.cut_texts(_given_vectors(t)(indexing.chunk_files(files))), "embedded")
    numbered = indexing.number_valid_chunks(embedded)
    return indexing.to_index_rows(numbered).select(*FILE, "chunk_index", "chunk_type", "name")


@_query
def upsert_chunks(t):
    new_chunks, _, _ = _index_run(t)
    return indexing.replace_chunks(_old_chunks(t), new_chunks).select(*FILE, "chunk_index", "chunk_type", "name")


@_query
def upsert_hashes(t):
    files = t.repo_files.select(*FILE, "size_bytes", "content")
    _, hashes, _ = index_run.plan_run(files, t.hash_ledger, _given_vectors(t), full=False, keep=materialise)
    return indexing.replace_hashes(t.hash_ledger, hashes)


@_query
def delete_files(t):
    removed = t.pr_files.where(F.col("status") == "removed").select("file_path").join(
        t.repo_files.select(*FILE), "file_path")
    chunks, ledger = indexing.delete_files(_old_chunks(t), t.hash_ledger, removed)
    return chunks.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks_left")).join(
        ledger.groupBy("repo").agg(F.count(F.lit(1)).alias("files_left")), "repo", "full")


@_query
def index_stats(t):
    new_chunks, _, _ = _index_run(t)
    return indexing.index_stats(new_chunks, t.hash_ledger)


@_query
def index_run_stats(t):
    return indexing.run_stats(_index_run(t)[2])


@_query
def index_load(t):
    """Index written to the shared folder and read back."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    chunks = t.code_chunks.select(*schemas.CHUNKS.fieldNames())
    ledger = t.code_files.select(*FILE, text.content_hash(F.col("content")).alias("content_hash"))
    index_store.save_index(path, chunks, ledger)
    return index_store.stats(t.spark, path)


def _updated_index(t):
    """Folder of an index of the earlier state, updated with all files on disk."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    index_store.save_index(path, _old_chunks(t), t.hash_ledger)
    index_run.run_index(t.spark, path, t.repo_files.select(*FILE, "size_bytes", "content"), _given_vectors(t))
    return path


@_query
def index_update(t):
    """Chunks with text and vector after an update of the index on disk."""
    chunks, _ = index_store.load_index(t.spark, _updated_index(t))
    return chunks.select(
        *FILE, "chunk_index", "chunk_type", "name", F.md5("content").alias("content_md5"), F.size("embedding").cast("bigint").alias("width"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x), 6).alias("vector_sum"))


@_query
def index_remove(t):
    """Chunks and files left on disk after an update and the removal of files."""
    path = _updated_index(t)
    removed = t.pr_files.where(F.col("status") == "removed").select("file_path").join(t.repo_files.select(*FILE), "file_path")
    index_store.remove_files(t.spark, path, removed)
    return index_store.stats(t.spark, path)


@_query
def embed_chunks(t):
    chunks = indexing.chunk_files(t.code_files.select(*FILE, "content"))
    embedded = hooks.hashing_embedder(dimensions=64)(chunks)
    return embedded.select(*FILE, "seq", F.size("embedding").alias("dimensions"), F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x).alias("token_count"))


# ---- events ----------------------------------------------------------------


@_query
def event_scan(t):
    parsed = events.parse_payload(t.webhooks.select("event_id", "received_at", "event", "body"))
    return parsed.select(
        "event_id", "received_at", "event", "action", F.col("payload.installation.id").alias("installation_id"),
        F.col("payload.repository.full_name").alias("repo"), F.col("payload.pull_request.head.sha").alias("sha"))


@_query
def event_scan_files(t):
    """The same over JSON lines on disk, written and read back."""
    folder, stamps = f"{shared_folder(t.spark)}/events-{uuid.uuid4().hex}", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    t.webhooks.select("event_id", "received_at", "event", F.lit("sha256=00").alias("signature"), "body").write.options(timestampFormat=stamps, timestampNTZFormat=stamps).json(folder)
    parsed = events.parse_payload(readers.read_events(t.spark, folder, timestampFormat=stamps))
    return parsed.select(
        "event_id", "received_at", "event", "action", F.col("payload.installation.id").alias("installation_id"),
        F.col("payload.repository.full_name").alias("repo"), F.col("payload.pull_request.head.sha").alias("sha"))


@_query
def route_events(t):
    return events.route_events(t.webhooks).select("event_id", "event", "action", "status")


@_query
def route_events_stream(t):
    """The router as a stream over the event files, run to completion into a table."""
    folder = f"{shared_folder(t.spark)}/router-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    event = F.create_map(*[F.lit(x) for x in (
        "view", "pull_request", "click", "installation", "signup", "installation_repositories")])[F.col("event_type")]
    action = F.element_at(F.array(*[F.lit(a) for a in ("opened", "synchronize", "created", "added", "closed")]),
                          (F.col("event_id") % 5 + 1).cast("int"))
    body = F.to_json(F.struct(action.alias("action")))
    hooks_in = stream.select(
        "event_id", F.col("ts").alias("received_at"), F.coalesce(event, F.lit("push")).alias("event"), body.alias("body"))
    query = event_streams.routed(hooks_in).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "event", "action", "status")


@_query
def index_worklist(t):
    return events.index_worklist(events.parse_payload(t.webhooks.select("event_id", "event", "body")))


@_query
def review_requests(t):
    return events.review_requests(events.parse_payload(t.webhooks.select("event_id", "event", "body")))


@_query
def verify_signature(t):
    signed = t.webhooks.select(
        "event_id", "body",
        F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, "sha256=00")
        .otherwise(signing.expected_signature(WEBHOOK_SECRET, F.col("body"))).alias("signature"))
    return events.check_signatures(signed, WEBHOOK_SECRET).select("event_id", "signature", "verdict")


@_query
def latest_status(t):
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending", "success", "failure")]), (F.col("event_id") % 3 + 1).cast("int"))
    statuses = t.webhooks.select(
        "repo", "sha", F.col("event_id").alias("seq"), state.alias("state"), F.concat(state, F.lit(" by "), F.col("event")).alias("description"))
    return events.latest_status(statuses)


@_query
def latest_status_stream(t):
    """The same by a stream that keeps one row of state per commit."""
    folder = f"{shared_folder(t.spark)}/statuses-{uuid.uuid4().hex}"
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    event = F.create_map(*[F.lit(x) for x in (
        "view", "pull_request", "click", "installation", "signup", "installation_repositories")])[F.col("event_type")]
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending", "success", "failure")]), (F.col("event_id") % 3 + 1).cast("int"))
    statuses = stream.select(
        F.concat(F.lit("org/r"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("sha"),
        F.col("event_id").alias("seq"), state.alias("state"), F.concat(state, F.lit(" by "), F.coalesce(event, F.lit("push"))).alias("description"))
    status_streams.start_statuses(statuses, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return status_streams.current(t.spark.read.schema(status_streams.LATEST).parquet(f"{folder}/out"))


# ---- changes: scan, risk, gate ----------------------------------------------


@_query
def pr_files_scan(t):
    documents = t.pr_files.select(
        F.when(F.col("pr_id") % 7 != 3, F.col("pr_id")).alias("installation_id"), "repo", "pr_id",
        F.concat(F.lit("c"), F.col("pr_id").cast("string")).alias("head_sha"),
        F.array(F.struct(F.col("file_path").alias("filename"), "status", "patch", "additions", "deletions")).alias("files"))
    files, rejected = readers.explode_pr_documents(documents)
    return files.select(*PR, "file_path", "status", "patch", "additions", "deletions", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select(*PR, "error"), allowMissingColumns=True)


def _documents(t):
    """Change requests as hosts deliver them; the host's totals differ from the sums over the files."""
    files = F.sort_array(F.collect_list(F.struct("file_ord", F.col("file_path").alias("filename"), "status", "patch", "additions", "deletions")))
    return t.pr_files.groupBy(*PR).agg(
        (F.count(F.lit(1)) + F.col("pr_id") % 3).alias("changed_files"), (F.sum("additions") * 2).alias("additions"),
        (F.sum("deletions") + F.col("pr_id") % 5).alias("deletions"), files.alias("files")).select(
        F.when(F.col("pr_id") % 7 != 3, F.col("pr_id")).alias("installation_id"), *PR, F.concat(F.lit("c"), F.col("pr_id").cast("string")).alias("head_sha"),
        "changed_files", "additions", "deletions", F.transform("files", lambda f: f.dropFields("file_ord")).alias("files"))


@_query
def pr_documents_scan(t):
    """Documents of several files, written as JSON lines and read back."""
    folder = f"{shared_folder(t.spark)}/documents-{uuid.uuid4().hex}"
    _documents(t).write.json(folder)
    files, rejected = readers.read_pr_documents(t.spark, folder)
    return files.select(
        *PR, "file_path", "status", F.md5("patch").alias("patch_md5"), "additions", "deletions", "host_files", "host_additions", "host_deletions",
        F.lit(None).cast("string").alias("error")).unionByName(rejected.select(*PR, "error"), allowMissingColumns=True)


@_query
def pr_risk_host_totals(t):
    files, _ = readers.explode_pr_documents(_documents(t))
    return risk.pr_risk(files).select(
        *PR, "changed_files_count", "total_additions", "total_deletions", "issue_count", "score", "level", F.array_join("reasons", "; ").alias("reasons"))


@_query
def rule_table_findings(t):
    """Findings of a rule table, with the number of patterns that match."""
    found = risk.rule_findings(t.pr_files, risk.rule_table(t.spark, "extended"))
    return found.select(*PR, "file_ord", "file_path", "category", "points", F.size("positions").cast("bigint").alias("patterns"))


@_query
def pr_totals(t):
    return risk.pr_totals(t.pr_files)


@_query
def test_impact(t):
    return risk.test_impact(t.pr_files)


@_query
def added_lines(t):
    return t.pr_files.select(*PR, "file_ord", text.added_code(F.col("patch")).alias("added_code"))


@_query
def sensitive_files(t):
    return t.pr_files.where(paths.is_sensitive(F.col("file_path"))).select(*PR, "file_ord", "file_path")


@_query
def security_findings(t):
    return risk.pattern_findings(t.pr_files).select(*PR, "file_ord", "file_path", F.col("kind").alias("category"), "points", "text")


@_query
def security_findings_extended(t):
    return risk.pattern_findings(t.pr_files, "extended").select(*PR, "file_ord", F.col("kind").alias("category"), "points")


@_query
def findings_summary(t):
    return risk.pattern_findings(t.pr_files).groupBy(F.col("kind").alias("category")).agg(
        F.count(F.lit(1)).alias("findings"), F.sum("points").alias("points"))


@_query
def vulnerable_packages(t):
    return risk.security_issues(t.pr_files).where(F.col("kind") == "vulnerable_package").select(*PR, "file_ord", "text")


@_query
def security_issues(t):
    lists = risk.issue_lists(t.pr_files)
    return lists.select(*PR, "part", F.array_join("security_issues", "\n").alias("issues"))


@_query
def pr_risk(t):
    return risk.pr_risk(t.pr_files).select(
        *PR, "changed_files_count", "total_additions", "total_deletions", "tests_modified", "missing_tests", "issue_count",
        "score", "level", F.array_join("reasons", "; ").alias("reasons"))


@_query
def risk_factors(t):
    scanned = materialise(risk.scan_files(t.pr_files), "scanned")
    return risk.risk_factors(risk.pr_risk(scanned), risk.security_issues(scanned))


@_query
def gate_status(t):
    return risk.gate(risk.pr_risk(t.pr_files)).select(*PR, "score", "state", "description")


@_query
def risk_badge(t):
    scored = risk.pr_risk(t.pr_files)
    return scored.select(*PR, review.badge(F.col("score"), F.col("level"), F.col("issue_count")).alias("badge"))


@_query
def status_rows(t):
    requests = t.pr_files.where(F.col("file_ord") == 0).select(
        *PR, F.when(F.col("pr_id") % 7 != 3, F.concat(F.lit("c"), F.col("pr_id").cast("string"))).alias("sha"),
        F.when(F.col("pr_id") % 11 == 5, "Missing context data").alias("error"))
    gated = risk.gate(risk.pr_risk(t.pr_files))
    return events.pending_statuses(requests).unionByName(events.final_statuses(requests, gated))


@_query
def fix_candidates(t):
    return review.fix_candidates(t.pr_files, risk.security_issues(t.pr_files)).select(*PR, "file_ord", "snippet")


# ---- similarity ------------------------------------------------------------


def _rounded(hits):
    return hits.withColumn("similarity", F.round("similarity", 6))


@_query
def similar_chunks(t):
    queries = t.vector_chunks.select("repo", F.col("id").alias("query_id"), "embedding")
    hits = similarity.top_k(t.vector_chunks, queries, 5, chunk_ord="vec_id")
    return _rounded(hits).select("repo", "query_id", "id", F.col("rank").cast("bigint").alias("rank"), "similarity")


@_query
def similar_filtered(t):
    queries = t.vector_chunks.select("repo", F.col("id").alias("query_id"), "embedding")
    hits = similarity.top_k(t.vector_chunks, queries, 5, chunk_ord="vec_id", where=F.col("chunk_type") == "code_chunk")
    return _rounded(hits).select("repo", "query_id", "id", F.col("rank").cast("bigint").alias("rank"), "similarity")


@_query
def similar_one_query(t):
    hits = similarity.with_distance(similarity.nearest(t.vector_chunks, AXIS_VECTOR, 5, tie_breakers=["vec_id"]))
    return _rounded(hits).select("vec_id", "repo", "similarity", F.round("distance", 6).alias("distance"))


# ---- symbols, impact, retrieval ----------------------------------------------


def _symbols(t):
    return impact.symbol_table(t.code_files)


def _changed_symbols(t):
    return impact.symbol_table(impact.changed_sources(t.code_prs, t.code_files))


@_query
def symbol_extract(t):
    return impact.symbol_rows(_symbols(t)).withColumn("pos", F.col("pos").cast("bigint"))


@_query
def symbol_counts(t):
    return impact.symbol_rows(_symbols(t)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


@_query
def structure_summary(t):
    return impact.file_structures(_symbols(t))


@_query
def pr_symbols(t):
    return impact.pr_symbols(t.code_prs, _changed_symbols(t))


@_query
def impact_analysis(t):
    found = impact.impact_analysis(t.code_prs, t.code_files, impact.pr_symbols(t.code_prs, _changed_symbols(t)), materialise)
    return found.withColumn("impact_ord", F.col("impact_ord").cast("bigint"))


@_query
def impact_from_postings(t):
    """Impact from postings on disk: written for an earlier state of the files, then brought up to date."""
    path, spark = f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}", t.spark
    mark = F.crc32(F.col("file_path").cast("binary"))
    files = t.code_files.select(*FILE, "content")
    edited = files.withColumn("content", F.when(mark % 3 == 0, F.concat("content", F.lit("\n"), "content")).otherwise(F.col("content")))
    gone = files.where(mark % 5 == 0).withColumn("file_path", F.concat(F.lit("old/"), "file_path"))
    postings.update_postings(spark, path, edited.where(mark % 7 != 0).unionByName(gone))
    postings.update_postings(spark, path, files)
    postings.remove_postings(spark, path, gone)
    found = impact.impact_analysis(
        t.code_prs, None, impact.pr_symbols(t.code_prs, _changed_symbols(t)), materialise, lambda asked: postings.load_postings(spark, path, asked))
    return found.withColumn("impact_ord", F.col("impact_ord").cast("bigint"))


@_query
def context_retrieval(t):
    hits = retrieval.retrieve_context(t.code_chunks, t.code_queries, t.code_prs)
    return hits.select(*PR, F.col("rank").cast("bigint").alias("rank"), "file", "content", F.round("relevance", 6).alias("relevance"))


@_query
def retrieval_status(t):
    return retrieval.retrieval_status(t.code_prs, t.code_chunks, t.code_queries)


@_query
def retrieval_query_text(t):
    wide = materialise(_changed_symbols(t), "symbols")
    summaries = review.file_summaries(t.code_prs, impact.file_structures(wide))
    return review_plan.query_texts(t.code_prs, impact.pr_symbols(t.code_prs, wide), summaries)


@_query
def context_from_text(t):
    """The whole chain: text of each change, its vector, search in an index by the same embedder, own files out, first three."""
    embed = hooks.digest_embedder(64)
    vectors = review_plan.embed_queries(retrieval_query_text(t), embed)
    embedded = materialise(indexing.cut_texts(embed(indexing.chunk_files(t.code_files.select(*FILE, "content")))), "embedded")
    chunks = materialise(indexing.to_index_rows(indexing.number_valid_chunks(embedded)), "chunks")
    hits = retrieval.retrieve_context(chunks, materialise(vectors, "vectors"), t.code_prs)
    return hits.select(
        *PR, F.col("rank").cast("bigint").alias("rank"), "file", "chunk_type", "name", F.md5("content").alias("content_md5"), F.round("relevance", 6).alias("relevance"),
        F.round("distance", 6).alias("distance"))


# ---- review ----------------------------------------------------------------


@_query
def change_size_class(t):
    return review.with_size_class(t.pr_files).select(*PR, "file_ord", "size_class", "truncated")


def _structures(t):
    return impact.file_structures(_changed_symbols(t))


@_query
def file_summaries(t):
    return review.file_summaries(t.code_prs, _structures(t)).select(*PR, "file_ord", "summary")


@_query
def summary_requests(t):
    return review.summary_requests(t.code_prs, _structures(t)).select(*PR, "file_ord", "request")


def _digest_answers(requests):
    """Stands for a model: an answer that any engine can give."""
    return ["Answer " + hashlib.md5(request.encode()).hexdigest() for request in requests]


@_query
def review_with_texts(t):
    """Summaries with a model's texts for large changes, asked once and remembered."""
    structures = materialise(_structures(t), "structures")
    requests = review.summary_requests(t.code_prs, structures).select(*PR, "file_ord", "request")
    memory = f"{shared_folder(t.spark)}/answers-{uuid.uuid4().hex}"
    ask = answers.remembered(hooks.batch_writer(_digest_answers), memory, request_col="request", answer_col="text", keep_request=False)
    return review.file_summaries(t.code_prs, structures, ask(requests)).select(*PR, "file_ord", "summary")


@_query
def fix_requests(t):
    scanned = materialise(risk.scan_files(t.pr_files), "scanned")
    return review.fix_requests(
        review.fix_candidates(t.pr_files, risk.security_issues(scanned)), risk.issue_lists(scanned))


@_query
def pr_report(t):
    tables = review_plan.assemble(t.code_prs, t.code_files, t.code_chunks, t.code_queries, keep=materialise)
    return tables["report"]


@_query
def pr_report_patches(t):
    """Report over the change requests with findings, without sources or index."""
    scanned = materialise(risk.scan_files(t.pr_files), "scanned")
    return review.report(risk.pr_risk(scanned), review.file_summaries(t.pr_files), risk.issue_lists(scanned))


@_query
def pr_bodies(t):
    """One review body per change, whatever its size."""
    return review.bodies(pr_report_patches(t)).select(*PR, "body")


@_query
def pr_review(t):
    tables = review_plan.assemble(t.code_prs, t.code_files, t.code_chunks, t.code_queries, keep=materialise)
    return review_plan.overview(tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(make):
        return lambda spark, sf_dir: make(Tables(spark, sf_dir))

    return {name: bind(make) for name, make in _QUERIES.items()}
