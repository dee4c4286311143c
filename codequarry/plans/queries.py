"""The core's queries by name, each over whole tables, and the same in SQL.

`code_chunks` holds repeated deliveries of an id; queries on the index use the last of each (`current_chunks`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import globs, languages, text
from codequarry.operators import aggregates, chunking, embedding, rag, render, search, store
from codequarry.schema import RESULT_COLUMNS
from codequarry.session import spread, table
from codequarry.sources.repos import with_overrides

K = 20
INCLUDE, EXCLUDE = ["**/src/**/*", "lib/**/*", "**/app/*.{ts,py}"], ["**/vendor/**", "**/*.min.js"]
IGNORE = ["node_modules/", "dist/", "# built files", "*.log", "/build", "tools/build", "!keep.ts"]
QUESTION = "Which function releases the buffer of the oldest session?"


def current_chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The last delivery of each chunk, with the columns that a query needs; texts decide ties only where they are read anyway."""
    order = ["indexed_at", *(["text"] if "text" in columns else [])]
    return store.latest(table(spark, sf_dir, "code_chunks"), "id", order, list(columns))


def current_files(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "source_files"), "file_id", ["scanned_at"], list(columns))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the smallest id as the query."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def knn_topk(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), K).select("id", "label", "score")


def knn_filtered(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), F.lower("lang").alias("language"))
    joined = _vectors(spark, sf_dir).join(docs, "id")
    return search.top_k(search.filtered(joined, {"language": "en"}), _query_vector(spark, sf_dir), K).select("id", "repo", "language", "score")


def knn_min_score(spark, sf_dir):
    return search.min_score(search.top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10), 0.6).select("id", "score")


def knn_batch(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return search.batch_top_k(rows, rows.where("id % 20 = 0"), 10)


def knn_index(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return search.batch_top_k(rows, rows.where("id % 20 = 0"), 10, index=search.CodeIndex(rows))


def knn_index_recall(spark, sf_dir):
    """The index's recall, and the share of all rows whose vectors each query compares."""
    found = search.recall(knn_batch(spark, sf_dir), knn_index(spark, sf_dir))
    share = _vectors(spark, sf_dir).agg(F.least(F.lit(1.0), F.lit(10.0 * 10) / F.count("embedding")).alias("compared"))
    return found.withColumn("compared", F.lit(share.first()["compared"]))


def repo_list(spark, sf_dir):
    return aggregates.list_repositories(current_chunks(spark, sf_dir, "repo"))


def repo_stats(spark, sf_dir):
    return aggregates.repo_stats(current_chunks(spark, sf_dir, "repo", "language", "symbol_type"))


def repo_count(spark, sf_dir):
    chunks = current_chunks(spark, sf_dir, "repo")
    return chunks.groupBy("repo").agg(F.count("*").alias("chunks")).agg(F.sum("chunks").alias("chunks"), F.count("repo").alias("repositories"))


def _one_file(spark, sf_dir) -> DataFrame:
    """The chunks of the file with the most of them. All deliveries of an id are of one file, so the others are left out first."""
    chunks = current_chunks(spark, sf_dir, "repo", "path")
    most = chunks.groupBy("repo", "path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "path").first()
    place = (most["repo"], most["path"]) if most else ("", "")
    rows = table(spark, sf_dir, "code_chunks").where((F.col("repo") == place[0]) & (F.col("path") == place[1]))
    return aggregates.file_chunks(store.latest(rows, "id", ["indexed_at", "text"]), *place)


def file_chunks(spark, sf_dir):
    return _one_file(spark, sf_dir).select("id", "repo", "path", "symbol_type", "symbol_name", "start_line", "end_line", "score")


def chunk_whole_file(spark, sf_dir):
    made = chunking.whole_file_chunks(current_files(spark, sf_dir, "repo", "relative_path", "language", "content"))
    return made.select("repo", "path", "symbol_type", "symbol_name", "start_line", "end_line", F.md5("text").alias("digest"))


def chunk_symbols(spark, sf_dir):
    made = chunking.chunk_files(current_files(spark, sf_dir, "repo", "relative_path", "extension", "content").withColumn("language", languages.language_of(F.col("extension"))))
    return made.select("repo", "path", "symbol_type", "symbol_name", "signature", "start_line", "end_line", F.md5("text").alias("digest"), "error")


def chunk_split(spark, sf_dir):
    return chunking.split_lines(current_files(spark, sf_dir, "content").where(text.has_content(F.col("content"))), 200, 40)


def token_estimate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(text.has_content(F.col("text")))
    n = text.token_estimate(F.col("text"))
    return docs.select("doc_id", n.cast("long").alias("tokens"), (n <= 1000).alias("fits"))


def chunk_digest(spark, sf_dir):
    c = F.col
    key = text.chunk_digest(c("repo"), c("path"), c("symbol_name"), c("start_line"), c("commit_sha"))
    return current_chunks(spark, sf_dir, "repo", "path", "symbol_name", "start_line", "commit_sha").select("id", key.alias("digest"))


def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.truncated(F.col("text"), 128)).alias("digest"))


def line_slice(spark, sf_dir):
    files, c = current_files(spark, sf_dir, "content"), F.col("content")
    return files.select("file_id", text.line_count(c).alias("lines"), F.md5(text.line_slice(c, F.lit(2), F.lit(6))).alias("digest"), text.line_of_offset(c, F.lit(100)).alias("line_at_100"))


def glob_include_exclude(spark, sf_dir):
    files = current_files(spark, sf_dir, "relative_path")
    return files.where(globs.matches_paths(F.col("relative_path"), INCLUDE, EXCLUDE)).select("file_id", "relative_path")


def gitignore_filter(spark, sf_dir):
    return current_files(spark, sf_dir, "relative_path").select("file_id", globs.is_ignored(F.col("relative_path"), IGNORE).alias("ignored"))


def repo_glob(spark, sf_dir):
    repos = table(spark, sf_dir, "repositories")
    return repos.where(globs.matches_names(F.col("repo"), ["*-*", "a?????"], ["c*", "*-core"])).select("repo")


def lang_detect(spark, sf_dir):
    files = current_files(spark, sf_dir, "relative_path").select("file_id", text.extension(F.col("relative_path")).alias("suffix"), text.base_name(F.col("relative_path")).alias("name"))
    language = languages.language_of(F.col("suffix"))
    return files.select("file_id", "suffix", "name", language.alias("language"), languages.has_parser(language).alias("parsed"))


def upsert_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "code_chunks").withColumn("digest", F.md5("text"))
    return store.latest(rows, "id", ["indexed_at", "digest"], ["repo", "indexed_at", "digest"]).select("id", "repo", F.unix_micros("indexed_at").alias("indexed_us"), "digest")


def _largest_repo(spark, sf_dir) -> str:
    most = aggregates.list_repositories(current_chunks(spark, sf_dir, "repo"), 1).first()
    return most["repo"] if most else ""


def delete_repo(spark, sf_dir):
    chunks = current_chunks(spark, sf_dir, "repo")
    return store.reindexed(chunks, chunks.where("false"), _largest_repo(spark, sf_dir))


def reindex_repo(spark, sf_dir):
    chunks, name = current_chunks(spark, sf_dir, "repo", "text"), _largest_repo(spark, sf_dir)
    new = chunks.where(F.col("repo") == name).withColumn("text", F.upper("text"))
    return store.reindexed(chunks, new, name).select("id", "repo", F.md5("text").alias("digest"))


def upsert_chunks(spark, sf_dir):
    chunks = current_chunks(spark, sf_dir, "repo", "text")
    new = chunks.where("length(text) > 1500").withColumn("text", F.concat(F.lit("new "), "text"))
    return store.upserted(chunks, new).select("id", F.md5("text").alias("digest"))


def incremental_files(spark, sf_dir):
    files = current_files(spark, sf_dir, "repo", "relative_path", "content", "committed_at", "scanned_at")
    known = files.where("scanned_at < committed_at + interval 14 days").select("repo", "relative_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    return store.new_or_changed(files, known).select("file_id", "digest")


def _scored(spark, sf_dir) -> DataFrame:
    """A ranked result to project, prompt and render: the chunks nearest to the question by hashed words."""
    provider = embedding.HashingProvider(64)
    chunks = current_chunks(spark, sf_dir, *(c for c in RESULT_COLUMNS if c not in ("id", "score")))
    return search.search(embedding.with_embeddings(chunks, provider), provider.embed(QUESTION), 10)


def search_code(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "score", "repo", "path", "start_line", "end_line")


def sources_projection(spark, sf_dir):
    chunks = current_chunks(spark, sf_dir, "repo", "path", "start_line", "end_line", "symbol_name").withColumn("score", F.round(F.col("end_line") / (F.col("end_line") + F.col("start_line")), 6))
    listed = rag.sources(chunks)
    return listed.withColumn("percent", text.percent(F.col("score"))).withColumn("shown", text.score_text(F.col("score"))).withColumn("band", text.score_band(F.col("score")))


def _documents_as_results(spark, sf_dir) -> DataFrame:
    """The nearest vectors with their documents, as result rows."""
    near = knn_topk(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), F.lower("lang").alias("language"), "doc_kind", "text")
    c = F.col
    return near.join(docs, "id").select(
        c("id").cast("string").alias("id"), "score", F.coalesce("repo", F.lit("none")).alias("repo"), c("id").cast("string").alias("path"), "language", F.lit(None).cast("string").alias("microservice"),
        F.lit("file").alias("symbol_type"), c("doc_kind").alias("symbol_name"), F.lit(None).cast("string").alias("signature"), F.lit(1).alias("start_line"), text.line_count(c("text")).alias("end_line"), "text",
    )


def rag_prompt(spark, sf_dir):
    return rag.prompt(search.min_score(_documents_as_results(spark, sf_dir), 0.5), QUESTION).select(F.md5("prompt").alias("digest"), F.length("prompt").cast("long").alias("n_chars"))


def render_search(spark, sf_dir):
    return render.search_text(_documents_as_results(spark, sf_dir)).select(F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def render_repositories(spark, sf_dir):
    return render.repositories_text(repo_list(spark, sf_dir))


def render_stats(spark, sf_dir):
    return render.stats_text(repo_stats(spark, sf_dir))


def render_file_chunks(spark, sf_dir):
    return render.file_chunks_text(_one_file(spark, sf_dir)).select(F.md5("text").alias("digest"))


def hash_embed(spark, sf_dir):
    return embedding.hashed_weights(spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")), "doc_id", "text")


def overrides_join(spark, sf_dir):
    repos = table(spark, sf_dir, "repositories")
    overrides = repos.where("microservice is not null").select("repo", "microservice", "tags")
    files = current_files(spark, sf_dir, "repo").select("file_id", "repo", F.lit(None).cast("string").alias("microservice"), F.lit(None).cast("array<string>").alias("tags"))
    joined = with_overrides(files.withColumnRenamed("repo", "name"), overrides.withColumnRenamed("repo", "name"))
    return joined.select("file_id", F.col("name").alias("repo"), "microservice", F.array_join("tags", ",").alias("tags"))


def ingest_totals(spark, sf_dir):
    files, chunks = current_files(spark, sf_dir, "repo", "content"), current_chunks(spark, sf_dir, "repo")
    by_file = files.groupBy("repo").agg(F.count("*").alias("files"), F.sum(F.when(~text.has_content(F.col("content")), 1).otherwise(0)).alias("failed"))
    by_chunk = chunks.groupBy("repo").agg(F.count("*").alias("chunks"))
    rows = by_file.join(by_chunk, "repo", "left").select("files", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chunks", F.lit(0)).alias("indexed"), "failed", F.array().cast("array<string>").alias("errors"))
    return aggregates.ingest_totals(rows).select("files", "chunks", "indexed", "failed")


def distinct_calls(spark, sf_dir):
    calls = table(spark, sf_dir, "parsed_symbols").dropDuplicates(["symbol_id"]).select("symbol_id", F.array_distinct("calls").alias("calls"))
    return calls.where("calls is not null").select("symbol_id", F.array_join("calls", ",").alias("calls"), F.size("calls").cast("long").alias("n"))


def late_scans(spark, sf_dir):
    """Files by repository and week of scan: the batch form of the streaming count."""
    files = current_files(spark, sf_dir, "repo", "scanned_at", "n_bytes")
    week = F.date_format(F.date_trunc("week", "scanned_at"), "yyyy-MM-dd")
    return files.groupBy(week.alias("week"), "repo").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))


_QUERIES = (
    knn_topk, knn_filtered, knn_min_score, knn_batch, knn_index, knn_index_recall, repo_list, repo_stats, repo_count, file_chunks, chunk_whole_file, chunk_symbols, chunk_split, token_estimate,
    chunk_digest, truncate, line_slice, glob_include_exclude, gitignore_filter, repo_glob, lang_detect, upsert_dedupe, upsert_chunks, delete_repo, reindex_repo, incremental_files, search_code,
    sources_projection, rag_prompt, render_search, render_repositories, render_stats, render_file_chunks, hash_embed, overrides_join, ingest_totals, distinct_calls, late_scans,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


# --- the same in SQL ------------------------------------------------------------------------------------------------------
_CHUNKS = "chunks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, text DESC) AS rn FROM code_chunks) WHERE rn = 1)"
_FILES = "files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY scanned_at DESC) AS rn FROM source_files) WHERE rn = 1)"
_BLANK = r"regexp_matches(content, '\S')"
_NEAR = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id AS id, label, round((1 + list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q))) / 2, 6) AS score FROM embeddings)"""
_RESULTS = f"""{_NEAR}, best AS (SELECT * FROM near ORDER BY score DESC, id LIMIT {K}),
results AS (SELECT d.doc_id::VARCHAR AS id, score, coalesce(source, 'none') AS repo, d.doc_id::VARCHAR AS path, lower(lang) AS language, doc_kind AS symbol_name,
  1 AS start_line, len(string_split(text, chr(10))) AS end_line, text, row_number() OVER (ORDER BY score DESC, d.doc_id::VARCHAR) AS rank FROM best JOIN documents d ON d.doc_id = best.id)"""
_LARGEST = "big AS (SELECT repo FROM chunks WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1)"
_STATS = """counted AS (SELECT repo, language, symbol_type, count(*) AS chunks, grouping(language, symbol_type) AS g FROM chunks GROUP BY GROUPING SETS ((repo), (repo, language), (repo, symbol_type))),
named AS (SELECT repo, CASE g WHEN 3 THEN 'total' WHEN 1 THEN 'language' ELSE 'symbol_type' END AS facet, CASE g WHEN 3 THEN 'all' WHEN 1 THEN language ELSE symbol_type END AS value, chunks FROM counted),
stats AS (SELECT repo, facet, value, chunks FROM (SELECT *, row_number() OVER (PARTITION BY repo, facet ORDER BY chunks DESC, value) AS rk FROM named WHERE value IS NOT NULL)
  WHERE rk <= CASE WHEN facet = 'language' THEN 50 ELSE 20 END)"""
_ONE_FILE = """best AS (SELECT repo, path FROM chunks GROUP BY repo, path ORDER BY count(*) DESC, repo, path LIMIT 1),
one AS (SELECT chunks.* FROM chunks JOIN best USING (repo, path) ORDER BY start_line, id LIMIT 1000)"""


def _any_of(patterns: list[str]) -> str:
    return " OR ".join(f"regexp_full_match(relative_path, '{p[1:-1]}')" for p in patterns)


def _split_sql(limit: int, keep: int) -> str:
    return f"""WITH RECURSIVE {_FILES},
l AS (SELECT file_id, string_split(content, chr(10)) AS t FROM files WHERE {_BLANK}),
n AS (SELECT file_id, unnest(t) AS line, generate_subscripts(t, 1) AS i, len(t) AS total FROM l),
p AS (SELECT file_id, i, total, length(line) + 1 AS c, coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
walk AS (
  SELECT file_id, 1::BIGINT AS i, 1::BIGINT AS s, c::HUGEINT AS held, false AS out, 0::BIGINT AS a FROM p WHERE i = 1
  UNION ALL
  SELECT p.file_id, p.i,
    CASE WHEN p.i > w.s AND w.held + p.c > {limit} THEN greatest(w.s, p.i - {keep}) ELSE w.s END,
    CASE WHEN p.i > w.s AND w.held + p.c > {limit} THEN p.before - b.before - CASE WHEN greatest(w.s, p.i - {keep}) < p.i THEN 1 ELSE 0 END + p.c ELSE w.held + p.c END,
    p.i > w.s AND w.held + p.c > {limit}, w.s
  FROM walk w JOIN p ON p.file_id = w.file_id AND p.i = w.i + 1 JOIN p b ON b.file_id = p.file_id AND b.i = greatest(w.s, p.i - {keep})),
spans AS (SELECT file_id, a AS x, i - 1 AS y FROM walk WHERE out UNION ALL SELECT w.file_id, w.s, p.total FROM walk w JOIN p ON p.file_id = w.file_id AND p.i = w.i WHERE w.i = p.total)
SELECT spans.file_id, row_number() OVER (PARTITION BY spans.file_id ORDER BY y) AS part, x::INT AS start_line, y::INT AS end_line, (e.before + e.c - f.before - 1)::BIGINT AS n_chars
FROM spans JOIN p e ON e.file_id = spans.file_id AND e.i = y JOIN p f ON f.file_id = spans.file_id AND f.i = x"""


def oracle_sql() -> dict[str, str]:
    ignored = _any_of([globs.path_regex(g) for g in globs.ignore_globs(IGNORE)])
    language = "CASE " + " ".join(f"WHEN suffix IN ({', '.join(repr(e) for e in listed)}) THEN '{name}'" for name, listed in languages.EXTENSIONS.items()) + " ELSE 'unknown' END"
    return {
        "knn_topk": f"WITH {_NEAR} SELECT id, label, score FROM near ORDER BY score DESC, id LIMIT {K}",
        "knn_filtered": f"WITH {_NEAR} SELECT id, source AS repo, lower(lang) AS language, score FROM near JOIN documents ON doc_id = id WHERE lower(lang) = 'en' ORDER BY score DESC, id LIMIT {K}",
        "knn_min_score": f"WITH {_NEAR} SELECT id, score FROM (SELECT * FROM near ORDER BY score DESC, id LIMIT 10) WHERE score >= 0.6",
        "knn_batch": """WITH pairs AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query, neighbour, rank::INT AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM pairs) WHERE rank <= 10""",
        "repo_list": f"WITH {_CHUNKS} SELECT repo, count(*) AS chunks FROM chunks WHERE repo IS NOT NULL GROUP BY repo ORDER BY chunks DESC, repo LIMIT 1000",
        "repo_stats": f"WITH {_CHUNKS}, {_STATS} SELECT * FROM stats",
        "repo_count": f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT repo) AS repositories FROM chunks",
        "file_chunks": f"WITH {_CHUNKS}, {_ONE_FILE} SELECT id, repo, path, symbol_type, symbol_name, start_line, end_line, 1.0::DOUBLE AS score FROM one",
        "chunk_whole_file": f"WITH {_FILES} SELECT repo, relative_path AS path, 'file' AS symbol_type, string_split(relative_path, '/')[-1] AS symbol_name, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line, md5(content) AS digest FROM files WHERE {_BLANK}",
        "chunk_split": _split_sql(800, 2),
        "token_estimate": r"SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens, ceil(length(text) / 4.0) <= 1000 AS fits FROM documents WHERE regexp_matches(text, '\S')",
        "chunk_digest": f"WITH {_CHUNKS} SELECT id, md5(concat_ws(':', repo, path, coalesce(symbol_name, ''), start_line::VARCHAR, commit_sha)) AS digest FROM chunks",
        "truncate": "SELECT doc_id, md5(left(text, 512)) AS digest FROM documents",
        "line_slice": f"WITH {_FILES} SELECT file_id, len(string_split(content, chr(10)))::INT AS lines, md5(array_to_string(string_split(content, chr(10))[2:6], chr(10))) AS digest, len(string_split(left(content, 100), chr(10)))::INT AS line_at_100 FROM files",
        "glob_include_exclude": f"WITH {_FILES} SELECT file_id, relative_path FROM files WHERE ({_any_of([globs.path_regex(p) for p in INCLUDE])}) AND NOT ({_any_of([globs.path_regex(p) for p in [*EXCLUDE, '**/.git/**']])}) AND NOT regexp_matches(relative_path, '(^|/)\\.')",
        "gitignore_filter": f"WITH {_FILES} SELECT file_id, ({ignored}) AS ignored FROM files",
        "repo_glob": "SELECT repo FROM repositories WHERE (repo LIKE '%-%' OR repo LIKE 'a_____') AND NOT (repo LIKE 'c%' OR repo LIKE '%-core')",
        "lang_detect": rf"WITH {_FILES}, s AS (SELECT file_id, string_split(relative_path, '/')[-1] AS name, lower(regexp_extract(string_split(relative_path, '/')[-1], '.(\.[^.]*)$', 1)) AS suffix FROM files), d AS (SELECT *, {language} AS language FROM s) SELECT file_id, suffix, name, language, language IN ('java', 'typescript', 'javascript', 'python') AS parsed FROM d",
        "upsert_dedupe": f"WITH {_CHUNKS} SELECT id, repo, epoch_us(indexed_at) AS indexed_us, md5(text) AS digest FROM chunks",
        "upsert_chunks": f"WITH {_CHUNKS} SELECT id, md5(CASE WHEN length(text) > 1500 THEN 'new ' || text ELSE text END) AS digest FROM chunks",
        "delete_repo": f"WITH {_CHUNKS}, {_LARGEST} SELECT id, repo FROM chunks WHERE repo IS DISTINCT FROM (SELECT repo FROM big)",
        "reindex_repo": f"WITH {_CHUNKS}, {_LARGEST} SELECT id, repo, md5(CASE WHEN repo = (SELECT repo FROM big) THEN upper(text) ELSE text END) AS digest FROM chunks",
        "incremental_files": f"WITH {_FILES}, d AS (SELECT *, sha256(coalesce(content, '')) AS digest FROM files) SELECT file_id, digest FROM d WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.scanned_at < k.committed_at + INTERVAL 14 DAY AND k.repo = d.repo AND k.relative_path = d.relative_path AND k.digest = d.digest)",
        "search_code": f"""WITH {_CHUNKS}, t AS (SELECT id, unnest(regexp_split_to_array(lower(left(text, 2048)), '[^a-z0-9]+')) AS w FROM chunks UNION ALL SELECT NULL, unnest(regexp_split_to_array(lower('{QUESTION}'), '[^a-z0-9]+'))),
h AS (SELECT id, ('0x' || left(md5(w), 8))::BIGINT AS h FROM t WHERE w <> ''),
s AS (SELECT id, h % 64 AS bucket, sum(CASE WHEN (h >> 31) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY 1, 2),
n AS (SELECT id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1),
v AS (SELECT s.id, bucket, (x / norm)::FLOAT::DOUBLE AS v FROM s JOIN n USING (id) WHERE id IS NOT NULL AND norm > 0),
q AS (SELECT s.bucket, x / norm AS v FROM s, n WHERE s.id IS NULL AND n.id IS NULL),
r AS (SELECT v.id, (1 + sum(v.v * coalesce(q.v, 0)) / sqrt(sum(v.v * v.v))) / 2 AS score FROM v LEFT JOIN q USING (bucket) GROUP BY v.id HAVING sum(v.v * v.v) > 0)
SELECT id, round(score, 6) AS score, repo, path, start_line, end_line FROM r JOIN chunks USING (id) ORDER BY r.score DESC, id LIMIT 10""",
        "sources_projection": f"WITH {_CHUNKS}, s AS (SELECT repo, path, start_line::VARCHAR || '-' || end_line::VARCHAR AS lines, symbol_name AS symbol, round(end_line / (end_line + start_line), 6) AS score FROM chunks) SELECT *, round(score * 100)::INT AS percent, printf('%.3f', score + 1e-9) AS shown, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM s",
        "rag_prompt": f"""WITH {_RESULTS}, parts AS (SELECT rank, '### [' || rank || '] ' || repo || '/' || path || ':' || start_line || '-' || end_line || chr(10) || concat_ws(' | ', 'Language: ' || language, 'Symbol: ' || symbol_name, 'Relevance: ' || round(score * 100)::INT || '%') || chr(10) || '```' || coalesce(language, '') || chr(10) || text || chr(10) || '```' AS part FROM results WHERE score >= 0.5),
p AS (SELECT CASE WHEN count(*) > 0 THEN '{rag.INTRODUCTION}' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) ELSE '{rag.NOTHING_FOUND}' END || chr(10) || chr(10) || 'Question: {QUESTION}' AS prompt FROM parts)
SELECT md5(prompt) AS digest, length(prompt) AS n_chars FROM p""",
        "render_search": f"""WITH {_RESULTS}, parts AS (SELECT rank, concat_ws(chr(10), 'Result ' || rank || ' (score: ' || printf('%.3f', score) || ')' || chr(10) || repo || '/' || path || ':' || start_line || '-' || end_line, 'Symbol: ' || symbol_name) || chr(10) || '```' || coalesce(language, '') || chr(10) || text || chr(10) || '```' AS part FROM results),
p AS (SELECT CASE WHEN count(*) > 0 THEN 'Found ' || count(*) || ' results' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) ELSE 'No matching code found' END AS text FROM parts)
SELECT md5(text) AS digest, length(text) AS n_chars FROM p""",
        "render_repositories": f"WITH {_CHUNKS}, r AS (SELECT repo, count(*) AS n FROM chunks WHERE repo IS NOT NULL GROUP BY repo ORDER BY n DESC, repo LIMIT 1000) SELECT 'Indexed repositories (' || count(*) || ')' || chr(10) || string_agg('- ' || repo, chr(10) ORDER BY n DESC, repo) AS text FROM r",
        "render_stats": f"""WITH {_CHUNKS}, {_STATS} SELECT repo, 'Total chunks: ' || sum(CASE WHEN facet = 'total' THEN chunks ELSE 0 END)::BIGINT || chr(10) || 'By language:' || chr(10) || coalesce(string_agg('- ' || value || ': ' || chunks, chr(10) ORDER BY chunks DESC, value) FILTER (WHERE facet = 'language'), '') || chr(10) || 'By symbol type:' || chr(10) || coalesce(string_agg('- ' || value || ': ' || chunks, chr(10) ORDER BY chunks DESC, value) FILTER (WHERE facet = 'symbol_type'), '') AS text FROM stats GROUP BY repo""",
        "render_file_chunks": f"WITH {_CHUNKS}, {_ONE_FILE} SELECT md5(string_agg('## ' || coalesce(symbol_name, symbol_type) || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || '```' || coalesce(language, '') || chr(10) || text || chr(10) || '```', chr(10) || chr(10) ORDER BY start_line, id)) AS digest FROM one",
        "hash_embed": """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, ('0x' || left(md5(w), 8))::BIGINT AS h, count(*) AS n FROM w WHERE w <> '' GROUP BY doc_id, w),
s AS (SELECT doc_id, h % 64 AS bucket, sum(n * CASE WHEN (h >> 31) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM h GROUP BY 1, 2),
m AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1)
SELECT s.doc_id, bucket, round(x / norm, 6) AS weight FROM s JOIN m USING (doc_id) WHERE x <> 0""",
        "overrides_join": f"WITH {_FILES} SELECT file_id, files.repo, r.microservice, array_to_string(r.tags, ',') AS tags FROM files LEFT JOIN (SELECT * FROM repositories WHERE microservice IS NOT NULL) r ON r.repo = files.repo",
        "ingest_totals": f"WITH {_CHUNKS}, {_FILES}, c AS (SELECT repo, count(*) AS n FROM chunks GROUP BY repo), f AS (SELECT repo, count(*) AS files, sum(CASE WHEN coalesce({_BLANK}, false) THEN 0 ELSE 1 END) AS failed FROM files GROUP BY repo) SELECT sum(files)::BIGINT AS files, sum(coalesce(n, 0))::BIGINT AS chunks, sum(coalesce(n, 0))::BIGINT AS indexed, sum(failed)::BIGINT AS failed FROM f LEFT JOIN c USING (repo)",
        "distinct_calls": "WITH s AS (SELECT symbol_id, any_value(calls) AS calls FROM parsed_symbols GROUP BY symbol_id), e AS (SELECT symbol_id, unnest(calls) AS c, generate_subscripts(calls, 1) AS i FROM s WHERE calls IS NOT NULL), d AS (SELECT symbol_id, c, min(i) AS i FROM e GROUP BY symbol_id, c) SELECT s.symbol_id, coalesce(string_agg(c, ',' ORDER BY i), '') AS calls, count(c) AS n FROM s LEFT JOIN d ON d.symbol_id = s.symbol_id WHERE s.calls IS NOT NULL GROUP BY s.symbol_id",
        "late_scans": f"WITH {_FILES} SELECT strftime(date_trunc('week', scanned_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week, repo, count(*) AS files, sum(n_bytes)::BIGINT AS bytes FROM files GROUP BY 1, 2",
    }
