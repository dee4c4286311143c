import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.config import config_from
from codequarry.operators import aggregates, rag, render, search
from codequarry.operators.components import connected_components
from codequarry.operators.embedding import HashingProvider, hashed_weights, with_embeddings
from codequarry.operators.skew import hot_keys, salted_join
from codequarry.operators.store import ChunkStore, latest, new_or_changed
from codequarry.plans.engine import Engine, RagRequest, RequestError, SearchRequest
from codequarry.plans.ingest import ingest


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two repositories, one plain directory, and one whose `.git` is a file."""
    base = tmp_path_factory.mktemp("repos")
    for name in ("repo1", "repo2"):
        git = base / name / ".git"
        (git / "refs/heads").mkdir(parents=True)
        (git / "HEAD").write_text("ref: refs/heads/dev\n")
        (git / "refs/heads/dev").write_text("a" * 40 + "\n")
    (base / "plain").mkdir()
    (base / "work").mkdir()
    (base / "work/.git").write_text("gitdir: elsewhere")
    files = {
        "repo1/src/index.ts": "export function start(n: number) {\n  return n;\n}\n", "repo1/src/util.py": "def helper(x):\n    return x\n", "repo1/node_modules/p/i.js": "function no() {}\n",
        "repo1/src/out.log": "x", "repo1/README.md": "# hi", "repo1/.gitignore": "node_modules/\n*.log\n", "repo1/src/empty.ts": "  \n", "repo2/src/q.sql": "SELECT 1;\nSELECT 2;\n",
    }
    for path, content in files.items():
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content)
    return str(base)


@pytest.fixture(scope="module")
def indexed(spark, root, tmp_path_factory):
    config = config_from({"store": {"url": f"file://{tmp_path_factory.mktemp('store')}"}, "files": {"root": root, "include": ["**/*"], "overrides": {"repo1": {"microservice": "svc", "tags": ["t"]}}}, "embedding": {"dimension": 32}})
    store = ChunkStore(spark, f"{config.store.url}/{config.store.index}")
    return config, store, ingest(spark, config, store)


def test_ingest(spark, indexed):
    config, store, result = indexed
    assert (result.repositories, result.files, result.chunks, result.failed) == (2, 4, 4, 0)
    rows = {r["path"]: r for r in store.read(embedding=True).collect()}
    assert set(rows) == {"src/index.ts", "src/util.py", "src/q.sql"}
    assert rows["src/index.ts"]["microservice"] == "svc" and rows["src/index.ts"]["branch"] == "dev" and len(rows["src/util.py"]["embedding"]) == 32
    again = ingest(spark, config, store)
    assert again.chunks == 4 and store.read().count() == 4


def test_dry_run_writes_nothing(spark, indexed, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert ingest(spark, indexed[0], store, repo="repo2", dry_run=True).chunks == 2 and not store.exists()


def test_store_lifecycle(spark, indexed, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.create() and not store.create() and store.create(force=True) and store.read().count() == 0
    rows = indexed[1].read(embedding=True)
    store.replace(rows)
    store.upsert(rows.where("repo = 'repo2'").withColumn("text", F.lit("new")))
    assert {r["text"] for r in store.read().where("repo = 'repo2'").collect()} == {"new"} and store.read().count() == 4
    assert store.delete_repo("repo1") == 2 and store.delete_repo("none") == 0 and store.read().count() == 2
    assert store.ping()
    store.drop()
    assert not store.exists() and not store.ping()


def test_engine_calls(indexed):
    provider = HashingProvider(32)
    engine = Engine(indexed[1].read(embedding=True), provider, rag.extractive, least=0.0)
    found = engine.search_code(SearchRequest("helper return x", top_k=2, filters={"language": "python", "repo": ""}))
    assert found["total"] == 1 and found["results"][0]["path"] == "src/util.py" and 0 <= found["results"][0]["score"] <= 1
    assert engine.list_repositories() == ["repo1", "repo2"]
    assert engine.repository_stats("repo1") == {"repo": "repo1", "total_chunks": 2, "by_language": {"python": 1, "typescript": 1}, "by_symbol_type": {"function": 2}}
    assert engine.repository_stats("none")["total_chunks"] == 0
    assert [c["start_line"] for c in engine.file_chunks("repo2", "src/q.sql")] == [1, 2]
    events = list(engine.rag_query(RagRequest("helper")))
    assert events[0][0] == "context" and events[-1] == ("done", None) and "src/" in "".join(t for k, t in events if k == "text")
    assert engine.rag_query(RagRequest("helper", stream=False)).sources and engine.health()["status"] == "healthy"
    assert "Found" in engine.tool("search_code", {"query": "helper"})["text"] and "Indexed repositories (2)" in engine.tool("list_repositories", {})["text"]
    assert "python: 1" in engine.tool("get_repository_stats", {"repo": "repo1"})["text"] and "no indexed chunks" in engine.tool("get_repository_stats", {"repo": "q"})["text"]
    assert engine.tool("get_file_chunks", {"repo": "a", "path": "b"})["text"] == "No chunks found" and engine.tool("x", {})["is_error"]


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "q", "top_k": 0}, {"query": "q", "top_k": 101}, {"query": "q", "filters": {"symbol_type": "table"}}])
def test_bad_requests(bad):
    with pytest.raises(RequestError):
        SearchRequest(**bad)


def test_failing_generator_ends_the_stream(spark, indexed):
    def broken(text, most):
        yield "a"
        raise RuntimeError("down")

    found = search.search(indexed[1].read(embedding=True), HashingProvider(32).embed("x"), 2)
    assert [k for k, _ in rag.stream_answer(found, "q", broken)] == ["context", "text", "error"]
    assert rag.NOTHING_FOUND in rag.prompt(found.where("false"), "q").first()["prompt"]
    assert rag.is_configured("ollama") and not rag.is_configured("openai", env={}) and rag.is_configured("openai", "k", {})


def vectors(spark, n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None)], "id long, embedding array<float>").repartition(5)


def test_batch_search_equals_brute_force(spark):
    x, rows = vectors(spark)
    unit = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    found = search.batch_top_k(rows, rows.where("id % 20 = 0"), 5, block=4).collect()
    for q in range(0, 300, 20):
        want = np.argsort(-sims[q], kind="stable")[:5].tolist()
        assert [r["neighbour"] for r in sorted((r for r in found if r["query"] == q), key=lambda r: r["rank"])] == want


def test_index_keeps_recall(spark):
    _, rows = vectors(spark, 600)
    queries = rows.where("id % 20 = 0")
    exact = search.batch_top_k(rows, queries, 10)
    near = search.batch_top_k(rows, queries, 10, index=search.CodeIndex(rows))
    assert search.recall(exact, near).first()["recall"] >= 0.9


def test_search_edge_cases(spark):
    _, rows = vectors(spark, 3)
    assert search.batch_top_k(rows, rows.where("false"), 5).count() == 0 and search.batch_top_k(rows.where("false"), rows, 5).count() == 0
    flat = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0])], "id long, embedding array<float>")
    assert [r["id"] for r in search.top_k(flat, [1.0, 0.0], 5).collect()] == [3]
    ties = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    assert [r["id"] for r in search.top_k(ties, [1.0, 0.0], 2).collect()] == [1, 2]
    assert [r["id"] for r in search.min_score(search.top_k(ties, [1.0, 0.0], 3), 0.5).collect()] == [1, 2, 3]


def test_hashed_weights_equal_the_provider(spark):
    texts = ["Foo bar foo", "", "x y z x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    dense = HashingProvider(16).embed_batch(texts)
    for r in hashed_weights(rows, "id", "text", 16).collect():
        assert abs(dense[r["id"], r["bucket"]] - r["weight"]) < 1e-6
    assert [len(r["embedding"]) for r in with_embeddings(rows, HashingProvider(16)).collect()] == [16] * 3


def test_latest_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "id string, at int, v string")
    assert {(r["id"], r["v"]) for r in latest(rows, "id", ["at"]).collect()} == {("a", "y"), ("b", None)}
    files = spark.createDataFrame([("r", "p", "c1"), ("r", "q", "c2"), ("r", "z", None)], "repo string, relative_path string, content string")
    known = files.where("relative_path = 'p'").select("repo", "relative_path", F.sha2("content", 256).alias("digest"))
    assert {r["relative_path"] for r in new_or_changed(files, known).collect()} == {"q", "z"}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 5), (None, 7)] + [(100 + k, 101 + k) for k in range(60)] + [(900, k) for k in range(901, 1000)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in (1, 2, 3, 4)} == {1} and found[11] == 10 and {found[k] for k in range(100, 161)} == {100} and found[950] == 900 and 7 not in found
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_join_keeps_every_row(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 100)
    joined = salted_join(many, one, hot, ["k"], F.col("id"))
    assert joined.count() == 1000 and joined.where("v <> 2 * k").count() == 0


def test_stats_long_form(spark):
    rows = spark.createDataFrame([("r", "ts", "f"), ("r", "ts", "c"), ("r", None, "f"), ("s", "py", "f")], "repo string, language string, symbol_type string")
    found = {(r["repo"], r["facet"], r["value"]): r["chunks"] for r in aggregates.repo_stats(rows).collect()}
    assert found == {("r", "total", "all"): 3, ("r", "language", "ts"): 2, ("r", "symbol_type", "f"): 2, ("r", "symbol_type", "c"): 1, ("s", "total", "all"): 1, ("s", "language", "py"): 1, ("s", "symbol_type", "f"): 1}
    assert render.repositories_text(aggregates.list_repositories(rows.where("false"))).first()["text"] == "Nothing is indexed yet"


def test_cli(spark, root, tmp_path, capsys):
    from codequarry.cli import main

    path = tmp_path / "c.yaml"
    path.write_text(f"store: {{url: 'file://{tmp_path}/s'}}\nfiles: {{root: '{root}', include: ['**/*']}}\nembedding: {{dimension: 8}}\n")
    assert main(["setup-index", "-c", str(path)], spark) == 0 and main(["ingest", "--config", str(path), "--repo", "repo1"], spark) == 0
    assert "chunks 2" in capsys.readouterr().out and os.path.isdir(f"{tmp_path}/s/code-chunks")


def test_upsert_keeps_the_last_by_order_whatever_the_rows_place(spark, tmp_path):
    from codequarry.schema import CODE_CHUNK

    store = ChunkStore(spark, str(tmp_path / "s"))
    store.create()

    def chunks(rows):
        base = spark.createDataFrame(rows, "id string, repo string, path string, text string, at int")
        for c in CODE_CHUNK:
            if c.name not in base.columns:
                base = base.withColumn(c.name, F.lit(None).cast(c.dataType))
        return base.coalesce(1)

    first = store.upsert(chunks([("a", "r", "p", "new", 2), ("a", "r", "p", "old", 1), ("b", "r", "p", "x", 1), (None, "r", "q", "x", 1), ("c", None, "z", "x", 1)]), ["at"])
    assert (first.indexed, first.failed) == (2, 2) and sorted(first.errors) == ["None/z: no repository", "r/q: no id"]
    assert {r["id"]: r["text"] for r in store.read().collect()} == {"a": "new", "b": "x"}
    store.upsert(chunks([("a", "r", "p", "newer", 4), ("a", "r", "p", "older", 3), ("d", "s'/=%", "p", "y", 1)]), ["at"])
    assert {r["id"]: r["text"] for r in store.read().collect()} == {"a": "newer", "b": "x", "d": "y"}
    assert store.delete_repo("s'/=%") == 1 and {r["id"] for r in store.read().collect()} == {"a", "b"}
    assert store.upsert(chunks([("z", None, "p", "y", 1)])).indexed == 0


def test_answers_fetch_the_search_once_and_stream_json(spark, indexed):
    import json

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    rows = indexed[1].read(embedding=True)
    found = rag.retrieve(rows, HashingProvider(32).embed("helper"), 3, 0.0)
    assert {r["hits"] for r in found.collect()} == {3}
    lines = list(rag.json_events(rag.stream_answer(found.withColumn("score", counted("score")), "helper", rag.extractive)))
    assert calls.value == 3
    events = [json.loads(x.removeprefix("data: ")) for x in lines]
    assert events[0]["type"] == "context" and events[0]["total"] == 3 and events[-1] == {"type": "done"} and all(x.endswith("\n\n") for x in lines)


def test_remote_requests_are_bounded_and_providers_disposed(spark):
    from codequarry.operators.embedding import RemoteProvider

    seen = []

    def post(url, header, body):
        seen.append((url, len(body["input"])))
        return {"data": [{"index": k, "embedding": [float(len(t))]} for k, t in reversed(list(enumerate(body["input"])))]}

    provider = RemoteProvider("azure", "https://a.example/", "k", "m", post, 1, batch_size=7, deployment="d", api_version="v")
    assert provider.embed_all(["x" * k for k in range(20)]).ravel().tolist() == [float(k) for k in range(20)]
    assert seen == [("https://a.example/openai/deployments/d/embeddings?api-version=v", n) for n in (7, 7, 6)]

    class Once(HashingProvider):
        disposed = spark.sparkContext.accumulator(0)

        def dispose(self):
            self.disposed.add(1)

    with_embeddings(spark.createDataFrame([("a",)], "text string").coalesce(1), Once(4)).collect()
    assert Once.disposed.value == 1


def test_ingest_tells_progress_and_keeps_failures(spark, indexed, tmp_path, monkeypatch):
    from codequarry.operators import chunking

    class Broken:
        languages = ("sql",)

        def parse(self, text, path):
            raise ValueError("bad")

    monkeypatch.setattr(chunking, "default_parsers", lambda: {"sql": Broken()})
    told = []
    store = ChunkStore(spark, str(tmp_path / "s"))
    monkeypatch.setattr("codequarry.plans.ingest.chunk_files", lambda files, *a: chunking.chunk_files(files, *a, parsers={"sql": Broken()}))
    result = ingest(spark, indexed[0], store, progress=lambda *x: told.append(x), batch=1)
    assert result.failed == 1 and result.errors == ["repo2/src/q.sql: ValueError: bad"] and result.files == 4
    assert told == [("parsed", 4, 4), ("indexed", 2, 2), ("indexed", 2, 2)]
    assert [r["path"] for r in spark.read.parquet(f"{store.path}-failures").collect()] == ["src/q.sql"]


def test_repositories_with_the_same_rules_are_one_scan(spark, tmp_path):
    from codequarry.sources.files import enumerate_repositories, read_file

    for k in range(5):
        (tmp_path / f"d{k}" / "src").mkdir(parents=True)
        (tmp_path / f"d{k}" / "src" / "a.py").write_text(f"x = {k}\n")
    files = enumerate_repositories(spark, [(f"name{k}", str(tmp_path / f"d{k}")) for k in range(5)], ["**/*"])
    assert files._jdf.queryExecution().executedPlan().toString().count("Scan binaryFile") + files._jdf.queryExecution().executedPlan().toString().count("FileScan binaryFile") >= 1
    assert {(r["repo"], r["relative_path"], r["content"]) for r in files.collect()} == {(f"name{k}", "src/a.py", f"x = {k}\n") for k in range(5)}
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
    assert read_file(spark, str(tmp_path / "d3"), "src/a.py") == "x = 3\n"


def test_ranking_uses_full_scores(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    assert [r["id"] for r in search.top_k(rows, [1.0, 0.0], 2).collect()] == [2, 1]
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1e-4]), (2, [1.0, 1e-5])], "id long, embedding array<double>")
    assert [r["neighbour"] for r in search.batch_top_k(three, three.where("id = 0"), 2).orderBy("rank").collect()] == [2, 1]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from codequarry import session

    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), getConf=lambda: {})
    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
