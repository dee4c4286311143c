"""Retrieval-augmented answers: context, prompt, and a pluggable text generator."""

from __future__ import annotations

import dataclasses as D
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.functions.text import percent
from codequarry.operators.search import min_score, search

Generator = Callable[[str, int], Iterator[str]]  # (prompt, most tokens) to pieces of text

INTRODUCTION = "Answer the question about the code base from the excerpts below. Name the file and lines you rely on, and say so if the excerpts do not answer it."
NOTHING_FOUND = "No excerpt of the code base matches the question. Say that, and suggest how to ask for it differently."


def retrieve(chunks: DataFrame, query: list[float], k: int = 10, least: float = 0.5, filters: dict[str, str | None] | None = None) -> DataFrame:
    """The k best chunks that also reach the least score, with `hits`: how many the search had found before."""
    found = search(chunks, query, k, filters)
    return min_score(found.withColumn("hits", F.count("*").over(W.partitionBy(F.lit(0)))), least)  # k rows


MOST_RESULTS = 1000


def ranked(results: DataFrame) -> DataFrame:
    """`rank` by score, then id, among the few rows of a result: they meet in one task, so more than `MOST_RESULTS` are an error."""
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))
    too_many = F.raise_error(F.lit(f"a result of more than {MOST_RESULTS} rows can't be ranked as a whole")).cast("int")
    return results.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") > MOST_RESULTS, too_many).otherwise(F.col("rank")))


def excerpt():
    """One numbered excerpt: heading, known facts, fenced text."""
    place = F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("] "), "repo", F.lit("/"), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    facts = F.concat_ws(
        " | ",
        F.concat(F.lit("Language: "), "language"),
        F.concat(F.lit("Symbol: "), "symbol_name"),
        F.concat(F.lit("Signature: "), "signature"),
        F.concat(F.lit("Relevance: "), percent(F.col("score")).cast("string"), F.lit("%")),
    )
    return F.concat(place, F.lit("\n"), facts, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "text", F.lit("\n```"))


def prompt(results: DataFrame, question: str) -> DataFrame:
    """(prompt): one row; excerpts in the order of their rank."""
    parts = ranked(results).select("rank", excerpt().alias("part"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    asked = F.lit(f"Question: {question}")
    filled = F.concat_ws("\n\n", F.lit(INTRODUCTION), F.col("body"), asked)
    return body.select(F.when(F.col("body") != "", filled).otherwise(F.concat_ws("\n\n", F.lit(NOTHING_FOUND), asked)).alias("prompt"))


def sources(results: DataFrame, with_text: bool = False) -> DataFrame:
    """(repo, path, lines, symbol, score[, text])."""
    lines = F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")).alias("lines")
    return results.select("repo", "path", lines, F.col("symbol_name").alias("symbol"), "score", *(["text"] if with_text else []))


# fixed values: providers that need no key, and the variable that holds the key of the others
KEYLESS, KEY_VARIABLES = ("ollama", "openai-compatible"), {"openrouter": "OPENROUTER_API_KEY", "openai": "OPENAI_API_KEY"}
# fixed values: where the providers listen by default
BASE_URLS = {"ollama": "http://localhost:11434/v1", "openrouter": "https://openrouter.ai/api/v1", "openai": "https://api.openai.com/v1", "openai-compatible": ""}


def is_configured(provider: str, api_key: str | None = None, env: dict[str, str] | None = None) -> bool:
    env = os.environ if env is None else env
    return provider in KEYLESS or bool(api_key or env.get(KEY_VARIABLES.get(provider, ""), ""))


def generator_for(provider: str, model: str, stream, api_key: str | None = None, base_url: str | None = None) -> Generator:
    """A generator over a transport `stream(url, key, body) -> pieces`, given by the caller."""
    if provider not in BASE_URLS:
        raise ValueError(f"unknown provider {provider}")
    key = api_key or os.environ.get(KEY_VARIABLES.get(provider, ""), "")
    url = base_url or BASE_URLS[provider]
    return lambda text, most: stream(f"{url}/chat/completions", key, {"model": model, "max_tokens": most, "messages": [{"role": "user", "content": text}]})


def extractive(text: str, most: int) -> Iterator[str]:
    """A stand-in generator without a model: it names the excerpts' headings."""
    yield from (line.removeprefix("### ") + "\n" for line in text.split("\n") if line.startswith("### ["))


def json_events(events: Iterator[tuple[str, object]]) -> Iterator[str]:
    """A stream of events as server-sent lines: each one JSON object with its type and content."""
    names = {"context": "sources", "text": "content", "error": "message"}
    for kind, content in events:
        body = {"type": kind, **({names[kind]: content} if kind in names else {}), **({"total": len(content)} if kind == "context" else {})}
        yield f"data: {json.dumps(body, ensure_ascii=False)}\n\n"


@D.dataclass
class Answer:
    answer: str
    sources: list[dict]


def kept_once(results: DataFrame) -> DataFrame:
    """A result's few rows, fetched once, so that sources and prompt don't each run the search again."""
    return results.sparkSession.createDataFrame(results.collect(), results.schema)


def stream_answer(results: DataFrame, question: str, generate: Generator, most: int = 4096) -> Iterator[tuple[str, object]]:
    """Events: `context` with the sources and how many there are, `text` for each piece, then `done`; `error` ends the stream instead
    if the generator fails. Only the k rows of the result reach the driver, once."""
    results = kept_once(results)
    kept = [r.asDict() for r in sources(results).collect()]
    yield "context", kept
    try:
        for piece in generate(prompt(results, question).first()["prompt"], most):
            yield "text", piece
    except Exception as e:
        yield "error", str(e)
        return
    yield "done", None


def answer(results: DataFrame, question: str, generate: Generator, most: int = 4096) -> Answer:
    results = kept_once(results)
    text = "".join(generate(prompt(results, question).first()["prompt"], most))
    return Answer(text, [r.asDict() for r in sources(results, with_text=True).collect()])
