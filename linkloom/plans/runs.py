"""Runs over several operators: retrieval by mode, ranking by an injected model, a sweep over modes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import LEXICAL_V5, LexicalConfig
from linkloom.functions import ids
from linkloom.operators import evaluation, fusion, lexical, payload, review, semantic
from linkloom.session import materialize

Embedder = Callable[[list[str]], list[list[float]]]


def lexical_run(queries: DataFrame, symbols: DataFrame, k: int, config: LexicalConfig = LEXICAL_V5) -> DataFrame:
    """requirementId, item, rank, score by field-weighted BM25; ``queries`` has requirementId and text."""
    corpus = symbols.withColumn("doc", F.col("symbolId"))
    found = lexical.bm25f(queries.select(F.col("requirementId").alias("query"), "text"), corpus, k, config)
    return found.select(F.col("query").alias("requirementId"), F.col("doc").alias("item"), "rank", "score")


def semantic_run(queries: DataFrame, symbols: DataFrame, k: int, embedder: Embedder, dimensions: int, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same by cosine of embeddings, and the cache (key, vector) of exactly this run's texts.

    Only texts that ``cache`` lacks are embedded. Ties are settled by a hash of the symbol id.
    """
    c = [F.col(x) for x in ("kind", "qualifiedName", "relativePath", "signature", "documentation", "normalizedSource")]
    keyed = symbols.select("symbolId", semantic.symbol_text(*c).alias("text")).withColumn("key", semantic.embedding_key(F.col("text")))
    asked = queries.select("requirementId", "text", semantic.embedding_key(F.col("text")).alias("key"))
    texts = keyed.select("text").unionByName(asked.select("text"))
    known = cache if cache is not None else texts.sparkSession.createDataFrame([], "key string, vector array<double>")
    fresh = materialize(semantic.embed(semantic.missing_texts(texts, known), embedder, dimensions), "embeddings")
    used = semantic.pruned_cache(known.unionByName(fresh), keyed.select("key").unionByName(asked.select("key")))
    numbered = lambda df, name: df.select(name).distinct().withColumn("number", F.xxhash64(name))
    q = asked.join(used, "key").select(F.xxhash64("requirementId").alias("query"), "vector")
    i = keyed.join(used, "key").select(F.xxhash64("symbolId").alias("item"), "vector")
    best = semantic.nearest(q, i, k)
    named = best.join(numbered(asked, "requirementId").withColumnRenamed("number", "query"), "query").join(numbered(keyed, "symbolId").withColumnRenamed("number", "item"), "item")
    return named.select("requirementId", F.col("symbolId").alias("item"), "rank", "score"), used


def retrieve(mode: str, queries: DataFrame, symbols: DataFrame, k: int = 10, embedder: Embedder | None = None, dimensions: int = 0, cache: DataFrame | None = None, strategy: str = "rrf-v1", parameter: float | None = None) -> DataFrame:
    """configurationId, requirementId, item, rank, score for a mode: lexical, semantic or hybrid."""
    if mode == "lexical":
        return lexical_run(queries, symbols, k).withColumn("configurationId", F.lit(LEXICAL_V5.configuration_id))
    if embedder is None:
        raise ValueError(f"mode {mode} needs an embedder")
    if mode == "semantic":
        return semantic_run(queries, symbols, k, embedder, dimensions, cache)[0].withColumn("configurationId", F.lit("embed-v1"))
    if mode != "hybrid":
        raise ValueError(f"unknown mode {mode}")
    pool = fusion.pool_size(k)
    first, second = lexical_run(queries, symbols, pool), semantic_run(queries, symbols, pool, embedder, dimensions, cache)[0]
    if strategy == "rrf-v1":
        parameter = 60 if parameter is None else parameter
        merged = fusion.reciprocal_rank_fusion(first, second, ["requirementId"], k, int(parameter))
    else:
        parameter = 0.5 if parameter is None else parameter
        merged = fusion.weighted_fusion(first, second, ["requirementId"], k, parameter)
    return merged.withColumn("configurationId", F.lit(fusion.fusion_id(LEXICAL_V5.configuration_id, "embed-v1", strategy, parameter)))


def rank_units(prompts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """requirementId, body, ref and error: the answer of ``model`` to every prompt; an exception becomes its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for requirement, prompt in zip(batch["requirementId"], batch["prompt"]):
                try:
                    rows.append((requirement, model(prompt), None))
                except Exception as error:  # noqa: BLE001 - a failed call is a result
                    rows.append((requirement, None, str(error)))
            yield pd.DataFrame(rows, columns=["requirementId", "body", "error"])

    answers = prompts.select("requirementId", "prompt").mapInPandas(run, "requirementId string, body string, error string")
    return answers.withColumn("ref", ids.digest(F.coalesce("body", F.concat(F.lit("provider error: "), "error")), 12))


def analyze(queries: DataFrame, symbols: DataFrame, model: Callable[[str], str], k: int = 10, suggest: float = 0.75, bounds: float = 0.5, **mode: object) -> tuple[DataFrame, DataFrame]:
    """Proposals with bands, and failures: retrieval, payload, one answer for each requirement, parsing, banding."""
    lists = materialize(retrieve(str(mode.pop("mode", "lexical")), queries, symbols, k, **mode).select("requirementId", F.col("item").alias("symbolId"), "rank"), "candidates")
    items = payload.payload_items(lists, symbols.drop("repositoryCommit"), ["requirementId"], k)
    prompts = payload.prompts(queries.select("requirementId", "text"), items, ["requirementId"], "## Requirement", "Return one verdict per candidate, as JSON.")
    answers = materialize(rank_units(prompts, model), "answers")
    proposals, failures = payload.verdicts(answers.filter("error is null").select("requirementId", "body"), lists, ["requirementId"])
    failed = answers.filter("error is not null").select("requirementId", F.lit(None).cast("string").alias("symbolId"), F.lit("response").alias("scope"), F.lit("provider-error").alias("rule"))
    banded = proposals.withColumn("band", review.band(F.col("confidence"), F.col("classification"), suggest, bounds))
    return banded, failures.unionByName(failed)


def sweep(modes: list[dict], queries: DataFrame, symbols: DataFrame, relevant: DataFrame, k: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """Metrics of several modes (arguments of :func:`retrieve`), and the reasons why some were skipped.

    ``relevant`` has requirementId and item.
    """
    done, skipped = [], {}
    for arguments in modes:
        try:
            done.append(retrieve(queries=queries, symbols=symbols, k=k, **arguments))
        except ValueError as error:
            skipped[str(arguments.get("mode"))] = str(error)
    if not done:
        raise ValueError(f"no mode could run: {skipped}")
    lists = reduce(DataFrame.unionByName, done)
    names = [r["configurationId"] for r in lists.select("configurationId").distinct().collect()]  # one for each mode
    each = lambda df: df.withColumn("configurationId", F.explode(F.array(*[F.lit(n) for n in names])))
    scope, truth = each(queries.select("requirementId").distinct()), each(relevant.select("requirementId", "item").distinct())
    items = evaluation.scored_items(lists, truth, scope, ["configurationId", "requirementId"])
    return evaluation.averaged(items, ["configurationId"]), skipped
