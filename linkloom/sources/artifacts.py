"""Artifacts as files: JSON lines with or without a header of provenance, and JSON envelopes.

Tables inside of the engine are Parquet; these readers and writers are its edges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "artifact string, version int, repositoryCommit string, engineVersion string, excludePatterns array<string>, symbolCount bigint, resultCount bigint"
SYMBOL = (
    "symbolId string, kind string, name string, qualifiedName string, relativePath string, startLine int, endLine int, signature string, documentation string, "
    "normalizedSource string, exported boolean, repositoryCommit string"
)
RESULT = "requirementId string, configurationId string, repositoryCommit string, candidates array<struct<rank:int,symbolId:string,score:double>>"
LABELS = "repositoryCommit string, createdAt string, labeler string, links array<struct<requirementId:string,symbolId:string,labelPass:string,relationship:string,confidence:string,rationale:string>>"
DECISION = (
    "requirementId string, proposedSymbolId string, symbolId string, kind string, relationship string, modelClassification string, modelConfidence double, band string, "
    "reviewer string, timestamp string, repositoryCommit string, note string"
)
PROPOSAL = "requirementId string, symbolId string, rank int, classification string, confidence double, rationale string, band string"


def _lines(spark: SparkSession, path: str, schema: str, version: int, counted: str) -> tuple[DataFrame, dict | None]:
    """Rows and header of a JSON-lines artifact; the header is optional, its version and count are checked."""
    kind = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    head = spark.createDataFrame([], HEADER).schema
    both = T.StructType([*head.fields, *[f for f in kind.fields if f.name not in head.names], T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(both).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    headers = rows.filter("artifact is not null").select(*head.names).limit(2).collect()
    if len(headers) > 1:
        raise ValueError(f"{path}: more than one header")
    header = headers[0].asDict() if headers else None
    if bad := rows.filter("_corrupt is not null").select("artifact", "_corrupt").limit(1).collect():
        raise ValueError(f"{path}: a line is not valid JSON: {bad[0]['_corrupt'][:80]}")
    body = rows.filter("artifact is null").select(*kind.names)
    if header:
        if header["version"] != version:
            raise ValueError(f"{path}: version {header['version']}, expected {version}")
        if header[counted] is not None and (n := body.count()) != header[counted]:
            raise ValueError(f"{path}: the header counts {header[counted]} rows, there are {n}")
    return body, header


def read_symbol_index(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, dict | None]:
    return _lines(spark, path, SYMBOL, version, "symbolCount")


def read_results(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, dict | None]:
    """Candidate lists, one row each; :func:`exploded` makes one row of each candidate."""
    return _lines(spark, path, RESULT, version, "resultCount")


def exploded(results: DataFrame) -> DataFrame:
    return results.select("requirementId", "configurationId", "repositoryCommit", F.explode("candidates").alias("c")).select("requirementId", "configurationId", "repositoryCommit", "c.*")


def _envelope(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a ground-truth file, one row each, with the file's commit; a file without links is an error."""
    rows = _envelope(spark, path, LABELS)
    checked = rows.filter(F.when(F.col("links").isNull(), F.raise_error(F.lit(f"{path}: no links")).cast("boolean")).otherwise(True))
    return checked.select("repositoryCommit", "createdAt", "labeler", F.explode("links").alias("l")).select("l.*", "repositoryCommit", "createdAt", "labeler")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """A decision log with ``seq``, the place of each decision."""
    rows = _envelope(spark, path, f"decisions array<struct<{', '.join(c.replace(' ', ':', 1) for c in DECISION.split(', '))}>>")
    return rows.select(F.posexplode("decisions").alias("seq", "d")).select(F.col("seq").cast("bigint"), "d.*")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    rows = _envelope(spark, path, f"proposals array<struct<{', '.join(c.replace(' ', ':', 1) for c in PROPOSAL.split(', '))}>>")
    return rows.select(F.explode("proposals").alias("p")).select("p.*")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """configurationId, label, requirementCount, mrr and the maps recall and hit (k to value) of a metrics file."""
    rows = _envelope(spark, path, "configurationId string, breakdowns array<struct<label:string,requirementCount:int,recallAtK:map<string,double>,hitAtK:map<string,double>,meanReciprocalRank:double>>")
    return rows.select("configurationId", F.explode("breakdowns").alias("b")).select("configurationId", "b.label", "b.requirementCount", F.col("b.recallAtK").alias("recall"), F.col("b.hitAtK").alias("hit"), F.col("b.meanReciprocalRank").alias("mrr"))


def read_embedding_cache(spark: SparkSession, path: str, model: str, dimensions: int) -> DataFrame:
    """key and vector; empty where the file is of another model or number of dimensions, bad vectors left out."""
    from linkloom.operators.semantic import valid_cache

    rows = _envelope(spark, path, "modelId string, dimensions int, entries array<struct<key:string,vector:array<double>>>")
    flat = rows.filter(F.col("dimensions") == dimensions).select(F.col("modelId").alias("model"), F.explode("entries").alias("e")).select("model", "e.*")
    return valid_cache(flat, model, dimensions)


def write_lines(rows: DataFrame, path: str, header: dict, order: list[str]) -> None:
    """JSON lines sorted by ``order`` after one header line; the folder holds one file, as a reader expects."""
    spark = rows.sparkSession
    body = rows.withColumn("__line", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    lines = body.select(F.lit(1).alias("part"), *order, "__line").unionByName(spark.createDataFrame([(0, json.dumps(header))], "part int, __line string"), allowMissingColumns=True)
    lines.repartition(1).sortWithinPartitions("part", *order).select("__line").write.text(path)


def write_symbol_index(symbols: DataFrame, path: str, commit: str, engine: str, patterns: list[str] | None = None) -> None:
    names = [c.split(" ")[0] for c in SYMBOL.split(", ")]
    header = {"artifact": "symbol-index", "version": 1, "repositoryCommit": commit, "engineVersion": engine, "excludePatterns": patterns or [], "symbolCount": symbols.count()}
    write_lines(symbols.select(*names), path, header, ["relativePath", "qualifiedName", "kind"])


def write_results(results: DataFrame, path: str, commit: str, engine: str) -> None:
    """``results`` in long form: requirementId, configurationId, repositoryCommit, rank, symbolId, score."""
    lists = results.groupBy("requirementId", "configurationId", "repositoryCommit").agg(F.array_sort(F.collect_list(F.struct("rank", "symbolId", "score"))).alias("candidates"))
    header = {"artifact": "retrieval-results", "version": 1, "repositoryCommit": commit, "engineVersion": engine, "resultCount": lists.count()}
    write_lines(lists, path, header, ["requirementId"])


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned ``by`` the columns that lookups name."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def is_current(stored: dict | None, wanted: dict) -> bool:
    """Whether a stored index may be used again: same commit, engine and patterns; never without a header."""
    return stored is not None and all(stored.get(k) == wanted.get(k) for k in ("repositoryCommit", "engineVersion", "excludePatterns"))


def write_document(rows: DataFrame, path: str, head: dict, name: str, order: list[str], tail: dict | None = None) -> None:
    """One JSON object: the keys of ``head``, ``name`` with all rows as an array sorted by ``order``, the keys of ``tail``.

    The rows stream through one task into one file, as readers of the format expect; they are never on the driver. Null
    fields are left out of a row. Tables that should stay many files go through :func:`write_table`.
    """
    columns = [c for c in rows.columns if not c.startswith("__")]  # what only orders the rows is not written
    opening = json.dumps(head, ensure_ascii=False)[:-1] + (", " if head else "") + json.dumps(name) + ": ["
    closing = "]" + "".join(f", {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in (tail or {}).items()) + "}"
    lines = rows.repartition(1).sortWithinPartitions(*order).select(F.to_json(F.struct(*columns)).alias("value"))

    def framed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        yield pd.DataFrame({"value": [opening]})
        for frame in frames:
            if len(frame):
                texts = ("," + frame["value"]).tolist()
                texts[0] = texts[0] if begun else texts[0][1:]
                begun = True
                yield pd.DataFrame({"value": texts})
        yield pd.DataFrame({"value": [closing]})

    # an empty table has no partition to frame
    framed_lines = lines.mapInPandas(framed, "value string") if not lines.isEmpty() else rows.sparkSession.createDataFrame([(opening + closing,)], "value string")
    framed_lines.coalesce(1).write.text(path)


def write_proposals(proposals: DataFrame, failures: DataFrame, path: str, provenance: dict, bands: dict[str, float], usage: dict, partial: bool = False) -> None:
    """The proposals of a run by requirement and rank, its failures (few) and its usage; ``partial`` only where it is true."""
    names = [c.split(" ")[0] for c in PROPOSAL.split(", ") if c.split(" ")[0] in proposals.columns]
    failed = [json.loads(r) for r in failures.toJSON().collect()]
    tail = {"failures": failed, "usage": usage} | ({"partial": True} if partial else {})
    write_document(proposals.select(*names), path, {"artifact": "proposals", "version": 1, **provenance, "bands": bands}, "proposals", ["requirementId", "rank", "symbolId"], tail)


def write_decisions(log: DataFrame, path: str) -> None:
    """A decision log in the order of ``seq``, without it; :func:`read_decisions` reads it back."""
    names = [c.split(" ")[0] for c in DECISION.split(", ") if c.split(" ")[0] in log.columns]
    ordered = log.select(F.struct(*names).alias("d"), "seq")
    write_document(ordered.select("d.*", F.col("seq").alias("__seq")), path, {"artifact": "decision-log", "version": 1}, "decisions", ["__seq"])


def write_link_index(index: DataFrame, path: str, commit: str) -> None:
    """Links by requirement and symbol."""
    head = {"artifact": "link-index", "version": 1, "repositoryCommit": commit}
    write_document(index.select("requirementId", "symbolId", "reviewer", "timestamp", "commit"), path, head, "links", ["requirementId", "symbolId"])


def write_payload_log(items: DataFrame, path: str, provenance: dict, mode: str, embedded: int | None = None) -> None:
    """What was sent: one entry for each item by requirement and rank; ``embedded`` texts for a run that embeds."""
    retrieval = {"mode": mode} | ({"embedding": {"embedded": embedded}} if embedded is not None else {})
    head = {"artifact": "payload-log", "version": 1, **provenance, "retrieval": retrieval}
    write_document(items, path, head, "items", ["requirementId", "rank", "symbolId"])


def write_embedding_cache(cache: DataFrame, needed: DataFrame, path: str, model: str, dimensions: int) -> None:
    """The vectors that this run needed, by key; :func:`read_embedding_cache` reads them back."""
    from linkloom.operators.semantic import pruned_cache

    head = {"artifact": "embedding-cache", "version": 1, "modelId": model, "dimensions": dimensions}
    write_document(pruned_cache(cache, needed).select("key", "vector"), path, head, "entries", ["key"])


def metrics_report(metrics: DataFrame, unscored: DataFrame, configuration: str, provenance: dict | None, ks: tuple[int, ...] = (1, 3, 5, 10)) -> str:
    """The slices of one configuration (rows of ``evaluation.averaged`` by stratum) with the requirements each leaves out."""
    left_out: dict[str, list[str]] = {}
    for r in unscored.orderBy("stratum", "requirementId").collect():  # ids of labelled requirements, a list made by hand
        left_out.setdefault(r["stratum"], []).append(r["requirementId"])
    slices = [
        {
            "label": r["stratum"], "requirementCount": r["scored"], "requirementsWithoutGroundTruth": left_out.get(r["stratum"], []), "recallAtK": {str(k): r[f"recall_{k}"] for k in ks},
            "hitAtK": {str(k): r[f"hit_{k}"] for k in ks}, "meanReciprocalRank": r["mrr"],
        }
        for r in metrics.filter(F.col("configurationId") == configuration).orderBy("stratum").collect()
    ]
    body = {"artifact": "retrieval-metrics", "version": 1, "provenance": provenance, "configurationId": configuration, "ks": list(ks), "breakdowns": slices}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def proposal_metrics_report(metrics: DataFrame, provenance: dict | None, outside: int) -> str:
    """The slices of ``evaluation.prediction_metrics`` with their bands, and how many proposals lie outside of the scope."""
    slices = [
        {
            "label": r["stratum"], "bands": ["suggest"] if r["stratum"] == "suggest-only" else ["suggest", "review"], "requirementCount": r["requirements"], "requirementsWithoutGroundTruthCount": r["without_labels"],
            "predicted": r["predicted"], "relevant": r["relevant"], "truePositives": r["true_positives"], "precision": r["precision"], "recall": r["recall"], "f1": r["f1"],
        }
        for r in metrics.orderBy("stratum").collect()
    ]
    return json.dumps({"artifact": "proposal-metrics", "version": 1, "provenance": provenance, "breakdowns": slices, "proposalsOutsideScope": outside}, indent=2, ensure_ascii=False) + "\n"


def comparison_report(comparison: DataFrame, omitted: dict[int, list[str]]) -> str:
    """Rows of ``evaluation.compare``, and the ks that only some configurations report."""
    body = {"artifact": "metrics-comparison", "version": 1, "strata": [json.loads(r) for r in comparison.orderBy("stratum").toJSON().collect()], "omittedKs": {str(k): v for k, v in omitted.items()}}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def init_report(root: str, created: list[str], skipped: list[str], overwritten: list[str]) -> str:
    return json.dumps({"artifact": "init-report", "version": 1, "repositoryRoot": root, "created": created, "skipped": skipped, "overwritten": overwritten}, indent=2) + "\n"


def validation_report(findings: DataFrame, documents: int, requirements: int, paths: list[str]) -> str:
    """Findings of ``documents.validation_report`` as violations and warnings; valid without a violation."""
    parts = {n: [json.loads(r) for r in findings.filter(F.col("level") == n).drop("level").orderBy("path", "rule", "field").toJSON().collect()] for n in ("violation", "warning")}
    body = {"artifact": "validation-report", "version": 1, "valid": not parts["violation"], "specPaths": paths, "requirementCount": requirements, "documentCount": documents, "violations": parts["violation"], "warnings": parts["warning"]}
    return json.dumps(body, indent=2, ensure_ascii=False) + "\n"


def write_coverage_report(states: DataFrame, path: str, commit: str, engine: str, broken: DataFrame | None = None) -> None:
    """States of ``links.coverage`` by requirement under their sums; broken links only where staleness was checked."""
    sums = {r["state"]: r for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("links").alias("links"), F.sum("broken_links").alias("broken")).collect()}
    total = lambda c: sum(r[c] for r in sums.values())
    summary = {"total": total("n"), **{s: sums[s]["n"] if s in sums else 0 for s in ("linked", "stale", "unlinked")}, "linkTotal": total("links"), "brokenLinkTotal": total("broken")}
    head = {"artifact": "coverage-report", "version": 1, "repositoryCommit": commit, "engineVersion": engine, "stalenessChecked": broken is not None, "summary": summary}
    tail = {} if broken is None else {"brokenLinks": [json.loads(r) for r in broken.orderBy("requirementId", "symbolId").toJSON().collect()]}
    write_document(states, path, head, "requirements", ["requirementId"], tail)


def envelope(artifact: str, commit: str, engine: str, **parts: DataFrame | int | float | str | bool) -> str:
    """A small result as one JSON text: rows as lists of objects. Meant for reports, whose rows are few."""
    body = {k: [json.loads(r) for r in v.toJSON().collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    return json.dumps({"artifact": artifact, "version": 1, "repositoryCommit": commit, "engineVersion": engine, **body}, indent=2, ensure_ascii=False) + "\n"
