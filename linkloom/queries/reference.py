"""Queries of the traceability operators over the domain tables, with their SQL.

``bm25f_v3_topk`` and ``bm25f_v4_topk`` ask for every requirement, ``bm25f_topk`` for those whose number is divisible by 20,
``cosine_topk`` for every vector whose id is. All of them search all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.config import LEXICAL_V3, LEXICAL_V4, LEXICAL_V5, STOPWORDS, Budget, LexicalConfig
from linkloom.functions import ids, text
from linkloom.operators import candidates, documents, evaluation, fusion, lexical, links, payload, review, semantic, snapshots
from linkloom.queries.general import table
from linkloom.session import materialize, spread
from linkloom.sources import exclusions, extractor

#: keys of eight bytes that are broadcast at most
TWICE = 1 << 20


def _req() -> Column:
    return ids.requirement_id(F.col("requirementId")).alias("requirementId")


def _sym() -> Column:
    return ids.symbol_id(F.col("symbolId")).alias("symbolId")



_IMAGE = ["kind", "name", "qualifiedName", "relativePath", "startLine", "endLine", "signature", "documentation", "normalizedSource"]


def _corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbol_index").withColumn("symbolId", _sym()).filter("symbolId is not null and repositoryCommit is not null")


def _corpus_of(rows: DataFrame) -> DataFrame:
    image = F.max(F.struct("loadedAt", *_IMAGE)).alias("s")
    once = rows.groupBy("repositoryCommit", "symbolId").agg(image).select("repositoryCommit", "symbolId", *[f"s.{c}" for c in _IMAGE])
    return once.withColumn("doc", F.concat_ws("@", "symbolId", "repositoryCommit")).withColumn("scope", F.col("repositoryCommit"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol index as a corpus: one row per (commit, symbol), doc names both."""
    return _corpus_of(_corpus_rows(spark, sf_dir))


def _corpus_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`_corpus` without a copy: only those whose key may be there twice are moved and aggregated."""
    rows = _corpus_rows(spark, sf_dir).withColumn("key", F.xxhash64("repositoryCommit", "symbolId"))
    twice = materialize(rows.groupBy("key").count().filter("count > 1").select("key"), "twice")
    if twice.count() <= TWICE:
        twice = F.broadcast(twice)
    merged = materialize(_corpus_of(rows.join(twice, "key", "left_semi")), "merged")
    alone = rows.join(twice, "key", "left_anti").withColumn("doc", F.concat_ws("@", "symbolId", "repositoryCommit")).withColumn("scope", F.col("repositoryCommit"))
    return alone.select(*merged.columns).unionByName(merged)


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements once each: requirementId, title, difficulty, text."""
    rows = table(spark, sf_dir, "requirements").select(
        ids.requirement_id(F.col("id")).alias("requirementId"), "title", "difficulty", text.requirement_text(F.col("title"), F.col("statement"), F.col("acceptance_criteria")).alias("text")
    )
    image = F.max(F.struct("title", "difficulty", "text")).alias("r")
    return rows.filter("requirementId is not null").groupBy("requirementId").agg(image).select("requirementId", "r.*")


def _all_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir).select(F.col("requirementId").alias("query"), "text")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_asked(spark, sf_dir).filter(F.regexp_extract("query", r"(\d+)$", 1).cast("int") % 20 == 0)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labeled_links").select(_req(), _sym(), "labelPass", "relationship", "repositoryCommit")
    return rows.filter("requirementId is not null and symbolId is not null")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_log(table(spark, sf_dir, "decisions"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_index(links.clean_links(table(spark, sf_dir, "stored_links")))


def _current_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links stored at the newest snapshots."""
    return _index(spark, sf_dir).join(_newest(spark, sf_dir).withColumnRenamed("repositoryCommit", "commit"), "commit", "left_semi")


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repositoryCommit of the newest snapshot of each repository."""
    pairs = snapshots.snapshot_pairs(table(spark, sf_dir, "commits"))
    return pairs.filter(F.col("later").isNull()).select("repositoryCommit")


def _before_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repositoryCommit of the last snapshot but one of each repository."""
    pairs = snapshots.snapshot_pairs(table(spark, sf_dir, "commits"))
    return pairs.filter(F.col("later").isNull() & F.col("earlier").isNotNull()).select(F.col("earlier").alias("repositoryCommit"))


def _symbols_at(spark: SparkSession, sf_dir: str, commits: DataFrame) -> DataFrame:
    rows = table(spark, sf_dir, "symbol_index").select("repositoryCommit", _sym()).filter("symbolId is not null")
    return rows.join(commits, "repositoryCommit", "left_semi").distinct()


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols_at(spark, sf_dir, _newest(spark, sf_dir)).select("symbolId").distinct()


# --- text and lexical retrieval -----------------------------------------------------------------------------------


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    found = text.tokens(F.col("text"))
    return docs.groupBy("source").agg(F.sum(F.size(found)).alias("tokens"), F.sum(F.size(F.array_distinct(found))).alias("distinct_tokens"))


def folded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    words = _requirements(spark, sf_dir).select(F.explode(F.filter(text.tokens(F.col("text")), lambda t: ~F.array_contains(stop, t))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("term", text.fold_plural(F.col("term"), 1).alias("folded_1"), text.fold_plural(F.col("term"), 2).alias("folded_2"), "n")


def protected_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lexical.effective_stopwords(_corpus(spark, sf_dir), LEXICAL_V5)
    return spark.createDataFrame([(w, w in kept) for w in STOPWORDS], "word string, kept boolean")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    rows = lexical.occurrences(corpus, list(STOPWORDS), LEXICAL_V5)
    return lexical.term_statistics(rows, corpus.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.occurrences(_corpus(spark, sf_dir), list(STOPWORDS), LEXICAL_V5)
    return lexical.field_lengths(rows).select("field", F.round("average_length", 6).alias("average_length"))


def _bm25f(spark: SparkSession, sf_dir: str, config: LexicalConfig, asked: DataFrame) -> DataFrame:
    found = lexical.bm25f(asked, _corpus_in_place(spark, sf_dir), 10, config)
    return found.select(F.col("query").alias("requirementId"), "rank", "doc", F.round("score", 6).alias("score"))


def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25f(spark, sf_dir, LEXICAL_V5, _asked(spark, sf_dir))


def bm25f_v4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25f(spark, sf_dir, LEXICAL_V4, _all_asked(spark, sf_dir))


def bm25f_v3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25f(spark, sf_dir, LEXICAL_V3, _all_asked(spark, sf_dir))


def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _corpus(spark, sf_dir).select("doc", F.concat_ws("\u0001", "scope", "relativePath").alias("path"), F.col("startLine").alias("start"), F.col("endLine").alias("end"))
    return lexical.contained_counts(spans)


# --- semantic retrieval and fusion --------------------------------------------------------------------------------


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = semantic.nearest(asked, rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 10)
    return found.select("query", "rank", "item", F.round("score", 6).alias("score"))


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to embed at the newest snapshots: the cache holds what the runs at all earlier snapshots embedded."""
    c = [F.col(x) for x in ("kind", "qualifiedName", "relativePath", "signature", "documentation", "normalizedSource")]
    corpus = _corpus(spark, sf_dir).select("repositoryCommit", semantic.symbol_text(*c).alias("text"))
    newest = _newest(spark, sf_dir)
    texts = corpus.join(newest, "repositoryCommit", "left_semi").select("text").unionByName(_requirements(spark, sf_dir).select("text"))
    cached = corpus.join(newest, "repositoryCommit", "left_anti").select(semantic.embedding_key(F.col("text")).alias("key")).distinct()
    return semantic.missing_texts(texts, cached).select("key", F.length("text").alias("chars"))


def _fused(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    keys = ["requirementId", "repositoryCommit"]
    ranked = candidates.first_places(table(spark, sf_dir, "retrieval"), fusion.pool_size(5))
    first, second = (ranked.filter(F.col("configurationId") == c).select(*keys, F.col("symbolId").alias("item"), F.col("place").alias("rank"), "score") for c in ("bm25f-v5", "semantic-v2"))
    merged = fusion.reciprocal_rank_fusion(first, second, keys, 5) if how == "rrf" else fusion.weighted_fusion(first, second, keys, 5)
    return merged.select(*keys, "rank", F.col("item").alias("symbolId"), F.round("score", 9).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "rrf")


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "weighted")


# --- evaluation ---------------------------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 to A12 over whole lists and all requirements.

    A run is a configuration at a commit of which any list was delivered, also an empty one. Every requirement counts in
    every run: labelled ones without a list with 0, those without a label as unscored.
    """
    keys = ["configurationId", "requirementId", "repositoryCommit"]
    retrieval = table(spark, sf_dir, "retrieval")
    runs = retrieval.select("configurationId", "repositoryCommit").dropna().distinct()
    known = _requirements(spark, sf_dir).select("requirementId", "difficulty")
    truth = _labels(spark, sf_dir).filter("relationship = 'implements'").withColumn("labels", F.explode(evaluation.label_slices(F.col("labelPass"))))
    truth = truth.select("requirementId", "repositoryCommit", "labels", F.col("symbolId").alias("item")).distinct().join(known, "requirementId", "left_semi")
    relevant = materialize(truth.join(runs, "repositoryCommit").select(*keys, "labels", "item"), "relevant")
    places = candidates.whole_places(retrieval, relevant.withColumnRenamed("item", "symbolId"))
    found = relevant.join(places.withColumnRenamed("symbolId", "item").withColumnRenamed("place", "rank"), [*keys, "item"])
    items = evaluation.scored_items(found, relevant, relevant, [*keys, "labels"])
    sliced = items.join(known, "requirementId").withColumn("stratum", F.explode(evaluation.pass_strata(F.col("labels"), F.col("difficulty"))))
    metrics = evaluation.averaged(sliced, ["configurationId", "stratum"]).drop("unscored")
    labels = F.explode(F.array(*map(F.lit, evaluation.LABEL_PASSES)))
    sizes = known.withColumn("labels", labels).select(F.explode(evaluation.pass_strata(F.col("labels"), F.col("difficulty"))).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    # one row for each word of the vocabulary of difficulties, and three more
    slices = F.array(*[F.struct(F.lit(r["stratum"]).alias("stratum"), F.lit(r["n"]).alias("n")) for r in sizes.collect()] or [F.lit(None).cast("struct<stratum:string,n:bigint>")])
    totals = runs.groupBy("configurationId").agg(F.count(F.lit(1)).alias("runs")).select("*", F.inline(F.array_compact(slices)))
    rows = totals.join(metrics, ["configurationId", "stratum"], "left").fillna(0)
    return rows.select("configurationId", "stratum", "scored", (F.col("n") * F.col("runs") - F.col("scored")).alias("unscored"), *metrics.columns[3:])


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


def unscored_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11's list of what the averages leave out: requirements that no label of a slice's passes scores at any commit of a run."""
    runs = table(spark, sf_dir, "retrieval").select("repositoryCommit", "configurationId").dropna().select("repositoryCommit").distinct()
    labels = F.explode(F.array(*map(F.lit, evaluation.LABEL_PASSES))).alias("labels")
    truth = _labels(spark, sf_dir).filter("relationship = 'implements'").join(runs, "repositoryCommit", "left_semi")
    truth = truth.select("requirementId", F.explode(evaluation.label_slices(F.col("labelPass"))).alias("labels")).distinct()
    open_ = _requirements(spark, sf_dir).select("requirementId", "difficulty", labels).join(truth, ["requirementId", "labels"], "left_anti")
    return open_.select("requirementId", F.explode(evaluation.pass_strata(F.col("labels"), F.col("difficulty"))).alias("stratum"))


def config_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare(_metrics(spark, sf_dir), "configurationId", "stratum", "recall_10")


def _pivoted(metrics: DataFrame) -> DataFrame:
    names = ["bm25f-v5", "hybrid-rrf-v1", "semantic-v2"]
    wide = metrics.groupBy("stratum").pivot("configurationId", names).agg(F.first("mrr"))
    return wide.select("stratum", *[F.col(f"`{n}`").alias(n.replace("-", "_")) for n in names])


def config_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pivoted(_metrics(spark, sf_dir))


def proposal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = review.latest_decisions(_log(spark, sf_dir)).withColumn("band", review.band(F.col("modelConfidence"), F.col("modelClassification")))
    known = _requirements(spark, sf_dir).select("requirementId", "difficulty")
    predicted = last.filter("modelClassification = 'implements' and band in ('suggest', 'review')").select("requirementId", F.col("proposedSymbolId").alias("symbolId"), "band").join(known, "requirementId")
    predicted = predicted.select("requirementId", "symbolId", F.explode(evaluation.proposal_strata(F.col("band"), F.col("difficulty"))).alias("stratum"))
    relevant = _labels(spark, sf_dir).filter("relationship = 'implements'").withColumn("labels", F.explode(evaluation.label_slices(F.col("labelPass")))).join(known, "requirementId")
    relevant = relevant.select("requirementId", "symbolId", F.explode(evaluation.proposal_label_strata(F.col("labels"), F.col("difficulty"))).alias("stratum"))
    found = evaluation.prediction_metrics(predicted, relevant, ["requirementId", "symbolId"], ["stratum"])
    scope = known.select("requirementId", F.explode(evaluation.proposal_strata(F.lit("suggest"), F.col("difficulty"))).alias("stratum"))
    labelled = relevant.select("requirementId", "stratum").distinct().withColumn("has", F.lit(1))
    sizes = scope.join(labelled, ["requirementId", "stratum"], "left").groupBy("stratum").agg(F.count(F.lit(1)).alias("requirements"), F.count(F.when(F.col("has").isNull(), 1)).alias("without_labels"))
    rows = sizes.join(found, "stratum", "left").fillna(0)
    return rows.select("stratum", "requirements", "without_labels", "predicted", "relevant", "true_positives", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# --- review, links, coverage --------------------------------------------------------------------------------------


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).withColumn("band", review.band(F.col("modelConfidence"), F.col("modelClassification")))
    return rows.groupBy("modelClassification", "band").agg(F.count(F.lit(1)).alias("n"))


def link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.accepted_links(_log(spark, sf_dir)).select("requirementId", "proposedSymbolId", "symbolId", "relationship")


def recorded_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.recorded_bands(_log(spark, sf_dir))


def review_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_statistics(_log(spark, sf_dir)).withColumn("override_rate", F.round("override_rate", 9))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that the decisions table names is a proposal; those with a row that is a decision are decided."""
    rows = table(spark, sf_dir, "decisions").select(_req(), ids.symbol_id(F.col("proposedSymbolId")).alias("symbolId"), "modelConfidence", "modelClassification").filter("requirementId is not null and symbolId is not null")
    proposals = rows.groupBy("requirementId", "symbolId").agg(F.max("modelConfidence").alias("confidence"), F.max("modelClassification").alias("classification"))
    stale = proposals.join(_known(spark, sf_dir), "symbolId", "left_anti")
    queue = review.review_queue(review.bucketed(proposals, review.recorded_bands(_log(spark, sf_dir))), stale)
    return queue.select("requirementId", "symbolId", "band", "stale")


def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("requirementId", "symbolId", "reviewer", "timestamp", "commit")


def link_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    sides = [links.adjacency(index, a, b).select(F.lit(n).alias("side"), F.col(a).alias("key"), F.col(b).alias("item")) for n, a, b in (("requirement", "requirementId", "symbolId"), ("symbol", "symbolId", "requirementId"))]
    return sides[0].unionByName(sides[1])


def unlinked_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.unlinked(_requirements(spark, sf_dir), _current_index(spark, sf_dir))


def reconcile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review.accepted_links(_log(spark, sf_dir)).withColumn("commit", F.col("repositoryCommit")).filter("symbolId is not null")
    return links.reconcile(links.link_index(log), _index(spark, sf_dir))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links resolved at the newest snapshots; the last run was at the snapshots before these."""
    index = _index(spark, sf_dir)
    seen = _symbols_at(spark, sf_dir, _before_newest(spark, sf_dir)).groupBy("symbolId").agg(F.max("repositoryCommit").alias("last"))
    previous = index.select("requirementId", "symbolId").join(seen, "symbolId")
    return links.resolve(index, _known(spark, sf_dir), previous, F.lit("now")).select("requirementId", "symbolId", "resolved", "last_resolved")


def _excluded(path: Column) -> Column:
    """The fixed directories, and two patterns as a project's settings would name them."""
    return exclusions.excluded_path(path, ["views/", "report/"])


def stale_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = _log(spark, sf_dir).select("requirementId", F.col("proposedSymbolId").alias("symbolId")).distinct()
    return links.proposal_staleness(proposals, _known(spark, sf_dir), _excluded)


def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _current_index(spark, sf_dir)
    broken = index.join(_known(spark, sf_dir), "symbolId", "left_anti")
    return links.coverage(_requirements(spark, sf_dir), index, broken)


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.coverage_summary(coverage_states(spark, sf_dir))


def drifted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshots.snapshot_changes(table(spark, sf_dir, "symbol_index"), table(spark, sf_dir, "commits"))
    return links.affected_links(_index(spark, sf_dir), changes)


def suspected_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, commits = table(spark, sf_dir, "symbol_index"), table(spark, sf_dir, "commits")
    changes = snapshots.snapshot_changes(symbols, commits)
    pairs = snapshots.snapshot_pairs(commits)
    # a renamed symbol carries its new name in its body
    source = F.replace(ids.canonical_space(F.col("normalizedSource")), F.col("name"), F.lit("_"))
    bodies = symbols.select("repositoryCommit", _sym(), F.when(source != "", F.md5(source)).alias("body")).filter("symbolId is not null").groupBy("repositoryCommit", "symbolId").agg(F.max("body").alias("body"))
    before = bodies.join(pairs.filter("later is not null"), "repositoryCommit").select(F.col("later").alias("repositoryCommit"), "symbolId", "body")
    return links.renames(changes.filter("change = 'removed'").join(before, ["repositoryCommit", "symbolId"]), changes.filter("change = 'added'").join(bodies, ["repositoryCommit", "symbolId"]))


def result_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = candidates.first_places(table(spark, sf_dir, "retrieval"), 5)
    keys = ["requirementId", "repositoryCommit"]
    first, second = (lists.filter(F.col("configurationId") == c).select(*keys, F.col("symbolId").alias("item"), F.col("place").alias("rank")) for c in ("bm25f-v5", "hybrid-rrf-v1"))
    return links.result_differences(first, second, keys)


# --- payloads, verdicts, usage ------------------------------------------------------------------------------------

LIST = candidates.LIST


def _clip_lengths(items: DataFrame) -> DataFrame:
    return items.select(*LIST, "rank", "symbolId", F.length("signature").alias("signature"), F.length("documentation").alias("documentation"), F.length("source").alias("source"))


def payload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = candidates.first_places(table(spark, sf_dir, "retrieval"), 5).withColumnRenamed("place", "rank")
    return _clip_lengths(payload.payload_items(lists, _corpus(spark, sf_dir), LIST, 3, strict=False))


def payload_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of the lexical run, with its units as delivered, judged against the lists of the semantic run, a k of 2 and a lower budget."""
    keys = ["requirementId", "repositoryCommit"]
    lists = materialize(candidates.first_places(table(spark, sf_dir, "retrieval"), 5).withColumnRenamed("place", "rank"), "lists")
    sent, judged = (lists.filter(F.col("configurationId") == c) for c in ("bm25f-v5", "semantic-v2"))
    items = payload.payload_items(sent, _corpus(spark, sf_dir), LIST, 3, strict=False)
    # one unit for each delivery of the requirement's document
    texts = table(spark, sf_dir, "requirements").select(ids.requirement_id(F.col("id")).alias("requirementId"), text.requirement_text(F.col("title"), F.col("statement"), F.col("acceptance_criteria")).alias("text"))
    units = sent.select(*keys).distinct().join(texts, "requirementId")
    found = payload.audit(items, judged, keys, 2, Budget(requirement=200, signature=60, documentation=120, source=300), units)
    return found.groupBy("rule").agg(F.sum("n").alias("n"))


def disclosure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of runs by commit: a run that embeds must log as many texts as its commit has symbols."""
    mode = F.when(F.col("configurationId").startswith("bm25f"), "lexical").when(F.col("configurationId").startswith("hybrid"), "hybrid").otherwise("semantic")
    runs = table(spark, sf_dir, "retrieval").select("configurationId", "repositoryCommit").dropna().distinct().withColumn("mode", mode)
    sizes = _corpus(spark, sf_dir).groupBy("repositoryCommit").agg(F.count(F.lit(1)).alias("embedded"))
    logs = runs.join(sizes, "repositoryCommit", "left").withColumn("logged_mode", F.col("mode"))
    return payload.audit_disclosure(logs, ["configurationId", "repositoryCommit"])


def verdict_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of the decision log: one body for each requirement, each row one verdict, as the log has them."""
    rows = table(spark, sf_dir, "decisions").filter("seq is not null and requirementId is not null")
    entry = F.struct("seq", F.to_json(F.struct(F.col("proposedSymbolId").alias("symbolId"), F.col("modelClassification").alias("classification"), F.col("modelConfidence").alias("confidence"), F.col("note").alias("rationale"))).alias("json"))
    bodies = rows.groupBy("requirementId").agg(F.array_sort(F.collect_set(entry)).alias("e"))
    bodies = bodies.select("requirementId", F.concat(F.lit('```json\n{"verdicts": ['), F.array_join("e.json", ","), F.lit("]}\n```")).alias("body"))
    candidates = rows.filter("proposedSymbolId is not null").groupBy("requirementId", F.col("proposedSymbolId").alias("symbolId")).agg(F.min("seq").alias("rank"))
    proposals, failures = payload.verdicts(bodies, candidates, ["requirementId"])
    return failures.groupBy("scope", "rule").agg(F.count(F.lit(1)).alias("n")).unionByName(proposals.agg(F.count(F.lit(1)).alias("n")).select(F.lit("entry").alias("scope"), F.lit("proposal").alias("rule"), "n"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select(
        ids.requirement_id(F.col("requirement_id")).alias("requirementId"), F.coalesce(text.estimate_tokens(F.col("text")), F.lit(0)).alias("inputTokens"), F.lit(60).cast("bigint").alias("outputTokens")
    )
    return payload.usage_totals(records)


# --- documents and identifiers ------------------------------------------------------------------------------------


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "requirements").select("path", ids.requirement_id(F.col("id")).alias("id"))
    return documents.shared_ids(rows).select(F.col("id").alias("requirementId"), "path", "n")


def overload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ids.base_symbol_id(F.col("relativePath"), F.col("qualifiedName"), F.col("kind"))
    rows = _corpus(spark, sf_dir).filter("relativePath is not null and qualifiedName is not null and kind is not null").withColumn("base", base)
    group = Window.partitionBy("repositoryCommit", "base")
    shared = F.count(F.lit(1)).over(group) > 1
    made = F.when(shared, F.concat("base", F.lit(":"), ids.digest(ids.canonical_space(F.col("signature")), 8))).otherwise(F.col("base"))
    return rows.select("repositoryCommit", "symbolId", made.alias("made"), shared.alias("overloaded"))


def wiki_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    found = docs.select("doc_id", F.explode(text.wiki_links(F.col("text"))).alias("target"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def wiki_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.explode(text.wiki_links(F.col("text"))).alias("target")).distinct()
    held = table(spark, sf_dir, "requirements").select("path", ids.requirement_id(F.col("id")).alias("requirementId")).filter("path is not null").distinct()
    return documents.resolve_wiki_links(docs, held)


def requirement_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source = 'requirements' and text is not null")
    parts = documents.split_frontmatter(docs, "text")
    return parts.select("doc_id", F.col("front").isNotNull().alias("has_front"), F.length(text.section(F.col("body"), "Statement")).alias("statement"), F.length(text.section(F.col("body"), "Rationale")).alias("rationale"))


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).groupBy("repositoryCommit", "kind").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("relativePath").alias("files"))


def extracted_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the source files among the documents; each document is a file of its own."""
    files = table(spark, sf_dir, "documents").filter("source = 'source-code' and text is not null")
    files = files.select(F.concat(F.lit("src/doc-"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.col("text").alias("content"))
    found = extractor.extract_symbols(spread(files), "documents")
    return found.select("symbolId", "kind", "qualifiedName", "startLine", "endLine", "signature", "exported")


def symbol_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).select(ids.symbol_path(F.col("symbolId")).alias("path"))
    return rows.groupBy("path", F.coalesce(_excluded(F.col("path")), F.lit(False)).alias("excluded")).agg(F.count(F.lit(1)).alias("symbols"))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, folded_terms, protected_stopwords, term_stats, field_lengths, bm25f_topk, bm25f_v4_topk, bm25f_v3_topk, span_containment, cosine_topk, embedding_texts, rrf_fusion,
        weighted_fusion, retrieval_metrics, unscored_requirements, config_comparison, config_pivot, proposal_metrics, band_counts, link_state, recorded_bands, review_statistics, review_queue, link_index, link_adjacency,
        unlinked_requirements, reconcile_links, resolved_links, stale_proposals, coverage_states, coverage_summary, drifted_links, suspected_renames, result_differences, payload_items, payload_audit, disclosure_audit,
        verdict_failures, usage_totals, duplicate_ids, overload_ids, wiki_backlinks, wiki_resolution, requirement_sections, symbol_counts, symbol_paths, extracted_symbols,
    )
}
