"""Bounded payloads for review, their audit, the parsing of verdicts, and usage totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.config import CLASSIFICATIONS, Budget
from linkloom.functions import text
from linkloom.functions.ids import outer_trim


def payload_items(candidates: DataFrame, symbols: DataFrame, keys: list[str], k: int, budget: Budget = Budget(), strict: bool = True) -> DataFrame:
    """The first ``k`` candidates of each list with clipped texts of their symbols.

    ``candidates`` has ``keys``, symbolId and rank, ``symbols`` the symbol index, joined on symbolId and such of the
    keys as it has. A candidate without a symbol is an error, or left out where ``strict`` is false.
    """
    on = [c for c in keys if c in symbols.columns] + ["symbolId"]
    best = candidates.filter(F.col("rank") <= k)
    held = symbols.dropDuplicates(on).select(*on, "kind", "qualifiedName", "relativePath", "startLine", "endLine", "signature", "documentation", "normalizedSource", F.lit(True).alias("__known"))
    rows = best.join(held, on, "left" if strict else "inner")
    if strict:
        rows = rows.filter(F.coalesce("__known", F.raise_error(F.concat(F.lit("candidate is not in the index: "), "symbolId")).cast("boolean")))
    return rows.select(
        *keys, "rank", "symbolId", "kind", "qualifiedName", "relativePath", "startLine", "endLine", text.clip(F.col("signature"), budget.signature).alias("signature"),
        text.clip(F.col("documentation"), budget.documentation).alias("documentation"), text.clip(F.col("normalizedSource"), budget.source).alias("source"),
    )


def audit(items: DataFrame, candidates: DataFrame, keys: list[str], k: int, budget: Budget = Budget(), units: DataFrame | None = None) -> DataFrame:
    """Violations of a payload against the retrieved lists: keys, symbolId, rule, n (how often).

    ``units`` has the keys and text, one row for each unit that was sent; without it the units are the lists of
    ``items``. Rules: unknown-list, missing-list, duplicate-requirement (n repetitions), excess-items, duplicate-item,
    unretrieved-item, oversized-field (n fields). A missing list breaks no bound; null texts are empty.
    """
    none, once = F.lit(None).cast("string").alias("symbolId"), F.lit(1).cast("bigint")
    sent_units = items.select(*keys) if units is None else units.select(*keys)
    sent = sent_units.distinct()
    retrieved = candidates.select(*keys).distinct()
    rule = lambda df, name, symbol=none, n=once: df.select(*keys, symbol, F.lit(name).alias("rule"), n.cast("bigint").alias("n"))
    over = lambda c, limit: F.coalesce((F.length(c) > limit + 1).cast("int"), F.lit(0))  # noqa: E731  one more for the mark of a clipped text
    fields = over("signature", budget.signature) + over("documentation", budget.documentation) + over("source", budget.source)
    found = [
        rule(sent.join(retrieved, keys, "left_anti"), "unknown-list"),
        rule(retrieved.join(sent, keys, "left_anti"), "missing-list"),
        rule(items.groupBy(*keys).count().filter(F.col("count") > k), "excess-items"),
        rule(items.groupBy(*keys, "symbolId").count().filter("count > 1"), "duplicate-item", F.col("symbolId"), F.col("count") - 1),
        rule(items.join(retrieved, keys, "left_semi").join(candidates.select(*keys, "symbolId").distinct(), [*keys, "symbolId"], "left_anti"), "unretrieved-item", F.col("symbolId")),
        rule(items.withColumn("over", fields).filter("over > 0"), "oversized-field", F.col("symbolId"), F.col("over")),
    ]
    if units is not None:
        found.append(rule(units.groupBy(*keys).count().filter("count > 1"), "duplicate-requirement", n=F.col("count") - 1))
        found.append(rule(units.filter(over("text", budget.requirement) > 0), "oversized-field"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def audit_disclosure(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether logs say what retrieval itself sent: keys and rule for every fault.

    ``logs`` has the keys, mode (of the run, null where unknown), logged_mode and embedded (texts that the log says
    were embedded, null for no entry). Semantic and hybrid runs embed the whole corpus, lexical ones nothing. Rules:
    mode-mismatch, undisclosed-embedding, unexpected-embedding.
    """
    embeds = F.col("logged_mode").isin("semantic", "hybrid")
    rules = F.array(
        F.when(F.col("mode").isNotNull() & ~F.col("mode").eqNullSafe(F.col("logged_mode")), "mode-mismatch"),
        F.when(embeds & F.col("embedded").isNull(), "undisclosed-embedding"),
        F.when(~F.coalesce(embeds, F.lit(False)) & F.col("embedded").isNotNull(), "unexpected-embedding"),
    )
    return logs.select(*keys, F.explode(F.array_compact(rules)).alias("rule"))


def tallies(items: DataFrame, candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One row: lists and items sent, items permitted (at most ``k`` of each retrieved list)."""
    sent = items.agg(F.count(F.lit(1)).alias("items"), F.countDistinct(F.struct(*keys)).alias("lists"))
    permitted = candidates.groupBy(*keys).count().agg(F.coalesce(F.sum(F.least("count", F.lit(k))), F.lit(0)).alias("permitted"))
    return sent.join(F.broadcast(permitted))  # one row each


def prompts(requirements: DataFrame, items: DataFrame, keys: list[str], heading: str, closing: str, budget: Budget = Budget()) -> DataFrame:
    """keys and prompt: the requirement's text, clipped to its budget, then every item by rank in labelled lines."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    body = F.concat_ws("\n", F.concat(F.lit("symbolId: "), "symbolId"), line("kind: ", F.col("kind")), line("name: ", F.col("qualifiedName")), line("signature: ", F.col("signature")), line("documentation: ", F.col("documentation")), line("source:\n", F.col("source")))
    lists = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("body")))).alias("parts"))
    numbered = F.transform("parts", lambda p, i: F.concat(F.lit("### Candidate "), (i + 1).cast("string"), F.lit("\n"), p["body"]))
    return requirements.join(lists, keys).select(*keys, F.concat_ws("\n\n", F.lit(heading), text.clip(F.col("text"), budget.requirement), F.array_join(numbered, "\n\n"), F.lit(closing)).alias("prompt"))


def verdicts(responses: DataFrame, candidates: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Proposals and failures of model answers.

    ``responses`` has the keys and body, ``candidates`` the keys, symbolId and rank. A body is JSON, fenced or not, with
    an array ``verdicts``. Rules for the whole: invalid-json, schema-mismatch; for an entry, in this order:
    schema-mismatch, unknown-symbol, duplicate-symbol (on the first mention, whether or not that one failed),
    unknown-classification, confidence-out-of-range (text is no number), empty-rationale; missing-verdict for
    candidates that no entry mentions.
    """
    parsed = responses.select(*keys, F.try_parse_json(text.strip_fence(F.col("body"))).alias("v"))
    listed = parsed.withColumn("list", F.try_variant_get("v", "$.verdicts", "array<variant>"))
    is_object = F.schema_of_variant("v").startswith("OBJECT") & F.schema_of_variant(F.try_variant_get("v", "$.verdicts", "variant")).startswith("ARRAY")
    whole = F.when(F.col("v").isNull(), "invalid-json").when(~F.coalesce(is_object, F.lit(False)), "schema-mismatch")
    listed = listed.withColumn("whole", whole)
    bad = listed.filter("whole is not null").select(*keys, F.lit(None).cast("string").alias("symbolId"), F.lit("response").alias("scope"), F.col("whole").alias("rule"))
    entries = listed.filter("whole is null").select(*keys, F.posexplode("list").alias("pos", "e"))
    part = lambda name, kind: F.try_variant_get("e", f"$.{name}", kind)
    kind_of = lambda name: F.coalesce(F.schema_of_variant(part(name, "variant")), F.lit(""))
    number = kind_of("confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    read = entries.select(
        *keys, "pos", F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False)).alias("object"),
        F.when(kind_of("symbolId") == "STRING", part("symbolId", "string")).alias("symbolId"), F.when(kind_of("classification") == "STRING", part("classification", "string")).alias("classification"),
        F.when(number, part("confidence", "double")).alias("confidence"), F.when(kind_of("rationale") == "STRING", outer_trim(part("rationale", "string"))).alias("rationale"),
    )
    held = candidates.select(*keys, "symbolId", "rank").dropDuplicates([*keys, "symbolId"])
    nth = F.row_number().over(Window.partitionBy(*keys, "symbolId").orderBy("pos"))
    rows = read.join(held, [*keys, "symbolId"], "left").withColumn("nth", nth)
    rule: Column = (
        F.when(~F.col("object") | F.col("symbolId").isNull() | (F.col("symbolId") == ""), "schema-mismatch")
        .when(F.col("rank").isNull(), "unknown-symbol")
        .when(F.col("nth") > 1, "duplicate-symbol")
        .when(F.col("classification").isNull() | ~F.col("classification").isin(*CLASSIFICATIONS), "unknown-classification")
        .when(F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence-out-of-range")
        .when(F.coalesce("rationale", F.lit("")) == "", "empty-rationale")
    )
    judged = rows.withColumn("rule", rule)
    proposals = judged.filter("rule is null").select(*keys, "symbolId", "rank", "classification", "confidence", "rationale")
    wrong = judged.filter("rule is not null").select(*keys, F.when(F.col("rule") != "schema-mismatch", F.col("symbolId")).alias("symbolId"), F.lit("entry").alias("scope"), "rule")
    answered = listed.filter("whole is null").select(*keys).distinct()
    silent = held.join(answered, keys, "left_semi").join(read.select(*keys, "symbolId").dropna(subset=["symbolId"]).distinct(), [*keys, "symbolId"], "left_anti")
    return proposals, bad.unionByName(wrong).unionByName(silent.select(*keys, "symbolId", F.lit("entry").alias("scope"), F.lit("missing-verdict").alias("rule")))


def usage_totals(records: DataFrame) -> DataFrame:
    """calls, input_tokens, output_tokens for the whole run (requirementId null, whole true) and for each requirement.

    Records without a requirement count for the run only.
    """
    totals = [F.count(F.lit(1)).alias("calls"), F.sum("inputTokens").alias("input_tokens"), F.sum("outputTokens").alias("output_tokens")]
    sums = records.groupingSets([[], ["requirementId"]], "requirementId").agg(*totals, F.grouping_id().alias("g"))
    return sums.filter((F.col("g") == 1) | F.col("requirementId").isNotNull()).select("requirementId", (F.col("g") == 1).alias("whole"), "calls", "input_tokens", "output_tokens")
