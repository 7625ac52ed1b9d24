"""Field-weighted BM25 retrieval over the distinct texts of a corpus.

Documents whose texts are equal have equal terms, so a text is tokenized and scored once, whatever the number of its
documents. A pseudo frequency of a term is the sum over its occurrences of weight / length norm. Queries go to the
tasks that hold the texts, and only the best of a task leave it: pairs of a query and a document are never rows.
Scores are rounded to nine digits for ranking, as sums have no fixed order on a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.config import LEXICAL_V5, LexicalConfig
from linkloom.functions import ids, text
from linkloom.session import default_partitions, materialize

#: terms of queries that go to every task at once, more take several passes; texts that are scored at once there
ASKED_TERMS, TEXT_BLOCK = 1 << 20, 32_768
#: queries that are worth a reading of all texts
DEALT_QUERIES = 2_048
#: groups of 24 bytes that are broadcast at most
WANTED = 1 << 18
#: spans of a file that one task holds
FILE_SPANS = 1 << 18
#: more than a score changes by rounding and by the order of its sum
SLACK = 2e-9


def _contents(config: LexicalConfig) -> list[Column]:
    """The texts of the fields in the order of the configuration's weights."""
    parts = {
        "name": F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("qualifiedName", F.lit(""))),
        "signature": F.col("signature"), "documentation": F.col("documentation"), "path": F.col("relativePath"), "source": F.col("normalizedSource"),
    }
    return [F.coalesce(parts[k], F.lit("")) for k in config.weights]


def field_texts(symbols: DataFrame, config: LexicalConfig = LEXICAL_V5) -> DataFrame:
    """One row per document and field: the columns of ``symbols``' key, field, weight, content."""
    rows = [F.struct(F.lit(k).alias("field"), F.lit(float(w)).alias("weight"), c.alias("content")) for (k, w), c in zip(config.weights.items(), _contents(config))]
    return symbols.select("doc", F.explode(F.array(*rows)).alias("f")).select("doc", "f.*")


def effective_stopwords(symbols: DataFrame, config: LexicalConfig = LEXICAL_V5) -> list[str]:
    """The stopwords that name no part of an identifier, raw or folded; bounded by the list itself."""
    if not config.protect_identifiers or not config.stopwords:
        return list(config.stopwords)
    names = symbols.select(F.concat_ws(" ", "name", "qualifiedName").alias("names")).distinct().repartition(_tasks(symbols))
    seen = names.select(F.explode(text.tokens(F.col("names"))).alias("t")).distinct()
    if config.fold_plurals:
        seen = seen.select(F.explode(F.array("t", text.fold_plural(F.col("t"), config.plural_revision))).alias("t"))
    used = {r["t"] for r in seen.filter(F.col("t").isin(list(config.stopwords))).distinct().collect()}
    return [w for w in config.stopwords if w not in used]


def _tasks(df: DataFrame) -> int:
    """Partitions for rows that cost much more to work on than to move."""
    return max(default_partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)


def _terms(value: Column, stopwords: list[str], config: LexicalConfig) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else None
    return text.terms(value, stop, config.fold_plurals, config.plural_revision)


def occurrences(symbols: DataFrame, stopwords: list[str], config: LexicalConfig = LEXICAL_V5) -> DataFrame:
    """doc, field, weight, terms, length (number of terms of the field in the document)."""
    rows = field_texts(symbols, config).withColumn("terms", _terms(F.col("content"), stopwords, config)).drop("content")
    return rows.withColumn("length", F.size("terms"))


def field_lengths(rows: DataFrame) -> DataFrame:
    """field and average_length over the documents in which the field is not empty."""
    return rows.groupBy("field").agg(F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("average_length"))


def term_statistics(rows: DataFrame, documents: int) -> DataFrame:
    """term, df (documents with the term in any field) and idf over all documents."""
    pairs = rows.select("doc", F.explode("terms").alias("term")).distinct()
    df = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def contained_counts(spans: DataFrame) -> DataFrame:
    """doc and inner: how many strictly shorter spans of the same path lie within its span.

    ``spans`` has doc, path, start and end; spans with a null path, start or end, or with an end below 0, contain none
    and lie in none. The spans of a path are never paired: each end is entered into the nodes of a binary tree over line
    numbers, a span asks the few nodes that make up all ends up to its own, and one running count by start for each
    node answers. That is n log n rows for n spans, and windows that hold no rows.
    """
    fit = F.col("path").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= 0)
    held = spans.filter(fit).groupBy("path", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    top = held.agg(F.max("end").alias("top")).first()["top"] or 0
    levels = int(top + 1).bit_length()
    node = lambda level, number: F.struct(level.alias("level"), number.alias("number"))
    every = F.sequence(F.lit(0), F.lit(levels - 1))
    entered = held.select("path", "start", "end", "n", F.lit(0).alias("asks"), F.explode(F.transform(every, lambda l: node(l, F.call_function("shiftright", F.col("end"), l)))).alias("node"))
    reach = F.col("end") + 1
    set_bits = F.filter(every, lambda l: F.call_function("shiftright", reach, l) % 2 == 1)
    asked = held.select("path", "start", "end", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("asks"), F.explode(F.transform(set_bits, lambda l: node(l, F.call_function("shiftright", reach, l) - 1))).alias("node"))
    so_far = Window.partitionBy("path", "node.level", "node.number").orderBy(F.desc("start"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = entered.unionByName(asked).withColumn("met", F.sum("n").over(so_far)).filter("asks = 1").groupBy("path", "start", "end").agg(F.sum("met").alias("met"))
    # of the spans within one, those as long as it are the equal ones
    inner = counted.join(held, ["path", "start", "end"]).select("path", "start", "end", (F.col("met") - F.col("n")).alias("inner"))
    return spans.select("doc", "path", "start", "end").join(inner, ["path", "start", "end"], "left").select("doc", F.coalesce("inner", F.lit(0)).alias("inner"))


def bm25f(queries: DataFrame, symbols: DataFrame, k: int = 10, config: LexicalConfig = LEXICAL_V5) -> DataFrame:
    """The ``k`` best documents of every query: query, rank, doc, score.

    ``queries`` has query and text, ``symbols`` doc and the columns of the symbol index. Only scores above zero
    count; ties are settled by doc in byte order. Queries without a term of the corpus give no rows.

    Documents of one text and one prior have one score. Such a group stands for its first document: the ``k`` best
    documents lie in the ``k`` best groups, as the first documents of these go before all of any other group.
    """
    stop = effective_stopwords(symbols, config)
    contents = _contents(config)
    parts = [f"c{i}" for i in range(len(contents))]
    # lengths before the texts: no two lists of texts look alike
    told = [*[F.length(c) for c in contents], *contents]
    alone = config.containment is None  # a prior of the kind alone goes with the texts: one pass takes all
    form = F.unhex(ids.digest(F.concat_ws(" ", *[_kind_prior(config).cast("string")] * alone, *told), 32)).alias("form")
    docs = _priors(symbols.select("*", form), config).filter("doc is not null")
    if alone:
        rows = symbols.filter("doc is not null").select("doc", form, _kind_prior(config).alias("prior"), *[c.alias(n) for c, n in zip(contents, parts)])
        rows = rows.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("prior", *parts)])
        rows = rows.withColumn("groups", F.array(F.struct("prior", "doc")))
    else:
        groups = docs.groupBy("form", "prior").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
        groups = groups.groupBy("form").agg(F.sum("n").alias("n"), F.collect_list(F.struct("prior", "doc")).alias("groups"))
        rows = symbols.select(form, *[c.alias(n) for c, n in zip(contents, parts)]).dropDuplicates(["form"]).join(groups, "form")
    rows = rows.select("form", F.array(*[text.words(F.col(c)) for c in parts]).alias("terms"), "n", "groups")
    forms = materialize(_with_terms(rows, stop, config), "forms")  # tokens are made once

    sizes = [F.size(F.col("terms")[i]) for i in range(len(contents))]
    held = [(F.sum(F.when(n > 0, n * F.col("n"))) / F.sum(F.when(n > 0, F.col("n")))).alias(c) for c, n in zip(parts, sizes)]
    *held, named = forms.agg(*held, F.sum("n")).first()
    documents = (named or 0) + symbols.filter("doc is null").count()
    averages = [a or 1.0 for a in held]  # a field without terms has none to weigh
    asked = queries.select("query", F.explode(_terms(F.col("text"), stop, config)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = materialize(asked, "asked")
    met = forms.select("n", F.explode(F.array_distinct(F.flatten("terms"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = met.groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = materialize(asked.join(df, "term").select("query", "term", (F.col("qtf") * idf * (config.k1 + 1)).alias("weight")), "weights")

    passes = -(-asked.count() // ASKED_TERMS)
    if not passes:
        return queries.select("query", F.lit(0).alias("rank"), F.lit("").alias("doc"), F.lit(0.0).alias("score")).limit(0)
    part = F.pmod(F.xxhash64("query"), F.lit(passes))
    best = reduce(DataFrame.unionByName, [_best_groups(forms, asked.filter(part == i), averages, k, config) for i in range(passes)])
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query", "form", "prior", "score")
    best = materialize(best, "top")
    wanted = materialize(best.select("form", "prior").distinct(), "wanted")
    if wanted.count() <= WANTED:  # else all documents are shuffled for the few that are asked for
        wanted = F.broadcast(wanted)
    # a group may have any number of documents, so the first of each are taken before queries meet them
    members = docs.select("form", "prior", "doc").join(wanted, ["form", "prior"], "left_semi")
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("form", "prior").orderBy("doc"))).filter(F.col("place") <= k).drop("place")
    scored = best.join(members, ["form", "prior"]).withColumn("rank", F.row_number().over(order))
    return scored.filter(F.col("rank") <= k).select("query", "rank", "doc", "score")


def _with_terms(forms: DataFrame, stopwords: list[str], config: LexicalConfig) -> DataFrame:
    """``forms`` with the terms of its texts: those of :func:`text.terms`, made of what :func:`text.words` gives of each.

    A word is looked at once a batch, however often it is there.
    """
    dropped, fold, revision = {"", *stopwords}, config.fold_plurals, config.plural_revision
    place = forms.columns.index("terms")
    schema = T.StructType([T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType()))) if f.name == "terms" else f for f in forms.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch["terms"].flatten(), " ")
            found = parts.flatten().dictionary_encode()
            words = found.dictionary.to_pylist()
            kept = np.array([w not in dropped for w in words], bool)
            terms = pa.array([text.folded(w, revision) for w in words] if fold else words, pa.string())
            at = np.asarray(found.indices)
            stay = kept[at]
            ends = np.append(0, np.cumsum(stay))[np.asarray(parts.offsets)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.take(pa.array(at[stay])))
            fields = np.append(0, np.cumsum(np.asarray(pc.list_value_length(batch["terms"]))))
            yield batch.set_column(place, "terms", pa.ListArray.from_arrays(pa.array(fields, pa.int32()), lists))

    return forms.mapInArrow(run, schema)


def _priors(symbols: DataFrame, config: LexicalConfig) -> DataFrame:
    """doc, form and prior: by the kind, less by the spans within a document where the configuration counts them."""
    rows = symbols.select("doc", "form", _kind_prior(config).alias("prior"), "relativePath", F.col("startLine").alias("start"), F.col("endLine").alias("end"), *(["scope"] if "scope" in symbols.columns else []))
    if config.containment is None:
        return rows.select("doc", "form", "prior")
    path = F.when(F.col("relativePath").isNotNull(), F.concat_ws("\u0001", "scope", "relativePath")) if "scope" in symbols.columns else F.col("relativePath")
    rows = rows.select("doc", "form", "prior", path.alias("path"), "start", "end")
    lowered = (F.col("prior") / (1 + config.containment * F.coalesce("inner", F.lit(0)))).alias("prior")
    return materialize(_with_inner(rows).select("doc", "form", lowered), "priors")


def _with_inner(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, path, start, end and others) with inner, as :func:`contained_counts` counts.

    A row is shuffled once, to the task that holds its file. Files of more than FILE_SPANS spans are counted there.
    """
    fit = F.coalesce(F.col("path").isNotNull() & F.col("start").isNotNull() & (F.col("end") >= 0), F.lit(False))
    none = rows.filter(~fit).withColumn("inner", F.lit(0).cast("bigint"))
    held = rows.filter(fit)
    large = materialize(held.groupBy("path").count().filter(F.col("count") > FILE_SPANS).select("path"), "large")
    if not large.isEmpty():
        apart = held.join(large, "path", "left_semi")
        held = held.join(large, "path", "left_anti")
        none = none.unionByName(apart.join(contained_counts(apart), "doc"))
    sorted_ = held.repartition("path").sortWithinPartitions("path")
    schema = T.StructType([*held.schema, T.StructField("inner", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # rows of the last file so far
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch["path"][-1]
            if kept and not last.equals(kept[0]["path"][0]) or not batch["path"][0].equals(last):
                table = pa.Table.from_batches([*kept, batch]).combine_chunks()
                cut = pc.index(table["path"], last).as_py()
                yield from _counted(table.slice(0, cut)).to_batches()
                kept = table.slice(cut).to_batches()
            else:
                kept.append(batch)
        if kept:
            yield from _counted(pa.Table.from_batches(kept)).to_batches()

    return sorted_.mapInArrow(run, schema).unionByName(none)


def _counted(table: pa.Table) -> pa.Table:
    """``table`` of whole files with inner: spans that start no earlier and end no later, equal ones apart.

    By descending start and ascending end, these are the earlier rows of a lower order by end and descending start.
    They are counted by the bits of that order: where two rows first differ, the lower one counts for the higher.
    """
    file = np.asarray(table["path"].combine_chunks().dictionary_encode().indices).astype(np.int64)
    start, end = (table[c].to_numpy().astype(np.int64) for c in ("start", "end"))
    inner = np.zeros(len(file), np.int64)
    if len(file):
        order = np.lexsort((-start, end, file))
        new = np.append(True, (np.diff(file[order]) != 0) | (np.diff(start[order]) != 0) | (np.diff(end[order]) != 0))
        number = np.cumsum(new) - 1
        begun = np.append(True, np.diff(file[order]) != 0)
        rank = np.empty(len(file), np.int64)
        rank[order] = number - number[np.flatnonzero(begun)[np.cumsum(begun) - 1]]
        at = np.lexsort((end, -start, file))
        for bit in range(int(rank.max()).bit_length()):
            width = int(rank.max() >> bit) // 2 + 1
            group = file[at] * width + (rank[at] >> bit >> 1)
            rows = at[np.argsort(group, kind="stable")]
            group = file[rows] * width + (rank[rows] >> bit >> 1)
            high = (rank[rows] >> bit & 1).astype(bool)
            low = np.cumsum(~high)
            first = np.flatnonzero(np.append(True, np.diff(group) != 0))
            before = (low - ~high)[first]  # lower rows of the groups before
            met = low - np.repeat(before, np.diff(np.append(first, len(rows))))
            inner[rows[high]] += met[high]
    return table.append_column("inner", pa.array(inner))


def _best_groups(forms: DataFrame, asked: DataFrame, averages: list[float], k: int, config: LexicalConfig) -> DataFrame:
    """query, form, prior, doc and score of the ``k`` best groups of each part of ``forms``.

    ``asked`` has query, term and weight, and goes to every task; ``forms`` has form, terms (a list for each field) and
    groups (prior and first doc). Each task takes TEXT_BLOCK texts at a time and keeps the best so far. Few queries are
    asked of each partition of ``forms``. Many are dealt to the tasks, which read all texts or a few parts of them, as
    the best of every part are written.
    """
    rows = asked.toArrow().sort_by([("query", "ascending"), ("term", "ascending")])
    names, words = (rows[c].combine_chunks().dictionary_encode() for c in ("query", "term"))
    number = np.asarray(names.indices.fill_null(len(names.dictionary)))  # a null name is one query too
    ends = np.append(np.flatnonzero(np.diff(number)) + 1, len(number))
    named = pc.take(rows["query"].combine_chunks(), pa.array(ends - 1))
    spark = asked.sparkSession
    sent = spark.sparkContext.broadcast((named, words.dictionary, np.asarray(words.indices), np.asarray(rows["weight"]), ends))
    tasks = 2 * spark.sparkContext.defaultParallelism
    dealt = min(tasks, -(-len(ends) // DEALT_QUERIES))
    schema = T.StructType([asked.schema["query"], forms.schema["form"], T.StructField("prior", T.DoubleType()), T.StructField("doc", T.StringType()), T.StructField("score", T.DoubleType())])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, word, share = _shares(batch["terms"], sent.value[1], averages, config)
            ends = pa.array(np.append(0, np.cumsum(each)), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((word, pa.int32()), (share, pa.float64())))
            made = pa.RecordBatch.from_arrays([batch["form"], *lists, batch["groups"]], ["form", "words", "shares", "groups"])
            yield made.filter(pa.array(each > 0))

    def run(batches: Iterator[pa.RecordBatch], every: int = 1, at: int = 0) -> Iterator[pa.RecordBatch]:
        named, vocabulary, words, weights, ends = sent.value
        starts = np.append(0, ends[:-1])
        least = np.zeros(len(ends))  # the score of the last of k
        best = None
        for block in _blocks(batches):
            ptr, texts, parts = _postings(block["words"], block["shares"], len(vocabulary))
            of = np.asarray(pc.list_value_length(block["groups"]))
            first = np.append(0, np.cumsum(of))[:-1]
            groups = block["groups"].flatten()
            prior, doc = np.asarray(groups.field("prior")), groups.field("doc")
            most = np.maximum.reduceat(prior, first)
            place = np.empty(len(doc), np.int64)
            place[np.asarray(pc.sort_indices(doc))] = np.arange(len(doc))
            found = []
            for q in range(at, len(ends), every):
                start, end = starts[q], ends[q]
                held = [slice(ptr[word], ptr[word + 1]) for word in words[start:end]]
                shares = [weight * parts[at] for weight, at in zip(weights[start:end], held)]
                raw = np.bincount(np.concatenate([texts[at] for at in held]), np.concatenate(shares), len(of))
                bound = raw * most
                hits = np.flatnonzero(bound >= least[q] - SLACK if least[q] > SLACK else bound > 0)
                if len(hits) > 4 * k:
                    top = bound[hits]
                    hits = hits[top >= np.partition(top, len(top) - k)[len(top) - k] - SLACK]
                each = of[hits]
                own = np.repeat(first[hits] - np.cumsum(each) + each, each) + np.arange(each.sum())
                score = np.round(np.repeat(raw[hits], each) * prior[own], 9)
                keep = np.flatnonzero((score > 0) & (score >= least[q]))
                keep = keep[np.lexsort((place[own[keep]], -score[keep]))[:k]]
                if len(keep):
                    found.append((np.full(len(keep), q), own[keep], score[keep]))
            if found:
                number, own, score = (np.concatenate(x) for x in zip(*found))
                text_of = np.repeat(np.arange(len(of)), of)
                new = pa.table({"number": number, "form": block["form"].take(pa.array(text_of[own])), "prior": prior[own], "doc": doc.take(pa.array(own)), "score": score})
                best = new if best is None else pa.concat_tables([best, new])
                best = best.sort_by([("number", "ascending"), ("score", "descending"), ("doc", "ascending")])
                number = best["number"].to_numpy()
                rank = np.arange(len(number)) - np.searchsorted(number, number)
                best = best.filter(pa.array(rank < k)).combine_chunks()
                last = rank == k - 1
                least[number[last]] = np.asarray(best["score"])[rank[rank < k] == k - 1]
        if best is not None:
            columns = [pc.take(named, best["number"]), *[best[c] for c in ("form", "prior", "doc", "score")]]
            yield from pa.table(columns, names=["query", "form", "prior", "doc", "score"]).to_batches()

    if dealt <= 1:
        made = materialize(forms.mapInArrow(lambda batches: run(met(batches)), schema), "best")
    else:
        lists = [T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
        held = materialize(forms.mapInArrow(met, T.StructType([forms.schema["form"], *lists, forms.schema["groups"]])), "shares")
        # one more part for the first: a union of single partitions would run as one task
        parts = [held.coalesce(-(-tasks // dealt) + (at == 0)) for at in range(dealt)]
        made = [rows.mapInArrow(lambda batches, at=at: run(batches, dealt, at), schema) for at, rows in enumerate(parts)]
        made = materialize(reduce(DataFrame.unionByName, made), "best")
    sent.destroy()
    return made


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """The columns of at least TEXT_BLOCK rows at a time, the last ones apart."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept += [batch] * bool(batch.num_rows)
        if sum(b.num_rows for b in kept) >= TEXT_BLOCK:
            yield {c: pa.concat_arrays([b.column(c) for b in kept]) for c in ("form", "words", "shares", "groups")}
            kept = []
    if kept:
        yield {c: pa.concat_arrays([b.column(c) for b in kept]) for c in ("form", "words", "shares", "groups")}


def _shares(terms: pa.ListArray, vocabulary: pa.Array, averages: list[float], config: LexicalConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words of the vocabulary each text has, and one text after the other these words and their saturated pseudo frequencies."""
    fields = terms.flatten()
    length = np.asarray(pc.list_value_length(fields))
    weight = np.tile(np.array(list(config.weights.values()), float), len(terms))
    share = weight / (1 - config.b + config.b * length / np.tile(averages, len(terms)))
    word = np.asarray(pc.index_in(fields.flatten(), value_set=vocabulary).fill_null(-1)).astype(np.int64)
    field = np.repeat(np.arange(len(fields)), length)[word >= 0]
    key, place = np.unique(field // len(config.weights) * len(vocabulary) + word[word >= 0], return_inverse=True)
    p = np.bincount(place, share[field], len(key))
    return np.bincount(key // len(vocabulary), minlength=len(terms)), key % len(vocabulary), p / (config.k1 + p)


def _postings(words: pa.ListArray, shares: pa.ListArray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and their shares by word of the vocabulary, and where those of each word begin."""
    word = np.asarray(words.flatten())
    order = np.argsort(word, kind="stable")
    text_of = np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(words)))
    return np.append(0, np.cumsum(np.bincount(word, minlength=vocabulary))), text_of[order], np.asarray(shares.flatten())[order]


def _kind_prior(config: LexicalConfig) -> Column:
    prior = F.lit(1.0)
    for kind, weight in config.kind_weights.items():
        prior = F.when(F.col("kind") == kind, F.lit(float(weight))).otherwise(prior)
    return prior
