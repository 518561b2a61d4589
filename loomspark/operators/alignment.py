"""Chunks against outcomes, weeks, sources and what was taught before: resolution, coverage, provenance."""

from __future__ import annotations

import json
from bisect import insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions import text as T
from loomspark.operators.joins import small, tfidf_links
from loomspark.session import materialize

# Tags of procedure, which are no concepts to build on.
PROCEDURAL_TAGS = ["initial-post", "replies", "due"]
#: Mentions of a concept in a course that one task takes, about.
MENTIONS_PER_PART = 100_000
#: Thresholds of provenance: a primary source, one beside the best, a contributing one; and how many of each.
PRIMARY, NEAR_BEST, CONTRIBUTING, MOST_PRIMARY, MOST_CONTRIBUTING = 0.15, 0.8, 0.05, 2, 3


def outcomes_of_weeks(outcomes: DataFrame) -> DataFrame:
    """(course, week, lo, ...) of outcomes (course, lo, week_lo, week_hi, ...): one row for each week of the interval."""
    return outcomes.where("week_lo <= week_hi").withColumn("week", F.explode(F.sequence("week_lo", "week_hi")))


def match_by_week(chunks: DataFrame, outcomes: DataFrame, least: float = 0.15, most: int = 3) -> DataFrame:
    """(course, id, lo, how): the outcomes of each chunk.

    chunks (course, id, week, refs, text), outcomes (course, lo, week_lo, week_hi,
    statement). Refs that name an outcome of the course are kept (`literal`); a chunk
    without such refs gets the outcomes of its week by weighted terms (`similar`), and
    where none is similar enough the week's first outcome (`first`).
    """
    own = outcomes.select("course", F.lower("lo").alias("lo"), "week_lo", "week_hi", "statement")
    refs = chunks.select("course", "id", F.explode("refs").alias("r")).select("course", "id", F.lower("r").alias("lo")).distinct()
    literal = materialize(refs.join(small(own.select("course", "lo").distinct()), ["course", "lo"], "left_semi").select("course", "id", "lo"), "literal-refs")
    rest = chunks.join(literal.select("id").distinct(), "id", "left_anti").where("week is not null")
    weeks = materialize(outcomes_of_weeks(own), "outcome-weeks")
    texts = rest.select("course", "week", "id", T.tokenize(F.coalesce("text", F.lit(""))).alias("toks"))
    targets = weeks.select("course", "week", F.col("lo").alias("target"), T.tokenize(F.coalesce("statement", F.lit(""))).alias("toks"))
    similar = materialize(tfidf_links(texts, targets, ["course", "week"], least, most).select("course", "id", F.col("target").alias("lo")), "similar")
    first = weeks.groupBy("course", "week").agg(F.min("lo").alias("lo"))
    left = rest.select("course", "week", "id").join(similar.select("id").distinct(), "id", "left_anti").join(small(first), ["course", "week"])
    tag = lambda df, how: df.select("course", "id", "lo", F.lit(how).alias("how"))
    return tag(literal, "literal").unionByName(tag(similar, "similar")).unionByName(tag(left, "first"))


def _best_known(most: int):
    """For rows in order of (course, concept, part, place): the best `most` neighbours met so far, for each chunk among them.

    What is in the best `most` of a chunk is in the best `most` of one of its concepts,
    its own concepts left out.
    """

    def run(batches):
        at, met = None, []
        for batch in batches:
            ids, best = [], []
            for course, concept, part, i, own, target, rank in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (course, concept, part) != at:
                    at, met = (course, concept, part), []
                if i is None:
                    insort(met, (rank, target))
                    continue
                found = []
                for x in met:
                    if x[1] not in own:
                        found.append(x)
                        if len(found) == most:
                            break
                if found:
                    ids.append(i)
                    best.append(found)
            kind = pa.list_(pa.struct([("rank", pa.float64()), ("concept", pa.string())]))
            rows = [[{"rank": r, "concept": c} for r, c in x] for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(rows, kind)], names=["id", "best"])

    return run


def prerequisites_before(chunks: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(id, prereqs array): neighbours of a chunk's concepts in the graph that were first seen in an earlier chunk of the course.

    chunks (course, id, module, pos), mentions (course, id, concept), nodes and edges of
    the graph. Ranked by weight over the root of the frequency, ties by name, `most` at
    most; a chunk without any takes the concepts of the chunk before it that it lacks.
    Places are compared as (module, pos, id), so that no course is put in order whole.
    """
    place = F.struct("module", "pos", "id")
    sets = mentions.where(~F.col("concept").isin(PROCEDURAL_TAGS)).groupBy("course", "id").agg(F.array_sort(F.collect_set("concept")).alias("tags"))
    row = chunks.select("course", "id", "module", "pos").join(sets, ["course", "id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    row = materialize(row, "placed-concepts")
    m = row.where(F.col("course").isNotNull() & (F.size("tags") > 0)).select("course", place.alias("at"), F.col("tags").alias("own"), F.explode("tags").alias("concept"))
    seen = m.groupBy("course", "concept").agg(F.min("at").alias("seen"))
    both = edges.select("course", "source", "target", "weight").unionByName(edges.select("course", F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    info = nodes.select("course", F.col("concept").alias("target"), "frequency").join(seen.withColumnRenamed("concept", "target"), ["course", "target"])
    # negative, so that the best comes first in ascending order
    reach = both.where(~F.col("source").isin(PROCEDURAL_TAGS)).join(small(info), ["course", "target"]).select("course", F.col("source").alias("concept"), "target", (-F.round(F.col("weight") / F.sqrt("frequency"), 9)).alias("rank"), F.col("seen").alias("at"))
    # hot concepts' mentions are spread over parts, and their neighbours repeated for each
    parts = small(materialize(nodes.select("course", "concept", F.ceil(F.col("frequency") / MENTIONS_PER_PART).cast("long").alias("parts")), "mention-parts"))
    asked = m.join(parts, ["course", "concept"]).select("course", "concept", F.pmod(F.xxhash64("at.id"), F.col("parts")).alias("part"), "at", "own", F.lit(None).cast("string").alias("target"), F.lit(None).cast("double").alias("rank"))
    known = reach.join(parts, ["course", "concept"]).select("course", "concept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "at", F.lit(None).cast("array<string>").alias("own"), "target", "rank")
    # a chunk comes before what is first seen in it
    rows = asked.unionByName(known).repartition("course", "concept", "part").sortWithinPartitions("course", "concept", "part", "at", F.col("target").isNotNull())
    rows = rows.select("course", "concept", "part", F.when(F.col("target").isNull(), F.col("at.id")).alias("id"), "own", "target", "rank")
    best = rows.mapInArrow(_best_known(most), "id string, best array<struct<rank:double,concept:string>>")
    best = best.groupBy("id").agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("best")))["concept"]), 1, most).alias("found"))
    before = F.lag("tags").over(Window.partitionBy("course", "module").orderBy("pos", "id"))
    row = row.withColumn("before", before).join(best, "id", "left")
    spare = F.slice(F.array_except(F.coalesce("before", F.array().cast("array<string>")), F.col("tags")), 1, most)
    return row.select("id", F.coalesce("found", spare).alias("prereqs"))


def resolve_refs(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(id, ref, lo, status) of refs (course, id, ref) against outcomes (course, lo).

    `direct` names an outcome, `parent` names one once its week (`w03-`) is taken off,
    `orphan` neither; case does not matter.
    """
    k = known.select("course", F.lower("lo").alias("lo")).distinct()
    a = refs.select("course", "id", "ref", F.lower("ref").alias("own"), F.regexp_replace(F.lower("ref"), r"^w(?:eek)?[-_]?\d+[-_]", "").alias("bare")).distinct()
    a = a.join(small(k.select("course", F.col("lo").alias("own"), F.lit(1).alias("d"))), ["course", "own"], "left").join(small(k.select("course", F.col("lo").alias("bare"), F.lit(1).alias("p"))), ["course", "bare"], "left")
    status = F.when(F.col("d").isNotNull(), "direct").when(F.col("p").isNotNull(), "parent").otherwise("orphan")
    return a.select("id", "ref", F.when(F.col("d").isNotNull(), F.col("own")).when(F.col("p").isNotNull(), F.col("bare")).alias("lo"), status.alias("status"))


def outside_week(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, lo) of pages' outcomes (course, id, week, lo) that are none of their week's; pages without a week are left out."""
    weeks = outcomes_of_weeks(outcomes).select("course", "week", F.lower("lo").alias("lo")).distinct()
    return pages.where("week is not null").select("course", "id", "week", F.lower("lo").alias("lo")).distinct().join(small(weeks), ["course", "week", "lo"], "left_anti").select("id", "lo")


def valid_ids(terminal: DataFrame, chapter: DataFrame, weeks: int) -> DataFrame:
    """(course, lo): terminal and chapter outcomes (course, lo), and each under the name of every week."""
    base = terminal.select("course", F.lower("lo").alias("lo")).union(chapter.select("course", F.lower("lo").alias("lo"))).distinct()
    scoped = base.select("course", F.explode(F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda w: F.concat(F.lit("w"), F.lpad(w.cast("string"), 2, "0"), F.lit("-"), F.col("lo")))).alias("lo"))
    return base.union(scoped).distinct()


def alignment_metrics(chunks: DataFrame, valid: DataFrame, roles: list[str]) -> DataFrame:
    """(course, chunks, covered, consistent, score): shares of chunks with a valid outcome and with a known role, blended 60 to 40.

    chunks (course, id, refs, role)."""
    hit = chunks.select("course", "id", F.explode("refs").alias("r")).select("course", "id", F.lower("r").alias("lo")).join(small(valid), ["course", "lo"], "left_semi").select("id").distinct().withColumn("hit", F.lit(1.0))
    g = chunks.join(hit, "id", "left").groupBy("course").agg(F.count("*").alias("chunks"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("covered"), F.avg(F.when(F.col("role").isin(roles), 1.0).otherwise(0.0)).alias("consistent"))
    return g.withColumn("score", 0.6 * F.col("covered") + 0.4 * F.col("consistent"))


def unresolved(refs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """References whose keys no row of `known` has; null keys do not resolve."""
    return refs.join(small(known.select(*keys).distinct()), keys, "left_anti")


def grounding(paragraphs: DataFrame, known: DataFrame, least_words: int = 30) -> DataFrame:
    """(page, long, grounded, share) of paragraphs (page, text, sources array, inherited array).

    Of the paragraphs of `least_words` words or more, those that a known source
    (source) is named for, on themselves or above them.
    """
    p = paragraphs.where(T.word_count(F.col("text")) >= least_words).withColumn("pid", F.monotonically_increasing_id())
    p = materialize(p, "paragraphs")
    named = p.select("pid", F.explode(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.coalesce("inherited", F.array().cast("array<string>")))).alias("source"))
    ok = named.join(small(known.select("source").distinct()), "source", "left_semi").select("pid").distinct().withColumn("ok", F.lit(1))
    g = p.join(ok, "pid", "left").groupBy("page").agg(F.count("*").alias("long"), F.count("ok").alias("grounded"))
    return g.withColumn("share", F.col("grounded") / F.col("long"))


def sources_of_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, block, kind, score): the blocks that a page's keywords are found in.

    pages (course, page, words array), blocks (course, block, words array). The
    similarity of the sets of words; the best two at PRIMARY and NEAR_BEST of the best
    are primary (the best always), the next three at CONTRIBUTING are contributing. An
    equality join on words: blocks that share none are never paired.
    """
    a = pages.select("course", "page", F.array_distinct("words").alias("w")).where(F.size("w") > 0)
    b = blocks.select("course", "block", F.array_distinct("words").alias("w")).where(F.size("w") > 0)
    k = a.select("course", "page", F.size("w").alias("na"), F.explode("w").alias("word")).join(b.select("course", "block", F.size("w").alias("nb"), F.explode("w").alias("word")), ["course", "word"])
    j = k.groupBy("page", "block").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = j.select("page", "block", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 9).alias("score"))
    w = Window.partitionBy("page").orderBy(F.desc("score"), "block")
    j = j.withColumn("n", F.row_number().over(w)).withColumn("top", F.max("score").over(Window.partitionBy("page")))
    strong = (F.col("score") >= F.greatest(F.lit(PRIMARY), F.col("top") * NEAR_BEST)) & (F.col("n") <= MOST_PRIMARY) | (F.col("n") == 1)
    j = j.withColumn("primary", strong)
    rest = j.where(~F.col("primary") & (F.col("score") >= CONTRIBUTING)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= MOST_CONTRIBUTING)
    return j.where("primary").select("page", "block", F.lit("primary").alias("kind"), "score").unionByName(rest.select("page", "block", F.lit("contributing").alias("kind"), "score"))


def merged_in_order(rows: DataFrame, keys: list[str], order: Column, ids: str) -> DataFrame:
    """(keys, ids): the distinct ids of a group's arrays, in the order in which they are first met. A group is one section."""
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(ids).alias("x")))).alias("g"))
    return g.select(*keys, F.array_distinct(F.flatten(F.filter(F.col("g.x"), lambda x: x.isNotNull()))).alias(ids))


def nested_ids(df: DataFrame, id_col: str, json_col: str, keys: tuple[str, ...] = ("sourceId",)) -> DataFrame:
    """(id, key, value) of every string or number under one of `keys`, at any depth of a JSON text; malformed and null texts give no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k in keys and isinstance(v, (str, int, float)) and not isinstance(v, bool):
                    yield k, str(v)
                else:
                    yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    def run(frames):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["_i"], pdf["_t"]):
                try:
                    rows += [(i, k, v) for k, v in walk(json.loads(t))] if t else []
                except (ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=[id_col, "key", "value"])

    return df.select(F.col(id_col).alias("_i"), F.col(json_col).alias("_t")).mapInPandas(run, f"{id_col} {kind}, key string, value string")


def section_metadata(sections: DataFrame, fields: dict[str, list[str]], default: dict[str, str]) -> DataFrame:
    """Each field from the first of its columns that is filled, else its default; `<field>_from` tells which."""
    out = [F.col("id")]
    for f, columns in fields.items():
        out.append(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(default.get(f))).alias(f))
        came = None
        for c in columns:
            full = F.nullif(F.trim(c), F.lit("")).isNotNull()
            came = F.when(full, F.lit(c)) if came is None else came.when(full, F.lit(c))
        out.append(came.otherwise("default").alias(f"{f}_from"))
    return sections.select(*out)


def roll_up(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, terms, definitions, examples, exercises): how many distinct terms, terms with a definition, and chunks of a kind each group has."""
    t = chunks.select(*keys, F.explode("key_terms").alias("k")).select(*keys, F.lower(F.trim("k.term")).alias("term"), F.col("k.definition").alias("d")).where("term <> ''")
    g = t.groupBy(*keys, "term").agg(F.max(F.when(F.trim(F.coalesce("d", F.lit(""))) != "", 1).otherwise(0)).alias("has")).groupBy(*keys).agg(F.count("*").alias("terms"), F.sum("has").alias("definitions"))
    k = chunks.groupBy(*keys).agg(F.count_if(F.col("chunk_type") == "example").alias("examples"), F.count_if(F.col("chunk_type") == "exercise").alias("exercises"))
    return k.join(g, keys, "left").na.fill(0, ["terms", "definitions"])


def taxonomy_errors(rows: DataFrame, taxonomy: DataFrame, levels: list[str]) -> DataFrame:
    """(id, level, value): the first level of a row's path that the taxonomy (a row a path) does not have under the levels above it."""
    left, found = rows.select("id", *levels), None
    for i, level in enumerate(levels):
        known = small(taxonomy.select(*levels[: i + 1]).distinct())
        bad = left.where(F.col(level).isNotNull()).join(known, levels[: i + 1], "left_anti").select("id", F.lit(level).alias("level"), F.col(level).alias("value"))
        found = bad if found is None else found.unionByName(bad.join(found.select("id"), "id", "left_anti"))
    return found
