"""Sections put together from several sources, tables made of them, reports on them, objectives made from topics; and hooks for callers' functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions import text as T
from loomspark.operators.joins import nearest_within

#: Trust in a source where it gives none itself.
TRUST = {"table": 0.9, "text": 0.8, "ocr": 0.6}


def merge_sources(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, source, confidence, agree) of parts (keys, source, value, confidence), a row a field.

    Values are compared without regard to case and white space; the one with the most
    trust in all wins (a part without a confidence has its source's), ties go to the
    value; confidence is that of its best source, raised by a tenth of what is missing
    for every further source that agrees.
    """
    known = F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])[F.col("source")]
    p = parts.where("value is not null and trim(value) <> ''").withColumn("trust", F.coalesce("confidence", known, F.lit(0.5))).withColumn("form", T.collapse(F.lower("value")))
    g = p.groupBy(*keys, "form").agg(F.sum("trust").alias("total"), F.max("trust").alias("best"), F.count_distinct("source").alias("agree"), F.max_by(F.struct("value", "source"), F.struct("trust", "value")).alias("v"))
    w = Window.partitionBy(*keys).orderBy(F.desc("total"), "form")
    return g.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, "v.value", "v.source", (1 - (1 - F.col("best")) * F.pow(F.lit(0.9), F.col("agree") - 1)).alias("confidence"), "agree")


def contacts(df: DataFrame, id_col: str, text_col: str, email_within: int = 300, phone_within: int = 200) -> DataFrame:
    """(id, name, email, phone, confidence): names in a text (`Dr. Ada Byron`, `Ada Byron, Director`), each with the nearest e-mail and telephone number.

    Full marks (0.9) where both are near, 0.7 with one, else 0.4. Places are found with
    the pieces of text between; the pairs come from a band join.
    """

    def places(pattern: str, name: str) -> DataFrame:
        c = F.coalesce(F.col(text_col), F.lit(""))
        rows = df.select(id_col, T.find_all(c, pattern).alias("hits"), F.split(c, pattern, -1).alias("rest"))
        at = rows.select(id_col, "hits", "rest", F.posexplode("hits").alias("k", name))
        before = F.length(F.array_join(F.zip_with(F.slice("rest", F.lit(1), F.col("k") + 1), F.concat(F.array(F.lit("")), F.slice("hits", F.lit(1), F.col("k"))), lambda r, h: F.concat(h, r)), ""))
        return at.select(id_col, name, before.alias(f"{name}_at"))

    names = places(r"(?:Dr|Prof|Mr|Ms|Mrs)\. [A-Z][a-z]+(?: [A-Z][a-z]+)+|[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+(?=,| \()", "name")
    mails = nearest_within(names, places(T.EMAIL_RE, "email"), [id_col], "name_at", "email_at", email_within).select(id_col, "name_at", "email")
    phones = nearest_within(names, places(T.PHONE_RE, "phone"), [id_col], "name_at", "phone_at", phone_within).select(id_col, "name_at", "phone")
    j = names.join(mails, [id_col, "name_at"], "left").join(phones, [id_col, "name_at"], "left")
    n = F.when(F.col("email").isNotNull(), 1).otherwise(0) + F.when(F.col("phone").isNotNull(), 1).otherwise(0)
    return j.select(id_col, "name", "email", "phone", F.when(n == 2, 0.9).when(n == 1, 0.7).otherwise(0.4).alias("confidence"))


def table_rows(df: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """(id, row, columns...) of the table lines of a text: cells between `|`, tabs or two blanks; lines with another number of cells are none, nor is a header or a rule."""
    lines = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("row", "line"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\s*\|\s*|\t+| {2,}"), lambda c: F.trim(c))
    rows = lines.select(id_col, "row", cells.alias("c")).where((F.size("c") == len(columns)) & ~F.exists("c", lambda x: x.rlike(r"^[-:= ]*$")))
    rows = rows.where(F.lower(F.col("c")[0]) != columns[0].lower())
    return rows.select(id_col, "row", *[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def roster(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, name, role) of lines `Name - role`, `Name: role` or `Name, role`, each name once, the first role kept."""
    lines = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    p = r"^\s*(?:[-*•]\s+)?([A-Z][a-z]+(?: [A-Z][a-z.]*)+)\s*(?:[-–—:]|,)\s*(\S.{1,60})$"
    rows = lines.where(F.col("line").rlike(p)).select(id_col, "pos", F.regexp_extract("line", p, 1).alias("name"), F.trim(F.regexp_extract("line", p, 2)).alias("role"))
    return rows.groupBy(id_col, "name").agg(F.min_by("role", "pos").alias("role"))


def mean_confidence(df: DataFrame, keys: list[str], c: str = "confidence") -> DataFrame:
    """(keys, confidence): the mean; 1 where none is given."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(c), F.lit(1.0)).alias(c))


def conversion_report(sections: DataFrame, findings: DataFrame, document: str) -> DataFrame:
    """(document, sections, empty, words, confidence, failures, passed): a document's sections (document, text, confidence) and what its pages fail (document, n)."""
    s = sections.groupBy(document).agg(F.count("*").alias("sections"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.sum(T.word_count(F.col("text"))).alias("words"), F.coalesce(F.avg("confidence"), F.lit(1.0)).alias("confidence"))
    f = findings.groupBy(document).agg(F.sum("n").alias("failures"))
    return s.join(f, document, "left").na.fill(0, ["failures"]).withColumn("passed", (F.col("failures") == 0) & (F.col("empty") * 2 <= F.col("sections")))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order: openers of chapters that a converter found twice, say."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def rubric(courses: DataFrame, items: dict[str, Column], key: str, least: float = 0.7) -> DataFrame:
    """(key, passed, of, score, ok): how many items of a rubric hold of each row; an item that is unknown does not."""
    held = sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in items.values()), F.lit(0))
    return courses.select(key, held.alias("passed"), F.lit(len(items)).alias("of"), (held / len(items)).alias("score")).withColumn("ok", F.col("score") >= least)


def course_rubric(chunks: DataFrame, courses: DataFrame) -> DataFrame:
    """(course, passed, of, score, ok): twelve items of course quality that the tables can tell."""
    c = chunks.groupBy(F.col("source.course_id").alias("course")).agg(
        F.count("*").alias("n"), F.count_if(F.col("chunk_type") == "overview").alias("overviews"), F.count_if(F.col("chunk_type") == "summary").alias("summaries"), F.count_if(F.col("chunk_type") == "example").alias("examples"),
        F.count_if(F.col("chunk_type") == "exercise").alias("exercises"), F.count_if(F.col("chunk_type") == "assessment_item").alias("questions"), F.avg(F.when(F.size("learning_outcome_refs") > 0, 1.0).otherwise(0.0)).alias("aligned"),
        F.avg(F.when(F.size("key_terms") > 0, 1.0).otherwise(0.0)).alias("with_terms"), F.count_distinct("bloom_level").alias("levels"), F.count_distinct("source.module_id").alias("modules"), F.avg(T.word_count(F.col("text"))).alias("words"),
    )
    o = courses.select(F.col("course_code").alias("course"), F.size("learning_outcomes").alias("outcomes"), "title")
    items = {
        "outcomes are stated": F.col("outcomes") >= 3, "the title is given": F.trim("title") != "", "overviews": F.col("overviews") > 0, "summaries": F.col("summaries") > 0, "examples": F.col("examples") * 10 >= F.col("n"),
        "practice": F.col("exercises") * 20 >= F.col("n"), "assessment": F.col("questions") > 0, "alignment": F.col("aligned") >= 0.6, "terms": F.col("with_terms") >= 0.3, "levels": F.col("levels") >= 4, "structure": F.col("modules") >= 3, "readable size": F.col("words") <= 300,
    }
    return rubric(c.join(o, "course"), items, "course")


def objectives_from_topics(topics: DataFrame, keys: list[str], order: str, weeks: int, most_terminal: int = 5) -> DataFrame:
    """(keys, id, hierarchy_level, week, statement): topics (keys, heading) as chapter outcomes, spread evenly over the weeks, and the first of every few as terminal ones.

    Verbs go round the levels from understanding up, so that neighbours differ.
    """
    verbs = ["Explain", "Apply", "Analyze", "Evaluate"]
    w = Window.partitionBy(*keys).orderBy(order)
    t = topics.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    verb = F.element_at(F.array(*[F.lit(v) for v in verbs]), (F.col("_i") % len(verbs) + 1).cast("int"))
    week = (F.floor(F.col("_i") * weeks / F.col("_n")) + 1).cast("int")
    step = F.ceil(F.col("_n") / most_terminal)
    chapter = t.select(*keys, F.concat(F.lit("co-"), F.lpad((F.col("_i") + 1).cast("string"), 2, "0")).alias("id"), F.lit("chapter").alias("hierarchy_level"), week.alias("week"), F.concat_ws(" ", verb, F.lower("heading")).alias("statement"))
    terminal = t.where(F.col("_i") % step == 0).select(*keys, F.concat(F.lit("to-"), F.lpad((F.floor(F.col("_i") / step) + 1).cast("string"), 2, "0")).alias("id"), F.lit("terminal").alias("hierarchy_level"), F.lit(None).cast("int").alias("week"), F.concat(F.lit("Demonstrate command of "), F.lower("heading")).alias("statement"))
    return terminal.unionByName(chapter)


def applied_filters(filters: dict[str, object]) -> Column:
    """The filters that are set, as a map; none of those left at None, 0 or empty."""
    pairs = [F.lit(x) for k, v in filters.items() if v not in (None, 0, "", [], ()) for x in (k, ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v))]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def content_gaps(expected: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, finding) of expected artifacts (keys) that are missing or empty: artifacts (keys, rows)."""
    j = expected.join(artifacts.select(*keys, "rows"), keys, "left")
    return j.select(*keys, F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").alias("finding")).where("finding is not null")


def strict_evidence(edges: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(source, target, rule, missing): edges whose evidence (a map) lacks a field that their rule must give; rules without a rule here are not let through."""
    need = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])[F.col("rule")]
    lacks = F.filter(need, lambda f: F.coalesce(F.col("evidence")[f], F.lit("")) == "")
    return edges.select("source", "target", "rule", F.when(need.isNull(), F.array(F.lit("unknown rule"))).otherwise(lacks).alias("missing")).where(F.size("missing") > 0)


def iso_time(c: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC; null stays null."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# ---------------------------------------------------------------- hooks


def propose_edges(chunks: DataFrame, nodes: DataFrame, propose: Callable[[pd.DataFrame], pd.DataFrame] | None) -> DataFrame | None:
    """Edges that a caller's function proposes from batches of chunks (source, target, type), kept where both ends are nodes (concept) and marked as proposed; None without a function."""
    if propose is None:
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield propose(pdf)[["source", "target", "type"]]

    got = chunks.mapInPandas(run, "source string, target string, type string").distinct()
    known = nodes.select("concept").distinct()
    for end in ("source", "target"):
        got = got.join(known.withColumnRenamed("concept", end), end, "left_semi")
    return got.where("source <> target").select("source", "target", "type", F.lit("proposed").alias("rule"))


def summaries(chunks: DataFrame, fallback: Column, summarize: Callable[[pd.Series], pd.Series] | None = None, least: int = 40, longest: int = 400) -> DataFrame:
    """(id, summary): a caller's summaries of text batches; where one fails, is empty or out of bounds, the fallback expression's."""
    if summarize is None:
        return chunks.select("id", fallback.alias("summary"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            try:
                made = summarize(pdf["text"].fillna(""))
            except Exception:  # noqa: BLE001  (a caller's function may fail in any way; its batch falls back)
                made = pd.Series([None] * len(pdf), index=pdf.index)
            yield pd.DataFrame({"id": pdf["id"], "summary": [m if isinstance(m, str) and least <= len(m) <= longest else f for m, f in zip(made, pdf["_f"])]})

    return chunks.select("id", "text", fallback.alias("_f")).mapInPandas(run, "id string, summary string")


def classify_blocks(blocks: DataFrame, rule: Column, classify: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """The blocks with role: by a caller's function on batches where one is given and answers, else by the rule."""
    if classify is None:
        return blocks.withColumn("role", rule)
    rows = blocks.withColumn("_rule", rule)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = classify(pdf.drop(columns=["_rule"]))
            yield pdf.drop(columns=["_rule"]).assign(role=[m if isinstance(m, str) and m else r for m, r in zip(made, pdf["_rule"])])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields) + ", role string"
    return rows.mapInPandas(run, schema)


class Registry:
    """Named column functions with the number of their arguments, as a session's SQL functions and for calls by name."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[Callable[..., Column], int]] = {}

    def register(self, name: str, function: Callable[..., Column], arguments: int) -> None:
        if name in self.held:
            raise ValueError(f"{name} is registered already")
        self.held[name] = (function, arguments)

    def call(self, name: str, *columns: Column) -> Column:
        function, n = self.held[name]
        if len(columns) != n:
            raise ValueError(f"{name} takes {n} columns")
        return function(*columns)


def audited(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """The same rows, with their number and the given aggregates observed while they are written."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in measures.items()])

