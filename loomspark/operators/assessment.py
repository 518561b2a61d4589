"""Questions: their parts, scores, checks over sets of them, leaks of answers, and questions made from content.

A question is (id, course, level, refs, stem, choices, answer, feedback): choices in
their order, the answer one of them (or free text), feedback null where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions import scoring, text as T
from loomspark.operators.checks import TYPES_OF_LEVEL
from loomspark.operators.joins import among

# Weights of the five parts of a question's quality.
QUALITY_WEIGHTS = {"stem_grounding": 0.25, "distractor_plausibility": 0.25, "answer_specificity": 0.20, "bloom_alignment": 0.15, "feedback_quality": 0.15}
# Signs that an answer is given away, and signs that it is explained.
REVEALS = [
    (r"(?:the\s+)?(?:correct|right)\s+answer\s+(?:is|would\s+be|should\s+be)", "answer_reveal"),
    (r"answer\s*[:=]\s*", "answer_assignment"),
    (r"(?:this|that)\s+is\s+(?:the\s+)?(?:correct|right)", "correctness_indicator"),
    (r"(?:should|must|will)\s+(?:be|equal|return)", "result_indicator"),
    (r"(?:always|never)\s+(?:returns?|equals?|is)", "absolute_result"),
]
EXPLAINS = r"(?:the\s+)?explanation\s*[:=]|(?:this|that)\s+is\s+because|the\s+reason\s+(?:is|being)|to\s+understand\s+why|(?:here's|here\s+is)\s+why"

_CHOICE = r"^\s*[A-H][).]\s"


def questions_of(chunks: DataFrame) -> DataFrame:
    """Questions of assessment chunks (id, source, bloom_level, learning_outcome_refs, text): a stem, then choices marked `A)`, `B)` on lines of their own.

    Texts name no key: the first choice stands for the answer. Null texts are no questions.
    """
    choices = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(_CHOICE)), lambda x: F.trim(F.regexp_replace(x, r"^\s*[A-H][).]\s+", "")))
    q = chunks.where("chunk_type = 'assessment_item' and text is not null")
    return q.select(
        "id", F.col("source.course_id").alias("course"), F.col("bloom_level").alias("level"), F.col("learning_outcome_refs").alias("refs"), F.trim(F.split("text", r"\n\s*[A-H][).]\s")[0]).alias("stem"),
        choices.alias("choices"), F.get(choices, F.lit(0)).alias("answer"), F.lit(None).cast("string").alias("feedback"),
    )


def vocabulary_of(chunks: DataFrame) -> DataFrame:
    """(course, word): the content words of each course's texts (source, text)."""
    return chunks.select(F.col("source.course_id").alias("course"), F.explode(T.content_words(F.coalesce("text", F.lit("")))).alias("word")).distinct()


def question_quality(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, course, five scores from 0 to 1): grounding of the stem, plausibility of wrong choices, the answer's length, level, feedback.

    What a stem or choice shares with the course's vocabulary is counted by an equality
    join on its words; a course without a vocabulary gives 0.5 for grounding and no
    penalty to choices.
    """
    wrong = F.slice("choices", F.lit(2), F.greatest(F.size("choices") - 1, F.lit(0)))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("part"), F.col("stem").alias("s"))), F.transform(wrong, lambda c, i: F.struct((i + 1).alias("part"), c.alias("s"))), F.array(F.struct(F.lit(-1).alias("part"), F.coalesce("feedback", F.lit("")).alias("s"))))
    words = questions.select("id", "course", F.explode(parts).alias("p")).select("id", "course", "p.part", T.content_words(F.col("p.s")).alias("w"))
    sizes = vocabulary.groupBy("course").agg(F.count("*").alias("n_vocabulary"))
    each = words.select("id", "course", "part", F.explode("w").alias("word"))
    hits = each.join(vocabulary, ["course", "word"]).groupBy("id", "part").agg(F.count("*").alias("k"))
    shared = words.join(sizes, "course", "left").join(hits, ["id", "part"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    shared = shared.select("id", "part", F.size("w").alias("n"), "n_vocabulary", (F.col("k") / (F.size("w") + F.col("n_vocabulary") - F.col("k"))).alias("j"))
    by_part = shared.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", F.struct("n", "j")))).alias("m"), F.first("n_vocabulary").alias("n_vocabulary"))
    q = questions.join(by_part, "id")
    known = F.coalesce(F.col("n_vocabulary"), F.lit(0)) > 0
    own = T.content_words(F.coalesce("answer", F.lit("")))

    def plausible(c, i):
        short = F.when(F.size(T.find_all(c, r"\S+")) < 3, 0.4).otherwise(0.0)
        same = F.when((F.size(own) > 0) & (T.jaccard(T.content_words(c), own) > 0.9), 0.5).otherwise(0.0)
        far = F.when(known & (F.col("m")[i + 1]["n"] > 0) & (F.col("m")[i + 1]["j"] < 0.01), 0.3).otherwise(0.0)
        return F.greatest(F.lit(0.0), 1.0 - short - same - far)

    scores = F.transform(wrong, plausible)
    mean = F.when(F.size("choices") == 0, 1.0).when(F.size(wrong) == 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(wrong))
    n_answer = F.size(T.find_all(F.coalesce("answer", F.lit("")), r"\S+"))
    n_feedback = F.size(T.find_all(F.coalesce("feedback", F.lit("")), r"\S+"))
    found = scoring.detect_bloom(F.col("stem"))
    return q.select(
        "id", "course", F.when(known, F.least(F.lit(1.0), F.col("m")[0]["j"] * 5)).otherwise(0.5).alias("stem_grounding"), mean.alias("distractor_plausibility"),
        F.when(n_answer >= 5, 1.0).when(n_answer >= 2, 0.6).when(n_answer == 1, 0.3).when(F.size("choices") == 0, 0.8).otherwise(0.3).alias("answer_specificity"),
        F.when(found.isNull(), 0.5).when(F.col("level").isNull(), 0.7).when(found == F.lower("level"), 1.0).otherwise(0.4).alias("bloom_alignment"),
        F.when(n_feedback == 0, 0.0).when((n_feedback >= 10) & (~known | (F.col("m")[-1]["j"] > 0.02)), 1.0).when(n_feedback >= 5, 0.6).otherwise(0.3).alias("feedback_quality"),
    )


def quality_score(scores: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """(keys, score, passed): the five parts averaged over questions and weighted."""
    total = reduce(lambda a, b: a + b, [F.avg(c) * w for c, w in QUALITY_WEIGHTS.items()])
    return scores.groupBy(*keys).agg(total.alias("score")).withColumn("passed", F.col("score") >= least)


def assessment_dimension(questions: DataFrame, targeted: DataFrame) -> DataFrame:
    """(course, n, shares): distinct stems and answers, mean normalized entropy of wrong choices, share of targeted outcomes covered.

    targeted (course, lo); a course without targets has coverage 1 if anything is covered.
    """
    wrong = F.slice("choices", F.lit(2), F.greatest(F.size("choices") - 1, F.lit(0)))
    each = questions.select("course", "id", F.explode(wrong).alias("c")).groupBy("course", "id", F.lower(F.trim("c")).alias("c")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("course", "id")
    p = F.col("k") / F.sum("k").over(w)
    entropy = each.withColumn("p", p).groupBy("course", "id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("m"))
    entropy = entropy.select("id", F.when(F.col("m") > 1, F.col("h") / F.log2("m")).otherwise(0.0).alias("e"))
    rows = questions.join(entropy, "id", "left")
    g = rows.groupBy("course").agg(
        F.count("*").alias("n"), (F.count_distinct(F.nullif(F.lower("stem"), F.lit(""))) / F.count(F.nullif("stem", F.lit("")))).alias("stem_share"),
        (F.count_distinct(F.lower("answer")) / F.count("answer")).alias("answer_share"), F.avg(F.coalesce("e", F.lit(0.0))).alias("distractor_entropy"),
    )
    covered = questions.select("course", F.explode("refs").alias("r")).select("course", F.lower("r").alias("lo")).distinct()
    goal = targeted.select("course", F.lower("lo").alias("lo")).distinct()
    hit = goal.join(covered.withColumn("hit", F.lit(1)), ["course", "lo"], "left").groupBy("course").agg((F.count("hit") / F.count("*")).alias("coverage"))
    return g.join(hit, "course", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))


def phantom_outcomes(questions: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, lo): outcomes that a question names and no chunk of its course (refs: course, lo) does, without regard to case."""
    q = questions.select("id", "course", F.explode("refs").alias("r")).select("id", "course", F.lower("r").alias("lo")).where("lo is not null").distinct()
    return q.join(refs.select("course", F.lower("lo").alias("lo")).distinct(), ["course", "lo"], "left_anti").select("id", "lo")


def assessment_gate(questions: DataFrame, keys: list[str], fewest: int = 5, least: float = 0.85) -> DataFrame:
    """(keys, questions, repeated_stems, score, passed): a warning each for repeated stems and for too few questions, 0.05 off the score."""
    stems = questions.groupBy(*keys, F.lower(F.trim("stem")).alias("s")).agg(F.count("*").alias("n"))
    g = stems.groupBy(*keys).agg(F.sum("n").alias("questions"), F.count_if((F.col("n") > 1) & (F.col("s") != "")).alias("repeated_stems"))
    warnings = F.when(F.col("repeated_stems") > 0, 1).otherwise(0) + F.when(F.col("questions") < fewest, 1).otherwise(0)
    return g.withColumn("score", F.greatest(F.lit(0.0), 1 - warnings * 0.05)).withColumn("passed", F.col("score") >= least)


def question_kind(choices: Column, stem: Column) -> Column:
    """What a question's parts show it to be."""
    low = F.lower(stem)
    two = F.transform(choices, lambda c: F.lower(F.trim(c)))
    return (
        F.when((F.size(choices) == 2) & F.array_contains(two, "true") & F.array_contains(two, "false"), "true_false").when(F.size(choices) > 0, "multiple_choice")
        .when(F.contains(stem, F.lit("_____")), "fill_in_blank").when(low.rlike(r"\b(discuss|evaluate|analy[sz]e|argue|critique)\b"), "essay").otherwise("short_answer")
    )


def level_mismatches(questions: DataFrame) -> DataFrame:
    """(id, kind, level) of questions of a kind that does not suit their level; kinds without a rule suit every level."""
    kind = question_kind(F.col("choices"), F.col("stem"))
    allowed = F.create_map(*[x for k, v in TYPES_OF_LEVEL.items() for x in (F.lit(k), T.strings(v))])[F.col("kind")]
    return questions.select("id", kind.alias("kind"), "level").where(F.col("level").isNotNull() & F.coalesce(~F.array_contains(allowed, F.col("level")), F.lit(False)))


def reveals(df: DataFrame, id_col: str = "id", text_col: str = "text", before: int = 50, after: int = 100) -> DataFrame:
    """(id, sign, n): how often each sign that gives an answer away stands in a text, places left out where it is explained.

    The text is cut at the sign's places; the `before` characters up to a place, the
    sign and the `after` characters from it on are its context. Empty and null texts have none.
    """
    def unexplained(pattern: str) -> Column:
        hits, rest = T.find_all(F.col("_t"), f"(?i){pattern}"), F.split("_t", f"(?i){pattern}", -1)

        def free(_, i):
            # what stands before place i and the sign itself: the pieces and signs up to it, joined
            head = F.length(F.array_join(F.zip_with(F.slice(rest, F.lit(1), i + 1), F.slice(hits, F.lit(1), i + 1), lambda r, h: F.concat(r, h)), ""))
            start = F.greatest(F.lit(1), head - F.length(F.get(hits, i)) - (before - 1))
            return ~F.substr(F.col("_t"), start, head - start + 1 + after).rlike(f"(?i){EXPLAINS}")

        return F.size(F.filter(hits, free))

    found = [F.struct(F.lit(name).alias("sign"), unexplained(pattern).alias("n")) for pattern, name in REVEALS]
    rows = df.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t"))
    return rows.select(id_col, F.explode(F.array(*found)).alias("x")).where("x.n > 0").select(id_col, "x.*")


def leak_batch(leaks: list[DataFrame], total: int, id_col: str = "id") -> DataFrame:
    """One row over findings (id): examples, failing examples, findings, whether the batch passes."""
    rows = reduce(DataFrame.unionByName, [x.select(id_col) for x in leaks])
    return rows.agg(F.count_distinct(id_col).alias("failing"), F.count("*").alias("leaks")).withColumn("examples", F.lit(total)).withColumn("passed", F.col("failing") == 0)


def multiple_choice(chunks: DataFrame, most: int = 3) -> DataFrame:
    """(id, term, stem, answer, distractors) of chunks (id, course, key_terms): which meaning a term has, among those of other terms of its course.

    Definitions of a course are placed in order of a hash; a term's wrong choices are
    the next different ones, round the end, so that no course's terms are gathered.
    """
    t = chunks.select("id", "course", F.explode("key_terms").alias("k")).select("id", "course", F.col("k.term").alias("term"), F.col("k.definition").alias("definition")).where("term is not null and trim(term) <> '' and definition is not null and trim(definition) <> ''")
    defs = t.select("course", "definition").distinct().withColumn("h", F.xxhash64("course", "definition"))
    # a ring in parts of bounded size: the hash's top bits name the part, its order inside is the hash's
    n = defs.groupBy("course").agg(F.ceil(F.count("*") / 5000).alias("parts"))
    ring = defs.join(n, "course").withColumn("part", F.pmod(F.shiftright("h", 8), F.col("parts")))
    w = Window.partitionBy("course", "part").orderBy("h", "definition")
    ring = ring.select("course", "part", "definition", F.row_number().over(w).alias("k"), F.collect_list("definition").over(w.rowsBetween(1, most)).alias("after"))
    head = ring.where(F.col("k") <= most + 1).groupBy("course", "part").agg(F.array_sort(F.collect_list(F.struct("k", "definition"))).alias("head"))
    ring = ring.join(head, ["course", "part"]).select("course", "definition", F.array_except(F.concat("after", F.col("head.definition")), F.array("definition")).alias("others"))
    q = t.join(ring, ["course", "definition"])
    return q.select("id", "term", F.concat(F.lit("Which of these describes "), F.trim("term"), F.lit("?")).alias("stem"), F.col("definition").alias("answer"), F.slice("others", 1, most).alias("distractors"))


# Openings of free questions by level.
FREE_STEMS = {
    "remember": "List the key facts about {}.", "understand": "Explain {} in your own words.", "apply": "Describe a situation in which {} is used.",
    "analyze": "Analyze how {} relates to the rest of the lesson.", "evaluate": "Evaluate the use of {}.", "create": "Design an activity that teaches {}.",
}


def free_questions(chunks: DataFrame) -> DataFrame:
    """(id, kind, prompt) of chunks (id, bloom_level, concept_tags, section_heading): an essay for the three upper levels, a short answer below.

    The topic is the first concept, else the heading; chunks without both have no question.
    """
    topic = F.coalesce(F.get(F.filter("concept_tags", lambda t: t.isNotNull() & (F.trim(t) != "")), F.lit(0)), F.nullif(F.trim("section_heading"), F.lit("")))
    level = F.coalesce("bloom_level", F.lit("understand"))
    stem = F.create_map(*[F.lit(x) for kv in FREE_STEMS.items() for x in kv])[level]
    kind = F.when(level.isin("analyze", "evaluate", "create"), "essay").otherwise("short_answer")
    return chunks.select("id", kind.alias("kind"), F.replace(F.coalesce(stem, F.lit(FREE_STEMS["understand"])), F.lit("{}"), F.regexp_replace(topic, "[-_]+", " ")).alias("prompt")).where("prompt is not null")


def augmented(generated: DataFrame, curated: DataFrame, query_col: str = "question") -> DataFrame:
    """Generated questions and the curated ones whose question is not among them yet (by words, without regard to case)."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    known = generated.select(key(F.col(query_col)).alias("_k")).distinct()
    return generated.unionByName(curated.withColumn("_k", key(F.col(query_col))).join(known, "_k", "left_anti").drop("_k"))


def misused_terms(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Questions a choice of which is among `terms` (term)."""
    each = questions.select("id", F.explode("choices").alias("c")).select("id", F.lower(F.trim("c")).alias("term"))
    return among(each, terms.select(F.lower("term").alias("term")).distinct(), ["term"], F.col("id")).select("id").distinct()


def assessment(chunks: DataFrame) -> DataFrame:
    """(id, kind, prompt, answer): a set of questions from content: multiple choice and gaps from key terms, true or false from misconceptions, free ones from concepts.

    chunks (id, course, key_terms, misconceptions, text, bloom_level, concept_tags, section_heading).
    """
    from loomspark.operators.extraction import blank_out, negate

    choice = multiple_choice(chunks).select("id", F.lit("multiple_choice").alias("kind"), F.col("stem").alias("prompt"), "answer")
    m = chunks.select("id", F.explode("misconceptions").alias("m")).where("m.misconception is not null")
    false = m.select("id", F.lit("true_false").alias("kind"), F.col("m.misconception").alias("prompt"), F.lit("false").alias("answer"))
    true = m.select("id", F.lit("true_false").alias("kind"), negate(F.col("m.misconception")).alias("prompt"), F.lit("true").alias("answer")).where(F.col("prompt") != F.col("m.misconception"))
    k = chunks.select("id", "text", F.explode("key_terms.term").alias("term")).where("trim(term) <> ''")
    gap = k.select("id", F.lit("fill_in_blank").alias("kind"), blank_out(F.col("text"), F.col("term")).alias("prompt"), F.col("term").alias("answer")).where("prompt is not null")
    free = free_questions(chunks).select("id", "kind", "prompt", F.lit(None).cast("string").alias("answer"))
    return reduce(DataFrame.unionByName, [choice, false, true, gap, free]).distinct()
