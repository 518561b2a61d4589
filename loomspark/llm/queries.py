"""Queries pN_... of the training-text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm import boilerplate, cooccurrence, encoding, frequency, nearduplicate, packing, scanned, spam, splitting
from loomspark.llm.items import item_mentions
from loomspark.tables import table


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.surprising_pairs(item_mentions(table(spark, d, "chunks")), min_count=5)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p1_pairs(spark, d)
    return pairs.where(F.col("n") * F.col("baskets") >= 20 * F.col("n_a") * F.col("n_b")).select("field", "item_a", "item_b")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts that the pairs are judged by."""
    return p1_pairs(spark, d).select("field", "item_a", "item_b", "n", "n_a", "n_b", "baskets")


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "raw_blocks"), table(spark, d, "text_spans"), table(spark, d, "lexicon")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.scan_defects(*_scans(spark, d))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned.scan_paragraphs(*_scans(spark, d))


def _by_course(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("id", F.col("source.course_id").alias("source"), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(_by_course(spark, d), min_docs=10)


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = _by_course(spark, d)
    return boilerplate.without_lines(docs, boilerplate.repeated_lines(docs, min_docs=10))


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_passages(_by_course(spark, d), min_docs=10)


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_chunks(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(table(spark, d, "chunks")).where("piece_no = 0 and n_pieces > 1").select("id")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, words, within, overlaps, linked): what must hold of the pieces of every chunk."""
    return splitting.piece_checks(p4_pieces(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicate.near_duplicate_pairs(table(spark, d, "chunks"), k=3, t=0.7)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicate.near_duplicate_groups(table(spark, d, "chunks"), k=3, t=0.7)


def p6_frequency(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    n = chunks.agg(F.countDistinct("id")).first()[0]
    return frequency.mark_extremes(frequency.item_frequency(item_mentions(chunks)), n)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_frequency(spark, d).where("mark is not null").select("field", "item", "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens."""
    sizes = encoding.encode_corpus(table(spark, d, "documents"), counts_only=True)
    return packing.pack_items(sizes, capacity=2048)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, within, whole, placed): what must hold of every document's place."""
    return packing.container_checks(p8_containers(spark, d), capacity=2048)


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("is_spam").select("doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


#: Items as TESTDATA.md defines them, for DuckDB.
_ONCE = "(SELECT id, any_value(text) AS text, any_value(source) AS source, any_value(concept_tags) AS concept_tags, any_value(key_terms) AS key_terms FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_WS = "[ \\t\\n\\r\\x{A0}]"
_MENTIONS = f"""
WITH one AS {_ONCE},
raw AS (
  SELECT id, 'concept_tags' AS field, trim(regexp_replace(lower(x), '[ \\t\\n\\r\\x{{A0}}_\\-\\x{{2010}}-\\x{{2013}}]+', '-', 'g'), '-') AS item
  FROM (SELECT id, unnest(concept_tags) AS x FROM one)
  UNION ALL
  SELECT id, 'key_terms', trim(regexp_replace(lower(x.term), '{_WS}+', ' ', 'g'), ' ') FROM (SELECT id, unnest(key_terms) AS x FROM one)),
mention AS (SELECT * FROM raw WHERE item IS NOT NULL AND item <> '')"""

_P1 = f"""{_MENTIONS},
b AS (SELECT DISTINCT id, field, item FROM mention),
n1 AS (SELECT field, item, count(*) AS n FROM b GROUP BY ALL),
tot AS (SELECT field, count(DISTINCT id) AS baskets FROM b GROUP BY field),
pr AS (SELECT x.field, x.item AS item_a, y.item AS item_b, count(*) AS n FROM b x JOIN b y ON x.id = y.id AND x.field = y.field AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5)
SELECT pr.field, item_a, item_b FROM pr JOIN n1 a ON a.field = pr.field AND a.item = item_a JOIN n1 c ON c.field = pr.field AND c.item = item_b
JOIN tot ON tot.field = pr.field WHERE pr.n * baskets >= 20 * a.n * c.n"""

_FREQ = f"""{_MENTIONS},
f AS (SELECT field, item, count(*) AS occurrences, count(DISTINCT id) AS records FROM mention GROUP BY ALL),
t AS (SELECT count(DISTINCT id) AS n FROM chunks),
m AS (SELECT f.*, CASE WHEN records < 3 THEN 'rare' WHEN records * 50 > t.n THEN 'common' END AS mark FROM f, t)"""


_LINES = f"""WITH one AS {_ONCE},
l AS (SELECT id, source.course_id AS c, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM one),
n AS (SELECT id, c, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '{_WS}+', ' ', 'g'), ' ') AS form FROM l),
o AS (SELECT coalesce(c, '') AS c, form FROM n WHERE form <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 10),
cut AS (SELECT id, line_no::INT AS line_no FROM n JOIN o ON coalesce(n.c, '') = o.c AND n.form = o.form)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_counts": _P1[: _P1.rindex("SELECT pr.field")] + "SELECT pr.field, item_a, item_b, pr.n, a.n AS n_a, c.n AS n_b, baskets FROM pr JOIN n1 a ON a.field = pr.field AND a.item = item_a JOIN n1 c ON c.field = pr.field AND c.item = item_b JOIN tot ON tot.field = pr.field",
        "p4_checks": f"SELECT id AS source_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{{A0}}]+')), 0)::BIGINT AS words, true AS within, true AS overlaps, true AS linked FROM {_ONCE}",
        "p8_checks": "SELECT doc_id, true AS within, true AS whole, true AS placed FROM documents WHERE text <> ''",
        "p5_groups": f"""WITH RECURSIVE one AS {_ONCE},
w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM one),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT p.x, p.y FROM p JOIN n a ON a.id = p.x JOIN n b ON b.id = p.y WHERE p.k >= 0.7 * (a.n + b.n - p.k) - 1e-9),
r(id, node) AS (SELECT id, id FROM n UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.node)
SELECT n.id, (SELECT min(node) FROM r WHERE r.id = n.id) AS group_id, (SELECT count(*) FROM n m WHERE m.k = n.k) AS copies, (SELECT count(DISTINCT m.k) FROM l JOIN n m ON m.id = l.y WHERE l.x = n.id AND m.k <> n.k) AS links FROM n""",
        "p3_found": f"{_LINES} SELECT id, line_no FROM cut",
        "p3_clean": f"""{_LINES},
g AS (SELECT id, list(DISTINCT line_no) AS gone FROM cut GROUP BY id)
SELECT one.id, CASE WHEN gone IS NULL THEN text ELSE coalesce(list_aggregate([x[1] FOR x IN list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))::BIGINT)) IF NOT list_contains(gone, x[2]::INT)], 'string_agg', chr(10)), '') END AS text, coalesce(len(gone), 0)::INT AS lines_cut FROM one LEFT JOIN g ON g.id = one.id""",
        "p4_found": f"SELECT id FROM {_ONCE} WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{{A0}}]+')) > 800",
        "p5_found": f"""WITH one AS {_ONCE},
w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM one),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9""",
        "p6_frequency": f"{_FREQ} SELECT field, item, occurrences, records, mark FROM m",
        "p6_found": f"{_FREQ} SELECT field, item, mark FROM m WHERE mark IS NOT NULL",
    }
