"""Markup as rows: HTML, Markdown, QTI and package archives, read by one task per document."""

from __future__ import annotations

import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomspark.functions.patterns import low_signal_heading

_SKIP = {"script", "style", "nav", "footer", "header"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Headings, sections' text, terms, links, anchors, images, lists, JSON-LD and balance of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = [{"level": 0, "heading": "", "text": []}]
        self.stack: list[str] = []
        self.unbalanced = 0
        self.terms: list[str] = []
        self.hrefs: list[str] = []
        self.ids: list[str] = []
        self.bad_images = self.empty_lists = 0
        self.items: list[int] = []
        self.jsonld: list[str] = []
        self.capture: list[str] | None = None
        self.in_ld = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if a.get("id"):
            self.ids.append(a["id"])
        if tag == "a" and a.get("href"):
            self.hrefs.append(a["href"])
        if tag == "img" and not (a.get("alt") or "").strip():
            self.bad_images += 1
        if tag in ("ul", "ol"):
            self.items.append(0)
        if tag == "li" and self.items:
            self.items[-1] += 1
        if tag in _VOID:
            return
        self.stack.append(tag)
        self.in_ld = tag == "script" and a.get("type") == "application/ld+json"
        if re.fullmatch("h[1-6]", tag):
            self.sections.append({"level": int(tag[1]), "heading": "", "text": []})
        if tag in ("strong", "b", "dfn", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.capture = []

    def handle_endtag(self, tag):
        if tag in _VOID:
            return
        if tag in ("ul", "ol") and self.items and not self.items.pop():
            self.empty_lists += 1
        if self.capture is not None and tag in ("strong", "b", "dfn"):
            t = " ".join("".join(self.capture).split())
            if t:
                self.terms.append(t)
            self.capture = None
        elif self.capture is not None and re.fullmatch("h[1-6]", tag):
            self.sections[-1]["heading"] = " ".join("".join(self.capture).split())
            self.capture = None
        if tag in self.stack:
            while self.stack[-1] != tag:
                self.stack.pop()
                self.unbalanced += 1
            self.stack.pop()
        else:
            self.unbalanced += 1
        self.in_ld = False

    def handle_data(self, data):
        if self.in_ld:
            self.jsonld.append(data)
            return
        if _SKIP & set(self.stack):
            return
        if self.capture is not None:
            self.capture.append(data)
        if not (self.stack and re.fullmatch("h[1-6]", self.stack[-1])):
            self.sections[-1]["text"].append(data)


PAGE = "sections array<struct<level:int,heading:string,text:string>>, terms array<string>, hrefs array<string>, ids array<string>, bad_images int, empty_lists int, unbalanced int, jsonld string"


def parse_page(html: str | None) -> dict:
    p = _Page()
    p.feed(html or "")
    p.close()
    sections = [{"level": s["level"], "heading": s["heading"], "text": " ".join("".join(s["text"]).split())} for s in p.sections]
    good = next((x for x in p.jsonld if _is_json(x)), None)
    return {"sections": [s for s in sections if s["heading"] or s["text"]], "terms": p.terms, "hrefs": p.hrefs, "ids": p.ids, "bad_images": p.bad_images, "empty_lists": p.empty_lists, "unbalanced": p.unbalanced + len(p.stack), "jsonld": good}


def _is_json(x: str) -> bool:
    try:
        json.loads(x)
        return True
    except ValueError:
        return False


def parse_html(df: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """One row a page with its sections, terms, links and faults; null HTML gives empty lists."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([{id_col: i} | parse_page(h) for i, h in zip(pdf[id_col], pdf["_html"])], columns=[id_col, "sections", "terms", "hrefs", "ids", "bad_images", "empty_lists", "unbalanced", "jsonld"])

    return df.select(id_col, F.col(html_col).alias("_html")).mapInPandas(run, f"{id_col} {kind}, {PAGE}")


def page_issues(pages: DataFrame, id_col: str = "id", thin: int = 50) -> DataFrame:
    """(id, check, severity): level skips, missing or empty headings, thin pages, images without text, empty lists, broken anchors, balance, placeholders."""
    levels = F.filter(F.transform("sections", lambda s: s["level"]), lambda x: x > 0)
    text = F.array_join(F.transform("sections", lambda s: F.concat_ws(" ", s["heading"], s["text"])), " ")
    later = F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0)))
    skips = F.exists(F.zip_with(F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), later, lambda a, b: b > a + 1), lambda x: x)
    anchors = F.filter("hrefs", lambda h: h.startswith("#") & (F.length(h) > 1))
    broken = F.exists(anchors, lambda h: ~F.array_contains("ids", F.substr(h, F.lit(2))))
    checks = [
        ("no headings", "warning", F.size(levels) == 0), ("heading level skipped", "warning", skips), ("empty heading", "error", F.exists("sections", lambda s: (s["level"] > 0) & (s["heading"] == ""))),
        ("thin content", "warning", F.regexp_count(text, F.lit(r"\S+")) < thin), ("image without text", "error", F.col("bad_images") > 0), ("empty list", "warning", F.col("empty_lists") > 0),
        ("anchor without target", "error", broken), ("unbalanced tags", "error", F.col("unbalanced") > 0), ("placeholder text", "error", F.lower(text).rlike(r"\[?\btodo\b|lorem ipsum|\btbd\b|\[insert")),
    ]
    rows = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"))) for n, s, c in checks]), lambda x: x.isNotNull())
    return pages.select(id_col, F.explode(rows).alias("i")).select(id_col, "i.*")


def gate(issues: DataFrame, total: int, most_errors: int = 0, least_score: float = 0.8, id_col: str = "id") -> DataFrame:
    """One row: errors, share of pages without an error, whether the gate is passed."""
    bad = issues.where("severity = 'error'")
    g = bad.agg(F.count("*").alias("errors"), F.count_distinct(id_col).alias("bad_pages"))
    score = F.lit(1.0) if total == 0 else 1 - F.col("bad_pages") / total
    return g.select("errors", score.alias("score"), ((F.col("errors") <= most_errors) & (score >= least_score)).alias("passed"))


def parse_markdown(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, block, kind, level, text): front matter, headings, list items, code and paragraphs in order."""
    kind = df.schema[id_col].dataType.simpleString()

    def blocks(text: str):
        lines, i, out = (text or "").split("\n"), 0, []
        if lines and lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
            end = [x.strip() for x in lines[1:]].index("---") + 1
            out.append(("front matter", 0, "\n".join(lines[1:end])))
            i = end + 1
        para: list[str] = []

        def flush():
            if para:
                out.append(("paragraph", 0, " ".join(para)))
                para.clear()

        while i < len(lines):
            line = lines[i]
            if re.match(r"^\s*```", line):
                flush()
                j = next((k for k in range(i + 1, len(lines)) if re.match(r"^\s*```", lines[k])), len(lines))
                out.append(("code", 0, "\n".join(lines[i + 1 : j])))
                i = j + 1
                continue
            if m := re.match(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t\r]*$", line):
                flush()
                out.append(("heading", len(m[1]), m[2]))
            elif m := re.match(r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$", line):
                flush()
                out.append(("item", len(m[1]) // 2 + 1, m[2]))
            elif not line.strip():
                flush()
            else:
                para.append(line.strip())
            i += 1
        flush()
        return out

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(d, n, k, lv, t) for d, x in zip(pdf[id_col], pdf["_t"]) for n, (k, lv, t) in enumerate(blocks(x))], columns=[id_col, "block", "kind", "level", "text"])

    return df.select(id_col, F.col(text_col).alias("_t")).mapInPandas(run, f"{id_col} {kind}, block int, kind string, level int, text string")


def parse_qti(df: DataFrame, id_col: str = "id", xml_col: str = "xml") -> DataFrame:
    """(id, item, stem, choices, correct) of every question; malformed XML gives no rows."""
    kind = df.schema[id_col].dataType.simpleString()
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def items(xml):
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return
        for it in (e for e in root.iter() if local(e) == "item"):
            stem = next((" ".join("".join(e.itertext()).split()) for e in it.iter() if local(e) == "mattext"), "")
            choices = [" ".join("".join(e.itertext()).split()) for e in it.iter() if local(e) == "response_label"]
            correct = [e.text or "" for e in it.iter() if local(e) == "varequal"]
            yield it.get("ident") or "", stem, choices, correct

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(d, *r) for d, x in zip(pdf[id_col], pdf["_x"]) for r in items(x)], columns=[id_col, "item", "stem", "choices", "correct"])

    return df.select(id_col, F.col(xml_col).alias("_x")).mapInPandas(run, f"{id_col} {kind}, item string, stem string, choices array<string>, correct array<string>")


class PackageSource(DataSource):
    """`spark.read.format("course_package").load(path-or-glob)`: a row for each member of zip packages, a partition for each package."""

    @classmethod
    def name(cls) -> str:
        return "course_package"

    def schema(self) -> str:
        return "package string, member string, size long, content binary, lms string"

    def reader(self, schema):
        return _PackageReader(self.options)


class _PackageReader(DataSourceReader):
    """Packages are opened where their task runs, through the file system of pyarrow that the path's scheme names; members are read one at a time."""

    def __init__(self, options) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self):
        import fnmatch

        from pyarrow import fs

        system, path = _file_system(self.path)
        base = path.split("*")[0].rsplit("/", 1)[0] if "*" in path else path
        info = system.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive="*" in path))
        ends = path if "*" in path else path if info.type == fs.FileType.File else path.rstrip("/") + "/*"
        return [InputPartition(x.path) for x in sorted(files, key=lambda x: x.path) if x.type == fs.FileType.File and fnmatch.fnmatch(x.path, ends)]

    def read(self, partition):
        # Marks of learning systems in a package's manifest.
        marks = (("brightspace", "d2l"), ("canvas", "instructure"), ("blackboard", "blackboard"), ("moodle", "moodle"))
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.value) as f, zipfile.ZipFile(f) as z:  # only what is asked for is read from the archive
            manifest = z.read("imsmanifest.xml").decode("utf-8", "replace").lower() if "imsmanifest.xml" in z.namelist() else ""
            lms = next((n for n, m in marks if m in manifest), "generic")
            for info in z.infolist():
                if not info.is_dir() and info.filename.endswith(self.suffix):
                    yield partition.value, info.filename, info.file_size, z.read(info), lms


def _file_system(url: str):
    """(file system, path) of a URL; a path without a scheme is the machine's own."""
    from pyarrow import fs

    if "://" not in url and not url.startswith("file:"):
        return fs.LocalFileSystem(), url
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/")
    scheme, rest = url.split("://", 1)
    host = rest.split("/", 1)[0]
    system, _ = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system, rest if scheme in ("s3", "gs") else "/" + rest.split("/", 1)[-1]


class _Paths(HTMLParser):
    """Every element's path with its number among siblings of its name, attributes and own text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = [["", {}, -1]]
        self.rows: list[list] = []

    def handle_starttag(self, tag, attrs):
        up = self.stack[-1]
        up[1][tag] = up[1].get(tag, 0) + 1
        path = f"{up[0]}/{tag}[{up[1][tag]}]"
        self.rows.append([path, tag, {k: v or "" for k, v in attrs}, ""])
        if tag not in _VOID:
            self.stack.append([path, {}, len(self.rows) - 1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        names = [x[0].rsplit("/", 1)[-1].split("[")[0] for x in self.stack]
        if tag in names[1:]:
            while self.stack.pop()[0].rsplit("/", 1)[-1].split("[")[0] != tag:
                pass

    def handle_data(self, data):
        if self.stack[-1][2] >= 0:
            self.rows[self.stack[-1][2]][3] += data


def xpath_index(df: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, xpath, tag, attributes, text) of every element in order; looked up by an equality on xpath. Null HTML has none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = []
            for i, h in zip(pdf["_i"], pdf["_h"]):
                p = _Paths()
                p.feed(h or "")
                p.close()
                rows += [(i, a, b, c, " ".join(t.split())) for a, b, c, t in p.rows]
            yield pd.DataFrame(rows, columns=[id_col, "xpath", "tag", "attributes", "text"])

    return df.select(F.col(id_col).alias("_i"), F.col(html_col).alias("_h")).mapInPandas(run, f"{id_col} {kind}, xpath string, tag string, attributes map<string,string>, text string")


def textbook_structure(df: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, chapter, section, block, kind, text): headings of the first level begin chapters, of the second sections, of others blocks; other elements with text of their own are blocks.

    Numbers count from 0 within what is above; what stands before the first chapter is chapter -1.
    """
    e = xpath_index(df, id_col, html_col).where("text <> '' and tag not in ('script', 'style', 'title')")
    e = e.withColumn("_n", F.monotonically_increasing_id())  # elements of a page come from one task in order
    w = Window.partitionBy(id_col).orderBy("_n")
    e = e.withColumn("chapter", (F.sum(F.when(F.col("tag") == "h1", 1).otherwise(0)).over(w) - 1).cast("int"))
    e = e.withColumn("section", (F.sum(F.when(F.col("tag") == "h2", 1).otherwise(0)).over(Window.partitionBy(id_col, "chapter").orderBy("_n")) - 1).cast("int"))
    kind = F.when(F.col("tag") == "h1", "chapter").when(F.col("tag") == "h2", "section").when(F.col("tag").rlike("^h[3-6]$"), "heading").when(F.col("tag") == "li", "item").when(F.col("tag").isin("td", "th"), "cell").otherwise("paragraph")
    block = F.row_number().over(Window.partitionBy(id_col, "chapter", "section").orderBy("_n")) - 1
    return e.select(id_col, "chapter", "section", block.alias("block"), kind.alias("kind"), "text")


def topics(pages: DataFrame, id_col: str = "id", least_words: int = 20) -> DataFrame:
    """(id, pos, heading, text, words): the sections of parsed pages that say enough and whose heading says something."""
    s = pages.select(id_col, F.posexplode("sections").alias("pos", "s")).select(id_col, "pos", "s.heading", "s.text")
    s = s.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    return s.where((F.col("words") >= least_words) & ~low_signal_heading(F.col("heading")))


def provenance_marks(df: DataFrame, id_col: str = "id", html_col: str = "html", marks: tuple[str, ...] = ("data-source-id", "data-confidence")) -> DataFrame:
    """(id, sections, marked, passed): how many sections of a page carry each of the attributes that tell where they come from."""
    e = xpath_index(df, id_col, html_col).where("tag = 'section'")
    has = F.lit(True)
    for m in marks:
        has = has & (F.coalesce(F.col("attributes")[m], F.lit("")) != "")
    g = e.groupBy(id_col).agg(F.count("*").alias("sections"), F.count_if(has).alias("marked"))
    return df.select(id_col).join(g, id_col, "left").na.fill(0, ["sections", "marked"]).withColumn("passed", F.col("sections") == F.col("marked"))


# Checks of a page's accessibility, with the criterion each is of.
ACCESS = {
    "image without text": "1.1.1", "heading level skipped": "1.3.1", "empty heading": "1.3.1", "table without headers": "1.3.1", "field without label": "1.3.1", "page without language": "3.1.1", "page without title": "2.4.2",
    "link without text": "2.4.4", "link says nothing": "2.4.4", "frame without title": "4.1.2", "repeated id": "4.1.1", "button without name": "4.1.2",
}


def accessibility(df: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """(id, check, criterion, n): how often a page fails each check of ACCESS that its elements alone can tell."""
    e = xpath_index(df, id_col, html_col)
    a = lambda k: F.coalesce(F.col("attributes")[k], F.lit(""))
    named = (a("aria-label") != "") | (a("aria-labelledby") != "") | (a("title") != "")
    one = {
        "image without text": (F.col("tag") == "img") & ~F.array_contains(F.map_keys("attributes"), "alt"), "empty heading": F.col("tag").rlike("^h[1-6]$") & (F.col("text") == "") & ~named,
        "page without language": (F.col("tag") == "html") & (a("lang") == ""), "link without text": (F.col("tag") == "a") & (a("href") != "") & (F.col("text") == "") & ~named,
        "link says nothing": (F.col("tag") == "a") & F.lower("text").isin("click here", "here", "more", "read more", "link"), "frame without title": (F.col("tag") == "iframe") & (a("title") == ""),
        "button without name": (F.col("tag") == "button") & (F.col("text") == "") & ~named,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in one.items()]), lambda x: x.isNotNull())
    rows = e.select(id_col, F.explode(found).alias("check"))
    ids = e.where(a("id") != "").groupBy(id_col, a("id").alias("x")).count().where("count > 1").select(id_col, F.lit("repeated id").alias("check"))
    labels = e.where((F.col("tag") == "label") & (a("for") != "")).select(id_col, a("for").alias("x")).distinct()
    fields = e.where(F.col("tag").isin("input", "select", "textarea") & ~a("type").isin("hidden", "submit", "button", "reset", "image") & ~named).select(id_col, a("id").alias("x"))
    loose = fields.join(labels, [id_col, "x"], "left_anti").select(id_col, F.lit("field without label").alias("check"))
    tables = e.where("tag in ('table', 'th')").select(id_col, F.regexp_extract("xpath", r"^(.*?/table\[\d+\])", 1).alias("x"), (F.col("tag") == "th").alias("th"))
    bare = tables.groupBy(id_col, "x").agg(F.max("th").alias("th")).where("not th").select(id_col, F.lit("table without headers").alias("check"))
    titled = e.where("tag = 'title' and text <> ''").select(id_col).distinct()
    untitled = e.where("tag = 'html'").select(id_col).distinct().join(titled, id_col, "left_anti").select(id_col, F.lit("page without title").alias("check"))
    rows = rows.unionByName(ids).unionByName(loose).unionByName(bare).unionByName(untitled)
    criterion = F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv])[F.col("check")]
    return rows.groupBy(id_col, "check").agg(F.count("*").alias("n")).withColumn("criterion", criterion)


def accessibility_report(findings: DataFrame, before: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """(id, failures, criteria, fixed): what pages fail; with findings of before their repair, how many went."""
    g = findings.groupBy(id_col).agg(F.sum("n").alias("failures"), F.count_distinct("criterion").alias("criteria"))
    if before is None:
        return g.withColumn("fixed", F.lit(None).cast("long"))
    b = before.groupBy(id_col).agg(F.sum("n").alias("were"))
    j = b.join(g, id_col, "full_outer").na.fill(0, ["were", "failures", "criteria"])
    return j.select(id_col, "failures", "criteria", (F.col("were") - F.col("failures")).alias("fixed"))


def package_findings(members: DataFrame) -> DataFrame:
    """(package, finding) of the members of packages (package, member, size, content): no manifest, resources it names that are not there, empty members."""
    by = members.groupBy("package").agg(F.max(F.when(F.col("member") == "imsmanifest.xml", F.decode("content", "UTF-8"))).alias("xml"))
    lost = by.where("xml is null").select("package", F.lit("no manifest").alias("finding"))
    named = by.where("xml is not null").select("package", F.explode(F.array_distinct(F.regexp_extract_all("xml", F.lit(r'<file[^>]*\shref="([^"#?]+)'), F.lit(1)))).alias("member"))
    gone = named.join(members.select("package", "member"), ["package", "member"], "left_anti").select("package", F.concat(F.lit("missing "), "member").alias("finding"))
    empty = members.where("size = 0").select("package", F.concat(F.lit("empty "), "member").alias("finding"))
    return lost.unionByName(gone).unionByName(empty)


def package_inventory(members: DataFrame) -> DataFrame:
    """(package, pages, quizzes, bytes, passed): what packages hold; one without pages has not passed."""
    is_quiz = F.col("member").endswith(".xml") & F.contains(F.decode("content", "UTF-8"), F.lit("questestinterop"))
    g = members.groupBy("package").agg(F.count_if(F.col("member").rlike(r"\.x?html?$")).alias("pages"), F.count_if(is_quiz).alias("quizzes"), F.sum("size").alias("bytes"))
    return g.withColumn("passed", F.col("pages") > 0)


def slides(sections: DataFrame, keys: list[str], order: str, most: int = 6) -> DataFrame:
    """(keys, slide, title, points): sections (heading, points array) as slides of at most `most` points; one that goes on says so in its title."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("points") / most).cast("int") - 1)), lambda k: F.struct(k.alias("k"), F.slice("points", k * most + 1, F.lit(most)).alias("p")))
    one = sections.select(*keys, F.col(order).alias("_o"), "heading", F.explode(parts).alias("x"))
    title = F.when(F.col("x.k") > 0, F.concat("heading", F.lit(" (continued)"))).otherwise(F.col("heading"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "x.k")) - 1
    return one.select(*keys, n.alias("slide"), title.alias("title"), F.col("x.p").alias("points"))
