from loomspark.llm import scanned as S, spam as Z

LEX = "the a of soil water table and handbook drainage tile measures compost pile well-known post-test pre test committee listing lists list plan small review reviewers group groups notes summary sky main again first then they read it".split()
SPAM = "cheap plan cheap plan review cheap plan coupon cheap plan. " * 6
PROSE = "The committee reads the notes before the first group lists what they found in the table, and then it is discussed again. "


def test_confusions_and_joint_decoding():
    lex = S.Lexicon(LEX)
    for seen, right in (("5oil", "soil"), ("tabIe", "table"), ("lisfs", "lists"), ("sumrnary", "summary"), ("smaU", "small"), ("rcview", "review")):
        assert lex.repair(seen.lower())[0] == right, seen
    stream = [("A", False), ("com¬", True), ("mittee", False), ("of", False), ("the", False), ("well-", True), ("known", False), ("pre-", True), ("and", False), ("post-test", False), ("soilwater", False), ("ta", False), ("ble", False), ("re-", True), ("vlew.", False)]
    got = [(k, w) for _, _, k, w in S.decode(stream, lex) if k != "word"]
    assert got == [("hyphen", "committee"), ("hyphen", "well-known"), ("suspended", "pre"), ("split", "soil water"), ("merge", "table"), ("hyphen+misread", "review")]


def pages(n=6):
    rows, no = [], 0
    for p in range(1, n + 1):
        # one running line is damaged; one page's foot has grown into the last block
        parts = ["Handb0ok of Drainage" if p == 3 else "Handbook of Drainage", f"The {LEX[p]} committee measures the {LEX[p + 5]} and the com-" if p % 2 else f"they list the {LEX[p]} again, and the group reads the sum-", f"mittee lists the {LEX[p + 9]} table." if p % 2 else f"mary of the {LEX[p + 7]} notes first.", f"The {LEX[p + 3]} reviewers read the rcview and", f"then the {LEX[p + 8]} is the small group"]
        foot = f"- {p} -"
        blocks = [parts[0], "\n".join(parts[1:3]), "\n".join(parts[3:5]) + ("\n" + foot if p == 4 else "")] + ([foot] if p != 4 else [])
        for t in blocks:
            rows.append((f"b{no}", "f.pdf", p, no, None, "x", None, t))
            no += 1
    return rows + [rows[1], ("null", "f.pdf", n, no, None, "x", None, None), (None, "f.pdf", n, no, None, "x", None, "text")]


BLOCKS = "block_id string, source_pdf string, page int, block_no int, bbox array<double>, extractor string, extractor_hint string, text string"
SPANS = "span_id string, source_pdf string, page int, span_no int, bbox array<double>, text string, font_size double, font_name string, is_bold boolean, is_italic boolean"


def test_defects_and_paragraphs(spark):
    blocks, spans, lexicon = spark.createDataFrame(pages(), BLOCKS), spark.createDataFrame([], SPANS), spark.createDataFrame([(w,) for w in LEX], "word string")
    got = {(r.record_id, r.defect, r.word) for r in S.scan_defects(blocks, spans, lexicon).collect()}
    texts = {r[0]: r[7] for r in pages() if r[0]}
    assert {i for i, k, _ in got if k == "running_line"} == {i for i, t in texts.items() if t and "of Drainage" in t}
    assert {i for i, k, _ in got if k == "page_number"} == {i for i, t in texts.items() if t and "- " in t.split("\n")[-1] and t.split("\n")[-1].startswith("-")}
    assert {(i, w) for i, k, w in got if k == "hyphen"} == {(i, "committee" if "com-" in t else "summary") for i, t in texts.items() if t and ("com-" in t or "sum-" in t)}
    assert {(i, w) for i, k, w in got if k == "misread"} == {(i, "review") for i, t in texts.items() if t and "rcview" in t}
    paragraphs = [r.text for r in S.scan_paragraphs(blocks, spans, lexicon).orderBy("seq", "line_no").collect()]
    assert not any("Drainage" in p or "- 3 -" in p for p in paragraphs)
    assert any(f"is the small group they list the {LEX[2]} again, and the group reads the summary of the {LEX[9]} notes first." in p for p in paragraphs)
    assert all("rcview" not in p for p in paragraphs)


def test_empty_scans(spark):
    empty = spark.createDataFrame([], BLOCKS), spark.createDataFrame([], SPANS), spark.createDataFrame([], "word string")
    assert S.scan_defects(*empty).count() == 0 and S.scan_paragraphs(*empty).count() == 0


def test_spam_shares():
    words = Z._Words()
    share = lambda t: Z.spam_share(t, words, 0.35)
    assert share(SPAM) > 0.95 and share(PROSE * 4) == 0
    assert share("#cheap #plan #coupon #diploma #template #answers #online #best #review #buy #tutor") > 0.9
    assert share("\n".join(f"https://www.site{i}.example/page/{i}" for i in range(12))) > 0.9
    assert share("Measurements\n" + "\n".join(f"{i}\t{i * 1.7:.1f}\t{i * 31}\t0.{i}51" for i in range(20))) < 0.2
    assert share("\n".join(f"soil water {i}: the {w} measures the water of the table while they read it." for i, w in enumerate("abcdef"))) < 0.2
    assert share("The song goes on and we sing it all again.\n" * 8) < 0.2
    assert 0.3 < share(PROSE * 3 + "\n" + SPAM) < 0.7
    assert share("相似三角形在练习里说明小调音阶。 如果没有课堂，土壤层次就不能说明主题句。 " * 3) == 0
    assert share("a heading outline with heading outline review or the heading outline and cheap heading outline for your heading outline, our heading outline, " * 3) > 0.9


def test_spam_operator(spark):
    rows = [(1, SPAM, 9), (2, PROSE * 5, 9), (3, None, 9), (4, " \n", 9), (1, SPAM, 9), (None, SPAM, 9), (7, PROSE * 400 + "\n" + SPAM, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spam_share int")
    got = [(r.doc_id, r.is_spam) for r in Z.spam_pages(df).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, True), (None, True), (2, False), (7, False)], key=str)
    assert Z.spam_pages(df.limit(0)).count() == 0


def test_spam_of_the_whole_page(spark):
    words = Z._Words()
    usual = Z.USUAL | {"function": 0.38}
    share = lambda t: Z.spam_share(t, words, usual)
    cycle = "buy cheap running shoes for men and women online at best price"  # its words come back after twelve
    assert share((cycle + ", ") * 60) > 0.95 and share((cycle + "\n") * 60) > 0.9
    assert 0.3 < share(PROSE * 6 + "\n" + (cycle + ", ") * 14) < 0.7
    tags = [f"{a} {b} {c}" for a in ("oak", "steel", "linen", "glass") for b in ("lamp for", "desk of", "shelf and", "chair in") for c in ("hall", "yard", "attic", "porch")]
    assert share("; ".join(tags)) > 0.9  # separators at many times the usual rate
    # what lessons repeat is none: a refrain of many lines, one sentence form with other words
    assert share("The song goes on and we sing it all again.\n" * 80) == 0
    assert share("\n".join(f"They measure the {a} of the {b} and then it is drawn on the table." for a in LEX[:8] for b in LEX[8:14])) < 0.2
    got = Z.page_measures((cycle + ", ") * 10, words)
    assert got[0] == "en" and got[1] == 120 and abs(got[2]["top"] - 1 / 9) < 1e-9 and abs(got[2]["gram"] - 106 / 118) < 1e-9 and abs(got[2]["separator"] - 10 / 120) < 1e-9
    rows = [(i, PROSE * 5) for i in range(9)] + [(9, (cycle + ", ") * 60)]
    assert [r.doc_id for r in Z.spam_pages(spark.createDataFrame(rows, "doc_id long, text string")).where("is_spam").collect()] == [9]


def test_a_long_paragraph_is_not_cut():
    lines = [{"text": "the committee reads the notes of the group", "rec": f"b{i // 17}", "page": 1} for i in range(150)]
    assert S.paragraph_starts(lines) == [0]
    assert S.paragraph_starts(lines + [{"text": "Then it ended.", "rec": "c", "page": 1, "after_break": True}]) == [0]
    lines[99]["text"] = "the notes end here."
    lines[100]["text"] = "Then the committee reads the notes of the group"
    assert S.paragraph_starts(lines) == [0, 100]


# course prose in languages that no list knows
RUSSIAN = "Преподаватель объясняет, как корни растений берут воду из почвы, и группа записывает результаты в тетрадь. После этого студенты сравнивают таблицы и обсуждают, почему уровень воды не был одинаковым на всех участках. На следующей неделе они измеряют его ещё раз и пишут короткий отчёт о том, что изменилось."
POLISH = "Nauczyciel wyjaśnia, jak korzenie roślin pobierają wodę z gleby, a grupa zapisuje wyniki w zeszycie. Potem studenci porównują tabele i mówią o tym, dlaczego poziom wody nie był taki sam na każdym polu. Za tydzień mierzą go po raz drugi i piszą krótki raport o tym, co się zmieniło."
ARABIC = "يشرح المعلم كيف تأخذ جذور النبات الماء من التربة، ثم تكتب المجموعة النتائج في الدفتر. بعد ذلك يقارن الطلاب الجداول في الصف ويناقشون لماذا لم يكن مستوى الماء هو نفسه في كل حقل. في الأسبوع التالي من الفصل يقيسونه مرة أخرى ويكتبون تقريرا قصيرا عن ما تغير."
JAPANESE = "先生は植物の根がどのように土から水を吸い上げるかを説明し、班の生徒は結果をノートに書きます。そのあと、表を比べながら、水位がすべての畑で同じではなかった理由を話し合います。来週はもう一度測って、変わったことについて短い報告を書きます。"


def test_prose_of_languages_without_a_list(spark):
    words = Z._Words()
    for prose in (RUSSIAN, POLISH, ARABIC, JAPANESE):
        for text in (prose, prose * 2, prose.replace(". ", ".\n"), "Wk 1\n" + prose):
            assert Z.spam_share(text, words, 0.38) == 0, text[:40]
    # spam in them is still spam
    assert Z.spam_share("купить диплом дешево скидка купить диплом онлайн дешево скидка купить " * 8, words, 0.38) > 0.9
    assert Z.spam_share(RUSSIAN * 2 + "\n" + "купить диплом дешево скидка купить диплом онлайн дешево скидка " * 14, words, 0.38) > 0.5
    rows = [(i, f"{RUSSIAN} {i}") for i in range(60)] + [(100 + i, f"{PROSE * 3} {i}") for i in range(60)] + [(900, "купить диплом дешево скидка купить диплом онлайн дешево скидка купить " * 8), (901, SPAM)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in Z.spam_pages(df).where("is_spam").collect()) == [900, 901]
    learned = Z.learn_function_words(df)
    assert list(learned) == ["cyrillic"] and {"и", "как", "из", "не"} <= set(learned["cyrillic"])
    assert set(Z.calibrate(df, learned=learned)) >= {"en", "cyrillic"}


def test_stretches_are_read_as_characters():
    lex = S.Lexicon(LEX + ["accessibility", "method"])
    read = lambda *tokens: [(k, w) for _, _, k, w in S.decode(list(tokens), lex) if k != "word"]
    assert read(("acc", False), ("essi", False), ("bility", False)) == [("merge", "accessibility")]
    assert read(("methodreviewcommittee", False)) == [("split", "method review committee")]
    assert read(("methodrcview", False)) == [("split", "method review")]
    assert read(("the", False), ("acc", False), ("essi-", True), ("bi1ity", False)) == [("resegmented", "accessibility")] or read(("acc", False), ("essi-", True), ("bi1ity", False)) == [("merge", "accessibility")]
    assert read(("zzyx", False), ("qwrk", False)) == [("other", "zzyx"), ("other", "qwrk")]
    long = "committee" * 6  # longer than what is searched by trial
    assert read((long, False)) == [("split", " ".join(["committee"] * 6))]
    wide = S.Lexicon(["incomprehensibilitiesandmisinterpretations"])
    assert wide.repair("incornprehensibilitiesandmisinterpretati0ns")[0] == "incomprehensibilitiesandmisinterpretations"


def test_records_without_a_page_are_spread(spark):
    spans = spark.createDataFrame([(f"s{i}", "f.pdf", None, i if i % 2 else None, None, f"the committee reads the notes {i}", 10.0, "x", False, False) for i in range(4000)], SPANS)
    win = S._windows(spark.createDataFrame([], BLOCKS), spans)
    most = win.where("core").groupBy("file", "win").count().agg({"count": "max"}).first()[0]
    assert most <= S.LINES and win.where("core").count() == 4000
    lexicon = spark.createDataFrame([(w,) for w in LEX], "word string")
    assert S.scan_defects(spark.createDataFrame([], BLOCKS), spans.limit(50), lexicon).count() >= 0
