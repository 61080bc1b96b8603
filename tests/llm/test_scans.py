from legajo.llm.scans import ScanRepair, misread_of, misread_words, open_part, page_line, skeleton

SCHEMA = "chunk_id string, source string, chunk_index int, content string, anchors array<struct<page_number int, start_char int, end_char int>>, kind string"


def test_confusions():
    for true, seen in (("reforma", "reforrna"), ("medida", "mcclida"), ("quedó", "qued6"), ("años", "afios"), ("internet", "intemet"), ("rural", "rura1")):
        assert misread_of(true, seen) and not misread_of(true, true)
    assert not misread_of("el", "d") and not misread_of("casa", "cosa")
    assert skeleton("reforrna") == skeleton("reforma") == skeleton("rcforma")


def test_page_lines():
    assert page_line("— l2 —") == ("framed digits", 12) and page_line("Página 7") == ("word digits", 7) and page_line("xiv") == ("bare roman", 14) and page_line("Pág. 3 de 2l8") == ("word digits", 3)
    assert page_line("57.815") is None and page_line("de 2024") is None and page_line("mil") is None


def _document():
    """Pages with a header, a bare number two more than the page, a broken word and a table cell."""
    rows = []
    own = "almendro bosque cafetal dintel escollo farola granero huerta".split()
    for page, word in enumerate(own, 1):
        body = ["La reforma del plan rural sigue en la vereda y la co-", "munidad espera agua potable para la comunidad.", "37", "El acuerdo costo-", "beneficio del plan rural quedó sin la comunidad."]
        if page == 3:
            body[1] = "munidad espera agua potab1e para la comunidad."
        rows.append("\n".join(["Plan Territorial 2024", f"El {word} abre.", *body, f"Un {word} verde.", f"Otro {word} azul.", str(page + 2)]))
    return [(f"c{i:02d}", "s", i, text, [(i + 1, 0, len(text))], "z") for i, text in enumerate(rows)]


def test_a_document(spark):
    found = ScanRepair(spark.createDataFrame(_document(), SCHEMA))
    got = {(r.chunk_id, r.line_no, r.kind) for r in found.found().collect()}
    expected = {(f"c{i:02d}", 1, "header") for i in range(8)} | {(f"c{i:02d}", 10, "page_number") for i in range(8)} | {(f"c{i:02d}", 3, "hyphen") for i in range(8)} | {("c02", 4, "misread")}
    assert got == expected
    texts = {(r.chunk_id, r.paragraph_no): r.text for r in found.paragraphs().collect()}
    assert "y la comunidad espera agua potable para" in texts[("c02", 1)] and "Territorial" not in texts[("c02", 1)] and "costo- beneficio" in texts[("c02", 1)]


def test_a_word_broken_across_chunks(spark):
    rows = [("a", "s", 0, "La comunidad espera.\nVino la comu-", None, "z"), ("b", "s", 1, "nidad de agua y la comunidad.", [], "z")]
    got = {(r.chunk_id, r.line_no, r.kind) for r in ScanRepair(spark.createDataFrame(rows, SCHEMA)).found().collect()}
    assert got == {("a", 2, "hyphen")}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "s", 0, "x", None, "z"), ("a", None, 0, "x", None, "z"), ("b", "s", None, None, None, "z"), ("c", "s", None, "", None, "z"), ("d", "s", 3, "hola a todos", [(None, None, None)], None), ("d", "s", 3, "hola a todos", None, None)]
    repair = ScanRepair(spark.createDataFrame(rows, SCHEMA))
    assert repair.found().count() == 0
    assert [r.text for r in repair.paragraphs().collect()] == ["hola a todos"]
    assert ScanRepair(spark.createDataFrame([], SCHEMA)).found().count() == 0


def _counts(spark, counts):
    return spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n bigint, m bigint")


def test_every_form_is_held_against_the_others(spark):
    """A true word that is only the fourth of its group by frequency still corrects its misreading."""
    counts = _counts(spark, {"bola": 90, "bo1a": 60, "boia": 50, "boja": 40, "hola": 30, "h0la": 2})
    lines = spark.createDataFrame([(["dijo", "h0la", "vecino"],), (["dijo", "hola", "vecino"],)], "words array<string>")
    assert {r.word: r.correction for r in misread_words(counts, lines).collect()}["h0la"] == "hola"


def test_neighbours_decide(spark):
    """Of two forms that a word may be a misreading of, the one beside the same neighbours is chosen; a scarce form needs them."""
    counts = _counts(spark, {"fila": 20, "tila": 40, "fi1a": 1, "reforma": 3, "reforrna": 1, "lecho": 3, "1ccho": 2, "lccho": 1})
    lines = spark.createDataFrame([(["en", "fi1a", "de"],), (["en", "fila", "de"],), (["té", "tila", "y"],), (["la", "reforrna", "rural"],), (["la", "reforma", "rural"],), (["un", "lccho", "así"],), (["su", "lecho", "es"],)], "words array<string>")
    got = {r.word: r.correction for r in misread_words(counts, lines).collect()}
    assert got["fi1a"] == "fila" and got["reforrna"] == "reforma" and "lccho" not in got
    swapped = lines.selectExpr("transform(words, w -> case w when 'fila' then 'tila' when 'tila' then 'fila' else w end) as words")
    assert {r.word: r.correction for r in misread_words(counts.where("word like '_i_a'"), swapped).collect()} == {"fi1a": "tila"}


def test_long_words_and_lines():
    assert open_part("x" * 100 + "-") == "x" * 100 and open_part("costo —") is None and open_part("a¬  ") == "a" and open_part("") is None
    assert page_line("— " * 30 + "7 " + "— " * 30) == ("framed digits", 7) and page_line("9" * 5000) is None


def test_skeletons_agree(spark):
    words = ["reforma", "años", "quedó", "mundo", "mil1ones", "wínd", "ﬁx", "straße"]
    from legajo.llm.scans import _skeleton_column

    df = spark.createDataFrame([(w,) for w in words], "word string").withColumn("s", _skeleton_column("word"))
    assert {r.word: r.s for r in df.collect()} == {w: skeleton(w) for w in words}
