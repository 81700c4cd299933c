from parchmill.llm import scans as S


def test_page_figures():
    for line, page in (("- 3 -", 3), ("Page 5 of 8", 5), ("9 | P a g e", 9), ("[12]", 12), ("iv", 4), ("l", 1), ("l0", 10), ("• 11 •", 11), ("Pg. 3", 3)):
        assert S.page_figure(line, page), line
    for line, page in (("1934", 4), ("39,903", 39), ("|", 1), ("Page", 1), ("7 apples", 7), ("x", None), ("3", 4)):
        assert not S.page_figure(line, page), line


def test_skeletons_fold_misreadings():
    assert S.skeleton("Rur@l Dcpartmcnt, Marmangal    4", 4) == S.skeleton("RURAL DEPARTMENT, MARMANGAL", 9)
    assert S.skeleton("APPENDIX 279", 1) != S.skeleton("APPENDIX 12", 1)


def test_stray_marks():
    assert S.stray("~ .") and S.stray("_|") and not S.stray("-----") and not S.stray("a") and not S.stray("") and not S.stray("।")


WORDS = "the water register of every village office was settled before winter and copies were given to members again".split()


def pages(n=60):
    rows = []
    for i in range(n):
        body = [" ".join(WORDS[(i + k) % len(WORDS)] for k in range(j, j + 6)) for j in range(8)]
        clean = " ".join(body) + "."
        rows.append((1000 + i, 7, i, clean + "\n\n" + clean, False, None))
    for i in range(1, 11):
        body = [" ".join(WORDS[(i + k) % len(WORDS)] for k in range(j, j + 6)) for j in range(14)]
        body[4] = "the reg!ster of every vi1lage was"
        body[5] = "settled before win-"
        body[6] = "ter and given to members"
        rows.append((i, 5, i, "\n".join([f"Old Gazette, Water series    {i}", *body, f"- {i} -"]), True, 80.0))
    return rows


def test_noisy_lines_and_repair(spark, frame):
    schema = "page_id long, doc_id long, page_number int, text string, is_ocr boolean, confidence double"
    rows = pages()
    rows += [rows[-1], (500, 9, 1, None, True, None), (501, 9, 2, "  \n ", True, 5.0), (502, None, None, "one line", None, None)]
    df = frame(rows, schema).selectExpr("*", "'clash' as line", "1 as word")
    got = {}
    for r in S.noisy_lines(spark, df).collect():
        got.setdefault((r["page_id"], r["line_no"]), set()).add(r["kind"])
    for i in range(1, 11):
        assert got[i, 0] == {"header"} and got[i, 15] == {"pageno"}
        assert got[i, 5] == {"misread"} and got[i, 6] == {"hyphen"}
    assert {p for p, _ in got} == set(range(1, 11))
    fixed = {r["page_id"]: r["repaired"] for r in S.repair_pages(spark, df).collect()}
    assert "the register of every village was settled before winter and given" in fixed[3] and "Gazette" not in fixed[3] and "- 3 -" not in fixed[3]
    assert fixed[1000] == rows[0][3] and fixed[500] is None


def test_no_pages(spark, frame):
    df = frame([], "page_id long, doc_id long, page_number int, text string, is_ocr boolean, confidence double")
    assert S.noisy_lines(spark, df).count() == 0 and S.repair_pages(spark, df).count() == 0


def test_any_number_of_confusions_in_a_word():
    assert S.path("r|v|d|cu|c", "ridicule") is None
    assert S.path("d!v!s!b!l!ty", "divisibility") == tuple((i, "!", "i") for i in (1, 3, 5, 7, 9))
    assert len(S.path("d!v!s!b!1!+y", "divisibility")) == 7
    p = S.Perceptron({("common" + "False", "replace"): 1.0})
    assert len(S.edit(p, "d!v!s!b!1!+y", [(500, "divisibility"), (1, "d!v!s!b!1!+y")])) == 7


def test_forms_are_shared_by_all_confusions():
    for printed, read in S.PAIRS:
        assert S.form(printed.casefold()) == S.form(read.replace("ſ", "f").casefold()), (printed, read)
    assert S.word_form("oſfice") == S.form("office") and S.path("15", "is") is None and S.path("I", "1") is None


def test_filter_holds_no_word_back(spark):
    words = [f"word{i}" for i in range(5000)]
    bits = S._filter_of(spark.createDataFrame([(w,) for w in words], "word string"))
    assert bits[S._bit(words)].all() and bits.sum() <= 5000
