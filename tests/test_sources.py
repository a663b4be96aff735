import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lattica.operators import external, localise
from lattica.sources import lexicons, readers, writers


def workbook(rows, active=0):
    def sheet(rows):
        cells = lambda r, k: "".join(f'<c r="{chr(65 + i)}{k + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r) if v != "")
        return '<worksheet xmlns="x"><sheetData>' + "".join(f'<row r="{k + 1}">{cells(r, k)}</row>' for k, r in enumerate(rows)) + "</sheetData></worksheet>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="x"><bookViews><workbookView activeTab="{active}"/></bookViews></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(rows))
        z.writestr("xl/worksheets/sheet2.xml", sheet([["term_fa"], ["other"]]))
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook([["term_en", "term_fa", "term_type"], ["one", "Alpha", "kind"], ["", "", ""], ["two", "beta", ""]]))
    (tmp_path / "c.xlsx").write_bytes(workbook([["term_fa"], ["ALPHA"]]))
    (tmp_path / "d.xlsx").write_bytes(workbook([["name"], ["x"]]))
    rows = lexicons.spreadsheet_terms(spark, str(tmp_path))
    assert sorted((r.file, r.row, r.term, r.english, r.category) for r in rows.collect()) == [("b.xlsx", 1, "Alpha", "one", "kind"), ("b.xlsx", 3, "beta", "two", "b"), ("c.xlsx", 1, "ALPHA", "", "c")]
    first, counts = lexicons.first_terms(rows)
    assert sorted((r.normalized, r.file) for r in first.collect()) == [("alpha", "b.xlsx"), ("beta", "b.xlsx")]
    assert {r.category: r.n for r in counts.collect()} == {"kind": 1, "b": 1, "c": 1}
    assert list(lexicons.sheet_rows(workbook([["a"]], active=1))) == [["term_fa"], ["other"]]


def test_rejects_count_the_first_reason(spark):
    rows = spark.createDataFrame([(None, "x"), ("a b", "x"), ("a", "bad"), ("c", "x"), ("d e", "bad")], "name string, grp string")
    kept, counts = lexicons.with_rejects(rows, {"missing": F.col("name").isNull(), "group": F.col("grp") == "bad", "multiword": F.col("name").contains(" ")})
    assert [r.name for r in kept.collect()] == ["c"]
    assert {r.reject_reason: r.n for r in counts.collect()} == {"missing": 1, "group": 2, "multiword": 1, "accepted": 1}


def test_questions_and_literal_answers(spark):
    rows = spark.createDataFrame([("What is it", "{'a': 'two words', 'b': 'one'}"), (" ", '{"a": "three whole words"}'), ("Q", "{broken"), ("R", None)], "question string, answer string")
    assert sorted((r.text, r.weight) for r in lexicons.question_rows(rows).collect()) == [("Q", 3), ("R", 3), ("What is it", 3), ("three whole words", 2), ("two words", 2)]


def test_lists_and_eligible_terms(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# no\n\nBeta Two\nalpha\nbeta  two\n")
    assert [(r.term, r.normalized) for r in lexicons.concept_list(spark, str(tmp_path / "l.txt")).orderBy("place").collect()] == [("Beta Two", "beta two"), ("alpha", "alpha")]
    terms = spark.createDataFrame([("red pill", "drug"), ("pill", "drug"), ("the pill", "drug"), ("a b c d", "drug"), ("x", "other")], "term string, category string")
    general = spark.createDataFrame([("the",), ("red",)], "word string")
    assert sorted(r.term for r in lexicons.eligible(terms, ["drug"], 3, general).collect()) == ["pill", "red pill", "the pill"]
    assert sorted(r.term for r in lexicons.eligible(terms, ["drug"], 3, general, ["pill"]).collect()) == []
    assert sorted(r.term for r in lexicons.eligible(terms, ["drug"], 1).collect()) == ["pill"]


def test_corpus_is_built_beside_and_checked_when_opened(spark, tmp_path):
    rows = spark.createDataFrame([("d", "s1", "One two. Three four five.", 2), ("d", "s2", "one TWO! Six seven.", 1), ("e", "s1", "word", 1)], "domain string, source string, text string, weight int")
    path = str(tmp_path / "corpus")
    for _ in range(2):
        sources = writers.build_corpus(rows, path, 3)
    assert {(r.domain, r.source): r.unique_sentences for r in sources.collect()} == {("d", "s1"): 2, ("d", "s2"): 1}
    got = lexicons.open_corpus(spark, path, ["sentences", "ngrams", "sources"], 3)
    assert {(r.gram, r.n): r.n_count for r in got["ngrams"].collect()}[("one two", 2)] == 2 and spark.read.json(f"{path}/lines").count() == 3
    assert not (tmp_path / "corpus.building").exists() and not (tmp_path / "corpus.old").exists()
    with pytest.raises(ValueError, match="version"):
        lexicons.open_corpus(spark, path, ["sentences"], 4)
    spark.createDataFrame([], "x int").write.parquet(f"{path}/nothing")
    with pytest.raises(ValueError, match="nothing"):
        lexicons.open_corpus(spark, path, ["nothing"], 3)


def test_cache_and_fetch(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "q string")
    cache = spark.createDataFrame([("a", 1000.0), ("b", 1000.0 - 8 * 86400)], "q string, fetched_at double")
    missing = lexicons.cache_misses(asked, cache, "q", F.lit(1000.0), 7)
    assert sorted(r.q for r in missing.collect()) == ["b", "c"]

    def fetch(q):
        if q == "c":
            raise lexicons.Busy(0)
        return q.upper()

    assert [tuple(r) for r in lexicons.fetched(missing, "q", fetch, 5.0, sleep=lambda s: None).collect()] == [("b", "B", 5.0)]


def test_writers_of_results(spark, tmp_path):
    segments = spark.createDataFrame([("r1", 1.0, 2.0, " hi "), ("r1", 0.0, 1.0, "ho"), ("r2", 0.0, 1.0, " ")], "run string, start double, end double, text string")
    writers.write_transcripts(segments, str(tmp_path / "t"))
    text = lambda kind: "".join(p.read_text() for p in sorted((tmp_path / "t" / kind / "run=r1").glob("part-*")))
    assert text("srt") == "1\n00:00:00,000 --> 00:00:01,000\nho\n\n2\n00:00:01,000 --> 00:00:02,000\nhi\n\n" and text("vtt").startswith("WEBVTT\n\n00:00:00.000") and text("txt") == "ho\nhi\n"
    decided = spark.createDataFrame([("k", "ACCEPT"), ("k", "REVIEW"), ("j", "REJECT")], "key string, verdict string")
    assert writers.write_results(decided, str(tmp_path / "r"), ["key"]).first().asDict() == {"slots": 3, "accept": 1, "review": 1, "reject": 1, "keep_source": 0}
    writers.comparison(decided, str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part-*")).read_bytes() == b"\xef\xbb\xbfkey,verdict\nj,REJECT\nk,ACCEPT\nk,REVIEW\n"
    terms = spark.createDataFrame([("a", "x"), ("b", "x")], "term string, category string")
    assert writers.write_lexicon(terms, terms.limit(0), str(tmp_path / "l")).collect()[0].n == 2
    plan = writers.clip_plan(spark.createDataFrame([("k", 3.0, 4.0), ("k", 0.5, 1.0)], "key string, start double, end double"), 1, 1.0).collect()
    assert [tuple(r) for r in plan] == [("k", 1, 0.0, 2.0)]


def test_latest_result(spark):
    rows = spark.createDataFrame([("r", "V2", 1), ("r", "V9", 0), ("r", "V9", 2), ("s", "zz", 1), ("s", "yy", 1)], "run string, version string, at int")
    assert sorted(tuple(r) for r in readers.latest_result(rows, "run", "version", ["V9", "V2"], "at").collect()) == [("r", "V9", 2), ("s", "yy", 1)]


def test_clips_are_shifted(spark):
    kind = "offset double, segments array<struct<id: int, start: double, end: double, words: array<struct<start: double, end: double, word: string>>>>"
    rows = spark.createDataFrame([(10.0, [(7, 0.0, 1.0, [(0.0, 0.5, "a")]), (9, 1.0, 2.0, None)]), (5.0, None)], kind)
    got = [r.segments for r in readers.shifted(rows, "offset").collect()]
    assert [(s.id, s.start, s.end) for s in got[0]] == [(0, 10.0, 11.0), (1, 11.0, 12.0)] and got[0][0].words[0].end == 10.5 and got[1] is None


def test_models_are_checked(spark):
    tasks = spark.createDataFrame([("1", ["a", "b"], [0.1, 0.9], "z"), ("2", ["c"], [1.0], "y")], "id string, options array<string>, scores array<double>, fallback string").coalesce(1)
    got = lambda chooser: {r.id: (r.choice, r.source) for r in external.chosen(tasks, chooser).collect()}
    assert got(external.best_option) == {"1": ("b", "chooser"), "2": ("c", "chooser")}
    assert got(lambda t: {"1": "a", "2": "q"}) == {"1": ("a", "chooser"), "2": ("y", "fallback")}
    assert got(lambda t: {"1": "a"}) == got(lambda t: {"1": "a", "2": "c", "3": "x"}) == got(lambda t: 1 / 0) == {"1": ("z", "fallback"), "2": ("y", "fallback")}
    rows = spark.createDataFrame([(1, "One. Two. Three. Four."), (2, None)], "k int, text string")
    assert {r.k: (r.summary, r.source) for r in external.written(rows, "k").collect()} == {1: ("One. Two. Three.", "writer"), 2: ("", "fallback")}
    assert {r.source for r in external.written(rows, "k", lambda t: 1 / 0).collect()} == {"fallback"}
    vectors = {r.k: r.embedding for r in external.encoded(rows, "k").collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-6 and set(vectors[2]) == {0.0}


def test_places_are_found_and_replaced_from_the_right(spark):
    text = "she took twenty five of the blue pills and then twenty nine of the red ones".split()
    assert localise.place_of(text, ["blue", "pils"]) == (6, 8)
    assert localise.place_of("one two one two".split(), ["one", "two"]) is None  # two places, equally good
    assert localise.place_of(text, ["nothing", "like", "it"]) is None
    assert localise.place_of("a one two b one two c".split(), ["one", "two"], ["b"], ["c"]) == (4, 6)
    changed, made = localise.replaced(text, [(["blue", "pils"], ["white", "big", "pills"], [], []), (["red"], ["green"], ["of", "the"], ["ones"]), (["xyz"], ["q"], [], [])])
    assert made == 2 and " ".join(changed) == "she took twenty five of the white big pills and then twenty nine of the green ones"
    rows = spark.createDataFrame([(1, "a blue pil b", [("blue pill", "red", "", "")]), (2, None, None)], "k int, text string, changes array<struct<phrase: string, new: string, left_context: string, right_context: string>>")
    assert sorted(tuple(r) for r in localise.projected(rows, "k").collect()) == [(1, "a red b", 1, 1), (2, "", 0, 0)]
