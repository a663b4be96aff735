"""Operators of what stands around a row: empty tables, nulls, ties and repeated rows."""

from pyspark.sql import functions as F

from lattica.operators import context as C


def test_lead_frame_and_following(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 1, "b")], "k int, at int, v string")
    framed = {(r.k, r.at): r.frame for r in C.lead_frame(rows, ["k"], ["at"], "v", 2).collect()}
    assert framed == {(1, 1): ["b"], (1, 2): ["b"], (1, 3): [], (2, 1): []}
    found = {(r.k, r.at): r.following for r in C.first_following(rows, ["k"], ["at"], F.col("v") == "b", "at").collect()}
    assert found == {(1, 1): 3, (1, 2): 3, (1, 3): None, (2, 1): None}
    assert C.first_following(rows.limit(0), ["k"], ["at"], F.col("v") == "b", "at").count() == 0


def test_echoes_go_only_between_equal_rows(spark):
    rows = spark.createDataFrame([(1, n, v) for n, v in enumerate(["a", "a", "a", "b", None, "b"])], "k int, at int, v string")
    assert [r.rewritten for r in C.without_echoes(rows, ["k"], ["at"], "v").orderBy("at").collect()] == ["a", None, "a", "b", None, "b"]


def test_local_evidence_counts_families_once(spark):
    rows = spark.createDataFrame([("x", ["a", "b", "a", "b"]), ("y", ["a", "b"]), ("y", []), ("z", ["a"]), ("z", None)], "family string, toks array<string>")
    assert {(r.gram, r.n_count, r.n_families) for r in C.local_evidence(rows, 2).collect()} == {("a b", 3, 2)}


def test_vocabulary(spark):
    rows = spark.createDataFrame([("a",)] * 9 + [("b",)], "tok string")
    assert {(r.tok, r.n_count, round(r.zipf, 3), r.is_member) for r in C.vocabulary(rows).collect()} == {("a", 9, 8.954, True), ("b", 1, 8.0, True)}
    assert C.vocabulary(rows.limit(0)).count() == 0


def test_columns(spark):
    rows = spark.createDataFrame([("card", "cardio", 3, 0, 0), ("ca", "card", 0, 0, 1), (None, "card", 0, 0, 0)], "a string, b string, u long, v long, w long")
    got = rows.select(C.prefix_overlaps(F.col("a"), F.col("b")).alias("p"), F.round(C.corpus_bonus(F.col("u"), F.col("v"), F.col("w")), 4).alias("c"), C.domain_mix(F.col("u"), F.col("w")).alias("m")).collect()
    assert [tuple(r) for r in got] == [(True, 0.0, 0.76), (False, 0.1629, 0.55), (None, 0.0, 0.25)]


def test_vote_gate_and_caps(spark):
    rows = spark.createDataFrame([(1, "a", 2, 5.0), (2, "a", 2, 5.0), (2, "b", 1, 9.0)], "slot int, candidate string, families int, score double")
    assert {(r.slot, r.candidate, r.gated) for r in C.vote_gate(rows, ["slot"]).collect()} == {(1, "a", 6.5), (2, "a", 5.0)}
    assert [r.candidate for r in C.capped(rows, ["slot"], [F.desc("score"), F.asc("candidate")], 1, 1).collect()] == ["b"]


def test_alternatives_and_ordered_text(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "key string"), spark.createDataFrame([("x",)], "key string")
    assert {(r.key, r.n, tuple(r.families)) for r in C.alternatives({"a": a, "b": b}).collect()} == {("x", 3, ("a", "b")), ("y", 1, ("a",))}
    pairs = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (1, 1, "early")], "k int, at int, v string")
    assert [tuple(r) for r in C.ordered_text(pairs, ["k"], ["at"], "v").collect()] == [(1, 3, "early early late")]
