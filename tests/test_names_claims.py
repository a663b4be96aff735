import random

from pyspark.sql import functions as F

from lattica.functions import similarity as S
from lattica.functions import text as T
from lattica.operators import claims, fuzzy, grounding, intervals, lattice, names, retrieval, slots


def first(c):
    return F.substring(c, 1, 1)


def test_fuzzy_vote_collapses_aliases_and_needs_two_families(spark):
    terms = spark.createDataFrame([("aspirin", "a", True), ("aspirine", "a", True), ("tablet", "t", False), ("tablets", "t", False)], "term string, identity string, is_strict boolean")
    rows = [(1, "f1", "aspirin"), (1, "f2", "aspirine"), (1, "f1", "tablex"), (2, "f1", "aspirin"), (2, "f1", "aspirine"), (3, "f1", "tablat"), (3, "f2", "tablet"), (4, None, None)]
    observed = spark.createDataFrame(rows, "slot int, family string, token string")
    got = {r.slot: (r.identity, r.families) for r in names.fuzzy_vote(observed, terms, names.edit_similarity, first, ["slot"], 0.95, 0.8).collect()}
    assert got == {1: ("a", 2), 3: ("t", 2)}
    assert names.fuzzy_vote(observed.limit(0), terms, names.edit_similarity, first, ["slot"]).count() == 0


def test_frames_equal_a_plain_search(spark):
    rng = random.Random(2)
    texts = [[rng.choice("abcx") for _ in range(rng.randint(0, 25))] for _ in range(30)]
    rows = spark.createDataFrame([(k, p, t) for k, ts in enumerate(texts) for p, t in enumerate(ts)], "k int, pos int, tok string")
    got = {(r.k, r.at_0): (r.at_1, r.at_2) for r in names.frames(rows, ["k"], [["a"], ["b"], ["c"]], [4, 3]).collect()}
    want = {}
    for k, ts in enumerate(texts):
        for i, t in enumerate(ts):
            chains = [(j, m) for j in range(i + 1, min(len(ts), i + 5)) if ts[j] == "b" for m in range(j + 1, min(len(ts), j + 4)) if ts[m] == "c"]
            if t == "a" and chains:
                want[k, i] = min(chains)
    assert got == want


def test_phrase_support_equals_all_windows(spark):
    texts = [(1, "f", "take the blue pil now"), (1, "g", "the bleu pill"), (2, "f", "blue pill"), (2, "g", "nothing of it"), (3, "f", "")]
    rows = spark.createDataFrame([(k, f, t.split()) for k, f, t in texts], "k int, family string, toks array<string>")
    phrases = spark.createDataFrame([("blue pill",), ("nothing",)], "phrase string")
    got = {(r.k, r.phrase): (r.families, r.supported) for r in names.phrase_support(phrases, rows, ["k"], names.edit_similarity).collect()}
    assert got == {(1, "blue pill"): (2, True), (2, "blue pill"): (1, False), (2, "nothing"): (1, False)}


def test_best_alias_and_suffixes(spark):
    lexicon = spark.createDataFrame([("metformin", "m"), ("metformine", "m"), ("metoprolol", "p")], "alias string, identity string")
    heard = spark.createDataFrame([("metformin",), ("metforin",), ("meto",), (None,)], "heard string")
    got = {(r.heard, r.rank): (r.identity, r.alias, r.accepted) for r in names.best_aliases(heard, lexicon, names.edit_similarity).collect()}
    assert got[("metformin", 1)] == ("m", "metformin", True) and got[("metforin", 1)] == ("m", "metformin", True)
    r = spark.range(1).select(names.without_suffix(F.lit("walking"), ["ing", "s"]).alias("a"), names.without_suffix(F.lit("king"), ["ing"]).alias("b")).first()
    assert (r.a, r.b) == ("walk", "king")


def test_unsupported_fuzzy(spark):
    claim = spark.createDataFrame([(1, "tablet"), (1, "moon"), (2, "moon"), (3, None)], "k int, tok string")
    evidence = spark.createDataFrame([(1, "tablets"), (2, "moon"), (1, "x")], "k int, tok string")
    assert sorted((r.k, r.tok) for r in names.unsupported_fuzzy(claim, evidence, ["k"], names.edit_similarity).collect() if r.tok) == [(1, "moon")]


def test_pair_hits_equal_all_documents(spark):
    rng = random.Random(3)
    docs = [(k, [rng.choice("abcdef") for _ in range(rng.randint(1, 9))]) for k in range(40)]
    index = retrieval.postings(spark.createDataFrame(docs, "id int, toks array<string>"))
    pairs = spark.createDataFrame([("a", "b"), ("c", "a"), ("z", "a")], "a string, b string")
    got = {}
    for r in retrieval.pair_hits(index, pairs, 100).collect():
        got.setdefault((r.a, r.b), set()).add(r.id)
    assert got == {(a, b): {k for k, t in docs if a in t and b in t} for a, b in (("a", "b"), ("c", "a"))}
    stats = retrieval.statistics(index).first()
    assert stats.n_docs == 40 and abs(stats.avg_dl - sum(len(t) for _, t in docs) / 40) < 1e-9


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_the_table(spark):
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert claims.common_subsequence(a, b) == plain_lcs(a, b)
    rows = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["a"]), (["a"], None), (None, None)], "x array<string>, y array<string>")
    assert [r.c for r in rows.select(claims.ordered_coverage("x", "y").alias("c")).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_composite_similarity(spark):
    pairs = [("pill", "pill"), ("", "x"), ("bat", "pad"), ("walked", "walks"), ("abc", "xyz")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.composite(F.col("a"), F.col("b"), T.latin_key, F.substring("a", 1, 4) == F.substring("b", 1, 4)).alias("s"))
    got = {(r.a, r.b): r.s for r in got.collect()}
    assert got["pill", "pill"] == 1 and got["", "x"] == 0 and got["bat", "pad"] == 1.0 and got["walked", "walks"] >= 0.84 and got["abc", "xyz"] == 0


def test_repairs_and_trims(spark):
    df = spark.createDataFrame([("He took 25 of it. Fine. Call 30!", ["25"], ["fine"]), (None, [], []), ("", [], [])], "text string, bad array<string>, words array<string>")
    kept = claims.without_sentences(F.col("text"), F.col("bad"))
    got = [tuple(r) for r in df.select(kept, claims.redacted_words(kept, F.col("words"))).collect()]
    assert got == [("Fine. Call 30!", "[?] Call 30!"), ("", ""), ("", "")]
    rows = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["a"]), ([], ["x"]), (["c", "c"], ["c", "c", "c"])], "p array<string>, w array<string>")
    assert [r[0] for r in rows.select(claims.trimmed(F.col("p"), F.col("w"))).collect()] == [["d"], [], ["x"], ["c"]]


def test_locks_go_to_the_first_slot(spark):
    rows = spark.createDataFrame([(1, k, float(k), k + 1.0, f"w{k}") for k in range(5)], "key int, slot int, start double, end double, word string")
    locks = spark.createDataFrame([(1, 7, 0.5, 2.5, "25 mg"), (1, 8, 2.2, 3.5, "x")], "key int, lock int, start double, end double, value string")
    assert [r.word for r in slots.locked_slots(rows, locks, ["key"], 10.0).orderBy("slot").collect()] == ["25 mg", "", "", "x", "w4"]


def test_decode_uses_transitions(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 1.0), (1, 1, "c", 1.1), (2, 0, "a", 1.0)], "run int, slot int, candidate string, score double")
    pairs = spark.createDataFrame([(1, "a", "b", 2.0), (3, "x", "y", 1.0)], "run int, left string, right string, gain double")
    got = {(r.run, r.slot): r.word for r in lattice.decode(rows, pairs).collect()}
    assert got == {(1, 0): "a", (1, 1): "b", (2, 0): "a"} and {(r.run, r.slot): r.word for r in lattice.decode(rows).collect()}[1, 1] == "c"


def test_priority_overlaps_equal_greedy(spark):
    rng = random.Random(6)
    rows = [(1, s := rng.randint(0, 60) / 2, s + rng.randint(1, 9) / 2, rng.randint(0, 4)) for _ in range(120)]
    got = sorted((r.start, r.end, r.priority) for r in intervals.resolve_by_priority(spark.createDataFrame(rows, "k int, start double, end double, priority int"), "k").collect())
    kept = []
    for _, s, e, p in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if all(e <= a or s >= b for a, b, _ in kept):
            kept.append((s, e, p))
    assert got == sorted(kept)


def test_number_words_and_names(spark):
    values = [0, 7, 19, 20, 21, 100, 110, 999, 1000, 1001, 2345, 9999, 10000, -1]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(T.number_words_column(F.col("v"))).collect()]
    assert got == [T.number_words(v) for v in values]
    p = spark.range(1).select(T.protected(F.lit("Dr. Who and Dr. No"), r"Dr\. \w+").alias("p")).select("p.*", T.filled(F.col("p.text"), F.array(F.lit("A"))).alias("f")).first()
    assert p.text == "[NAME 1] and [NAME 2]" and p.names == ["Dr. Who", "Dr. No"] and p.f == "A and [NAME 2]"
    assert spark.range(1).select(T.displayed(F.lit(" a  b ,c‏ "))).first()[0] == "a b,c"
    rows = spark.createDataFrame([(1, "a a b c b c b c d".split()), (2, [])], "k int, toks array<string>")
    assert sorted((r.k, r.kept, r.removed) for r in grounding.collapsed(rows, ["k"]).collect()) == [(1, "a b c d", 5), (2, "", 0)]


def test_blocked_join_by_indel_equals_all_pairs(spark):
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    rows = spark.createDataFrame([(t, rng.choice("xy")) for t in terms], "term string, brand string")
    kind = {r.term: r.brand for r in rows.collect()}
    got = {(r.term, r.match): round(r.similarity, 9) for r in fuzzy.blocked_join(rows, rows, first, S.indel_ratio, 2, 0.6, 99, ["brand"]).collect()}
    want = {(a, b): round(S.indel(a, b), 9) for a in terms for b in terms if a != b and kind[a] == kind[b] and a[0] == b[0] and abs(len(a) - len(b)) <= 2 and S.indel(a, b) >= 0.6}
    assert got == want


def test_wider_beams_are_no_worse():
    rng = random.Random(7)
    for _ in range(20):
        path = [[(w, rng.uniform(0, 3)) for w in rng.sample(["", "a", "b", "c", "d"], 4)] for _ in range(8)]
        pairs = {(x, y): rng.uniform(-2, 2) for x in "abcd" for y in "abcd"}
        scores = [lattice.beam(path, pairs, width, each)[0] for width, each in ((1, 1), (72, 1), (72, 2))]
        assert scores[0] <= scores[1] + 1e-9 and abs(scores[1] - scores[2]) < 1e-9


def test_foreign_script(spark):
    rows = [("این یک متن فارسی است و چند کلمه دارد",), ("This text has no letter of that script",), ("123 !",), (None,)]
    got = [r.f for r in spark.createDataFrame(rows, "t string").select(T.foreign_script(F.col("t")).alias("f")).collect()]
    assert [(f.share, f.foreign) for f in got] == [(1.0, False), (0.0, True), (1.0, False), (1.0, False)] and got[0].other == 0 and got[1].own == 0
