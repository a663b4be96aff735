import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import components, decontamination, dom, exact_dedup, extraction, langid, licenses, near_copies, packing, quality, simhash, warc
from lattica.llm import substring_dedup as sub
from lattica.llm.license_rules import _WRITTEN, rules
from lattica.llm.queries import ORACLES, QUERIES
from lattica.llm.shared import table
from tests.oracle import duck, rows_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINE = "under the MIT License, and this line is long enough to be found again elsewhere. "

#: Null and repeated ids, null, empty, short, equal and long texts, and columns whose names the operators use.
HARD = [
    (1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, "!!! ???"), (6, LINE + "One"), (7, LINE + "Two"), (7, LINE + "Other"), (8, "é" * 60), (9, "x" + "é" * 60),
    (10, "word " * 30_000), (11, "ha " * 100), (12, LINE + "One"), (13, "\x00" * 120), (14, "\x00" * 121), (15, "CC-BY-NC cc by nc Apache License, Version 2.0"),
]


def hard(spark):
    rows = [(i, t, "en" if k % 2 else None, k % 2, "n", 0, 1) for k, (i, t) in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, name string, row long, rank int")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck(ORACLES[name], SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_exact_dedup_hard(spark):
    out = exact_dedup.exact_dedup(hard(spark), block_bytes=64).collect()
    assert len(out) == len(HARD)
    groups = {}
    for i, t in HARD:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in out:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sorted(r.text_sha256 for r in out if r.kept) == sorted(groups)
    assert exact_dedup.keep_one(hard(spark)).count() == len(groups)
    assert exact_dedup.exact_dedup(hard(spark).limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_hard(spark):
    out = simhash.near_groups(hard(spark)).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t in HARD)
    assert simhash.near_groups(hard(spark).limit(0)).count() == 0
    assert simhash.keep_one(hard(spark)).count() >= len({r.component_id for r in out})


def test_pivots_discard_pairs(spark):
    """Fewer pairs are verified the more pivots there are, and none of those within the radius is lost."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3)})
    near = {(x, y) for x in prints for y in prints if x < y and bin(x ^ y).count("1") <= 2}
    members = spark.createDataFrame([(1, x - (1 << 64) if x >> 63 else x) for x in prints], "group int, fp long")
    counts = []
    for n in (0, 1, 4, 16):
        got = {tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in simhash.pairs_to_verify(members, 2, n).collect()}
        assert near <= got
        counts.append(len(got))
    assert counts == sorted(counts, reverse=True) and counts[0] == len(prints) * (len(prints) - 1) // 2 and counts[3] * 20 < counts[0]


def roots_of(names, linked):
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in linked:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    return {x: find(x) for x in names}


def test_simhashes_equal_counted_bits():
    """Majorities and peaks of sets of 0 to 700 hashes against bits counted one by one, and the tables for few and many texts."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (0, 1, 2, 3, 255, 256, 700, 0)]
    prints, peaks = near_copies.simhashes(sets)
    for k, s in enumerate(sets):
        for w in (0, 3, 4, near_copies.WORDS - 1):
            with np.errstate(over="ignore"):
                mixed = [int(x) for x in near_copies.mixed(s ^ near_copies._TURN[w])]
            lead = [2 * sum(x >> b & 1 for x in mixed) - len(s) for b in range(64)]
            if w < 4:
                assert int(prints[k, w]) & (1 << 64) - 1 == sum(1 << b for b in range(64) if lead[b] > 0)
            best, value = divmod(int(peaks[k, w]), 2)
            assert not len(s) or abs(lead[best]) == max(map(abs, lead)) and value == (lead[best] > 0)
    for texts, each, least in ((10, 3, 36), (2_000_000, 3, 36), (5_000_000, 4, 81), (10**10, 5, 185)):
        found = near_copies.tables(texts)
        assert len(found) >= least and all(len(set(t)) == each for t in found) and {w for t in found for w in t} == set(range(near_copies.WORDS))


@pytest.mark.parametrize("limit", [2, 64])
def test_near_copies_equal_all_pairs(spark, limit):
    """Groups of copies with a few words changed, around the threshold: nothing is linked that should not be, and nine in ten pairs are found."""
    rng, texts = random.Random(9), []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 12)):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
            texts.append(" ".join(changed).upper())
    texts = ["", " \n", "one", "One", "one two", *texts]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if alike(sets[i], sets[j])]
    want = roots_of(range(len(texts)), pairs)
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r.component for r in near_copies.near_copies(rows, group_limit=limit).collect()}
    assert len(got) == len(texts) and all(want[i] == want[j] for i in got for j in got if got[i] == got[j])
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert near_copies.near_copies(rows.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1, 64])
def test_links_equal_all_pairs(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), group_limit=limit)).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in signed:
        for y in signed:
            if x < y and bin((x ^ y) & (1 << 64) - 1).count("1") <= 2:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    assert all(roots.get(x, x) == find(x) for x in signed)


def brute_hits(docs, items, window=10):
    out = []
    known = [(str(i), WORD.findall(lower(t))) for i, t in items if t is not None]
    for i, t in docs:
        words = WORD.findall(lower(t))
        hit, names = set(), set()
        for name, w in known:
            n = min(window, len(w))
            for q in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[q : q + n]:
                        hit |= set(range(p, p + n))
                        names.add(name)
        out.append((i, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 500_000])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "c1", "d"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 6, 9, 10, 11, 25]))) for k in range(8)] + [(8, None), (9, "..."), (10, "q " * 12)]
    docs = [(k, f"{text(rng.randint(0, 30))}. {(rng.choice(items)[1] or '')[:60].upper()} {text(5)}") for k in range(40)] + [(None, None), (41, ""), (41, "q " * 12), (42, "é" + "q " * 14)]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block).drop("spans", "items").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(docs, items)


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.decontaminate(hard(spark), none).collect())
    assert decontamination.decontaminate(hard(spark).limit(0), none).count() == 0


def brute_bins(lengths, capacity):
    """Best-fit decreasing piece by piece; the rooms that are left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r, k) for k, r in enumerate([*rooms, capacity + 1]) if r >= n)[1]
        if fit == len(rooms):
            rooms.append(capacity)
        rooms[fit] -= n
    return rooms


def test_packing_needs_as_many_bins_as_piece_by_piece():
    rng = random.Random(60)
    cases = [({33: 9, 5: 9, 50: 8, 8: 11}, 50)]
    cases += [({rng.randint(1, c): rng.randint(1, 12) for _ in range(rng.randint(1, 9))}, c) for c in (rng.choice([10, 20, 37, 50, 100]) for _ in range(1500))]
    for histogram, capacity in cases:
        pieces = [n for n, count in histogram.items() for _ in range(count)]
        plan, rooms = packing.best_fit_plan(histogram, capacity), {}
        for (n, rank, first, _, each), end in zip(plan, [*plan[1:], None], strict=True):
            for k in range((end[1] if end and end[0] == n else histogram[n]) - rank):
                rooms[first + k // each] = rooms.get(first + k // each, capacity) - n
        assert sorted(rooms.values()) == sorted(brute_bins(pieces, capacity)), (histogram, capacity)


def test_packing_is_best_fit_decreasing():
    rng = random.Random(6)
    lengths = [rng.randint(1, 60) for _ in range(400)]
    rooms = brute_bins(lengths, 100)
    histogram = {n: lengths.count(n) for n in set(lengths)}
    bins = {}
    for (n, rank, first, offset, each), end in zip(plan := packing.best_fit_plan(histogram, 100), [*plan[1:], None], strict=True):
        last = end[1] if end and end[0] == n else histogram[n]
        for k in range(last - rank):
            bins.setdefault(first + k // each, []).append((offset + k % each * n, n))
    assert len(bins) == len(rooms) and sum(map(len, bins.values())) == len(lengths)
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 100


def test_packing_hard(spark):
    from tokenizers import Tokenizer

    out = packing.pack(hard(spark)).toPandas()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in HARD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k // 2048, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    got = [("None" if r.doc_id != r.doc_id or r.doc_id is None else str(int(r.doc_id)), r.piece, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(hard(spark).limit(0)).count() == 0


def brute_removed(rows):
    first, out = {}, []
    key = lambda i: float("inf") if i is None else i
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup_hard(spark):
    got = sub.remove_repeats(hard(spark).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(HARD)
    assert sub.remove_repeats(hard(spark).limit(0)).count() == 0
    named = [(None if i is None else f"id{i}é", t) for i, t in HARD]
    order = {n: k for k, n in enumerate(sorted({n for n, _ in named if n}))}
    got = sub.remove_repeats(spark.createDataFrame(named, "doc_id string, text string")).collect()
    want = brute_removed([(order.get(n), t) for n, t in named])
    assert sorted((str(order.get(r.doc_id)), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("common", [False, True])
def test_parse_marks_what_brute_force_does(common):
    """The steps in one process, with every hash dealt out by single windows or by phrases."""
    rng = random.Random(8)
    parts = ["".join(rng.choices("abc ", k=rng.randint(20, 90))) for _ in range(6)]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 6)))) for k in range(12)]
    data, ids = "".join(t for _, t in rows).encode(), np.array([i for i, _ in rows])
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    none = np.zeros(len(rows), bool)
    first, count, hashes = sub.phrases_of(data, offsets, piece=37)
    assert count.sum() == sum(max(0, len(t) - 49) for _, t in rows)
    parse = sub.Parse(ids, offsets, data, none, np.unique(hashes) | np.uint64(common), 4)
    infos = [{"share": -1, "info": (np.unique(hashes) | np.uint64(common)).tobytes()}]
    for share, strings, least, _, _ in parse.parts:
        earlier = sub.earlier_windows(np.array([len(s) for s in strings], "<u4"), least, b"".join(strings))
        infos.append({"share": share, "info": np.packbits(earlier < np.repeat(least, [len(s) - 49 for s in strings])).tobytes()})
    gone = sub._marked(ids, offsets, data, none, infos, 4)
    want = dict((r[0], r[2]) for r in brute_removed(rows))
    assert {str(i): int(gone[a:b].sum()) for i, a, b in zip(ids, offsets, offsets[1:], strict=False)} == want


def test_licenses_equal_python(spark):
    known = rules()
    assert len(_WRITTEN) > 200 and len(known) > len(_WRITTEN)
    texts = [*HARD, (20, "Licensed under the Apache License, Version 2.0 or the GNU General Public License v3 or later; GPL-3.0-or-later."), (21, "MİT lıcense under the MİT license"), (22, "İ " + LINE * 50), (23, "Sous licence MIT. Licencia pública general de GNU; gemeinfrei! " * 40)]
    got = {(r.doc_id, r.n_words, r.n_base): r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        words = WORD.findall(lower(t))
        places, base = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        padded, kept = f" {' '.join(words)} ", set()
        hits = [(m.start(), m.end(), r["priority"], r["rule"], r["label"]) for r in known if r["keyword"] in words for m in re.finditer(r["pattern"], padded)]
        for x in hits:
            inside = [y for y in hits if y != x and y[0] <= x[0] and y[1] >= x[1]]
            if not any(y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[1] - y[0] == x[1] - x[0] and y[3] < x[3]) for y in inside):
                kept.add(x[4])
        r = got[i, len(words), len(places)]
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | kept)) and 0 <= r.score <= 1


def test_language_model_learns_and_predicts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_gradients_equal_differences():
    tagger = langid.ByteTagger(["a", "b", "c"])
    tagger.start(1)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    rng = np.random.default_rng(0)
    text, known, target = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.ones((5, 4), np.float32), np.array([0, 1, 2, 1])
    _, grads = tagger.gradients(text, known, target)
    for name, w in tagger.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old, losses = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            losses.append(tagger.gradients(text, known, target)[0])
        w[at] = old
        assert abs(grads[name][at] - (losses[0] - losses[1]) / 2e-2) < 1e-4


def test_probabilities_equal_a_plain_forward_pass():
    """The network byte by byte, from its equations, over whole texts of several windows."""
    tagger = langid.ByteTagger(["a", "b", "c"])
    tagger.start(3)
    w = {k: v.astype(float) for k, v in tagger.weights.items()}
    gate = lambda x: np.clip(0.25 * x + 0.5, 0, 1)

    def states(window, d):
        h, out, n = np.zeros(langid.HIDDEN), [], langid.HIDDEN
        for byte in window:
            x, s = w[f"inputs_{d}"][byte], h @ w[f"states_{d}"]
            z, r = gate(x[:n] + s[:n]), gate(x[n : 2 * n] + s[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * s[2 * n :])
            out.append(h)
        return out

    texts = ["Short.".encode(), ("déjà vu " * 20).encode(), b"x" * 64, b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = tagger.document_probabilities(data, offsets)
    for row, text in zip(got, texts, strict=True):
        each = []
        for at in range(0, len(text), langid.STEPS):
            window = text[at : at + langid.STEPS]
            padded = window + bytes(langid.STEPS - len(window))  # the backward layer reads the padding first
            f, b = states(padded, "f"), states(padded[::-1], "b")[::-1]
            for k in range(len(window)):
                y = np.exp(np.concatenate([f[k], b[k]]) @ w["out"] + w["bias"])
                each.append(y / y.sum())
        assert np.allclose(row, np.mean(each, axis=0) if each else 0, atol=1e-4)


def test_samples_count_an_id_once(spark):
    from lattica.llm.shared import sampled_texts

    rows = spark.createDataFrame([(1, f"t{k}") for k in range(300)] + [(2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    keys = spark.createDataFrame([(1, k % 2) for k in range(300)] + [(2, 0), (3, 1)], "doc_id long, label int")
    assert sorted(tuple(r) for r in sampled_texts(rows, keys, "label", 200).collect()) == [(1, 0, "t0"), (2, 0, "b"), (3, 1, "c")]
    assert sampled_texts(rows, keys, "label", 1).count() == 2


def test_language_hard(spark):
    out = {r.doc_id: r for r in langid.predict(hard(spark), langid.train(hard(spark))).collect() if r.doc_id is not None}
    assert all(out[i].lang_pred == "und" for i in (1, 2, 5, 13)) and out[6].lang_pred == "en"
    nothing = langid.predict(hard(spark), langid.train(hard(spark).limit(0))).collect()
    assert len(nothing) == len(HARD) and {r.lang_pred for r in nothing} == {"und"}


def test_quality_separates_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    out = quality.predict(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9 and out.score.between(0, 1).all()


def test_scores_follow_from_compressed_sizes():
    """The score from its equation, with the sizes of every piece taken anew."""
    import zstandard

    model = quality.CompressionClassifier(b"good words here " * 9, b"bad noise there " * 9, 30.0, 0.4, -0.2)
    texts = [b"", b"good words here again", b"bad noise there " * 200, b"good words here " * 200]
    size = lambda raw, p: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) - 6
    want = []
    for t in texts:
        a, b = (sum(size(raw, t[i : i + quality.PIECE_BYTES]) for i in range(0, len(t), quality.PIECE_BYTES)) for raw in (model.good, model.bad))
        weight = (a + b) / (a + b + quality.LITTLE)
        want.append(1 / (1 + np.exp(-((model.slope * (b - a) / max(1, a + b) + model.base) * weight + model.usual * (1 - weight)))))
    got = model.score(texts)
    assert np.allclose(got, want, atol=1e-3) and got[3] > got[2]


def test_quality_hard(spark):
    labels = hard(spark).select("doc_id", "quality")
    assert quality.predict(hard(spark), quality.train(hard(spark), labels)).count() == len(HARD)
    assert {r.score for r in quality.predict(hard(spark), quality.train(hard(spark), labels.limit(0))).collect()} == {0.5}


def test_extraction_text_of_every_page(spark):
    from html import unescape

    pages = table(spark, SF, "pages")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


PAGE = '<body><div class="top"><a href=x>Home</a></div><div id="wrap"><div class="story"><h1>Title {0}</h1><p>Body {0} of&nbsp;the <i>st</i>ory &amp; more.<p>Second {0}.<div class="x">Read our terms first.</div></div><div class="comments"><p>I like {0}</div></div><p>Powered by Foo</body>'


def test_wrapper_tells_template_from_slots():
    pages = [PAGE.format(k) for k in range(5)]
    wrapper = extraction.induced(pages)
    assert extraction.main_text(pages[2], wrapper) == "Title 2 Body 2 of the story & more. Second 2."
    assert extraction.main_text(pages[2]) == "Title 2 Body 2 of the story & more. Second 2. Read our terms first."
    assert extraction.induced([pages[0]] * 5) == {} and extraction.induced(pages[:2]) == {}


LONG = "some words that fill a paragraph well enough to weigh more than what stands around it"
#: A page of a host, and the text of it with and without the host's wrapper.
NEED_WRAPPERS = [
    ("<body><form id=aspnet><div class=hd>Shop</div><div class=txt>Own {0} " + LONG + "</div><div class='ad'>buy {0}</div></form><p>Foot", "Own {0} " + LONG, "Foot"),
    ("<body><div class=top>Site</div><div class='widget'><div>Own {0} " + LONG + "</div></div><div class=x><a href=a>one {0}</a> <a>two {0}</a></div><p>Foot", "Own {0} " + LONG, "Site Foot"),
    ("<body><article class=teaser>Same teaser</article><article><p>First {0} " + LONG + "</article><article><p>Tiny {0}</article>", "First {0} " + LONG + " Tiny {0}", "Same teaser First {0} " + LONG + " Tiny {0}"),
    ("<body><div class=crumbs>You are here</div><main><p>Own {0} " + LONG + "<p>Share this</main><main>More {0}</main>", "Own {0} " + LONG + " More {0}", "Own {0} " + LONG + " Share this More {0}"),
]


@pytest.mark.parametrize("page, text, alone", NEED_WRAPPERS)
def test_wrapper_changes_the_text(page, text, alone):
    pages = [page.format(k) for k in range(4)]
    wrapper = extraction.induced(pages)
    assert [extraction.main_text(p, wrapper) for p in pages] == [text.format(k) for k in range(4)]
    assert [extraction.main_text(p) for p in pages] == [alone.format(k) for k in range(4)]


def test_marks_alone_drop_no_article_text():
    for page, text in [
        ("<article><h1>A</h1><div class='legal-analysis'>Deep law.</div><p>E = <math><mi>m</mi></math> c</article>", "A Deep law. E = m c"),
        ("<article><p>" + LONG * 6 + "</article><article>Tiny</article>", LONG * 6 + " Tiny"),
        ("<main>a</main><main>b</main>", "a b"),
        ("<body><form><div><h1>T</h1><p>Hello</div></form>", "T Hello"),
        ("<article><p><a href=x>All of it a link</a></article>", "All of it a link"),
        ("<body><form><label>User</label><input></form>", ""),
        ("<article>Text<section class='comments'><article>I like it</article></section></article>", "Text"),
    ]:
        assert extraction.main_text(page) == text


def test_matching_is_largest_and_keeps_order():
    tree = lambda x: extraction.folded("".join(f"<{t}>{t}</{t}>" for t in x.split()))
    assert extraction.matching(tree("p ul ol pre"), tree("ul pre p ol"))[0] == 3
    assert extraction.matching(tree("p ul"), tree("table"))[0] == 1


def test_pages_without_a_host_share_no_wrapper(spark):
    pages = spark.createDataFrame([(k, None, f"<p>Shared by all.<p>Own {k}") for k in range(8)], "page_id long, url string, html string")
    assert {r.text for r in extraction.extract(pages.withColumns({"host": F.lit(1), "hash": F.lit(2), "wrapper": F.lit(3)})).collect()} == {f"Shared by all. Own {k}" for k in range(8)}


def test_parser_survives():
    for html in ("", "<", "<p", "a<b", '<a "' * 250_000, '<a "<b>"' * 100_000, "<a" * 500_000, "<div" * 500, "<div>" * 5000 + "x", "<script>never closed", "<p class='x", "&#x110000;&bad;", "<!-- open", "<a href=\"x>y</a>"):
        assert isinstance(dom.parse(html), dom.Element)
        extraction.main_text(html)
    assert extraction.main_text("<div>" * 5000 + "x").endswith("x")


def test_extraction_hard(spark):
    rows = [(1, None, None), (1, None, ""), (None, "http://a/", "<p>x y</p>"), (2, "not a url", "<article>a<br>b</article>"), (2, "not a url", "<article>a<br>b</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.text for r in extraction.extract(pages).collect()) == ["", "", "a b", "a b", "x y"]
    assert extraction.extract(pages.limit(0)).count() == 0


def test_warc_hard(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n\r\n\r\n" * 3
    rows = [(5, "u\r\nx", "é" * 60), (3, "v", "é" * 60), (5, "u", "é" * 60), (None, None, "é" * 60), (7, "w", None), (8, "w", ""), (9, "z", inner), (10, None, inner)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.n_requests, r.n_metadata) for r in warc.archived(pages).collect())
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if i is not None and len(raw) >= 100 and min(same) < i else None
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if first is not None else "response", first, 1, 1))
    assert got == sorted(want)
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_reader_and_assembly(spark, tmp_path):
    import gzip

    def record(kind, rid, body, *more):
        head = "".join(f"{x}\r\n" for x in ("WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(body)}"))
        return head.encode() + b"\r\n" + body + b"\r\n\r\n"

    http = "Content-Type: application/http; msgtype=response"
    records = [record("warcinfo", "i", b"x"), record("response", "a", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello", http, "WARC-Concurrent-To: q"), record("request", "q", b"GET /"), record("metadata", "m", b"f: 1", "WARC-Concurrent-To: a"), record("request", "lone", b"GET /x", "WARC-Concurrent-To: gone")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"noise" + records[1].replace(b": a\r\n", b": c\r\n", 1) + records[3][:40])
    rows = warc.read_records(spark, str(tmp_path))
    assert rows.count() == 6
    got = {r.record_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(rows.filter("record_id <> 'c'")).collect()}
    assert got == {"a": (["q"], ["m"]), None: (["lone"], [])}
    assert rows.filter("record_id = 'a'").first().payload == b"hello"


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_go_by_their_own_texts(spark, doc_id):
    clean, words = "A quiet walk along the river in autumn", " ".join(f"w{k}" for k in range(12))
    ids = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(doc_id, clean, "en"), (doc_id, f"x {words} y", "en"), (doc_id, None, "en"), (8, "un autre texte sans rapport avec rien", "fr")], ids)
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    assert {r.text for r in decontamination.clean_of(docs, items).collect()} == {clean, None, "un autre texte sans rapport avec rien"}
    if doc_id is None:
        known = {r.text for r in langid.identified(docs, reject_below=0.0).collect()}
        assert clean in known and None not in known
    near = spark.createDataFrame([(doc_id, clean), (doc_id, "Same words here"), (3, "same  WORDS here"), (doc_id, "one two three"), (doc_id, "One two three"), (doc_id, "one two three")], "doc_id long, text string")
    kept = sorted((str(r.doc_id), r.text.lower()) for r in simhash.keep_one(near).collect())
    assert kept == sorted([(str(doc_id), clean.lower()), ("3", "same  words here"), (str(doc_id), "one two three")])


def test_wrappers_count_every_page_of_a_host(spark):
    """A line on 35 of 40 pages is template, one on 20 of them is not; each way 6 pages may tell otherwise."""
    page = "<body><div class=top>{0}</div><div class=story><p>Own words of page {1}.</p>{2}</div></body>"
    htmls = [page.format("Often here" if k % 8 else f"Other {k}", k, "<p>Half the pages.</p>" * (k % 2)) for k in range(40)]
    pages = spark.createDataFrame([(k, "http://a/", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    found = extraction.wrappers(pages.withColumn("host", F.lit("a"))).collect()
    assert set(json.loads(found[0].wrapper)["constant"]) == {extraction.mark(("body", "div.top"), "Often here")}


def test_packing_fills_the_tightest_bin_up():
    """Strict best-fit decreasing needs two sequences; one piece into each open bin needs three."""
    histogram = {12: 2, 3: 2, 2: 5}
    plan, used = packing.best_fit_plan(histogram, 20), {}
    for (n, rank, first, offset, each), end in zip(plan, [*plan[1:], None], strict=True):
        last = end[1] if end and end[0] == n else histogram[n]
        for k in range(last - rank):
            used.setdefault(first + k // each, []).append((offset + k % each * n, n))
    assert sorted(used) == [0, 1] and sum(map(len, used.values())) == 9
    for pieces in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:], strict=False)) and sum(n for _, n in pieces) <= 20


def test_pivot_table_discards_only_pairs_too_far_apart(spark):
    rng, radius = random.Random(12), 58
    turned = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(256), n))
    groups = []
    for key in range(30):
        centres = [rng.getrandbits(256) for _ in range(3)]
        groups.append((key, [turned(rng.choice(centres), rng.randint(0, 34)) for _ in range(rng.randint(1, 16))]))
    signed = lambda f: [(x := f >> 64 * k & (1 << 64) - 1) - (x >> 63 << 64) for k in range(4)]
    rows = [(key, [(key * 100 + k, *signed(f)) for k, f in enumerate(fs)]) for key, fs in groups]
    frame = spark.createDataFrame(rows, "key int, members array<struct<id: long, f0: long, f1: long, f2: long, f3: long>>")
    got = {(r.a, r.b) for r in near_copies.pivot_pairs(frame, radius).selectExpr("x.id a", "y.id b").collect()}
    near = {(key * 100 + i, key * 100 + j) for key, fs in groups for i in range(len(fs)) for j in range(i + 1, len(fs)) if (fs[i] ^ fs[j]).bit_count() <= radius}
    everything = sum(len(fs) * (len(fs) - 1) // 2 for _, fs in groups)
    assert near <= got and len(got) - len(near) < (everything - len(near)) // 2


def test_workers_give_memory_back_after_a_task():
    import re as regex

    from lattica.llm.shared import giving_back

    def mb():
        return sum(map(int, regex.findall(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    held = []

    def run(batches):
        texts = [b"x" * 2000 + str(k).encode() for k in range(60_000)]
        held.append((mb(), texts[::6000]))  # a few stay, so that the rest isn't freed from the top
        yield from batches

    before = mb()
    assert list(giving_back(run)([1, 2])) == [1, 2]
    assert held[0][0] > before + 100 and mb() < before + 40
