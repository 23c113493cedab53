"""Hard negatives, spelling variants and personal data against brute force, on families, ties and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import hard_negatives, private_data, spelling


def brute_negatives(rows, anchors):
    """rows and anchors: (id, label, list of whole numbers)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, label, v in anchors:
        scored = sorted(((-dot(v, x), i, lab) for i, lab, x in rows), key=lambda s: s[:2])
        for s, i, lab in [s for s in scored if s[2] == label and s[1] != a][:5]:
            fits = [(j, -t) for t, j, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, i, n + 1, j, -s, t) for n, (j, t) in enumerate(fits[:3])]
    return Counter(out)


def mined(spark, rows, anchors, **options):
    schema = "id long, label string, v array<long>"
    own = spark.createDataFrame(rows, schema).select("id", "label", "v", F.lit(1).alias("score"))
    found = hard_negatives.mine(own.select("id", "label", "v"), spark.createDataFrame(anchors, schema), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in found.collect())


def test_hard_negatives_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (4, 12)) * (0.7 ** np.arange(12))
    # Clusters that labels follow in part, many equal vectors, one label with half of all rows.
    rows = [(i, "ab"[i % 2] if i % 3 else "c", (centres[i % 4] + rng.normal(0, 25, 12)).astype(int).tolist()) for i in range(900)]
    rows += [(1000 + i, "a", rows[0][2]) for i in range(60)] + [(2000 + i, "b", rows[0][2]) for i in range(60)] + [(3000, "c", [0] * 12), (3001, "a", [5]), (3002, "b", []), (1, *rows[1][1:])]
    anchors = [r for r in rows if r[0] % 20 == 0]
    want = brute_negatives(rows, anchors)
    assert sum(want.values()) > 300
    assert mined(spark, rows, anchors) == want == mined(spark, rows, anchors, block=16)


def test_hard_negatives_need_more_than_one_pass(spark):
    """Far groups beside a broad mass of rows: the first thresholds hold none of what is looked for."""
    rng = np.random.default_rng(6)
    rows = [(i, "m", rng.normal(0, 40, 6).astype(int).tolist()) for i in range(400)]
    rows += [(1000, "x", [400, 0, 0, 0, 0, 0]), (1001, "x", [90, 1, 0, 0, 0, 0]), (1002, "x", [1, 0, 0, 0, 0, 0]), (1003, "x", [-50, 0, 0, 0, 0, 0])]
    anchors = [rows[-4], rows[-1], (7, "nowhere", [1] * 6)]
    assert mined(spark, rows, anchors) == brute_negatives(rows, anchors)


def test_index_omits_what_cannot_reach_a_threshold():
    """No pair that reaches is lost, and rows with small suffixes aren't in the later slices."""
    rng = np.random.default_rng(7)
    a = hard_negatives.Slices((rng.normal(0, 50, (30, 32)) * 0.8 ** np.arange(32)).astype(np.int64), np.arange(32))
    x = hard_negatives.Slices((rng.normal(0, 50, (200, 32)) * 0.8 ** np.arange(32)).astype(np.int64), np.arange(32))
    whole = a.whole @ x.whole.T
    for share in (0.5, 0.99):
        least, most = np.quantile(whole, share, axis=1), np.quantile(whole, (1 + share) / 2, axis=1)
        q, r, score = hard_negatives.candidates(a, x, np.ones(whole.shape, bool), least, most)
        ok = (score >= least[q]) & (score <= most[q])
        assert set(zip(q[ok], r[ok], strict=True)) == set(zip(*np.nonzero((whole >= least[:, None]) & (whole <= most[:, None])), strict=True))
        assert (score == whole[q, r]).all()
    assert len(q) < 0.2 * whole.size


def edits(word, letters):
    return {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}


@pytest.mark.parametrize("symbols", [1, 2, 5])
def test_neighbourhoods_are_whole(symbols):
    rng = random.Random(symbols)
    letters = [chr(65 + i) for i in range(symbols)]
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 10)))
        own, keys = spelling.neighbourhood(word, symbols)
        assert own == spelling.neighbourhood_hash(word)
        assert sorted(keys) == sorted({spelling.neighbourhood_hash(w) for w in edits(word, letters) | {word}})


def brute_variants(counts):
    near = {w: (edits(w, {c for v in counts for c in v}) - {w}) & set(counts) for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def test_variants_by_brute_force(spark):
    rng = random.Random(3)
    counts = {}
    for base in ("spelling", "spélling", "neighbour", "aaaaaaaa", "straße×÷ÀÿÉ"):
        words, n = {base}, 4000
        for _ in range(4):  # chains of forms, and ties
            for w in words:
                counts.setdefault(w, max(2, n))
            words, n = set(rng.sample(sorted(edits(rng.choice(sorted(words)), "aeéz")), 25)), n // 12
    counts |= {"x" * 5000: 300, "x" * 5001: 2, "x" * 4999 + "y": 30}
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {tuple(r) for r in spelling.variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants({w: n for w, n in counts.items() if len(w) < 100})
    assert {r for r in found if len(r[0]) < 100} == want and any(r[1] != r[2] and r[1] for r in want)
    x, xx, xy = "x" * 5000, "x" * 5001, "x" * 4999 + "y"
    assert {r for r in found if len(r[0]) > 100} == {(x, None, x, 300, 2, None), (xx, x, x, 2, 1, 300), (xy, x, x, 30, 1, 300)}


def test_words_of_odd_rows(spark):
    rows = [("d", None), ("d", ""), (None, "Spelling SPELLING ÉCOLEÉCOLE"), ("d", "Spelling-spelling 7spellingß"), ("d", "Spelling-spelling 7spellingß"), ("e", "long" * 20000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").select("*", F.lit(1).alias("run"), F.lit(2).alias("n"), F.lit(3).alias("a.b"))
    want = Counter()
    import zlib

    for i, t in rows:
        for run in ["".join(w) for w in __import__("re").findall("[A-Za-zÀ-ÿ]+", t or "")]:
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i or ''}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[word] += len(word) >= 7
    assert {r.word: r.n for r in spelling.words(docs).collect()} == +want


SEEDED = [f"Bitte schreiben an {x} oder rufen." for x in ("a1@x.org", "b2@x.org", "c3@y.com", "+49 170 1234567")]


def test_contexts_of_seeds_find_identifiers_unknown_to_the_rules(spark):
    rows = [*enumerate(SEEDED), (10, "Bitte schreiben an KD-998877 oder rufen."), (11, "Kunde: kd-998877"), (12, "im Jahr 20245 war"), (13, "Bitte schreiben an der oder rufen."), (10, "Bitte schreiben an KD-998877 oder rufen."), (None, None), (14, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit(2).alias("rank"), F.lit(3).alias("a.b"), F.lit(4).alias("Spans"))
    found = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in private_data.find_private(docs).collect())
    assert found[(10, (("found", 19, 28),))] == 2 and found[(11, (("found", 7, 16),))] == 1  # an instance is found in other contexts too
    assert found[(12, ())] == found[(13, ())] == found[(None, ())] == found[(14, ())] == 1
    assert found[(3, (("phone", 19, 34),))] == 1 and sum(found.values()) == len(rows)
    # Two seeds are no support; copies of a text add nothing to it.
    few = spark.createDataFrame([*enumerate(SEEDED[:2] * 5), rows[4]], "doc_id long, text string")
    assert all(s.kind != "found" for r in private_data.find_private(few).collect() for s in r.spans)


def test_base_kinds_on_texts_that_are_hard_for_regular_expressions(spark):
    texts = ["7" * 300_000, "1 " * 150_000, "a" * 300_000, "a." * 150_000 + "@", "+" + "1 " * 100_000, "1." * 100_000, "a@b.c_d@e.f", "a@b.c.d@e.f@g.h", "0001.02.255.0 1.2.3.256 1.2.3.4.5.6.7.8", "4111 1111-1111 1111 4111111111111112", "+1 (555) 555-0100+49123456789", "x@y", "0" * 5000 + "1.2.3.4", "+12-345-67890-"]
    import re

    def brute(t):
        found = []
        for k in private_data.KINDS[:4]:
            for m in re.finditer(k.plain.replace(r"\x20", " "), t, re.A):
                d = re.sub("[^0-9]", "", m[0])
                ok = {
                    "email": lambda: True, "ip": lambda: all(int(p[-400:]) <= 255 and not p[:-400].strip("0") for p in m[0].split(".")), "phone": lambda: 10 <= len(d) <= 15,
                    "card": lambda: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                }[k.name]()
                if ok:
                    found.append((m.start(), k.name, m.end()))
        return sorted(found, key=lambda s: (s[0], [k.name for k in private_data.KINDS].index(s[1])))

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans if s.kind != "found"] for r in private_data.find_private(docs).collect()}
    # Python's own engine takes the square of the first six.
    assert all(got[i] == [] for i in range(5)) and got[5] == [(8 * i, "ip", 8 * i + 7) for i in range(25_000)]
    assert {i: got[i] for i in range(6, len(texts))} == {i: brute(t) for i, t in enumerate(texts) if i > 5}
