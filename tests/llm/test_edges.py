"""Odd rows for every operator: nulls, empty and very long texts, ties, repeated rows, clashing columns, other types of ids; ledgers, chunks, large buckets."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from fleetloom.llm import common, decontaminate, exact_dedup, license_scan, mixing, secret_scan, simhash, toxicity, url_filter, warc
from fleetloom.llm.common import saved

LONG = "word " * 30000 + "end"
TEXTS = [(1, ""), (2, None), (3, "Same Text"), (4, "same text"), (5, "sAME tEXT"), (5, "sAME tEXT"), (None, "same text"), (6, "É é"), (7, LONG), (8, LONG.upper()), (9, " \n\t"), (10, "ein Satz über Äpfel ÄPFEL"), (11, "EIN satz über Äpfel ÄPFEL")]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_docs(spark, rows=TEXTS):
    """With columns that clash with names used inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("row", "copy", "count", "size", "norm", "k1", "doc", "of", "n", "keep_id", "own", "toxic_score")])


def test_lower_ascii(spark):
    rows = spark.createDataFrame([("AZ az ÀÉ",), ("PLAIN ascii",), ("",), (None,), ("İI Σ",)], "t string")
    assert [r.g for r in rows.select(common.lower_ascii(F.col("t")).alias("g")).collect()] == ["az az ÀÉ", "plain ascii", "", None, "İi Σ"]


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_exact_dedup_of_odd_rows(spark, keep, share):
    docs = odd_docs(spark)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    best = {t: ({"min": min, "max": max}[keep]([i for i in ids if i is not None], default=None)) for t, ids in groups.items()}
    want = Counter((i, best[lower(t)], len(groups[lower(t)])) for i, t in TEXTS)
    found = exact_dedup.exact_dedup(docs, keep=keep, hot_share=share).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == want
    assert Counter(r.keep_id for r in found if r.kept) == Counter(best.values())
    kept = exact_dedup.drop_exact_copies(docs, keep=keep, hot_share=share)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(best.values())


def test_exact_dedup_takes_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x"), ("c", "X"), ("b", "x"), (None, "y")], "doc_id string, text string")
    for keep, stays in (("min", {"a", None}), ("max", {"c", None})):
        for share in (1, 10**6):
            assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs, keep=keep, hot_share=share).collect()} == stays
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(docs, keep="first")


def test_edit_matching_on_odd_rows(spark):
    item = "the benchmark item that no training text may hold in any place at all"
    changed = item.replace("training", "trainng").upper()
    rows = [(None, f"a {item} b"), (1, None), (2, ""), (3, changed), (3, changed), (4, LONG + " " + item), (5, item[:-12])]
    docs = odd_docs(spark, rows)
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, " "), (None, "sAME  words twice in here")], "item_id long, text string")
    found = Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.find_items(docs, items).collect())
    assert found == Counter({(None, 1, 0): 1, (None, 2, 0): 1, (3, 1, 1): 2, (3, 2, 1): 2, (4, 1, 0): 1, (4, 2, 0): 1})
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    words = decontaminate.find_items(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), items.withColumn("item_id", F.concat(F.lit("i"), "item_id")), block_chars=80)
    assert Counter((r.doc_id, r.item_id) for r in words.collect()) == Counter({(None, "i1"): 1, (None, "i2"): 1, ("d3", "i1"): 2, ("d3", "i2"): 2, ("d4", "i1"): 1, ("d4", "i2"): 1})
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_url_verdicts_don_t_depend_on_blocks(spark):
    rng = random.Random(6)
    words = ["a", "ab", "x", "y", "com", "net", "en", "7", "z9"]
    host = lambda: ".".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + rng.choice(words) for _ in range(rng.randint(0, 2))) + rng.choice(["", "/"])
    rules = [url_filter.host_rule(host(), path() or "/", rng.choice(["block", "allow"])) for _ in range(25)]
    rules += [url_filter.pattern_rule(p, rng.choice(["block", "allow"])) for p in ("||ab.", "/en*7", "^x^", "y|", "||com^", "*", "ab*", "|")]
    rules += [url_filter.host_rule("y.com", "/ab", "block"), url_filter.host_rule("x.y.com", "/", "allow"), url_filter.host_rule("ab.com", "/", "block"), url_filter.host_rule("b.com", "/a", "allow")]
    urls = [None, "", "no scheme", "http://x.y.com/abc", "http://q.z/en\nx7", "http://ab.com/a", "x://"] + [f"http://{host()}{path()}{rng.choice(['', '?y', '#x', chr(10) + 'y'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "subject", "best") for i, u in enumerate(urls)], "page_id long, url string, subject string, best string")
    runs = [sorted(map(str, url_filter.filter_urls(pages, rules, max_broadcast=n).collect())) for n in (10, 1000)]
    assert runs[0] == runs[1]
    for r in url_filter.filter_urls(pages, rules, max_broadcast=10).collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        head = re.match(r"[^/?#]*", rest)[0]
        subject = lower(head) + rest[len(head) :]
        best = max((x for x in rules if re.search(x.regex, subject, re.S)), key=lambda x: x.rank, default=None)
        assert (r.rule or r.pattern, r.verdict) == ((best.name, best.verdict) if best else (None, "allow")), r
        assert r.subject == "subject" and r.best == "best"
    assert {r.verdict for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_ledger_is_incremental_and_idempotent(spark, tmp_path, monkeypatch):
    scanned = []
    scan = secret_scan.scan_blobs

    def counted(blobs, kinds=secret_scan.KINDS):
        blobs = saved(blobs)
        scanned.append(sorted(r.text for r in blobs.collect()))
        return scan(blobs, kinds)

    monkeypatch.setattr(secret_scan, "scan_blobs", counted)
    ledger = str(tmp_path / "ledger")
    secret = "token = abcdef123456"
    first = spark.createDataFrame([("a", secret), ("a", "old version"), ("b", secret), (None, None), ("c", "")], "path string, text string")
    one = sorted(map(str, secret_scan.scan_versions(first, ledger).collect()))
    assert scanned == [["", "old version", secret]]
    assert sorted(map(str, secret_scan.scan_versions(first, ledger).collect())) == one and scanned[1] == []
    more = first.unionByName(spark.createDataFrame([("a", "new " + secret), ("d", "old version")], "path string, text string"))
    two = secret_scan.scan_versions(more, ledger).collect()
    assert scanned[2] == ["new " + secret] and len(two) == 7
    assert {(r.path, len(r.spans)) for r in two} == {("a", 1), ("a", 0), ("b", 1), (None, 0), ("c", 0), ("d", 0)}
    # Another version of the rules scans all again, and leaves the first one's findings alone.
    assert secret_scan.scan_versions(more, ledger, rule_version="next").count() == 7 and len(scanned[3]) == 4
    # A job that ran twice, or two scans at once, append the same rows again.
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "-copy")
    spark.read.parquet(ledger + "-copy").write.mode("append").parquet(ledger)
    assert sorted(map(str, secret_scan.scan_versions(more, ledger).collect())) == sorted(map(str, two))


def test_secrets_of_odd_rows(spark, tmp_path):
    rows = [(None, "x"), (1, LONG + " token=abcdef123456"), (1, LONG + " token=abcdef123456"), (2, "é password: 'geheim99' é")]
    docs = odd_docs(spark, rows).withColumnRenamed("doc_id", "path").withColumn("sha", F.lit("clash"))
    found = Counter((r.path, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secret_scan.scan_versions(docs, str(tmp_path / "l")).collect())
    start = len(LONG) + 1
    assert found == Counter({(None, ()): 1, (1, (("assign", start, start + 18),)): 2, (2, (("assign", 2, 21),)): 1})


def confirmed(want, words):
    """Whether some stretch of words is the template with few enough differences: every stretch is tried, by edit distance of words."""
    most = int(license_scan.MAX_DIFF * len(want))
    row = list(range(len(want) + 1))
    for w in words:
        before, row[0] = row[0], 0
        for i, x in enumerate(want, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != w))
        if row[-1] <= most:
            return True
    return False


def test_license_findings_against_every_place():
    rng = random.Random(12)
    forms = [(n, f) for n, fs in license_scan.TEMPLATES.items() for f in fs]
    prose = "the license of this text is told by some words that stand in a row and mean little to anyone who reads them".split()
    judge = license_scan.Judge()
    planted = 0
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randint(1, 4)):
            name, form = rng.choice(forms)
            words = form.split()
            for _ in range(rng.choice([0, 0, 1]) if len(words) > 14 else 0):
                words[rng.randrange(1, len(words) - 1)] = "other"
            parts += [" ".join(rng.choice(prose) for _ in range(rng.choice([2, 9, 500]))), rng.choice([" ", "\n"]).join([" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])])]
            want.append((name, words))
        text = rng.choice([" ", "\n\n"]).join(parts)
        found = list(judge.findings(text))
        spans = sorted((f[1], f[2]) for f in found)
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
        for f in found:  # what is found is there
            own = [w.lower() for w in license_scan.WORDS.findall(text[f[1] : f[2]])]
            assert any(confirmed([w.lower() for w in license_scan.WORDS.findall(form)], own) for n, form in forms if n == f[0]), (f, text[f[1] - 60 : f[2] + 60])
        covered = Counter(f[0] for f in found)
        for name, number in Counter(n for n, _ in want).items():  # and what is there is found
            assert covered[name] >= number, (name, text)
            planted += number
    assert planted > 100


def test_licenses_of_odd_rows(spark):
    mit = license_scan.TEMPLATES["MIT"][0]
    rows = [(None, mit), (1, None), (2, ""), (3, f"{mit}\n{mit}"), (3, f"{mit}\n{mit}"), (4, LONG + " " + mit), (5, "license " * 20000)]
    found = license_scan.scan_licenses(odd_docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.license) for r in found) == Counter({(None, "MIT"): 1, (3, "MIT"): 4, (4, "MIT"): 1})
    long = "word " * 420 + "Released under the MIT License."
    bsd = license_scan.TEMPLATES["BSD"][0].replace(" source ", "\nsource ")
    of = lambda t: [f[0] for f in license_scan.Judge().findings(t)]
    assert of(long) == ["MIT"] and of(f"{mit} {mit}") == ["MIT", "MIT"] and of(f"{mit}\n{bsd}") == ["MIT", "BSD"]
    wrapped = license_scan.TEMPLATES["MIT"][1].replace(" any ", "\nany ")
    assert sorted(of(f"{wrapped}\n{bsd}")) == ["BSD", "MIT"]
    assert sorted(of(f"{mit} {license_scan.TEMPLATES['Apache-2.0'][0]}")) == ["Apache-2.0", "MIT"]


def test_decoding_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    logp = np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS) * 0.3, (toxicity.SYMBOLS, toxicity.SYMBOLS)) + 1e-9)

    def value(ways):
        score, x, y = -sum(cost for _, cost in ways), 0, 0
        for c in "".join(w for w, _ in ways):
            z = 0 if c == " " else int(toxicity.TABLE[ord(c)])
            score, (x, y) = score + (logp[x, y, z] if z or y else 0.0), (y, z) if z else (0, 0)
        return score + (logp[x, y, 0] if y else 0.0)

    for token in ("1d10t", "m0r.n", "a--b", "heeey", "$t!!p", "a b", "o_o", "5+1", "z"):
        paths = list(itertools.product(*toxicity.lattice(token)))
        best = max(map(value, paths))
        texts = {"".join(w for w, _ in p) for p in paths if value(p) > best - 1e-9}
        assert toxicity.decode(token, logp) in texts, token


def test_toxicity_of_odd_rows(spark):
    plain = ["a quiet day in the park", "we met for tea and cake", "the train was late again", "rain fell on the old roof", "she read a long book"]
    rows = [(i, f"{rng} {i} " + (f"horrid {i} vermin {i}" if i % 3 == 0 else "fine")) for i, rng in zip(range(1, 241), itertools.cycle(plain))]
    rows += [(300, ""), (301, None), (302, " \n"), (303, LONG), (304, "horrid v3rm!n"), (None, "horrid vermin"), (None, None), (305, "h o r r i d"), (1, rows[0][1]), (1, rows[0][1])]
    labels = [(i, int(i % 3 == 0)) for i in range(1, 241)] + [(i, 1) for i in (300, 301, 302, 303)] + [(5, None), (None, 1), (999, 1), (7, 0), (7, 0)]
    docs, marks = odd_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, marks).collect()
    assert len(scored) == len(rows) and all(0 <= r.toxic_score <= 1 and not math.isnan(r.toxic_score) for r in scored)
    by = {r.doc_id: r for r in scored}
    assert by[3].toxic_predicted == by[304].toxic_predicted == 1 and by[1].toxic_predicted == by[300].toxic_predicted == 0
    assert by[300].toxic_score == by[301].toxic_score == by[302].toxic_score
    assert len({r.toxic_score for r in scored if r.doc_id == 1}) == 1
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic_predicted for r in scored)
    for few in (marks.limit(0), marks.where("toxic = 1"), marks.where("toxic = 0")):
        assert {r.toxic_score for r in toxicity.score_toxicity(docs, few).collect()}.__len__() == 1
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def test_calibration_follows_the_counts():
    rng = np.random.default_rng(5)
    top, rest = rng.uniform(0, 6, 4000), rng.uniform(0, 3, 4000)
    y = rng.uniform(size=4000) < 1 / (1 + np.exp(4 - top - rest))
    bias, a, b = toxicity.calibrated(zip(top, rest, y, np.ones(4000), strict=True))
    assert abs(bias + 4) < 0.6 and abs(a - 1) < 0.2 and abs(b - 1) < 0.3
    assert toxicity.calibrated(zip(top, -rest, y, np.ones(4000), strict=True))[2] == 0
    assert np.isfinite(toxicity.calibrated([(1.0, 0.0, 1, 5), (0.0, 0.0, 0, 5)])).all()


def test_mixing_of_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", "empty"), (None, "one two", None), (4, LONG, "y"), (5, "é ü", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(3).alias("copy"), F.lit(4).alias("rate"), F.lit(5).alias("of"), F.lit(6).alias("n"))
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == len(rows) and all(0 <= r.copies <= 2 and r.target <= 2 * r.source_size + 1e-9 for r in mixed)
    assert {r.target for r in mixed if r.source == "empty"} == {0.0}
    out = mixing.emit_copies(docs)
    assert out.columns == [c for c in docs.columns if c != "copy"] + ["copy"]
    want = Counter()
    for r in mixed:
        want[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
    assert got == +want and mixing.emit_copies(docs.limit(0)).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.emit_copies(docs).collect()))


def test_chunks_hold_whole_characters_and_no_header():
    for text in ("", "abc", "é" * 50, "x" * 30 + "WARC/1.0\r\n" * 3 + "y" * 9, "WARC/1.0\r\n", "€uro WARC/1.0\r" + "z" * 20 + "\n"):
        data = text.encode()
        for n in (4, 7, 16, 1000):
            spans = list(warc.cuts(memoryview(data), n))
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
            assert all(e - b <= n for b, e in spans) and "".join(data[b:e].decode() for b, e in spans) == text
            assert not any(b"WARC/1.0\r\n" in data[b:e] for b, e in spans)


def test_a_large_payload_is_never_held_twice():
    size = 200 << 20
    batch = pa.record_batch([pa.array([1]), pa.array([2]), pa.array(["u"]), pa.array(["<p>large</p>" * (size // 12)])], names=["rid", "page_id", "url", "html"])
    tracemalloc.start()
    n = total = held = 0
    for out in warc.chunker(warc.CHUNK_BYTES)(iter([batch])):
        n, total, held = n + out.num_rows, total + out.column("chunk").nbytes, max(held, out.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 3000 and total > size and peak < 16 << 20 and held < 16 << 20


def test_archives_of_odd_rows(spark, tmp_path):
    page = "x" * 2000
    rows = [(None, None, page), (1, "u", page), (1, "u", page), (2, "a b", page), (3, "u", None), (3, "u", None), (4, "u", "é" * 100_000), (5, "u", "WARC/1.0\r\n" * 400)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("rid"), F.lit("z").alias("sha"), F.lit("z").alias("chunk"))
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        warc.write_archives(warc.record_table(docs, chunk_bytes=1000), path, compression=kind)
        found = warc.payloads(warc.read_archives(spark, path)).collect()
        assert len(found) == len(rows)
        assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found) == Counter({
            (None, 2000, "revisit", 2): 1, (1, 2000, "revisit", 2): 2, (2, 2000, "response", None): 1, (3, 0, "response", None): 2, (4, 200_000, "response", None): 1, (5, 4000, "response", None): 1,
        })


def test_large_buckets_get_finer_keys(spark, monkeypatch):
    """Many fingerprints that share keys, in buckets far over a block, link as by brute force."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 1)[0]
    fps = [int(base) ^ sum(1 << int(b) for b in rng.choice(np.r_[46:63], rng.integers(0, 9), replace=False)) for _ in range(400)]
    fps += [f ^ (1 << 3) for f in fps[:40]] + [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 100)]
    fps = np.array(sorted(set(fps)), np.int64)
    monkeypatch.setattr(simhash, "fingerprints", lambda shingle: lambda text: text.cast("long"))
    docs = spark.createDataFrame([(i, str(f)) for i, f in enumerate(fps)], "doc_id long, text string")
    label = np.arange(len(fps))
    near = simhash.distances(fps[:, None, None], fps[None, :, None]) <= 3
    for _ in range(len(fps)):
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            break
        label = low
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert [found[i] for i in range(len(fps))] == label.tolist()


def test_near_duplicates_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, words), (2, words + " end"), (2, words + " end"), (None, words), (3, ""), (4, None), (5, "a few words"), (6, "A few  WORDS"), (7, LONG)]
    docs = odd_docs(spark, rows)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 5, 7])
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0
    names = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in simhash.drop_near_copies(names).collect()} == {"d1", "d3", "d5", "d7"}


def test_join_by_key_with_hot_keys(spark):
    left = saved(spark.createDataFrame([(1, i) for i in range(50)] + [(2, 60), (3, 61), (None, 62)], "k long, v long"))
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k long, w string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, "k", how).select("k", "v", "w").collect()))
        for share in (1, 2, 1000):
            assert sorted(map(str, common.join_by_key(left, right, "k", how, share).select("k", "v", "w").collect())) == want


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, odd rows among real ones."""
    import corpus_pipeline as p

    real = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = [(9001, "", "en", "s", 0), (9002, None, None, None, None), (9003, LONG, "en", "s", 1), (9003, LONG, "en", "s", 1), (None, "one two three", "en", "s", 1), (9004, "One two THREE", "en", None, 1), (9005, " ", "xx", "t", 0)]
    docs = real.unionByName(spark.createDataFrame(extra, real.schema)).withColumn("row", F.lit(1)).withColumn("copy", F.lit(2)).withColumn("k1", F.lit("k"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.createDataFrame([(9001, 1, 1), (9002, 1, 1)], "doc_id long, quality int, toxic int").write.mode("append").parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontaminate", "mix_sources"]
    run = lambda name, d: saved(stages[name](spark, d, str(tmp_path)))
    ids = lambda rows: Counter((r.doc_id, r.text) for r in rows)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = toxicity.score_toxicity(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    kept = run("toxicity", docs)
    assert ids(kept.collect()) == ids(r for r in scores if not r.toxic_predicted) and kept.columns == docs.columns

    best = {}
    for r in kept.collect():
        t = lower(r.text)
        best[t] = min(best.get(t, r.doc_id), r.doc_id, key=lambda i: (i is None, i or 0)) if t in best else r.doc_id
    one = run("exact_dedup", kept)
    assert Counter((r.doc_id, lower(r.text)) for r in one.collect()) == Counter((i, t) for t, i in best.items()) and one.columns == docs.columns

    rows = one.collect()
    sets = [set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows]
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    two = run("simhash_near_dedup", one)
    left = {(r.doc_id, r.text) for r in two.collect()}
    groups = {}
    for r, g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append((r.doc_id, r.text))
    assert all(len(left & set(g)) >= 1 for g in groups.values())
    assert sum(len(left & set(g)) == 1 for g in groups.values()) >= 0.97 * len(groups) and two.columns == docs.columns

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    three = run("decontaminate", two)
    clean = {(r.doc_id, r.text) for r in three.collect()}
    assert clean <= left and not any(i in decontaminate.normal(t) for _, t in clean for i in items if i)
    gone = left - clean
    for _, t in gone:  # what goes holds an item, by plain edit distance
        text = decontaminate.normal(t)
        assert any(decontaminate.myers(i, text, decontaminate.masks_of(i))[0] <= len(i) // 10 for i in items if i)

    rates = mixing.mix_sources(three).collect()
    out = run("mix_sources", three)
    want = Counter()
    for r in rates:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +want
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == +want


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_host_rules_without_a_path_and_columns_in_another_case(spark):
    pages = spark.createDataFrame([(1, "http://example.com"), (2, "http://example.community/x"), (3, "http://a.EXAMPLE.com/y?z"), (4, "http://example.com#f"), (5, "http://x.org/?ref=x\n"), (6, "http://x.org/?ref=x"), (7, "http://badexample.com/")], "page_id long, url string").withColumns({"Host": F.lit("own"), "VERDICT": F.lit(1), "a.b": F.lit(2)})
    rules = [url_filter.host_rule("Example.COM", "", "block"), url_filter.pattern_rule("^ref=x|", "block")]
    for most in (1, 10):
        rows = url_filter.filter_urls(pages, rules, max_broadcast=most)
        assert rows.columns == ["page_id", "url", "a.b", "host", "path", "rule", "pattern", "verdict"]
        assert {r.page_id for r in rows.where("verdict = 'block'").collect()} == {1, 3, 4, 6}


def test_toxicity_stage_keeps_columns_with_dots(spark):
    docs = spark.createDataFrame([(i, "some plain words" if i % 2 else "idiot scum") for i in range(30)], "doc_id long, text string").withColumns({"a.b": F.lit(1), "Text.x": F.lit(2)})
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(30)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} <= {0, 1}


@pytest.mark.parametrize("between", ["\n", "\n\n", "\r\n", "\n# ", "\n * ", "\n// ", "  ", "\t\n"])
def test_notices_are_found_over_any_line_breaks(between):
    """Each template cut at each word, and at every second and at every word, amid prose."""
    judge = license_scan.Judge()
    prose = " ".join(f"some{i} plain prose here" for i in range(30))
    for name, forms in license_scan.TEMPLATES.items():
        for form in forms:
            words = form.split(" ")
            cuts = [between.join([" ".join(words[:i]), " ".join(words[i:])]) for i in range(1, len(words))]
            cuts += [between.join(" ".join(words[i : i + n]) for i in range(0, len(words), n)) for n in (1, 2)]
            for cut in cuts:
                for text in (cut, f"{prose}\n{cut}\n{prose}", f"{prose} {cut} {prose}"):
                    found = list(judge.findings(text))
                    assert [f[0] for f in found] == [name], (text[:200], found)


def test_license_scan_takes_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "Released under\nthe MIT License."), (None, "Licensed under CC BY 4.0."), ("c", None)], "doc_id string, text string").withColumn("a.b", F.lit(1))
    rows = license_scan.scan_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in rows} == {("a", "MIT"), (None, "CC-BY-4.0")}
