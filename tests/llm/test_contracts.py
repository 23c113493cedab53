"""Queries against their SQL on the smallest tables and on odd rows."""

import pytest
from oracle import DATA, same

from fleetloom.llm import registry

LONG = "word " * 30000 + "token = abcdef123456 AKIA" + "Z" * 20
ODD = [
    (1, "", "a"), (2, None, "a"), (3, "Same Text", None), (4, "same text", "b"), (5, "sAME tEXT", "b"), (5, "sAME tEXT", "b"), (6, "É token: 'secret99' é", "ü"),
    (7, LONG, "a"), (8, LONG.upper(), "c"), (9, "password=short1 password=ab token=token = longvalue123", "c"), (10, "\t\n ", "c"), (11, "0123456789abcdef0123456789abcdef", "c"),
    (12, "ghp_" + "a" * 40 + " -----BEGIN RSA PRIVATE KEY-----", "c"), (13, "AKIAABC AKIA" + "Q" * 16, None),
]
URLS = [(1, "https://www.Example.com/en/71?x=1"), (2, None), (3, "no scheme"), (4, "http://"), (5, "ftp://a.b.example.net/de/8#x"), (6, "http://com/en/"), (7, "http://notexample.com/en/7"), (8, "http://x.org?/es/"), (9, "http://m.spam-farm.z/fr/6a.html?ref=x"), (9, "http://m.spam-farm.z/fr/6a.html?ref=x"), (10, "http://ÉX.net/de/\n?ref=x"), (11, "http://spam-farm.")]
PAGE = "x" * 999
PAGES = [(1, "u", PAGE), (2, "u", PAGE), (3, "u", PAGE + "y"), (4, None, PAGE + "y"), (5, "a\r\nb", "WARC/1.0\r\n" * 200), (6, "u", None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" * 9000), (9, "u", "\r\n\r\n" * 500), (10, "u", "\r\n\r\nWARC/1.0\r" + "z" * 70000 + "\r\n")]
TURNS = [(1, 0, "user", "a & b"), (1, 1, "user", "<|im_end|>"), (1, 2, "assistant", "&lt;|"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "a\nb<|", "x\n"), (3, 0, "a\nb<|", "x\n"), (3, None, "assistant", "first")]
NAN = float("nan")
VECTORS = [(0, [1.0, 0.5], 1), (50, [0.0, 0.0], 1), (100, [-1.0, 0.25], None), (150, None, 2), (200, [0.5, NAN], 2), (1, [1.0, 0.25], 1), (2, [0.75, 0.5], 1), (2, [0.75, 0.5], 1), (3, [float("inf"), 0.0], 1), (4, [0.6, 0.4], 2), (5, [0.6, 0.4], 2), (7, [0.9, 0.1], 1), (None, [1.0, 1.0], 1), (9, [None, 1.0], 1), (10, [0.59, 0.41], 3), (250, [-0.001, -1.0], 2), (11, [0.0, -0.8], 2), (12, [0.1, -0.7], 1)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    import pandas as pd

    pd.DataFrame({"doc_id": pd.array([r[0] for r in ODD], "Int64"), "text": [r[1] for r in ODD], "source": [r[2] for r in ODD], "norm": "clash", "row": 1, "count": 2}).to_parquet(d / "documents.parquet")
    pd.DataFrame(URLS, columns=["page_id", "url"]).assign(html=None, host="clash", subject="clash").astype({"html": "string"}).merge(pd.DataFrame([], columns=[]), how="left", left_index=True, right_index=True).to_parquet(d / "pages.parquet")
    pd.DataFrame({"conv_id": [r[0] for r in TURNS], "turn": pd.array([r[1] for r in TURNS], "Int64"), "role": [r[2] for r in TURNS], "text": [r[3] for r in TURNS]}).to_parquet(d / "conversations.parquet")
    pd.DataFrame(VECTORS, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"}).assign(id=1, v=2).to_parquet(d / "embeddings.parquet")
    w = tmp_path_factory.mktemp("web")
    pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).assign(rid=1, n=2).to_parquet(w / "pages.parquet")
    return {"op10_warc": str(w)}.get, str(d)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_small_tables(spark, name):
    assert same(registry.QUERIES[name](spark, f"{DATA}/sf0.001"), registry.ORACLES[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - {"op5_exact_dedup"}))
def test_odd_rows(spark, odd, name):
    special, d = odd
    sf = special(name) or d
    assert same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_exact_dedup_on_odd_rows(spark, odd):
    rows = registry.QUERIES["op5_exact_dedup"](spark, odd[1]).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    for group in by.values():
        assert {(r.keep_id, r.group_size) for r in group} == {(max(r.doc_id for r in group), len(group))}
        assert sum(r.kept for r in group) == 1  # of repeated rows, one
    assert len(by) == len({"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "") for r in ODD})


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, q in registry.QUERIES.items():
        assert q(spark, str(tmp_path)).count() == (1 if name == "op6_chat_format" else 0), name
