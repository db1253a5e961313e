import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from brightloom.llm import spelling
from tests.llm.helpers import documents


def one_edit(a, b):
    """By trying every edit, for short alphabets."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain(texts, every=199):
    n = Counter()
    for doc, text in texts:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=lambda r: r[0])


def got(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def noisy(seed, docs=60, letters="abé"):
    r = random.Random(seed)
    base = ["".join(r.choices(letters, k=r.randint(5, 9))) for _ in range(40)]
    texts = []
    for d in range(docs):
        words = []
        for _ in range(120):
            w = base[min(int(r.expovariate(0.15)), 39)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", r.choice(letters), r.choice(letters) + w[at]]) + w[at + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        texts.append((d, r.choice([" ", ", ", "\n", "1", "漢"]).join(words)))
    return texts


@pytest.mark.parametrize("block, tile", [(2048, 128), (6, 4), (30, 7)])
def test_same_as_all_pairs(spark, monkeypatch, block, tile):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block)
    monkeypatch.setattr(spelling, "TILE", tile)
    texts = noisy(block)
    want = plain(texts)
    assert len(want) > 100 and max(r[2] for r in want) > 5
    assert got(spelling.group_spellings(documents(spark, texts))) == want


def test_pairs_appear_once_each_way(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 3)
    words = ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa", "aabaaa", "aaaaaab", "zzzzzz", "aaaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "\U0001f600aaaaaa"]
    path = spelling.fresh_path(spark, "w")
    spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").write.parquet(path)
    found = Counter((r.word, r.other) for r in spelling.near_words(spark.read.parquet(path)).collect())
    want = {(a, b) for a in words for b in words if one_edit(a, b)}
    assert set(found) == want and set(found.values()) == {1}


def test_forms_chain_and_tie(spark):
    many = {"abcdefgh": 300, "abcdefg": 50, "abcdef": 6, "abcdefx": 7, "qqqqqqa": 25, "qqqqqqb": 25, "qqqqqqc": 5, "alones": 5, "fourth": 4}
    rows = [(1, " ".join(f"{w} " * c for w, c in many.items()))]
    out = {r[0]: r for r in got(spelling.group_spellings(documents(spark, rows), every=10**9 + 7))}
    assert "fourth" not in out
    assert out["abcdef"] == ("abcdef", 6, 2, "abcdefg", 50, "abcdefgh") and out["abcdefg"][3:] == ("abcdefgh", 300, "abcdefgh")
    assert out["qqqqqqc"][3:] == ("qqqqqqa", 25, "qqqqqqa") and out["qqqqqqa"][2:] == (2, None, None, "qqqqqqa")
    assert out["alones"] == ("alones", 5, 0, None, None, "alones")


def test_deleted_code_points(spark):
    # every run loses one, as the checksum is a multiple of 1; ids that are missing read as empty
    texts = [(7, "Straße×naïve " * 5), (None, "lettersÀ " * 6), (7, "Straße×naïve")]
    assert got(spelling.group_spellings(documents(spark, texts), every=1)) == plain(texts, every=1)


def test_edge_tables(spark):
    assert got(spelling.group_spellings(documents(spark, []))) == []
    assert got(spelling.group_spellings(documents(spark, [(1, None), (2, ""), (3, "  \n "), (4, "short"), (5, "漢字漢字漢字漢字 " * 9)]))) == []
    long = [(1, "word" * 20_000 + " " + "seldom " * 4), (2, "seldom")]
    assert got(spelling.group_spellings(documents(spark, long * 5))) == plain(long * 5)


def test_flushed_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNT_ROWS", 3)
    texts = noisy(9, docs=10)
    assert got(spelling.group_spellings(documents(spark, texts))) == plain(texts)
