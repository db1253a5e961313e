import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import quality, toxicity
from tests.llm.helpers import EDGE as CASES
from tests.llm.helpers import documents, prose

EDGE = [(i and i + 10_000, t) for i, t in CASES]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_segments(scores):
    """All maximal segments by their definition: best part, then the same left and right of it."""
    n, best = len(scores), None
    for a in range(n):
        total = 0.0
        for z in range(a, n):
            total += scores[z]
            if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                best = (a, z, total)
    if best is None:
        return []
    a, z, _ = best
    right = [(x + z + 1, y + z + 1, s) for x, y, s in plain_segments(scores[z + 1 :])]
    return plain_segments(scores[:a]) + [best] + right


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 0.37, 1.13, 2.71]), max_size=24))
def test_segments_are_the_maximal_ones(gain):
    drift = 0.2501
    scores = [g - drift for g in gain]
    at = [i for i, g in enumerate(gain) if g]
    got = toxicity.maximal_segments(at, [gain[i] for i in at], drift)
    want = plain_segments(scores)
    assert np.allclose(sorted(s for *_, s in got), sorted(s for *_, s in want))


def test_passages_have_places():
    gains = toxicity.Gains({"vilewordx": 3.0, "nasty*": 2.0})
    text = "Hello there. VileWordx and nastyword end " + "plain " * 200 + "nastyish"
    n, found = toxicity.find_segments(text, gains)
    assert n == 207 and [text[a:z] for _, _, a, z, _ in found] == ["VileWordx and nastyword", "nastyish"]
    assert abs(found[0][4] - (5.0 - 3 * toxicity.DRIFT)) < 1e-9
    assert toxicity.find_segments(None, gains) == (0, []) and toxicity.find_segments("plain", gains) == (1, [])


def test_toxic_documents_are_found(spark):
    r, texts, marks = random.Random(5), [], []
    for i in range(500):
        words, toxic = prose(i, 60 + i % 50).split(), int(i % 5 == 0)
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = r.choices(["vilewordx", "nastyword", "uglyterms", "badspeech"], k=5)
        texts.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    marks += [(7, 1, 1), (900, 1, 1), (None, 1, 0), (8, 0, None)]
    rows = toxicity.score_toxicity(documents(spark, texts + EDGE), labels(spark, marks)).collect()
    assert len(rows) == len(texts) + len(EDGE)
    got = {r.doc_id: r for r in rows}
    for i, _, toxic in marks[:500]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(500) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.95 * len(held)
    assert all(got[i].score < 0.5 and not got[i].passages for i in (10_100, 10_101, 10_102))
    none = toxicity.score_toxicity(documents(spark, texts[:5]), labels(spark, [])).collect()
    assert {r.predicted for r in none} == {0} and all(0 <= r.score < 0.01 for r in none)
    assert toxicity.score_toxicity(documents(spark, []), labels(spark, marks)).count() == 0


def junk(seed):
    return "!! ".join(w.upper() for w in prose(seed, 60).split()) if seed % 2 else " ".join(["spam"] * 40 + ["$$$"] * 30)


def test_good_documents_stay_and_junk_goes(spark):
    texts = [(i, junk(i) if i % 4 == 0 or i % 12 == 1 else prose(i, 40 + i % 90)) for i in range(600)]
    good = {i: int(not (i % 4 == 0 or i % 12 == 1)) for i in range(600)}
    marks = [(i, q, 0) for i, q in good.items() if i % 2 == 0 or i % 3 == 0] + [(2, 0, 0), (None, 1, 0), (5000, 1, 1), (3, None, 0)]
    docs = documents(spark, texts + EDGE)
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels(spark, marks)).collect()}
    assert len(rows) == len(texts) + len(EDGE) and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in good if rows[i].held_out]
    assert held == [i for i in good if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(rows[i].predicted == good[i] for i in held) >= 0.93 * len(held)
    kept = quality.keep_good(docs, labels(spark, marks))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, r in rows.items() if r.predicted}


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text"), *EDGE])
    rows = quality.score_quality(docs, labels(spark, [])).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.5, 1)}
    assert quality.keep_good(docs, labels(spark, [])).count() == docs.count()
    assert quality.score_quality(documents(spark, []), labels(spark, [(1, 1, 0)])).count() == 0
