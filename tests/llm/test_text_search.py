import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import decontam, passages, pii
from tests.llm.helpers import EDGE, documents, prose

FORMATS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="a1.@-+ (2_0%9é\n", max_size=60))
def test_fixed_formats(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_stay_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "a@b" * 50_000):
        pii.candidates(text, pii.base_spans(text))


SEEDS = ["4111111111111111", "5500000000000004", "340000000000009", "30000000000004", "6011000000000004"]


def test_patterns_find_unseen_identifiers(spark):
    texts = [(i, f"hello there my card number is {v} thanks a lot") for i, v in enumerate(SEEDS)]
    texts += [(10, "hello there my card number is 4111111111111112 thanks a lot"), (11, "in the year 2020 here"), *EDGE, (10, "hello there my card number is 4111111111111112 thanks a lot")]
    rows = pii.report(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[10].n_card == 0 and by_id[10].spans == "card:30:46" and by_id[10].base_sha256 == pii.digest([])
    assert by_id[11].spans == "" and by_id[100].spans == "" and by_id[0].n_card == 1
    out = pii.redact(documents(spark, texts))
    assert out.columns == documents(spark, texts).columns
    red = {r.doc_id: r for r in out.collect()}
    assert red[10].text == "hello there my card number is <CARD> thanks a lot" and red[10].n_chars == len(red[10].text)
    assert red[100].text is None and red[11].text == "in the year 2020 here" and red[0]["__pii_key"] == "k"
    assert pii.report(documents(spark, [])).count() == 0 and pii.redact(documents(spark, [])).count() == 0


PHONES = [f"+1 (843) 555-{k}" for k in (7672, 5254, 1017, 3380, 9026)]
UNKNOWN = ["4111111111111112", "5500 0000 0000 0005", "340000000000001", "30000000000009", "6011-0000-0000-0009", "4222222222222229"]
KEYS = ["ed85aea7af91af30d358df8319c45ee8ae9f5135", "740d10cfb38a379bfbce847f43f32482d573dc8b", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "65f8700754a1d8161928a1d0cca87ca77d009e4f"]


def identifiers():
    """Texts and, by doc_id, the spans that only patterns find."""
    texts = [(i, f"note {i}: the number of my card {v} was lost") for i, v in enumerate(SEEDS)]
    texts += [(20 + i, f"note {i}: the number of my card {v} was lost") for i, v in enumerate(UNKNOWN)]
    # a second context, which only values found in the first one make trustworthy, and a new value in it
    texts += [(40 + i, f"paid by plastic ending {v} on {i} March") for i, v in enumerate([*UNKNOWN, "4333333333333331"])]
    texts += [(60 + i, f"please call me on {v} tonight") for i, v in enumerate(PHONES)]
    texts += [(70, "please call me on 843 555 1234 tonight"), (71, "please call me on 12 tonight"), (72, "and 843 555-1234 again, alone")]
    texts += [(80 + i, f'secret token = "{v}" {"x" * i}') for i, v in enumerate(KEYS)]
    texts += [(90, 'secret token = "hunter2hunter2"'), (91, f"commit {KEYS[0][::-1]} merged"), (92, "in 2020 and 2021 there were 10000000 of them")]
    texts += [(93, "the number of my card joe@example.org 4111111111111111 and"), (94, "year 2020 2021 2022")]
    want = {20 + i: [("card", v)] for i, v in enumerate(UNKNOWN)}
    want |= {40 + i: [("card", v)] for i, v in enumerate([*UNKNOWN, "4333333333333331"])}
    want |= {70: [("phone", "843 555 1234")], 72: [("phone", "843 555-1234")], 90: [("key", "hunter2hunter2")]}
    want |= {80 + i: [("key", v)] for i, v in enumerate(KEYS)}
    return texts, want


def plain_rounds(texts):
    """Spans per document by the rounds on sets in plain Python."""
    values = {(i, *v[:2]): v for i, t in texts for v in pii.candidates(t, pii.base_spans(t))}
    kind, may, around = {}, {}, {}
    for _, _, code, k, bits, patterns in values.values():
        if k:
            kind[code] = max(k, kind.get(code, k))
        for p in patterns:
            around.setdefault(p, set()).add(code)
            may[p, code] = may.get((p, code), 0) | bits
    keys = {c for c, k in kind.items() if k == "key"}
    while True:
        trusted = []
        for p, codes in around.items():
            for b, k in enumerate(pii.ALL_KINDS):
                n = sum(1 for c in codes if may[p, c] and kind.get(c) == k)
                against = sum(1 for c in codes if not may[p, c] or kind.get(c, k) != k or c not in kind and not may[p, c] >> b & 1)
                if n >= pii.MIN_SEEDS and n / (n + against + 1) >= pii.MIN_CONFIDENCE:
                    trusted.append((p, k, b, n / (n + against + 1)))
        doubt = {}
        for p, k, b, confidence in trusted:
            for c in around[p]:
                if c not in kind and may[p, c] >> b & 1:
                    doubt[c, k] = doubt.get((c, k), 1.0) * (1 - confidence)
        if not doubt:
            break
        kind |= {c: max((1 - d, k) for (x, k), d in doubt.items() if x == c)[1] for c, _ in doubt}
    shown = {c for p, k, *_ in trusted if k == "key" for c in around[p]}
    out = {}
    for (i, a, z), (_, _, code, k, _, _) in values.items():
        if k in (None, "key") and code in kind and not (code in keys and code not in shown):
            out.setdefault(i, set()).add((a, z, kind[code]))
    return out


def test_rounds_spread_to_new_contexts_and_spellings(spark):
    texts, want = identifiers()
    rows = texts + EDGE + texts[:30]
    found = pii.find_base(documents(spark, rows).select("doc_id", "text"))
    more = {r.doc_id: {(s.start, s.end, s.kind) for s in r.more} for r in pii.discovered(found).collect()}
    assert more == plain_rounds(texts)
    by_id = dict(texts)
    assert {i: [(k, by_id[i][a:z]) for a, z, k in sorted(x)] for i, x in more.items()} == want
    report = {r.doc_id: r for r in pii.report(documents(spark, rows)).collect()}
    assert report[93].spans.count(":") == 4 and report[93].n_email == report[93].n_card == 1
    red = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    assert red[90] == 'secret token = "<KEY>"' and red[70] == "please call me on <PHONE> tonight" and red[91] == by_id[91]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@-+ (2_0)9é\n", max_size=60))
def test_values_lie_beside_the_fixed_formats(text):
    spans = pii.base_spans(text)
    values = pii.candidates(text, spans)
    assert [v[0] for v in values] == sorted(v[0] for v in values) and all(0 <= v[0] < v[1] <= len(text) for v in values)
    for a, z, _, kind, *_ in values:
        if kind in pii.KINDS:
            assert (a, z, kind) in spans
        else:
            assert any(c in "@0123456789" for c in text[a:z])


def test_overlapping_spans_are_covered_once():
    assert pii.cover("ab 1.2.3.4 cd", [(3, 10, "ip"), (5, 10, "card")]) == "ab <IP> cd"
    assert pii.cover("0123456789", [(1, 4, "ip"), (3, 6, "card")]) == "0<IP>6789"


def plain_repeats(texts):
    first, out = {}, set()
    for i, t in sorted({x for x in texts}, key=lambda x: (x[0] is None, x[0] or 0)):
        for a, z in passages.units(t):
            u = " ".join(t[a:z].lower().split())
            if u in first:
                out.add((i, a, z, *first[u]))
            else:
                first[u] = (i, a, z)
    return out


def test_repeated_passages(spark):
    shared = "This passage has certainly more than eight words in it. And so does the next sentence of this very passage."
    texts = [(i, f"{prose(i, 20)} x{i}. {shared} {prose(50 + i, 15)} end{i} of text number {i} here.") for i in range(12)]
    texts += [(30, shared.upper() + "\n" + shared), (31, "Short line.\nShort line.\n" * 5), *EDGE, (30, shared.upper() + "\n" + shared)]
    got = {tuple(r) for r in passages.repeated_units(documents(spark, texts)).collect()}
    assert got == plain_repeats(texts)
    assert {i for i, *_ in got} == {*range(1, 12), 30}
    copies = [(i, prose(7, 300)) for i in range(200)]
    assert {r.kept_doc_id for r in passages.repeated_units(documents(spark, copies)).collect()} == {0}
    assert passages.repeated_units(documents(spark, [])).count() == 0


QUESTION = "A train leaves Boston at 60 miles per hour and meets Tom after 3 hours of travel with Tom"


def test_template_leaks(spark):
    benchmark = spark.createDataFrame([(1, QUESTION), (2, "Short one here"), (3, None), (4, ""), (1, QUESTION), (None, "no id for this question")], "item_id long, text string")
    other = "A train leaves Chicago at 75 miles per hour and meets Ann after 8 hours of travel with {}"
    texts = [
        (1, "hello. " + other.format("Ann") + ". bye"), (2, other.format("Bob")), (3, "foo short one here bar"), (4, QUESTION.lower()),
        (5, prose(3, 5000) + " " + QUESTION + " " + prose(4, 50)), (6, prose(5, 100)), *EDGE, (5, prose(3, 5000) + " " + QUESTION + " " + prose(4, 50)),
    ]
    rows = {(r.doc_id, r.item_id): r for r in decontam.leaks(documents(spark, texts), benchmark).collect()}
    assert set(rows) >= {(1, 1), (3, 2), (5, 1)} and {d for d, _ in rows} <= {1, 3, 4, 5}
    assert not rows[1, 1].verbatim and rows[5, 1].verbatim and rows[5, 1].cover >= 0.9
    t = dict(texts)[5]
    assert t[rows[5, 1].start : rows[5, 1].end] == QUESTION[2:]  # its first word is a capital inside a sentence here
    left = decontam.without_leaks(documents(spark, texts), benchmark)
    assert left.columns == documents(spark, texts).columns and {r.doc_id for r in left.collect()} >= {2, 6, None, 100, 101}
    assert decontam.leaks(documents(spark, []), benchmark).count() == 0
    assert decontam.leaks(documents(spark, texts), benchmark.limit(0)).count() == 0


def plain_windows(text, width):
    words = [t.lower() for t in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", text or "")]
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)], len(words)


def held_whatever_the_case(texts, items):
    """(doc_id, item_id) where at least 0.6 of the question's windows stand in the text, by brute force."""
    out = set()
    for item, question in items:
        wanted = plain_windows(question, max(1, min(decontam.WINDOW, plain_windows(question, 1)[1])))[0]
        for doc, text in texts:
            there = set(plain_windows(text, len(wanted[0]))[0]) if wanted else set()
            if wanted and sum(w in there for w in wanted) >= 0.6 * len(wanted):
                out.add((doc, item))
    return out


def test_leaks_whatever_the_case(spark):
    items = [(1, QUESTION), (2, "What is the name of the river that flows through Paris and Rouen into the sea"), (3, "THE HEAT OF THE SUN IS WHAT KEEPS ALL OF US ALIVE"), *[(10 + k, prose(70 + k, 25)) for k in range(5)]]
    change = (str.lower, str.upper, str.title, str.swapcase)
    texts = [(100 * i + k, f"{prose(i + k, 40)} {f(q)} {prose(k, 30)}") for i, q in items for k, f in enumerate(change)]
    texts += [(5000 + i, f"{prose(i, 10)} {' '.join(q.split()[: len(q.split()) * n // 8]).upper()} {prose(i, 9)}") for i, q in items for n in (3, 7)]
    texts += [(4, QUESTION.lower()), (6, prose(5, 100))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontam.leaks(documents(spark, texts), benchmark).collect()}
    assert (4, 1) in rows and rows[4, 1].verbatim and (rows[4, 1].start, rows[4, 1].end) == (0, len(QUESTION))
    expected = held_whatever_the_case(texts, items)
    assert len(expected) >= 4 * len(items) and set(rows) == expected


def test_leaks_with_fillers_that_coincide_or_change_once(spark):
    apples = "if a farmer sells 3 apples and then buys 5 pears from the market how much does the farmer have to pay"
    long = ("the treaty of Verona was signed by both kings after a long winter and it was in the town of Verona that "
            "the envoys met again to settle who would pay for the broken bridges and the burnt mills along the border")
    benchmark = spark.createDataFrame([(1, apples), (2, long)], "item_id long, text string")
    texts = [
        (1, apples.replace("3", "4").replace("5", "4")), (2, long.replace("Verona", "Pavia", 1)), (3, long[::-1].replace("anoreV", "Pavia", 1)[::-1]),
        (4, long.replace("Verona", "Pavia")), (5, "the " + prose(3, 60)),
    ]
    rows = {(r.doc_id, r.item_id): r for r in decontam.leaks(documents(spark, texts), benchmark).collect()}
    assert rows.keys() == {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert rows[1, 1].cover == rows[4, 2].cover == 1 and not rows[1, 1].verbatim and rows[2, 2].verbatim and 0.7 < rows[2, 2].cover < 1


def test_majority_of_the_mentions():
    def window(at, q, d):
        return {"q_pos": at, "nth": at, "form": 0, "start": at, "end": at + 1, "fill": [{"at": at, "q": q, "d": d}]}

    def kept(*fills):
        return [(p, t) for p, t, *_ in decontam.consistent([window(k, *f) for k, f in enumerate(fills)])]

    assert kept(("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")) == [(0, True), (1, True), (3, True)]
    assert kept(("a", "x"), ("a", "a"), ("b", "b")) == [(1, True), (2, True)]
    assert kept(("a", "x"), ("a", "y"), ("b", "b")) == [(2, False)]


def test_leaks_of_short_questions_and_of_long_stretches(spark):
    long = " ".join(w for w in prose(11, 200).replace(".", "").split())
    renamed = "when Anna and Berta went to see the old mill near Ulm with Carla they found nobody there but a dog of 7 years that barked " + long
    benchmark = spark.createDataFrame([(1, "What is 12 + 45?"), (2, long), (3, renamed)], "item_id long, text string")
    words = long.split()
    texts = [
        (1, "so tell me: what is 12 + 45? I do not know"), (2, "so tell me: what is 12 + 46?"), (3, "zz " + " ".join(words[50:63]) + " zz"),
        (4, "zz " + " ".join(words[50:62]) + " zz"), (5, "zz when Dora and Emma went to see the old mill near Bonn with Frida they found nobody there but a dog of 9 years that barked zz"),
    ]
    rows = {(r.doc_id, r.item_id) for r in decontam.leaks(documents(spark, texts), benchmark).collect()}
    assert rows == {(1, 1), (3, 2), (3, 3), (5, 3)}


def test_repeated_stretches_inside_long_lines(spark):
    shared = prose(90, 50).replace(".", "")
    texts = [(i, f"{prose(i, 30 + i).replace('.', '')} {shared if i % 2 else shared.title()} {prose(60 + i, 40).replace('.', '')}") for i in range(6)]
    texts += [(10, prose(200, 20) + " " + shared.replace(" ", "\n")), (11, "la " * 100), *EDGE]
    rows = passages.repeated_units(documents(spark, texts)).collect()
    assert {tuple(r) for r in rows} == plain_repeats(texts)
    earlier = set()
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        spans = [m.span() for m in re.finditer(r"\S+", t or "")]
        words = (t or "").lower().split()
        covered = [any(r.start <= a and z <= r.end for r in rows if r.doc_id == i) for a, z in spans]
        runs = [k for k in range(len(words) - 49) if tuple(words[k : k + 50]) in earlier]
        assert len(runs) >= (i in {*range(1, 6), 10})
        for k in runs:
            assert all(covered[k + 15 : k + 35])
        earlier |= {tuple(words[k : k + 50]) for k in range(len(words) - 49)}
    out = passages.without_repeats(documents(spark, texts))
    assert out.columns == documents(spark, texts).columns
    left = {r.doc_id: r for r in out.collect()}
    middle = " ".join(shared.split()[15:35])
    assert left[0].text == texts[0][1] and left[100].text is None and left[None].text == dict(EDGE)[None]
    assert all(middle not in " ".join(left[i].text.lower().split()) and left[i].n_chars == len(left[i].text) for i in (1, 2, 3, 4, 5, 10))
    assert left[1].text.startswith(prose(1, 31).replace(".", "")) and left[11].text.startswith("la " * 16)


def test_texts_become_strings_in_pieces(monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 25)
    texts = ["ten chars.", None, "", "x" * 60, *["ten chars."] * 7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11), pa.int64()), pa.array(texts)], names=["id", "text"])
    pieces = list(decontam._chunks(batch))
    assert [i for ids, _ in pieces for i in ids] == [0, 3, *range(4, 11)] and [len(ids) for ids, _ in pieces] == [2, 3, 3, 1]
    assert all(t == texts[i] for ids, some in pieces for i, t in zip(ids, some, strict=True))
