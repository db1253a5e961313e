import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brightloom.llm import packing, repair, tokens
from brightloom.llm.queries import vocabulary
from brightloom.llm.tokens import encoder
from tests.llm.helpers import EDGE, documents, prose


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    return lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4")


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="aBcÉßéσΣİıx́'’s-., \t\n\x0b\x1c\x85\xa0　12%$!漢\U0001f600", max_size=60))
def test_ids_are_the_librarys(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    assert encoder(vocabulary()).encode([text])[0] == np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_case_and_marks_behind_a_word_take_no_place_in_the_store(plain):
    e = tokens.Encoder(vocabulary())
    text = "Écart écart, ÉCART! word Word. (word) x́"
    assert e.encode([text, None]) == [plain(text).tobytes(), b""]
    assert set(e.ids) == {"", "écart", "word", ",", "!", ".", "(word)", "x́"}


def test_a_full_store_is_kept_as_the_older_one(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    e = tokens.Encoder(vocabulary())
    for text in ("one two three four", "five one", "six seven eight", "one nine two"):
        assert e.encode([text]) == [plain(text).tobytes()]
        assert len(e.ids) + len(e.older) <= 12
    assert "one" in e.ids and "three" not in {**e.ids, **e.older}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=8), st.integers(2, 5), st.sampled_from([4, 1 << 20]))
def test_grammar_round_trip(docs, min_count, first_free):
    ids = [np.array(d, dtype=np.uint32) for d in docs]
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    ends = np.cumsum([len(d) for d in ids], dtype=np.int64)
    seq, new_ends, rules = repair.compress(flat, ends, first_free, min_count, 16)
    lengths = repair.expansion_lengths(rules, first_free)
    assert (repair.expand(seq, rules, lengths, first_free) == flat).all()
    starts = [0, *new_ends[:-1]] if len(new_ends) else []
    for d, a, z in zip(ids, starts, new_ends, strict=True):
        assert (repair.expand(seq[a:z], rules, lengths, first_free) == d).all()


def test_repeated_pairs_shrink():
    flat = np.array([1, 2] * 500 + [0, 0] * 100, dtype=np.uint32)
    seq, _, rules = repair.compress(flat, np.array([len(flat)]), 10, 4, 4)
    assert len(rules) and len(seq) < len(flat) / 4


def test_shards_give_back_all_ids(spark, plain, tmp_path):
    texts = [(i, prose(i, 50 + i)) for i in range(40)] + EDGE + [(7, prose(7, 57)), (500, prose(5, 20_000))]
    docs = documents(spark, texts)
    manifest = repair.write_shards(docs, str(tmp_path / "out"), vocabulary(), 1, 49408, shard_ids=1500)
    assert manifest.count() > 3
    rows = repair.read_shards(manifest, with_ids=True).orderBy("start").collect()
    at, by_id = 0, {}
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4"))
        by_id.setdefault(r.doc_id, []).append(r.ids[:-1])
        at += r.n_tokens
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(i for i, _ in texts if i is not None)
    for i, t in texts:
        assert plain(t).tolist() in by_id[i]
    shard = repair.Shard(manifest.orderBy("docs", ascending=False).first().file)
    whole, last = shard.all_ids(), np.cumsum(shard.sizes)
    assert all((shard.document(k) == whole[last[k] - shard.sizes[k] : last[k]]).all() for k in range(len(last)))


def test_pieces_cover_each_document_once(spark, plain):
    texts = [(i, prose(i % 5, 30 + i % 7)) for i in range(60)] + EDGE + [(900, prose(1, 9000)), (3, prose(3, 33))]
    rows = packing.pack(documents(spark, texts), vocabulary(), length=256).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    sizes = [sum(n for _, n in p) for p in by_sequence.values()]
    assert max(sizes) <= 256 and sum(s < 256 for s in sizes) <= 1
    for i, t in texts:
        ids = np.append(plain(t), 2).astype("<u4")
        copies = sum(j == i for j, _ in texts)
        assert sum(n for _, n, _, _ in by_doc[i]) == copies * len(ids)
        for start, n, crc, total in by_doc[i]:
            assert crc == zlib.crc32(ids[start : start + n]) and total == len(ids)


def test_hilbert_keys_visit_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys(points, bits=3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.pack(none, vocabulary()).count() == 0
    assert repair.token_shards(none, vocabulary()).count() == 0
