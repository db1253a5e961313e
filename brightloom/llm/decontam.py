"""Benchmark questions in documents, also with other numbers, names and units in them.

Words become a template: numbers, units behind a number, and capitalised words inside a sentence are
replaced by their type. Windows of ``WINDOW`` template words with ``MIN_PLAIN`` plain ones are joined
by hash; what stood in the typed places must then be consistent along one alignment: each filler of
the question has one filler in the document, which several may share. It is the one that stands for
most of its mentions, or of equally many the filler itself, and windows with another one are dropped.
All windows are also joined word for word, whatever the case of their letters. A document holds a
question if consistent template windows cover at least ``MIN_COVER`` of the question's, or windows that
match in either form at least ``MIN_COVER`` of all its windows. Where a filler has no such majority, what
is left of the alignment's template windows counts for the latter only. ``RUN`` neighbouring windows of a
question that hold along one alignment suffice whatever share of it they are: in either form, or as
templates where windows with too few plain words are passed over.

A question of fewer words than a window is one window by itself, and one whose windows all have too few
plain words is found word for word. Missing and empty texts hold nothing and match nothing; repeated rows
count once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import cut_lineage, fresh_path

WINDOW, MIN_PLAIN, MIN_COVER = 5, 3, 0.6
RUN = 9  # windows in a row, that is 13 words
FILTER_BITS = 24
KEPT_WORDS = 500_000
CHUNK = 1 << 20  # code points that are cut at once, which changes no result; a longer text is cut by itself
# Words that count as units behind a number
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces "
    "pound pounds lb lbs ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
    "hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
)
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
_ENDS = frozenset(".!?")
_END, _NUMBER, _UNIT, _CAPITAL = 1, 2, 4, 8
_TEMPLATE, _EXACT = 0, 1
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WINDOW + 1)], dtype=np.uint64)
_TYPED = {t: np.uint64(xxhash.xxh3_64_intdigest(t)) for t in ("<number>", "<unit>", "<name>")}


class Words:
    """Codes and kinds of the tokens of every stretch without white space that a task has met."""

    def __init__(self):
        self.index: dict[str, int] = {"": 0}
        self.codes, self.kinds, self.first, self.n = array("Q"), bytearray(), array("q", [0]), array("q", [0])

    def _add(self, stretch: str) -> None:
        tokens = (stretch,) if stretch.isalpha() else _TOKEN.findall(stretch)
        self.index[stretch] = len(self.n)
        self.first.append(len(self.codes))
        self.n.append(len(tokens))
        for t in tokens:
            low = t.lower()
            self.codes.append(xxhash.xxh3_64_intdigest(low))
            if t in _ENDS:
                self.kinds.append(_END)
            elif t[0].isdigit():
                self.kinds.append(_NUMBER)
            else:
                self.kinds.append((_UNIT if low in UNITS else 0) | (_CAPITAL if t[0] != low[0] else 0))

    def look_up(self, stretches: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and kinds of all tokens of the stretches in order, and the number of tokens of each."""
        if len(self.index) > KEPT_WORDS:
            self.__init__()
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = self.index
        for w in [w for w in distinct if w not in index]:
            self._add(w)
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[stretches.indices.to_numpy()]
        n = np.array(self.n)[at]
        ends = np.cumsum(n)
        token = np.repeat(np.array(self.first)[at] - (ends - n), n) + np.arange(n.sum())
        return np.array(self.codes, np.uint64)[token], np.frombuffer(bytes(self.kinds), np.uint8)[token], n


@dataclass(frozen=True)
class Cut:
    """The words of some texts, one text after the other."""

    text: np.ndarray  # number of the text
    place: np.ndarray  # place among the text's tokens
    code: np.ndarray
    template: np.ndarray  # code with numbers, units and names replaced by their type
    typed: np.ndarray  # which words are replaced


def cut(texts: list[str], words: Words) -> Cut:
    # a line end is a token like a full stop; no other token holds white space
    split = pc.ascii_split_whitespace(pc.replace_substring(pa.array(texts, pa.string()), "\n", " . "))
    code, kind, n = words.look_up(split.flatten().dictionary_encode())
    bounds = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy()]
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    new_text = np.diff(text, prepend=-1) != 0
    first = new_text | np.concatenate([[True], (kind[:-1] & _END) != 0])[: len(kind)]
    word = np.flatnonzero((kind & _END) == 0)
    text, first, code, kind = text[word], first[word], code[word], kind[word]
    number = (kind & _NUMBER) != 0
    behind_number = np.concatenate([[False], number[:-1] & (text[:-1] == text[1:])])[: len(text)]
    unit = ((kind & _UNIT) != 0) & behind_number
    name = ((kind & _CAPITAL) != 0) & ~first & ~unit
    template = code.copy()
    for mask, t in ((number, "<number>"), (unit, "<unit>"), (name, "<name>")):
        template[mask] = _TYPED[t]
    return Cut(text, word - bounds[text], code, template, number | unit | name)


def windows(c: Cut, form: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows of ``width`` words of one text; of templates those with enough plain words."""
    n = len(c.text) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = c.template if form == _TEMPLATE else c.code
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h += code[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    good = c.text[:n] == c.text[width - 1 :]
    if form == _TEMPLATE:
        total = np.concatenate([[0], np.cumsum(~c.typed)])
        good &= total[width:] - total[:-width] >= min(MIN_PLAIN, width)
    at = np.flatnonzero(good)
    return at, h[at]


# n_rich, n_all: windows of the text with enough plain words, and all; nth: which of its form in a question
_ROWS = "id long, n_rich int, n_all int, form int, pos int, nth int, width int, start int, end int, h long, fill array<string>"
_KINDS = [pa.int64(), *[pa.int32()] * 8, pa.int64(), pa.list_(pa.string())]
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]


def _rows(idents: list, texts: list[str], words: Words, wanted: dict[tuple[int, int], np.ndarray] | None) -> list[tuple]:
    """Windows of texts in both forms: all of a single question, or with ``wanted``, filters by form and length, some of documents."""
    c = cut(texts, words)
    n_words = np.bincount(c.text, minlength=len(texts))
    start = np.cumsum(n_words) - n_words
    rows: list[tuple] = []
    tokens: dict[int, list[re.Match]] = {}
    for form, width in wanted or ((f, min(WINDOW, len(c.text))) for f in (_TEMPLATE, _EXACT)):
        if not width:
            continue
        at, h = windows(c, form, width)
        n_rich = 0
        if wanted is not None:
            bit = h >> np.uint64(64 - FILTER_BITS)
            hit = (wanted[form, width][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, h = at[hit], h[hit]
        else:
            n_rich = len(windows(c, _TEMPLATE, width)[0])
        for nth, (p, code_h) in enumerate(zip(at.tolist(), h.astype(np.int64).tolist(), strict=True)):
            i = int(c.text[p])
            if i not in tokens:
                tokens[i] = list(_TOKEN.finditer(texts[i]))
            inside = [tokens[i][k] for k in c.place[p : p + width].tolist()]
            typed = c.typed[p : p + width].tolist() if form == _TEMPLATE else [False] * width
            fill = [m.group().lower() if t else None for m, t in zip(inside, typed, strict=True)]
            rows.append((
                idents[i], n_rich, int(n_words[i]) - width + 1, form, p - int(start[i]), 0 if wanted is not None else nth, width,
                inside[0].start(), inside[-1].end(), code_h, fill,
            ))
    return rows


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the rows with a text, in lists of about ``CHUNK`` code points; only these are Python strings at a time."""
    some: tuple[list, list[str]] = ([], [])
    size = 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        t = t.as_py()
        if not t:
            continue
        some[0].append(i.as_py())
        some[1].append(t)
        size += len(t)
        if size >= CHUNK:
            yield some
            some, size = ([], []), 0
    if some[0]:
        yield some


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def question_windows(benchmark: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            yield _batch([r for i, t in pairs if t for r in _rows([i], [t], words, None)])

    return benchmark.selectExpr("CAST(item_id AS BIGINT) AS id", "text").mapInArrow(find, _ROWS)


def window_filter(questions: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Per form and window length, which leading hash bits occur; its size does not depend on the benchmark's."""
    word = f"shiftrightunsigned(h, {64 - FILTER_BITS})"
    bits = questions.selectExpr("form", "width", f"shiftright({word}, 5) AS w", f"shiftleft(1L, int({word} & 31)) AS bit")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in bits.groupBy("form", "width", "w").agg(F.expr("bit_or(bit) AS bits")).collect():
        out.setdefault((r.form, r.width), np.zeros((1 << FILTER_BITS) // 32, dtype=np.uint32))[r.w] = r.bits
    return {k: v.view(np.uint8) for k, v in out.items()}


def document_windows(docs: DataFrame, wanted: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """Windows of the documents that may stand in a question."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for idents, texts in _chunks(b) if wanted else ():
                yield _batch(_rows(idents, texts, words, wanted))

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS id", "text").mapInArrow(find, _ROWS)


_WINDOW = "struct<q_pos:int,nth:int,form:int,start:int,end:int,fill:array<struct<at:int,q:string,d:string>>>"
_HELD = "doc_id long, item_id long, n_rich int, n_all int, q_pos int, by_template boolean, verbatim boolean, start int, end int, in_run boolean"


def longest_run(places: set[int]) -> int:
    best = 0
    for p in places:
        if p - 1 not in places:
            n = 1
            while p + n in places:
                n += 1
            best = max(best, n)
    return best


def consistent(found: list[dict]) -> list[tuple]:
    """Windows of one alignment that hold: place in the question, whether as a template, whether word for word, start,
    end, whether the alignment has a run."""
    typed = [w for w in found if w["form"] == _TEMPLATE]
    mentions: dict[str, dict[str, set[int]]] = {}
    for w in typed:
        for f in w["fill"]:
            mentions.setdefault(f["q"], {}).setdefault(f["d"], set()).add(f["at"])
    chosen: dict[str, str | None] = {}
    for q, by in mentions.items():
        most = max(map(len, by.values()))
        top = [d for d, at in by.items() if len(at) == most]
        chosen[q] = q if q in top else top[0] if len(top) == 1 else None
    settled = None not in chosen.values()
    kept = [w for w in typed if all(chosen[f["q"]] == f["d"] for f in w["fill"])]
    exact = [w for w in found if w["form"] == _EXACT]
    run = max(longest_run({w["nth"] for w in kept}), longest_run({w["q_pos"] for w in kept + exact})) >= RUN
    out = [(w["q_pos"], settled, all(f["q"] == f["d"] for f in w["fill"]), w["start"], w["end"], run) for w in kept]
    return out + [(w["q_pos"], False, True, w["start"], w["end"], run) for w in exact]


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _HELD.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]
    for b in batches:
        keys = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
        rows = [(*k, *w) for k, found in zip(keys, b.column(4).to_pylist(), strict=True) for w in consistent(found)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def leaks(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id, item_id, cover, verbatim (all fillers equal), start and end of the covered stretch.

    One row per document and question that it holds. Where template windows alone suffice, the figures are
    theirs, otherwise those of both forms.
    """
    spark = docs.sparkSession
    rows = 2 * (benchmark.selectExpr("sum(length(text))").first()[0] or 0)  # two forms, and no word without a character
    questions = cut_lineage(question_windows(benchmark).filter("id IS NOT NULL").distinct(), rows)
    path = fresh_path(spark, "benchmark-windows")
    document_windows(docs, window_filter(questions)).write.parquet(path)
    found = spark.read.schema(_ROWS).parquet(path).distinct()
    q = questions.selectExpr("id AS item_id", "n_rich", "n_all", "form", "pos AS q_pos", "nth", "width", "h", "fill AS q_fill")
    d = found.selectExpr("id AS doc_id", "pos AS d_pos", "start", "end", "form", "width", "h", "fill AS d_fill")
    fill = "transform(arrays_zip(q_fill, d_fill), (x, i) -> struct(q_pos + i AS at, x.q_fill AS q, x.d_fill AS d))"
    pairs = d.join(q, ["form", "width", "h"]).selectExpr(
        "doc_id", "item_id", "n_rich", "n_all", "d_pos - q_pos AS shift",
        f"CAST(struct(q_pos, nth, form, start, end, filter({fill}, x -> x.q IS NOT NULL) AS fill) AS {_WINDOW}) AS found",
    )
    # along one alignment a window stands once, so a group is no longer than its question
    aligned = pairs.groupBy("doc_id", "item_id", "n_rich", "n_all", "shift").agg(F.collect_set("found").alias("found"))
    covered = aligned.drop("shift").mapInArrow(_check, _HELD)
    # windows of one question next to each other, a few words more or less, count together
    windows_held = covered.groupBy("doc_id", "item_id", "n_rich", "n_all", "q_pos").agg(
        F.max("by_template").alias("by_template"), F.max("in_run").alias("in_run"),
        *(F.expr(f"{f}({c}) {w} AS {p}{c}") for p, w in (("", ""), ("t_", "FILTER (WHERE by_template)"))
          for f, c in (("min", "start"), ("max", "end"), ("max", "verbatim"))),
    )
    held = windows_held.groupBy("doc_id", "item_id", "n_rich", "n_all").agg(
        F.count("*").alias("n"), F.count_if("by_template").alias("t_n"), F.max("in_run").alias("in_run"),
        *(F.expr(f"{f}({p}{c}) AS {p}{c}") for p in ("", "t_") for f, c in (("min", "start"), ("max", "end"), ("min", "verbatim"))),
    )
    by_template = f"(t_n > 0 AND t_n >= {min_cover} * n_rich)"
    return held.filter(f"{by_template} OR n >= {min_cover} * n_all OR in_run").selectExpr(
        "doc_id", "item_id", f"IF({by_template}, t_n / n_rich, n / n_all) AS cover",
        *(f"IF({by_template}, t_{c}, {c}) AS {c}" for c in ("verbatim", "start", "end")),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """The documents that hold no benchmark question; rows without a doc_id stay."""
    bad = leaks(docs, benchmark, min_cover).select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_doc"], "left_anti")
