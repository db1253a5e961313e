"""Personal data: fixed formats, and identifiers that stand where such data stands.

The fixed formats (e-mail, IP address, card, phone) and strings that mix letters and digits at random
(access keys) seed a graph of patterns and instances. An instance is a value that looks like an
identifier: a run of neighbouring tokens with a digit or an at sign, cut where a fixed format begins or
ends. A pattern is a few of the words before it, after it, or on both sides; how the value is spelt is no
part of it. In each round a pattern's confidence in a kind is the share of that kind among the distinct
values that speak for or against it: values of another kind, and values that cannot be of the kind
(``may_be``), speak against it, unknown ones that can be do neither. Unknown values around which confident
patterns stand take their kind and count like seeds from the next round on, until a round finds nothing
new. Such values are reported wherever they stand. A key is never reported for its spelling alone: it
needs a confident pattern.

Places count code points; ends are exclusive. Missing and empty texts have no spans. Repeated rows
give the same spans each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.session import cut_lineage, fresh_path

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "key")  # in the order in which bits of ``may_be`` name them
MIN_SEEDS, MIN_CONFIDENCE = 4, 0.7

# A run of digits is entered at its start, and a run of an e-mail's first part ends at the at sign:
# the same matches as a search from every character, in one pass over the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_MIXED = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_ADDRESS = re.compile(r"[0-9A-Fa-f]*([.:][0-9A-Fa-f]*){3,}")
_NUMERIC = re.compile(r"[0-9 ().+/-]+")
_EDGE = "\"'`.,;:!?)]}>([{<=%$&*#|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all fixed formats, by start and then kind."""
    if not text or not _HINT.search(text):
        return []
    found = [(a, z, "email") for a, z in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def may_be(value: str) -> int:
    """Bits of the kinds that a value can be of, judged by its characters alone."""
    n = len(_digits(value))
    numeric = _NUMERIC.fullmatch(value) is not None
    fits = (
        "@" in value.strip("@") and " " not in value,
        n >= 4 and _ADDRESS.fullmatch(value) is not None,
        numeric and n >= 8,
        numeric and 6 <= n <= 15,
        len(value) >= 8 and _MIXED.search(value) is not None and "@" not in value and " " not in value,
    )
    return sum(1 << i for i, f in enumerate(fits) if f)


def is_key(value: str) -> bool:
    """A long string in which letters and digits take turns: one of the seeds for access keys."""
    return _KEY.fullmatch(value) is not None and len(_MIXED.findall(value)) >= 6


def _code(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def _trimmed(text: str, a: int, z: int) -> tuple[int, int]:
    while a < z and (text[z - 1] in _EDGE or text[z - 1].isspace()) and not (text[z - 1] == ")" and text.find("(", a, z) >= 0):
        z -= 1
    while a < z and (text[a] in _EDGE or text[a].isspace()) and not (text[a] == "(" and text.find(")", a, z) >= 0):
        a += 1
    return a, z


def _pieces(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None, bool]]:
    """Words and values of a text in order: start, end, kind of a fixed format, whether a value."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out: list[tuple[int, int, str | None, bool]] = []
    i = at = free = 0  # token, span, end of the last fixed format
    while i < len(tokens):
        a, z = tokens[i]
        i += 1
        if not _HINT.search(text, a, z):
            if a >= free:
                out.append((a, z, None, False))
            continue
        while i < len(tokens) and text[z] == " " and tokens[i][0] == z + 1 and _HINT.search(text, *tokens[i]):
            z = tokens[i][1]
            i += 1
        a = max(a, free)
        while a < z:
            while at < len(spans) and spans[at][0] < a:
                at += 1
            here = spans[at] if at < len(spans) and spans[at][0] < z else None
            x, y = _trimmed(text, a, here[0] if here else z)
            if x < y and _HINT.search(text, x, y):
                out.append((x, y, None, True))
            if here is None:
                break
            out.append((*here, True))
            a = free = here[1]
    return out


def candidates(text: str | None, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int, str | None, int, list[int]]]:
    """Values of a text: start, end, code, kind if known by its format, kinds that it may be of, patterns.

    Spelling with or without spaces, hyphens and brackets gives the same code.
    """
    if not text or not _HINT.search(text):
        return []
    pieces, out = _pieces(text, spans), []

    def word(k: int) -> str:
        if not 0 <= k < len(pieces):
            return ""
        a, z, kind, value = pieces[k]
        token = text[a:z].lower()
        return f"<{kind or 'value'}>" if value else token.strip(_EDGE) or token

    for k, (a, z, kind, value) in enumerate(pieces):
        if not value:
            continue
        spelt = text[a:z]
        left, right = [word(j) for j in range(k - 4, k)], [word(k + 1), word(k + 2)]
        patterns = [_code(f"left{n}", *left[-n:]) for n in (2, 3, 4) if left[-n]]
        if left[-1]:
            patterns.append(_code("both", left[-1], right[0]))
        if right[1]:
            patterns.append(_code("right", *right))
        same = spelt.lower().translate(_SPELLING)
        out.append((a, z, _code("value", same), kind or ("key" if is_key(spelt) else None), may_be(spelt), patterns))
    return out


_SPELLING = str.maketrans("", "", " ()-")
_SPAN = "struct<start:int,end:int,kind:string>"
_VALUE = ("start", "end", "value", "kind", "may", "patterns")
_FOUND = f"doc_id long, text_key long, spans array<{_SPAN}>, values array<struct<start:int,end:int,value:long,kind:string,may:int,patterns:array<long>>>"


def find_base(docs: DataFrame) -> DataFrame:
    """Fixed formats and identifier-like values of every document, stored once."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()))
    value = pa.list_(pa.struct(list(zip(_VALUE, kinds, strict=True))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            spans = [base_spans(t) for t in texts]
            values = [candidates(t, s) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in x] for x in spans], span),
                    pa.array([[dict(zip(_VALUE, v, strict=True)) for v in x] for x in values], value),
                ],
                names=["doc_id", "text_key", "spans", "values"],
            )

    path = fresh_path(docs.sparkSession, "pii-found")
    docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(find, _FOUND).write.parquet(path)
    return docs.sparkSession.read.schema(_FOUND).parquet(path)


def text_key(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _confident(edges: DataFrame, known: DataFrame) -> DataFrame:
    """pattern, kind and confidence of the patterns that the known values make trustworthy."""
    marked = edges.join(known.select("value", F.col("kind").alias("is")), "value", "left")
    per_kind = [
        f"struct('{k}' AS kind, count_if(is = '{k}') AS n, count_if(is <> '{k}' OR is IS NULL AND may & {1 << i} = 0) AS against)"
        for i, k in enumerate(ALL_KINDS)
    ]
    counted = marked.groupBy("pattern", "n_bad").agg(F.expr(f"array({', '.join(per_kind)})").alias("kinds"))
    return (
        counted.selectExpr("pattern", "n_bad", "inline(kinds)")
        .selectExpr("pattern", "kind", "n", "n / (n + against + n_bad + 1) AS confidence")
        .filter(f"n >= {MIN_SEEDS} AND confidence >= {MIN_CONFIDENCE}")
        .drop("n")
    )


def accepted_values(found: DataFrame) -> DataFrame:
    """(value, kind): what the fixed formats and the trusted patterns know after the last round."""
    values = found.selectExpr("explode(values) AS v").selectExpr("v.value", "v.kind", "v.may", "explode(v.patterns) AS pattern")
    rows = found.selectExpr("sum(aggregate(values, 0L, (n, v) -> n + size(v.patterns)))").first()[0] or 0
    every = cut_lineage(values.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.expr("bit_or(may)").alias("may")), rows)
    rows = every.count()
    known = every.filter("kind IS NOT NULL").groupBy("value").agg(F.max("kind").alias("kind")).withColumn("seed", F.lit(True))
    known = cut_lineage(known, rows)
    # a pattern around fewer values that can be personal data can never be trusted; of the others only the number counts
    worth = every.groupBy("pattern").agg(F.expr("count_if(may <> 0) AS n"), F.expr("count_if(may = 0) AS n_bad"))
    edges = every.filter("may <> 0").select("pattern", "value", "may").join(worth.filter(f"n >= {MIN_SEEDS}").drop("n"), "pattern")
    edges = cut_lineage(edges, rows)
    fits = " OR ".join(f"kind = '{k}' AND may & {1 << i} <> 0" for i, k in enumerate(ALL_KINDS))
    while True:  # each round but the last adds a value
        trusted = cut_lineage(_confident(edges, known), rows)
        open_edges = edges.join(known.select("value"), "value", "left_anti")
        # a value's score for a kind: that not all patterns around it are wrong
        scored = open_edges.join(trusted, "pattern").filter(fits).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")
        )
        new = cut_lineage(scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).selectExpr("value", "best.kind AS kind", "false AS seed"), rows)
        if new.isEmpty():
            break
        known = cut_lineage(known.unionByName(new), rows)
    keys = edges.join(trusted.filter("kind = 'key'").select("pattern"), "pattern", "left_semi").select("value").distinct()
    lone = known.filter("seed AND kind = 'key'").join(keys, "value", "left_anti").select("value")
    return known.join(lone, "value", "left_anti").select("value", "kind")


def discovered(found: DataFrame) -> DataFrame:
    """doc_id, text_key and ``more``: spans that only the patterns find."""
    unknown = found.selectExpr("doc_id", "text_key", "explode(filter(values, v -> v.kind IS NULL OR v.kind = 'key')) AS v")
    spans = unknown.selectExpr("doc_id", "text_key", "v.start", "v.end", "v.value").distinct().join(accepted_values(found), "value")
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("more"))


def all_spans(found: DataFrame) -> DataFrame:
    """The base spans and those that the patterns add, per document, by start and kind."""
    more = discovered(found).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    both = found.join(more, F.expr("doc_id <=> _doc AND text_key = _key"), "left").drop("_doc", "_key")
    order = "array_position(array('email', 'ip', 'card', 'phone', 'key'), {}.kind)"
    compare = f"(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE int({order.format('a')} - {order.format('b')}) END"
    merged = f"array_sort(concat(spans, coalesce(more, array())), {compare})"
    return both.select("doc_id", "text_key", "spans", F.expr(merged).alias("all_spans"))


def _joined(column: str) -> str:
    return f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """Counts of the fixed formats per document, a digest of their spans, and all spans as text."""
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    counts = [f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS]
    return all_spans(find_base(docs)).selectExpr(
        "doc_id", *counts, f"sha2({_joined('spans')}, 256) AS base_sha256", f"{_joined('all_spans')} AS spans"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; ``n_chars``, if there, follows the new text."""
    plain = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    spans = all_spans(find_base(plain)).filter("size(all_spans) > 0").distinct()
    spans = spans.selectExpr("doc_id AS __pii_doc", "text_key AS __pii_key", "all_spans AS __pii_spans")
    same = docs["doc_id"].eqNullSafe(spans["__pii_doc"]) & (text_key(docs["text"]) == spans["__pii_key"])
    marked = docs.join(spans, same, "left").select(*[docs[c] for c in docs.columns], spans["__pii_spans"])
    names = docs.columns
    at, last = names.index("text"), len(names)
    size_at = names.index("n_chars") if "n_chars" in names else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [
                cover(t, [(s["start"], s["end"], s["kind"]) for s in x]) if x else t
                for t, x in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True)
            ]
            columns = [b.column(i) for i in range(last)]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if size_at is not None:
                old = columns[size_at].to_pylist()
                n = [len(t) if x else c for t, x, c in zip(texts, b.column(last).to_pylist(), old, strict=True)]
                columns[size_at] = pa.array(n, b.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(replace, docs.schema)


def cover(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace spans from left to right; where two overlap, the rest of the later one goes with it."""
    out, at = [], 0
    for start, end, kind in spans:
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        out.append(f"<{kind.upper()}>" if start >= at else "")
        at = end
    out.append(text[at:])
    return "".join(out)


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in spans).encode()).hexdigest()
