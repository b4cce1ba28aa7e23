"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is built-in column functions over one row; nothing is shuffled. Matches are taken with
``regexp_extract_all`` and the text between them with ``split``, so starts are running sums of their
lengths. The sums are taken in blocks, which keeps a text with very many matches near linear. Patterns
use possessive quantifiers (no deep recursion, no re-scan of a long run); each gives the same matches
as its plain form, because the repeated class never holds the character that must follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.llm.base import hex_digest, query, table

BLOCK = 64     # entries added up at once in a running sum
CONTEXT = 40   # characters looked at on each side of a span
ACCEPT = 0.5   # an added span needs this score; the base kinds always stay


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str             # for Java's engine
    plain: str               # the same matches without lookbehind, for other engines
    guard: str               # a text without a match of this has no span of the kind
    prior: float
    words: str = ""          # context that raises the score by 0.4
    against: str = ""        # context that lowers it by 0.3
    base: bool = True


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", 0.8, "mail|contact|write to", "example only"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9]\.[0-9]", 0.6, "server|host|address|login", "version|release|section"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", "[0-9]{2}|[0-9][ -][0-9]", 0.7, "card|visa|credit|payment", "order|invoice|isbn"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, "phone|call|mobile|fax", ""),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}", r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]){11,30}",
         "[A-Z][A-Z][0-9][0-9]", 0.6, "iban|account|bank|konto|cuenta|compte", "", base=False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", 0.2,
         "ssn|social security|tax id", "", base=False),
]


def _valid(kind: str) -> str:
    """SQL condition on a span ``s`` (hit, before, after): checksum, value range or digit count."""
    digits = "regexp_replace(s.hit, '[^0-9]', '')"
    luhn = (f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 0 THEN int(c) "
            "WHEN int(c) < 5 THEN 2 * int(c) ELSE 2 * int(c) - 9 END), 0, (a, x) -> a + x) % 10 = 0")
    joined = "replace(s.hit, ' ', '')"
    mod97 = (f"aggregate(split(concat(substr({joined}, 5), left({joined}, 4)), ''), 0, (a, c) -> "
             "CASE WHEN ascii(c) < 58 THEN (a * 10 + ascii(c) - 48) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1")
    return {
        "email": "true",
        "ip": "forall(split(s.hit, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": mod97,
        "ssn": "NOT right(s.before, 1) RLIKE '[0-9-]' AND NOT left(s.after, 1) RLIKE '[0-9-]'",
    }[kind]


def _score(kind: Kind) -> str:
    near = "lower(concat(s.before, ' ', s.after))"
    plus = f" + CASE WHEN {near} RLIKE '{kind.words}' THEN 0.4D ELSE 0D END" if kind.words else ""
    minus = f" - CASE WHEN {near} RLIKE '{kind.against}' THEN 0.3D ELSE 0D END" if kind.against else ""
    return f"round(greatest(0D, least(1D, {kind.prior}D{plus}{minus})), 2)"


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` plus ``out``: array<struct<kind, start, end, score, base>> of every whole text.

    Positions are code points, end exclusive; order is by kind as in KINDS, then start. Spans of one
    kind never overlap. A null or empty text has no spans. Every other column passes through, and a
    column named like ``out`` is replaced; names starting with ``__`` are reserved.
    """
    df = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    per_kind = lambda make: {f"__{step}_{k.name}": make(k) for k in KINDS for step in [make.__name__]}

    def gap(k):
        return F.when(F.col("__t").rlike(k.guard), F.split("__t", k.pattern, -1))

    def hit(k):
        return F.when(F.col("__t").rlike(k.guard), F.regexp_extract_all("__t", F.lit(k.pattern), F.lit(0)))

    def step(k):
        g, h = f"__gap_{k.name}", f"__hit_{k.name}"
        return F.expr(f"transform({h}, (x, i) -> char_length({g}[i]) + CASE WHEN i > 0 THEN char_length({h}[i - 1]) ELSE 0 END)")

    def total(k):
        s = f"__step_{k.name}"
        return F.expr(f"CASE WHEN size({s}) > 0 THEN transform(sequence(0, (size({s}) - 1) div {BLOCK}), "
                      f"b -> aggregate(slice({s}, int(b) * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x)) END")

    def offset(k):
        t = f"__total_{k.name}"
        return F.expr(f"transform({t}, (x, b) -> aggregate(slice({t}, 1, b), 0, (a, y) -> a + y))")

    def span(k):
        g, h, s, o = (f"__{x}_{k.name}" for x in ("gap", "hit", "step", "offset"))
        start = f"{o}[i div {BLOCK}] + aggregate(slice({s}, int(i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (a, y) -> a + y)"
        found = (f"filter(transform({h}, (x, i) -> named_struct('start', {start}, 'hit', x, 'before', right({g}[i], {CONTEXT}), "
                 f"'after', left({g}[i + 1], {CONTEXT}))), s -> {_valid(k.name)})")
        scored = (f"transform({found}, s -> named_struct('kind', '{k.name}', 'start', s.start, 'end', s.start + char_length(s.hit), "
                  f"'score', {_score(k)}, 'base', {str(k.base).lower()}))")
        kept = scored if k.base else f"filter({scored}, s -> s.score >= {ACCEPT}D)"
        return F.expr(f"coalesce({kept}, array())")

    for make in (gap, hit, step, total, offset, span):
        df = df.withColumns(per_kind(make))
    parts = [F.col(f"__span_{k.name}") for k in KINDS]
    return df.select(*[c for c in docs.columns if c != out], F.concat(*parts).alias(out))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _oracle() -> str:
    """The same result in DuckDB's dialect, from the plain patterns."""
    gaps, spans = [], []
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(s.hit, '.'), lambda p: NOT (len(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))) = 0",
        "card": "len(regexp_replace(s.hit, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(s.hit, '[^0-9]', '', 'g')), ''), "
                "lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END)) % 10 = 0",
        "phone": "len(regexp_replace(s.hit, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(s.hit, ' ', ''), 5) || left(replace(s.hit, ' ', ''), 4), ''), "
                "lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, d: CASE WHEN d < 10 THEN (a * 10 + d) % 97 ELSE (a * 100 + d) % 97 END) = 1",
        "ssn": "NOT regexp_matches(right(s.before, 1), '[0-9-]') AND NOT regexp_matches(left(s.after, 1), '[0-9-]')",
    }
    for k in KINDS:
        gaps.append(f"string_split_regex(t, '{k.plain}') AS g_{k.name}, regexp_extract_all(t, '{k.plain}') AS h_{k.name}")
        start = f"(list_sum(list_transform(g_{k.name}[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(h_{k.name}[1:i - 1], lambda x: len(x))), 0))::BIGINT"
        found = (f"list_filter(list_transform(h_{k.name}, lambda h, i: {{'start': {start}, 'hit': h, 'before': right(g_{k.name}[i], {CONTEXT}), "
                 f"'after': left(g_{k.name}[i + 1], {CONTEXT})}}), lambda s: {valid[k.name]})")
        near = "lower(s.before || ' ' || s.after)"
        if not k.base:
            found = f"list_filter({found}, lambda s: {k.prior} + CASE WHEN regexp_matches({near}, '{k.words}') THEN 0.4 ELSE 0 END >= {ACCEPT})"
        spans.append(f"list_transform({found}, lambda s: '{k.name}:' || s.start || ':' || (s.start + len(s.hit))) AS {k.name}")
    base = " || ".join(k.name for k in KINDS if k.base)
    every = " || ".join(k.name for k in KINDS)
    counts = ", ".join(f"len({k.name}) AS n_{k.name}" for k in KINDS if k.base)
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, {', '.join(gaps)} FROM d), "
            f"s AS (SELECT doc_id, {', '.join(spans)} FROM m) SELECT doc_id, {counts}, "
            f"sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string({every}, ',') AS spans FROM s")


@query("op2_pii", _oracle())
def op2_pii(spark, sf_dir):
    """Counts, digest and list of the personal data in every document."""
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found").drop("text")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k.name) for k in KINDS if k.base],
        hex_digest(joined(F.filter("found", lambda s: s["base"]))).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
