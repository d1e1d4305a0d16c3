"""Secret scans: patterns of well-known secrets, and windows of high entropy in other long strings.

Everything is a column expression: no shuffle, no Python, one pass over the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyveil.llm.common import text_of

# The patterns asked for. Letters of the key words match in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hex digits is kept from 16 on; a shorter run is a match of its own and is dropped, so asking for 16 finds the same.
HEX = r"[0-9a-f]{16,}"
#: Strings in which windows are looked at.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Window length, and the bits that a window needs by the class of the string's characters: what 99 of 100 windows of random
#: characters of that class reach (sixteen hex digits, 32 and 36 letters and digits of one case, 62 of both).
WINDOW = 20
CLASSES = {
    "hex": ("^([-0-9a-f]+|[-0-9A-F]+)$", 2.90),
    "upper": ("^[-0-9A-Z]+$", 3.35),
    "lower": ("^[-0-9a-z]+$", 3.40),
    "mixed": ("", 3.65),
}
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", *(f"entropy_{c}" for c in CLASSES))

#: What parts a string, and what its parts may be without counting: words, numbers, the placeholders of public
#: documentation, runs of the alphabet. All else in the string is looked at.
SEPARATORS = "+/_"
ALLOW = (
    r"^([A-Za-z][a-z]{3,}|[A-Z]{4,}|[0-9]{4,})$",
    r"(?i)0123456789|abcdefghijkl|qwertyuiop",
    r"(?i)example|sample|placeholder|changeme|xxxxxx",
)

_SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"


def _empty() -> Column:
    return F.array().cast(_SPANS)


def _span(rank: int, start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), stop.cast("int").alias("stop"))


#: A fold that collects copies what it has for each piece it adds; pieces are collected in lists of this length.
_LIST = 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Where ``pattern`` matches, in code points, leftmost and non-overlapping, with the text of one group."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,stop:int,part:string>>")

    def step(done: Column, x: Column) -> Column:
        first = done["at"] + F.length(x["gap"])
        stop = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.struct(first.alias("start"), stop.alias("stop"), x["part"].alias("part"))
        return F.struct(stop.alias("at"), F.when(x["hit"].isNull(), done["out"]).otherwise(F.array_append(done["out"], found)).alias("out"))

    def some(done: Column, pieces: Column) -> Column:
        inner = F.aggregate(pieces, F.struct(done["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(done["out"], x["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int,part:string>>>").alias("out"))
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _LIST).cast("int")), lambda k: F.slice(z, k * _LIST + 1, _LIST))
    return _let(zipped, lambda z: F.aggregate(cut(z), start, some, lambda done: F.flatten(done["out"])))


def _known(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    kept = F.filter(_matches(text, pattern, group), lambda m: F.length(m["part"]) >= least)
    return F.when(text.rlike(pattern), F.transform(kept, lambda m: _span(rank, m["start"], m["stop"]))).otherwise(_empty())


def _masked(part: Column, allow: tuple[str, ...]) -> Column:
    """``part`` with a dash for each separator and each character of the parts that are allowed: what is left can be a secret."""

    def allowed(word: Column) -> Column:
        found = F.lit(False)
        for pattern in allow:
            found = found | word.rlike(pattern)
        return found

    words = F.split(F.translate(part, SEPARATORS, "-" * len(SEPARATORS)), "-", -1)
    return F.array_join(F.transform(words, lambda w: F.when(allowed(w), F.repeat(F.lit("-"), F.length(w))).otherwise(w)), "-")


def _mixed(part: Column, rank: Column, kind: Column, start: Column, window: int, bits: Column) -> Column:
    """Unions of the windows of ``part`` that reach ``bits``: counts change by one character in, one out.

    The counts stand in a text, one character for each that can be counted, of which a step replaces two.
    """
    zero = ord("0")
    weights = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    chars = F.transform(F.split(part, ""), lambda c: F.ascii(c))
    # The character that leaves the window comes with the one that enters; NULL until the window is full.
    steps = _let(chars, lambda c: F.arrays_zip(c.alias("new"), F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), window), c), F.lit(1), F.size(c)).alias("old")))
    init = F.struct(
        F.lit(-1).alias("i"), F.lit("0" * 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), _empty().alias("out"),
    )

    def found(s: Column) -> Column:
        one = F.struct((start + s["first"]).cast("int").alias("start"), rank.alias("rank"), kind.alias("kind"), (start + s["last"]).cast("int").alias("stop"))
        return F.when(s["first"] < 0, s["out"]).otherwise(F.array_append(s["out"], one))

    def step(s: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], s["i"] + 1
        count = lambda c: F.ascii(F.substring(s["counts"], c + 1, 1)) - zero
        put = lambda text, c, n: F.overlay(text, F.char(n + zero), c + 1, F.lit(1))
        weight = lambda n: F.get(weights, n)

        def moved(pair: Column) -> Column:
            entered, left = pair["entered"], pair["left"]
            more = s["sum"] + weight(entered + 1) - weight(entered)
            total = F.when(old == new, s["sum"]).when(old.isNull(), more).otherwise(more + weight(left - 1) - weight(left))
            added = put(s["counts"], new, entered + 1)
            counts = F.when(old == new, s["counts"]).when(old.isNull(), added).otherwise(put(added, old, left - 1))
            return F.struct(counts.alias("counts"), total.alias("sum"))

        def placed(now: Column) -> Column:
            reached = (i >= window - 1) & (F.round(F.lit(math.log2(window)) - now["sum"] / window, 6) >= bits)
            begins = i - (window - 1)
            joins = (s["first"] >= 0) & (begins <= s["last"])
            return F.struct(
                i.alias("i"), now["counts"].alias("counts"), now["sum"].alias("sum"),
                F.when(reached & ~joins, begins).otherwise(s["first"]).alias("first"),
                F.when(reached, i + 1).otherwise(s["last"]).alias("last"),
                F.when(reached & ~joins, found(s)).otherwise(s["out"]).alias("out"),
            )

        touched = F.struct(count(new).alias("entered"), F.when(old.isNotNull(), count(old)).alias("left"))
        return _let(_let(touched, moved), placed)

    return F.aggregate(steps, init, step, found)


def _entropy(text: Column, window: int, classes: dict[str, tuple[str, float]], allow: tuple[str, ...]) -> Column:
    def spans(m: Column) -> Column:
        def of(part: Column) -> Column:
            rank, bits = F.lit(2 + len(classes)), F.lit(list(classes.values())[-1][1])
            for k, (pattern, least) in reversed(list(enumerate(classes.values()))[:-1]):
                rank, bits = F.when(part.rlike(pattern), 3 + k).otherwise(rank), F.when(part.rlike(pattern), least).otherwise(bits)
            kind = F.element_at(F.array(*[F.lit(f"entropy_{c}") for c in classes]), rank - 2)
            own = lambda c: _mixed(part, c["rank"], c["kind"], m["start"], window, c["bits"])
            return F.when(part.rlike("[^-]"), _let(F.struct(rank.alias("rank"), kind.alias("kind"), bits.alias("bits")), own)).otherwise(_empty())

        return _let(_masked(m["part"], allow), of)

    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(_matches(text, CANDIDATE, 0), spans))).otherwise(_empty())


def find_secrets(
    df: DataFrame,
    text: str = "text",
    out: str = "secrets",
    window: int = WINDOW,
    classes: dict[str, tuple[str, float]] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``df`` with a column of spans (start, rank, kind, stop), in code points, ends exclusive, ordered by start, then kind.

    Kinds ``assign``, ``access`` and ``hex`` are pattern matches. Kinds ``entropy_…`` are the unions of windows of ``window``
    characters, within a longer string, whose Shannon entropy reaches the bits of the string's class: the first of
    ``classes`` (pattern and bits; the last takes the rest) that it fits. Separators, and parts between them that match
    one of ``allow``, count as dashes there. Spans inside a pattern match are left out.

    A missing or empty text has no spans; equal rows get equal spans; an empty table gives an empty table. Other columns
    pass through, except that one named ``out`` is replaced.
    """
    hold = f"__{out}"
    content = text_of(text)
    known = F.concat(_known(content, ASSIGN, 2, 12, 0), _known(content, ACCESS, 0, 18, 1), _known(content, HEX, 0, 16, 2))
    staged = df.select("*", known.alias(f"{hold}_known"), _entropy(content, window, classes, allow).alias(f"{hold}_mixed"))
    base, mixed = F.col(f"{hold}_known"), F.col(f"{hold}_mixed")
    added = F.filter(mixed, lambda m: ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (b["stop"] >= m["stop"])))
    return staged.withColumn(out, F.sort_array(F.concat(base, added))).drop(f"{hold}_known", f"{hold}_mixed")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secrets_by_document(documents: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    found = find_secrets(documents.select("doc_id", "text"), out="secrets").select("doc_id", "secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"),
    )


def _sql_matches(name: str, pattern: str, group: int, least: int, rank: int) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (
    SELECT doc_id, '{KINDS[rank]}' AS kind, {rank} AS rank, start, start + len(hit) AS stop, hit FROM (
      SELECT doc_id, hits[i] AS hit, parts[i] AS part,
             list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0)::BIGINT AS start
      FROM (SELECT doc_id, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {group}) AS parts,
               string_split_regex(text, '{p}') AS gaps
        FROM docs WHERE regexp_matches(text, '{p}'))))
    WHERE len(part) >= {least})"""


def _sql() -> str:
    allowed = " OR ".join(f"regexp_matches(w, '{p}')" for p in ALLOW)
    cases = [(pattern, bits, k) for k, (pattern, bits) in enumerate(CLASSES.values())]
    bits = " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {b}" for p, b, _ in cases[:-1]) + f" ELSE {cases[-1][1]}"
    rank = " ".join(f"WHEN regexp_matches(hit, '{p}') THEN {3 + k}" for p, _, k in cases[:-1]) + f" ELSE {3 + cases[-1][2]}"
    kind = " ".join(f"WHEN {3 + k} THEN 'entropy_{c}'" for k, c in enumerate(CLASSES))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_matches("assign", ASSIGN, 2, 12, 0)},
{_sql_matches("access", ACCESS, 0, 18, 1)},
{_sql_matches("hexes", HEX, 0, 16, 2)},
{_sql_matches("runs", CANDIDATE, 0, 20, 4)},
masked AS (
  SELECT doc_id, start, list_aggregate(list_transform(string_split(translate(hit, '{SEPARATORS}', '{"-" * len(SEPARATORS)}'), '-'),
                                lambda w: CASE WHEN {allowed} THEN repeat('-', len(w)) ELSE w END), 'string_agg', '-') AS hit FROM runs),
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes),
windows AS (
  SELECT doc_id, start AS run, rank, bar, i, round(list_aggregate(string_split(hit[i + 1:i + {WINDOW}], ''), 'entropy'), 6) AS bits
  FROM (SELECT doc_id, start, hit, CASE {rank} END AS rank, CASE {bits} END AS bar, unnest(range(0, len(hit) - {WINDOW} + 1)) AS i FROM masked)),
reached AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, run ORDER BY i) AS part FROM (
    SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, run ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS opens
    FROM windows WHERE bits >= bar)),
mixed AS (
  SELECT doc_id, CASE any_value(rank) {kind} END AS kind, any_value(rank) AS rank, run + min(i) AS start, run + max(i) + {WINDOW} AS stop
  FROM reached GROUP BY doc_id, run, part),
spans AS (
  SELECT doc_id, kind, rank, start, stop FROM base
  UNION ALL SELECT doc_id, kind, rank, start, stop FROM mixed m
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start <= m.start AND b.stop >= m.stop)),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id"""


SQL = _sql()
