"""Pseudonyms for personal numbers, dates and addresses that keep their format.

What passes its check (digit sums, ranges, the calendar) is permuted by a keyed Feistel network over exactly the values of
its format, so a pseudonym passes the same check, different values stay different, and equal values stay equal in all
documents. Everything is a column expression: no shuffle, no Python, one pass over the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyveil.llm.common import text_of

ROUNDS = 10

# What each kind looks like before it is checked. Kinds are tried in this order at every place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Places after which a value may start, and those with the text from there on: more than the longest match and the character after it.
_STARTS, _WINDOWS = f"(?={PATTERN})", f"(?s)(?=.(?:{PATTERN}))(?=(.{{1,640}}))."
#: Digits of card numbers that can be part of a longer match, and characters of the account numbers of a country.
CARD_DIGITS = range(18, 12, -1)
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
        "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
#: Texts without a match of this hold nothing to look for.
_WORTH = "[0-9@]"
#: Days from 0001-01-01 to 9999-12-31, the dates that four digits of a year can write, and two factors of their number.
_FIRST, _DAYS, _SIDES = "0001-01-01", 3_652_059, (1717, 2127)
#: How often a number is moved on until it is one of those wanted. Of the rarest kind, three in five are.
_WALK = 96


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(value: Column, left: Column | int, right: Column | int, key: Column, kind: str) -> Column:
    """A keyed permutation of the whole numbers below ``left * right``: halves are shifted in turn by a keyed digest of the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (left, right))

    def shift(i: Column, half: Column) -> Column:
        mixed = F.sha2(F.concat_ws("|", key, F.lit(kind), a, b, i, half), 256)
        return F.conv(F.substring(mixed, 1, 13), 16, 10).cast("long")

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + shift(i, s["r"]), a)).otherwise(s["l"]).cast("long").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + shift(i, s["l"]), b)).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _power(base: int, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(base**k).cast("long") for k in range(10)]), (n + 1).cast("int"))


def _permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """Of up to 18 digits, as many."""
    n = F.length(digits)
    half = F.floor(n / 2)
    number = permuted(digits.cast("long"), _power(10, half), _power(10, n - half), key, f"{kind}{0}")
    return F.when(n == 0, digits).otherwise(F.lpad(number.cast("string"), n, "0"))


def _permuted_letters(letters: Column, first: str, key: Column, kind: str) -> Column:
    """Of up to 12 letters from ``first`` on, as many."""
    value = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - ord(first)))
    n = F.length(letters)
    half = F.floor(n / 2)

    def spelled(number: Column) -> Column:
        start = F.struct(number.alias("n"), F.lit("").alias("out"))
        step = lambda s, _: F.struct(F.floor(s["n"] / 26).cast("long").alias("n"), F.concat(F.char((F.pmod(s["n"], F.lit(26)) + ord(first)).cast("int")), s["out"]).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["out"])

    return _let(permuted(value, _power(26, half), _power(26, n - half), key, kind), spelled)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        own = c.between("0", "9")
        return F.struct((s["at"] + F.when(own, 1).otherwise(0)).alias("at"), F.concat(s["out"], F.when(own, F.substring(digits, s["at"], 1)).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The check digit that goes after ``digits``."""
    doubled = lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(doubled(c.cast("int"), i)))
    return F.pmod(10 - F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10, F.lit(10))


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise((n * F.when(c.between("A", "Z"), 100).otherwise(10) + value(c)) % 97))


def _email(hit: Column, key: Column) -> Column:
    local, place = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    parts = F.regexp_extract_all(local, F.lit("[a-z]{1,12}|[A-Z]{1,12}|[0-9]{1,12}|[^A-Za-z0-9]"), F.lit(0))
    one = lambda p: (
        F.when(p.rlike("^[a-z]"), _permuted_letters(p, "a", key, "email")).when(p.rlike("^[A-Z]"), _permuted_letters(p, "A", key, "email"))
        .when(p.rlike("^[0-9]"), _permuted_digits(p, key, "email")).otherwise(p)
    )
    return F.concat(F.array_join(F.transform(parts, one), ""), F.lit("@"), place)


def _iban(hit: Column, key: Column) -> Column:
    def checked(text: Column) -> Column:
        country, bank = F.substring(text, 1, 2), F.substring(text, 5, 99)
        parts = F.regexp_extract_all(bank, F.lit("[0-9]{1,18}|[A-Z]+"), F.lit(0))
        moved = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), _permuted_digits(p, key, "iban")).otherwise(p)), "")

        def spelled(new: Column) -> Column:
            whole = F.concat(country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
            return _refilled_all(hit, whole)

        return F.when(_mod97(F.concat(bank, F.substring(text, 1, 4))) == 1, _let(moved, spelled))

    return _let(F.replace(hit, F.lit(" "), F.lit("")), checked)


def _refilled_all(shape: Column, text: Column) -> Column:
    """``shape`` with everything but its blanks replaced, in order, by ``text``."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        own = (c != " ") & (c != "")
        return F.struct((s["at"] + F.when(own, 1).otherwise(0)).alias("at"), F.concat(s["out"], F.when(own, F.substring(text, s["at"], 1)).otherwise(c)).alias("out"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _ssn(hit: Column, key: Column) -> Column:
    area, group, serial = (F.substring(hit, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def spelled(n: Column) -> Column:
        a = F.floor(n / (99 * 9999)) + 1
        return F.concat(
            F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lit("-"),
            F.lpad((F.floor(n / 9999) % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((n % 9999 + 1).cast("string"), 4, "0"),
        )

    return F.when(good, _let(permuted(index, 898 * 99, 9999, key, "ssn"), spelled))


def _walked(value: Column, wanted: Callable[[Column], Column], key: Column, kind: str) -> Column:
    """A keyed permutation of those days that are ``wanted``: what lands on another is moved on until it does not."""
    move = lambda n: permuted(n, *_SIDES, key, kind)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), move(value), lambda n, _: F.when(wanted(n), n).otherwise(move(n)))


def _date(hit: Column, key: Column) -> Column:
    """Dates of all styles move alike, but for those that can only be read as day/month: they move among themselves.

    Written as month/day, such a pseudonym would be read otherwise than it is meant, or be that of another date.
    """
    first = F.lit(_FIRST).cast("date")
    of_day = lambda n: F.date_add(first, n.cast("int"))

    def moved(style: str, late: bool = False) -> Column:
        day = F.datediff(F.try_to_date(hit, style), first).cast("long")
        after = lambda n: F.dayofmonth(of_day(n)) > 12
        move = lambda d: _walked(d, after, key, "day") if late else permuted(d, *_SIDES, key, "date")
        return _let(day, lambda d: F.when(d.between(0, _DAYS - 1), _let(move(d), lambda n: F.date_format(of_day(n), style))))

    slashed = F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy", True))
    return F.when(hit.rlike("^[0-9]{4}-"), moved("yyyy-MM-dd")).when(hit.rlike(r"^[0-9]{2}\."), moved("dd.MM.yyyy")).otherwise(slashed)


def _card(hit: Column, key: Column) -> Column:
    def checked(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _permuted_digits(d.substr(F.lit(2), n - 2), key, "card"))
        good = d.substr(n, F.lit(1)).cast("int") == _luhn(d.substr(F.lit(1), n - 1))
        return F.when(good & ~d.rlike("^0+$"), _let(body, lambda b: _refilled(hit, F.concat(b, _luhn(b).cast("string")))))

    return _let(_digits(hit), checked)


def _phone(hit: Column, key: Column) -> Column:
    def checked(d: Column) -> Column:
        n = d.substr(F.length(d) - 9, F.lit(10))
        area, exchange, line = (n.substr(a, k).cast("long") for a, k in ((1, 3), (4, 3), (7, 4)))
        index = ((area - 200) * 800 + exchange - 200) * 10000 + line
        spelled = lambda m: F.concat(
            d.substr(F.lit(1), F.length(d) - 10), (F.floor(m / 8_000_000) + 200).cast("string"), (F.floor(m / 10000) % 800 + 200).cast("string"), F.lpad((m % 10000).cast("string"), 4, "0")
        )
        return F.when((area >= 200) & (exchange >= 200), _let(permuted(index, 80_000, 80_000, key, "phone"), lambda m: _refilled(hit, spelled(m))))

    return _let(_digits(hit), checked)


def _ip(hit: Column, key: Column) -> Column:
    def checked(parts: Column) -> Column:
        good = F.forall(parts, lambda p: (p <= 255)) & ~hit.rlike(r"(^|\.)0[0-9]")  # no second way to write a number
        number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
        spelled = lambda n: F.concat_ws(".", *[F.floor(n / 256**k) % 256 for k in (3, 2, 1, 0)])
        return F.when(good, _let(permuted(number, 1 << 16, 1 << 16, key, "ip"), spelled))

    return _let(F.transform(F.split(hit, r"\."), lambda p: p.cast("long")), checked)


_MOVES = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone, "ip": _ip}


def _lengths(kind: str, hit: Column, shorter: bool) -> Column:
    """What to try of the longest match of a kind: array<string>, some of them NULL or empty."""
    if shorter:
        return F.array(*[F.regexp_extract(hit, f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9A-Za-z])", 0) for n in CARD_DIGITS])
    if kind == "iban":
        known = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
        pattern = F.concat(F.lit("^(?:[A-Z0-9] ?){"), (F.try_element_at(known, F.substring(hit, 1, 2)) - 1).cast("string"), F.lit("}[A-Z0-9](?![A-Za-z0-9])"))
        return F.array(F.regexp_substr(hit, pattern), hit)
    return F.array(hit)


def _moved(window: Column, key: Column) -> Column:
    """kind, pseudonym and length of the value that starts at the second character of ``window``; NULL without one.

    The first kind that has a match there which passes its check counts. Shorter card numbers come last: of six lengths,
    one fits by chance in nearly half of all numbers, and would take the start of a phone number.
    """

    def of(kind: str, shorter: bool = False) -> Column:
        def tried(hit: Column) -> Column:
            one = lambda v: F.struct(F.lit(kind).alias("kind"), F.when(F.length(v) > 0, _MOVES[kind](v, key)).alias("new"), F.length(v).alias("size"))
            return F.when(hit != "", F.get(F.filter(F.transform(_lengths(kind, hit, shorter), one), lambda x: x["new"].isNotNull()), 0))

        return _let(F.regexp_extract(window, f"(?s)^.({KINDS[kind]})", 1), tried)

    return _let(window, lambda _: F.coalesce(*map(of, KINDS), of("card", True)))


def pseudonymize_texts(df: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``df`` with the personal values in ``text`` replaced, and a column of where they were.

    ``found`` is an array of kind, start, stop (exclusive; both in code points of the text as it was) and new, in order. Numbers
    that fail their check stay as they are. The same key gives the same pseudonyms in every run; whoever has it can undo them;
    it stands in no plan. Phone numbers are those of North America.
    A missing text stays missing and has none; empty and repeated texts are no special case; an empty table gives an
    empty one. Other columns pass through; one named ``found`` is replaced.
    """
    content, hold = text_of(text), f"__{found}"
    marked = F.concat(F.lit("\n"), content)  # so that no value starts at the first character
    # From a table of one row, as a constant would stand in plans and event logs for all to read.
    secret, hidden = f"{hold}_key", df.sparkSession.createDataFrame([(key,)], "key string").scalar()
    df = df.withColumn(secret, hidden)
    nothing = F.lit(None).cast("string")
    zipped = F.arrays_zip(F.split(marked, _STARTS, -1).alias("own"), F.concat(F.array(nothing), F.regexp_extract_all(marked, F.lit(_WINDOWS), F.lit(1))).alias("window"))
    pieces = F.transform(zipped, lambda x: F.struct(x["own"].alias("own"), F.when(x["window"].isNotNull(), _moved(x["window"], F.col(secret))).alias("to")))
    start = F.struct(
        F.lit(-1).alias("at"), F.lit(0).alias("free"), F.array().cast("array<string>").alias("text"),
        F.array().cast("array<struct<kind:string,start:int,stop:int,new:string>>").alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        """The next piece: a value at its start counts from ``free`` on, where the one before ended; text before that is gone."""
        to, stop = x["to"], s["at"] + F.length(x["own"])
        taken = to.isNotNull() & (s["at"] >= s["free"])
        free = F.when(taken, s["at"] + to["size"]).otherwise(s["free"])
        one = F.struct(to["kind"].alias("kind"), s["at"].alias("start"), free.alias("stop"), to["new"].alias("new"))
        rest = F.when(s["at"] >= free, x["own"]).when(stop > free, x["own"].substr(free - s["at"] + 1, F.length(x["own"]))).otherwise("")
        return F.struct(
            stop.alias("at"), free.alias("free"), F.array_append(s["text"], F.concat(F.when(taken, to["new"]).otherwise(""), rest)).alias("text"),
            F.when(taken, F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"),
        )

    plain = F.struct(F.array(marked).alias("text"), F.array().cast("array<struct<kind:string,start:int,stop:int,new:string>>").alias("out"))
    done = F.aggregate(pieces, start, step, lambda s: F.struct(s["text"].alias("text"), s["out"].alias("out")))
    staged = df.withColumn(hold, F.when(content.rlike(_WORTH), done).otherwise(plain))
    return staged.withColumns({
        text: F.when(F.col(text).isNull(), nothing).otherwise(F.regexp_replace(F.array_join(F.col(hold)["text"], ""), r"\A\n", "")),
        found: F.col(hold)["out"],
    }).drop(hold, secret)


def pseudonyms_by_document(documents: DataFrame, key: str) -> DataFrame:
    """The rewritten text of every document, how many values of each kind were replaced, and where."""
    done = pseudonymize_texts(documents.select("doc_id", "text"), key)
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return done.select("doc_id", "text", *map(of, KINDS), spans.alias("spans"))
