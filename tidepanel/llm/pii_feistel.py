"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check (Luhn, calendar, octet and area ranges) are permuted within their own format by a keyed Feistel
network whose round function is SHA-256: a card becomes another number that passes Luhn, a date another date, an address another
address, in the same punctuation. The permutation depends on the key, the kind and the value alone, so equal values stay linked across
documents, and who has the key can turn it back (``restored``). The name part of an e-mail address is permuted the same way, letters
among letters of their case and digits among digits.

DataFrame and SQL functions only: one regular expression cuts a text into matches and the gaps between them, each match goes through
SQL expressions (rounds are an ``aggregate`` over a sequence), and the pieces are joined again. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import frames

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "ip", "date", "email")

#: The patterns of candidates, in the order in which they are tried at a place. Repeated groups are possessive, which takes
#: no stack, so matches may be of any length; what follows such a group can't be in it. The name part of an address has 64 characters at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone_plus": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])",
    "phone_area": r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date_iso": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9])|(?![0-9A-Za-z-]))",
    "date_dots": r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z])",
    "date_slashes": r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z/])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone_plain": r"(?<![0-9A-Za-z-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])",
}
#: A run of groups of digits, 13 digits or more, up to where another candidate begins; possessive, so runs of any length take no stack.
CARD_RUN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -](?!" + "|".join(PATTERNS.values()) + r")[0-9]++(?![A-Za-z]))*+"
CANDIDATE = "|".join([*PATTERNS.values(), CARD_RUN])
#: Digits of a card, least and most.
LEAST, MOST = 13, 19
#: The country codes of telephone numbers of one and of two digits; all others have three.
CODES_1 = ("1", "7")
CODES_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54",
    "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
#: The code of numbers that are written without one (ddd-ddd-dddd is a format of countries with this code).
HOME_CODE = "1"
#: Days from the first date on: 400 years, which is 189 * 773 days.
FIRST_DATE, LEFT_DAYS, RIGHT_DAYS = "1800-01-01", 189, 773


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, kind: str, *parts: str) -> str:
    """60 bits of a keyed SHA-256."""
    return f"cast(conv(substr(sha2(concat_ws('|', {_quoted(key)}, {kind}, {', '.join(parts)}), 256), 1, 15), 16, 10) AS bigint)"


def _rounds(back: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0, -1)" if back else f"sequence(0, {ROUNDS - 1})"


def _permuted(left: str, right: str, left_size: str, right_size: str, key: str, kind: str, back: bool) -> str:
    """A struct of l and r: a permutation of the pairs in [0, left_size) x [0, right_size), halves changing in turn."""
    sign = "-" if back else "+"
    turn = f"""(a, i) -> CASE WHEN i % 2 = 0
        THEN named_struct('l', pmod(a.l {sign} {_digest(key, kind, "i", "a.r")} % ({left_size}), {left_size}), 'r', a.r)
        ELSE named_struct('l', a.l, 'r', pmod(a.r {sign} {_digest(key, kind, "i", "a.l")} % ({right_size}), {right_size})) END"""
    return f"aggregate({_rounds(back)}, named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), {turn})"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _number(digits: str, key: str, kind: str, back: bool) -> str:
    """A string of 2 to 18 digits, permuted among those of its length."""
    half, rest = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    size = lambda n: f"cast(pow(10, {n}) AS bigint)"
    pair = _permuted(f"substr({digits}, 1, {half})", f"substr({digits}, {half} + 1)", size(half), size(rest), key, f"concat({kind}, length({digits}))", back)
    return _let("p", pair, f"concat(lpad(cast(p.l AS string), cast({half} AS int), '0'), lpad(cast(p.r AS string), cast({rest} AS int), '0'))")


def _in_format(text: str, digits: str) -> str:
    """``text`` with its digits, in order, replaced by ``digits``."""
    place = f"length({_digits(f'substr({text}, 1, k + 1)')})"
    return f"array_join(transform(split({text}, ''), (c, k) -> CASE WHEN c BETWEEN '0' AND '9' THEN substr({digits}, {place}, 1) ELSE c END), '')"


def _luhn(digits: str, first: int) -> str:
    """The Luhn sum, where the last digit is doubled if ``first`` is 1."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, k) -> CASE WHEN (k + {first}) % 2 = 0 THEN cast(c AS int) ELSE (cast(c AS int) * 2) div 10 + (cast(c AS int) * 2) % 10 END), 0L, (a, x) -> a + x)"


#: Groups of digits that are taken together before their results are put to those of the others: what is copied as arrays grow.
CHUNK = 256


def _chunked(name: str, items: str, start: str, fields: tuple[str, ...], out: str, step: str) -> str:
    """A struct of ``fields`` and ``out`` (an array of arrays) after ``step``, from (z, w) for each of ``items``, which extends ``z.out``; chunk by chunk, so that an array never grows long one by one."""
    empty = f"cast(array() AS array<{out}>)"
    carried = ", ".join(f"'{f}', {name}.{f}" for f in fields)
    inner = f"aggregate(c, named_struct({carried}, 'out', {empty}), (z, w) -> {step})"
    joined = _let("r", inner, f"named_struct({', '.join(f"'{f}', r.{f}" for f in fields)}, 'out', concat({name}.out, array(r.out)))")
    chunks = f"transform(sequence(0, (size({items}) - 1) div {CHUNK}), c -> slice({items}, cast(c * {CHUNK} + 1 AS int), {CHUNK}))"
    return f"aggregate({chunks}, named_struct({start}, 'out', cast(array() AS array<array<{out}>>)), ({name}, c) -> {joined})"


def _card(m: str, key: str, back: bool) -> str:
    """A struct of n and text: how many cards a run of groups has, and the run with each of them permuted.

    Of the sub-runs that start at a group the longest that passes Luhn counts; from left to right each is a card, or the longest that starts within it.
    Luhn sums of sub-runs are differences of two running sums over the whole run, with every even digit doubled and with every odd one, so
    a run of any length takes time in proportion to it.
    """
    doubled, plain = "cast(substr('0246813579', cast(d AS int) + 1, 1) AS int)", "cast(d AS int)"
    digit = f"named_struct('p', v.p + 1, 'x', v.x + CASE WHEN v.p % 2 = 0 THEN {doubled} ELSE {plain} END, 'y', v.y + CASE WHEN v.p % 2 = 0 THEN {plain} ELSE {doubled} END)"
    group = f"aggregate(split(w, ''), named_struct('p', z.p, 'x', z.x, 'y', z.y), (v, d) -> {digit})"
    sums = _chunked("zz", "g", "'p', 0, 'x', 0, 'y', 0", ("p", "x", "y"), "struct<p:int,x:int,y:int>", _let("q", group, "named_struct('p', q.p, 'x', q.x, 'y', q.y, 'out', concat(z.out, array(q)))"))
    running = f"concat(array(named_struct('p', 0, 'x', 0, 'y', 0)), flatten({sums}.out))"
    # from group i on, x groups: digits from i to e; the last digit is plain, so what is doubled are those of the other parity
    between = _let("e", "f[i + x]", f"e.p - f[i].p BETWEEN {LEAST} AND {MOST} AND (CASE WHEN e.p % 2 = 0 THEN e.x - f[i].x ELSE e.y - f[i].y END) % 10 = 0")
    longest = _let("k", f"coalesce(get(filter(sequence(least({MOST}, size(g) - i), 1, -1), x -> {between}), 0), 0)", "named_struct('k', k, 'n', f[i + k].p - f[i].p)")
    own = _let("d", _digits("u"), _let("q", _number("substr(d, 1, length(d) - 1)", key, "'card'", back), _let("e", f"concat(q, cast((10 - {_luhn('q', 1)} % 10) % 10 AS string))", _in_format("u", "e"))))
    best = "aggregate(sequence(w, w + s[w].k - 1), w, (b, h) -> CASE WHEN s[h].n > s[b].n THEN h ELSE b END)"
    card = _let("u", "array_join(slice(t, j + 1, s[j].k), '')", own)
    taken = _let("j", best, f"named_struct('at', j + s[j].k, 'n', z.n + 1, 'out', concat(z.out, array(array_join(slice(t, z.at + 1, j - z.at), ''), {card})))")
    found = _chunked("zz", "places", "'at', 0, 'n', 0", ("at", "n"), "string", f"CASE WHEN w < z.at OR s[w].k = 0 THEN z ELSE {taken} END")
    out = _let("r", _let("places", "sequence(0, size(g) - 1)", found), "named_struct('n', r.n, 'text', array_join(concat(flatten(r.out), slice(t, r.at + 1, size(t))), ''))")
    some = "CASE WHEN exists(s, o -> o.k > 0) THEN " + out + f" ELSE named_struct('n', 0, 'text', {m}) END"
    parts = _let("f", running, _let("s", f"transform(g, (y, i) -> {longest})", _let("t", f"regexp_extract_all({m}, '[0-9]+[ -]?', 0)", some)))
    return _let("g", f"split({m}, '[ -]')", parts)


def _phone(m: str, key: str, back: bool) -> str:
    """The digits after the country code, whatever punctuation is between them; the permutation depends on the code and these digits alone."""
    listed = lambda codes: ", ".join(map(_quoted, codes))
    size = f"CASE WHEN NOT startswith({m}, '+') THEN 0 WHEN substr(d, 1, 1) IN ({listed(CODES_1)}) THEN 1 WHEN substr(d, 1, 2) IN ({listed(CODES_2)}) THEN 2 ELSE 3 END"
    kind = f"concat('phone', CASE WHEN z = 0 THEN {_quoted(HOME_CODE)} ELSE substr(d, 1, z) END, '/')"
    body = _let("e", f"concat(substr(d, 1, z), {_number('substr(d, z + 1)', key, kind, back)})", _in_format(m, "e"))
    return _let("d", _digits(m), _let("z", size, f"CASE WHEN length(d) <= 15 AND length(d) - z >= 6 THEN {body} END"))


def _ssn(m: str, key: str, back: bool) -> str:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    pair = _permuted("a1 - 1 - CASE WHEN a1 > 666 THEN 1 ELSE 0 END", "(a2 - 1) * 9999 + a3 - 1", "898", "989901", key, "'ssn'", back)
    area = "p.l + 1 + CASE WHEN p.l >= 665 THEN 1 ELSE 0 END"
    out = f"concat(lpad(cast({area} AS string), 3, '0'), '-', lpad(cast(p.r div 9999 + 1 AS string), 2, '0'), '-', lpad(cast(p.r % 9999 + 1 AS string), 4, '0'))"
    body = f"CASE WHEN a1 BETWEEN 1 AND 899 AND a1 <> 666 AND a2 > 0 AND a3 > 0 THEN {_let('p', pair, out)} END"
    part = lambda i: f"cast(split({m}, '-')[{i}] AS bigint)"
    return _let("a1", part(0), _let("a2", part(1), _let("a3", part(2), body)))


def _ip(m: str, key: str, back: bool) -> str:
    pair = _permuted("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key, "'ip'", back)
    out = "concat_ws('.', cast(p.l div 256 AS string), cast(p.l % 256 AS string), cast(p.r div 256 AS string), cast(p.r % 256 AS string))"
    return _let("o", f"transform(split({m}, '[.]'), x -> cast(x AS bigint))", f"CASE WHEN forall(o, x -> x <= 255) THEN {_let('p', pair, out)} END")


def _date(m: str, form: str, key: str, back: bool) -> str:
    days = f"datediff(try_to_date({m}, '{form}'), date'{FIRST_DATE}')"
    pair = _permuted(f"n div {RIGHT_DAYS}", f"n % {RIGHT_DAYS}", str(LEFT_DAYS), str(RIGHT_DAYS), key, "'date'", back)
    out = f"date_format(date_add(date'{FIRST_DATE}', cast(p.l * {RIGHT_DAYS} + p.r AS int)), '{form}')"
    return _let("n", days, f"CASE WHEN n BETWEEN 0 AND {LEFT_DAYS * RIGHT_DAYS - 1} THEN {_let('p', pair, out)} END")


def _name(name: str, key: str, back: bool) -> str:
    """A string whose characters move within a-z, A-Z or 0-9, half by half."""
    sign = "-" if back else "+"

    def moved(half: str, other: str) -> str:
        by = _digest(key, "'name'", "i", "j", other)
        one = " ".join(f"WHEN c BETWEEN '{a}' AND '{z}' THEN chr({ord(a)} + pmod(ascii(c) - {ord(a)} {sign} {by} % {n}, {n}))" for a, z, n in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)))
        return f"array_join(transform(split({half}, ''), (c, j) -> CASE {one} ELSE c END), '')"

    turn = f"(a, i) -> CASE WHEN i % 2 = 0 THEN named_struct('l', {moved('a.l', 'a.r')}, 'r', a.r) ELSE named_struct('l', a.l, 'r', {moved('a.r', 'a.l')}) END"
    pair = f"aggregate({_rounds(back)}, named_struct('l', substr({name}, 1, length({name}) div 2), 'r', substr({name}, length({name}) div 2 + 1)), {turn})"
    return _let("p", pair, "concat(p.l, p.r)")


def _replacement(m: str, key: str, back: bool) -> str:
    """A struct of the kind, what stands in for a match and how many values it has; the kind is null and the text its own where a match isn't valid."""

    def own(kind: str, value: str) -> str:
        return _let("v", value, f"named_struct('kind', CASE WHEN v IS NOT NULL THEN '{kind}' END, 'text', coalesce(v, {m}), 'n', 1)")

    cases = [
        (f"contains({m}, '@')", own("email", _let("w", f"substring_index({m}, '@', 1)", f"concat({_name('w', key, back)}, substr({m}, length(w) + 1))"))),
        (f"{m} RLIKE '^([0-9]+[.]){{3}}[0-9]+$'", own("ip", _ip(m, key, back))),
        (f"{m} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'", own("date", _date(m, "yyyy-MM-dd", key, back))),
        (f"{m} RLIKE '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$'", own("date", _date(m, "dd.MM.yyyy", key, back))),
        (f"{m} RLIKE '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$'", own("date", _date(m, "dd/MM/yyyy", key, back))),
        (f"{m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'", own("ssn", _ssn(m, key, back))),
        (f"{m} RLIKE '^[(+]' OR {m} RLIKE '^[0-9]{{3}}[-.][0-9]{{3}}[-.][0-9]{{4}}$'", own("phone", _phone(m, key, back))),
    ]
    card = _let("v", _card(m, key, back), "named_struct('kind', CASE WHEN v.n > 0 THEN 'card' END, 'text', v.text, 'n', v.n)")
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {card} END"


def _rewritten(docs: DataFrame, key: str, text: str, back: bool) -> DataFrame:
    counts = tuple(f"n_{k}" for k in KINDS)
    none = F.expr("cast(array() AS array<string>)")
    # the text stays in its place; all else goes through in a struct, so no name of a column matters
    own = docs.select(frames.packed(docs, counts).alias("row"), F.col(text).alias("text"))
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0))).otherwise(none)
    hits = own.withColumn("found", found).withColumn("hits", F.expr(f"transform(found, m -> {_replacement('m', key, back)})"))
    gaps = F.split(F.col("text"), CANDIDATE, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("hits", i)["text"], F.lit(""))))
    out = F.when(F.exists("hits", lambda h: h["kind"].isNotNull()), F.array_join(pieces, "")).otherwise(F.col("text"))

    def count(kind: str) -> Column:
        return F.aggregate(F.filter("hits", lambda h: h["kind"] == kind), F.lit(0).cast("long"), lambda a, h: a + h["n"])

    kept = [c for c in docs.columns if c.lower() not in counts]
    return hits.select(*[(out if c.lower() == text.lower() else F.col("row").getField(c)).alias(c) for c in kept], *[count(k).alias(f"n_{k}") for k in KINDS])


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, and n_card, n_phone, n_ssn, n_ip, n_date, n_email (long), how many were.

    Card: 13 to 19 digits, single blanks or hyphens between them, that pass Luhn, also beside other groups of digits (see ``_card``). Phone:
    + and digits with a country code (told by its first digits, with or without a separator), area in parentheses, or ddd-ddd-dddd; the
    last two count as numbers of ``HOME_CODE``. The code stays and the digits after it are permuted, so one number in several formats
    stays one. Ssn: ddd-dd-dddd in the ranges given out. Ip: four octets. Date: yyyy-MM-dd, dd.MM.yyyy or dd/MM/yyyy (day first) of 1800
    to 2199, the first also before the time of a timestamp. Email: the part before the @, of 64 characters at most; the domain stays.
    Candidates that fail their check, and all else, stay byte for byte; numbers with letters or further digits at an end are no candidates.

    A null text stays null with counts of 0. Whole texts and matches of any length are rewritten; repeated rows alike; an empty table gives
    an empty table. Columns of the new names, in any case, are replaced; others pass through, whatever they are called.
    """
    return _rewritten(docs, key, text, False)


def restored(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Turns ``pseudonymised`` back, with the same key: each permutation takes valid values of a kind and format to such values.

    A card beside other groups of digits doesn't come back where its pseudonym makes another sub-run pass Luhn that comes first: the
    permutation depends on the card alone, so that equal cards stay linked, and can't look at its neighbours.
    """
    return _rewritten(docs, key, text, True)
