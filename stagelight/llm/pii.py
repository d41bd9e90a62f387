"""Format-preserving Feistel pseudonyms for personal data (operator 10). DataFrame functions only.

Values are cut out in passes, and what a pass leaves, failed candidates too, is whole text for the next: access keys,
secrets, e-mail and IPv4 addresses; IBANs and cards in their usual grouping, tried at each place where one can begin;
cards of other even groupings; dates, SSNs and phones; cards in any other grouping. IBANs (mod-97 digits, length of the
country), cards (Luhn digit), addresses (octets), dates (calendar), SSNs (area, group, serial) and phones (7 to 15
digits, not all the same) are validated. A keyed Feistel network then
permutes each value among the values of its own format:

- digit and letter strings: the halves are added, character by character in each one's own alphabet, to digests of
  the other half, so length, case, separators and the class of each character stay;
- cards: all digits but the last, which is the Luhn digit of the others;
- IPv4 addresses: two halves of 16 bits; dates: a day number in a product of two moduli; SSNs: the number of an SSN
  among those that can be given out. Dates with the month first are those that can't be read day first, and are
  permuted among themselves;
- phones: all digits but the country code, so that a number with and without it, spaced or not, stays linked.

The key, the class and the length are all that a permutation depends on, so equal values get equal pseudonyms in
every document, however they are spaced, and different values never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm.common import fresh

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Candidates, in the order in which they are tried at a place.
PATTERNS = {
    "credential": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9/-]|\.[0-9])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: No candidate is without one of these.
HINT = r"[0-9@]|AKIA|ASIA|(?i:pass|pwd|secret|token|key)"
#: Cut out first, and after IBANs and cards in their usual grouping.
FIRST, LATER = ("|".join(PATTERNS[k] for k in kinds) for kinds in (("credential", "secret", "email", "ip"), ("date", "ssn", "phone")))

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int) -> str:
    fours, rest = divmod(length - 4, 4)
    return rf"(?:{IBAN_LENGTHS[length].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Zero-width: where an IBAN or a card can begin.
IBAN_HEAD, CARD_HEAD = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4})", r"(?<![0-9+])(?=[0-9](?:[ -]?[0-9]){12})"
#: Cards in their usual grouping, the first number of a row, and rows whose first number has four digits or more.
USUAL_HEAD, ROW_HEAD, LONG_HEAD = r"(?<![0-9+])(?=[0-9]{13}|[0-9]{4}[ -][0-9]{4,6}[ -][0-9]{4})", CARD_HEAD.replace("(?=", "(?<![0-9][ -])(?=", 1), CARD_HEAD.replace("(?=", "(?=[0-9]{4})(?=", 1)
#: What is tried at such a place, in order. An IBAN of its country's length doesn't take the next word.
IBANS = [f"^(?:{'|'.join(map(_iban_of, IBAN_LENGTHS))})(?![A-Za-z0-9])", f"^{PATTERNS['iban'].removeprefix('(?<![A-Za-z0-9])')}"]
USUAL_CARDS = [r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{3}(?![0-9])", r"^[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])", r"^[0-9]{13,19}(?![0-9])"]
#: All numbers of a row: first those with one separator throughout.
EVEN_CARDS = [r"^(?=[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9]))[0-9]{1,6}([ -])[0-9]{1,6}(?:\1[0-9]{1,6})*(?![ -]?[0-9])"]
OTHER_CARDS = [r"^[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", *(rf"^(?=[0-9]{{4,}}(?:[ -][0-9]{{4,}})*(?:[^0-9]|$))[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])" for n in (16, 15, 14, 19, 18, 17, 13))]
#: The longest value: a card of 19 digits or an IBAN of 34 characters with separators, and the character after it.
REACH = 48
#: Places that such a value can span: of numbers, one at each group of digits, so every two characters at most.
REACH_PARTS = REACH // 2 + 1
#: Places that are folded together.
BLOCK = 128

#: Days 1900-01-01 to 2200-08-14: the product of the two moduli of the dates' network.
DATE_MODULI = (300, 366)
#: SSNs: areas 001 to 899 without 666, and 99 groups of 9,999 serials.
SSN_MODULI = (898, 99 * 9999)
#: Country codes by their first digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Steps of a walk through a permutation's cycle to the next value of a set that holds more than half of all: it
#: misses with probability 1e-16.
WALK = 40


def _number(key: str, parts: list[Column], modulus: int) -> Column:
    """A number below modulus from the digest of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 12), 16, 10).cast("long") % F.lit(modulus)


def permute_number(value: Column, key: str, kind: str, a: int, b: int) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""

    def step(acc: Column, i: Column) -> Column:
        left = (acc["l"] + _number(key, [F.lit(kind), i, F.lit("l"), acc["r"]], a)) % F.lit(a)
        return F.struct(left.alias("l"), ((acc["r"] + _number(key, [F.lit(kind), i, F.lit("r"), left], b)) % F.lit(b)).alias("r"))

    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), (value % F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def _add(half: Column, digest: Column) -> Column:
    """Each character moved within its alphabet by two hex digits of the digest; the digest goes round for long halves."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, i % 64 * 2 + 1, 2), 16, 10).cast("int")
        out = c
        for alphabet in (DIGITS, LOWER, UPPER):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), move), "")


def permute_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with the value's length and classes of characters; others stay in place."""
    classes = F.translate(value, DIGITS + LOWER + UPPER, "0" * 10 + "a" * 26 + "A" * 26)
    half = F.floor(F.length(value) / 2).cast("int")

    def step(acc: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), classes, acc["r"]), 512)
        return F.struct(acc["r"].alias("l"), _add(acc["l"], digest).alias("r"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    alone = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), classes), 512)
    return F.when(F.length(value) < 2, _add(value, alone)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"])))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, last_doubled: bool) -> Column:
    """Sum of the Luhn values; last_doubled: the last digit counts twice, as before a check digit."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == (0 if last_doubled else 1), F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x)


def refill(template: Column, chars: Column, pattern: str) -> Column:
    """template with its characters that match pattern replaced by those of chars, in order."""
    gaps = F.split(template, pattern)
    return F.array_join(F.zip_with(gaps, F.split(chars, ""), lambda g, c: F.concat(F.coalesce(g, F.lit("")), F.coalesce(c, F.lit("")))), "")


def card_pseudonym(found: Column, key: str) -> Column:
    digits = digits_of(found)
    card = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.concat(card, ((10 - luhn_sum(card, True) % 10) % 10).cast("string"))
    return refill(found, card, "[0-9]")


def iban_pseudonym(found: Column, key: str) -> Column:
    """Country and separators stay, account characters are permuted, check digits are computed again."""
    compact = F.regexp_replace(found, " ", "")
    account = permute_text(F.substring(compact, F.lit(5), F.length(compact)), key, "iban")
    country = F.substring(compact, 1, 2)
    check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return refill(found, F.concat(country, check, account), "[A-Za-z0-9]")


def is_card(found: Column) -> Column:
    return luhn_sum(digits_of(found), False) % 10 == 0


def is_iban(found: Column) -> Column:
    compact = F.regexp_replace(found, " ", "")
    return mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1


def _walk(value: Column, permute, inside) -> Column:
    """The first value of the set in the permutation's cycle behind `value`, which is a permutation of the set."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permute(value), lambda n, _: F.when(inside(n), n).otherwise(permute(n)))


def ssn_pseudonym(found: Column, digits: Column, key: str) -> Column:
    """Area, group and serial of a valid SSN become those of another one; others stay."""
    area, group, serial = (F.substring(digits, *x).try_cast("long") for x in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (area - F.when(area > 666, 2).otherwise(1)) * SSN_MODULI[1] + (group - 1) * 9999 + serial - 1

    def spelt(n: Column) -> Column:
        a, rest = F.floor(n / F.lit(SSN_MODULI[1])).cast("long"), n % SSN_MODULI[1]
        a = a + F.when(a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(rest / F.lit(9999)).cast("long") + 1).cast("string"), 2, "0"), F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(permute_number(number, key, "ssn", *SSN_MODULI), spelt)).otherwise(found)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one match of FIRST or LATER; one that isn't valid stays as it is."""
    is_a = lambda kind: found.rlike(f"^(?:{PATTERNS[kind].replace('(?<', '(?<')})$")
    digits = digits_of(found)
    octets = F.split(found, r"\.")
    ip = sum(((F.try_element_at(octets, F.lit(i + 1)).try_cast("long") * 256 ** (3 - i)) for i in range(4)), F.lit(0))
    ip = permute_number(ip, key, "ip", 65536, 65536)
    ip = F.concat_ws(".", *((F.floor(ip / F.lit(256 ** (3 - i))) % 256).cast("string") for i in range(4)))
    # dates: year first, or day first with / or .
    first = F.try_to_timestamp(F.lit("1900-01-01"), F.lit("yyyy-MM-dd")).cast("date")
    year_first = found.rlike("^[0-9]{4}-")
    day = F.when(year_first, F.try_to_timestamp(found, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(F.regexp_replace(found, "[.]", "/"), F.lit("dd/MM/yyyy"))).cast("date")
    at = F.datediff(day, first)
    valid_day = at.between(0, DATE_MODULI[0] * DATE_MODULI[1] - 1)
    new_day = F.date_add(first, permute_number(at, key, "date", *DATE_MODULI).cast("int"))
    date = F.when(year_first, F.date_format(new_day, "yyyy-MM-dd")).when(found.contains("/"), F.date_format(new_day, "dd/MM/yyyy")).otherwise(F.date_format(new_day, "dd.MM.yyyy"))
    # month first: only where the second number is no month
    us_at = F.datediff(F.try_to_timestamp(F.when(found.rlike("^[0-9]{2}/(?:1[3-9]|[23])"), found), F.lit("MM/dd/yyyy")).cast("date"), first)
    us_day = F.date_add(first, _walk(us_at, lambda n: permute_number(n, key, "us-date", *DATE_MODULI), lambda n: F.dayofmonth(F.date_add(first, n.cast("int"))) > 12).cast("int"))
    date = F.when(valid_day, date).when(us_at.between(0, DATE_MODULI[0] * DATE_MODULI[1] - 1), F.date_format(us_day, "MM/dd/yyyy")).otherwise(found)
    head = F.regexp_extract(found, r"^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)", 0)
    secret = F.concat(head, permute_text(F.substring(found, F.length(head) + 1, F.length(found)), key, "secret"))
    local = F.substring_index(found, "@", 1)
    email = F.concat(permute_text(local, key, "email"), F.substring(found, F.length(local) + 1, F.length(found)))
    code = F.regexp_extract(found, COUNTRY, 0)
    rest = F.substring(found, F.length(code) + 1, F.length(found))
    phone = F.concat(code, refill(rest, permute_text(digits_of(rest), key, "phone"), "[0-9]"))
    valid_phone = F.length(digits).between(7, 15) & ~digits.rlike(r"^([0-9])\1*$")
    return (
        F.when(is_a("credential"), F.concat(F.substring(found, 1, 4), permute_text(F.substring(found, F.lit(5), F.lit(16)), key, "credential")))
        .when(head != "", secret)
        .when(found.contains("@"), email)
        .when(is_a("ip"), ip)
        .when(is_a("date"), date)
        .when(is_a("ssn"), ssn_pseudonym(found, digits, key))
        .when(is_a("phone"), F.when(valid_phone, phone).otherwise(found))
        .otherwise(found)
    )


def mod97(text: Column) -> Column:
    """The number that the letters (A = 10 ...) and digits spell, modulo 97."""

    def step(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _piece(text: Column, kind: str | None) -> Column:
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(kind).cast("string").alias("kind"))


def _on_text(pieces: Column, pattern: str, use) -> Column:
    """Pieces with use(text) in place of those that are no value yet and that the pattern finds."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull() & p["text"].rlike(pattern), use(p["text"])).otherwise(F.array(p))))


def _matches(pieces: Column, pattern: str) -> Column:
    """Cuts out all matches of the pattern."""
    found = lambda t: F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(0))
    return _on_text(pieces, pattern, lambda t: F.flatten(F.zip_with(F.split(t, pattern), found(t), lambda gap, m: F.array(_piece(gap, None), _piece(m, "match")))))


def _scanned(pieces: Column, head: str, options: list[str], kind: str, valid) -> Column:
    """Cuts out the valid values of the kind.

    At each place that head finds, the options are tried in order; the first valid one is cut out and the search goes
    on behind it, else at the next place.
    """

    def choice(parts: Column, i: Column) -> Column:
        try_all = lambda w: F.coalesce(*(_let(F.regexp_extract(w, o, 0), lambda m: F.when((m != "") & valid(m), m)) for o in options))
        return _let(F.substring(F.array_join(F.slice(parts, i + 1, F.lit(REACH_PARTS)), ""), 1, REACH), try_all)

    def place(parts: Column, found: Column, i: Column) -> Column:
        """(i, j, found, rest): a value that begins at place i ends in place j, of whose text rest is left."""
        step = lambda acc, p: F.when(acc["last"].isNotNull(), acc).when(acc["left"] > F.length(p), F.struct((acc["j"] + 1).alias("j"), (acc["left"] - F.length(p)).alias("left"), acc["last"].alias("last"))).otherwise(F.struct(acc["j"].alias("j"), acc["left"].alias("left"), p.alias("last")))
        start = F.struct(i.alias("j"), F.length(found).alias("left"), F.lit(None).cast("string").alias("last"))
        end = F.aggregate(F.slice(parts, i + 1, F.lit(REACH_PARTS)), start, step)
        return _let(end, lambda e: F.struct(i.alias("i"), e["j"].alias("j"), found.alias("found"), F.substring(e["last"], e["left"] + 1, F.length(e["last"])).alias("rest")))

    places = lambda parts: F.filter(F.transform(parts, lambda p, i: _let(choice(parts, i), lambda found: F.when(found.isNotNull(), place(parts, found, i)))), lambda c: c.isNotNull())
    cut = lambda parts: _let(places(parts), lambda all_: _let(_first_come(all_), lambda taken: _rebuilt(parts, taken, kind)))
    return _on_text(pieces, head, lambda t: _let(F.split(t, head), cut))


def _first_come(places: Column) -> Column:
    """Those of the places (by rising i) that begin behind the end of the last one taken.

    Each depends on those before it, so this is a fold. A fold copies what it holds at each step: it holds numbers
    alone, over blocks of places, first the end that each block leaves, then which of a block are taken.
    """
    size = F.floor((F.size(places) + BLOCK - 1) / BLOCK).cast("int")
    cut = F.transform(F.slice(F.sequence(F.lit(0), size), F.lit(1), size), lambda b: F.slice(places, b * BLOCK + 1, F.lit(BLOCK)))

    def over(blocks: Column) -> Column:
        last = lambda j, c: F.when(c["i"] > j, c["j"]).otherwise(j)
        ends = F.aggregate(blocks, F.array(F.lit(-1)), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, F.lit(-1)), last))))
        step = lambda acc, c: F.when(c["i"] > acc["j"], F.struct(c["j"].alias("j"), F.concat(acc["at"], F.array(c["i"])).alias("at"))).otherwise(acc)
        picked = lambda b, j: F.aggregate(b, F.struct(j.alias("j"), F.array().cast("array<int>").alias("at")), step, lambda acc: acc["at"])
        return F.flatten(_let(ends, lambda e: F.transform(blocks, lambda b, n: _let(picked(b, F.get(e, n)), lambda at: F.filter(b, lambda c: F.array_contains(at, c["i"]))))))

    return _let(cut, over)


def _rebuilt(parts: Column, taken: Column, kind: str) -> Column:
    """Pieces: each value, and the text before, between and behind them as one piece each; each part is read once."""
    text = lambda low, upto: F.array_join(F.slice(parts, low + 1, F.greatest(upto - low, F.lit(0))), "")
    until = lambda k: F.coalesce(F.get(taken, k)["i"], F.size(parts))
    behind = F.transform(taken, lambda c, k: F.array(_piece(c["found"], kind), _piece(F.concat(c["rest"], text(c["j"] + 1, until(k + 1))), None)))
    return F.concat(F.array(_piece(text(F.lit(0), until(F.lit(0))), None)), F.flatten(behind))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the personal data in `text` replaced; all other columns and all other text stay.

    Found are e-mail addresses (the local part changes), IPv4 addresses, card numbers with a valid Luhn digit, IBANs
    with valid check digits, US social-security numbers, phone numbers, calendar dates from 1900-01-01 to 2200-08-14,
    access keys and the values of passwords and tokens. Dates may have the year first, the day first or, where that
    is no date, the month first. Candidates that are not valid stay. Not covered, and left as they stand: dates with one
    digit for day or month, with the year first and slashes, or with the day first and dashes; SSNs with spaces or
    without separators; IPv6 addresses; phone numbers of ten digits in a row without a plus; secrets of fewer than eight
    characters. A null text stays null, an
    empty one empty. Repeated rows and equal values in other rows get equal pseudonyms under one key. Whole texts of
    any length are read, in time linear in their length; a text without a digit, `@` or keyword is passed on unchanged. Other columns may have any
    names; an empty table stays empty. No shuffle.
    """
    held = fresh(docs, "_pieces")
    now, x = F.col(held), lambda p: p["text"]
    passes = [
        lambda p: _matches(p, FIRST),
        *((lambda p, some=options: _scanned(p, IBAN_HEAD, some, "iban", is_iban)) for options in (IBANS[:1], IBANS[1:])),
        lambda p: _scanned(p, USUAL_HEAD, USUAL_CARDS, "card", is_card),
        lambda p: _scanned(p, ROW_HEAD, EVEN_CARDS, "card", is_card),
        lambda p: _matches(p, LATER),
        lambda p: _scanned(p, ROW_HEAD, OTHER_CARDS[:1], "card", is_card),
        lambda p: _scanned(p, LONG_HEAD, OTHER_CARDS[1:], "card", is_card),
    ]
    new = lambda p: F.when(p["kind"].isNull(), x(p)).when(p["kind"] == "card", card_pseudonym(x(p), key)).when(p["kind"] == "iban", iban_pseudonym(x(p), key)).otherwise(pseudonym(x(p), key))
    # a column for each pass: the analyser resolves nested lambdas one level at a time, over the whole tree each time
    out = docs.withColumn(held, F.when(F.col(text).rlike(HINT), F.array(_piece(F.col(text), None))))
    for cut in passes:
        out = out.withColumn(held, cut(now))
    return out.withColumn(text, F.coalesce(F.array_join(F.transform(now, new), ""), F.col(text))).drop(held)


#: The query's key. A production run passes its own.
QUERY_KEY = "stagelight-example-key"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_KEY)


QUERIES = {"op10_pii_pseudonyms": op10_pii_pseudonyms}
ORACLE_SQL: dict[str, str] = {}
