"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is checked (calendar dates, Luhn, IBAN and
address checks, ...) and what is valid is replaced by a keyed permutation of
its own kind: a valid card number becomes another valid card number, a date
another date.  The permutations are Feistel networks, so they can be undone
with the key, and equal values get equal pseudonyms in every document.

* ``permute_text`` permutes strings over an alphabet: each round adds to one
  half, symbol by symbol, what SHA-256 gives for the key, the kind and the
  other half.
* ``permute_pair`` permutes pairs of numbers below two bounds: each round adds
  to one of them, modulo its bound, what SHA-256 gives for the other one.  So
  the days of two centuries, addresses or social security numbers map onto
  themselves without any walk.

Defined cases: null text stays null with no findings; empty text stays empty;
keys may be null or repeat, each row is treated by itself; very long texts,
runs of numbers and secrets take time in proportion to their length; ``pseudonymize``
keeps all other columns; an empty table gives an empty result.  A candidate
that fails every check is looked at again from each of its numbers and words to
each later one: from the left, the longest part that is valid is replaced.  The
rest stays as it is.  A part replaced in a run of numbers can, by chance (about
one in ten), form a longer valid card number with its neighbours; there, and
only there, undoing goes wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgeo.llm.common import free_name

ROUNDS = 8
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()

#: Days from 1900-01-01 to 2099-12-31, as a product.
DATE_A, DATE_B = 17, 4297
FIRST_DAY = "1900-01-01"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+"
#: Names before a secret, in any case.
NAMES = "(?i:token|password|passwd|secret|api_?key)"
SECRET = rf"AKIA[0-9A-Z]{{16}}|{NAMES}\s{{0,2}}[=:]\s{{0,2}}[\"']?[0-9A-Za-z+/_-]{{8,}}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<!\w)\+\d{8,15}(?!\d)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
#: Numbers in a row, of which some may be a card's, however many; each ends where a card may end.
NUMBER = r"\d++(?:-\d++)*+(?![\w-])(?![\w.%+-]{1,64}+@)"
#: At least 13 digits, with a date or an address that may follow without a blank.
RUN = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){NUMBER}(?: {NUMBER})*+(?:[./]\d{{1,4}}(?!\w)){{0,3}}"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV4, DATE, SSN, PHONE, RUN))
VALID_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
VALID_SSN = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"
#: Between the parts of a candidate, and the most and fewest characters of a valid part.
GAP = "[ ./-]"
MOST, LEAST = 43, 7
#: Symbols of a secret permuted together: a longer one goes block by block.
BLOCK = 256


def _draw(key: str, kind: str, round_: Column, other: Column, at: Column | None = None) -> Column:
    """A number from the key, the kind, the round and the other half: below
    2^56, or below 2^16 for a symbol's place."""
    block = F.lit(0) if at is None else F.floor(at / 16)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), block.cast("string"), other.cast("string")), 256)
    part = F.substring(digest, F.lit(1), F.lit(14)) if at is None else F.substring(digest, (1 + 4 * (at % 16)).cast("int"), F.lit(4))
    return F.conv(part, 16, 10).cast("bigint")


def _chars(s: Column) -> Column:
    """The symbols of a string, an empty array for an empty one."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def permute_text(s: Column, alphabet: str, key: str, kind: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """A permutation of the strings of each length over ``alphabet``."""
    radix, sign = len(alphabet), -1 if undo else 1
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def added(part: Column, other: Column, r: Column) -> Column:
        moved = F.transform(_chars(part), lambda c, i: F.substring(
            F.lit(alphabet), (F.pmod(F.instr(F.lit(alphabet), c) - 1 + sign * _draw(key, kind, r, F.concat_ws("/", F.length(part).cast("string"), other), i), F.lit(radix)) + 1).cast("int"), F.lit(1)))
        return F.array_join(moved, "")

    def step(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(F.when(odd, acc["a"]).otherwise(added(acc["a"], acc["b"], r)).alias("a"),
                        F.when(odd, added(acc["b"], acc["a"], r)).otherwise(acc["b"]).alias("b"))

    turns = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(turns, start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_pair(a: Column, below_a: int, b: Column, below_b: int, key: str, kind: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """A permutation of the pairs (a, b), 0 <= a < below_a, 0 <= b < below_b, as a struct."""
    sign = -1 if undo else 1

    def step(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(F.when(odd, acc["a"]).otherwise(F.pmod(acc["a"] + sign * _draw(key, kind, r, acc["b"]), F.lit(below_a))).alias("a"),
                        F.when(odd, F.pmod(acc["b"] + sign * _draw(key, kind, r, acc["a"]), F.lit(below_b))).otherwise(acc["b"]).alias("b"))

    turns = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(turns, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _only(s: Column, alphabet_class: str) -> Column:
    return F.regexp_replace(s, f"[^{alphabet_class}]", "")


def _refill(frame: Column, *fills: tuple[str, Column]) -> Column:
    """``frame`` with the symbols of each class taken in order from its string."""
    def char(c: Column, i: Column) -> Column:
        out = c
        for alphabet_class, s in fills:
            place = F.length(_only(F.substring(frame, F.lit(1), i + 1), alphabet_class))
            out = F.when(c.rlike(f"[{alphabet_class}]"), F.substring(s, place, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(frame), char), "")


def _scramble(s: Column, key: str, kind: str, undo: bool, lower: str = LOWER) -> Column:
    """Each class of symbols (digits, lower and upper case) permuted for itself."""
    classes = (("0-9", DIGITS), ("a-z", lower), ("A-Z", UPPER))
    return _refill(s, *((c, permute_text(_only(s, c), alphabet, key, kind + c, undo=undo)) for c, alphabet in classes))


def _blockwise(s: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of each block of a string, so that the work grows with its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / BLOCK)), lambda i: f(F.substring(s, (i * BLOCK + 1).cast("int"), F.lit(BLOCK))))
    return F.when(F.length(s) > BLOCK, F.array_join(blocks, "")).otherwise(f(s))


def luhn_digit(payload: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(payload)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 0, F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(payload, i, F.lit(1)).cast("int") + 1)
    ).otherwise(F.substring(payload, i, F.lit(1)).cast("int")))
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97)
                       .otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _is_card(m: Column) -> Column:
    digits = _only(m, "0-9")
    return m.rlike(f"^(?:{CARD})$") & (luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1))


def _card(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    digits = _only(m, "0-9")
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    new = permute_text(payload, DIGITS, key, "card", undo=undo)
    return _is_card(m), _refill(m, ("0-9", F.concat(new, luhn_digit(new))))


def _is_iban(m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    return m.rlike(f"^(?:{IBAN})$") & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)


def _iban(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    plain = F.regexp_replace(m, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    moved = _scramble(account, key, "iban", undo)
    check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(country, check, moved)
    spaced = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(
        F.substring(whole, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), "")
    return _is_iban(m), spaced


def _ipv4(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    o = [F.try_element_at(F.split(m, r"\."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    p = permute_pair(o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536, key, "ipv4", undo=undo)
    return m.rlike(VALID_IPV4), F.concat_ws(".", *((F.floor(p[x] / 256) if high else p[x] % 256).cast("string") for x, high in (("a", 1), ("a", 0), ("b", 1), ("b", 0))))


def _day(m: Column) -> Column:
    iso = (F.when(m.contains("-"), m).when(m.contains("."), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
           .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))))
    return F.date_diff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))


def _is_date(m: Column) -> Column:
    return m.rlike(f"^(?:{DATE})$") & F.coalesce(_day(m).between(0, DATE_A * DATE_B - 1), F.lit(False))


def _date(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    form = F.when(m.contains("-"), F.lit("yyyy-MM-dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).otherwise(F.lit("MM/dd/yyyy"))
    day = _day(m)
    p = permute_pair(F.floor(day / DATE_B), DATE_A, day % DATE_B, DATE_B, key, "date", undo=undo)
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DATE_B + p["b"]).cast("int"))
    text = moved.cast("string")
    y, mo, d = F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)
    return _is_date(m), F.when(form == "yyyy-MM-dd", text).when(form == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))


def _ssn(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    p = permute_pair(area - F.when(area > 666, 2).otherwise(1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "ssn", undo=undo)
    new = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
    return m.rlike(VALID_SSN), F.concat_ws("-", F.lpad(new.cast("string"), 3, "0"), F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"),
                              F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"))


def _phone(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    """National numbers of the form NXX NXX XXXX stay so; of others the last six digits move."""
    digits = _only(m, "0-9")
    last = F.substring(digits, -10, 10)
    before = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0)))
    national = last.rlike(r"^[2-9]\d\d[2-9]\d{6}$")
    p = permute_pair(F.substring(last, 1, 3).cast("int") - 200, 800, F.substring(last, 4, 7).cast("int") - 2_000_000, 8_000_000, key, "phone", undo=undo)
    moved = F.concat(before, F.lpad((p["a"] + 200).cast("string"), 3, "0"), (p["b"] + 2_000_000).cast("string"))
    other = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 6), permute_text(F.substring(digits, -6, 6), DIGITS, key, "phone6", undo=undo))
    return m.rlike(f"^(?:{PHONE})$"), _refill(m, ("0-9", F.when(national, moved).otherwise(other)))


def _email(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    return m.rlike(f"^(?:{EMAIL})$"), F.concat(_scramble(local, key, "email", undo), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str, undo: bool) -> tuple[Column, Column]:
    lead = F.regexp_extract(m, r"^(?:AKIA|[A-Za-z_]+\s{0,2}[=:]\s{0,2}[\"']?)", 0)
    value = F.substring(m, F.length(lead) + 1, F.length(m))
    moved = F.when(value.rlike("^[0-9a-f]+$"), _blockwise(value, lambda v: _scramble(v, key, "hex", undo, LOWER[:6]))).otherwise(_blockwise(value, lambda v: _scramble(v, key, "secret", undo)))
    return m.rlike(f"^(?:{SECRET})$"), F.concat(lead, moved)


KINDS = (("email", _email), ("secret", _secret), ("iban", _iban), ("ipv4", _ipv4), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card))


def _kind(m: Column) -> Column:
    """The first kind of numbers of which ``m`` is valid as a whole, else null."""
    return (F.when(_is_iban(m), "iban").when(m.rlike(VALID_IPV4), "ipv4").when(_is_date(m), "date").when(m.rlike(VALID_SSN), "ssn")
            .when(m.rlike(f"^(?:{PHONE})$"), "phone").when(_is_card(m), "card"))


def _span(tokens: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(tokens, start, end - start + 1), "")


def cut(m: Column) -> Column:
    """A candidate as an array of valid parts and of what stands between them:
    from the left the longest valid part, then on behind it.  A long candidate
    is searched from each of its pieces into the next one."""
    split = lambda x: F.split(x, f"(?<={GAP})|(?={GAP})", -1)

    def piece(pieces: Column, at: Column) -> Column:
        own = F.get(pieces, at)
        before = F.substring(F.coalesce(F.get(pieces, at - 1), F.lit("")), -1, 1)
        skipped = F.aggregate(F.slice(pieces, F.lit(1), at), F.lit(0), lambda n, x: n + F.length(x))
        tokens = split(F.concat(own, F.coalesce(F.get(pieces, at + 1), F.lit(""))))
        return F.flatten(F.transform(F.array(F.struct(tokens.alias("t"), skipped.alias("skipped"))), lambda w: spans(w["t"], F.size(split(own)), before, w["skipped"])))

    def spans(t: Column, n_own: Column, before: Column, skipped: Column) -> Column:
        word = lambda i: ~F.get(t, i - 1).isin("", *GAP[1:-1])
        starts = F.filter(F.sequence(F.lit(1), n_own), word)
        return F.flatten(F.transform(starts, lambda i: F.filter(F.transform(F.filter(F.sequence(F.least(F.size(t), i + MOST), i, F.lit(-1)), word), lambda j: span(t, i, j, before, skipped)), right)))

    def span(t: Column, i: Column, j: Column, before: Column, skipped: Column) -> Column:
        beside = F.concat(F.coalesce(F.get(t, i - 2), before), F.coalesce(F.get(t, j), F.lit("")))
        return F.transform(F.array(_span(t, i, j)), lambda x: F.struct(
            F.when(F.length(x).between(LEAST, MOST) & x.rlike("^[A-Z0-9].*[A-Z0-9]$"), _kind(x)).alias("kind"), beside.alias("beside"), x.alias("text"), i.alias("i"), t.alias("t"), skipped.alias("skipped")))[0]

    def right(x: Column) -> Column:
        return x["kind"].isNotNull() & ~((x["kind"] == "ssn") & x["beside"].contains("-")) & ~((x["kind"] == "ipv4") & x["beside"].contains("."))

    def parts(pieces: Column) -> Column:
        found = F.flatten(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda at: piece(pieces, at)))
        valid = F.transform(found, lambda x: F.struct((x["skipped"] + F.length(_span(x["t"], F.lit(1), x["i"] - 1))).alias("start"), x["text"].alias("text")))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(valid, start, lambda acc, x: F.when(x["start"] >= acc["end"], F.struct((x["start"] + F.length(x["text"])).alias("end"), F.concat(
            acc["out"], F.array(F.substring(m, acc["end"] + 1, x["start"] - acc["end"]), x["text"])).alias("out"))).otherwise(acc),
            lambda acc: F.concat(acc["out"], F.array(F.substring(m, acc["end"] + 1, F.length(m)))))

    again = m.rlike(f"[A-Za-z0-9]{GAP}[A-Za-z0-9]") & ~m.rlike("[@=:]") & _kind(m).isNull()
    pieces = F.regexp_extract_all(m, F.lit(f"(?:[^{GAP[1:-1]}]*+{GAP}){{1,{MOST}}}+|[^{GAP[1:-1]}]++"), F.lit(0))
    return F.when(again, F.transform(F.array(pieces), parts)[0]).otherwise(F.array(m))


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """Kind and replacement of one candidate; a null kind if it is nothing."""
    out = None
    for kind, f in KINDS:
        valid, new = f(m, key, undo)
        both = F.struct(F.lit(kind).alias("kind"), new.alias("new"))
        out = F.when(valid, both) if out is None else out.when(valid, both)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", undo: bool = False, kinds: str | None = None) -> DataFrame:
    """The input with its text replaced under the secret ``key``; ``kinds`` names a column to add: what
    was replaced, in the order of the text."""
    if kinds and free_name(docs, kinds) != kinds:
        raise ValueError(f"the input has a column {kinds} already")
    held = free_name(docs, kinds or "_kinds")
    own = F.col(f"`{text}`")
    some = own.rlike(f"[0-9@]|AKIA|{NAMES}")
    found = F.when(some, F.regexp_extract_all(own, F.lit(ANY), F.lit(0)))
    rows = docs.withColumn(held, F.transform(F.transform(found, cut), lambda parts: F.transform(parts, lambda m: pseudonym(m, key, undo))))
    new = F.concat(F.transform(held, lambda parts: F.array_join(F.transform(parts, lambda x: x["new"]), "")), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(own, ANY, -1), new, lambda p, m: F.concat(p, m)), "")
    names = F.filter(F.transform(F.flatten(held), lambda x: x["kind"]), lambda k: k.isNotNull())
    rows = rows.withColumn(text, F.when(F.size(held) > 0, joined).otherwise(own))
    return rows.withColumn(held, F.coalesce(names, F.array().cast("array<string>"))) if kinds else rows.drop(held)


def redact(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_found and kinds (distinct, sorted, comma-joined) of every row."""
    out = pseudonymize(docs.select(F.col(key), F.col(text)), secret, text, kinds="found")
    return out.select(key, text, F.size("found").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("kinds"))
