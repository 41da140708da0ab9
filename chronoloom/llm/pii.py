"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, dates, social security,
telephone and card numbers.  Each find is validated (octets, calendar, number
ranges, Luhn digit) and then permuted within its own format: its value is split
in two halves that in turn have a keyed digest of the other added to them.  That
is a permutation of the format's values, so equal values stay equal, different
ones stay different, and separators keep their place (an octet's length may change).

* card: all digits but the last are permuted, then the Luhn digit is renewed;
* telephone: any ten digits in a written form; those with area and exchange in
  200-999 (NANP) are permuted among themselves, and so are all others;
* IPv4: over all 2**32 addresses; leading zeros of octets are not addresses;
* social security: areas 001-899 without 666, groups 01-99, serials 0001-9999;
* date (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy where only that is a
  date), of the years 0001-9999: over its own century, such as 1901-2000;
* e-mail: letters and digits before the last dot, each within its own kind.

Finds that are not valid stay as they are.  Who has the key can invert all this,
so the key is the caller's to bring and to keep; none is in the code.

Defined cases: a null text stays null with zero counts, an empty one empty; a
text, and an address in it, may have any length, and both are treated whole; rows
are independent, so repeated rows and null ids are treated like any; other
columns are carried along untouched, but for those named like a count; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import packed, whole

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Every run is entered only at its start and never given back, and repeated groups are possessive (Java's matcher
#: then loops where it would call itself), so a run costs time in proportion to its length, and no stack.
PATTERN = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    r"|(?<![\p{L}\p{N}_.])(?:"
    rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.\d)"
    r"|\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}"
    r"|\d{3}-\d\d-\d{4}"
    r"|(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\d(?:[ -]?\d){12,18}"
    r")(?![\p{L}\p{N}_])"
)


def _digest(key: str, tag: str | Column, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")), 256)


def feistel(value: Column, a: Column | int, b: Column | int, key: str, tag: str | Column) -> Column:
    """A keyed permutation of 0 .. a * b - 1; ``value`` outside has no meaning."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def add(to: Column, i: Column, other: Column, size: Column) -> Column:
        number = F.conv(F.substring(_digest(key, tag, i, other), 1, 15), 16, 10).cast("long")
        return (to + number % size) % size

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, add(s["l"], i, s["r"], a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, add(s["r"], i, s["l"], b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _refilled(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substring(x, F.lit(1), i)))
    char = lambda i: F.substring(x, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(char(i).between("0", "9"), F.substring(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def _number(x: Column, start: int | Column, size: int | Column) -> Column:
    start, size = (c if isinstance(c, Column) else F.lit(c) for c in (start, size))
    return F.substring(x, start, size).cast("long")


def _padded(x: Column, width: int | Column) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _card(x: Column, key: str) -> Column:
    digits = _digits(x)
    n = F.length(digits) - 1
    half = n - F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    body = _padded(feistel(_number(digits, 1, n), ten(n - half), ten(half), key, "card"), n)
    check = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string"))))[0]
    return F.when(F.call_function("luhn_check", digits), _refilled(x, F.concat(body, check.cast("string"))))


def _phone(x: Column, key: str) -> Column:
    digits = _digits(x)
    last = F.substring(digits, -10, 10)
    area, exchange, line = _number(last, 1, 3), _number(last, 4, 3), _number(last, 7, 4)

    def moved(rank: Column, half: int, tag: str, pair: Callable[[Column], tuple[Column, Column]]) -> Column:
        new = feistel(rank * 10000 + line, half, half, key, tag)
        a, e = pair(F.floor(new / 10000).cast("long"))
        return F.concat(_padded(a, 3), _padded(e, 3), _padded(new % 10000, 4))

    nanp = moved((area - 200) * 800 + exchange - 200, 80000, "phone", lambda r: (F.floor(r / 800).cast("long") + 200, r % 800 + 200))
    # Areas 000-199 with any exchange come first, then areas 200-999 with exchanges 000-199: 60000 ** 2 numbers.
    rank = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    head = lambda r: F.when(r < 200_000, F.floor(r / 1000)).otherwise(F.floor(r / 200) - 800).cast("long")
    others = moved(rank, 60000, "phone-other", lambda r: (head(r), F.when(r < 200_000, r % 1000).otherwise(r % 200)))
    fresh = F.when((area >= 200) & (exchange >= 200), nanp).otherwise(others)
    return _refilled(x, F.when(F.length(digits) == 11, F.concat(F.lit("1"), fresh)).otherwise(fresh))


def _ip(x: Column, key: str) -> Column:
    parts = F.split(x, r"\.")
    value = sum((parts[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), parts[0].cast("long") * 256**3)
    new = feistel(value, 65536, 65536, key, "ip")
    return F.concat_ws(".", *[(F.shiftright(new, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)])


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = _number(x, 1, 3), _number(x, 5, 2), _number(x, 8, 4)
    place = area - 1 - (area > 666).cast("long")
    new = feistel((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
    head = F.floor(new / 9999).cast("long")
    fresh = F.floor(head / 99).cast("long") + 1
    fresh = fresh + (fresh >= 666).cast("long")
    made = F.concat(_padded(fresh, 3), F.lit("-"), _padded(head % 99 + 1, 2), F.lit("-"), _padded(new % 9999 + 1, 4))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), made)


def _permuted_day(day: Column, key: str) -> Column:
    """The permuted date of its century, or null if ``day`` is null or before the year 1.

    A century has 36524 = 92 * 397 days, with a leap day at its end 36525 = 75 * 487;
    the last one ends with 9999 and has 36159 = 51 * 709.
    """
    century = F.floor((F.year(day) - 1) / 100).cast("int")
    start = F.make_date(century * 100 + 1, F.lit(1), F.lit(1))
    long, last = century % 4 == 3, century == 99
    a = F.when(last, 51).when(long, 75).otherwise(92).cast("long")
    b = F.when(last, 709).when(long, 487).otherwise(397).cast("long")
    new = feistel(F.datediff(day, start).cast("long"), a, b, key, F.concat(F.lit("date"), century.cast("string")))
    return F.when(F.year(day) >= 1, F.date_add(start, new.cast("int")))


def _date(x: Column, key: str) -> Column:
    iso = x.rlike(r"^\d{4}-")
    first, second, year, mark = F.substring(x, 1, 2), F.substring(x, 4, 2), F.substring(x, 7, 4), F.substring(x, 3, 1)
    of = lambda y, m, d: F.concat_ws("-", y, m, d).try_cast("date")
    by_day, by_month = of(year, second, first), of(year, first, second)
    plain = x.try_cast("date")
    form = lambda d, *parts: F.array_join(F.transform(F.array(d), lambda p: F.concat(*[F.date_format(p, c) if c.isalpha() else mark for c in parts])), "")
    made = F.when(iso, F.date_format(_permuted_day(plain, key), "yyyy-MM-dd"))
    made = made.when(by_day.isNotNull(), form(_permuted_day(by_day, key), "dd", "-", "MM", "-", "yyyy"))
    made = made.when(by_month.isNotNull() & (mark == "/"), form(_permuted_day(by_month, key), "MM", "-", "dd", "-", "yyyy"))
    return F.when(F.length(made) == 10, made)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _email(x: Column, key: str) -> Column:
    """Letters and digits before the last dot, moved within a-z, A-Z or 0-9; time grows with the length."""

    def moved(s: Column, i: Column, other: Column) -> Column:
        # A digest moves 32 characters; longer parts have one for every 32.  It is of the other part, or of a long one's digest.
        blocks = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 32).cast("int"))
        short = F.when(F.length(other) > 512, F.sha2(other, 256)).otherwise(other)
        digest = _bound(short, lambda o: F.array_join(F.transform(blocks, lambda n: _digest(key, "email", i, F.concat_ws("|", n.cast("string"), o))), ""))
        pairs = F.slice(F.regexp_extract_all(digest, F.lit("(..)")), F.lit(1), F.length(s))

        def char(letter: Column, pair: Column) -> Column:
            c, by = F.ascii(letter), F.conv(pair, 16, 10).cast("int")
            to = F.when(c.between(97, 122), (c - 97 + by) % 26 + 97).when(c.between(65, 90), (c - 65 + by) % 26 + 65)
            return F.chr(to.when(c.between(48, 57), (c - 48 + by) % 10 + 48).otherwise(c))

        return F.when(F.length(s) > 0, F.array_join(F.zip_with(F.split(s, ""), pairs, char), "")).otherwise("")

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, moved(s["l"], i, s["r"])).otherwise(s["l"])
        right = F.when(i % 2 == 1, moved(s["r"], i, s["l"])).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    tail = F.regexp_extract(x, r"\.[^.]*$", 0)
    head = F.length(x) - F.length(tail)
    half = F.floor(head / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("l"), F.substring(x, half + 1, head - half).alias("r"))
    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"])), tail)


def kind_of(x: Column) -> Column:
    kind = F.when(x.contains("@"), "email").when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
    kind = kind.when(x.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})$"), "date").when(x.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
    return kind.when(x.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]\d{4}$"), "phone").otherwise("card")


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one find; null where it is not valid."""
    kind = kind_of(x)
    makers = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}
    made = F.when(kind == "card", _card(x, key))
    for name, make in makers.items():
        made = made.when(kind == name, make(x, key))
    return made


def _finds(text: Column, key: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), 0)
    made = F.transform(found, lambda x: F.struct(x.alias("was"), kind_of(x).alias("kind"), pseudonym(x, key).alias("now")))
    return F.when(text.rlike("[0-9@]"), made).otherwise(F.array().cast("array<struct<was:string,kind:string,now:string>>"))


def _joined(text: Column, finds: Column) -> Column:
    between = F.split(text, PATTERN, -1)
    put = F.array_join(F.zip_with(between, finds, lambda a, f: F.concat(a, F.coalesce(f["now"], f["was"], F.lit("")))), "")
    return F.when(F.size(finds) > 0, put).otherwise(text)


def pseudonymised(df: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``df`` with the text's finds replaced; with ``counts``, ``n_<kind>`` of the valid finds follow its columns.

    A column of ``df`` that is named like a count is replaced by the count.
    """
    rows = packed(df, text=F.col(text_col), finds=_finds(whole(text_col), key))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), _joined(whole("text"), F.col("finds"))))
    valid = lambda k: F.size(F.filter("finds", lambda f: (f["kind"] == k) & f["now"].isNotNull())).cast("long")
    names = [f"n_{k}" for k in KINDS] if counts else []
    own = [F.col("text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in names]
    return rows.select(*own, *[valid(k[2:]).alias(k) for k in names])
