"""Format-preserving pseudonyms for personal numbers, dates and names of accounts, by keyed Feistel networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketmill.functions.once import compute_once
from ticketmill.llm.common import prepare

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
YEAR, MONTH, DAY = r"(?:1[89]|2[01])[0-9]{2}", r"(?:1[0-2]|0?[1-9])", r"(?:[12][0-9]|3[01]|0?[1-9])"
# What is looked for, in this order; every repetition is bounded, so the time is linear.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,128}+(?![A-Za-z0-9])",
    "address": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "date": rf"(?<![0-9/.-])(?:{YEAR}(?:-{MONTH}-{DAY}|/{MONTH}/{DAY}|\.{MONTH}\.{DAY})|{DAY}(?:-{DAY}-|/{DAY}/|\.{DAY}\.){YEAR})(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}+(?![0-9])",
    "account": r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])",
}
PATTERN = "|".join(f"(?:{shape})" for shape in SHAPES.values())
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
# The Gregorian calendar repeats after 400 years of 146,097 = 189 * 773 days.
ERA, DAYS_A, DAYS_B = "1800-01-01", 189, 773


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside a lambda."""
    return F.transform(F.array(value), use)[0]


class Cipher:
    """Permutations of short values under a key; ``inverse`` undoes them."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.sign = F.lit(key), -1 if inverse else 1
        self.rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def _digest(self, tag: Column, number: Column, half: Column, bits: int) -> Column:
        parts = [self.key, tag, number.cast("string"), half.cast("string")]
        return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), bits)

    def _network(self, a: Column, b: Column, tag: Column, turn) -> Column:
        """Even rounds change ``b`` by a keyed function of ``a``, odd rounds ``a`` by one of ``b``."""
        def step(s: Column, n: Column) -> Column:
            even = n % 2 == 0
            return F.struct(
                F.when(even, s["a"]).otherwise(turn(s["a"], "a", tag, n, s["b"])).alias("a"),
                F.when(even, turn(s["b"], "b", tag, n, s["a"])).otherwise(s["b"]).alias("b"),
            )

        rounds = F.array(*[F.lit(n) for n in self.rounds])
        return F.aggregate(rounds, F.struct(a.alias("a"), b.alias("b")), step)

    def numbers(self, a: Column, b: Column, size_a: Column, size_b: Column, tag: Column) -> Column:
        """Permute the pairs (a, b) with a below ``size_a`` and b below ``size_b``."""
        def turn(own: Column, side: str, tag: Column, n: Column, other: Column) -> Column:
            size = size_a if side == "a" else size_b
            value = F.conv(F.substring(self._digest(tag, n, other, 256), 1, 15), 16, 10).cast("bigint")
            return F.pmod(own + F.lit(self.sign) * (value % size), size)

        return self._network(a.cast("bigint"), b.cast("bigint"), tag, turn)

    def digits(self, value: Column, tag: str) -> Column:
        """Permute the digit strings of the length of ``value`` (at most 18)."""
        n = F.length(value)
        half = F.floor(n / 2).cast("int")
        a, b = F.substring(value, F.lit(1), half), F.substring(value, half + 1, n)
        s = self.numbers(
            F.when(half > 0, a).otherwise("0").cast("bigint"), b.cast("bigint"),
            F.pow(F.lit(10), half).cast("bigint"), F.pow(F.lit(10), n - half).cast("bigint"),
            F.concat_ws(":", F.lit(tag), n.cast("string")),
        )
        return let(s, lambda s: F.concat(
            F.when(half > 0, F.lpad(s["a"].cast("string"), half, "0")).otherwise(""), F.lpad(s["b"].cast("string"), n - half, "0")
        ))

    def letters(self, value: Column, alphabets: tuple[str, ...], tag: str) -> Column:
        """Permute the strings of the same length with the same alphabet at each position."""
        def turn(own: Column, side: str, tag: Column, n: Column, other: Column) -> Column:
            def moved(k: Column, stream: Column) -> Column:
                c = F.substring(own, k + 1, F.lit(1))
                by = F.conv(F.substring(stream, (k % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") * self.sign
                out = c
                for alphabet in alphabets:
                    at = F.instr(F.lit(alphabet), c)
                    out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
                return out

            places = F.sequence(F.lit(0), F.length(own) - 1)
            return F.when(F.length(own) == 0, own).otherwise(let(
                self._digest(tag, n, other, 512),
                lambda stream: F.array_join(F.transform(places, lambda k: moved(k, stream)), ""),
            ))

        n = F.length(value)
        half = F.floor(n / 2).cast("int")
        tags = F.concat_ws(":", F.lit(tag), n.cast("string"))
        s = self._network(F.substring(value, F.lit(1), half), F.substring(value, half + 1, n), tags, turn)
        return let(s, lambda s: F.concat(s["a"], s["b"]))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    def one(k: Column) -> Column:
        c = F.substring(value, k, F.lit(1))
        at = F.length(only_digits(F.substring(value, F.lit(1), k)))
        return F.when(c.between("0", "9"), F.substring(digits, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def luhn(body: Column) -> Column:
    """Check digit of a digit string: from the right, every other digit doubled, first that next to the check digit."""
    def add(total: Column, k: Column) -> Column:
        d = F.substring(body, F.length(body) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add), F.lit(10))


def _email(c: Cipher, v: Column) -> Column:
    """All letters and digits before the last dot change within digits, small and capital letters."""
    name = F.regexp_extract(v, r"^(.*)\.[A-Za-z]+$", 1)
    return F.concat(c.letters(name, (DIGITS, LOWER, UPPER), "email"), F.substring(v, F.length(name) + 1, F.length(v)))


def _address(c: Cipher, v: Column) -> Column:
    o = [F.split_part(v, F.lit("."), F.lit(k)).cast("int") for k in (1, 2, 3, 4)]
    s = c.numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("address"))
    return let(s, lambda x: F.concat_ws(
        ".", *[part.cast("string") for half in (x["a"], x["b"]) for part in (F.floor(half / 256), half % 256)]
    ))


def _date(c: Cipher, v: Column) -> Column:
    """Valid dates move within 400 years; the layout stays. Day or month first goes by what is valid, month first if both are."""
    sep = F.regexp_extract(v, "[/.-]", 0)
    parts = [F.regexp_extract(v, r"^([0-9]+)[/.-]([0-9]+)[/.-]([0-9]+)$", k) for k in (1, 2, 3)]
    year_first = F.length(parts[0]) == 4

    def number(text: Column) -> Column:
        return text.cast("int")

    def real(y: Column, m: Column, d: Column) -> Column:
        start = F.make_date(y, F.least(m, F.lit(12)), F.lit(1))
        return (m <= 12) & (d <= F.day(F.last_day(start)))

    month_first = ~year_first & (sep != ".") & real(number(parts[2]), number(parts[0]), number(parts[1]))
    y = number(F.when(year_first, parts[0]).otherwise(parts[2]))
    m_text = F.when(month_first, parts[0]).otherwise(parts[1])
    d_text = F.when(year_first, parts[2]).when(month_first, parts[1]).otherwise(parts[0])
    m, d = number(m_text), number(d_text)
    day = F.date_diff(F.date_add(F.make_date(y, F.least(m, F.lit(12)), F.lit(1)), d - 1), F.lit(ERA).cast("date"))
    s = c.numbers(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), F.lit("date"))

    def shown(x: Column) -> Column:
        new = F.date_add(F.lit(ERA).cast("date"), (x["a"] * DAYS_B + x["b"]).cast("int"))
        year = F.year(new).cast("string")
        month, of = (F.lpad(f(new).cast("string"), F.greatest(F.length(t), F.length(f(new).cast("string"))), "0")
                     for f, t in ((F.month, m_text), (F.day, d_text)))
        return F.when(year_first, F.concat(year, sep, month, sep, of)).when(
            month_first, F.concat(month, sep, of, sep, year)
        ).otherwise(F.concat(of, sep, month, sep, year))

    return F.when(real(y, m, d), let(s, shown)).otherwise(v)


def _phone(c: Cipher, v: Column) -> Column:
    """The last ten digits change (all, if there are fewer); a country code before them stays."""
    def moved(d: Column) -> Column:
        keep = F.greatest(F.length(d) - 10, F.lit(0))
        last = F.substring(d, keep + 1, F.lit(10))
        return F.concat(F.substring(d, F.lit(1), keep), let(last, lambda x: c.digits(x, "phone")))

    return let(let(only_digits(v), moved), lambda new: laid_out(v, new))


def _account(c: Cipher, v: Column) -> Column:
    """The digits before the last change; the last keeps its distance from the check digit, so valid numbers stay valid."""
    def moved(d: Column) -> Column:
        last = F.substring(d, F.length(d), F.lit(1)).cast("int")

        def closed(body: Column) -> Column:
            return let(c.digits(body, "account"), lambda new: F.concat(
                new, F.pmod(luhn(new) + last - luhn(body), F.lit(10)).cast("string")
            ))

        return let(F.substring(d, F.lit(1), F.length(d) - 1), closed)

    return let(let(only_digits(v), moved), lambda new: laid_out(v, new))


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value, by the first shape it has."""
    c = Cipher(key, inverse)
    made = {
        "email": _email, "secret": lambda c, v: c.letters(v, (HEX,), "secret"), "address": _address, "date": _date,
        "social": lambda c, v: let(let(only_digits(v), lambda d: c.digits(d, "social")), lambda new: laid_out(v, new)), "phone": _phone, "account": _account,
    }
    out = value
    for name in reversed(SHAPES):
        out = F.when(value.rlike(f"^(?:{SHAPES[name]})$"), made[name](c, value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", count: str | None = None, inverse: bool = False) -> DataFrame:
    """``docs`` with each e-mail address, secret, IP address, date, social security, phone and account number replaced.

    Equal values get equal pseudonyms in every text, whatever separators they
    are written with; different values of a shape get different ones. Layout,
    lengths and validity (octets, calendar, check digit) stay. ``key`` is the
    secret; ``inverse=True`` with the same key restores what was replaced,
    except that a date whose day and month can be exchanged is read month first.
    ``count`` names a column for the number of values found.

    Only column expressions, row by row: no shuffle. Null text stays null (and
    counts 0), empty text stays empty; repeated rows give repeated rows, an empty
    table gives an empty table, other columns pass unchanged. Values longer than
    the shapes allow, and impossible dates, stay.
    """
    prepare(docs.sparkSession)
    found = "_found"
    while found in docs.columns or found == count:
        found += "_"
    quoted = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    text = F.col(quoted[text_column])
    matched = compute_once(docs, list(quoted.values()), {found: F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))})
    values = F.col(found)
    between = F.split(text, PATTERN, -1)
    tail = F.zip_with(
        F.transform(values, lambda v: pseudonym(v, key, inverse)), F.slice(between, 2, F.size(values)), lambda v, b: F.concat(v, b)
    )
    rewritten = F.when(F.size(values) > 0, F.concat(F.get(between, F.lit(0)), F.array_join(tail, ""))).otherwise(text)
    columns = [rewritten.alias(c) if c == text_column else F.col(q) for c, q in quoted.items()]
    if count:
        columns.append(F.coalesce(F.size(values), F.lit(0)).cast("bigint").alias(count))
    return matched.select(*columns)
