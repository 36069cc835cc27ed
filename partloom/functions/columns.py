"""Column jobs: normalizing and reading the texts of supplier data with native expressions.

Null input counts as an empty string unless a function says otherwise. Every function takes and gives columns.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII (U+FF01 to U+FF5E) and the wide space fold to ASCII, by their fixed offset.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "

#: Number formats by brand, used for ranking only.
BRAND_FORMATS = [
    ("Volvo", r"^\d{8}$"), ("Renault Trucks", r"^(50|74)\d{8}$"), ("Scania", r"^\d{7}$"), ("DAF", r"^\d{7}$"), ("Cummins", r"^\d{7}$"),
    ("Mercedes-Benz", r"^[ANQ]\d{10}$"), ("MAN", r"^(81|51)\d{9}$"), ("Iveco", r"^\d{8,9}$"), ("Sinotruk HOWO", r"^(WG|VG|AZ)\d{10}$"),
    ("Shacman", r"^DZ\d{10}$"), ("Weichai", r"^61\d{10}$"), ("Knorr-Bremse", r"^(K\d{6}|II\d{5}[A-Z])$"), ("WABCO", r"^\d{10}$"),
    ("Bosch", r"^0\d{9}$"), ("Sachs", r"^\d{10}$"), ("MANN-FILTER", r"^(W|WK|WDK|C|CU|CF|H|HU|PU)\d{3,}[A-Z0-9]*$"),
    ("Fleetguard", r"^(FF|LF|AF|FS|WF|HF)\d{4,5}$"), ("Donaldson", r"^P\d{6}$"),
]
MIN_NUMBER = 5
HARD_SEPARATORS = r"[,;、|\n\r\t]+"


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: what stands in a branch or a lambda is computed anew wherever it stands."""
    return F.transform(F.array(value), then)[0]


@cache
def compatible() -> tuple[str, str, str, str]:
    """Unicode's compatibility forms, by its own table: those of one character and what they stand for; of those that stand for
    several, a character class and a map as JSON."""
    forms = ((chr(i), unicodedata.normalize("NFKC", chr(i))) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)
    one, many = [], []
    for form, text in forms:
        if form != text:
            (one if len(text) == 1 else many).append((form, text))
    runs = [[form for _, (form, _) in run] for _, run in groupby(enumerate(many), lambda x: ord(x[1][0]) - x[0])]
    code = lambda form: f"\\x{{{ord(form):x}}}"
    return "".join(f for f, _ in one), "".join(t for _, t in one), "[" + "".join(f"{code(r[0])}-{code(r[-1])}" for r in runs) + "]", json.dumps(dict(many))


def compat(c: Column) -> Column:
    """A text in its compatible form: ligatures, circled, half-width and full-width characters, powers and units as plain ones; null gives ''.

    ASCII texts pass as they are. Each character folds alone: a letter before a combining mark stays two characters.
    """
    one, to, several, table = compatible()
    t = text_of(c)
    plain = F.translate(t, one, to)
    each = F.transform(F.split(plain, ""), lambda ch: F.coalesce(F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), ch), ch))
    return F.when(t.rlike(r"^\p{ASCII}*$"), t).when(plain.rlike(several), F.array_join(each, "")).otherwise(plain)


def full_norm(c: Column) -> Column:
    """C1 of any text: number_norm of its compatible form."""
    return number_norm(compat(c))


def fold_width(c: Column) -> Column:
    """Compatibility folding of full-width characters, the only ones that supplier numbers use."""
    return F.translate(text_of(c), FULL_WIDTH, HALF_WIDTH)


def number_norm(c: Column) -> Column:
    """Half width, letters and digits only, upper case; leading zeros stay; null gives ''."""
    return F.upper(F.regexp_replace(fold_width(c), "[^0-9A-Za-z]", ""))


def split_numbers(c: Column) -> Column:
    """The numbers of a cell, in their original form, repeats by norm dropped.

    A slash divides only where every side is long enough to be a number.
    """
    return split_plain(compat(c))


def split_plain(c: Column) -> Column:
    """C2 of a text that is in its compatible form already."""
    chunks = F.split(c, HARD_SEPARATORS)
    sides = lambda x: F.split(x, "/")
    full = lambda x: F.forall(sides(x), lambda p: F.length(number_norm(p)) >= MIN_NUMBER)
    pieces = F.flatten(F.transform(chunks, lambda x: F.when(F.contains(x, F.lit("/")) & full(x), sides(x)).otherwise(F.array(x))))
    pairs = F.filter(F.transform(pieces, lambda p: F.struct(F.trim(p).alias("piece"), number_norm(p).alias("norm"))), lambda x: x["norm"] != "")
    first = lambda ps: let(ps["norm"], lambda norms: F.filter(ps, lambda x, i: F.array_position(norms, x["norm"]) == i + 1))
    return let(pairs, first)["piece"]


def query_prefix(c: Column) -> Column:
    """The kind that an explicit sku:, oe: or name: prefix asks for, or null."""
    head = F.lower(F.regexp_extract(F.trim(fold_width(c)), r"^\s*(?i)(sku|oe|name)\s*:", 1))
    return F.when(head == "sku", "sku").when(head == "oe", "number").when(head == "name", "text")


def query_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(fold_width(c)), r"^(?i)(sku|oe|name)\s*:", ""))


def query_kind(c: Column, sku_prefix: str) -> Column:
    """Sku, number or text; a text without a digit is text even with the company's prefix."""
    return kind_of(query_prefix(c), number_norm(query_text(c)), sku_prefix)


def kind_of(prefix: Column, norm: Column, sku_prefix: str) -> Column:
    """C3 from the kind that the prefix asks for (or null) and the norm."""
    own = number_norm(F.lit(sku_prefix))
    letters = F.length(F.regexp_replace(norm, "[^A-Z]", ""))
    guess = (
        F.when(~norm.rlike("[0-9]"), "text")
        .when((own != "") & F.startswith(norm, own), "sku")
        .when((F.length(norm) >= MIN_NUMBER) & (letters * 2 < F.length(norm)), "number")
        .otherwise("text")
    )
    return F.coalesce(prefix, guess)


def brand_hints(c: Column) -> Column:
    """C4: every brand whose number format fits, in the formats' order."""
    return hints_of(number_norm(c))


def hints_of(norm: Column) -> Column:
    """C4 from a number's norm."""
    fits = lambda digit: F.array_compact(F.array(*(F.when(norm.rlike(p), F.lit(b)) for b, p in BRAND_FORMATS if bool(re.match(r"\^(\\d|\d|\(\d)", p)) == digit)))
    return F.when(F.substring(norm, 1, 1).between("0", "9"), fits(True)).otherwise(fits(False))


def brand_key(c: Column) -> Column:
    """What brand spellings are compared by."""
    return F.regexp_replace(F.lower(fold_width(c)), r"[\s\-_.·/&+]+", "")


def header_key(c: Column, numbers: bool = False) -> Column:
    """What column headers are compared by; with numbers, '#' reads as 'no'."""
    folded = F.lower(fold_width(c))
    folded = F.replace(folded, F.lit("#"), F.lit(" no ")) if numbers else folded
    return F.regexp_replace(folded, r"[\s_\-./()（）:：*]+", "")


def decimal_of(c: Column) -> Column:
    """The first number of a text as decimal(18,4); one comma not before three digits is the decimal point."""
    found = F.regexp_extract(text_of(c), r"\d[\d.,]*", 0)
    found = F.regexp_replace(found, "[.,]+$", "")
    lone = lambda x: x.rlike(r"^\d+,\d+$") & ~x.rlike(r"^\d+,\d{3}$")
    plain = let(found, lambda x: F.when(lone(x), F.translate(x, ",", ".")).otherwise(F.regexp_replace(x, ",", "")))
    return let(plain, lambda x: F.when(x.rlike(r"^\d+(\.\d+)?$"), x.try_cast("decimal(18,4)")))


def currency_v1(*cols: Column) -> Column:
    """The currency that the first telling text names; dollars, then yuan, then euros."""
    seen = lambda c: F.when(F.lower(text_of(c)).rlike(r"usd|\$|美元|美金"), "USD").when(F.lower(text_of(c)).rlike("cny|rmb|¥|￥|元|人民币"), "CNY").when(F.lower(text_of(c)).rlike("eur|€|欧元"), "EUR")
    return F.coalesce(*map(seen, cols))


def currency(currency_cell: Column, price_cell: Column) -> Column:
    """(currency, warning). A bare dollar sign counts in the currency column only; nothing is assumed."""
    cell, price = F.upper(F.trim(text_of(currency_cell))), F.upper(text_of(price_cell))
    word = lambda x: F.when(x.rlike(r"USD|US\$|美元|美金"), "USD").when(x.rlike("CNY|RMB|人民币"), "CNY").when(x.rlike("EUR|€|欧元"), "EUR").when(x.rlike("GBP|£|英镑"), "GBP")
    code = F.when(cell.rlike("^[A-Z]{3}$"), F.when(cell == "RMB", "CNY").otherwise(cell))
    found = F.coalesce(code, word(cell), F.when(cell == "$", "USD"), word(price))
    warning = F.when(cell == "$", "bare dollar sign read as USD").when(found.isNull() & (cell != ""), "currency not recognized")
    return F.struct(found.alias("currency"), warning.alias("warning"))


#: Spellings of currencies, codes that count inside a price, and the currencies that a symbol may stand for.
CURRENCY_WORDS = {"US$": "USD", "RMB": "CNY", "YUAN": "CNY", "EURO": "EUR", "EUROS": "EUR"}
PRICE_CODES = "USD|EUR|GBP|CNY|CAD|JPY|MXN|AUD"
FORMAT_CODES = "USD|EUR|GBP|CNY|CAD|JPY"
SYMBOLS = {"$": ["USD", "CAD", "AUD", "MXN", "NZD", "HKD", "SGD"], "€": ["EUR"], "£": ["GBP"], "¥": ["CNY", "JPY"]}


def currency_code(c: Column, loose: bool = False) -> Column:
    """The code that a text states: a word, three letters, or the one symbol that means one currency; loose: also within a text."""
    t = F.upper(F.trim(fold_width(c)))
    t = F.translate(t, "￥￡", "¥£")
    found = [F.when(t == w, F.lit(code)) for w, code in CURRENCY_WORDS.items()] + [F.when(t.rlike("^[A-Z]{3}$"), t)]
    if loose:
        found += [F.when(F.contains(t, F.lit(w)), F.lit(code)) for w, code in CURRENCY_WORDS.items()]
        found.append(F.nullif(F.regexp_extract(t, rf"(?U)\b({PRICE_CODES})\b", 1), F.lit("")))
    seen = F.array_distinct(F.regexp_extract_all(t, F.lit("([$€£¥])"), F.lit(1)))
    found += [F.when((F.size(seen) == 1) & (seen[0] == s), F.lit(codes[0])) for s, codes in SYMBOLS.items() if len(codes) == 1]
    return F.coalesce(*found)


def format_currency(c: Column) -> Column:
    """The symbol (else the code) that a cell's number format shows, or null."""
    t = text_of(c)
    bracket = F.regexp_extract(t, r"\[\$([^\]-]+)", 1)
    shown = F.when(bracket != "", bracket).otherwise(t)
    return F.coalesce(*(F.when(F.contains(shown, F.lit(s)), F.lit(s)) for s in ("€", "£", "¥", "$")), F.nullif(F.regexp_extract(F.upper(shown), rf"(?U)\b({FORMAT_CODES})\b", 1), F.lit("")))


def currencies_by_symbol() -> Column:
    return F.create_map(*(x for s, codes in SYMBOLS.items() for x in (F.lit(s), F.array(*map(F.lit, codes)))))


def lead_days(c: Column) -> Column:
    """C11: the largest number, times 7 for weeks or 30 for months."""
    low = F.lower(text_of(c))
    most = F.array_max(F.transform(F.regexp_extract_all(low, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")))
    return (most * F.when(low.rlike("week|wk|周"), 7).when(low.rlike("month|月"), 30).otherwise(1)).cast("int")


def packing(c: Column) -> Column:
    """(l_cm, w_cm, h_cm, weight_kg, pcs); pieces are read only without dimensions."""
    low = F.lower(text_of(c))
    n = r"(\d+(?:\.\d+)?)"
    size = n + r"\s*[x×*]\s*" + n + r"\s*[x×*]\s*" + n
    got = lambda pattern, i=1: F.nullif(F.regexp_extract(low, pattern, i), F.lit(""))  # noqa: E731  a cast of '' would throw, and cost
    side = lambda i: got(size, i).try_cast("double") / F.when(low.rlike(size + r"\s*mm"), 10.0).otherwise(1.0)
    kilos = F.coalesce(got(n + r"\s*kgs?\b").try_cast("double"), got(n + r"\s*g\b").try_cast("double") / 1000)
    count = F.coalesce(got(r"(\d+)\s*(?:pcs?|sets?|pairs?|kits?|个|件|套)").try_cast("int"), got(r"^\s*(\d+)\s*$").try_cast("int"))
    return F.struct(side(1).alias("l_cm"), side(2).alias("w_cm"), side(3).alias("h_cm"), kilos.alias("weight_kg"), F.when(~low.rlike(size), count).alias("pcs"))


def years_v1(c: Column) -> Column:
    """(year_from, year_to) from the first two numbers of two to four digits; two digits to 40 are 20xx."""
    found = F.filter(F.regexp_extract_all(text_of(c), F.lit(r"\d+"), F.lit(0)), lambda x: F.length(x).between(2, 4))
    full = lambda y: F.when(y < 100, y + F.when(y <= 40, 2000).otherwise(1900)).otherwise(y)
    year = lambda x, i: let(F.try_element_at(x, F.lit(i)).cast("int"), full)
    return let(found, lambda x: F.struct(year(x, 1).alias("year_from"), year(x, 2).alias("year_to")))


def dims_cm(c: Column, header: Column) -> Column:
    """(l, w, h) in centimetres as decimal(8,2), half-even; the unit of the cell, else of the header; none gives null."""
    low, head = F.lower(text_of(c)), F.lower(text_of(header))
    n = r"(\d+(?:\.\d+)?)"
    size = n + r"\s*[x×*]\s*" + n + r"\s*[x×*]\s*" + n
    unit = lambda x: F.when(x.rlike(r"mm\b|毫米"), "0.1").when(x.rlike(r"cm\b|厘米"), "1").when(x.rlike(r"\bin(ch)?\b|英寸"), "2.54").when(x.rlike(r"\bm\b|米"), "100")
    factor = F.coalesce(unit(low), unit(head)).cast("decimal(8,2)")
    side = lambda i: F.bround(F.regexp_extract(low, size, i).try_cast("decimal(12,4)") * factor, 2).cast("decimal(8,2)")
    return F.struct(side(1).alias("l"), side(2).alias("w"), side(3).alias("h"))


def moq(c: Column) -> Column:
    """C17: a whole number, else null."""
    return let(decimal_of(c), lambda value: F.when(value == F.floor(value), value.cast("int")))


def quote_date(c: Column) -> Column:
    """Nine written forms; day and month are told apart only where one exceeds 12."""
    t = F.trim(text_of(c))
    # A form is tried only where its own sign stands: a try that fails throws inside, which costs more than all else.
    signs = {"yyyy-M-d": "-", "yyyy/M/d": "/", "yyyy.M.d": ".", "MMM d, yyyy": ",", "d MMM yyyy": " ", "MMMM d, yyyy": ",", "d MMMM yyyy": " ", "yyyyMMdd": "", "yyyy年M月d日": "年"}
    there = lambda sign: F.contains(t, F.lit(sign)) if sign else t.rlike(r"^[+-]?\d+$")
    forms = F.coalesce(*(F.when(there(sign), F.try_to_timestamp(t, F.lit(f))) for f, sign in signs.items())).cast("date")
    a, b, y = (F.nullif(F.regexp_extract(t, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", i), F.lit("")).try_cast("int") for i in (1, 2, 3))
    made = F.when((a > 12) & (b <= 12), F.try_to_timestamp(F.concat_ws("-", y, F.lpad(b.cast("string"), 2, "0"), F.lpad(a.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))).when(
        (b > 12) & (a <= 12), F.try_to_timestamp(F.concat_ws("-", y, F.lpad(a.cast("string"), 2, "0"), F.lpad(b.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))
    )
    return F.coalesce(forms, made.cast("date"))


def split_script(c: Column) -> Column:
    """(zh, en) of a name that holds both Han and Latin letters; else the whole on its own side."""
    t = text_of(c)
    both = t.rlike(r"\p{IsHan}") & t.rlike("[A-Za-z]")
    zh = F.array_join(F.regexp_extract_all(t, F.lit(r"\p{IsHan}+"), F.lit(0)), "")
    en = F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{IsHan}+", " "), r"\s+", " "))
    return F.struct(F.when(both, zh).when(t.rlike(r"\p{IsHan}"), t).otherwise("").alias("zh"), F.when(both, en).when(~t.rlike(r"\p{IsHan}"), t).otherwise("").alias("en"))


def is_scientific(c: Column) -> Column:
    """A number that a spreadsheet spoiled."""
    return F.trim(text_of(c)).rlike(r"^\d+(\.\d+)?[eE]\+?\d+$")


def query_key(c: Column) -> Column:
    """What searches are grouped by; at most 200 characters."""
    return F.substring(F.regexp_replace(F.lower(query_text(c)), r"[\s\-_./]+", ""), 1, 200)


def plain_key(c: Column) -> Column:
    """How record texts are compared: lower case without white space and hyphens."""
    return F.regexp_replace(F.lower(text_of(c)), r"[\s\-]+", "")
