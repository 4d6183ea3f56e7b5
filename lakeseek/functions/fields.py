"""Fields of a tender document, as native expressions over its stripped lines.

A finder looks at the lines that follow a label.  Unless it says otherwise all
lines with the label are tried in order and the first hit counts.  All take the
column of lines (an array of strings that some earlier select made; joined() spares
joining them anew for each finder).  A finder is one regular expression that starts with
its label, which the matcher skips to by whole words of bytes: cheaper than Spark's
search and cut, which count characters.  So a text is never read line by line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeseek.functions.dates import parse_date
from lakeseek.functions.text import BID_ID, let

#: Labels as they stand in documents, misspelling included: fixed values.
BID_START, BID_END = "Bid Start Date/Time", "Bid End Date/Time"
MINISTRY, DEPARTMENT, ORGANISATION = "Ministry/State Name", "Department Name", "Organisation Name"
CATEGORY, CATEGORY_STOPS = "Item Category", ("GeMARPTS", "Turnover", "Experience", "Dated", "Bid Number")
QUANTITY, EXPERIENCE, PERFORMANCE = "Total Quantity", "Past Experience Required", "Past Performance"
TURNOVER, OEM_TURNOVER = "Minimum Average Annual Turnover of the bidder", "OEM Average Turnover"
MII, MSE = "MII Purchase Preference", "MSE Purchase Preference"
MII_BAND, MII_SHARE = "Preference to MII sellers availabele upto price within L1+X%", "Maximum Percentage of Bid quantity for MII purchase preference"
MSE_BAND, MSE_SHARE = "Purchase Preference to MSE OEMs available upto price within L1+X%", "Percentage of Bid quantity/amount for MSE"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null without a match. (nullif evaluates the match once, a case expression twice.)"""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def document(lines: Column) -> Column:
    """The stripped lines as one text."""
    return F.array_join(lines, "\n")


def joined(lines: Column) -> Column:
    """The lines as one element: for finders the same, and joined once."""
    return F.array(document(lines))


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def _not_with(words: tuple[str, ...]) -> str:
    """Matches at the start of a line without any of the words."""
    return rf"(?![^\n]*(?:{_any_of(words)}))" if words else ""


def _after(lines: Column, label: str, k: int, hit: str, group: int = 1) -> Column:
    """A group of the hit, a pattern from the start of a line, in the first of the k lines after any line with the label."""
    return found(document(lines), rf"\Q{label}\E[^\n]*+\n(?:[^\n]*+\n){{0,{k - 1}}}?{hit}", group)


def _whole(marked: Column) -> Column:
    """A line found together with the line feed before it; an empty line is an empty text, no line is null."""
    return F.substr(F.nullif(marked, F.lit("")), F.lit(2))


def date_time(lines: Column, label: str) -> Column:
    return _after(lines, label, 3, r"[^\n]*?(\d{2}-\d{2}-\d{4}[^\S\n]+\d{2}:\d{2}:\d{2})")


def _plain(digits: Column) -> Column:
    """Without the commas between digits."""
    return F.replace(digits, F.lit(","), F.lit(""))


def quantity(lines: Column) -> Column:
    return _plain(_after(lines, QUANTITY, 2, r"([\d,]*\d[\d,]*)(?=\n|\z)")).try_cast("long")


def category(lines: Column) -> Column:
    """Of the first label only: the lines up to a stop word, nine at most, joined; empty text if there are none."""
    text = F.when(F.contains(document(lines), F.lit(CATEGORY)), document(lines))
    block = F.regexp_extract(text, rf"\Q{CATEGORY}\E[^\n]*\n((?:{_not_with(CATEGORY_STOPS)}[^\n]*(?:\n|\z)){{0,9}})", 1)
    kept = F.filter(F.split(block, "\n"), lambda x: x != "")
    return F.array_join(kept, " , ")


#: A line's first run of digits, dots and commas that is a number once its commas are gone.
_NUMBER = r"((?:,*\d[\d,]*\.?[\d,]*|,*\.,*\d[\d,]*))(?![\d.,])"


def turnover(lines: Column, label: str) -> Column:
    """struct(value, unit): of each line the first run of digits, dots and commas, if it is a number; Lakh unless said."""
    hit = rf"[^0-9.,\n]*{_NUMBER}(?:[^\S\n]*((?i:Lakh|Crore|Thousand)))?"
    value = _plain(_after(lines, label, 3, hit, 1)).try_cast("double")
    return F.struct(value.alias("value"), F.coalesce(_after(lines, label, 3, hit, 2), F.lit("Lakh")).alias("unit"))


def experience_years(lines: Column) -> Column:
    return _after(lines, EXPERIENCE, 3, r"[^\n]*?(\d+)[^\S\n]*(?i:Year)").try_cast("long")


def past_performance(lines: Column) -> Column:
    return _after(lines, PERFORMANCE, 3, r"[^\n]*?(\d+)[^\S\n]*%").try_cast("long")


def percentage(lines: Column, label: str) -> Column:
    return _after(lines, label, 4, r"[^\n]*?(\d+)").try_cast("long")


def preference(lines: Column, label: str) -> Column:
    """Whether the first line with yes or no in it, of three after the label, has yes; false without one."""
    return F.coalesce(F.contains(F.lower(_after(lines, label, 3, r"([^\n]*(?i:yes|no)[^\n]*)")), F.lit("yes")), F.lit(False))


def _section(lines: Column, label: str, k: int, body: Callable[[Column, Column], Column]) -> Column:
    """body of two columns: whether, in the first section with the label, 'no' follows a Required line among the next four; and the k + 1 lines after the label, each behind a line feed."""
    block = F.regexp_extract(F.coalesce(document(lines), F.lit("")), rf"\Q{label}\E[^\n]*+((?:\n[^\n]*+){{0,{k + 1}}})", 1)
    refusal = r"\A(?:\n[^\n]*+){0,3}\n[^\n]*Required[^\n]*+\n(?i:no)(?:\n|\z)"
    both = let(block, lambda b: F.struct(b.alias("block"), F.coalesce(b.rlike(refusal), F.lit(False)).alias("refused")))
    return let(both, lambda x: body(x["refused"], x["block"]))


def _last(block: Column, k: int, word: str, hit: str, unless: tuple[str, ...] = ()) -> Column:
    """The first group of the hit in the line after the last line with the word, of the first k lines; lines with one of unless don't count."""
    return F.regexp_extract(block, rf"\A(?:\n[^\n]*+){{0,{k - 1}}}\n{_not_with(unless)}[^\n]*\Q{word}\E[^\n]*{hit}", 1)


_DIGITS, _LINE = r"\n[^\n]*?(\d[\d,]*)", r"(\n[^\n]*)"


def emd(lines: Column) -> Column:
    """struct(amount, bank) of the first EMD Detail section; nulls if it isn't required."""

    def read(refused: Column, block: Column) -> Column:
        amount = _plain(_last(block, 9, "EMD Amount", _DIGITS, ("Advisory Bank",))).try_cast("double")
        return F.struct(F.when(~refused, amount).alias("amount"), F.when(~refused, _whole(_last(block, 9, "Advisory Bank", _LINE))).alias("bank"))

    return _section(lines, "EMD Detail", 9, read)


def epbg(lines: Column) -> Column:
    """struct(required, percent, months, bank) of the first ePBG Detail section; required also without one."""

    def read(refused: Column, block: Column) -> Column:
        percent = _plain(_last(block, 11, "ePBG Percentage", rf"\n[^\d.\n]*{_NUMBER}", ("Advisory Bank",))).try_cast("double")
        months = _plain(_last(block, 11, "Duration of ePBG", _DIGITS, ("Advisory Bank", "ePBG Percentage"))).try_cast("long")
        bank = _whole(_last(block, 11, "Advisory Bank", _LINE))
        return F.struct((~refused).alias("required"), *[F.when(~refused, c).alias(n) for c, n in ((percent, "percent"), (months, "months"), (bank, "bank"))])

    return _section(lines, "ePBG Detail", 11, read)


def local_content(text: Column) -> Column:
    """struct(class1, class2) in percent."""
    rule = r"(?i)Minimum\s*(\d+)%\s*and\s*(\d+)%\s*Local\s*Content"
    return F.struct(*[found(text, rule, i).try_cast("long").alias(f"class{i}") for i in (1, 2)])


def after_last(lines: Column, label: str, unless: tuple[str, ...] = ()) -> Column:
    """The line after the last line with the label; lines with a label of unless don't count. Needs the lines themselves, not joined()."""

    def has(line: Column) -> Column:
        out = F.contains(line, F.lit(label))
        for other in unless:
            out = out & ~F.contains(line, F.lit(other))
        return out

    places = F.filter(F.transform(lines, lambda line, i: F.when(has(line), i)), lambda i: i.isNotNull())
    return F.get(lines, F.array_max(places) + 1)


def bid_id(text: Column, path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(found(text, f"({BID_ID})"), F.concat(F.lit("GEM/UNKNOWN/B/"), F.coalesce(found(name, r"(\d+)"), F.lit("0000000"))))


def published_date(text: Column) -> Column:
    return let(found(text, r"(?i)Dated:\s*(\d{2}-\d{2}-\d{4})"), parse_date)


def link(bid: Column, internal_id: Column, path: Column, base: str) -> Column:
    kind = F.when(F.contains(bid, F.lit("/R/")), "showradocumentPdf").otherwise("showbidDocument")
    return F.when(internal_id.isNotNull(), F.concat_ws("/", F.lit(base), kind, internal_id.cast("string"))).otherwise(F.element_at(F.split(path, "/"), -1))
