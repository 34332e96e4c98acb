"""Text normalisation and formatting as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_account(name: Column) -> Column:
    """OP-STR-01/02: lower case, what follows the last em or en dash, trimmed."""
    return F.trim(F.element_at(F.split(F.lower(F.coalesce(name, F.lit(""))), "[—–]"), -1))


def parent_department(agency: Column) -> Column:
    """OP-STR-03: the part before the first comma; for an inspector general's office the part after it."""
    before, after = F.trim(F.substring_index(agency, ",", 1)), F.trim(F.regexp_replace(agency, "^[^,]*,", ""))
    return F.when(F.contains(agency, F.lit(",")), F.when(F.lower(before) == "office of inspector general", after).otherwise(before)).otherwise(agency)


def short_title(name: Column) -> Column:
    """OP-STR-04: what stands before the first comma, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(name, ",", 1)))


def comparable(text: Column) -> Column:
    """OP-STR-05: straight quotes, plain dashes, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”—–‒", "''\"\"---"), r"(?U)\s+", " "))


def spaceless(text: Column) -> Column:
    """OP-STR-06: as ``comparable``, without spaces."""
    return F.replace(comparable(text), F.lit(" "), F.lit(""))


def quality(amount_status: Column, match_tier: Column) -> Column:
    """OP-STR-07: strong, moderate, weak or n/a from how amount and text were found."""
    found, many = amount_status == "found", amount_status == "found_multiple"
    return (
        F.when(found & (match_tier == "exact"), "strong")
        .when(found & match_tier.isin("normalized", "spaceless", "no_match"), "moderate")
        .when(many & match_tier.isin("exact", "normalized"), "moderate")
        .when(many & match_tier.isin("no_match", "spaceless"), "weak")
        .when(amount_status == "not_found", "weak")
        .otherwise("n/a")
    )


def dollars_text(value: Column, signed: bool = False) -> Column:
    """OP-STR-08: thousands separators; ``signed`` puts a plus before positive values."""
    plain = F.format_number(value, 0)
    return F.when(value > 0, F.concat(F.lit("+"), plain)).otherwise(plain) if signed else plain


def _tenths(x: Column) -> Column:
    """One decimal, ties to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def dollars_short(value: Column) -> Column:
    """OP-STR-09: $1.2T, $3.4B, $5.6M, or whole dollars."""
    size = F.abs(value)
    return F.when(size >= 10**12, F.concat(F.lit("$"), _tenths(value / 1e12), F.lit("T"))).when(size >= 10**9, F.concat(F.lit("$"), _tenths(value / 1e9), F.lit("B"))).when(size >= 10**6, F.concat(F.lit("$"), _tenths(value / 1e6), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_number(value, 0)))


def bytes_text(n: Column) -> Column:
    """OP-STR-11: B, KB or MB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(_tenths(n / 1024), F.lit(" KB"))).otherwise(F.concat(_tenths(n / 1024**2), F.lit(" MB")))


def _inside(text: Column, at: Column) -> Column:
    """Whether a byte position of a text lies within a character."""
    return F.substring(F.hex(F.encode(text, "UTF-8")), 2 * at.cast("int") + 1, F.lit(2)).between("80", "BF")


def _before(text: Column, at: Column) -> Column:
    """The last place between characters at or before a byte position."""
    return F.when(~_inside(text, at), at).when(~_inside(text, at - 1), at - 1).when(~_inside(text, at - 2), at - 2).otherwise(at - 3)


def _bytes(text: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def truncated(text: Column, most: int) -> Column:
    """OP-STR-10: texts of more than ``most`` bytes cut between characters before that and ended by an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(_bytes(text, F.lit(0), _before(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def shortened(text: Column, most: int) -> Column:
    """OP-STR-10 by characters: at most ``most``, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def preview(text: Column) -> Column:
    """OP-STR-15: the first 80 characters, with dots where there are more."""
    return F.when(F.length(text) > 80, F.concat(F.left(text, F.lit(80)), F.lit("..."))).otherwise(text)


def context(text: Column, position: Column, radius: int = 80) -> Column:
    """OP-STR-12: what lies within ``radius`` bytes of a byte position, of whole characters, on one line."""
    at, size = F.greatest(position - radius, F.lit(0)), F.octet_length(text)
    start = F.when(~_inside(text, at), at).when(~_inside(text, at + 1), at + 1).when(~_inside(text, at + 2), at + 2).otherwise(at + 3)
    end = _before(text, F.least(position + radius, size))
    return F.trim(F.replace(_bytes(text, start, F.greatest(start, end)), F.lit("\n"), F.lit(" ")))


def bill_label(identifier: Column, congress: Column) -> Column:
    """OP-PRJ-14: ``H.R. 1 (118th)``, the bare identifier where the congress isn't known."""
    return F.when(congress.isNotNull(), F.concat(identifier, F.lit(" ("), congress.cast("string"), F.lit("th)"))).otherwise(identifier)


def fas_code(tas: Column) -> Column:
    """OP-STR-18: ``AAA-MMMM`` from an account string whose parts are split by dashes; periods of availability go."""
    cleaned = F.regexp_replace(F.upper(F.trim(tas)), r"\s+", "")
    agency = F.regexp_extract(cleaned, r"^(\d{1,3})-", 1)
    main = F.regexp_extract(cleaned, r"-(\d{1,4})(?:-\d{3})?$", 1)
    return F.when((agency != "") & (main != ""), F.concat(F.lpad(agency, 3, "0"), F.lit("-"), F.lpad(main, 4, "0")))


def no_year(tas: Column) -> Column:
    """Whether an account string marks funds available until spent."""
    return F.contains(F.upper(tas), F.lit("-X-"))


def prefix_expansion(a: Column, b: Column) -> Column:
    """OP-STR-16: same text before the em dash, and one rest is the other's ``department of (the)`` form."""
    head = lambda x: F.substring_index(x, "—", 1)
    rest = lambda x: F.trim(F.regexp_replace(x, "^[^—]*—", ""))
    longer = lambda x, y: F.startswith(rest(x), F.lit("department of ")) & F.endswith(rest(x), rest(y))
    return F.contains(a, F.lit("—")) & F.contains(b, F.lit("—")) & (head(a) == head(b)) & (longer(a, b) | longer(b, a))


def preposition_variant(a: Column, b: Column) -> Column:
    """OP-STR-16: alike but for *of* and *for*."""
    even = lambda x: F.replace(x, F.lit(" of "), F.lit(" for "))
    return (a != b) & (even(a) == even(b))


def us_abbreviation(a: Column, b: Column) -> Column:
    """OP-STR-16: alike but for *u.s.* and *united states*."""
    long = lambda x: F.replace(F.replace(x, F.lit("u.s. "), F.lit("united states ")), F.lit("u.s."), F.lit("united states"))
    return (a != b) & (long(a) == long(b))


def congress_of(file_name: Column) -> Column:
    """OP-PRJ-13: the number after ``BILLS-``, else null."""
    return F.regexp_extract(file_name, r"BILLS-(\d+)", 1).try_cast("int")


def xml_context(xml: Column, wanted: Column, before: int = 800, after: int = 400, lines: int = 8) -> Column:
    """OP-STR-13: what stands around the first place of ``wanted`` in marked-up text: headers marked, tags removed, the
    last ``lines`` lines that aren't blank; null where it isn't found."""
    at = F.call_function("instr", xml, wanted)
    start = F.greatest(at - before, F.lit(1))
    cut = F.substring(xml, start, at + after - start)
    marked = F.regexp_replace(F.regexp_replace(cut, r"<header[^>]*>", "\n## "), r"</header>", "\n")
    bare = F.regexp_replace(F.regexp_replace(marked, r"^[^<>]*>|<[^<>]*$", ""), r"<[^>]*>", " ")
    kept = F.filter(F.transform(F.split(bare, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return F.when(at > 0, F.array_join(F.slice(kept, F.greatest(F.size(kept) - lines + 1, F.lit(1)), lines), "\n"))
