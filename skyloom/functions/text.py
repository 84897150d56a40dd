"""Names, identifiers and free text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filter aliases.
FILTERS = {"none": "None", "clear": "None", "ircut": "IRCUT", "uvir": "IRCUT", "ha": "Ha", "halpha": "Ha", "oiii": "OIII", "sii": "SII", "haoiii": "HaOIII", "duo": "HaOIII", "duoband": "HaOIII", "astro": "Astro", "vis": "Astro", "lum": "L", "l": "L", "red": "R", "green": "G", "blue": "B"}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def canonical_instrument(name: Column) -> Column:
    """Upper case, no spaces, ``III`` as ``3``."""
    return F.replace(F.upper(F.replace(name, F.lit(" "), F.lit(""))), F.lit("III"), F.lit("3"))


def canonical_filter(name: Column) -> Column:
    """The alias's name, else the trimmed original; empty is null."""
    key = F.lower(F.regexp_replace(name, r"[\s_\-]+", ""))
    return F.nullif(F.coalesce(F.try_element_at(literal_map(FILTERS), key), F.trim(name)), F.lit(""))


def normalize_target(name: Column) -> Column:
    """Single spaces, without a trailing ``(2)``."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"\s*\(\d+\)\s*$", ""))


def canonical_id(name: Column) -> Column:
    """``NGC0007A`` as ``NGC 7 A``: prefix, number without leading zeros, suffix."""
    part = lambda i: F.regexp_extract(name, r"^([A-Za-z]+)\s*0*(\d+)\s*([A-Za-z]*)$", i)
    return F.when(part(2) != "", F.concat_ws(" ", F.upper(part(1)), part(2), F.nullif(part(3), F.lit("")))).otherwise(name)


#: Prefixes of foreign identifiers that people type.
FOREIGN = ("sh ", "sh2-", "lbn ", "ldn ", "c ", "b ", "mel ", "vdb ", "rcw ", "abell ")


def alias_keys(name: Column) -> Column:
    """Spaced and joined spellings of an identifier, its number as it is, without leading zeros and in four digits, lower-cased."""
    part = lambda i: F.lower(F.regexp_extract(name, r"^([A-Za-z]+)\s*(\d+)\s*([A-Za-z]*)$", i))
    rest = F.when(part(3) != "", F.concat(F.lit(" "), part(3))).otherwise("")
    plain = F.regexp_replace(part(2), r"^0+(?=\d)", "")
    numbers = F.array(part(2), plain, F.lpad(plain, F.greatest(F.lit(4), F.length(plain)), F.lit("0")))
    spelled = F.flatten(F.transform(numbers, lambda n: F.array(F.concat(part(1), F.lit(" "), n, rest), F.concat(part(1), n, F.trim(rest)))))
    own = F.array(F.lower(name), F.replace(F.lower(name), F.lit(" "), F.lit("")))
    return F.array_distinct(F.when(part(2) != "", F.concat(own, spelled)).otherwise(own))


def numbered_aliases(prefix: str, number: Column) -> Column:
    """``PREFIX n`` and ``PREFIXn`` of a cross-identification, with and without leading zeros; none for an empty number."""
    raw = F.trim(F.coalesce(number, F.lit("")))
    both = F.array(raw, F.regexp_replace(raw, r"^0+(?=\d)", ""))
    spelled = F.flatten(F.transform(both, lambda n: F.array(F.concat(F.lit(f"{prefix.lower()} "), n), F.concat(F.lit(prefix.lower()), n))))
    return F.when(raw != "", spelled).otherwise(F.array().cast("array<string>"))


def foreign_aliases(identifiers: Column) -> Column:
    """Spellings of the identifiers of a comma-separated list that begin with one of ``FOREIGN``."""
    tokens = F.transform(F.split(F.lower(F.coalesce(identifiers, F.lit(""))), ","), lambda x: F.trim(x))
    known = F.filter(tokens, lambda x: F.exists(F.array(*map(F.lit, FOREIGN)), lambda p: F.startswith(x, p)))

    def spell(x: Column) -> Column:
        head, number, tail = (F.regexp_extract(x, r"^(\D+?)\s*(\d+)(.*)$", i) for i in (1, 2, 3))
        plain = F.concat(F.regexp_replace(number, r"^0+(?=\d)", ""), tail)
        joined = F.when(F.rlike(head, F.lit("[a-z]$")), F.array(F.concat(head, plain))).otherwise(F.array().cast("array<string>"))
        more = F.when(number != "", F.concat(F.array(F.concat(head, F.lit(" "), plain)), joined)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(x, F.replace(x, F.lit(" "), F.lit(""))), more)

    return F.flatten(F.transform(known, spell))


def lookup_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def matches_search(needle: str, *fields: Column) -> Column:
    """A trimmed, single-spaced needle in a field, or without spaces in it without spaces."""
    q = " ".join(needle.lower().split())
    low = [F.lower(F.regexp_replace(F.coalesce(f, F.lit("")), r"\s+", " ")) for f in fields]
    hit = F.lit(False)
    for f in low:
        hit = hit | f.contains(q) | F.replace(f, F.lit(" "), F.lit("")).contains(q.replace(" ", ""))
    return hit


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_")


def quoted(path: Column) -> Column:
    return F.when(path.rlike(r"[\s\"']"), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(path)


def progress(line: Column) -> Column:
    """The fraction of a progress line: ``12.5%`` or ``3/24``, within 0 and 1; else null."""
    percent = F.regexp_extract(line, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100
    done, total = (F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", i).try_cast("double") for i in (1, 2))
    value = F.coalesce(percent, F.when(total > 0, done / total))
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))  # least and greatest skip nulls


def hours_label(hours: Column) -> Column:
    return F.when(hours < 1, F.concat(F.round(hours * 60).cast("int").cast("string"), F.lit(" min"))).otherwise(F.concat(F.format_number(hours, 1), F.lit(" h")))


def bytes_label(size: Column) -> Column:
    gb = F.lit(1e9)
    return F.when(size >= gb, F.concat(F.format_number(size / gb, 1), F.lit(" GB"))).when(size >= 1e6, F.concat(F.format_number(size / 1e6, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(size / 1e3, 1), F.lit(" kB")))


def first_set(*values: Column) -> Column:
    """The first that is neither null nor zero; the last as it is."""
    return F.coalesce(*(F.nullif(v, F.lit(0).cast("double")) for v in values[:-1]), values[-1])


def parse_overrides(spec: Column) -> Column:
    """``node.param=value,...`` as a map; the values stay text."""
    return F.when(F.trim(spec) != "", F.str_to_map(F.regexp_replace(spec, r"\s*([,=])\s*", "$1"), F.lit(","), F.lit("=")))


def typed(value: Column) -> Column:
    """What kind of value a text holds: null, bool, int, float or text."""
    return (
        F.when(F.lower(value).isin("null", "none", ""), "null").when(F.lower(value).isin("true", "false"), "bool")
        .when(value.try_cast("long").isNotNull() & value.rlike(r"^[+-]?\d+$"), "int").when(value.try_cast("double").isNotNull(), "float").otherwise("text")
    )


def spaced_name(name: Column) -> Column:
    """A catalog name with a blank after its prefix: ``M33`` as ``M 33``."""
    return F.regexp_replace(name, r"^(Sh2-|NGC|IC|M|C|B)(?=[^\sA-Za-z])", "$1 ")


def label_value(value: Column) -> Column:
    """A metric label's value with backslashes, line breaks and quotes escaped."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(plain, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
