"""Text, number and hash expressions; each is a Column built from built-in functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space, the no-break space included.
BLANKS = " \t\n\x0b\f\r\u00a0"


def strip(c: str | Column) -> Column:
    """Remove white space, no-break spaces included, from both ends (the built-in trim removes blanks only, and a pattern is slow)."""
    return F.trim(col(c), F.lit(BLANKS))


def single_spaced(c: str | Column) -> Column:
    return F.regexp_replace(strip(c), "[\\s\\u00a0]+", " ")


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def code(c: str | Column) -> Column:
    """A code in its canonical form: stripped, upper case, null where empty."""
    return F.upper(blank_to_null(c))


def zero_pad(c: str | Column, n: int) -> Column:
    """Left-pad with zeros and never cut a longer value."""
    return F.when(F.length(col(c)) < n, F.lpad(col(c), n, "0")).otherwise(col(c))


def digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "")


def number(c: str | Column) -> Column:
    """A double, or null where the text is no number."""
    return strip(col(c).cast("string")).try_cast("double")


def currency(c: str | Column, places: int = 4) -> Column:
    """'$1,234.5' as a decimal."""
    return F.regexp_replace(strip(c), "[$,]", "").try_cast(f"decimal(18,{places})")


def canonical_number(c: str | Column, places: int, half_even: bool = False, is_number: bool = False) -> Column:
    """A number as text with exactly `places` decimals, rounded as a decimal; '' where it is none. is_number: c is no text, so nothing is parsed."""
    exact = (col(c) if is_number else number(c)).try_cast("decimal(38,10)")
    rounded = (F.bround if half_even else F.round)(exact, places)
    return F.coalesce(rounded.cast(f"decimal(38,{places})").cast("string"), F.lit(""))


_PLAIN = {chr(i): unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() for i in range(0xC0, 0x250)}


def ascii_key(c: str | Column) -> Column:
    """A place name as a join key: accents removed, upper case, single spaces, no parentheses."""
    one = [(k, v) for k, v in _PLAIN.items() if len(v) == 1]
    plain = F.translate(col(c), "".join(k for k, _ in one), "".join(v for _, v in one))
    plain = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), [(k, v) for k, v in _PLAIN.items() if len(v) > 1], plain)
    spaced = F.regexp_replace(plain, "[\\s\\u00a0]+", " ")
    return F.regexp_replace(F.upper(F.regexp_replace(F.regexp_replace(spaced, "[^\\x00-\\x7F]", ""), "[()]", "")), "^ +| +$", "")


def county_key(name: str | Column, state_fips: str | Column) -> Column:
    """ascii_key, and without the word for a county in the state that calls them parishes."""
    key = ascii_key(name)
    return F.when(col(state_fips) == "22", F.regexp_replace(key, " PARISH$", "")).otherwise(key)


def split_list(c: str | Column) -> Column:
    """'A / B, C AND D' as an array; hyphens do not separate."""
    parts = F.split(F.regexp_replace(col(c), "(?i)\\s+AND\\s+", ","), "[,/]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def set_logic(c: str | Column) -> Column:
    """'all', 'all_except', 'rest' or 'list': what a county list says."""
    up = F.upper(single_spaced(c))
    return F.when(up.rlike("^ALL COUNTIES$"), "all").when(up.rlike("^ALL COUNTIES EXCEPT (.+)$"), "all_except").when(up.rlike("^REST OF (STATE|[A-Z ]+)$"), "rest").otherwise("list")


def exception_list(c: str | Column) -> Column:
    return split_list(F.regexp_extract(F.upper(single_spaced(c)), "^ALL COUNTIES EXCEPT (.+)$", 1))


def canonical(c: str | Column, kind: str, places: int = 6) -> Column:
    """A value as the text that goes into hashes: '' for null, True/False, ISO dates, fixed decimals."""
    x = col(c)
    if kind in ("double", "float") or kind.startswith("decimal"):
        return canonical_number(x, places, is_number=True)
    if kind == "boolean":
        return F.coalesce(F.when(x, "True").when(~x, "False"), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def joined_hash(parts: list[Column], separator: str = SEPARATOR) -> Column:
    """SHA-256 of the parts joined in order; nulls keep their place as ''."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), separator, ""), 256)


def row_hash(df, columns: list[str], places: dict[str, int] | None = None) -> Column:
    """The content hash of a row over columns in the contract's order."""
    kinds = dict(df.dtypes)
    return joined_hash([canonical(c, kinds[c], (places or {}).get(c, 6)) for c in columns])


def row_id(df, keys: list[str]) -> Column:
    """The hash of a row's natural key."""
    return row_hash(df, keys)


def short_row_hash(df, columns: list[str]) -> Column:
    """The first 16 hex digits of row_hash, as older files carry them."""
    return F.substring(row_hash(df, columns), 1, 16)


def classified(c: str | Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """The first rule of which a word occurs in the text (lower case); the order of rules matters."""
    low = F.lower(col(c))
    out = None
    for words, name in rules:
        hit = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def year_in(c: str | Column) -> Column:
    return F.regexp_extract(col(c), "(20\\d{2})", 1).try_cast("int")


def quarter_in(c: str | Column) -> Column:
    """Quarter 1-4 from 'Q3' in a name, or from a release letter A-D after a year."""
    named = F.regexp_extract(col(c), "[Qq]([1-4])", 1).try_cast("int")
    letter = F.upper(F.regexp_extract(col(c), "\\d{2}([A-Da-d])(?![A-Za-z])", 1))
    return F.coalesce(named, F.when(letter != "", F.ascii(letter) - 64))


def record_id(df, columns: list[str]) -> Column:
    """The first 16 hex digits of the MD5 of a record's columns as JSON, in order of their names; nulls are left out."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(columns)))), 1, 16)


#: Canonical column names and the names that the outside uses for them.
API_NAMES = {"rvu_work": "work_rvu", "rvu_pe_nonfac": "pe_nonfac_rvu", "rvu_pe_fac": "pe_fac_rvu", "rvu_malp": "mp_rvu", "gpci_mp": "malp_gpci", "gpci_work": "work_gpci", "gpci_pe": "pe_gpci"}


def to_api(df, names: dict[str, str] | None = None):
    """A table under outside names; names that it lacks are ignored."""
    return df.withColumnsRenamed(names or API_NAMES)


def from_api(df, names: dict[str, str] | None = None):
    return df.withColumnsRenamed({b: a for a, b in (names or API_NAMES).items()})
