"""Column functions on text: the same in queries over whole corpora and in small tests."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import helpers

#: Cyrillic letters and what stands for them.
ONE_LETTER = ("абвгдезийклмнопрстуфхыэ", "abvgdeziyklmnoprstufhye")
MANY_LETTERS = {"ё": "yo", "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ь": "", "ю": "yu", "я": "ya"}
#: Top-level domains that are never real, and the pattern of an address.
FALSE_DOMAINS = ["abc", "test", "invalid", "localhost", "example"]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
KEYWORD = "[а-яА-ЯёЁa-zA-Z]{4,}"
#: What counts as white space at the ends of a name.
WHITE = "".join(c for c in map(chr, range(1 << 16)) if c.isspace())


def once(value: Column, use) -> Column:
    """use(value), in which value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """NFKC, lower case, anything but letters, digits, underscores and white space to a space, spaces collapsed; null is ''."""
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(r"^\p{ASCII}*$")
    composed = F.when(plain, text).otherwise(helpers.nfkc(F.when(~plain, text)))  # a Python function is evaluated for every row; plain ones go as nulls
    return strip(F.regexp_replace(F.regexp_replace(F.lower(composed), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def casefold(text: Column) -> Column:
    """Text without differences of case."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(helpers.casefold(F.when(~plain, text)))


def trim_white(text: Column) -> Column:
    """Text without white space at its ends; most texts have only blanks there."""
    cut = F.trim(text)
    clear = lambda c: c.between("!", "~")
    return F.when(clear(F.substring(cut, 1, 1)) & clear(F.substring(cut, -1, 1)), cut).otherwise(F.btrim(cut, F.lit(WHITE)))


def keywords(normalized: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(KEYWORD), 0))


def transliterate(text: Column) -> Column:
    out = F.translate(F.lower(text), *ONE_LETTER)
    for a, b in MANY_LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_filename(text: Column, max_len: int = 50) -> Column:
    """No punctuation, spaces and hyphens to one underscore, at most max_len characters with an ellipsis, lower case."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\p{L}\p{N}_\s\-]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)[\s\-]+", "_"), "_+", "_")
    cut = F.regexp_replace(F.substring(out, 1, max_len), "_+$", "")
    cut = F.when(F.length(cut) > max_len - 3, F.concat(F.substring(cut, 1, max_len - 3), F.lit("..."))).otherwise(cut)
    return F.regexp_replace(F.lower(F.when(F.length(out) > max_len, cut).otherwise(out)), "^_+|_+$", "")


def sanitize_filename(text: Column, replacement: str = "_") -> Column:
    """Characters that file systems refuse become the replacement, runs of it become one, none stays at an end."""
    out = F.regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', replacement)
    if not replacement:
        return F.trim(out)
    mark = "[" + replacement + "]"
    return F.regexp_replace(F.regexp_replace(F.trim(out), mark + "+", replacement), f"^{mark}+|{mark}+$", "")


def emails(text: Column) -> Column:
    """Sorted distinct addresses with a believable top-level domain."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), 0)
    top = lambda e: F.lower(F.regexp_extract(e, r"\.([a-zA-Z]+)$", 1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: ~top(e).isin(FALSE_DOMAINS) & (F.length(top(e)) <= 5))))


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
