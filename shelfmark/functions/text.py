"""Text functions as Columns. "Blank" means empty after stripping Unicode white space; null counts as blank."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
ENTITY = r"&(?:[a-zA-Z]+|#\d+);"

#: Fixed values.
FRANCHISE_STOP = ["season", "part", "movie", "ova", "ona", "special", "final", "the", "episode"]
GENERIC_FRANCHISE = ["love", "ghost", "hero", "king", "queen", "girl", "boys", "dream", "story", "special"]
PLACEHOLDERS = ["no description", "n/a", "none", "tba", "to be announced"]
NA_TOKENS = ["NA", "N/A", "n/a", "NULL", "null", "None", "nan", "NaN"]
#: Words that carry no topic; frozen, so that scores stay comparable.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers him his how if in into is it its itself just me more most my no nor not now of off on once only "
    "or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c) -> Column:
    return F.regexp_replace(text(c), rf"(?U)^{WS}+|{WS}+$", "")


def is_blank(c) -> Column:
    return text(c).rlike(rf"(?U)^{WS}*$")


def collapse(c) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.array_join(F.filter(F.split(text(c), rf"(?U){WS}+", -1), lambda w: w != ""), " ")


def to_num(c) -> Column:
    """A lenient number: null for what doesn't look like one."""
    return F.when(text(c).rlike(NUMBER), F.trim(text(c)).try_cast("double"))


def na_to_blank(c) -> Column:
    return F.when(text(c).isin(NA_TOKENS), "").otherwise(text(c))


_NAMED = {k: v for k, v in html5.items() if k.endswith(";")}
_LEGACY = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def _lookup(pairs: dict) -> Column:
    """A constant map as one folded literal, rather than as an expression for each entry."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


_NAMED_LEGACY = {k: html5[k] for k in _LEGACY}
_WINDOWS = {str(n): html.unescape(f"&#{n};") for n in range(0x80, 0xA0)}


def _character(number: Column) -> Column:
    """The character that a numeric reference stands for; C1 numbers are read as Windows-1252."""
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(bad, "�").when(number.between(0x80, 0x9F), F.try_element_at(_lookup(_WINDOWS), number.cast("string"))).otherwise(plain)


def unescape_html(c, open_ended: bool = True) -> Column:
    """One pass over named and numeric references; what comes out is not read again. HTML knows some without a semicolon, which open_ended allows."""
    named, legacy = _lookup(_NAMED), _lookup(_NAMED_LEGACY)
    end = ";?" if open_ended else ";"

    def chunk(p: Column) -> Column:
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*;)", 1)
        short = F.regexp_extract(p, f"^({'|'.join(_LEGACY)})", 1)
        decimal, hexa = F.regexp_extract(p, f"^#([0-9]{{1,9}}){end}", 1), F.regexp_extract(p, f"^#[xX]([0-9a-fA-F]{{1,8}}){end}", 1)
        rest = lambda pattern: F.regexp_replace(p, pattern, "")
        number = lambda n, base: F.conv(n, base, 10).try_cast("long")
        return (
            F.when(decimal != "", F.concat(_character(number(decimal, 10)), rest(f"^#[0-9]{{1,9}}{end}")))
            .when(hexa != "", F.concat(_character(number(hexa, 16)), rest(f"^#[xX][0-9a-fA-F]{{1,8}}{end}")))
            .when((name != "") & F.try_element_at(named, name).isNotNull(), F.concat(F.try_element_at(named, name), F.substring(p, F.length(name) + 1, F.length(p))))
            .when((short != "") & F.lit(open_ended), F.concat(F.try_element_at(legacy, short), F.substring(p, F.length(short) + 1, F.length(p))))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(text(c), "&", -1)
    done = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(chunk(p)))
    return F.when(text(c).contains("&"), F.array_join(done, "")).otherwise(text(c))


def has_entity(c) -> Column:
    return text(c).rlike(ENTITY)


def strip_markup(c, open_ended: bool = True) -> Column:
    """Unescaped; line breaks as blanks, other tags gone without a trace; white space collapsed."""
    plain = F.regexp_replace(unescape_html(c, open_ended), r"(?i)<br\s*/?>", " ")
    return collapse(F.regexp_replace(plain, r"<[^>]+>", ""))


def clean_text(c, open_ended: bool = True) -> Column:
    """Unescaped, tags as blanks, only A-Z, a-z, 0-9, ' and - left, collapsed, lower case."""
    plain = F.regexp_replace(unescape_html(c, open_ended), r"<[^>]+>", " ")
    # white space and what is dropped both end up as one blank; extracting is much faster than many replacements
    return F.lower(F.array_join(F.regexp_extract_all(plain, F.lit(r"([A-Za-z0-9'-]+)"), F.lit(1)), " "))


def tokens(clean: Column) -> Column:
    return F.regexp_extract_all(clean, F.lit(r"([a-z0-9][a-z0-9'-]*)"), F.lit(1))


def word_tokens(clean: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of two letters or more without stop words; any list may be given."""
    return F.filter(F.regexp_extract_all(clean, F.lit(r"([a-z0-9_]{2,})"), F.lit(1)), lambda w: ~w.isin(list(stop)))


def with_bigrams(words: Column) -> Column:
    return F.concat(words, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def list_items(c) -> Column:
    """The stripped, non-empty parts of a pipe list, in order."""
    return F.filter(F.transform(F.split(text(c), r"\|", -1), lambda x: F.regexp_replace(x, rf"(?U)^{WS}+|{WS}+$", "")), lambda x: x != "")


def list_set(c) -> Column:
    return F.array_distinct(F.transform(list_items(c), lambda x: F.lower(x)))


def list_text(c) -> Column:
    return F.array_join(list_items(c), " ")


def standard_list(c) -> Column:
    return F.array_join(list_items(c), "|")


def join_list(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), "|")


def list_commas(c, limit: int | None = None) -> Column:
    items = list_items(c)
    return F.array_join(F.slice(items, 1, limit) if limit else items, ", ")


def normalize_title(c) -> Column:
    return collapse(F.regexp_replace(F.lower(text(c)), r"""['"\-!.,]""", ""))


def preferred_title(english="title_english", romaji="title_romaji", native="title_native") -> Column:
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in (english, romaji, native)], F.lit(""))


def franchise_key(title: Column) -> Column:
    """Up to four telling words of a title."""
    t = F.regexp_replace(F.lower(title), r"\([^)]*\)", " ")
    t = F.regexp_replace(t, rf"(?U)\b({'|'.join(FRANCHISE_STOP)})\b", " ")
    t = F.regexp_replace(t, r"(?U)\b[0-9ivx]+\b", " ")
    words = F.filter(F.split(F.regexp_replace(t, r"[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)
    return F.array_join(F.slice(words, 1, 4), " ")


#: Single words that are a franchise all the same.
SINGLE_FRANCHISE = ["naruto", "bleach", "overlord", "kingdom", "gintama"]


def useful_franchise(key: Column, single: list[str] = SINGLE_FRANCHISE) -> Column:
    """Not empty or generic, and of two words or on the list of single words that count."""
    return (key != "") & ~key.isin(GENERIC_FRANCHISE) & ((F.size(F.split(key, " ")) >= 2) | (key.isin(list(single)) if single else F.lit(False)))


def truncate_words(c, limit: int) -> Column:
    """Collapsed; if longer than limit, cut with dots after the last non-blank."""
    t = collapse(c)
    return F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def truncate(c, limit: int) -> Column:
    return F.when(F.char_length(text(c)) > limit, F.concat(F.substring(text(c), 1, limit - 3), F.lit("..."))).otherwise(text(c))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    y = F.coalesce(year, F.lit(0)) != 0
    m, d = F.coalesce(month, F.lit(0)) != 0, F.coalesce(day, F.lit(0)) != 0
    return F.when(~y, "").when(m & d, F.format_string("%04d-%02d-%02d", year, month, day)).when(m, F.format_string("%04d-%02d", year, month)).otherwise(year.cast("string"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def label_from_score(score: Column) -> Column:
    return F.when(score >= 7, 2).when(score >= 4, 1).otherwise(0)


def json_object(c) -> Column:
    """The text if it parses, else its longest stretch from { to } if that parses, else null."""
    inner = F.regexp_extract(text(c), r"(?s)\{.*\}", 0)
    whole = F.trim(text(c))
    parses = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(parses(whole), whole).when((inner != "") & parses(inner), inner)
