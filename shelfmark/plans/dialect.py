"""SQL (DuckDB) forms of the text functions, for the queries' counterparts."""

from __future__ import annotations

from shelfmark.functions.text import FRANCHISE_STOP, GENERIC_FRANCHISE, SINGLE_FRANCHISE, STOP_WORDS


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def blank(x: str) -> str:
    return rf"regexp_matches(coalesce({x}, ''), '^\s*$')"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def number(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$') THEN CAST(trim({x}) AS DOUBLE) END"


def unescape(x: str) -> str:
    """The references that the tables have; &amp; last, so the pass is single."""
    for name, sign in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{sign}')"
    return x


def clean(x: str, markup: bool = True) -> str:
    plain = f"regexp_replace({unescape(x)}, '<[^>]+>', ' ', 'g')" if markup else x
    return rf"lower(trim(regexp_replace(regexp_replace({plain}, '[^A-Za-z0-9\s''-]', ' ', 'g'), '\s+', ' ', 'g')))"


def markup(x: str) -> str:
    plain = rf"regexp_replace({unescape(x)}, '<br\s*/?>', ' ', 'gi')"
    return collapse(f"regexp_replace({plain}, '<[^>]+>', '', 'g')")


def items(x: str) -> str:
    return f"[trim(e) FOR e IN string_split({x}, '|') IF trim(e) <> '']"


def item_set(x: str) -> str:
    return f"list_distinct([lower(trim(e)) FOR e IN string_split({x}, '|') IF trim(e) <> ''])"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[a-z0-9][a-z0-9''-]*')"


def word_tokens(x: str) -> str:
    return f"[w FOR w IN regexp_extract_all({x}, '[a-z0-9_]{{2,}}') IF w NOT IN ({words(STOP_WORDS)})]"


def normal_title(x: str) -> str:
    return collapse(f"regexp_replace(lower({x}), '[''\"\\-!.,]', '', 'g')")


PREFERRED = "coalesce(nullif(title_english, ''), nullif(title_romaji, ''), nullif(title_native, ''), '')"


def franchise(x: str) -> str:
    t = rf"regexp_replace(lower({x}), '\([^)]*\)', ' ', 'g')"
    t = rf"regexp_replace({t}, '\b({'|'.join(FRANCHISE_STOP)})\b', ' ', 'g')"
    t = rf"regexp_replace({t}, '\b[0-9ivx]+\b', ' ', 'g')"
    return f"array_to_string(list_slice([w FOR w IN string_split(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'), ' ') IF length(w) > 2], 1, 4), ' ')"


def useful(key: str) -> str:
    return f"({key} <> '' AND {key} NOT IN ({words(GENERIC_FRANCHISE)}) AND (len(string_split({key}, ' ')) >= 2 OR {key} IN ({words(SINGLE_FRANCHISE)})))"


def shorten(x: str, limit: int) -> str:
    t = collapse(x)
    return f"CASE WHEN length({t}) > {limit} THEN rtrim(substring({t}, 1, {limit - 3})) || '...' ELSE {t} END"
