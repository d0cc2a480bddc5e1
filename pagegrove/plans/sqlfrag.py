"""SQL fragments for the DuckDB oracle (independent re-statements of the
operators in plain SQL).  Regex texts are shared with the Spark side so the
two engines are asked the same question."""

from __future__ import annotations

from pagegrove.functions.text import JS_STRIP, PY_STRIP, PY_WS
from pagegrove.functions.urls import PATH_ENCODE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(PY_STRIP)}, '', 'g')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(JS_STRIP)}, '', 'g')"


def sanitize_text(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(PY_WS + '+')}, ' ', 'g'))"


def sanitize_filename(x: str) -> str:
    a = f"regexp_replace({x}, '^https?://[^/]+', '')"
    b = f"regexp_replace({a}, {q(r'[^\p{L}\p{N}_\-.]')}, '_', 'g')"
    c = f"regexp_replace({b}, '_+', '_', 'g')"
    d = f"substring({c}, 1, 200)"
    e = f"(CASE WHEN suffix({d}, '.md') THEN {d} ELSE {d} || '.md' END)"
    return f"regexp_replace({e}, '^[_.]+|[_.]+$', '', 'g')"


def unescape(x: str) -> str:
    """Entity decoding as the tokenizer does it, for the entities that occur
    in the fixture pages (``&amp;`` decoded last; ``&amp`` without ';' when
    not followed by a letter or digit)."""
    y = f"replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    y = f"regexp_replace({y}, '&amp([^a-zA-Z0-9;]|$)', '&\\1', 'g')"
    return f"replace({y}, '&amp;', '&')"


def element_text(fragment: str) -> str:
    """Strings between tags, each unescaped and stripped, empties dropped,
    joined with no separator."""
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({fragment}, '<[^>]*>'), "
            f"lambda s: {strip(unescape('s'))}), lambda s: s <> ''), '')")


def pct_path(x: str) -> str:
    cls = f"[{PATH_ENCODE}]"
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).', 0), "
            f"lambda ch: CASE WHEN regexp_matches(ch, {q(cls)}) "
            f"THEN regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') ELSE ch END), '')")


def scheme_host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"


def host(url: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"


TITLE_RAW = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
NAV_HTML = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
NAV_LINK_RE = '<a href="([^"]*)">([^<]*)</a>'
