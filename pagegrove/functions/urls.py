"""URL scalars (U1-U4, L6) as native Column expressions.

* ``url_parts``   Python ``urlparse`` split (scheme, netloc, path, params,
                  query, fragment).
* ``valid_url``   scheme and netloc both non-empty.
* ``resolve_href`` browser-style resolution of an ``href`` against a base
                  URL, with dot-segment removal and percent-encoding.
* ``py_urljoin_abs`` Python ``urljoin(base, absolute_url)`` normalisation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrove.functions.text import _c, let

# RFC 3986 appendix B, with a Python-style scheme (must start with a letter).
URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"

# --- Fixed values -----------------------------------------------------------
# Schemes a browser treats as "special" (hierarchical, backslash = slash).
SPECIAL_SCHEMES = ["ftp", "file", "http", "https", "ws", "wss"]
# Default ports dropped by a browser when serialising.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# Characters a browser percent-encodes (C0 controls, space, listed ASCII,
# everything above U+007E) in the path, query and fragment.
PATH_ENCODE = r"\x00-\x20\"<>`{}\x7f-\x{10ffff}"
QUERY_ENCODE = r"\x00-\x20\"#<>'\x7f-\x{10ffff}"
FRAGMENT_ENCODE = r"\x00-\x20\"<>`\x7f-\x{10ffff}"
# ... in a user name or password, and in URLs without a host.
USERINFO_ENCODE = r"\x00-\x20\"#/:;<=>?@\[\\\]\^`{|}\x7f-\x{10ffff}"
OPAQUE_ENCODE = r"\x00-\x1f\x7f-\x{10ffff}"
OPAQUE_QUERY_ENCODE = r"\x00-\x20\"#<>\x7f-\x{10ffff}"
# Characters that no host name may hold.
HOST_FORBIDDEN = r"\x00-\x20\"#%/:<>?@\[\\\]\^`{|}\x7f"
# Characters that Python's quote() encodes: all but letters, digits, _.-~/
QUOTE_ENCODE = r"\x00-,:-@\[-\^`{-}\x7f-\x{10ffff}"
# ---------------------------------------------------------------------------


def _group(col: Column, i: int) -> Column:
    return F.regexp_extract(col, URL_RE, i)


def _clean(col) -> Column:
    """What urlsplit does first: drop leading C0/space, remove TAB/CR/LF."""
    x = F.regexp_replace(_c(col), r"^[\x00-\x20]+", "")
    return F.regexp_replace(x, r"[\t\r\n]", "")


# Schemes whose paths have parameters.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]


def url_parts(col) -> Column:
    """Python ``urlparse`` as a struct of six strings ('' when absent)."""
    def body(u):
        full_path = _group(u, 3)
        # ';params' are split off the last segment, at its first ';', and only
        # for schemes that have them
        has = lambda fp: fp.rlike(r";[^/]*$") & F.lower(_group(u, 1)).isin(*PARAM_SCHEMES)
        return let(full_path, lambda fp: F.struct(
            F.lower(_group(u, 1)).alias("scheme"), _group(u, 2).alias("netloc"),
            F.when(has(fp), F.regexp_extract(fp, r"(?s)^((?:.*/)?[^/;]*);[^/]*$", 1)).otherwise(fp).alias("path"),
            F.when(has(fp), F.regexp_extract(fp, r"(?s)^(?:.*/)?[^/;]*;([^/]*)$", 1)).otherwise(F.lit("")).alias("params"),
            _group(u, 4).alias("query"), _group(u, 5).alias("fragment")))
    return let(_clean(col), body)


def url_host(col) -> Column:
    """Lower-cased host of an absolute URL (userinfo and port removed)."""
    netloc = _group(_clean(col), 2)
    host = F.regexp_replace(netloc, r"^.*@", "")
    host = F.regexp_replace(host, r":[0-9]*$", "")
    return F.lower(host)


def valid_url(col) -> Column:
    """``urlparse(u).scheme and urlparse(u).netloc`` (False on the
    bracket errors urlparse raises)."""
    u = _clean(col)
    netloc = _group(u, 2)
    brackets_ok = (~netloc.rlike(r"[\[\]]")) | netloc.rlike(r"^([^\[\]]*@)?\[[0-9A-Fa-f:.]+\](:[0-9]*)?$")
    return F.coalesce(u.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]") & brackets_ok, F.lit(False))


def pct_encode(col, chars: str) -> Column:
    """Percent-encode (UTF-8) every character of the class ``[chars]``."""
    return let(_c(col), lambda x: F.when(x.rlike(f"[{chars}]"), _pct_encoded(x, chars)).otherwise(x))


def _pct_encoded(col: Column, chars: str) -> Column:
    toks = F.regexp_extract_all(_c(col), F.lit(f"[{chars}]+|[^{chars}]+"), F.lit(0))
    enc = F.transform(
        toks,
        lambda t: F.when(t.rlike(f"^[{chars}]"),
                         F.regexp_replace(F.hex(F.encode(t, "UTF-8")), "(..)", "%$1")).otherwise(t))
    return F.array_join(enc, "")


def remove_dot_segments(path) -> Column:
    """Drop '.' and '..' segments of an absolute path as a browser does."""
    return let(_c(path), lambda x: F.when(x.rlike(r"(?i)/(\.|%2e)") | ~x.startswith("/"), _without_dots(x)).otherwise(x))


def _without_dots(path: Column) -> Column:
    segs = F.split(path, "/", -1)
    n = F.size(segs)

    def step(acc, i):
        seg = F.lower(F.element_at(segs, i))
        last = i == n
        pop = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (F.when(seg.isin("..", ".%2e", "%2e.", "%2e%2e"),
                       F.when(last, F.concat(pop, F.array(F.lit("")))).otherwise(pop))
                .when(seg.isin(".", "%2e"),
                      F.when(last, F.concat(acc, F.array(F.lit("")))).otherwise(acc))
                .otherwise(F.concat(acc, F.array(F.element_at(segs, i)))))

    kept = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
                       F.array().cast("array<string>"),
                       lambda acc, i: F.when(i <= n, step(acc, i)).otherwise(acc))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _reference(col) -> Column:
    """A reference split into head (scheme, authority and path), query and
    fragment; query and fragment are null where their mark is missing."""
    def body(u):
        return F.struct(F.regexp_extract(u, r"(?s)^([^?#]*)", 1).alias("head"),
                        F.when(u.rlike(r"(?s)^[^#]*\?"), F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)).alias("query"),
                        F.when(u.contains("#"), F.regexp_extract(u, r"(?s)^[^#]*#(.*)$", 1)).alias("fragment"))
    def clean(x):
        trimmed = F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
        return F.when(x.rlike(r"[\x00-\x20]"), F.regexp_replace(trimmed, r"[\t\n\r]", "")).otherwise(x)
    return let(_c(col), lambda x: let(clean(x), body))


def _slashes(col: Column) -> Column:
    """Backslashes of a head are slashes; queries and fragments keep theirs."""
    return F.translate(col, "\\", "/")


def _authority(auth: Column, scheme: Column) -> Column:
    """The serialised authority of a special URL; null where a browser
    rejects it (no host, a bad port, a character that no host may hold).

    User names and passwords keep their case and are percent-encoded, the
    host is decoded and lower-cased, a default or empty port disappears."""
    port_of = F.create_map(*[x for k, v in DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])

    def split(a):
        info = F.regexp_extract(a, r"(?s)^(.*)@", 1)
        hostport = F.regexp_replace(a, r"(?s)^.*@", "")
        bracketed = hostport.startswith("[")
        host = F.when(bracketed, F.regexp_extract(hostport, r"(?s)^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(hostport, r"(?s)^([^:]*)", 1))
        return F.struct(F.regexp_extract(info, r"(?s)^([^:]*)", 1).alias("user"), F.regexp_extract(info, r"(?s)^[^:]*:(.*)$", 1).alias("password"),
                        F.when(bracketed, host).otherwise(py_unquote(host)).alias("host"), hostport.alias("hostport"),
                        F.length(host).alias("n"))

    def parts(p):
        tail = F.substring(p["hostport"], p["n"] + 1, F.length(p["hostport"]))
        digits = F.regexp_replace(F.regexp_extract(tail, r"^:([0-9]*)$", 1), r"^0+(?=[0-9])", "")
        port_ok = (tail == "") | (tail.rlike(r"^:[0-9]*$") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535))
        host_ok = F.when(p["host"].startswith("["), p["host"].rlike(r"^\[[0-9A-Fa-f:.]+\]$")).otherwise(~p["host"].rlike(f"[{HOST_FORBIDDEN}]") & (p["host"] != ""))
        return F.struct(p["user"].alias("user"), p["password"].alias("password"), F.lower(p["host"]).alias("host"), digits.alias("port"), (port_ok & host_ok).alias("ok"))

    def render(p):
        known = F.coalesce(F.element_at(port_of, scheme) == p["port"], F.lit(False))
        password = F.when(p["password"] != "", F.concat(F.lit(":"), pct_encode(p["password"], USERINFO_ENCODE))).otherwise(F.lit(""))
        info = F.when((p["user"] != "") | (p["password"] != ""), F.concat(pct_encode(p["user"], USERINFO_ENCODE), password, F.lit("@"))).otherwise(F.lit(""))
        port = F.when((p["port"] != "") & ~known, F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        return F.when(p["ok"], F.concat(info, p["host"], port))
    return let(auth, lambda a: F.when(a.rlike(r"^[a-z0-9.\-]+$"), a).otherwise(let(split(a), lambda p: let(parts(p), render))))


def resolve_href(base, href) -> Column:
    """U2+U3: the absolute URL a browser reports as ``a.href``.

    The reference is split into head, query and fragment first; each part
    then has its own rules.  Only the head reads backslashes as slashes and
    has dot segments removed; the authority is read by ``_authority``; path,
    query and fragment are percent-encoded with their own sets.  Covers
    absolute, scheme-relative, path-absolute, path-relative, query-only,
    fragment-only and empty references, also after a scheme equal to the
    base's.  References with other schemes keep their opaque part
    (``javascript:``, ``mailto:``).  What a browser cannot resolve is given
    back as written.  IDNA and numeric IPv4 host forms are not applied.
    """
    def scheme_of(head):
        return F.lower(F.regexp_extract(head, _SCHEME_RE, 1))

    def read(v):
        b, h = v["b"], v["h"]
        bscheme, hscheme = scheme_of(b["head"]), scheme_of(h["head"])
        brest = _slashes(F.regexp_replace(b["head"], _SCHEME_RE, ""))
        rest = F.regexp_replace(h["head"], _SCHEME_RE, "")
        special = hscheme.isin(*SPECIAL_SCHEMES)
        return F.struct(
            v["raw"].alias("raw"), bscheme.alias("bscheme"), F.regexp_extract(brest, r"(?s)^/*([^/]*)", 1).alias("bauth"),
            F.regexp_extract(brest, r"(?s)^/*[^/]*(.*)$", 1).alias("bpath"), b["query"].alias("bquery"),
            hscheme.alias("hscheme"), ((hscheme != "") & ~special).alias("opaque"), rest.alias("rest"), _slashes(rest).alias("ref"),
            h["query"].alias("query"), h["fragment"].alias("fragment"),
            # a scheme equal to the base's before anything but two slashes begins a relative reference
            (special & ((hscheme != bscheme) | _slashes(rest).startswith("//"))).alias("absolute"))

    def place(p):
        ref, file = p["ref"], F.when(p["absolute"], p["hscheme"]).otherwise(p["bscheme"]) == "file"
        own_auth = p["absolute"] | ref.startswith("//")
        after = F.when(file, F.regexp_extract(ref, r"(?s)^(?://)?(.*)$", 1)).otherwise(F.regexp_extract(ref, r"(?s)^/*(.*)$", 1))
        merged = F.concat(F.regexp_replace(p["bpath"], r"[^/]*$", ""), ref)
        path = (F.when(own_auth, F.regexp_extract(after, r"(?s)^[^/]*(.*)$", 1)).when(ref.startswith("/"), ref)
                .when(ref == "", p["bpath"]).otherwise(F.when(merged.startswith("/"), merged).otherwise(F.concat(F.lit("/"), merged))))
        return F.struct(
            p.alias("p"), file.alias("file"), F.when(p["absolute"], p["hscheme"]).otherwise(p["bscheme"]).alias("scheme"),
            F.when(own_auth, F.regexp_extract(after, r"(?s)^([^/]*)", 1)).otherwise(p["bauth"]).alias("auth"),
            F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
            F.when(own_auth | (ref != "") | p["query"].isNotNull(), p["query"]).otherwise(p["bquery"]).alias("query"))

    def mark(sign: str, part: Column, chars: str) -> Column:
        return F.when(part.isNotNull(), F.concat(F.lit(sign), pct_encode(part, chars))).otherwise(F.lit(""))

    def render(r):
        p = r["p"]
        fragment = mark("#", p["fragment"], FRAGMENT_ENCODE)
        auth = F.when(r["file"] & (r["auth"] == ""), F.lit("")).otherwise(_authority(r["auth"], r["scheme"]))
        special = F.concat(r["scheme"], F.lit("://"), auth, pct_encode(remove_dot_segments(r["path"]), PATH_ENCODE), mark("?", r["query"], QUERY_ENCODE), fragment)
        opaque = F.concat(p["hscheme"], F.lit(":"), pct_encode(p["rest"], OPAQUE_ENCODE), mark("?", p["query"], OPAQUE_QUERY_ENCODE), fragment)
        return F.when(p["opaque"], opaque).when(r["scheme"] == "", p["raw"]).otherwise(F.coalesce(special, p["raw"]))

    bound = F.struct(_reference(base).alias("b"), _reference(href).alias("h"), _c(href).alias("raw"))
    return F.when(_c(href).isNotNull(), let(bound, lambda v: let(read(v), lambda p: let(place(p), render))))


# ---- the standard library's quoting ----------------------------------------

def py_unquote(col) -> Column:
    """Python ``unquote``: runs of %XX become the UTF-8 text they encode,
    bytes that are no UTF-8 the replacement character."""
    toks = F.regexp_extract_all(_c(col), F.lit(r"(?s)(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    decoded = F.transform(toks, lambda t: F.when(t.rlike(r"^%[0-9A-Fa-f]{2}"), F.make_valid_utf8(F.unhex(F.translate(t, "%", "")).cast("string"))).otherwise(t))
    return F.when(_c(col).contains("%"), F.array_join(decoded, "")).otherwise(_c(col))


def py_quote(col) -> Column:
    """Python ``quote``: everything but letters, digits and ``_.-~/`` is
    percent-encoded."""
    return pct_encode(col, QUOTE_ENCODE)


def py_urlunparse(p: Column, whole: bool = True) -> Column:
    """Python ``urlunparse`` of ``url_parts``; empty parts lose their marks.
    ``whole`` false leaves scheme and netloc out."""
    tail = F.concat(p["path"], *[F.when(p[name] != "", F.concat(F.lit(sign), p[name])).otherwise(F.lit(""))
                                 for sign, name in ((";", "params"), ("?", "query"), ("#", "fragment"))])
    if not whole:
        return tail
    rooted = F.when((p["path"] != "") & ~p["path"].startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)
    with_auth = F.when(p["netloc"] != "", F.concat(F.lit("//"), p["netloc"], rooted)).otherwise(tail)
    return F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit(":"), with_auth)).otherwise(with_auth)


def splits(col) -> Column:
    """Whether Python ``urlparse`` accepts the text: a bracket of an IPv6
    host must have its counterpart."""
    netloc = _group(_clean(col), 2)
    return F.coalesce(netloc.contains("[") == netloc.contains("]"), F.lit(False))


def py_urljoin_abs(base, url) -> Column:
    """Python ``urljoin(base, url)`` for an ``url`` that already carries a
    scheme: re-assembled from its parts when the scheme equals the base's
    (empty query / fragment disappear), returned unchanged otherwise."""
    def body(v):
        p = v["p"]
        rebuilt = F.concat(
            p["scheme"], F.lit("://"), p["netloc"], p["path"],
            F.when(p["params"] != "", F.concat(F.lit(";"), p["params"])).otherwise(F.lit("")),
            F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
            F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise(F.lit("")))
        return F.when((p["scheme"] == v["bscheme"]) & (p["netloc"] != ""), rebuilt).otherwise(v["u"])
    bscheme = F.lower(F.regexp_extract(_clean(base), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return let(F.struct(url_parts(url).alias("p"), bscheme.alias("bscheme"), _c(url).alias("u")), body)


def host_contains(url, needle: str) -> Column:
    """U4: ``hostname.includes(needle)``."""
    return url_host(url).contains(needle)
