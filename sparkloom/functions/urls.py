"""URLs: one canonical form, then admission, priority and caps as plain columns over it.

Only :func:`canonicalize` needs Python (in Arrow batches); a canonical URL is regular enough
that host, path and query are regular expressions, so the rules stay in generated code.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.rules import hosts, paths

MAX_LENGTH = 2048
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f]")
_SCHEME = re.compile(r"https:[/\\]*", re.I)
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_HOST_PORT = re.compile(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", re.S)
_KEEP = frozenset("!$%&'()*+,-./:;=@[]\\^_|~0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _host(raw: str) -> str | None:
    """The host part in lower case, in ASCII; None if it is not valid."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1])}]" if raw.endswith("]") else None
        except ValueError:
            return None
    if "%" in raw:
        raw = unquote_plus(raw.replace("+", "%2B"))
    try:
        host = (raw if raw.isascii() else raw.encode("idna").decode("ascii")).lower()
    except UnicodeError:
        return None
    if not host or _FORBIDDEN.search(host):
        return None
    last = host.rstrip(".").rsplit(".", 1)[-1]
    if last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last):
        return _ipv4(host.rstrip("."))
    return host


def _ipv4(host: str) -> str | None:
    parts = host.split(".")
    if len(parts) > 4:
        return None
    try:
        numbers = [int(p, 16) if p[:2] == "0x" and len(p) > 2 else 0 if p == "0x" else int(p, 8) if p[0] == "0" and len(p) > 1 else int(p) for p in parts]
    except (ValueError, IndexError):
        return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _path(raw: str) -> str:
    out: list[str] = []
    segments = raw.replace("\\", "/").split("/")[1:] if raw else [""]
    for at, segment in enumerate(segments):
        plain = segment.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
        if plain in (".", ".."):
            if at == len(segments) - 1:
                out.append("")
            continue
        out.append("".join(c if c in _KEEP else "".join(f"%{b:02X}" for b in c.encode()) for c in segment))
    return "/" + "/".join(out)


def _query(raw: str) -> str:
    pairs = []
    for part in raw.split("&"):
        if part:
            name, _, value = part.partition("=")
            pairs.append((unquote_plus(name), unquote_plus(value)))
    pairs.sort(key=lambda p: (p[0].encode(), p[1].encode()))
    form = lambda s: quote_plus(s, safe="*").replace("~", "%7E")
    return "&".join(f"{form(k)}={form(v)}" for k, v in pairs)


def canonical(raw: str | None) -> str | None:
    """The one form of an https URL; None for what is rejected.

    Host in lower case, no credentials, port or fragment; query pairs in order and
    re-encoded; no slashes at the path's end. Hosts need a dot or to be an address.
    """
    if not raw or _CONTROL.search(raw):
        return None
    raw = raw.strip(" ")
    scheme = _SCHEME.match(raw)
    if not scheme:
        return None
    rest, _, _ = raw[scheme.end() :].partition("#")
    rest, asked, query = rest.partition("?")
    authority = re.match(r"[^/\\]*", rest).group()
    place = authority.rpartition("@")[2]
    parts = _HOST_PORT.fullmatch(place)
    if parts is None:
        return None
    named, port = parts.groups()
    if port and (not (port.isascii() and port.isdigit()) or int(port) > 65535):
        return None
    host = _host(named)
    if host is None or host == "localhost" or ("." not in host and not host.startswith("[")):
        return None
    path = _path(rest[len(authority) :]).rstrip("/") or "/"
    query = _query(query) if asked else ""
    out = f"https://{host}{path}" + (f"?{query}" if query else "")
    return out if len(out.encode()) <= MAX_LENGTH else None


@F.pandas_udf(T.StringType())
def canonicalize(urls: pd.Series) -> pd.Series:
    """:func:`canonical` of a column; null where rejected."""
    known = {url: canonical(url) for url in urls.unique()}
    return pd.Series([known[url] for url in urls], dtype=object)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_or_col(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def host(url: Column | str) -> Column:
    """The lower-case host of an absolute URL; null without one."""
    found = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def path(url: Column | str) -> Column:
    """The path of an absolute URL, ``/`` where it has none."""
    found = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column | str) -> Column:
    """What follows the first question mark, without the fragment; empty where there is none."""
    return F.regexp_extract(_c(url), r"^[^?#]*\?([^#]*)", 1)


def host_matches(host_: Column | str, rule: Column | str) -> Column:
    """Whether a host is the rule's host or below it; ``www.`` counts on neither side."""
    h, r = (F.regexp_replace(x, r"^www\.", "") for x in (_c(host_), _lit_or_col(rule)))
    return (h == r) | F.endswith(h, F.concat(F.lit("."), r))


def suffixes(host_: Column | str) -> Column:
    """A host and all domains above it, the longest first: the keys of a rule lookup."""
    parts = F.split(F.regexp_replace(_c(host_), r"^www\.", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def listed(words) -> Column:
    """A constant array of words without spaces."""
    return F.split(F.lit(" ".join(words)), " ")


def table(pairs) -> Column:
    """A constant map of texts without line ends or tabs."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in pairs)), F.lit("\n"), F.lit("\t"))


def _under(host_: Column | str, rules) -> Column:
    plain = sorted({r.removeprefix("www.") for r in rules})
    return F.coalesce(F.arrays_overlap(suffixes(host_), listed(plain)), F.lit(False))


def host_allowed(host_: Column | str) -> Column:
    """Whether pages of the host are admitted: set membership, no join."""
    return _under(host_, hosts.ALLOWED)


def looks_binary(path_: Column | str, extensions: list[str] = paths.BINARY) -> Column:
    """Whether a path ends like a file that is no page."""
    return F.lower(_c(path_)).rlike(r"\.(" + "|".join(map(re.escape, extensions)) + r")$")


def has_locale(path_: Column | str) -> Column:
    """Whether a whole segment of the path is a language's code."""
    return F.lower(_c(path_)).rlike("(^|/)(" + "|".join(paths.LOCALES) + ")(/|$)")


def _params(url: Column | str) -> Column:
    # canonical queries encode what is special, so the raw names are the decoded ones
    return F.transform(F.split(F.lower(query(url)), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))


def rejected_by(url: Column | str) -> Column:
    """The first admission rule that a canonical URL breaks; null if it is admitted.

    Rule names follow the order of the checks, so a reason is stable.
    """
    h, p = host(url), path(url)
    own = F.struct(
        _c(url).alias("u"), h.alias("h"), p.alias("p"), F.lower(p).alias("low"), _params(url).alias("params")
    )
    # the URL is taken apart once; the rules look at the parts
    return F.transform(F.array(own), _first_broken)[0]


def _first_broken(x: Column) -> Column:
    u, h, p, low = x["u"], x["h"], x["p"], x["low"]
    starts = lambda *x: low.rlike("^(" + "|".join(map(re.escape, x)) + ")")
    within = lambda rule: h.rlike(rf"^(www\.)?(.*\.)?{re.escape(rule)}$")
    title = F.regexp_extract(low, "^/wiki/(.*)", 1)
    wiki = h == "en.wikipedia.org"
    rules = [
        ("no_host", h.isNull()),
        ("host", ~host_allowed(h)),
        ("binary", looks_binary(p)),
        (
            "subhost",
            (within("stackoverflow.com") & (h != "stackoverflow.com"))
            | (within("research.google") & (h != "research.google"))
            | (within("arxiv.org") & (h != "arxiv.org"))
            | (within("usenix.org") & (h != "www.usenix.org"))
            | (within("kernel.org") & ~h.isin("docs.kernel.org", "www.kernel.org"))
            | (within("haskell.org") & ~h.rlike("^(downloads|wiki|www)[.]haskell[.]org$")),
        ),
        ("generated", low.rlike(r"/doxygen/|(-members|_source)\.html$")),
        ("localized", low.rlike("^/(" + "|".join(paths.LOCALES) + ")(/|-|$)")),
        ("language", F.lower(u).rlike("|".join(map(re.escape, paths.LANGUAGE_MARKS)))),
        ("locale", has_locale(p)),
        ("wiki_path", wiki & (~p.startswith("/wiki/") | p.rlike("^/wiki/(Special|Talk):"))),
        ("wiki_title", wiki & (title.rlike("^[0-9]|:|" + "|".join(paths.WIKI_OFF_TOPIC)) | ~title.rlike("|".join(paths.WIKI_TOPICS)))),
        ("stackoverflow", (h == "stackoverflow.com") & ~p.rlike("^/(questions|tags|q/|a/)")),
        (
            "cppreference",
            within("cppreference.com") & (~h.isin("en.cppreference.com", "cppreference.com") | ~starts("/w/c/", "/w/cpp/")),
        ),
        (
            "aws",
            within("aws.amazon.com")
            & (h != "docs.aws.amazon.com")
            & ~(h.isin("www.aws.amazon.com", "aws.amazon.com") & starts("/blogs/")),
        ),
        (
            "databricks",
            within("databricks.com")
            & (h != "docs.databricks.com")
            & ~(h.isin("www.databricks.com", "databricks.com") & starts("/blog")),
        ),
        (
            "medium",
            within("medium.com")
            & ((h != "medium.com") | starts(*["/" + x for x in paths.MEDIUM_PAGES]) | low.rlike("/follow(ers|ing)$")),
        ),
        (
            "ghc_docs",
            (h == "downloads.haskell.org") & (~low.rlike("^/~?ghc/latest/") | low.contains("/src/") | low.contains("doc-index")),
        ),
        ("gcc_archive", (h == "gcc.gnu.org") & starts("/bugzilla/", "/legacy-ml/")),
        (
            "params",
            F.exists(x["params"], lambda k: k.isin(paths.BLOCKED_PARAMS) | k.startswith("utm_")),
        ),
    ]
    out = F.lit(None).cast("string")
    for name, breaks in reversed(rules):
        out = F.when(breaks, F.lit(name)).otherwise(out)
    return out


def priority(url: Column | str, depth: Column | str) -> Column:
    """The crawl priority of a canonical URL at a depth."""
    low = F.lower(path(url))
    high = low.rlike("/(" + "|".join(paths.HIGH_SIGNAL) + ")/")
    poor = low.rlike("/(" + "|".join(map(re.escape, paths.LOW_SIGNAL)) + ")")
    score = F.lit(100) - _c(depth).cast("int") * 10
    for when, points in ((high, 50), (poor, -70), (query(url) != "", -20), (_under(host(url), paths.TOP_HOSTS), 30)):
        score = score + F.when(when, points).otherwise(0)
    return score.cast("int")


def page_cap(host_: Column | str) -> Column:
    """How many pages of a host are kept."""
    h = _c(host_)
    exact, below = table(sorted(hosts.CAPS.items())), table(sorted(hosts.SUFFIX_CAPS.items()))
    nearest = F.element_at(F.filter(F.transform(suffixes(h), lambda s: below[s]), lambda c: c.isNotNull()), 1)
    return F.coalesce(exact[h].cast("int"), F.when(_under(h, hosts.SUFFIX_CAPS), nearest.cast("int")), F.lit(hosts.DEFAULT_CAP))


def rate_limit_ms(host_: Column | str, default_ms: int = 100) -> Column:
    """Milliseconds between two fetches of a host."""
    return F.when(host_matches(host_, "wikipedia.org"), max(default_ms, 1200)).otherwise(default_ms)


def discovery_limit(host_: Column | str) -> Column:
    """How many links of a page are followed."""
    return F.when(host_matches(host_, "wikipedia.org"), 60).otherwise(200)


def chunk_limit(host_: Column | str) -> Column:
    """How many chunks of a page a host-aware chunker keeps (the default chunker keeps 220 of any)."""
    small = host_matches(host_, "wikipedia.org") | host_matches(host_, "docs.rs")
    return F.when(small, 120).when(host_matches(host_, "llvm.org"), 140).otherwise(220)


def harvest_worthy(url: Column | str) -> Column:
    """Whether an aggregator's link is of a host that is harvested; rules with ``www.`` match as written."""
    h = host(url)
    known = F.arrays_overlap(suffixes(h), listed(sorted(hosts.HARVESTED)))
    return F.coalesce(_c(url).rlike("^(?i)https?://") & known & ~looks_binary(path(url), paths.HARVEST_BINARY), F.lit(False))


def url_key(url: Column | str) -> Column:
    """What makes two results the same page: no query or fragment; versions of the Rust docs are one."""
    u = _c(url)
    rust = F.concat(F.lit("doc.rust-lang.org/"), F.regexp_replace(F.regexp_replace(path(u), "^/+", ""), "^(beta|stable|nightly)/", ""))
    return F.when(host(u).isin("docs.rust-lang.org", "doc.rust-lang.org"), rust).otherwise(F.regexp_replace(u, "[?#].*$", ""))


def display_url(url: Column | str) -> Column:
    """Host and path, the path left out if it is the root; the text itself where there is no host."""
    return F.coalesce(F.concat(host(url), F.when(path(url) == "/", "").otherwise(path(url))), _c(url))


def is_web(url: Column | str) -> Column:
    """Whether a link is of http or https at all."""
    return F.coalesce(_c(url).rlike("^(?i)https?://"), F.lit(False))


def robots_rules(text: str | None) -> list[str]:
    """The path prefixes that a robots.txt forbids to every agent."""
    out, everyone = [], False
    for line in (text or "").splitlines():
        key, _, value = (part.strip() for part in line.strip().partition(":"))
        if line.strip().startswith("#"):
            continue
        if key.lower() == "user-agent":
            everyone = value == "*"
        elif key.lower() == "disallow" and everyone and value:
            out.append(value)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_robots(texts: pd.Series) -> pd.Series:
    """:func:`robots_rules` of a column of robots.txt texts."""
    return texts.map(robots_rules)


def robots_allow(path_: Column | str, rules: Column | str) -> Column:
    """Whether no rule is a prefix of the path; hosts without rules (null) allow all."""
    return ~F.coalesce(F.exists(_c(rules), lambda r: (r != "") & _c(path_).startswith(r)), F.lit(False))


def noindex_header(value: Column | str) -> Column:
    """Whether an X-Robots-Tag keeps a page out of the index."""
    return F.coalesce(F.lower(_c(value)).rlike("noindex|none"), F.lit(False))


@F.pandas_udf(T.BooleanType())
def is_private(addresses: pd.Series) -> pd.Series:
    """Whether an address is one that must not be fetched: private, loopback or link-local."""
    return pd.Series([None if a is None else _private(a) for a in addresses], dtype=object)


_PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::/127", "fe80::/10", "fc00::/7")]


def _private(address: str) -> bool | None:
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return None
    return any(ip in net for net in _PRIVATE if net.version == ip.version)
