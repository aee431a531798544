"""What a result looks like: title, address, snippet; and signed click tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import urls
from sparkloom.functions.text import STOP_WORDS

SNIPPET_BYTES = 300
_ENTITIES = {ord(c): f"&{name};" for c, name in zip("&<>\"'", "amp lt gt quot #39".split())}
TOKEN_MS, SKEW_MS = 3_600_000, 60_000


def escape_html(text: Column) -> Column:
    """The text with HTML's own characters as entities."""
    for code, entity in _ENTITIES.items():  # the ampersand comes first
        text = F.replace(text, F.lit(chr(code)), F.lit(entity))
    return text


def result_title(chain: Column, url: Column) -> Column:
    """The last heading, else the first, else the address."""
    last, first = F.get(chain, F.size(chain) - 1), F.get(chain, F.lit(0))
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(first, F.lit("")), urls.display_url(url))


def query_terms(query: str | None) -> set[str]:
    """The words of a query that snippets mark, punctuation inside them left out."""
    cleaned = ("".join(c for c in word if c.isalnum() or c == "+") for word in (query or "").split())
    lower = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in cleaned)
    return {w for w in lower if len(w.encode()) >= 2 and w not in STOP_WORDS}


def _escape(text: str) -> str:
    return text.translate(_ENTITIES)


def snippet(text: str | None, terms: set[str]) -> str:
    """The text's first 300 bytes or so, escaped, with the query's words in bold."""
    clean = " ".join((text or "").split())
    raw = clean.encode()
    if len(raw) > SNIPPET_BYTES:
        clean = raw[: SNIPPET_BYTES - 3].decode(errors="ignore") + "..."
    out, word = [], ""
    for c in clean + "\0":
        if c.isalnum() or c == "+":
            word += c
            continue
        if word:
            lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word)
            out.append(f"<b>{_escape(word)}</b>" if lower in terms else _escape(word))
            word = ""
        out.append(_escape(c))
    return "".join(out[:-1])


@F.pandas_udf(T.StringType())
def highlighted(texts: pd.Series, queries: pd.Series) -> pd.Series:
    """:func:`snippet` of each text for its query."""
    return pd.Series([snippet(t, query_terms(q)) for t, q in zip(texts, queries)], dtype=object)


def signature(key: str, query: Column, position: Column, url: Column, at_ms: Column) -> Column:
    """The keyed digest of a click, computed in the JVM."""
    head = F.unhex(F.lit((struct.pack("<Q", len(key.encode())) + key.encode()).hex()))
    body = F.encode(F.concat_ws("|", query, position.cast("string"), url, at_ms.cast("string")), "UTF-8")
    return F.sha2(F.concat(head, body), 256)


def click_token(key: str, query: Column, position: Column, url: Column, at_ms: Column) -> Column:
    """A signed click as URL-safe base64 without padding."""
    payload = F.struct(query.alias("query"), position.cast("long").alias("position"), url.alias("target_url"), at_ms.cast("long").alias("timestamp_ms"))
    signed = F.to_json(F.struct(payload.alias("payload"), signature(key, query, position, url, at_ms).alias("sig")))
    return F.regexp_replace(F.translate(F.base64(F.encode(signed, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def read_token(token: str | None, key: str, now_ms: int) -> dict | None:
    """The click behind a token; None if it is malformed, forged, too old or from the future."""
    try:
        signed = json.loads(base64.urlsafe_b64decode((token or "") + "=" * (-len(token or "") % 4)))
        click = signed["payload"]
        body = f"{click['query']}|{click['position']}|{click['target_url']}|{click['timestamp_ms']}".encode()
        age = now_ms - click["timestamp_ms"]
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None
    want = hashlib.sha256(struct.pack("<Q", len(key.encode())) + key.encode() + body).hexdigest()
    return click if want == signed.get("sig") and -SKEW_MS <= age <= TOKEN_MS else None


def read_tokens(key: str, now_ms: int):
    """A column function: :func:`read_token` of each token."""
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("position", T.LongType()), T.StructField("target_url", T.StringType()), T.StructField("timestamp_ms", T.LongType())])

    @F.pandas_udf(schema)
    def read(tokens: pd.Series) -> pd.DataFrame:
        found = [read_token(t, key, now_ms) or {} for t in tokens]
        return pd.DataFrame({n: pd.Series([c.get(n) for c in found], dtype=object) for n in schema.names})

    return read


def click_id(query: Column, position: Column, url: Column, now_ms: Column) -> Column:
    """The key under which a click is kept."""
    return F.sha2(F.concat(query, position.cast("string"), url, now_ms.cast("string")), 256)


def result_rows(results, panels, key: str, now_ms: int):
    """Results as a page shows them: ``(query_id, rank, query, breadcrumbs, display_url, title, href, snippet, score)``.

    ``results`` has ``query_id, query, rank, source_url, heading_chain, text, score``. All texts are
    escaped. ``panels`` (``query_id, title, summary, description, image_url``) or None adds the
    article's columns, prefixed with ``panel_``.
    """
    url = F.col("source_url")
    token = click_token(key, F.col("query"), F.col("rank"), url, F.lit(now_ms))
    rows = results.select(
        "query_id",
        "rank",
        escape_html(F.col("query")).alias("query"),
        F.transform("heading_chain", escape_html).alias("breadcrumbs"),
        escape_html(urls.display_url(url)).alias("display_url"),
        escape_html(result_title(F.col("heading_chain"), url)).alias("title"),
        F.concat(F.lit("/act?d="), token).alias("href"),
        highlighted("text", "query").alias("snippet"),
        F.format_string("%.4f", F.col("score").cast("double")).alias("score"),
    )
    if panels is None:
        return rows
    shown = panels.select("query_id", *[escape_html(F.col(c)).alias(f"panel_{c}") for c in ("title", "summary", "description", "image_url")])
    return rows.join(shown, "query_id", "left")


def result_page(query: str, rows: list, took_ms: int = 0) -> str:
    """The page of one query, from its :func:`result_rows` in order; without any, a note."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{_escape(query)}</title>", f'<form action="/search"><input name="q" value="{_escape(query)}"></form>']
    parts.append(f"<p>{len(rows)} results ({took_ms / 1000:.2f} seconds)</p><ol>")
    for row in rows:
        crumbs = " &rsaquo; ".join(row["breadcrumbs"] or [])
        parts.append(f'<li><small>{crumbs}</small> <cite>{row["display_url"]}</cite> <a href="{row["href"]}">{row["title"]}</a> <p>{row["snippet"]}</p> {row["score"]}</li>')
    parts.append("</ol>" if rows else "</ol><p>Nothing found; other or fewer words may help.</p>")
    first = rows[0].asDict() if rows else {}
    if first.get("panel_title") is not None:
        image = f'<img src="{first["panel_image_url"]}">' if first["panel_image_url"] else ""
        parts.append(f'<aside><h2>{first["panel_title"]}</h2><i>{first["panel_description"] or ""}</i><p>{first["panel_summary"]}</p>{image}</aside>')
    return "".join(parts)
