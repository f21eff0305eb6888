"""Scalar functions over text, paths, addresses and JSON."""

from __future__ import annotations

import ipaddress
import json
import posixpath
import re
from urllib.parse import quote, unquote_to_bytes, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cell_escape(c: Column) -> Column:
    """Text fit for a cell of a Markdown table."""
    c = F.replace(html_escape(c), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\r\n|\n|\r", "<br>")


def title_escape(c: Column) -> Column:
    """Text fit for the label of a Markdown link."""
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


# fixed values: suffixes by media type
MIME_SUFFIX = {
    "text/html": ".html",
    "application/xhtml+xml": ".xhtml",
    "text/plain": ".txt",
    "text/markdown": ".md",
    "application/pdf": ".pdf",
    "application/json": ".json",
    "text/csv": ".csv",
    "application/octet-stream": ".bin",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/tiff": ".tiff",
    "image/webp": ".webp",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
}


def safe_filename(c: Column, media: Column | None = None) -> Column:
    """A file name of letters, digits, dot, underscore and hyphen, 120 at most; named snapshot where nothing is left, with a suffix of the media type where it has none."""
    bare = F.regexp_replace(c, r"[/\\\p{Cc}]", "")
    name = F.substring(F.btrim(F.regexp_replace(bare, r"[^A-Za-z0-9._-]+", "-"), F.lit("-.")), 1, 120)
    name = F.when(name == "", "snapshot").otherwise(name)
    known = F.create_map(*[F.lit(x) for pair in MIME_SUFFIX.items() for x in pair])
    own = F.coalesce(F.try_element_at(known, media), F.lit(".bin")) if media is not None else F.lit(".bin")
    return F.when(name.rlike(r"^.+\.[^.]+$"), name).otherwise(F.concat(name, own))


def media_type(c: Column) -> Column:
    """A media type without parameters, in lower case."""
    return F.lower(F.btrim(F.split_part(c, F.lit(";"), F.lit(1))))


_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, at least the path /.

    Null for anything else than http(s), and for addresses with blanks, control
    characters, credentials, backslashes in the host, or a port or host that is
    none. Names that aren't ASCII and addresses in brackets go through Python,
    all others stay in the JVM.
    """
    parts = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
    clean = ~c.rlike(r"(?U)[\s\p{Cc}]") & c.rlike(parts)
    scheme, netloc = F.lower(F.regexp_extract(c, parts, 1)), F.regexp_extract(c, parts, 2)
    sound = clean & ~netloc.rlike(r"[@\\%]|:$|^$")
    plain = netloc.rlike(r"^[A-Za-z0-9.-]+(:[0-9]+)?$")
    host = F.lower(F.regexp_extract(netloc, r"^([^:]*)", 1))
    host = F.when(plain, F.when(host.rlike(rf"^{_LABEL}(?:\.{_LABEL})*\.*$") & (F.length(host) <= 253), host)).otherwise(_special_host(F.when(sound & ~plain, netloc)))
    digits = F.regexp_extract(netloc, r":([0-9]+)$", 1)
    default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
    port = F.when(digits == "", default).otherwise(digits.try_cast("int"))
    query = F.regexp_extract(c, parts, 4)
    path = F.regexp_extract(c, parts, 3)
    whole = F.concat(scheme, F.lit("://"), host, F.when(port == default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when(sound & host.isNotNull() & port.between(1, 65535), whole)


def _special_host(netloc: Column) -> Column:
    """Host of a netloc with an address in brackets or a name that isn't ASCII."""

    def one(text: str | None) -> str | None:
        try:
            if text is None:
                return None
            name = urlsplit(f"//{text}").hostname or ""
            if ":" in name:
                return f"[{ipaddress.ip_address(name)}]"
            name = name.encode("idna").decode().lower()
            return name if len(name) <= 253 and all(re.fullmatch(_LABEL, x) for x in name.rstrip(".").split(".")) else None
        except ValueError:
            return None

    return F.pandas_udf(lambda texts: texts.map(one), "string")(netloc)


def idna_host(c: Column) -> Column:
    """ASCII form of a host name; null where it has none."""

    @F.pandas_udf("string")
    def encode(hosts: pd.Series) -> pd.Series:
        def one(h: str | None) -> str | None:
            try:
                return None if h is None else h.encode("idna").decode().lower()
            except UnicodeError:
                return None

        return hosts.map(one)

    return encode(c)


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def suffix(c: Column) -> Column:
    """Last extension with its dot in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(file_name(c), r"[^.](\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(file_name(c), r"(?<=[^.])\.[^.]+$", "")


def parent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def is_relative_posix(c: Column) -> Column:
    """No root, no empty, dot or dot-dot parts, no backslash and no control characters."""
    bad = F.exists(F.split(c, "/"), lambda p: p.isin("", ".", ".."))
    return ~(bad | c.contains("\\") | c.rlike(r"\p{Cc}"))


def has_control(c: Column) -> Column:
    return c.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]")


def whole_token(name: str) -> str:
    """Pattern of a literal that no letter, digit or underscore adjoins."""
    return r"(?U)(?<![\p{Alnum}_])\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E(?![\p{Alnum}_])"


def _encoded(target: str, base: str) -> str:
    return "/".join(quote(p, safe="-._~") for p in posixpath.relpath(target, posixpath.dirname(base) or ".").split("/"))


def relative_link(target: Column, base: Column) -> Column:
    """Shortest relative path from the folder of ``base`` to ``target``, percent-encoded."""

    @F.pandas_udf("string")
    def link(targets: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or b is None else _encoded(t, b) for t, b in zip(targets, bases)], dtype=object)

    return link(target, base)


def resolve_link(link: Column, base: Column) -> Column:
    """Path that a relative link leads to; null if it isn't in its one canonical spelling or leaves the tree. Fragments are dropped.

    The canonical spelling is the shortest relative path with upper-case escapes
    of all but unreserved characters; what spells the same path otherwise is refused.
    """
    raw = F.split_part(link, F.lit("#"), F.lit(1))
    # refused before Python is asked: schemes, roots, forbidden characters and escapes, empty and dot parts
    bad = raw.rlike(r"^$|^/|^[A-Za-z][A-Za-z0-9+.-]*:|[\\?\x00]|%(?![0-9A-F]{2})|%(?:2F|5C|00)|(^|/)\.?(/|$)")

    @F.pandas_udf("string")
    def resolve(links: pd.Series, bases: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str | None:
            try:
                whole = None if a is None or b is None else posixpath.normpath(posixpath.join(posixpath.dirname(b), unquote_to_bytes(a).decode()))
            except UnicodeDecodeError:
                return None
            if whole is None or whole == ".." or whole.startswith("../"):
                return None
            return whole if _encoded(whole, b) == a else None

        return pd.Series([one(a, b) for a, b in zip(links, bases)], dtype=object)

    return resolve(F.when(~bad, raw), base)


def canonical_json(c: Column) -> Column:
    """JSON text with sorted keys and no spaces, ended by a line feed; null for invalid text, repeated keys, NaN or infinity."""

    def no_repeats(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name: str) -> None:
        raise ValueError(name)

    @F.pandas_udf("string")
    def canon(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t, object_pairs_hook=no_repeats, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return canon(c)


def strict_utc(c: Column) -> Column:
    """Timestamp of text of the form YYYY-MM-DDTHH:MM:SS[.ffffff]Z; null for any other spelling."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?Z$"), c.try_cast("timestamp"))


def contiguous(c: Column) -> Column:
    """Whether an array holds 1, 2, … n."""
    return F.coalesce(c == F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(c), F.lit(False))


def ordered_unique(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)
