"""Resolution of links by the public URL standard: usual forms as built-in expressions, all others by its parser.

``resolve_href`` knows the usual forms alone.  Here an array of links is split: what ``_USUAL`` and the page's own
URL show to be such a form stays with it, and only the distinct others go, with the page's URL, through the
standard's state machine in an Arrow function, so of most pages nothing leaves the JVM but an empty array.
"""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import resolve_href
from .text import bound

# ---- Fixed values of the standard ----
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
QUERY_SET, FRAGMENT_SET = set(" \"#<>'"), set(' "<>`')
PATH_SET = set(' "#<>?`{}^')
USERINFO_SET = PATH_SET | set("/:;=@[\\]|")
FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|%") | {chr(c) for c in range(0x20)} | {"\x7f"}
# --------------------------------------

#: A path from the root or a web address, of characters that every part keeps or encodes alike, without dot segments, user, port or number as host.
_SAFE = r"[^\s\\?#\"'<>`{}^|%\[\]\x00-\x20\x7f-\x9f]"
_USUAL = rf"^(?:/(?!/)|https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+/)(?!.*(?:^|/)\.{{1,2}}(?:/|$))(?:{_SAFE})*$"
_USUAL_BASE = r"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+(?:/[^\s\\]*)?$"


def _encoded(text: str, reserved: set[str]) -> str:
    return "".join(c if " " <= c <= "~" and c not in reserved else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(part: str) -> int | None:
    try:
        return int(part[2:] or "0", 16) if part[:2].lower() == "0x" else int(part, 8) if len(part) > 1 and part[0] == "0" else int(part) if part.isdigit() and part.isascii() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """The address of a host whose last label is a number; None is a failure."""
    parts = host.removesuffix(".").split(".")
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or any(n is None for n in numbers) or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    name = unquote_to_bytes(raw.encode("utf-8", "replace")).decode("utf-8", "replace")
    try:
        name = ".".join(p.encode("idna").decode() if not p.isascii() else p.lower() for p in re.split("[.。．｡]", name))
    except UnicodeError:
        return None
    if not name or any(c in FORBIDDEN_HOST for c in name):
        return None
    last = name.removesuffix(".").rsplit(".", 1)[-1]
    return _ipv4(name) if last.isdigit() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last) else name


def _authority(raw: str, scheme: str) -> str | None:
    user, _, rest = raw.rpartition("@")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", rest)
    host = _host(found[1]) if found and rest else None
    if host is None:
        return None
    port = int(found[2]) if found[2] else None
    if port is not None and port > 65535:
        return None
    name, _, word = user.partition(":")
    who = _encoded(name, USERINFO_SET) + (f":{_encoded(word, USERINFO_SET)}" if word else "")
    return (f"{who}@" if who else "") + host + ("" if port in (None, SPECIAL[scheme]) else f":{port}")


def _path(segments: list[str], more: str) -> str:
    out = list(segments)
    parts = re.split(r"[/\\]", more)
    for i, part in enumerate(parts):
        plain, last = re.sub("%2e", ".", part, flags=re.IGNORECASE), i == len(parts) - 1
        if plain == "..":
            out = out[:-1]
            out += [""] * last
        elif plain == ".":
            out += [""] * last
        else:
            out.append(_encoded(part, PATH_SET))
    return "/" + "/".join(out)


def _split(text: str) -> tuple[str, str | None, str | None]:
    head, hash_, fragment = text.partition("#")
    head, mark, query = head.partition("?")
    return head, query if mark else None, fragment if hash_ else None


def parsed_url(link: str, base: tuple | None = None) -> tuple | None:
    """(scheme, authority, path, query, fragment) of a link on a page ``base``; an opaque one has no authority; None for what is none."""
    link = re.sub(r"[\t\n\r]", "", link.strip("".join(map(chr, range(0x21)))))
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", link)
    ends = lambda q, f: (None if q is None else _encoded(q, QUERY_SET), None if f is None else _encoded(f, FRAGMENT_SET))
    if found:
        scheme, rest = found[1].lower(), link[found.end() :]
        if scheme not in SPECIAL:
            head, query, fragment = _split(rest)
            return scheme, None, _encoded(head, set()), *ends(query, fragment)
        if base is None or base[0] != scheme or rest.startswith("//"):
            return _absolute(scheme, rest.lstrip("/\\"))
        link = rest
    if base is None or base[1] is None:
        return None
    scheme, authority, path, base_query, _ = base
    if re.match(r"[/\\]{2}", link):
        return _absolute(scheme, link.lstrip("/\\"))
    head, query, fragment = _split(link)
    if not head:
        kept = base_query if query is None else ends(query, None)[0]
        return scheme, authority, path, kept, ends(None, fragment)[1]
    folder = [] if head[0] in "/\\" else path[1:].split("/")[:-1]
    return scheme, authority, _path(folder, head[1:] if head[0] in "/\\" else head), *ends(query, fragment)


def _absolute(scheme: str, rest: str) -> tuple | None:
    end = re.search(r"[/\\?#]|$", rest).start()
    authority = _authority(rest[:end], scheme)
    if authority is None:
        return None
    head, query, fragment = _split(rest[end:])
    return scheme, authority, _path([], head[1:]), None if query is None else _encoded(query, QUERY_SET), None if fragment is None else _encoded(fragment, FRAGMENT_SET)


def joined_url(link: str, base: str) -> str:
    """The link's absolute form; empty for what cannot be one."""
    page = parsed_url(base)
    found = page and parsed_url(link, page)
    if not found:
        return ""
    scheme, authority, path, query, fragment = found
    return f"{scheme}:" + ("" if authority is None else f"//{authority}") + path + ("" if query is None else f"?{query}") + ("" if fragment is None else f"#{fragment}")


def _joined(links: pa.Array, bases: pa.Array) -> pa.Array:
    return pa.array([[joined_url(x or "", base or "https://example.com") for x in some or ()] for some, base in zip(links.to_pylist(), bases.to_pylist())], pa.list_(pa.string()))


def is_usual(link: Column, base: Column) -> Column:
    return link.rlike(_USUAL) & base.rlike(_USUAL_BASE)


def resolved_urls(links: Column, base: Column) -> Column:
    """Absolute forms of an array of links on the page ``base``, empty texts for what cannot be one."""
    odd = F.array_distinct(F.filter(links, lambda x: ~F.coalesce(is_usual(x, F.coalesce(base, F.lit(""))), F.lit(False))))
    others = F.arrow_udf(_joined, "array<string>")(odd, base)
    return bound(F.map_from_arrays(F.coalesce(odd, F.array().cast("array<string>")), F.coalesce(others, F.array().cast("array<string>"))), lambda known: F.transform(links, lambda x: F.coalesce(F.element_at(known, x), resolve_href(x, base))))
