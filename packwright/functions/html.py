"""HTML to links, assets, Markdown and text, as built-in expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, cut, distinct_texts, is_web_url, one_spaced, origin_url, replaced, trimmed, url_part, whole_word

# ---- Fixed values of the contract ----
ENTITIES = (("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&apos;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&mdash;|&ndash;", "-"))
DROPPED_ELEMENTS = ("script", "style", "noscript", "svg", "canvas")
CLOSING_BLOCKS = "p|div|section|article|main|aside|header|footer|nav|ul|ol|table"
FAVICONS, LOGOS, IMAGES = 12, 12, 24
KEY_WORDS = "AUM|Asset Class|Investor Type|Founded|Headquarters|Location|Strategy|Geography|Sector|CRD|SEC|Fund|Commitment"
KEY_LABELS = "AUM|Assets under management|Asset classes?|Investor type|Institution type|Firm type|Founded|Headquarters|Location|Strategy|Strategies|Geograph(?:y|ies)|Sectors?|CRD|SEC|Known fund commitments?|Fund commitments?|Office|Website|Email|Phone"
# --------------------------------------


def decode_entities(value: Column) -> Column:
    """Named entities in their fixed order, then decimal ones, as one UTF-16 unit each."""
    numeric = r"^&#(\d+);$"
    unit = lambda p: F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(p, numeric, 1).cast("long").bitwiseAND(F.lit(0xFFFF))), 4, "0")), "UTF-16BE")
    parts = lambda v: F.regexp_extract_all(v, F.lit(r"([^&]+|&#\d+;|&)"), F.lit(1))
    decoded = lambda v: F.array_join(F.transform(parts(v), lambda p: F.when(p.rlike(numeric), unit(p)).otherwise(p)), "")
    named = lambda v: bound(replaced(v, *ENTITIES), lambda w: F.when(w.contains("&#"), decoded(w)).otherwise(w))
    return bound(value, lambda v: F.when(v.contains("&"), named(v)).otherwise(v))


def without_tags(value: Column) -> Column:
    return decode_entities(one_spaced(replaced(value, ("<[^>]+>", " "))))


def attribute(tag: Column, name: str) -> Column:
    return one_spaced(F.regexp_extract(tag, rf"""(?i){whole_word(name)}=["']([^"']+)["']""", 1))


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}{'(?![0-9A-Za-z_])'}[^>]*>"), F.lit(0))


def percent_encoded(path: Column) -> Column:
    """Spaces and non-ASCII characters percent-encoded; other characters stay."""
    letter = lambda c: F.when(c == " ", F.lit("%20")).when(c.rlike("[^!-~]"), F.url_encode(c)).otherwise(c)
    return bound(path, lambda p: F.when(p.rlike("[^!-~]"), F.array_join(F.transform(F.split(p, ""), letter), "")).otherwise(p))


def _without_dots(path: Column) -> Column:
    """Path with . and .. segments resolved; an empty path is the root."""
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.array_append(acc, s))
    walk = lambda p: F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return bound(path, lambda p: F.when(p == "", F.lit("/")).when(p.rlike(r"/\.{1,2}(/|$)"), walk(p)).otherwise(p))


def resolve_href(href: Column, base: Column) -> Column:
    """Absolute form of a link on the page ``base``; empty for what cannot be one."""

    def relative(h: Column) -> Column:
        part = lambda i: F.regexp_extract(h, r"^([^?#]*)(\?[^#]*)?(#.*)?$", i)
        folder = F.coalesce(F.nullif(F.regexp_extract(url_part(base, 3), "^(.*/)", 1), F.lit("")), F.lit("/"))
        path = bound(part(1), lambda p: F.when(p.startswith("/"), p).when(p == "", url_part(base, 3)).otherwise(F.concat(folder, p)))
        query = F.when(h.rlike(r"^(#|$)"), url_part(base, 4)).otherwise(part(2))
        return F.concat(origin_url(base), percent_encoded(_without_dots(path)), percent_encoded(query), part(3))

    def absolute(h: Column) -> Column:
        return F.concat(F.lower(url_part(h, 1)), F.lit("://"), F.lower(url_part(h, 2)), percent_encoded(_without_dots(url_part(h, 3))), percent_encoded(url_part(h, 4)), url_part(h, 5))

    return bound(
        trimmed(href),
        lambda h: F.when(h.rlike(r"(?i)^https?:/+[^/?#\s]"), absolute(h))
        .when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.lower(url_part(base, 1)), F.lit(":"), h))
        .when(is_web_url(base), relative(h))
        .otherwise(F.lit("")),
    )


def anchor_hrefs(html: Column) -> Column:
    """What the anchors link to, as it stands, without what leads to the page itself or to a script."""
    return F.filter(F.transform(tags(html, "a"), lambda t: attribute(t, "href")), lambda h: (h != "") & ~h.rlike("(?i)^#|^javascript:"))


def page_links(html: Column, base: Column) -> Column:
    """Distinct http(s) targets of the anchors, in order, without fragments."""
    full = F.transform(anchor_hrefs(html), lambda h: replaced(resolve_href(h, base), ("#.*$", "")))
    return distinct_texts(F.filter(full, is_web_url))


def page_assets(html: Column, base: Column) -> Column:
    """favicon_urls, logo_urls and image_urls of a page."""
    resolved = lambda a: F.filter(F.transform(a, lambda h: resolve_href(h, base)), lambda u: u != "")
    icons = F.filter(tags(html, "link"), lambda t: attribute(t, "rel").rlike("(?i)icon|mask-icon|apple-touch-icon") & (attribute(t, "href") != ""))
    named = F.filter(tags(html, "meta"), lambda t: F.concat_ws(" ", attribute(t, "property"), attribute(t, "name")).rlike("(?i)image") & (attribute(t, "content") != ""))
    source = lambda t: F.when(attribute(t, "src") != "", attribute(t, "src")).otherwise(attribute(t, "data-src"))
    images = F.filter(tags(html, "img"), lambda t: source(t) != "")
    label = lambda t: F.lower(F.concat_ws(" ", attribute(t, "alt"), attribute(t, "class"), attribute(t, "id"), source(t)))
    logos = F.filter(images, lambda t: label(t).rlike(f"{whole_word('logo')}|brand|mark"))
    content = resolved(F.transform(named, lambda t: attribute(t, "content")))
    origin = origin_url(base)
    own_icon = F.when(origin != "", F.array(F.concat(origin, F.lit("/favicon.ico")))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        F.slice(distinct_texts(F.concat(resolved(F.transform(icons, lambda t: attribute(t, "href"))), own_icon)), 1, FAVICONS).alias("favicon_urls"),
        F.slice(distinct_texts(F.concat(content, resolved(F.transform(logos, source)))), 1, LOGOS).alias("logo_urls"),
        F.slice(distinct_texts(F.concat(content, resolved(F.transform(images, source)))), 1, IMAGES).alias("image_urls"),
    )


def normalize_markdown(value: Column, size: int | None = 220_000) -> Column:
    steps = ((r"\r", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"(?m)[ \t\x0B\f ]+$", ""))
    return cut(trimmed(replaced(value, *steps)), size)


def html_title(html: Column) -> Column:
    return decode_entities(one_spaced(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def _linked(piece: Column, base: Column) -> Column:
    """A piece of HTML that ends with its only closing anchor, that anchor turned to Markdown."""
    pattern = r"(?is)^(.*?)<a(?![0-9A-Za-z_])([^>]*)>(.*)</a>$"
    part = lambda i: F.regexp_extract(piece, pattern, i)
    plain = lambda href: (href == "") | href.rlike("(?i)^#|^javascript:")
    target = bound(attribute(part(2), "href"), lambda href: F.when(plain(href), F.lit("")).otherwise(resolve_href(href, base)))
    marked = lambda x: F.concat(F.lit("["), replaced(x["text"], (r"([\[\]])", r"\\$1")), F.lit("]("), x["target"], F.lit(")"))
    link = bound(F.struct(without_tags(part(3)).alias("text"), target.alias("target")), lambda x: F.when((x["text"] == "") | (x["target"] == ""), x["text"]).otherwise(marked(x)))
    # the end is looked at first: what follows a page's last anchor may be most of it
    return F.when(_ends(piece, "</a>") & piece.rlike(pattern), F.concat(part(1), link)).otherwise(piece)


def _ends(piece: Column, tag: str) -> Column:
    return F.lower(F.right(piece, F.lit(len(tag)))) == tag


def html_to_markdown(html: Column, base: Column, size: int | None = 220_000) -> Column:
    """title and markdown of a page."""
    body = replaced(html, *[(rf"(?is)<{e}.*?</{e}>", " ") for e in DROPPED_ELEMENTS], ("(?s)<!--.*?-->", " "))
    body = F.array_join(F.transform(F.split(body, "(?i)(?<=</a>)"), lambda p: _linked(p, base)), "")
    for level in range(1, 7):
        body = _heading(body, level)
    steps = [(r"(?i)<li(?![0-9A-Za-z_])[^>]*>", "\n- "), ("(?i)</li>", "\n"), (r"(?i)<t[dh](?![0-9A-Za-z_])[^>]*>", " | "), ("(?i)</t[dh]>", " "), ("(?i)</tr>", " |\n"), (r"(?i)<br\s*/?>", "\n")]
    body = replaced(body, *steps, (f"(?i)</({CLOSING_BLOCKS})>", "\n"), ("<[^>]+>", " "))
    page = F.struct(html_title(html).alias("title"), normalize_markdown(decode_entities(body), size).alias("markdown"))
    titled = lambda p: normalize_markdown(F.concat(F.lit("# "), p["title"], F.lit("\n\n"), p["markdown"]), size)
    untitled = lambda p: (p["title"] != "") & ~F.lower(p["markdown"]).contains(F.lower(p["title"]))
    return bound(page, lambda p: F.struct(p["title"].alias("title"), F.when(untitled(p), titled(p)).otherwise(p["markdown"]).alias("markdown")))


def _heading(body: Column, level: int) -> Column:
    """Headings of one level as Markdown lines; their inner tags go."""
    pattern = rf"(?is)^(.*?)<h{level}(?![0-9A-Za-z_])[^>]*>(.*)</h{level}>$"
    part = lambda p, i: F.regexp_extract(p, pattern, i)
    line = lambda p: F.concat(part(p, 1), F.lit("\n" + "#" * level + " "), without_tags(part(p, 2)), F.lit("\n"))
    turned = lambda b: F.array_join(F.transform(F.split(b, f"(?i)(?<=</h{level}>)"), lambda p: F.when(_ends(p, f"</h{level}>") & p.rlike(pattern), line(p)).otherwise(p)), "")
    return bound(body, lambda b: F.when(b.rlike(f"(?i)</h{level}>"), turned(b)).otherwise(b))


def markdown_to_text(markdown: Column) -> Column:
    steps = ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*]\s+", ""), (r"[|`*_>]", " "))
    return one_spaced(replaced(markdown, *steps))


def is_key_value(line: Column) -> Column:
    listed = line.rlike("(?i):|" + whole_word(KEY_WORDS))
    return F.when(line.rlike(r"^[-*]\s+"), listed).otherwise(line.rlike(rf"(?i)^({KEY_LABELS})(?![0-9A-Za-z_])\s*[:|-]"))


def markdown_structure(markdown: Column) -> Column:
    """headings, key_value_lines, table_like_lines, link_count and sample_lines."""
    lines = F.filter(F.transform(F.split(markdown, r"\r?\n"), trimmed), lambda x: x != "")
    heads = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+")), lambda x: replaced(x, (r"^#{1,6}\s+", "")))
    return F.struct(
        distinct_texts(F.slice(heads, 1, 30)).alias("headings"),
        distinct_texts(F.slice(F.filter(lines, is_key_value), 1, 60)).alias("key_value_lines"),
        distinct_texts(F.slice(F.filter(lines, lambda x: F.size(F.split(x, r"\|")) >= 3), 1, 40)).alias("table_like_lines"),
        F.size(F.regexp_extract_all(markdown, F.lit(r"\[[^\]]+\]\([^)]+\)"), F.lit(0))).cast("long").alias("link_count"),
        F.slice(lines, 1, 80).alias("sample_lines"),
    )


def page_summary(*candidates: Column) -> Column:
    """First non-empty of the candidates (text, markdown, title, error), at most 900 characters."""
    filled = [F.when(F.coalesce(c, F.lit("")) != "", c) for c in candidates]
    return cut(one_spaced(F.coalesce(*filled, F.lit(""))), 900)
