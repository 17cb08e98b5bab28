"""String, number and URL expressions.  All are built-in Spark expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the contract (wider than Java's ``\s``), and ASCII word boundaries.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_START, WORD_END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_word(pattern: str) -> str:
    """The pattern between ASCII word boundaries; Java's own boundary knows other letters too."""
    return f"{WORD_START}(?:{pattern}){WORD_END}"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(pattern)


def replaced(value: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        value = F.regexp_replace(value, F.lit(pattern), F.lit(by))
    return value


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_CHARACTERS))  # looks at the ends alone


def text_or_empty(value: Column) -> Column:
    return trimmed(F.coalesce(value.cast("string"), F.lit("")))


def one_spaced(value: Column) -> Column:
    """White space runs become one space, ends are trimmed; a single space is no match, as it stays."""
    return F.trim(replaced(value, (rf"{WS}(?:{WS}++|(?<! ))", " ")))


def cut(value: Column, size: int | None) -> Column:
    """At most ``size`` characters, the last three being dots where something was cut; None leaves the text whole."""
    if size is None:
        return value
    return bound(value, lambda v: F.when(F.length(v) <= size, v).otherwise(F.concat(trimmed(F.substring(v, 1, max(0, size - 3))), F.lit("..."))))


def compact(value: Column, size: int) -> Column:
    return cut(one_spaced(F.coalesce(value, F.lit(""))), size)


def clip_text(value: Column, size: int | None) -> Column:
    """Line-preserving clip: spaces at line ends and surplus blank lines go first."""
    return cut(trimmed(replaced(value, (r"\r", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"))), size)


def slug(value: Column, size: int = 80, default: str = "item") -> Column:
    out = F.substring(replaced(F.lower(F.coalesce(value, F.lit(""))), ("[^a-z0-9]+", "_"), ("^_+|_+$", "")), 1, size)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def normalize_domain(value: Column) -> Column:
    """Host of a domain or URL in lower case, without scheme, www, path, query and port."""
    bare = replaced(F.lower(text_or_empty(value)), ("^https?://", ""), (r"^www\.", ""))
    return replaced(bare, (r"[/?#:].*\z", ""))


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where the URL has none or doesn't parse."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, group)


def is_web_url(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://[^/?#\s]+")


def host_of(url: Column) -> Column:
    """Lower-case host without www and port; empty for what is no URL."""
    return F.when(is_web_url(url), replaced(F.lower(url_part(url, 2)), ("^.*@", ""), (r":\d+$", ""), (r"^www\.", ""))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme, host without www and path without a final slash; hash and query go."""
    path = replaced(url_part(url, 3), ("/$", ""))
    return F.when(is_web_url(url), F.concat(F.lower(url_part(url, 1)), F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path))).otherwise(text_or_empty(url))


def page_key(url: Column, page_path: Column, fallback: Column) -> Column:
    """Key under which two pages are one: host and path; else the page's path, else ``fallback``."""
    path = replaced(url_part(url, 3), ("/$", ""))
    key = F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path))
    other = F.when(F.coalesce(page_path, F.lit("")) != "", page_path).otherwise(fallback)
    return F.when(is_web_url(url), key).otherwise(other)


def origin_url(url: Column) -> Column:
    return F.when(is_web_url(url), F.concat(F.lower(url_part(url, 1)), F.lit("://"), F.lower(url_part(url, 2)))).otherwise(F.lit(""))


def domain_to_url(value: Column) -> Column:
    host = normalize_domain(value)
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("https://"), host))


def first_url_like(value: Column) -> Column:
    """The first http(s) URL in a text, else its first bare domain as an https URL."""
    text = text_or_empty(value)
    found = replaced(F.regexp_extract(text, r"""(?i)https?://[^\s,;"'<>)]+""", 0), (r"[.,;]+$", ""))
    bare = F.regexp_extract(text, r"(?i)(?:www\.)?[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/[^\s,;]*)?", 0)
    return F.when(found != "", found).when(bare != "", F.concat(F.lit("https://"), bare)).otherwise(F.lit(""))


def page_path_of(url: Column) -> Column:
    path = url_part(url, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def page_name_of(url: Column) -> Column:
    """Last three path segments in words; ``homepage`` for none."""
    segments = F.filter(F.split(url_part(url, 3), "/"), lambda s: s != "")
    words = F.transform(F.slice(segments, F.greatest(F.size(segments) - 2, F.lit(1)), F.lit(3)), lambda s: replaced(s, ("[-_]+", " ")))
    return F.when(F.size(segments) == 0, F.lit("homepage")).otherwise(cut(F.array_join(words, " / "), 120))


def text_hash(value: Column) -> Column:
    """32-bit multiply-by-33-and-xor hash of the UTF-16 code units, in hex: a character beyond the basic plane is two."""
    step = lambda h, unit: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(unit)
    high, low = (lambda c: F.shiftright(c - 0x10000, 10) + 0xD800), (lambda c: (c - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    code, start = (lambda c: F.ascii(c).cast("long")), F.lit(5381).cast("long")
    # one step a character; pairs are looked for only in texts that have such characters
    plain = lambda v: F.aggregate(F.split(v, ""), start, lambda h, c: step(h, code(c)))
    paired = lambda v: F.aggregate(F.transform(F.split(v, ""), code), start, lambda h, c: F.when(c > 0xFFFF, step(step(h, high(c)), low(c))).otherwise(step(h, c)))
    return bound(value, lambda v: F.lower(F.hex(F.when(v == "", start).when(v.rlike(r"[\x{10000}-\x{10FFFF}]"), paired(v)).otherwise(plain(v)))))


def estimated_tokens(value: Column) -> Column:
    return F.ceil(F.length(F.coalesce(value, F.lit(""))) / 4).cast("long")


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, as the contract does (-2.5 gives -2)."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def trimmed_packet(markdown: Column, size: int) -> Column:
    """A packet of over ``size`` characters cut before its last task section, with a note of the cut."""
    task = F.when(markdown.contains("\n## Task"), F.concat(F.lit("\n## Task"), F.substring_index(markdown, "\n## Task", -1))).otherwise(F.lit(""))
    head = lambda t: F.substring(markdown, F.lit(1), F.greatest(F.lit(1000), F.lit(size - 120) - F.length(t)))
    cut_off = bound(task, lambda t: trimmed(F.concat(trimmed(head(t)), F.lit(f"\n\n[Content trimmed to benchmark budget: {size} chars.]\n"), t)))
    return F.when(F.length(markdown) <= size, markdown).otherwise(cut_off)


def zero_padded(value: Column, size: int = 6) -> Column:
    return F.lpad(value.cast("string"), size, "0")


def output_folder(row_index: Column, name: Column, domain: Column, record_id: Column) -> Column:
    """Folder of a company: padded row number and two slugs."""
    either = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    return F.concat_ws("-", zero_padded(row_index + 1), F.substring(slug(either(name, domain)), 1, 52), F.substring(slug(either(domain, record_id)), 1, 36))


def regex_escaped(value: Column) -> Column:
    return replaced(value, (r"([.*+?^${}()|\[\]\\])", r"\\$1"))


def normalized_text(value: Column) -> Column:
    """Lower case, URLs out, anything but letters, digits and underscores to single spaces."""
    return trimmed(replaced(F.lower(F.coalesce(value, F.lit(""))), (r"https?://\S+", " "), ("[^a-z0-9_]+", " ")))


def distinct_texts(values: Column) -> Column:
    """Trimmed, blanks out, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(values, trimmed), lambda v: v != ""))


def duration(seconds: Column) -> Column:
    """Minutes, or hours and minutes, rounded up."""
    minutes = F.ceil(seconds / 60).cast("long")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def stamp(at: Column) -> Column:
    """ISO time that can stand in a file name."""
    return replaced(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ("[:.]", "-"))
