"""Fill-in-the-middle examples: prefix, middle and suffix of a text, cut at units, by relational steps alone.

The matches of a unit pattern are exploded with their places; a window of running sums gives what stands
before each match, in units and in code points; the cuts asked for, ordinals of units, are joined to
the matches that hold them; their offsets are aggregated to one row a document; and substrings of the
whole text are put together.  Nothing but these offsets meets the text: of a document's units only
numbers are shuffled, and its text once, for that last join.

A unit is a match of ``Units.pattern``.  Units of one code point each are matched in runs of
``per_match``, as a row for every code point of a corpus would be many times the corpus: a cut inside a
run lies as many code points behind its start as units.  Patterns must match any text from end to end.

Documents are told apart by doc_id and the SHA-256 of the text: rows that repeat both have the same offsets.

Defined cases: a null text is an empty one; an empty text, and one that holds a marker, is plain; a null
doc_id reads as no digits in the hash; repeated rows give repeated rows; an empty table gives no rows;
texts of any length are cut whole; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Units:
    """pattern: one match; per_match: units in a full match, more than one only where each is a code point."""

    pattern: str
    per_match: int = 1


CODE_POINTS = Units(r"(?s).{1,4096}", 4096)
WORDS = Units(r"\S+\s*|\s+")
LINES = Units(r"[^\n]*\n|[^\n]+")


@dataclass(frozen=True)
class Middle:
    """plain_percent: h3 from 100 less this on stays plain; spm_percent: h4 below this is suffix first.

    The markers must not begin inside one another: a text that holds none of them can then be restored.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20
    salt: str = "1:"
    units: Units = field(default=CODE_POINTS)

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def hash_group(doc_id: Column, number: int, salt: str) -> Column:
    """The ``number``-th group (from 1) of eight hex digits of the document's hash, as a number."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """key (doc_id and digest of the text) and text, null as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(F.col("doc_id").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).alias("key"), text.alias("text"))


def placed_matches(texts: DataFrame, units: Units) -> DataFrame:
    """key, match, chars_before of each match; on a key's last match its units and chars, all of them, else null.

    texts: key, text.  Rows that repeat a key give one row a match; a text without units gives one, of no size.
    """
    sizes = F.transform(F.regexp_extract_all("text", F.lit(units.pattern), F.lit(0)), F.char_length)
    rows = texts.select("key", F.posexplode_outer(sizes).alias("match", "chars")).groupBy("key", "match").agg(F.first("chars").alias("chars"))
    rows = rows.select("key", F.coalesce("match", F.lit(0)).cast("long").alias("match"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    size = F.col("chars") if units.per_match > 1 else F.when(F.col("chars") > 0, 1).otherwise(0)
    order = Window.partitionBy("key").orderBy("match")
    so_far, last = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.lead("match").over(order).isNull()
    chars = F.sum("chars").over(so_far)
    return rows.select("key", "match", (chars - F.col("chars")).alias("chars_before"), F.when(last, F.sum(size).over(so_far)).alias("units"), F.when(last, chars).alias("chars"))


def cut_requests(matches: DataFrame, options: Middle) -> DataFrame:
    """key, cut, ordinal, units, chars: after how many units each key's text is cut, the lower cut first; one row a cut."""
    totals = matches.where("units IS NOT NULL").select("key", "units", "chars")
    at = [F.pmod(hash_group(F.col("key.doc_id"), i, options.salt), F.col("units") + 1) for i in (1, 2)]
    return totals.select("key", "units", "chars", F.posexplode(F.array(F.least(*at), F.greatest(*at))).alias("cut", "ordinal"))


def cut_offsets(matches: DataFrame, requests: DataFrame, units: Units) -> DataFrame:
    """key, units, prefix_end, middle_end: code points before each cut.

    A cut after all units ends with the text; any other lies in the match that holds the unit behind it.
    """
    wanted = requests.withColumn("match", F.floor(F.col("ordinal") / F.lit(units.per_match)).cast("long"))
    found = wanted.join(matches.select("key", "match", "chars_before"), ["key", "match"], "left")
    inside = F.pmod("ordinal", F.lit(units.per_match).cast("long"))
    offset = F.when(F.col("ordinal") == F.col("units"), F.col("chars")).otherwise(F.col("chars_before") + inside)
    end = lambda cut: F.max(F.when(F.col("cut") == cut, offset))
    return found.groupBy("key").agg(F.max("units").alias("units"), end(0).alias("prefix_end"), end(1).alias("middle_end"))


def _after(text: Column, marker: str) -> Column:
    """What follows the first ``marker``."""
    return F.substr(text, F.locate(marker, text) + F.lit(len(marker)))


def restored(output: Column, form: Column, options: Middle = Middle()) -> Column:
    """The text from an output and its form: the first of each marker is the marker, as the text holds none."""
    first_mark = F.when(form == "spm", F.lit(options.suffix)).otherwise(F.lit(options.prefix))
    rest = F.substr(output, F.char_length(first_mark) + F.lit(1))

    def parts(second: str) -> tuple[Column, Column, Column]:
        tail = _after(rest, second)
        return F.substring_index(rest, second, 1), F.substring_index(tail, options.middle, 1), _after(tail, options.middle)

    prefix, suffix, middle = parts(options.suffix)
    suffix_2, prefix_2, middle_2 = parts(options.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


def fill_in_middle(docs: DataFrame, options: Middle = Middle()) -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars, output of docs(doc_id, text); n: units of the text."""
    texts = keyed(docs)
    matches = placed_matches(texts, options.units)
    offsets = cut_offsets(matches, cut_requests(matches, options), options.units)
    text, a, b = F.col("text"), F.col("prefix_end"), F.col("middle_end")
    group = lambda i: hash_group(F.col("key.doc_id"), i, options.salt)
    held = F.contains(text, F.lit(options.prefix)) | F.contains(text, F.lit(options.suffix)) | F.contains(text, F.lit(options.middle))
    plain = (F.col("units") == 0) | held | (group(3) % 100 >= 100 - options.plain_percent)
    form = F.when(plain, "plain").when(group(4) % 100 < options.spm_percent, "spm").otherwise("psm")
    prefix, middle, suffix = F.substr(text, F.lit(1), a.cast("int")), F.substr(text, (a + 1).cast("int"), (b - a).cast("int")), F.substr(text, (b + 1).cast("int"))
    p, s, m = (F.lit(x) for x in options.markers)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    cut = texts.join(offsets, "key").withColumn("form", form)
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select(F.col("key.doc_id").alias("doc_id"), "text", F.col("units").alias("n"), "form", chars(a).alias("prefix_chars"), chars(b - a).alias("middle_chars"), output.alias("output"))


def middle_digests(docs: DataFrame, options: Middle = Middle()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    made = fill_in_middle(docs, options)
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), options)).alias("restored_sha256"))
