"""Column functions with the corpus's text semantics (Unicode word classes, Python-like stripping and splitting)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AMENDMENTS

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def split_lines(c: Column) -> Column:
    """Lines at every kind of line break; a final break opens no line."""
    return F.filter(F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"), lambda x: c != "")


def or_default(c: Column, default) -> Column:
    """The default for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def article_key(number: Column, suffix: Column) -> Column:
    return F.concat(number.cast("string"), F.coalesce(suffix, F.lit("")))


def dir_name(number: Column, suffix: Column) -> Column:
    """art- and the number, padded to three digits and never cut, and the suffix."""
    return F.concat(F.lit("art-"), F.format_string("%03d", number), F.coalesce(suffix, F.lit("")))


def article_path(root: str, law: Column, number: Column, suffix: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.lower(law), dir_name(number, suffix))


def state_key(law: Column, number: Column, suffix: Column) -> Column:
    return F.concat_ws(":", law, number.cast("string"), F.coalesce(suffix, F.lit("")))


def slug_of_dir(name: Column) -> Column:
    """The page slug of a directory: zero padding off, suffix kept; null for other names."""
    number = F.regexp_extract(name, r"^art-(\d+)([a-z]*)$", 1)
    return F.when(number != "", F.concat(F.lit("art-"), F.regexp_replace(number, r"^0+(?=\d)", ""), F.regexp_extract(name, r"^art-(\d+)([a-z]*)$", 2)))


def fedlex_url(eli: Column, number: Column, suffix: Column) -> Column:
    return F.concat(F.lit("https://www.fedlex.admin.ch/eli/cc/"), F.coalesce(eli, F.lit("")), F.lit("/de#art_"), article_key(number, suffix))


def default_title(title: Column, law: Column, number: Column, suffix: Column) -> Column:
    return or_default(title, F.concat(F.lit("Art. "), article_key(number, suffix), F.lit(" "), law))


def provision_link(provision: Column, base: str = "/de") -> Column:
    """struct(href, label) of `law/art-NNN`."""
    law = F.element_at(F.split(provision, "/"), 1)
    number = F.regexp_replace(F.regexp_replace(F.get(F.split(provision, "/"), 1), "^(.*?)art-", "$1"), "^0+", "")
    return F.struct(F.concat(F.lit(base + "/"), law, F.lit("/art-"), number).alias("href"), F.concat(F.lit("Art. "), number, F.lit(" "), F.upper(law)).alias("label"))


def label(c: Column, labels: Mapping[str, str], fallback: Column | None = None) -> Column:
    found = F.create_map([F.lit(x) for kv in labels.items() for x in kv])[c]
    return found if fallback is None else F.coalesce(found, fallback)


def escape_xml(c: Column, quotes: bool = True) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def rfc822(ts: Column) -> Column:
    """A UTC timestamp or date as an RFC 822 string; the session's zone must be UTC for timestamps with one."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def article_title(rest: Column) -> Column:
    """The title within an article line: none where it starts with an amendment note; cut at the first note, in the
    order of AMENDMENTS, that stands later; the transitional note and a footnote mark at the end go."""
    starts = F.lit(False)
    for m in AMENDMENTS:
        starts = starts | rest.startswith(m)
    cut = F.when(F.lit(False), rest)
    for m in AMENDMENTS:
        cut = cut.when(F.instr(rest, m) > 1, strip(F.substring_index(rest, m, 1)))
    text = cut.otherwise(rest)
    text = strip(F.regexp_replace(text, r"(?U)\s*\*?\s*Mit Übergangsbestimmung\.?\s*\*?\s*", ""))
    return F.when(starts, F.lit("")).otherwise(strip(F.regexp_replace(text, r"(?U)\d*\*\s*$", "")))


def clean_extracted(c: Column) -> Column:
    """Words split at line ends joined; lines that are page numbers or gazette headers dropped."""
    joined = F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")
    noise = lambda x: strip(x).rlike(r"(?U)^\d+$") | strip(x).rlike(r"(?iU)^BBl\s+\d{4}$")
    return F.array_join(F.filter(F.split(joined, "\n", -1), lambda x: ~noise(x)), "\n")


def clean_ocr(c: Column) -> Column:
    c = F.regexp_replace(c, r"\bN\.[ \t]*(\d)", "N. $1")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"\bBGE\s+(\d+)\s+([IVX]+)\s+(\d+)", "BGE $1 $2 $3"))


def bbl_reference(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"\s+", "-"), "^(?i)bbl", "bbl")


def key_of_file_name(c: Column) -> Column:
    """Article key in a file name: number and suffix, then `ziff` and its number; null without an article."""
    pattern = r"-Art-(\d+[a-z]*)(?:-Ziff-(\d+(?:-\d+)*))?"
    key, ziff = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.nullif(F.concat(key, F.when(ziff != "", F.concat(F.lit("ziff"), ziff)).otherwise("")), F.lit(""))


def html_number(c: Column) -> Column:
    return F.regexp_extract(c, r"""<span[^>]*class=['"][^'"]*number[^'"]*['"][^>]*>\s*([^<]*?)\s*</span>""", 1)


def html_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def html_body(c: Column) -> Column:
    return html_text(F.regexp_replace(c, r"""<span[^>]*class=['"][^'"]*number[^'"]*['"][^>]*>[^<]*</span>""", ""))


def token_cost(prompt: Column, completion: Column) -> Column:
    """US dollars at 10 and 30 per million tokens; missing usage costs nothing."""
    return (F.coalesce(prompt, F.lit(0)) * 10 + F.coalesce(completion, F.lit(0)) * 30) / F.lit(1_000_000.0)


def per_unit(amount: Column, units: Column) -> Column:
    """amount / units, 0 where there are none."""
    return F.coalesce(F.try_divide(amount, units), F.lit(0.0))


def affair_time(c: Column) -> Column:
    """/Date(ms+zone)/ or an ISO timestamp."""
    ms = F.regexp_extract(c, r"^/Date\((-?\d+)", 1)
    return F.when(ms != "", F.timestamp_millis(F.nullif(ms, F.lit("")).cast("long"))).otherwise(F.try_to_timestamp(c))


def backoff_seconds(attempt: Column) -> Column:
    return attempt * 3 + 2


def lang_base(lang: Column, root: str = "") -> Column:
    return F.concat(F.regexp_replace(F.lit(root), "/+$", ""), F.lit("/"), lang)


def url_language(url: Column) -> Column:
    """The first part of a URL's path where it is all letters a-z; empty if it is not."""
    return F.regexp_extract(url, r"^https?://[^/]+/([a-z]+)", 1)


def url_path(url: Column) -> Column:
    """What stands after the language in a URL, `/` where nothing does."""
    return or_default(F.regexp_extract(url, r"^https?://[^/]+/[a-z]+(/.*)$", 1), "/")


def all_digits(c: Column) -> Column:
    """Whether a text is digits 0 to 9 and nothing else; an empty one is not."""
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def elapsed_seconds(began: Column, ended: Column) -> Column:
    return (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / F.lit(1_000_000.0)


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; a key that both have takes the value of the second. A null map is empty."""
    a, b = (F.coalesce(x, F.create_map().cast("map<string,string>")) for x in (first, second))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
