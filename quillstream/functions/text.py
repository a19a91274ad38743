"""Text functions as Column expressions, and the few that need Python, as vectorised UDFs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Noise words of captions, contractions, fillers, and patterns of sentences without content.
NOISE = [">>", "[laughter]", "[music]", "[applause]"]
CONTRACTIONS = [
    (" cuz ", " because "), (" u ", " you "), (" ur ", " your "), (" im ", " I'm "), (" dont ", " don't "),
    (" cant ", " can't "), (" wont ", " won't "), (" its ", " it's "), (" thats ", " that's "),
]
FILLER_START = r"^(?i:(Um|Uh|Ah|Like|So|You know),?\s+)"
JUNK = [
    r"^(um|uh|ah|like|so|you know|i mean)\W*$", r"^can you (hear|see) me\??$", r"^type \d in the chat", r"^let me know if", r"^sound check",
    r"^mic check", r"^alright guys", r"^welcome back", r"^hit the like button", r"^subscribe", r"^check the link",
]
HIGH_VALUE = ["basis points", "MAE", "MFE", "0-5 box", "line in the sand", "reversal", "if.*then", "fair value gap", "order block"]
VIDEO_SITE = r"^((https?://)?(www\.)?(youtube|youtu|youtube-nocookie)\.(com|be)/|(https?://)?(www\.)?youtube\.com/watch\?v=|(https?://)?(www\.)?youtu\.be/)"
SKIPPED_IMAGES = ["logo", "icon", "avatar", "sprite", "pixel", "spacer", "banner", "share", "social", "favicon", "emoji"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
BOILERPLATE = ["Here is", "Sure", "These are", "**", "Glossary"]
PLAYLIST = ["list=", "/channel/", "/c/", "/user/", "/@"]
NUMBER_CLAIM = r"(?i)\b\d{3,5}\b|\b\d+\s*(point|pt|pip|%)\b"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_caption(line: Column | str) -> Column:
    """A caption line without its leading ``[HH:MM:SS]``, noise words and repeated white space."""
    s = F.regexp_replace(F.trim(_c(line)), r"^\[\d{2}:\d{2}:\d{2}\]\s*", "")
    s = F.regexp_replace(s, r"\s+", " ")
    for n in NOISE:
        s = F.replace(s, F.lit(n), F.lit(""))
    return F.trim(s)


def sentences(text: Column | str) -> Column:
    """An array of sentences, each with its closing marks; cut where white space follows them."""
    marked = F.regexp_replace(_c(text), r"([.!?]+)\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda s: s != "")


def fix_contractions(s: Column | str) -> Column:
    out = _c(s)
    for a, b in CONTRACTIONS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def drop_leading_filler(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), FILLER_START, "")


def capitalise(s: Column | str) -> Column:
    """The first character in upper case, the others as they are."""
    s = _c(s)
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def is_junk(s: Column | str) -> Column:
    return F.lower(_c(s)).rlike("|".join(f"({p})" for p in JUNK))


def has_high_value(s: Column | str) -> Column:
    return _c(s).rlike("(?i)" + "|".join(HIGH_VALUE))


def is_video_url(url: Column | str) -> Column:
    return F.coalesce(_c(url).rlike(VIDEO_SITE), F.lit(False))


def video_id(url: Column | str) -> Column:
    """The id after ``watch?v=`` or ``youtu.be/``, up to the next ``&`` or ``?``; null without either."""
    url = _c(url)
    after = F.when(url.contains("watch?v="), F.split_part(url, F.lit("watch?v="), F.lit(2))).when(url.contains("youtu.be/"), F.split_part(url, F.lit("youtu.be/"), F.lit(2)))
    return F.split_part(F.split_part(after, F.lit("&"), F.lit(1)), F.lit("?"), F.lit(1))


def slugify(url: Column | str, n: int = 80) -> Column:
    """A URL as a name: scheme dropped, lower case, runs of other characters as one ``_``, at most n characters."""
    s = F.regexp_replace(F.lower(F.regexp_replace(_c(url), r"^https?://", "")), r"[^a-z0-9]+", "_")
    return F.left(F.btrim(s, F.lit("_")), F.lit(n))


def concept_stub(raw: Column | str, n: int = 40) -> Column:
    s = F.left(F.btrim(F.regexp_replace(F.lower(_c(raw)), r"[^a-z0-9]+", "_"), F.lit("_")), F.lit(n))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unnamed_concept")).otherwise(s)


def sanitize_filename(name: Column | str, n: int = 100) -> Column:
    """Reserved characters as ``_``, single spaces, at most n characters, no point or space at the end."""
    s = F.trim(F.regexp_replace(F.regexp_replace(_c(name), r'[<>:"/\\|?*]', "_"), r"\s+", " "))
    return F.rtrim(F.left(s, F.lit(n)), F.lit(". "))


def match_name(name: Column | str) -> Column:
    """A name for matching: lower case, without extension, ``_ - .`` as spaces."""
    s = F.regexp_replace(F.lower(_c(name)), r"(?<=[^.])\.[^.\s]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[_\-.]", " "), r"\s+", " "))


def sorted_tokens(s: Column | str) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(_c(s)), r"\s+")), " ")


def bold_figures(s: Column | str) -> Column:
    """Percentages and prices like 4500.25 between double asterisks."""
    return F.regexp_replace(F.regexp_replace(_c(s), r"(\d+(?:\.\d+)?%)", r"**$1**"), r"(\b\d{4}\.\d{2}\b)", r"**$1**")


def verbatim_form(s: Column | str) -> Column:
    """Text for verbatim search: bracketed stamps as spaces, single spaces, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(_c(s), r"\[[^\]]*\]", " "), r"\s+", " ")))


def probes(s: Column | str) -> Column:
    """Three substrings of 40 characters, near begin, middle and end, of a text over 90 characters; else all of it."""
    s = _c(s)
    n = F.length(s)
    at = lambda a: F.substr(s, a, F.lit(40))
    return F.when(n > 90, F.array(at(F.lit(11)), at(F.floor(n / 2).cast("int") + 1), at(n - 49))).otherwise(F.array(s))


def number_claims(s: Column | str) -> Column:
    """How many figures a text names that could be made up."""
    return F.regexp_count(_c(s), F.lit(NUMBER_CLAIM))


def find_replace(s: Column | str, find: str, put: str, ignore_case: bool = False) -> Column:
    """Literal replacement. With ignore_case, upper and lower case are alike."""
    if not ignore_case:
        return F.replace(_c(s), F.lit(find), F.lit(put))
    return F.regexp_replace(_c(s), "(?i)" + re.sub(r"([^\w\s])", r"\\\1", find), put.replace("\\", "\\\\").replace("$", "\\$"))


def repair_stamp(s: Column | str) -> Column:
    """``[HH:MM:SS:mmm]`` as ``[HH:MM:SS]``."""
    return F.regexp_replace(_c(s), r"\[(\d{2}:\d{2}:\d{2}):\d+\]", "[$1]")


def four_part_stamp(s: Column | str) -> Column:
    """``[00:00:MM:SS]`` as ``[MM:SS]``: of a stamp of four parts, the last two."""
    return F.regexp_replace(_c(s), r"\[\d*:\d*:(\d+):(\d+)\]", "[$1:$2]")


def date_in_name(name: Column | str) -> Column:
    """The date in a file's name: ``YYYY-MM-DD`` (or with ``_``) anywhere, else ``DD_Mon_D_YYYY``; null where there is
    none or it is no date."""
    name = _c(name)
    iso = F.regexp_extract(name, r"\d{4}[-_]\d{2}[-_]\d{2}", 0)
    spoken = r"\d{2}_?([A-Za-z]{3})[_ ](\d{1,2})[_ ](\d{4})"
    part = lambda i: F.regexp_extract(name, spoken, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1)))
    made = F.when(month > 0, F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))
    return F.when(iso != "", F.replace(iso, F.lit("_"), F.lit("-")).try_cast("date")).otherwise(made.try_cast("date"))


def without_boilerplate(text: Column | str) -> Column:
    """A model's answer without the lines that introduce it."""
    lines = F.split(_c(text), "\n")
    return F.array_join(F.filter(lines, lambda x: ~F.trim(x).rlike("^(" + "|".join(map(re.escape, BOILERPLATE)) + ")")), "\n")


def is_playlist(url: Column | str) -> Column:
    return F.coalesce(_c(url).rlike("|".join(map(re.escape, PLAYLIST))), F.lit(False))


def known_as(name: Column | str, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """A name in lower case, or what stands for it: the first rule whose text it contains; ``default`` if it is empty."""
    low = F.lower(F.trim(_c(name)))
    out = F.when(F.coalesce(_c(name), F.lit("")) == "", F.lit(default))
    for part, put in rules:
        out = out.when(low.contains(part), F.lit(put))
    return out.otherwise(low)


def notes_source(path: Column | str) -> Column:
    """Whether a path is a transcript to make notes of: below a transcripts folder, not of the year left out, no notes."""
    p = _c(path)
    folder = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return p.endswith(".txt") & F.lower(folder).contains("transcripts") & ~folder.contains("2023") & ~folder.rlike("[Nn]otes")


def stem(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]+?)(\.[^./]*)?$", 1)


def paged_image(path: Column | str) -> Column:
    """``struct(source, page)`` of ``<stem>_p<number>.png``; null fields for other names."""
    name = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    source = F.regexp_extract(name, r"^(.*)_p(\d+)\.png$", 1)
    return F.struct(F.when(source != "", source).alias("source"), F.regexp_extract(name, r"^(.*)_p(\d+)\.png$", 2).try_cast("int").alias("page"))


def byte_size(n: Column | str) -> Column:
    """``struct(value, unit)``: bytes in steps of 1024, two decimals, up to TB."""
    n = _c(n).cast("double")
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).when(n < 1024**4, 3).otherwise(4)
    return F.struct(F.round(n / F.pow(F.lit(1024.0), step), 2).alias("value"), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB"))), step + 1).alias("unit"))


# ---- Python: HTML, longest common subsequence ----


class _Text(HTMLParser):
    DROPPED = {"script", "style", "nav", "footer", "header", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = {"article": 0, "main": 0}
        self.skip = 0
        self.got: dict[str, list[str]] = {"article": [], "main": [], "body": []}

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.DROPPED
        if tag in self.inside:
            self.inside[tag] += 1

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.DROPPED))
        if tag in self.inside:
            self.inside[tag] = max(0, self.inside[tag] - 1)

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        for k, n in self.inside.items():
            if n:
                self.got[k].append(data.strip())
        self.got["body"].append(data.strip())


def html_text(page: str) -> str:
    """The text of ``<article>``, else of ``<main>``, else of the page, without navigation, scripts and styles."""
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(p.got["article"] or p.got["main"] or p.got["body"])


@F.pandas_udf(T.StringType())
def html_text_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda p: None if p is None else html_text(p))


@F.pandas_udf(T.StringType())
def unescape_html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else html.unescape(t))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)), by bit vectors; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    lcs = len(a) - row.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")
