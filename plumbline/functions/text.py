"""Rules on single texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases, labels and patterns that results depend on.
AUTO_CAPTIONS = ("description automatically generated", "a close up of", "a picture containing", "a screenshot of", "a group of", "a close-up of", "a blurry photo of", "a photo of a")
LABEL_STARTS = ("figure", "fig.", "image", "picture", "photo", "chart", "graph", "diagram", "table", "panel", "screenshot", "flow chart", "flowchart")
META_STARTS = ("this is an image", "this is a", "image of", "image showing", "photo of", "photograph of", "picture of", "figure showing", "figure depicting", "figure illustrat", "flow chart", "diagram showing", "chart showing", "screenshot of")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".svg")
VAGUE = ("click here", "click", "here", "read more", "more", "learn more", "info", "more info", "more information", "details", "more details", "link", "this link", "this", "go", "go here", "see more", "view", "view more", "download", "open", "continue", "next", "previous")
LANGUAGES = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "chinese": "zh", "japanese": "ja", "korean": "ko", "russian": "ru", "arabic": "ar", "hindi": "hi"}
BULLET = r"^[\u2022\u2023\u25E6\u2043\u2219\u25AA\u25CF\u25CB\u2013\u2014\-\*\>]\s+"
NUMBERED = r"^(\d{1,3})[.\)]\s+"
LETTERED = r"^[a-zA-Z][.\)]\s+"
ROMAN = r"(?i)^(?:i{1,3}|iv|vi{0,3}|ix|x{0,3})[.\)]\s+"
CAPTION = r"^(?:TABLE|Table|table)\s+(?:\d+|[IVXLC]+)\b[\s.:]*"
PAGE_NUMBER = r"(?i)^[\s\-\u2013\u2014.]*(?:\d{1,4}|[ivxlcdm]{1,8})[\s\-\u2013\u2014.]*$"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def n_words(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def any_of(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_auto_caption(c: Column, phrases=AUTO_CAPTIONS) -> Column:
    return any_of(F.lower(c).contains(p) for p in phrases)


def alt_quality(c: Column, phrases=AUTO_CAPTIONS) -> Column:
    """good, borderline or bad: the first rule of the ladder that holds decides."""
    t = strip(F.replace(strip(c), F.lit("\\000"), F.lit("")))
    low, n = F.lower(t), n_words(t)
    starts = lambda words: any_of(low.startswith(w) for w in words)
    bad = (t == "") | (F.length(t) < 20) | (n < 4) | ((n <= 5) & starts(LABEL_STARTS)) | is_auto_caption(t, phrases) | low.contains("graphical user interface")
    return F.when(bad, "bad").when(n >= 15, "good").when((n < 12) & starts(META_STARTS), "borderline").when(n >= 8, "good").when(n >= 5, "borderline").otherwise("bad")


def is_filename(c: Column) -> Column:
    t = strip(c)
    return any_of(F.lower(t).endswith(e) for e in IMAGE_ENDINGS) | t.startswith("Screen Shot ") | t.startswith("image") | ((F.length(t) < 10) & t.contains("."))


def repair_uri(uri: Column) -> Column:
    """The uri with its slashes and blanks put right; null if that changes nothing."""
    s = strip(uri)
    slashes = F.concat(F.lower(F.regexp_extract(s, r"(?i)^(https?):/+", 1)), F.lit("://"), F.regexp_replace(s, r"(?i)^https?:/+", ""))
    fixed = F.when(s.rlike(r"(?i)^https?:/+"), slashes).otherwise(s)
    no_blanks = F.regexp_replace(fixed, r"\s+", "")
    out = F.when(F.lower(fixed).startswith("mailto:"), F.concat(F.lit("mailto:"), F.regexp_replace(F.substring(fixed, 8, 1 << 30), r"\s+", ""))).when(fixed.rlike("(?i)^https?://"), no_blanks).otherwise(fixed)
    return F.when((uri != "") & (out != s), out)


def uri_severity(uri: Column) -> Column:
    """severe: one slash or three and more, a blank in the host, a split mail address; minor: any other blank."""
    s = strip(uri)
    one_or_many = s.rlike(r"https?:/([^/]|$)") | s.rlike(r"https?:/{3,}")
    blank_host = F.regexp_extract(s, r"^https?://([^/]*)", 1).rlike(r"\s")
    address = strip(F.substring(s, 8, 1 << 30))
    split_mail = s.startswith("mailto:") & address.contains("@") & ~address.rlike(r"^\S+@\S+")
    return F.when(one_or_many | blank_host | split_mail, "severe").when(s.rlike(r"\s"), "minor").otherwise("ok")


def is_url(c: Column) -> Column:
    return strip(c).rlike(r"(?i)^(https?://|www\.|ftp://|mailto:)")


def is_vague(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\.+$", "").isin(*VAGUE)


def list_type(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(BULLET), "bulleted").when(t.rlike(NUMBERED) | t.rlike(LETTERED) | t.rlike(ROMAN), "numbered")


def without_list_prefix(c: Column) -> Column:
    t = strip(c)
    out = t
    for p in (ROMAN, LETTERED, NUMBERED, BULLET):
        out = F.when(t.rlike(p), F.regexp_replace(t, p, "")).otherwise(out)
    return out


def is_citation(c: Column) -> Column:
    return c.rlike(r"\(\d{4}\)") | c.rlike(r"(?i)\bet\s+al\.") | (F.regexp_count(c, F.lit(",")) >= 3)


def base_font(c: Column) -> Column:
    bare = F.regexp_replace(c, r"^[A-Z]{6}\+", "")
    bare = F.when(F.length(bare) > 2, F.regexp_replace(bare, "MT$", "")).otherwise(bare)
    return F.regexp_replace(bare, "-(BoldItalic|BoldItal|Bold|Italic|Ital)$", "")


def dedup_form(c: Column) -> Column:
    """Single blanks, split words joined, dashes and quotes made plain, lower case."""
    s = F.regexp_replace(strip(c), r"\s+", " ")
    s = F.regexp_replace(s, r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2")
    return F.lower(F.translate(s, "\u2014\u2013\u201c\u201d\u2018\u2019", "--\"\"''"))


def language_code(c: Column) -> Column:
    t = strip(c)
    head = F.regexp_replace(F.substring_index(F.lower(t), " ", 1), "[,.]+$", "")
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.when(t == "", "").otherwise(F.coalesce(names[head], F.when((F.length(t) <= 10) & ~t.contains(" ") & ~t.contains("("), t), F.substring(t, 1, 10)))


def is_leaked_header(c: Column) -> Column:
    t = strip(c)
    few = n_words(t).between(1, 12)
    return few & (t.rlike(r"^[A-Z][A-Z\s'\u2019:,\-]+\d{1,4}\s*$") | t.rlike(r"^\d{1,4}\s+[A-Z]{2,}(\s+[A-Z]{2,})*\s*$") | t.rlike(r"^\d{1,3}$"))


def is_page_number(c: Column) -> Column:
    return (strip(c) == "") | strip(c).rlike(PAGE_NUMBER)


def without_page_header(c: Column) -> Column:
    """The text without a first line of page number and capitals and the blank lines after it."""
    return F.regexp_replace(c, r"\A[ \t]*\d+[ \t]+[A-Z][A-Z \t]+(\n|\z)([ \t]*\n)*", "")


def is_private_use(c: Column) -> Column:
    return (c == "") | c.rlike(PRIVATE_USE)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_ids(c: Column) -> Column:
    s = F.regexp_replace(c, r"\b(ocr_)?[a-z]+_\d+\b", "")
    s = F.regexp_replace(s, r"\s{2,}", " ")
    return strip(F.regexp_replace(F.regexp_replace(s, r"^\s*[,;:]\s*", ""), r"\s*[,;:]\s*$", ""))


def duration(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60), F.floor(seconds % 60)
    short = F.concat(F.bround(seconds, 0).cast("int").cast("string"), F.lit(" seconds"))
    middle = F.when(rest > 0, F.concat(minutes.cast("string"), F.lit(" min "), rest.cast("string"), F.lit(" sec"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit(" hr "), (minutes % 60).cast("string"), F.lit(" min"))
    return F.when(seconds < 60, short).when(minutes < 60, middle).otherwise(long)


def mime(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.endswith(".png"), "image/png").when(low.rlike(r"\.jpe?g$"), "image/jpeg").when(low.endswith(".svg"), "image/svg+xml").when(low.endswith(".pdf"), "application/pdf").otherwise("image/png")


def cut(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def pages(c: Column, words_per_page: int = 275) -> Column:
    return F.greatest(F.ceil(n_words(c) / words_per_page), F.lit(1)).cast("int")


def wcag_criterion(tag: Column) -> Column:
    """wcag143 as 1.4.3; null for other tags."""
    return F.when(tag.rlike(r"^wcag\d{3,}$"), F.array_join(F.split(F.substring(tag, 5, 100), ""), "."))


def retry_delay(c: Column) -> Column:
    """Seconds of the retryDelay that an error text names."""
    p = r"retryDelay'?\s*:\s*'?(\d+(?:\.\d+)?)\s*(ms|s)\b"
    n = F.regexp_extract(c, p, 1)
    return F.when(n != "", n.cast("double") / F.when(F.regexp_extract(c, p, 2) == "ms", 1000.0).otherwise(1.0))


def usage_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    m = F.lower(model)
    price = lambda i, o: (tokens_in * i + tokens_out * o) / 1_000_000
    return F.when(m.contains("gemini"), price(0.15, 0.60)).when(m.contains("claude"), price(3.0, 15.0)).otherwise(0.0)
