"""Main text, title, links and date of HTML pages as column expressions, so that they run inside the scan's stage.

Null and empty pages give null titles and dates, an empty text and no links. Markup is read with patterns, not
parsed into a tree: an element is taken to end at the first closing tag of its name, as these containers seldom nest.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: elements that never hold the author's text
DROPPED = ["script", "style", "noscript", "svg", "form", "iframe", "figure", "nav", "header", "footer", "aside"]
#: fixed values: elements that end a line of text
BLOCKS = "p|h[1-6]|li|blockquote|pre|td|dd|dt|div|br|tr|section|article|main"
#: fixed values: meta keys that hold a page's date, best first, with the confidence they deserve
META_DATES = {"article:published_time": "exact", "og:article:published_time": "exact", "datePublished": "exact", "date": "day", "dc.date.issued": "day", "parsely-pub-date": "exact", "sailthru.date": "exact", "article:modified_time": "inferred"}


#: fixed values: keys of a page's date in JSON-LD, best first
LD_DATES = ["datePublished", "dateCreated", "uploadDate"]


def unescaped(text: Column) -> Column:
    """text with the five named entities, the apostrophe by number and the no-break space resolved."""
    for name, char in (("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&amp;", "&")):
        text = F.regexp_replace(text, name, char)
    return text


def escaped(text: Column) -> Column:
    """text as the content of an element or of an attribute in double quotes."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def tidy(text: Column) -> Column:
    """No-break spaces as blanks, no characters of zero width, single blanks, none before closing or after opening marks, at most one empty line, trimmed lines."""
    t = F.translate(text, "\u00a0\u200b\u200c\u200d\ufeff\u2060", " ")
    for pattern, into in (("[ \t]+", " "), (r" ([,.;:!?%)\]])", "$1"), (r"([(\[]) ", "$1"), (r" *(\r?\n) *", "\n"), ("\n{3,}", "\n\n")):
        t = F.regexp_replace(t, pattern, into)
    return F.regexp_replace(t, r"^\s+|\s+\z", "")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def main_text(html: Column) -> Column:
    """The text of <article>, else <main>, else <body>, else the page, a line per block; without the DROPPED elements."""
    h = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({'|'.join(DROPPED)})\b.*?</\1\s*>", " ")

    def body(page: Column) -> Column:
        inner = [_once(F.trim(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1)), lambda x: F.when(x != "", x)) for tag in ("article", "main", "body")]
        return F.coalesce(*inner, page)

    h = _once(h, body)
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)<!--.*?-->", " "), r"[ \t\r\n]+", " ")
    h = F.regexp_replace(h, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(tidy(unescaped(F.regexp_replace(h, "<[^>]*>", " "))), "\n{2,}", "\n")


def _attribute(html: Column, tag: str, key: str, value: str, wanted: str) -> Column:
    """The attribute `wanted` of the first tag whose attribute `key` has the value; null without it."""
    inside = rf"""(?is)(<{tag}\b(?=[^>]*\b(?:{key})\s*=\s*["']{value}["'])[^>]*>)"""
    found = F.regexp_extract(F.regexp_extract(html, inside, 1), rf"""(?is)\b{wanted}\s*=\s*(["'])(.*?)\1""", 2)
    return _once(F.trim(found), lambda x: F.when(x != "", unescaped(x)))


def title(html: Column) -> Column:
    """og:title, else twitter:title, else the first <h1>, else <title>; null without any."""
    inner = [F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), "<[^>]*>", " ") for tag in ("h1", "title")]
    found = [_attribute(html, "meta", "property|name", key, "content") for key in ("og:title", "twitter:title")] + [F.when(F.trim(x) != "", unescaped(x)) for x in inner]
    return tidy(F.coalesce(*found))


def links(html: Column) -> Column:
    """Every different http address that the page links to, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["'](https?://[^"'\s]+)["']"""), F.lit(1))
    return F.array_distinct(F.transform(found, unescaped))


def date(html: Column, url: Column) -> Column:
    """struct(value, confidence, provenance): the page's date as written, from JSON-LD (at any depth), else meta keys, else <time>, else the path of the url; null without."""

    def some(value: Column, confidence: str, provenance: str) -> Column:
        return _once(F.trim(value), lambda x: F.when(x != "", F.struct(x.alias("value"), F.lit(confidence).alias("confidence"), F.lit(provenance).alias("provenance"))))

    ld = [some(F.regexp_extract(html, rf'(?is)<script\b[^>]*application/ld\+json[^>]*>(?:(?!</script).)*?"{key}"\s*:\s*"([^"]+)"', 1), "exact", "jsonld:datePublished") for key in LD_DATES]
    metas = [some(_attribute(html, "meta", "property|name|itemprop", key.replace(".", r"\."), "content"), sure, f"meta:{key}") for key, sure in META_DATES.items()]
    day = [F.regexp_extract(url, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:/|-|\z)", i) for i in (1, 2, 3)]
    path = F.when(day[0] != "", F.concat_ws("-", day[0], F.lpad(day[1], 2, "0"), F.lpad(day[2], 2, "0")))
    time = F.regexp_extract(html, r"""(?is)<time\b[^>]*\bdatetime\s*=\s*["']([^"']+)["']""", 1)
    return F.coalesce(*ld, *metas, some(time, "day", "time[datetime]"), some(path, "inferred", "url:path-date"))


def plausible(ts: Column) -> Column:
    """Epoch seconds from 1990 to a year from now; null outside."""
    return F.when((ts >= 631152000) & (ts <= F.unix_timestamp(F.current_timestamp()) + 366 * 86400), ts)


def plain_marks(text: Column) -> Column:
    """text with typographic quotes, dashes and blanks as their plain ones, and the ellipsis as three full stops."""
    return F.replace(F.translate(text, "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2212\u00a0", "''\'\"\"\"--- "), F.lit("\u2026"), F.lit("..."))


def quoted(text: Column) -> Column:
    """text for a query string: what isn't a letter, a digit or one of -._~ by its bytes in percent form."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
