"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tokens leave out, for the four languages of the corpus.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "de", "la", "le", "et", "der", "die", "und", "el", "que", "en")


def tokens(text: Column, least: int = 2, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of ASCII letters and digits, in order, of `least` characters or more, without stop words."""
    stop_list = F.array(*[F.lit(x) for x in stop]) if stop else F.array().cast("array<string>")
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) >= least) & ~F.array_contains(stop_list, x))


def unicode_tokens(text: Column, least: int = 2) -> Column:
    """As `tokens`, over letters and digits of any script."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) >= least)


def bigrams(words: Column) -> Column:
    """Neighbouring tokens joined by an underscore."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws("_", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def collapse(text: Column) -> Column:
    """White space of any script collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space, and at line ends; trimmed, empty ones left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def bounded(claim: Column, most: int = 700, least: int = 20) -> Column:
    """A claim of at most `most` characters, cut at its last white space where it is longer; where that would leave fewer than `least`, in the word."""
    cut = F.substring(claim, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*)[ \t\r\n]", 1)
    return F.when(F.length(claim) <= most, claim).when(F.length(whole) >= least, F.regexp_replace(whole, r"[ \t\r\n]+$", "")).otherwise(cut)


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """The words of the list that the text holds, in the list's order, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.instr(low, w) > 0, F.lit(w)) for w in words]))


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+|\D+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))).otherwise(p))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces, common entities their characters."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def public_host(host: Column) -> Column:
    """Whether a host is neither empty nor local: `localhost`, `.local` names and private, loopback or link-local IPv4 literals aren't public. Names aren't resolved."""
    low = F.lower(F.coalesce(host, F.lit("")))
    private = low.rlike(r"^(0|10|127)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    return (F.length(low) > 0) & (low != "localhost") & ~low.endswith(".local") & ~(low.rlike(r"^[0-9.]+$") & private)


def assembled(*fields: Column) -> Column:
    """Fields joined by single spaces; nulls are left out."""
    return F.concat_ws(" ", *[f.cast("string") for f in fields])


def host_allowed(url: Column, hosts: Sequence[str]) -> Column:
    """Whether a URL is https and its host is one of the list or below one."""
    host = url_host(url)
    below = [(host == h) | host.endswith(f".{h}") for h in hosts]
    allowed = F.lit(False)
    for x in below:
        allowed = allowed | x
    return F.lower(F.coalesce(url, F.lit(""))).startswith("https://") & allowed


def fact_key(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24)


def token_estimate(text: Column) -> Column:
    """Model tokens a text costs: a quarter of its length, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def bucket(key: Column, modulus: int = 100) -> Column:
    """Stable bucket from the first eight hex digits of a key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % modulus).cast("int")


def safe_path(path: Column, most: int = 118) -> Column:
    """Each segment without characters that file systems refuse, trimmed and bounded; empty segments go."""
    parts = F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: F.substring(F.trim(F.regexp_replace(F.regexp_replace(p, r'[\\:*?"<>|\x00-\x1f]', " "), r"\s+", " ")), 1, most))
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def heading(text: Column, most: int = 180) -> Column:
    """The first line that isn't blank, trimmed and bounded; null without one."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.substring(F.get(lines, F.lit(0)), 1, most)


def public_link(base: str, path: Column) -> Column:
    """A base URL followed by a path whose segments are percent-encoded."""
    parts = F.transform(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(parts, "/"))


def http_date(text: Column) -> Column:
    """A date of HTTP headers (`Tue, 15 Nov 1994 08:12:31 GMT`) in ISO form, UTC; null for anything else."""
    bare = F.regexp_extract(F.coalesce(text, F.lit("")), r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    return F.date_format(F.try_to_timestamp(F.when(F.length(bare) > 0, bare), F.lit("dd MMM yyyy HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_sentences(text: Column, most: int) -> Column:
    """The text if it fits, else its start up to the last end of a sentence within `most` characters; without one, cut there."""
    clean = collapse(text)
    head = F.substring(clean, 1, most)
    full = F.regexp_extract(head, r"^(.*[.!?])(\s|$)", 1)
    return F.when(F.length(clean) <= most, clean).when(F.length(full) > 0, full).otherwise(F.rtrim(head))


def like_prefix(text: Column, prefix: str) -> Column:
    """Whether a text begins with prefix as LIKE sees it: ASCII case aside, an underscore in prefix stands for any character."""
    return F.lower(text).like(prefix.lower() + "%")


def narrative(text: Column) -> Column:
    """A text without markup: code fences, headings, emphasis, list marks and links' targets go, lines are single-spaced."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"```[a-zA-Z]*", " ")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(#{1,6}|[-*+]|[0-9]+\.)[ \t]+", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*_`]{1,3}", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def normal_name(name: Column) -> Column:
    """A file name for comparison: lower case, without extension, other characters than letters and digits as single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\.[a-z0-9]{1,5}$", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def title_case(name: Column) -> Column:
    """Runs of ASCII letters and digits of a name, each capitalised, single-spaced; null where there are none."""
    runs = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    return F.when(F.length(runs) > 0, F.initcap(runs))


def redacted(text: Column) -> Column:
    """Text with addresses and long numbers replaced."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(out, r"[0-9]{8,}", "[number]")


def last_year(text: Column) -> Column:
    """The last year from 1900 to 2099 that a text names, as a string; null without one."""
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    years = F.filter(numbers, lambda x: x.rlike("^(19|20)[0-9]{2}$"))
    return F.get(years, F.size(years) - 1)
