"""String functions as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORDS_LEAST = 6


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bill_number(x) -> Column:
    """Canonical "PREFIX N[SUFFIX]" of an identifier, null if it has no such form."""
    compact = F.regexp_replace(F.upper(F.regexp_replace(col(x), r"[^A-Za-z0-9\s]", "")), r"\s+", "")
    pattern = "^([A-Z]*)0*([0-9]+)([A-Z]*)$"
    prefix, digits, suffix = (F.regexp_extract(compact, pattern, k) for k in (1, 2, 3))
    return F.when(compact.rlike(pattern), F.concat(prefix, F.when(prefix == "", "").otherwise(" "), digits, suffix))


def bill_number_or_raw(x) -> Column:
    return F.coalesce(bill_number(x), F.upper(F.trim(col(x))))


def companion_number(x) -> Column:
    """White space collapsed and upper case only: no space is put in."""
    return F.upper(F.regexp_replace(col(x), r"\s+", " "))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def unslug(x) -> Column:
    return F.translate(col(x), "-", " ")


def session_key(x) -> Column:
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def years(x) -> Column:
    """Sorted years of a text; eight digits in a row are two."""
    runs = F.regexp_extract_all(col(x), F.lit("(?:19|20)[0-9]{2}(?:(?:19|20)[0-9]{2})?"), F.lit(0))
    both = F.transform(runs, lambda r: F.when(F.length(r) == 8, F.array(F.substring(r, 1, 4), F.substring(r, 5, 4))).otherwise(F.array(r)))
    return F.array_sort(F.array_distinct(F.flatten(both)))


def ordinals(x) -> Column:
    """Numbers of one to three digits that stand alone; three digits that end in 1 or 2 and are the whole text are a legislature and its called session."""
    called = F.regexp_extract(F.trim(col(x)), "^([0-9]{2})([12])$", 1)
    index = F.regexp_extract(F.trim(col(x)), "^([0-9]{2})([12])$", 2)
    found = F.array_distinct(F.regexp_extract_all(col(x), F.lit("(?<![0-9])([0-9]{1,3})(?:st|nd|rd|th)?(?![0-9])"), F.lit(1)))
    return F.when(called != "", F.array(called, index)).otherwise(found)


def session_class(x) -> Column:
    key = F.lower(col(x))
    return F.when(key.rlike("special|extra|called|^s[0-9]|[0-9]s[0-9]|[0-9]e$"), "special").when(key.rlike("fiscal|budget"), "fiscal").otherwise("regular")


def list_repr(x) -> Column:
    """The texts of a list as a program prints it; anything else is a list of itself, null and blank an empty one."""
    inner = F.regexp_extract(F.trim(col(x)), r"^\[(.*)\]$", 1)
    quoted = F.regexp_extract_all(inner, F.lit("""'([^']*)'|"([^"]*)\""""), F.lit(0))
    items = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.when(F.coalesce(F.trim(col(x)), F.lit("")) == "", F.array().cast("array<string>")).when(F.trim(col(x)).rlike(r"^\[.*\]$"), items).otherwise(F.array(col(x)))


def vote_detail(organisation, motion, result, yes, no) -> Column:
    """"Org: Motion -- result Y-N", without empty parts."""
    blank = lambda c: F.when(F.trim(col(c)) != "", F.trim(col(c)))
    head = F.concat_ws(": ", blank(organisation), blank(motion))
    tail = F.concat_ws(" ", blank(result), F.when(col(yes).isNotNull() & col(no).isNotNull(), F.concat_ws("-", col(yes).cast("string"), col(no).cast("string"))))
    return F.concat_ws(" -- ", F.nullif(head, F.lit("")), F.nullif(tail, F.lit("")))


def status_detail(old, new) -> Column:
    return F.concat_ws(" -> ", F.coalesce(col(old), F.lit("unknown")), F.coalesce(col(new), F.lit("unknown")))


def action_detail(added, revised) -> Column:
    """"n action(s) added, m revised", without what didn't happen; null if nothing did."""
    parts = F.when(col(added) > 0, F.concat(col(added).cast("string"), F.lit(" action(s) added"))), F.when(col(revised) > 0, F.concat(col(revised).cast("string"), F.lit(" revised")))
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def plain_text(x) -> Column:
    """No NUL, LF line ends, no blanks at line ends, at most one blank line in a row, no line ends around."""
    out = F.regexp_replace(F.translate(col(x), "\0", ""), "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t\f\u000b]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[ \t]+$", ""), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def xml_text(x) -> Column:
    """End tags end lines, other tags go."""
    return plain_text(F.regexp_replace(F.regexp_replace(col(x), "</[^>]*>", "\n"), "<[^>]*>", ""))


def visible_text(x) -> Column:
    """A page's text without scripts, styles and tags, white space collapsed."""
    out = F.regexp_replace(col(x), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "(?s)<[^>]+>", " "), r"\s+", " "))


def page_key(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), r"[^a-z0-9\s]", ""), r"\s+", " "))


def sniffed(header, url, body) -> Column:
    """Kind of a fetched body: by header, by the path's extension, by its first characters."""
    h, path, head = F.lower(F.coalesce(col(header), F.lit(""))), F.lower(F.coalesce(F.regexp_extract(col(url), r"^[a-z]+://[^/]*([^?#]*)", 1), F.lit(""))), F.lower(F.ltrim(F.substring(col(body), 1, 256)))
    by_header = F.when(h.contains("pdf"), "pdf").when(h.contains("html"), "html").when(h.contains("xml"), "xml").when(h.startswith("text/plain"), "plain")
    by_path = F.when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.(html?|aspx?|php)$"), "html").when(path.endswith(".xml"), "xml").when(path.endswith(".txt"), "plain")
    by_head = F.when(head.startswith("%pdf"), "pdf").when(head.startswith("<?xml"), "xml").when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
    return F.coalesce(by_header, by_path, by_head, F.lit("unknown"))


def long_words(x, stop: list[str]) -> Column:
    """Distinct lower-case words of six letters and more that aren't stop words, in order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(col(x)), F.lit(f"[a-z]{{{WORDS_LEAST},}}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>"))


def longest_word(x, stop: list[str]) -> Column:
    """The first of the longest."""
    words = long_words(x, stop)
    most = F.array_max(F.transform(words, lambda w: F.length(w)))
    return F.get(F.filter(words, lambda w: F.length(w) == most), 0)


def xml_safe(x) -> Column:
    return F.regexp_replace(col(x), "[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]", "")


def cut(x, most: int) -> Column:
    return F.substring(col(x), 1, most)


def lines(x) -> Column:
    return F.filter(F.transform(F.split(col(x), "\r\n|\r|\n"), lambda t: F.trim(t)), lambda line: line != "")


def truth(x) -> Column:
    """true, 1, t and yes; anything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(col(x))).isin("true", "1", "t", "yes"), F.lit(False))


def ocd_id(code) -> Column:
    kind = F.when(F.lower(col(code)) == "dc", "district").otherwise("state")
    return F.concat(F.lit("ocd-division/country:us/"), kind, F.lit(":"), F.lower(col(code)))


def canonical_list(x) -> Column:
    """A comma-separated list, sorted and without repetitions."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(col(x), ","), lambda t: F.trim(t)), lambda t: t != ""))), ",")


# Answers of a receiver that will be the same next time.
HARD_STATUSES = (400, 401, 403, 404, 405, 406, 411, 413, 414, 415, 422)


def error_class(status) -> Column:
    """Class of a delivery attempt by its HTTP status; null is a transport error. Rate limits and other client errors that may pass have classes of their own, so that they neither count towards a run of hard ones nor hide in one."""
    s = col(status)
    kinds = F.when(s.isNull(), "transport").when(s.between(200, 299), "ok").when(s == 410, "gone").when(s == 429, "limited")
    return kinds.when(s.isin(*HARD_STATUSES), "hard").when(s.between(400, 499), "retryable").when(s >= 500, "soft").otherwise("redirect")


def admissible_url(x) -> Column:
    """A lower-case host's https URL without credentials or a port of its own; null if it isn't admitted."""
    pattern = r"^https://([A-Za-z0-9.-]+)(?::443)?(/[^\s]*)?$"
    host, path = F.lower(F.regexp_extract(col(x), pattern, 1)), F.regexp_extract(col(x), pattern, 2)
    named = host.rlike(r"[a-z]") & host.contains(".") & ~host.rlike(r"(^|\.)(localhost|local|internal)$")
    return F.when(col(x).rlike(pattern) & named, F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path)))


def url_parameter(url, name: str) -> Column:
    return F.nullif(F.regexp_extract(col(url), f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def citation(identifier, code, session, title, status, snapshot) -> Column:
    """One line that cites a record; a derived status is called that."""
    derived = F.when(col(status).isNotNull(), F.concat(F.lit("status (derived): "), col(status))).otherwise("status: not determined")
    return F.concat_ws(", ", F.concat_ws(" ", col(code), col(identifier)), F.concat(F.lit("session "), col(session)), F.concat(F.lit('"'), F.substring(col(title), 1, 160), F.lit('"')), derived, F.concat(F.lit("snapshot "), col(snapshot)))


# What the letters of an identifier stand for.
SPELLED = {"HB": "House Bill", "SB": "Senate Bill", "AB": "Assembly Bill", "HR": "House Resolution", "SR": "Senate Resolution", "HJR": "House Joint Resolution", "SJR": "Senate Joint Resolution", "LD": "Legislative Document"}


def spelled_out(identifier: Column) -> Column:
    """The identifier with its letters spelled out, null for letters that aren't known."""
    table = F.create_map(*(F.lit(x) for item in SPELLED.items() for x in item))
    parts = F.regexp_extract(F.upper(identifier), r"^\s*([A-Z]+)", 1), F.regexp_extract(identifier, r"(\d+)\s*$", 1)
    return F.concat(F.try_element_at(table, parts[0]), F.lit(" "), F.nullif(parts[1], F.lit("")))


def status_note(status: Column) -> Column:
    """A full-text outcome as the note that rows carry."""
    return F.concat(F.lit("fulltext_status="), status)


def noted_status(note: Column) -> Column:
    """The outcome that a note holds, null if it holds none."""
    return F.nullif(F.regexp_extract(note, r"(?:^|;)\s*fulltext_status=([^;]*)", 1), F.lit(""))


def topic_hint(patterns: Column) -> Column:
    """The first of a topic's patterns without its wild cards."""
    return F.trim(F.regexp_replace(F.get(patterns, F.lit(0)), "%", " "))


def search_url(base: str, kind: str, key: Column) -> Column:
    """Permalink of a record, or the place of its file."""
    return F.concat(F.lit(f"{base.rstrip('/')}/{kind}/"), key.cast("string"), F.lit("" if kind == "bills" else ".json"))


#: Suffixes of two labels under which domains are registered; all others have one (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "gov.au", "org.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")


def registrable_domain(host: Column) -> Column:
    """The domain that somebody registered: a label and its public suffix; null for addresses and single labels."""
    labels = F.filter(F.split(F.lower(F.trim(host)), "[.]"), lambda x: x != "")
    n = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
    own = F.when(two.isin(*TWO_LABELS), F.when(n > 2, F.concat_ws(".", F.slice(labels, F.greatest(n - 2, F.lit(1)), 3)))).otherwise(two)
    return F.when((n > 1) & ~host.rlike(r"^[\d.]+$|:"), own)


@F.pandas_udf(StringType())
def address_bucket(forwarded: pd.Series) -> pd.Series:
    """Whom a request counts for: of the forwarded hops, from the right, the first public one; IPv4 as it is, also if embedded, IPv6 by its /64."""
    import ipaddress

    def read(value):
        for hop in reversed((value or "").split(",")):
            try:
                address = ipaddress.ip_address(hop.strip().strip("[]"))
            except ValueError:
                continue
            address = getattr(address, "ipv4_mapped", None) or address
            if address.is_global:
                return str(address) if address.version == 4 else str(ipaddress.ip_network((address, 64), strict=False))
        return None

    return forwarded.map(read)
