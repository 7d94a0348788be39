"""Text expressions: trigram similarity, path parts, episode numbers, predicates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of media files, and the similarity above which titles match.
MEDIA_ENDINGS = ("webm", "mkv", "mp4")
TITLE_THRESHOLD = 0.3
#: Fixed value: how an account's address must look.
ADDRESS = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams, 0 if there are none."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def is_media_path(path: Column) -> Column:
    """A media file in a folder with a numeric name."""
    return path.rlike(r"(^|/)\d+/[^/]*\.(" + "|".join(MEDIA_ENDINGS) + r")$") & folder(path).rlike(r"^\d+$")


def episode_number(name: Column) -> Column:
    """The first of S01E02, EP 02, [02], ' - 02' and a number before the ending; 0 and none are null."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{2,4}$", "")
    found = [F.regexp_extract(stem, p, 1) for p in (r"[Ss]\d{1,2}[Ee](\d{1,4})", r"(?i)\bEP ?(\d{1,4})\b", r"\[(\d{1,4})\]", r" - (\d{1,4})(?:$|[ \[v])", r"(\d{1,4})$")]
    number = F.coalesce(*[F.nullif(x, F.lit("")) for x in found]).cast("int")
    return F.when(number > 0, number)


def is_email(text: Column) -> Column:
    return text.rlike(ADDRESS)


def is_safe_url(url: Column) -> Column:
    """http or https, and not a literal private, shared, loopback, link-local or multicast address.

    Also unsafe: addresses that are written as one number, in less than four parts, in octal or in hexadecimal, and IPv4
    addresses within IPv6 ones.
    """
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|198\.1[89]\.|(22[4-9]|2[345]\d)\.|\[(::|f[cdf][0-9a-f]*:|fe[89a-f][0-9a-f]*:|64:ff9b:|2002:|0*:))")
    numeric = host.rlike(r"^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+)){0,2}\.?$|^(0x[0-9a-f]*|\d+)(\.(0x[0-9a-f]*|\d+))*$") & ~host.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    return F.lower(url).rlike(r"^https?://") & (host != "") & ~private & ~numeric


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def fill_template(template: Column, **values: Column) -> Column:
    """Replace ``{{name}}`` by each value, escaped for HTML."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), escape_html(value))
    return template


def negotiate_format(accept: Column) -> Column:
    """The first of jxl and webp in the order of an Accept header, else jpeg."""
    kinds = F.transform(F.split(accept, ","), lambda x: F.trim(F.substring_index(x, ";", 1)))
    known = F.filter(kinds, lambda k: k.isin("image/jxl", "image/webp"))
    return F.coalesce(F.substring_index(F.try_element_at(known, F.lit(1)), "/", -1), F.lit("jpeg"))
