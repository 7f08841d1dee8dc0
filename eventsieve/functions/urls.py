"""Url rules as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventsieve.functions.lexicon import DEFAULT, Lexicon
from eventsieve.functions.text import ends_with_any

# Campaign keys; below, the links that count as goals.
UTM_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def bare_host(url: Column) -> Column:
    """Lower-cased, without scheme and www., up to the first slash; port and query stay if none follows."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    return F.split_part(F.regexp_replace(lowered, r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1))


def source_rank(url: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """0 for a first source, 2 for an aggregator, else 1; a first source wins."""
    host = bare_host(url)
    aggregator = "|".join(map(re.escape, lexicon.aggregator_domains))
    return F.when(ends_with_any(host, lexicon.primary_domains), 0).when(host.rlike(aggregator), 2).otherwise(1)


def query_value(url: Column, key: str) -> Column:
    """The first value of a key of the query string, decoded; null if absent or empty."""
    found = F.regexp_extract(F.split_part(url, F.lit("#"), F.lit(1)), rf"\?(?:[^#]*&)?{re.escape(key)}=([^&#]*)", 1)
    return F.nullif(F.try_url_decode(found), F.lit(""))


def utm(url: Column) -> Column:
    """A map of the campaign keys that the url's query sets; empty if none."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), query_value(url, k).alias("v")) for k in UTM_KEYS])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def language(tag: Column) -> Column:
    return F.when(F.startswith(F.coalesce(tag, F.lit("")), F.lit("ru")), "ru").otherwise("en")


def click_goal(href: Column) -> Column:
    """The goal that a click on a link counts for, or null."""
    return (
        F.when(href.rlike(r"(?i)^mailto:"), "email_click")
        .when(href.rlike(r"(?i)wa\.me|whatsapp"), "whatsapp_click")
        .when(href.rlike(r"(?i)\.pdf(\?|#|$)"), "download")
    )


def click_file(href: Column) -> Column:
    """The file that a click on a link downloads, or null."""
    return F.when(click_goal(href) == "download", href)


# What counts as a web link and as an address in a text.
LINK = r"https?://[^\s<>\"')]+[^\s<>\"').,!?]"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"


def links(text: Column) -> Column:
    """array<struct<kind, value>> of web links and e-mail addresses in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LINK}|{EMAIL}"), F.lit(0))
    return F.transform(
        found, lambda v: F.struct(F.when(v.rlike("^https?://"), "link").otherwise("email").alias("kind"), v.alias("value"))
    )
