"""Word lists and patterns that the text functions use; another domain passes its own Lexicon."""

from __future__ import annotations

from dataclasses import dataclass

# They must be these for results to match published figures.
STOP_WORDS = tuple(
    """
a an the and or of to in on at for by with from as into over amid after before
is are was were be been being has have had will would may might could can
says said say according report reports reported new next last this that these
its it their than more most up down out about against via per year years month
months week weeks percent pct mln million billion bn usd us dollar dollars php
philippines philippine ph phl pilipinas filipino filipinos country nation local
government gov govt official officials data
и в на по за от до из для что как это его их при об не но уже ещё году года
филиппины филиппин филиппинах филиппинский филиппинская
""".split()
)

# Fixed values: (pattern, replacement), applied in this order, each to the whole text.
PHRASES = (
    (r"free[\s-]+trade[\s-]+(agreement|deal|pact|accord)s?", " fta "),
    (r"european union", " eu "),
    (r"asian development bank", " adb "),
    (r"department of agriculture", " da "),
    (r"bureau of animal industry", " bai "),
    (r"bureau of customs", " boc "),
    (r"philippine statistics authority", " psa "),
    (r"department of trade and industry", " dti "),
    (r"united states department of agriculture|us department of agriculture", " usda "),
    (r"bangko sentral( ng pilipinas)?", " bsp "),
    (r"african swine fever", " asf "),
    (r"metric tons?|tonnes?", " mt "),
    (r"all[\s-]time high|35[\s-]year high|record[\s-]high|highest", " record "),
    (
        r"\bhikes?\b|\bincreases?\b|\braises?\b|\bclimbs?\b|\bsoars?\b|\bsurges?\b|\bjumps?\b|\brises?\b|\brising\b",
        " rise ",
    ),
    (r"\bcuts?\b|\bslash(es|ed)?\b|\blowers?\b|\btrims?\b", " cut "),
    (r"\boutlook\b|\bforecasts?\b|\bprojections?\b", " forecast "),
    (r"\bshipments?\b|\boutbound\b", " export "),
)

# Fixed values: (suffix, replacement); the first whose length guard holds and that matches is cut.
SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))
# What a word and a telling number look like.
TOKEN = r"[a-zа-яё][a-zа-яё']*[a-zа-яё]"
NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)\s*(%|percent|b\b|bn\b|billion|m\b|mn\b|million|k\b)?"

# Hosts of first sources (by ending) and of aggregators (by substring).
PRIMARY_DOMAINS = ("gov.ph", "adb.org", "worldbank.org", "usda.gov", "fao.org")
AGGREGATOR_DOMAINS = ("msn.com", "news.google.", "yahoo.com", "tradersunion.com", "canadianinquirer.net")


@dataclass(frozen=True)
class Lexicon:
    stop_words: tuple[str, ...] = STOP_WORDS
    phrases: tuple[tuple[str, str], ...] = PHRASES
    suffixes: tuple[tuple[str, str], ...] = SUFFIXES
    primary_domains: tuple[str, ...] = PRIMARY_DOMAINS
    aggregator_domains: tuple[str, ...] = AGGREGATOR_DOMAINS


DEFAULT = Lexicon()
