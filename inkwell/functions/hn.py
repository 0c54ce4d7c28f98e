"""Story lists: how playful and how readable a linked story is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.basics import matches, weighted
from inkwell.functions.urls import is_article_path, path

# Patterns and weights.
PLAYFUL = [
    (r"^show hn\b", 2),
    (r"\b(paint|draw|art|visual(?:ize|izing|ization)?|animation|game|map|music|piano|creative|design|3d)\w*", 3),
    (r"\b(i built|i made|i trained|building|making|training|experiment(?:ing)?|playing|exploring|from scratch|inside|how i)\b", 2),
    (r"\b(weird|tiny|accident(?:al|ally)?|unexpected|reverse.engineer(?:ing)?|interactive|simulat\w*|playground|toy|museum)\b", 2),
]
PRESS_PATH = r"(?i)/(?:press|press-release|newsroom)(?:/|$)"
WIRE = r"\b(acquires?|acquisition|agrees to acquire|introduces?|unveils?|shutting down|dies at|outage|state department|tariffs?|approves?|press release)\b"
LIST_HOSTS = ["news.ycombinator.com", "hnrss.org"]
NOT_BLOG = r"(?i)podcast|archive|changelog|release notes|recent additions|\bnews\b|status|jobs|roadmap|press release"


def playfulness(title: Column) -> Column:
    return weighted([(matches(F.lower(title), p), w) for p, w in PLAYFUL]).cast("int")


def selection_score(points: Column, title: Column) -> Column:
    return F.round(F.log2(F.greatest(F.lit(1), points) + 1) + playfulness(title) * 1.5, 9)


def article_score(points: Column, front: Column) -> Column:
    return F.when(points <= 0, 0.5).otherwise(F.round(F.least(F.lit(0.78), F.lit(0.54) + F.lit(0.018) * F.log2(points + 1) + F.when(front, 0.05).otherwise(0.0)), 9))


def is_readable(url: Column, title: Column) -> Column:
    """An article's address and a headline of four words or more that isn't wire news."""
    return is_article_path(url) & (F.regexp_count(title, F.lit(r"\S+")) >= 4) & ~path(url).rlike(PRESS_PATH) & ~matches(title, WIRE, True)


def is_list_host(host: Column) -> Column:
    out = host.isin(LIST_HOSTS)
    for h in LIST_HOSTS:
        out = out | host.endswith(f".{h}")
    return out
