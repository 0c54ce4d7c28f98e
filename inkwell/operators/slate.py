"""Slate construction: a greedy choice of cards for each session that spaces voices, domains and ecosystems.

A session's pool is small by construction (ten windows of cards), so a session is one group and one Python call; the
sessions spread over the cluster. Within a session the choice is sequential: every card changes what the next one costs.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.basics import clamp, uniform
from inkwell.operators.ranking import Settings, round_robin
from inkwell.sources.views import DAY

# Penalties of a card's tier, spacing in cards, cost of repeats.
NEAR_VOICE, NEAR_DOMAIN, NEAR_CLUSTER = 7, 4, 12
ADJACENT, VOICE_SOON, DOMAIN_SOON, DOMAIN_SHARE, VOICE_SHARE, CLUSTER_SOON = 10_000, 4_000, 3_000, 2_000, 1_000, 10
SCREEN = 12


@dataclass(frozen=True)
class Card:
    id: int
    topic: str
    domain: str
    author: str = ""
    cluster: str = ""

    @property
    def voice(self) -> str:
        return self.author or f"site:{self.domain}"


def water_fill(topics: list[str], cards: list[Card], limit: int) -> dict[str, int]:
    """Seats of each topic: dealt in turn, level by level, until the limit or the supply is reached."""
    supply = Counter(c.topic for c in cards)
    quotas = dict.fromkeys(topics, 0)
    seats = min(max(0, limit), sum(supply[t] for t in quotas))
    level = 0
    while seats:
        level += 1
        for t in quotas:
            if seats and supply[t] >= level:
                quotas[t] += 1
                seats -= 1
    return quotas


def fair_cap(counts: list[int], slots: int) -> int:
    """The least cap with which the capped counts fill the slots."""
    cap = 0
    while sum(min(n, cap) for n in counts) < min(slots, sum(counts)):
        cap += 1
    return cap


def domain_supply(cards: list[Card], cap: int, demand: dict[str, int]) -> int:
    """The most cards of capped domains that fit the demand, as the least cut over the sets of topics."""
    topics = list(demand)
    own: dict[str, Counter] = {}
    for c in cards:
        if c.topic in demand:
            own.setdefault(c.domain, Counter())[c.topic] += 1
    best = None
    for mask in range(1 << len(topics)):
        out = [t for i, t in enumerate(topics) if not mask >> i & 1]
        cut = sum(n for i, n in enumerate(demand.values()) if mask >> i & 1) + sum(min(cap, sum(n[t] for t in out)) for n in own.values())
        best = cut if best is None else min(best, cut)
    return best or 0


def domain_cap(cards: list[Card], demand: dict[str, int]) -> int:
    need = sum(demand.values())
    cap = fair_cap(list(Counter(c.domain for c in cards).values()), need)
    while cap < need and domain_supply(cards, cap, demand) < need:
        cap += 1
    return cap


def voice_supply(cards: list[Card], voice_cap: int, domain_cap_: int) -> int:
    """The most cards when both voices and domains are capped: a maximum flow along shortest paths."""
    pairs = Counter((c.voice, c.domain) for c in cards)
    out = Counter(v for v, _ in pairs.elements())
    into = Counter(d for _, d in pairs.elements())
    capacity: dict[tuple, int] = {}
    near: dict[tuple, set] = {}

    def link(a: tuple, b: tuple, n: int) -> None:
        capacity[a, b] = n
        capacity.setdefault((b, a), 0)
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    source, sink = ("s",), ("t",)
    for v, n in out.items():
        link(source, ("v", v), min(n, voice_cap))
    for d, n in into.items():
        link(("d", d), sink, min(n, domain_cap_))
    for (v, d), n in pairs.items():
        link(("v", v), ("d", d), n)
    flow = 0
    while True:
        came: dict[tuple, tuple] = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b in near.get(a, ()):
                if b not in came and capacity[a, b] > 0:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return flow
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        links = list(zip(path[1:], path, strict=False))
        amount = min(capacity[x] for x in links)
        for a, b in links:
            capacity[a, b] -= amount
            capacity[b, a] += amount
        flow += amount


def voice_cap(cards: list[Card], slots: int, domain_cap_: int) -> int:
    slots = min(slots, len(cards))
    cap = fair_cap(list(Counter(c.voice for c in cards).values()), slots)
    while cap < slots and voice_supply(cards, cap, domain_cap_) < slots:
        cap += 1
    return cap


class _Run:
    """What one pass over a pool has chosen so far."""

    def __init__(self, pool: list[Card], limit: int, topics: list[str], prior: list[Card]):
        self.pool, self.limit, self.prior = list(pool), limit, prior
        horizon = max(SCREEN, math.ceil(max(0, limit) * 2 / 3)) if prior else max(0, limit)
        demand = Counter(water_fill(topics, self.pool, min(horizon, len(self.pool))))
        for c in prior:
            demand[c.topic] += 1
        every = [*prior, *self.pool]
        self.domain_cap = domain_cap(every, dict(demand))
        self.voice_cap = voice_cap(every, sum(demand.values()), self.domain_cap) if prior else math.inf
        self.quotas = water_fill(topics, self.pool, limit)
        voices: dict[str, set[str]] = {}
        domains: dict[str, set[str]] = {}
        for c in self.pool:
            voices.setdefault(c.voice, set()).add(c.topic)
            domains.setdefault(c.domain, set()).add(c.topic)
        self.breadth = {c.id: (len(domains[c.domain]), len(voices[c.voice])) for c in self.pool}
        self.seen: Counter = Counter()
        self.last: dict[tuple[str, str], int] = {}
        self.taken: Counter = Counter()
        self.rolling: Counter = Counter(dict.fromkeys(topics, 0))
        for i, c in enumerate(prior):
            self._place(c, i - len(prior), c.topic in self.quotas)

    def _place(self, c: Card, at: int, counts: bool) -> None:
        for kind, key in (("a", c.author), ("d", c.domain)):
            if key:
                self.seen[kind, key] += 1
                self.last[kind, key] = at
        if c.cluster:
            self.last["c", c.cluster] = at
        if counts:
            self.rolling[c.topic] += 1

    def tier(self, c: Card, at: int) -> tuple[int, int]:
        """(tier, cost of repeats) of a card at a place; 0 is the best tier."""
        voice, domain = ("a", c.author) if c.author else ("d", c.domain), ("d", c.domain)
        v, d = self.seen[voice], self.seen[domain]
        gap_v = at - self.last.get(voice, -math.inf) if voice[1] else math.inf
        gap_d = at - self.last.get(domain, -math.inf) if c.domain else math.inf
        gap_c = at - self.last.get(("c", c.cluster), -math.inf) if c.cluster else math.inf
        novelty = (0 if not d else 1) if not v else (2 if not d else 3)
        total = 2 * novelty
        total += VOICE_SOON * (gap_v < NEAR_VOICE) + DOMAIN_SOON * (gap_d < NEAR_DOMAIN) + CLUSTER_SOON * (gap_c < NEAR_CLUSTER)
        total += ADJACENT * (gap_v == 1 or gap_d == 1) + DOMAIN_SHARE * (d >= self.domain_cap) + VOICE_SHARE * (v >= self.voice_cap)
        return total, v * 1000 + d * 100 + 800 * (gap_d == 1) + 400 * (gap_v == 1)

    def choose(self, at: int) -> int | None:
        """Index of the next card: the least (tier, domain breadth, voice breadth, cost), the first of equals."""
        open_topics = [t for t, q in self.quotas.items() if self.taken[t] < q]
        if not open_topics:
            return None
        ahead = min(self.rolling[t] for t in open_topics) + 1
        best, found = None, None
        for i, c in enumerate(self.pool):
            if self.taken[c.topic] >= self.quotas.get(c.topic, 0) or self.rolling[c.topic] > ahead:
                continue
            tier, repeats = self.tier(c, at)
            domains, voices = self.breadth[c.id]
            if (tier, domains, voices) == (0, 1, 1):
                return i
            rank = (tier, domains, voices, repeats + i / max(1, len(self.pool)))
            if best is None or rank < best:
                best, found = rank, i
        return found

    def cards(self) -> list[Card]:
        out: list[Card] = []
        while len(out) < self.limit and self.pool:
            i = self.choose(len(out))
            if i is None:
                break
            c = self.pool.pop(i)
            self._place(c, len(out), True)
            self.taken[c.topic] += 1
            out.append(c)
        return out


def _swapped(slate: list[Card], unused: list[Card], prior: list[Card], most_voice: float, most_domain: int) -> list[Card] | None:
    """The slate with cards over a cap exchanged for unused ones under it, topic by topic; None if nothing changed."""
    slate, unused = list(slate), list(unused)
    voices = Counter(c.voice for c in [*prior, *slate])
    domains = Counter(c.domain for c in [*prior, *slate])
    clusters = Counter(c.cluster for c in [*prior, *slate] if c.cluster)
    changed = False

    def count(c: Card, n: int) -> None:
        voices[c.voice] += n
        domains[c.domain] += n
        if c.cluster:
            clusters[c.cluster] += n

    def exchange(at: int, rank, settles) -> bool:
        """Put the best fitting unused card at a place. rank(card) orders them; settles(rank) ends the search."""
        nonlocal changed
        old = slate[at]
        count(old, -1)
        best, found = None, None
        for i, c in enumerate(unused):
            if c.topic != old.topic or voices[c.voice] >= most_voice or domains[c.domain] >= most_domain:
                continue
            r = rank(c)
            if r is None or best is not None and r >= best:
                continue
            best, found = r, i
            if settles(c, r):
                break
        if found is None:
            count(old, 1)
            return False
        slate[at] = unused.pop(found)
        unused.append(old)
        count(slate[at], 1)
        changed = True
        return True

    for _ in range(2 * len(slate)):
        over = (i for i in range(len(slate) - 1, -1, -1) if voices[slate[i].voice] > most_voice or domains[slate[i].domain] > most_domain)
        if not any(exchange(i, lambda c: clusters[c.cluster] if c.cluster else 0, lambda c, r: r == 0) for i in over):
            break
    most = max(1, math.ceil((len(prior) + len(slate)) / SCREEN))
    for i in range(len(slate) - 1, -1, -1):
        if not slate[i].cluster or clusters[slate[i].cluster] <= most:
            continue
        place = iter(range(0, -len(unused) - 2, -1))  # of clustered ones the last that fits, so later ones rank first
        exchange(i, lambda c, p=place: None if c.cluster and clusters[c.cluster] >= most else next(p), lambda c, r: not c.cluster)
    return slate if changed else None


def build_slate(pool: list[Card], limit: int, topics: list[str], prior: list[Card] | None = None) -> list[Card]:
    """The session's cards in order. prior: cards shown just before; with them, caps are repaired once."""
    prior = prior or []
    topics = list(dict.fromkeys(topics))
    run = _Run(pool, limit, topics, prior)
    slate = run.cards()
    if prior:
        better = _swapped(slate, run.pool, prior, run.voice_cap, run.domain_cap)
        if better is not None:
            return _Run(better, limit, topics, prior).cards()
    return slate


COLUMNS = ["id", "topic", "domain", "author_key", "cluster"]


def cards_of(rows: pd.DataFrame) -> list[Card]:
    return [Card(int(r.id), r.topic, r.domain, r.author_key, r.cluster) for r in rows.itertuples()]


def diverse_slates(rows: DataFrame, limit: int, topics: list[str], settings: Settings, prior: DataFrame | None = None) -> DataFrame:
    """(session_id, position, id, topic, domain, author_key, cluster) from one row per session and eligible article.

    The keys, ranks and the cut to ten windows are windows in the JVM; only the cut pools reach Python. prior: the cards of
    a session's last screens (session_id, position, id, topic, domain, author_key, cluster), which are not given again and
    which the new ones continue.
    """
    age = F.greatest((F.lit(settings.now) - F.col("effective")) / float(DAY), F.lit(-30.0))
    boost = F.when(F.col("source_origin").isNull() | (F.col("source_origin") != settings.seed_origin), settings.discovery_boost).otherwise(1.0)
    key = F.greatest("quality", F.lit(0.05)) * (0.35 + 0.65 * F.col("topic_relevance")) * F.pow(F.lit(0.5), age / settings.half_life_days) * (0.75 + 0.5 * clamp(F.col("score"))) * boost
    drawn = F.round(key * uniform(F.concat(F.lit(settings.seed), F.lit("/"), F.col("session_id").cast("string")), F.col("id")), 9)
    if prior is not None:
        rows = rows.join(prior.select("session_id", "id"), ["session_id", "id"], "left_anti")
    pool = round_robin(rows.withColumn("ranking_key", drawn), 10 * limit, "session_id")
    pool = pool.select("session_id", F.col("position").alias("place"), "cost", *COLUMNS)
    schema = "session_id long, position long, id long, topic string, domain string, author_key string, cluster string"

    def built(session: int, group: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        shown = [] if before is None else cards_of(before.sort_values("position"))
        slate = build_slate(cards_of(group.sort_values(["cost", "place"])), limit, topics, shown)
        return pd.DataFrame([(session, i, c.id, c.topic, c.domain, c.author, c.cluster) for i, c in enumerate(slate)], columns=["session_id", "position", *COLUMNS])

    if prior is None:
        return pool.groupBy("session_id").applyInPandas(lambda key, group: built(key[0], group, None), schema)
    shown = prior.select("session_id", "position", *COLUMNS)
    return pool.groupBy("session_id").cogroup(shown.groupBy("session_id")).applyInPandas(lambda key, group, before: built(key[0], group, before), schema)
