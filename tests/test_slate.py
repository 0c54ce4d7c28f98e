import random
from itertools import combinations

import pytest

from inkwell.operators.slate import Card, build_slate, domain_cap, domain_supply, fair_cap, voice_supply, water_fill
from inkwell.plans import catalog

TOPICS = ["technology", "economics", "math"]


def cards(n, domains, authors, seed=0, clusters=()):
    rng = random.Random(seed)
    return [Card(i, TOPICS[i % 3], f"d{rng.randrange(domains)}", f"a{rng.randrange(authors)}" if authors else "", rng.choice(clusters) if clusters else "") for i in range(n)]


def diverse_opening(slate, topics, opening=12):
    head = slate[:opening]
    counts = [sum(c.topic == t for c in slate) for t in topics]
    return len(head) == len({c.voice for c in head}) == len({c.domain for c in head}) == opening and max(counts) - min(counts) <= 1


def flow_by_search(supply, cap, demand):
    """The most cards by trying every number per domain and topic."""
    best = 0
    domains = list(supply)

    def go(k, left):
        nonlocal best
        if k == len(domains):
            best = max(best, sum(demand.values()) - sum(left.values()))
            return
        own = supply[domains[k]]
        for a in range(min(own.get("x", 0), left["x"], cap) + 1):
            for b in range(min(own.get("y", 0), left["y"], cap - a) + 1):
                go(k + 1, {"x": left["x"] - a, "y": left["y"] - b})

    go(0, dict(demand))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_cut_form_is_the_flow(seed):
    rng = random.Random(seed)
    pool = [Card(i, rng.choice("xy"), f"d{rng.randrange(3)}") for i in range(rng.randrange(1, 10))]
    supply = {}
    for c in pool:
        supply.setdefault(c.domain, {}).setdefault(c.topic, 0)
        supply[c.domain][c.topic] += 1
    demand = {"x": rng.randrange(4), "y": rng.randrange(4)}
    for cap in range(4):
        assert domain_supply(pool, cap, demand) == flow_by_search(supply, cap, demand)


def test_voice_supply_is_bounded_by_both_caps():
    pool = [Card(i, "x", "d0" if i < 4 else f"d{i}", f"a{i % 2}") for i in range(8)]
    assert voice_supply(pool, 8, 8) == 8
    assert voice_supply(pool, 1, 8) == 2
    assert voice_supply(pool, 8, 1) == 5


def test_quotas_are_dealt_in_turn():
    pool = [Card(i, "technology" if i < 9 else "math", f"d{i}") for i in range(11)]
    assert water_fill(TOPICS, pool, 6) == {"technology": 4, "economics": 0, "math": 2}
    assert fair_cap([9, 1, 1], 5) == 3


@pytest.mark.parametrize("seed", range(8))
def test_a_slate_keeps_its_hard_rules(seed):
    pool = cards(200, 60, 80, seed, ["", "", "py"])
    slate = build_slate(pool, 36, TOPICS)
    assert len({c.id for c in slate}) == len(slate) == 36
    assert all(sum(c.topic == t for c in slate) == 12 for t in TOPICS)
    for n in range(1, 37):
        counts = [sum(c.topic == t for c in slate[:n]) for t in TOPICS]
        assert max(counts) - min(counts) <= 2
    assert diverse_opening(slate, TOPICS)
    assert all(a.domain != b.domain for a, b in zip(slate, slate[1:]))
    assert max(sum(c.domain == d for c in slate) for d in {c.domain for c in slate}) <= domain_cap(pool, water_fill(TOPICS, pool, 36))


def test_prior_cards_are_continued():
    prior = [Card(1000 + i, TOPICS[i % 3], f"d{i}", f"a{i}") for i in range(6)]
    pool = [Card(i, TOPICS[i % 3], f"d{i % 30}", f"a{i % 30}") for i in range(90)]
    slate = build_slate(pool, 12, TOPICS, prior)
    assert len(slate) == 12 and slate[0].domain not in {"d5", "d4"}
    assert len({c.voice for c in slate[:6]} & {c.voice for c in prior}) == 0


def test_flexible_voices_are_kept_for_later():
    pool = [Card(1, "economics", "both", "flex"), Card(2, "economics", "e", "eve"), Card(3, "math", "both", "flex")]
    assert [c.id for c in build_slate(pool, 2, ["economics", "math"])] == [2, 3]


def test_short_and_empty_pools():
    assert build_slate([], 5, TOPICS) == []
    assert [c.id for c in build_slate([Card(7, "math", "d")], 5, ["math"])] == [7]
    assert not diverse_opening([], TOPICS)


def test_slates_of_sessions(spark, small):
    rows = catalog.queries()["diverse_slate"](spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.session_id, []).append(r)
    for own in by.values():
        ids = [r.id for r in sorted(own, key=lambda r: r.position)]
        assert len(ids) == len(set(ids)) <= 36
        counts = [sum(r.topic == t for r in own) for t in TOPICS]
        assert max(counts) <= 36
    assert all(a != b for a, b in combinations([tuple(r.id for r in sorted(v, key=lambda r: r.position)) for v in by.values()], 2))


# Cards of known results: what a slate must do beside cards shown just before, and how topics and voices share it.


def card(id_, domain, author, topic="economics", cluster=""):
    return Card(id_, topic, domain, author, cluster)


def ids(slate):
    return [c.id for c in slate]


def test_a_prolific_publication_gives_two_cards_where_supply_allows():
    pool = [card(d * 10 + k, f"site-{d}", f"writer-{d}-{k}") for d in range(20) for k in range(3)]
    slate = build_slate(pool, 36, ["economics"])
    assert max(sum(c.domain == f"site-{d}" for c in slate) for d in range(20)) == 2


def test_few_domains_share_the_slate_evenly():
    pool = [card(d * 100 + k, f"site-{d}", f"writer-{d}-{k}") for d in range(5) for k in range(10)]
    slate = build_slate(pool, 25, ["economics"])
    assert sorted(sum(c.domain == f"site-{d}" for c in slate) for d in range(5)) == [5] * 5


def test_a_domain_of_two_topics_is_kept_for_the_one_that_needs_it():
    pool = [card(1, "shared", "a", "technology"), card(2, "unique", "b", "technology"), card(3, "shared", "c", "economics")]
    assert ids(build_slate(pool, 2, ["technology", "economics"])) == [2, 3]


def test_a_voice_of_two_topics_is_kept_for_the_one_that_needs_it():
    pool = [card(1, "st", "shared", "technology"), card(2, "et", "own", "technology"), card(3, "se", "shared", "economics")]
    assert ids(build_slate(pool, 2, ["technology", "economics"])) == [2, 3]


def test_domains_are_fair_within_each_topic():
    pool = [card(i + 1, f"tech-{i}", f"tech-{i}", "technology") for i in range(8)] + [card(100 + i, f"math-{i % 2}", f"math-{i}", "math") for i in range(4)]
    slate = build_slate(pool, 8, ["technology", "math"])
    assert sum(c.topic == "math" for c in slate) == 4 and max(sum(c.domain == d for c in slate) for d in {c.domain for c in slate}) == 2


def test_other_topics_fill_what_a_scarce_one_leaves():
    pool = [card(i + 1, f"tech-{i}", f"tech-{i}", "technology") for i in range(5)] + [card(100, "econ", "econ", "economics")]
    slate = build_slate(pool, 6, ["technology", "economics"])
    assert len(slate) == 6 and sum(c.topic == "economics" for c in slate) == 1


def test_spacing_goes_on_over_the_boundary_of_batches():
    prior = [card(900, "recent-one", "recent-one"), card(901, "recent-two", "recent-two")]
    pool = [card(1, "recent-two", "different"), card(2, "different", "recent-one")] + [card(100 + i, f"fresh-{i}", f"fresh-{i}") for i in range(4)]
    assert ids(build_slate(pool, 4, ["economics"], prior)) == [100, 101, 102, 103]


def test_a_recent_voice_stays_cooled_on_a_new_domain():
    prior = [card(900, "older", "older-writer"), *[card(910 + i, f"middle-{i}", f"middle-{i}") for i in range(5)], card(920, "recent", "recent-writer")]
    pool = [card(1, "brand-new", "recent-writer"), card(2, "older", "older-writer")]
    assert ids(build_slate(pool, 1, ["economics"], prior)) == [2]


def test_windows_continue_the_queue(spark, small):
    """The served window is the slate of its pool behind its context, whatever way the cards took to Python."""
    from inkwell.operators import deque, ranking
    from inkwell.operators.session import diversity_context
    from inkwell.operators.slate import cards_of
    from inkwell.plans.deque import S, _queue, _rows, _seen
    from inkwell.sources import views

    got = [(r.position, r.id) for r in catalog.queries()["deque_window"](spark, small).orderBy("position").collect()]
    rows, seen, queue = _rows(spark, small), _seen(spark, small), _queue(spark, small)
    pool = deque.deque_pool(rows, seen, queue, S).withColumn("cluster", deque.card_cluster()).toPandas().sort_values("position")
    cards = ranking.keyed(views.articles(spark, small)).join(views.sources(spark, small).selectExpr("id as source_id", "name as source_name", "origin as source_origin"), "source_id", "left").withColumn("cluster", deque.card_cluster())
    prior = diversity_context(queue, cards.select("id", "topic", "domain", "author_key", "cluster", "is_read", "read_at")).toPandas().sort_values("position")
    want = build_slate(cards_of(pool), 36, list(S.topics), cards_of(prior))
    assert got == [(i, c.id) for i, c in enumerate(want)] and got and not {i for _, i in got} & set(queue.toPandas()["id"])


def test_slates_behind_cards_shown_before(spark, small):
    shown = {}
    from inkwell.plans.deque import _shown

    for r in _shown(spark, small).collect():
        shown.setdefault(r.session_id, []).append(r)
    by = {}
    for r in catalog.queries()["slate_with_prior"](spark, small).collect():
        by.setdefault(r.session_id, []).append(r)
    for session, own in by.items():
        own.sort(key=lambda r: r.position)
        before = sorted(shown.get(session, []), key=lambda r: r.position)
        assert not {r.id for r in own} & {r.id for r in before} and len({r.id for r in own}) == len(own)
        if before and len({r.domain for r in own}) > 12:
            assert own[0].domain != before[-1].domain
    assert by
