"""Article quality: eight shallow-text signals in [0, 1] and their weighted sum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.basics import bind, bounded, clamp, matches, weighted

# Word lists, patterns, weights and bands of the score.
STOPWORDS = """the be to of and a in that have i it for not on with he as you do at this but his by from they we say
her she or an will my one all would there their what so up out if about who get which go me when make can like time no
just him know take people into year your good some could them see other than then now look only come its over also back
after use two how our work first well way even new want any these""".split()
CLICKBAIT_PHRASES = [
    "you won't believe", "you wont believe", "won't believe what", "this one weird", "one simple trick", "click here",
    "what happened next", "here's what happened", "here is what happened", "the reason is not", "the reason isn't",
    "shocking truth", "mind-blowing", "game-changer", "changed everything", "changes everything",
    "will blow your mind", "destroyed", "slays", "owns", "epic takedown", "must read", "must-read",
    "everything you need to know", "ultimate guide to", "#will shock you", "do this every day", "do this daily",
    "stop doing", "start doing this",
]
CLICKBAIT_TITLES = [
    r"^\d+\s+(things|ways|reasons|lessons|tips|tricks|hacks|facts)\b",
    r"\b\d+\s+(things|ways|reasons|tips|tricks)\b.*\b(you|your)\b",
    r"^(this|these|that|those)\b.{0,40}\b(is why|is how|changed|broke)\b",
    r"\b(why|how)\b.{0,30}\b(will|won't|wont|can't|cant|shouldn't)\b",
    r"\bi tried\b.{0,30}\bfor\b",
    r"\bis (actually )?(dead|dying|over|back)\b",
    r"\byou'?re (doing|using) (it|them) wrong\b",
    r"\bno one talks about\b",
    r"\bnobody (talks|tells you)\b",
    r"\bthe (dark |hidden )?(truth|secret) about\b",
]
INTERESTING = [
    (r"\b(i built|i made|i wrote|i trained|i created|building my|making my)\b", 0.18),
    (r"\b(how i|what i learned|lessons from|my experience|things i)\b", 0.14),
    (r"\b(i discovered|i realized|i was wrong|changed my mind)\b", 0.16),
    (r"\b(from scratch|under the hood|inside|internals|deep dive|dissecting)\b", 0.16),
    (r"\b(reverse.engineer(?:ing|ed)?|decompil(?:ing|ed)|disassembl(?:ing|ed))\b", 0.18),
    (r"\b(proof|theorem|conjecture|derivation|formal verification)\b", 0.12),
    (r"\b(interactive|visualization|simulator|playground|experiment(?:ing)?)\b", 0.14),
    (r"\b(animation|generative|procedural|creative coding|art of)\b", 0.14),
    (r"\b(game|music|paint|draw(?:ing)?|3d|render(?:ing)?)\b", 0.10),
    (r"\b(surprising|counterintuitive|unexpected|paradox|misconception)\b", 0.12),
    (r"\b(actually|myth|wrong about|misunderstood|overlooked)\b", 0.08),
    (r"\b(trade.?offs?|compared|versus|vs\.?)\b", 0.06),
    (r"\b(case study|war story|post.?mortem|incident report)\b", 0.14),
    (r"^(why|how|what) .{15,}", 0.06),
    (r"\b(getting started|introduction to|beginner'?s? guide|tutorial)\b", -0.12),
    (r"\b(cheat ?sheet|quick ?start|step.by.step|setup guide)\b", -0.10),
    (r"\b(release notes?|version \d|changelog|what'?s new in)\b", -0.10),
    (r"\b(announcement|announcing|now available|just released|launched)\b", -0.08),
]
FIRST_PERSON = r"\bi (built|made|wrote|discovered|realized|tried)\b"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
WEIGHTS = {"depth": 0.22, "stopwords": 0.10, "sentences": 0.08, "caps": 0.16, "punctuation": 0.06, "clickbait": 0.12, "link_density": 0.08, "interestingness": 0.12}
FLOOR = 0.06


def depth(words: Column) -> Column:
    """Log-scaled length: 0 at 150 words, 1 at 6,000."""
    return F.when(words <= 0, F.lit(0.0)).otherwise(clamp(F.log10(words / F.lit(150.0)) / F.log10(F.lit(40.0))))


def stopwords(text: Column) -> Column:
    def band(share: Column) -> Column:
        return F.when((share >= 0.32) & (share <= 0.58), 1.0).when((share >= 0.22) & (share < 0.32), 0.7).when((share > 0.58) & (share <= 0.68), 0.7).otherwise(0.25)

    def of(found: Column) -> Column:
        return F.when(F.size(found) < 50, 0.5).otherwise(bind(F.size(F.filter(found, lambda w: w.isin(STOPWORDS))) / F.size(found), band))

    return bind(F.regexp_extract_all(F.lower(F.substring(text, 1, 4000)), F.lit("[a-z']+"), F.lit(0)), of)


def sentences(text: Column) -> Column:
    def band(mean: Column) -> Column:
        return F.when((mean >= 8) & (mean <= 32), 1.0).when((mean >= 5) & (mean <= 45), 0.7).otherwise(0.3)

    def of(head: Column) -> Column:
        parts = F.size(F.filter(F.split(head, r"[.!?]+(?:\s|$)", -1), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > 2))
        return bind(parts, lambda n: F.when(n < 5, 0.6).otherwise(bind(F.size(F.split(head, r"\s+", -1)) / n, band)))

    return bind(F.substring(text, 1, 4000), of)


def caps(title: Column, text: Column) -> Column:
    def of(sample: Column) -> Column:
        letters = F.greatest(F.lit(1), F.regexp_count(sample, F.lit("[A-Za-z]+")))
        return clamp(F.regexp_count(sample, F.lit(bounded(r"\b[A-Z]{3,}\b"))) / letters * 12.0)

    return bind(F.concat(title, F.lit(" "), F.substring(text, 1, 600)), of)


def punctuation(title: Column) -> Column:
    return clamp(weighted([(title.rlike(r"!{2,}|\?{2,}"), 0.5), (F.regexp_count(title, F.lit("!")) > 2, 0.4), (title.rlike(EMOJI), 0.3)]))


def clickbait(title: Column) -> Column:
    def of(low: Column) -> Column:
        terms = [(low.contains(p), 0.45) for p in CLICKBAIT_PHRASES] + [(matches(title, p, True), 0.35) for p in CLICKBAIT_TITLES]
        terms += [(matches(low, r"\b(this|these)\b") & (F.size(F.split(low, " ", -1)) <= 12), 0.15), (title.rlike(r"\.\.\.|…"), 0.2)]
        return clamp(weighted(terms))

    return bind(F.lower(title), of)


def link_density(html: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href[^>]*>[\s\S]*?</a>"), F.lit(0))
    anchors = F.aggregate(links, F.lit(0), lambda n, a: n + F.length(F.regexp_replace(a, "<[^>]*>", "")))
    size = F.length(F.regexp_replace(html, "<[^>]*>", " "))

    def band(share: Column) -> Column:
        return F.when(share.isNull(), 1.0).when(share <= 0.15, 0.0).when(share <= 0.3, 0.3).otherwise(clamp((share - 0.3) * 2.5))

    return bind(size, lambda n: bind(anchors / F.when(n > 0, n), band))


def interestingness(title: Column, text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 2000))
    return clamp(weighted([*((matches(title, p, True), w) for p, w in INTERESTING), (matches(head, FIRST_PERSON), 0.06)]))


def score(title: Column, text: Column, html: Column, words: Column) -> Column:
    """struct<quality, components> of an article; texts must not be null. Doubles are rounded to 9 places."""
    parts = {
        "depth": depth(words), "stopwords": stopwords(text), "sentences": sentences(text), "caps": caps(title, text),
        "punctuation": punctuation(title), "clickbait": clickbait(title), "link_density": link_density(html), "interestingness": interestingness(title, text),
    }
    made = F.struct(*(v.cast("double").alias(k) for k, v in parts.items()))

    def total(x: Column) -> Column:
        out = F.lit(FLOOR)
        for k, w in WEIGHTS.items():
            good = x[k] if k in ("depth", "stopwords", "sentences", "interestingness") else F.lit(1.0) - x[k]
            out = out + F.lit(w) * good
        return F.round(clamp(out), 9)

    # The array binds the components to a name, so that the sum doesn't compute them again.
    return F.transform(F.array(made), lambda x: F.struct(total(x).alias("quality"), F.struct(*(F.round(x[k], 9).alias(k) for k in parts)).alias("components")))[0]
