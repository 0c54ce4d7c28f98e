"""Topic classification against three lexicons, title-based ecosystem clusters and round-up titles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.basics import bind, clamp, matches

TOPICS = ["technology", "economics", "math"]
MIN_RELEVANCE = 0.4

# The lexicons; a strong term counts 2.4, a supporting one 0.75.
STRONG = {
    "technology": [
        "artificial intelligence", "machine learning", "large language model", "model context protocol",
        "software engineering", "computer science", "programming language", "distributed system", "operating system",
        "database", "compiler", "kernel", "cybersecurity", "cryptography", "algorithm", "source code", "open source",
        "developer tool", "web browser", "cloud computing", "neural network", "generative ai", "language model",
        "coding agent", "memory safety", "computer vision", "wireless network", "virtual machine", "nanogpt",
    ],
    "economics": [
        "economics", "economic growth", "monetary policy", "fiscal policy", "central bank", "federal reserve",
        "interest rate", "labor market", "public finance", "industrial policy", "international trade",
        "exchange rate", "cost of living", "income inequality", "development economics", "behavioral economics",
        "game theory", "consumer price", "gross domestic product", "supply and demand", "market power",
        "economic policy", "political economy", "marginal utility", "balance of payments", "debt to gdp",
        "stock market", "economic education", "economic history", "financial market", "financial regulation",
        "equity market", "equity derivative", "asset pricing", "banking system", "social security", "public pension",
        "government spending", "tax policy", "energy market", "power market", "commodity market",
        "corporate finance", "sovereign debt", "financial stability",
    ],
    "math": [
        "mathematics", "mathematical", "number theory", "graph theory", "category theory", "set theory",
        "group theory", "measure theory", "linear algebra", "differential equation", "partial differential",
        "complex analysis", "real analysis", "algebraic geometry", "differential geometry", "probability theory",
        "random variable", "prime number", "formal proof", "bessel function", "fourier transform",
        "hadamard matrix", "zeta function", "statistical model", "bayesian inference", "complexity theory",
        "quantum computing",
    ],
}
SUPPORTING = {
    "technology": [
        "software", "programming", "computer", "developer", "coding", "code", "internet", "protocol", "network",
        "server", "api", "framework", "library", "runtime", "linux", "python", "javascript", "typescript", "rust",
        "security", "encryption", "hardware", "gpu", "llm", "mcp", "chatgpt", "claude", "openai", "debugging",
        "browser", "ai model", "gpt", "wifi", "wi-fi", "wireless", "firmware", "microprocessor", "processor",
        "chipset", "emulator", "bookmarklet", "webpage",
    ],
    "economics": [
        "economy", "economic", "economist", "inflation", "deflation", "unemployment", "productivity", "recession",
        "tariff", "trade", "wage", "income", "consumption", "investment", "capital", "market", "price",
        "competition", "monopoly", "housing", "inequality", "tax", "regulation", "currency", "gdp", "bond", "yield",
        "incentive", "econometric", "macroeconomic", "microeconomic", "stagnation", "auction", "bankruptcy",
        "birth rate", "migration", "banking", "credit", "loan", "mortgage", "equity", "derivative", "portfolio",
        "valuation", "pension", "retirement", "subsidy", "deficit", "debt", "wealth", "rent", "employment",
        "worker", "business cycle", "financial", "futures", "commodity",
    ],
    "math": [
        "theorem", "proof", "lemma", "corollary", "geometry", "algebra", "calculus", "topology", "combinatorics",
        "probability", "statistics", "equation", "integral", "derivative", "matrix", "polynomial", "prime",
        "integer", "sequence", "function", "manifold", "vector", "tensor", "symmetry", "infinity", "axiom",
        "conjecture",
    ],
}
# Patterns of round-up titles, and of ecosystems with the sites that belong to them.
ROUNDUPS = [
    r"^\s*fragments?\s*(?::|#|-|–|—|\d)",
    r"^\s*(?:(?:some|assorted|weekly|weekend|friday|saturday|sunday)\s+)?links\s*(?::|#|-|–|—|$)",
    r"^\s*(?:weekly\s+)?reading list\s*(?::|#|-|–|—|\d|$)",
    r"^\s*roundup\s*(?::|#|-|–|—|\d|$)",
    r"^\s*(?:weekly|weekend|monthly)\s+(?:roundup|digest)\b",
]
#: (cluster, domains, title pattern); the first that fits wins.
CLUSTERS = [
    ("technology:python", ["djangoproject.com", "lernerpython.com", "planetpython.org", "pycoders.com", "pyfound.blogspot.com", "pythonbytes.fm"],
     r"\b(?:django|pip|polars|pycharm|pycon|pyodide|pypi|pytest|python(?:\s*3)?)\b"),
    ("technology:rust", ["blog.rust-lang.org", "rustup.rs", "crates.io", "rustwasm.github.io"],
     r"\b(?:rust(?:lang|acean|up)?|cargo|crate|borrow checker|lifetime(?:s)?|tokio|actix|wasm.?pack)\b"),
    ("technology:javascript", ["nodejs.org", "deno.land", "bun.sh", "tc39.es"],
     r"\b(?:javascript|typescript|node\.?js|deno|bun(?:\.sh)?|react|vue|svelte|angular|next\.?js|nuxt|astro|vite|webpack|esbuild|tc39|ecmascript|npm|pnpm|jsx|tsx)\b"),
    ("technology:ai-ml", ["openai.com", "deepmind.google", "huggingface.co"],
     r"\b(?:llm|gpt|transformer|diffusion model|neural net(?:work)?|deep learning|machine learning|training (?:a |the )?model|fine.?tun(?:e|ing)|rlhf|rag|embedding|tokeniz(?:er|ation)|attention (?:mechanism|head)|language model|chatgpt|claude|llama|mistral|stable diffusion|midjourney|generative ai)\b"),
    ("technology:systems", ["lwn.net", "kernelnewbies.org"],
     r"\b(?:kernel|syscall|linux|freebsd|openbsd|operating system|file ?system|ext4|btrfs|zfs|memory manag(?:er|ement)|page table|scheduler|interrupt|eBPF|io_uring|mmap|ptrace|strace|assembly|x86|arm64|risc.?v|simd|avx)\b"),
    ("technology:go", ["go.dev", "golang.org"],
     r"\b(?:golang|go(?:\s+)?(?:1\.\d+|module|routine|channel|interface)|goroutine|go.?channel)\b"),
    ("technology:security", ["krebsonsecurity.com", "schneier.com"],
     r"\b(?:vulnerabilit(?:y|ies)|CVE-\d|exploit|malware|ransomware|zero.?day|buffer overflow|SQL injection|XSS|CSRF|penetration test|ctf|cryptograph(?:y|ic)|TLS|certificate|authentication bypass)\b"),
    ("technology:databases", ["use-the-index-luke.com", "pganalyze.com"],
     r"\b(?:postgres(?:ql)?|mysql|sqlite|redis|mongodb|cassandra|DynamoDB|database|query (?:plan|optimizer)|B.?tree|LSM.?tree|WAL|MVCC|index(?:ing)?|sharding|replication)\b"),
    ("technology:functional", ["haskell.org", "elm-lang.org", "elixir-lang.org", "ocaml.org", "clojure.org"],
     r"\b(?:haskell|ocaml|elixir|erlang|clojure|lisp|scheme|monad|functor|algebraic data type|pattern matching|type class|lambda calculus|purely functional)\b"),
]


#: Bytes that are no part of a word become spaces.
_SPACED = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789+#." else 32 for c in range(256))
#: Every word of a term; a text's other words only separate them.
_WORDS = frozenset(w.encode() for terms in (*STRONG.values(), *SUPPORTING.values()) for t in terms for w in t.split(" "))
#: For each topic its terms in order: (first word, term between spaces, weight).
_TERMS = {topic: [[(t.split(" ")[0].encode(), f" {t} ".encode(), w) for t in terms] for terms, w in ((STRONG[topic], 2.4), (SUPPORTING[topic], 0.75))] for topic in TOPICS}


def lexicon_text(text: str) -> tuple[bytes, set[bytes]]:
    """(the text's words between single spaces, each run of those that no term has as one underscore; the terms' words in it)."""
    words = text.lower().encode("utf-8", "replace").translate(_SPACED).split()
    there = _WORDS.intersection(words)
    if not there:
        return b"", there
    kept, gap = [b""], False
    for w in words:
        if w in there:
            kept.append(w)
            gap = False
        elif not gap:
            kept.append(b"_")
            gap = True
    kept.append(b"")
    return b" ".join(kept), there


def term_score(lexicon: tuple[bytes, set[bytes]], topic: str) -> float:
    """Terms of a topic in a lexicon text, three of each at most; neighbours share a space and count once."""
    text, there = lexicon
    if not there:
        return 0.0
    return sum(sum((w * min(3, text.count(t)) for first, t, w in terms if first in there), 0.0) for terms in _TERMS[topic])


def raw_scores(title: str, excerpt: str, text: str) -> list[float]:
    """A score for each topic: titles weigh ten times what the text does; a topic that only the text names, and rarely, is cut."""
    fields = [lexicon_text(x) for x in (title, excerpt, text[:12000])]
    out = []
    for topic in TOPICS:
        head = term_score(fields[0], topic) * 3.5 + term_score(fields[1], topic) * 1.5
        every = head + term_score(fields[2], topic) * 0.35
        out.append(every * 0.25 if head == 0 and every < 4 else every)
    return out


def _raw(title: pa.Array, excerpt: pa.Array, text: pa.Array) -> pa.Array:
    scores = np.fromiter((raw_scores(t.as_py(), e.as_py(), x.as_py()) for t, e, x in zip(title, excerpt, text, strict=True)), np.dtype((np.float64, len(TOPICS))), len(title))
    return pa.StructArray.from_arrays([pa.array(c) for c in scores.T], TOPICS)


def assess(title: Column, excerpt: Column, text: Column, hint: Column) -> Column:
    """struct<topic, relevance, technology, economics, math>: the topic of an article and its confidence in each.

    The hint keeps a near-tie. Texts must not be null; the hint must be one of TOPICS. Rounded to 9 places. The search for
    two hundred terms runs in Arrow batches, a row at a time: one pass keeps the few words that terms have, and terms are
    counted in those.
    """
    scored = F.arrow_udf(_raw, ", ".join(f"{t} double" for t in TOPICS))(title, excerpt, F.substring(text, 1, 12000))

    def chosen(x: Column) -> Column:
        of_hint = F.when(hint == TOPICS[0], x[TOPICS[0]]).when(hint == TOPICS[1], x[TOPICS[1]]).otherwise(x[TOPICS[2]])
        top = F.greatest(*(x[t] for t in TOPICS))
        first = F.when(of_hint == top, hint).when(x[TOPICS[0]] == top, TOPICS[0]).when(x[TOPICS[1]] == top, TOPICS[1]).otherwise(TOPICS[2])
        topic = F.when(top < of_hint * 1.25 + 1.2, hint).otherwise(first)
        sure = {t: F.round(clamp(F.lit(1.0) - F.exp(-x[t] / 5.0)), 9) for t in TOPICS}
        relevance = F.when(topic == TOPICS[0], sure[TOPICS[0]]).when(topic == TOPICS[1], sure[TOPICS[1]]).otherwise(sure[TOPICS[2]])
        return F.struct(topic.alias("topic"), relevance.alias("relevance"), *(sure[t].alias(t) for t in TOPICS))

    return bind(scored, chosen)


def is_roundup(title: Column) -> Column:
    found = F.lit(False)
    for p in ROUNDUPS:
        found = found | matches(title, p, True)
    return found


def cluster(topic: Column, title: Column, domain: Column, source_name: Column, source_origin: Column) -> Column:
    """The ecosystem of a technology article, or the empty string."""
    planet = (source_origin == "aggregator") & (F.lower(F.trim(F.coalesce(source_name, F.lit("")))) == "planet python")
    site = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    out = F.when(topic != "technology", "").when(F.coalesce(planet, F.lit(False)), CLUSTERS[0][0])
    for name, domains, pattern in CLUSTERS:
        out = out.when(site.isin(domains) | matches(title, pattern, True), name)
    return out.otherwise("")
