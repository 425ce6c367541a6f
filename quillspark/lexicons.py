"""Fixed word lists, patterns and dimension tables, as data.

Lexicons are plain values so that a job can replace them by its own tables.
"""

from __future__ import annotations

# Bracketed labels whose counts make up the claim-type metrics.
CLAIM_TAGS = ["PRAMANA", "SMRITI", "ANUMANA", "VIKALPA", "UNCERTAIN", "ESTABLISHED", "TEXTBOOK", "INFERRED", "FRAMING", "CERTAIN", "LIKELY", "SPECULATIVE", "UNKNOWN"]
CLAIM_TAGS_SHORT = ["PRAMANA", "SMRITI", "ANUMANA", "VIKALPA", "UNCERTAIN"]

# Patterns counted in lower-cased text.  Those with capitals never match there and are kept as dead entries.
EXAMPLE_MARKERS = [
    r"for example[,:]", r"for instance[,:]", r"such as\b", r"e\.g\.\b", r"like the\b.*\b(?:in|of|during)\b", r"case of\b",
    r"(?:consider|take)\b.*\bexample\b", r"UDAHARANA", r"Udaharana", r"grounded example", r"known case", r"real.world example",
]
GROUNDING_MARKERS = [
    r"for example[,:]", r"for instance[,:]", r"such as\b", r"e\.g\.\b", r"case of\b", r"Source:", r"According to",
    r"research (?:shows|found|suggests)", r"study (?:by|from|in)",
]
HEDGES = [
    r"i(?:'m| am) not (?:sure|certain|confident)", r"this (?:may|might|could) (?:be|not be)", r"it(?:'s| is) (?:unclear|uncertain|debatable)",
    r"tentative", r"i lack", r"not confident", r"more research", r"evidence (?:is|remains) (?:limited|mixed|unclear)",
    r"approximately|roughly", r"to (?:my|the best of my) knowledge",
]
HEDGES_SHORT = [
    r"i(?:'m| am) not (?:sure|certain|confident)", r"this (?:may|might|could) (?:be|not be)", r"it(?:'s| is) (?:unclear|uncertain|debatable)",
    r"tentative", r"not confident", r"treat as tentative", r"could not find.*example",
]
# Labels of reasoning steps.
STEP_LABELS = ["PRATIJNA", "HETU", "UDAHARANA", "UPANAYA", "NIGAMANA", "CLAIM", "REASON", "EVIDENCE", "APPLICATION", "CONCLUSION", "Step", "Claim", "Reason", "Example", "Conclusion"]
SYLLOGISM_STEPS = ["PRATIJNA", "HETU", "UDAHARANA", "UPANAYA", "NIGAMANA"]
# What makes a question need a search.
SEARCH_TRIGGERS = [
    r"\b(?:latest|current|recent|today|now|202\d|this year|this month)\b",
    r"\b(?:how much|how many|what percent|what rate|statistics|data)\b",
    r"\b(?:who (?:is|was|are)|when (?:did|was|is)|where (?:is|was))\b",
    r"\b(?:price|cost|stock|market|gdp|inflation rate)\b",
]

# Category keywords.  The order of the categories decides ties.
CATEGORIES = {
    "purusha": ["methodology", "epistemology", "reasoning", "logic", "framework", "analysis method", "how to think", "critical thinking", "scientific method"],
    "prakriti": ["definition", "defined as", "refers to", "is a type of", "classification", "taxonomy", "list of", "table of"],
    "sattva": ["difference between", "compare", "contrast", "distinguish", "whereas", "on the other hand", "unlike", "classification", "categorize", "differentiate"],
    "rajas": ["cause", "mechanism", "drives", "leads to", "results in", "because", "therefore", "consequently", "force", "dynamic", "process", "how it works", "trigger"],
    "tamas": ["limit", "constraint", "boundary", "cannot", "restricted", "bottleneck", "barrier", "threshold", "maximum", "minimum", "prevent", "resist", "slow down"],
    "tanmatra_empirical": ["experiment", "observed", "measured", "data shows", "study found", "laboratory", "field observation"],
    "tanmatra_statistical": ["percent", "statistics", "survey", "correlation", "average", "median", "standard deviation", "p-value"],
    "tanmatra_case": ["case study", "for example", "instance", "specific case", "in the case of", "anecdotal", "real-world example"],
    "tanmatra_expert": ["according to", "expert", "authority", "established", "consensus", "widely accepted", "mainstream view"],
    "tanmatra_historical": ["historically", "precedent", "trend", "over time", "evolution of", "development of", "history shows"],
}
ONTOLOGICAL_ORDER = ["purusha", "prakriti", "sattva", "rajas", "tamas", "tanmatra_empirical", "tanmatra_statistical", "tanmatra_case", "tanmatra_expert", "tanmatra_historical"]
TAXONOMY_ORDER = ["prakriti", "tanmatra_expert", "tanmatra_case", "sattva", "rajas", "tamas", "tanmatra_empirical", "tanmatra_statistical", "purusha", "tanmatra_historical"]

# Score dimensions in the order that decides ties, each with its curriculum stage.
DIMENSIONS = ["factual_accuracy", "completeness", "calibration", "reasoning_depth", "usefulness"]

# Dimensions of the pointwise judges of seven.
FACET_DIMENSIONS = ["dravya", "guna", "karma", "samanya", "vishesha", "samavaya", "abhava"]
GENERIC_DIMENSIONS = ["accuracy", "completeness", "clarity", "depth", "relevance", "coherence", "usefulness"]

# Words that are frequent in the synthetic documents; a lexicon of our own for queries over them.
SAMPLE_CATEGORIES = {"articles": ["the", "la", "der", "el"], "links": ["and", "et", "und", "y"], "places": ["of", "de", "in", "to the"]}
SAMPLE_TRIGGERS = [r"\b(?:that|this)\b", r"\b(?:with|from) "]
