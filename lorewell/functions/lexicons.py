"""Word lists and weights.  All are parameters of the plans; these are the defaults.

Fixed values: they must equal the published behaviour for equal results.
"""

CATEGORIES = {
    "engineering_db": ("postgres", "mysql", "sqlite", "schema", "migration", "index", "query"),
    "engineering_backend": ("backend", "api", "service", "controller", "endpoint", "runtime"),
    "ai_memory": ("rag", "retrieval", "memory", "context", "selector", "token"),
    "content_marketing": ("copywriting", "retention", "hook", "youtube", "storyboard", "cta"),
    "operations_reliability": ("incident", "rollback", "sre", "outage", "latency", "reliability"),
}
TOPICS = {
    "migration_rollout_safety": ("migration", "rollback", "rollout", "guardrail", "staging"),
    "database_change_risk": ("postgres", "mysql", "schema", "index", "query", "locking"),
    "runtime_reliability": ("incident", "outage", "latency", "timeout", "retry", "fallback"),
    "memory_retrieval_design": ("rag", "retrieval", "selector", "context", "token", "provenance"),
    "execution_quality_loop": ("execution", "evaluation", "rubric", "improvement", "quality"),
}
CLUSTER_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with")
SIGNATURE_STOPWORDS = ("a", "an", "and", "are", "as", "at", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "what", "with")
NEGATIVE = ("not", "never", "cannot", "cant", "can't", "failed", "failure", "no", "disabled", "off")
STRONG_NEGATIVE = ("not", "never", "cannot", "cant", "can't", "no")
POSITIVE = ("works", "working", "succeeds", "success", "yes", "enabled", "active", "on")
SPEECH_ACTS = (r"^\s*the user said (that )?", r"^\s*the user mentioned (that )?", r"^\s*i remember (that )?", r"^\s*we concluded (that )?", r"^\s*it was concluded (that )?", r"^\s*we learned (that )?", r"^\s*note that\s*")
#: Intents in the order in which their phrases are tried; the last stands for all other queries.
INTENTS = (
    ("exact_recall", ("what did we say", "earlier", "quote")),
    ("investigative", ("investigate", "investigation", "unknown unknown", "what else matters")),
    ("architecture_explanation", ("how is your memory organized", "architecture", "where did this answer come from")),
    ("memory_summary", ("what do you remember", "what do you know about me")),
    ("corpus_overview", ("what can you tell me about", "synopsis", "book", "corpus")),
    ("planning", ("current task state", "what changed", "blocker", "blockers", "next step", "next steps")),
    ("planning", ("plan", "roadmap", "sequence")),
)
OTHER_INTENT = "investigative"
WEB_WORDS = ("latest", "current", "today", "yesterday", "recent", "news", "update", "verify")
LANES = {
    "exact_recall": ("episodic", "lexical", "semantic"),
    "memory_summary": ("promoted", "episodic", "semantic"),
    "architecture_explanation": ("promoted", "episodic"),
    "corpus_overview": ("corpus", "large_file", "lexical", "episodic"),
    "planning": ("episodic", "lexical", "promoted", "semantic"),
    "investigative": ("semantic", "lexical", "episodic", "promoted", "corpus", "large_file"),
}
#: Intents whose lanes a web-sensitive query extends by the web lane.
WEB_INTENTS = ("corpus_overview", "planning", "investigative")
RISKS = (("high", ("security", "compliance", "legal", "medical", "financial")), ("elevated", ("verify", "contradiction", "conflict", "audit")))
#: Weights of a candidate's utility: relevance, provenance, recency, freshness and trust, novelty, intent fit,
#: redundancy, contradiction.
WEIGHTS = {
    "exact_recall": (1.25, 0.8, 0.65, 0.35, 0.2, 1.1, 0.75, 0.8),
    "memory_summary": (0.9, 0.95, 0.45, 0.75, 0.55, 1.1, 0.9, 0.85),
    "architecture_explanation": (0.85, 1.1, 0.3, 0.7, 0.25, 1.3, 0.85, 0.95),
    "corpus_overview": (1.2, 1.0, 0.35, 0.45, 0.3, 1.35, 0.7, 0.8),
    "planning": (1.05, 0.85, 0.8, 0.55, 0.45, 1.15, 0.7, 0.8),
    "investigative": (1.15, 0.9, 0.4, 0.6, 0.75, 1.0, 0.6, 0.9),
}
LANE_MAXIMA = {"lexical": 8, "semantic": 8, "fresh_tail": 10, "episodic": 8, "session_summary": 8, "promoted": 4, "corpus": 8, "large_file": 6, "reasoning": 4, "architecture": 4, "fallback_mirror": 4}
LANE_MAXIMA_BY_INTENT = {
    "exact_recall": {"session_summary": 0, "corpus": 3, "lexical": 4, "semantic": 4},
    "memory_summary": {"episodic": 3, "lexical": 3},
    "corpus_overview": {"episodic": 2, "lexical": 3},
    "planning": {"session_summary": 0, "corpus": 2, "large_file": 1, "promoted": 2},
}
LANE_MINIMA = {"fresh_tail": 2}
LANE_MINIMA_BY_INTENT = {
    "exact_recall": {"fresh_tail": 1, "episodic": 2},
    "memory_summary": {"session_summary": 2, "promoted": 1},
    "architecture_explanation": {"architecture": 1},
    "corpus_overview": {"corpus": 1},
    "planning": {"episodic": 1},
}
CLUSTER_BONUS = 0.2
#: The discovery plan's own lists: lanes of an intent, words of web-sensitive queries, words that are no topics, intents
#: without discovery.
PLAN_LANES = {
    "exact_recall": ("episodic", "lexical", "semantic"),
    "memory_summary": ("promoted", "episodic", "semantic"),
    "architecture_explanation": ("promoted", "episodic"),
    "corpus_overview": ("corpus", "large_file", "lexical"),
    "planning": ("episodic", "lexical", "promoted", "semantic"),
    "investigative": ("semantic", "lexical", "episodic", "promoted", "corpus", "large_file"),
}
PLAN_WEB_WORDS = ("latest", "current", "today", "yesterday", "recent", "news", "update", "2026", "verify", "fact-check", "confirm", "source", "citation")
PLAN_STOPWORDS = ("what", "tell", "about", "does", "this", "that", "with", "from", "into", "your", "have", "been", "current", "latest", "today", "recent", "query", "where", "when", "should", "would")
UNDISCOVERED = ("exact_recall", "architecture_explanation", "planning")
#: Probes of a plan beside those of its roles: kind, role, priority, purpose, intents (none: all), only if web-sensitive.
ROLE_PURPOSE = "Generate a bounded retrieval probe from this role perspective."
PLAN_PROBES = (
    ("contradiction", "skeptic", 1, "Find evidence that conflicts with the current strongest claim.", (), False),
    ("contradiction", "security auditor", 2, "Check for policy/safety contradictions in architecture or process claims.", ("architecture_explanation", "planning"), False),
    ("contradiction", "compliance reviewer", 3, "Cross-check freshness-sensitive claims against recent external evidence.", (), True),
    ("novelty", "domain specialist", 1, "Find one high-value angle not already captured in obvious evidence.", ("exact_recall", "memory_summary", "corpus_overview", "planning", "investigative"), False),
    ("novelty", "ops reviewer", 2, "Find practical edge-cases or operational implications missing from the baseline view.", ("corpus_overview", "investigative", "planning"), False),
)
PLAN_NOTES = ("m9-controller: structured planning only", "m10-discovery-loop not executed here")
WEB_NOTE = "web-sensitivity detected from query terms"
