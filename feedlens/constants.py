"""Fixed values of the semantic contract.

Everything in this file must have exactly these values for results to be right:
thresholds, word lists, header aliases, output sentences and formats.
"""

# --- thresholds and limits -------------------------------------------------
TOP_K = 5
RETRIEVAL_THRESHOLD = 0.2
EVIDENCE_THRESHOLD = 0.60
DEDUP_THRESHOLD = 0.85
CLUSTER_DISTANCE = 0.35
SINGLE_TICKET_CAP = 39
TWO_TICKET_CAP = 69
NORM_TOLERANCE = 1e-5
DRIFT_ECE = 0.15
CALIBRATED_BIAS = 0.05

# --- text ------------------------------------------------------------------
# the 32 ASCII punctuation characters
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# one whitespace character, in the syntax shared by Java regex and RE2
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
# the same characters for trimming
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NOT_WS = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"

SEVERITY_KEYWORDS = [
    "crash", "crashes", "hurts", "hurt", "burning", "blinding", "cannot", "can't", "broken",
    "severe", "freeze", "fail", "urgent", "error", "glare", "pain", "issue", "bug",
]

# --- ingest ----------------------------------------------------------------
ID_ALIASES = ["ticket_id", "id", "ticket", "record_id", "uuid", "index"]
DATE_ALIASES = ["created_at", "date", "timestamp", "time", "created_date", "datetime"]
TOPIC_ALIASES = ["topic", "title", "subject", "category", "issue", "header"]
MESSAGE_ALIASES = ["message", "description", "text", "body", "comment", "content", "feedback", "detail"]
JSON_WRAPPER_KEYS = ["tickets", "data", "records", "items", "evidence", "support_tickets"]
DEFAULT_TOPIC = "General Feedback"

# --- scoring and decision --------------------------------------------------
LEVELS = {
    "very low": 1.0, "low": 1.5, "medium": 3.0, "moderate": 3.0,
    "high": 4.5, "very high": 5.0, "critical": 5.0,
}
WEIGHTS = {"evidence": 0.35, "impact": 0.30, "alignment": 0.15, "effort": 0.10, "cost": 0.05, "risk": 0.05}
PRIORITY_OFFSET = 20.0
PRIORITY_TIERS = [
    (80, "Top Priority"), (60, "Strong Candidate"), (40, "Conditional"), (20, "Low Priority"),
]
LOWEST_TIER = "Unfavorable"

# Sentences; {ev}, {pri}, {imp}, ... are replaced by formatted values of the row.
RATIONALE = {
    "none": [
        "No validated customer support evidence exists for this proposal.",
        "Absence of evidence is not evidence of absence; collect user feedback or telemetry before decision.",
    ],
    "reject": [
        "High execution risk paired with weak evidence and low strategic alignment.",
        "The ROI profile does not justify the disproportionate risk.",
    ],
    "impact": [
        "High business impact potential ({imp}/5.0), but customer evidence strength is currently {ev}/100.",
        "High impact justifies active validation (surveys, interviews, analytics) before engineering commitment.",
    ],
    "spike": [
        "High technical complexity and execution risk require architectural de-risking.",
        "Moderate customer evidence ({ev}/100) supports building a targeted prototype or technical spike.",
    ],
    "build": [
        "Strong, validated customer evidence ({ev}/100) with solid strategic and business alignment.",
        "Priority score ({pri}/100) confirms a favorable return on engineering investment.",
    ],
    "modest": [
        "Low customer evidence ({ev}/100) combined with modest business impact ({imp}/5.0).",
        "Allocate engineering capacity to higher-leverage roadmap initiatives.",
    ],
    "misaligned": ["High engineering effort does not align closely with core strategic priorities."],
    "favorable": ["Favorable multi-criteria balance with priority score of {pri}/100."],
    "borderline": ["Borderline priority score indicates mixed signals; recommend targeted discovery."],
    "suboptimal": ["Sub-optimal priority score ({pri}/100); recommend deprioritizing."],
}
ASSUMPTIONS = {
    "effort": "Assumes estimated engineering effort ({eff}/5.0) remains within scoped capacity.",
    "impact": "Assumes business impact potential ({imp}/5.0) reflects addressable user demand.",
    "duplicates": "Customer feedback volume was normalized for {dup} duplicate inquiries.",
}
RISKS = {
    "execution": "Execution Risk: High architectural or domain complexity ({risk}/5.0).",
    "opportunity": "Opportunity Cost: Significant engineering resource allocation may delay parallel roadmap tracks.",
    "financial": "Financial/Infrastructure Risk: Heightened recurring operational or third-party costs ({cost}/5.0).",
    "market": "Market Validation Risk: Limited customer support signals may lead to building a low-adoption feature.",
    "default": "Manageable Risk Profile: No severe technical, operational, or evidence red flags identified.",
}
TRADE_OFFS = {
    "both_high": "High Impact vs High Effort: Requires large sprint investment for high anticipated user payoff.",
    "quick_win": "High Leverage Quick-Win: High anticipated return with minimal engineering overhead.",
    "low_value": "Unfavorable Cost-to-Value: Significant engineering expenditure for marginal business gain.",
    "off_strategy": "Customer Demand vs Strategic Focus: Strong user demand exists but diverges from immediate strategic goals.",
    "default": "Balanced Investment: Resource requirements align proportionally with expected utility.",
}
MISSING = {
    "analytics": "Quantitative user analytics and product telemetry (e.g. drop-off rates, click tracking).",
    "interviews": "Qualitative feedback from user interviews or customer advisory boards.",
    "sample": "Broader sample size of customer support tickets across diverse customer segments.",
    "spec": "Detailed technical specification and architecture RFC from engineering.",
}

# --- evaluation ------------------------------------------------------------
GATE_SWEEP = [0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80]
DEDUP_SWEEP = [0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
CLUSTER_SWEEP = [0.20, 0.25, 0.30, 0.35, 0.40, 0.50]
GENERIC_WORDS = ["the", "a", "is", "app", "to", "for", "please", "in", "and", "my", "on", "it"]
# name, cosine >=, token Jaccard >= (0 = off), 3-gram >= (0 = off), topic must match
CANDIDATE_FILTERS = [
    ("Baseline (Embedding Cosine >= 0.85)", 0.85, 0.0, 0.0, False),
    ("Cosine >= 0.85 + Jaccard >= 0.20", 0.85, 0.20, 0.0, False),
    ("Cosine >= 0.85 + Jaccard >= 0.30", 0.85, 0.30, 0.0, False),
    ("Cosine >= 0.85 + 3-gram >= 0.25", 0.85, 0.0, 0.25, False),
    ("Cosine >= 0.80 + Jaccard >= 0.30", 0.80, 0.30, 0.0, False),
    ("Cosine >= 0.85 + Exact Topic Match", 0.85, 0.0, 0.0, True),
]
