"""Patterns of the clause miner, testability checks and guard, in the syntax that Java and RE2 share.

Fixed values: what the patterns match decides the results.  `(?i)` is ASCII in
both engines.  A pattern that needs look-around is split in two (PLAIN_MAY).
"""

DEONTIC = (
    r"(?i)\b(shall(?:\s+not)?|must(?:\s+not)?|should(?:\s+not)?|may\s+not|may\s+only\b|is\s+required\s+to|are\s+required\s+to|"
    r"is\s+prohibited\s+from|are\s+prohibited\s+from|forbidden|prohibited|unlawful|ensure\s+that|verify\s+that|"
    r"enable\s+.*\s+only\s+if|guarantee\s+that|responsible\s+for|obliged\s+to|mandated\s+to)\b"
)
EXCEPTION = r"(?i)\b(except|unless|provided\s+that|subject\s+to|notwithstanding|as\s+permitted\s+by|save\s+as|only\s+if|if\s|when\s|where\s)\b"
EXEMPTION = r"(?i)\bshall\s+not\s+be\s+required\s+to\b"
DEFINITION = r"(?i)\b(means|is\s+defined\s+as|refers\s+to|denotes|includes|comprises|consists\s+of)\b"
DEADLINE = r"(?i)\b(no\s+later\s+than|within)\s+(\d+)\s+(day|days|week|weeks|month|months|year|years)\b"
THRESHOLD = r"(?i)\b(more\s+than|at\s+least|no\s+more\s+than|not\s+exceed(?:ing)?)\s+([\d,]+(?:\.\d+)?)\s*(users?|requests?|percent|%)\b"
JURISDICTION = r"(?i)\b(to\s+the\s+extent\s+permitted\s+by\s+law|unless\s+otherwise\s+required\s+by)\b"
CROSS_REFERENCE = (
    r"(?i)\b(Article\s+\d+(?:\(\d+\))?|Art\.\s*\d+(?:\(\d+\))?|Annex\s+[A-Z]|Appendix\s+[A-Z]|"
    r"§\s?\d{3,}(?:\.\d+)*(?:\([a-z0-9]+\))*|Section\s+\d+(?:\.\d+)*)"
)
BULLET = r"^\s*(?:[\-•*]|\(?[a-zA-Z]\)|\(?[ivxIVX]+\)|\(?\d+\)|\d+\.)\s+"
INFORMATIVE = r"(?i)\b(example|examples|note|notes|guidance|informative|appendix|annex|foreword|acknowledg(e|ment))\b"
NORMATIVE = r"(?i)\b(scope|requirements?|shall|must|obligations?)\b"
ADMINISTRATIVE = r"(?i)\b(this\s+(document|publication|playbook)|email\s+to|comments?\s+may\s+be\s+sent|contact\s|printing\s+office|citation\s+information)\b"
EPISTEMIC = r"(?i)\bmay\s+not\s+(align|recognize|apply|capture|reflect|generalize|work|hold)\b"
ACTOR = r"(?i)\b(organization(?:s)?|provider(?:s)?|deployer(?:s)?|user(?:s)?|operator(?:s)?|controller(?:s)?|processor(?:s)?|ai\s+actor(?:s)?)\b"

PROHIBITED = r"\b(shall|must)\s+not\b|prohibit|forbid|unlawful"
#: "may" that neither "only" nor "not" follows: take those away first, then look for any left.
MAY_WITH = r"\bmay\s(only|not\b)"
PLAIN_MAY = r"\bmay\s"
SEVERE = r"(?i)\b(shall|must|prohibit|unlawful|required)\b"
SEVERE_UPPER = r"\b(MUST|SHALL|PROHIBITED|UNLAWFUL)\b"
#: The first 28 characters of the cue patterns as the miner reports them.
CUES = {"deontic": r"\b(shall(?:\s+not)?|must(?:\s+not)?", "exception": r"\b(except|unless|provided\s+that", "exemption": r"\bshall\s+not\s+be\s+required\s+to"}
CUES = {name: source[:28] for name, source in CUES.items()}

ACTIONABLE = r"(?i)\b(shall(?:\s+not)?|must(?:\s+not)?|may\s+not|may\s+only|required?\s+to|prohibited?\s+from|forbidden|prohibited|ensure\s+that|verify\s+that|obliged?\s+to|mandated?\s+to)\b"
BOUND_ACTOR = r"(?i)\b(provider|deployer|user|org|model|agent|developer|admin|operator|controller|processor|organization|system|service)\b"
BOUND_DATA = r"(?i)\b(PHI|PII|data|log|record|request|response|prompt|output|token|model|config|credential|secret|file|report)\b"
BOUND_CONDITION = r"(?i)\b(when|where|if|upon|before|after|within|during|at\s+least|no\s+later\s+than|always|every)\b"
SIGNALS = {
    "io_check": r"\b(prompt|response|output|refus|redact|reply|answer|generat)\b",
    "log_check": r"\b(log|audit|telemetr|trace|event|correlat|monitor|record)\b",
    "config_check": r"\b(config|policy|setting|yaml|json|rule|flag|parameter|threshold)\b",
    "ci_gate": r"\b(ci|cd|pipeline|deploy|build|gate|report|test|scan|lint)\b",
    "data_check": r"\b(dataset|data set|pii\s+tag|license|annotation|metadata|schema)\b",
    "repo_check": r"\b(repo|git|pull\s+request|merge\s+request|code\s+review|branch|commit)\b",
}
REPAIR_CRITICAL = r"\b(critical|fatal|breach|exfiltr|unlawful|gdpr\s+fine)\b"
REPAIR_HIGH = r"\b(shall|must|prohibit|required|forbidden)\b"
REPAIR_MEDIUM = r"\b(should|recommend|prefer)\b"

# Fixed values, as all below but RISK_LITERALS: risk patterns with (weight once found, more for each of up to two hits).
RISKS = {
    "pii": (0.4, 0.15, r"(?i)\b(ssn|social\s*security|passport|driver'?s?\s*license|mrn|medical\s*record|npi)\b"),
    "secrets": (0.6, 0.2, r"(?i)\b(token|api[_-]?key|password|secret|bearer\s+[a-z0-9\-_.]+)\b"),
    "exfil": (0.6, 0.2, r"(?i)\b(base64|hex\s*dump|decode|decrypt|extract|deobfuscat)\w*\b"),
    "bypass": (0.6, 0.2, r"(?i)\b(bypass|disable|turn\s*off|override|ignore)\b.*\b(safeguard|guard|safety|policy|filter|auth|validation)\b"),
    "med_claims": (0.4, 0.15, r"(?i)\b(diagnos(e|is)|treat(ment)?|prescrib(e|ing)|dose|protocol|contraindication)\b"),
    "copyright": (0.4, 0.15, r"(?i)\b(copy(right(ed)?|paste)|verbatim|proprietary|internal\s+code|license)\b"),
    "tenant": (0.4, 0.15, r"(?i)\b(cross[-\s]?tenant|other\s+tenant|outside\s+(workspace|org|boundary))\b"),
}
#: Literals in lower case of which a hit of each risk pattern holds one of every group; texts without them need no pattern.
RISK_LITERALS = {
    "pii": [("ssn", "security", "passport", "license", "mrn", "record", "npi")],
    "secrets": [("token", "api", "password", "secret", "bearer")],
    "exfil": [("base64", "dump", "decode", "decrypt", "extract", "deobfuscat")],
    "bypass": [("bypass", "disable", "off", "override", "ignore"), ("guard", "safety", "policy", "filter", "auth", "validation")],
    "med_claims": [("diagnos", "treat", "prescrib", "dose", "protocol", "contraindication")],
    "copyright": [("copy", "verbatim", "proprietary", "internal", "license")],
    "tenant": [("tenant", "outside")],
}
#: Shapes of secrets: what each adds once.
SHAPES = {"ssn": (0.7, r"\b\d{3}-\d{2}-\d{4}\b"), "hex": (0.4, r"\b[0-9A-Fa-f]{32,}\b"), "base64": (0.4, r"\b[a-zA-Z0-9+/]{40,}={0,2}\b")}
DEFUSER = (0.2, r"(?i)\b(example|sample|demo|mock|placeholder|lorem|ipsum)\b")

# Words that set severity by what a document is and says.
HINTS = {
    "critical": ("safety-critical", "life-critical", "high-risk", "systemic risk"),
    "regulation": ("hipaa", "eu ai act", "gdpr", "45 cfr", "regulation", "law", "statute"),
    "guidance": ("who", "nist", "oecd", "standard", "guidance", "recommendation", "framework"),
    "escalation": ("criminal", "sanction", "liable", "penalty", "fines", "breach"),
}
NEGATIVE = ("must not", "may not", "shall not", "prohibit", "forbid", "forbidden")
CAPTION = r"(?i)^\s*(Figure|Fig\.|Table)\s+(\d+|[A-Za-z]\d*|\d+\.\d+)\b"
