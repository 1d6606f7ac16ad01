"""Word lists, parameters and labels that results depend on. Keyword lists are defaults; operators take others."""

# Fixed values.
IMPORTANT_KEYWORDS = [
    "breach", "exploit", "vulnerability", "ransomware", "attack", "zero-day", "outage", "incident", "earnings", "ipo", "acquisition", "merger",
    "sanction", "inflation", "gdp", "layoffs", "funding", "tariff", "rate cut", "antitrust", "chip", "semiconductor", "cloud", "datacenter", "ai",
    "model", "launch", "security", "cyber"
]
HIGH_PRIORITY_ENTITIES = [
    "openai", "anthropic", "deepmind", "google", "microsoft", "nvidia", "amd", "tsmc", "asml", "intel", "arm", "github", "cloudflare", "vercel",
    "aws", "amazon web services", "azure", "google cloud", "meta", "apple", "cisa", "sec", "federal reserve", "fed", "ecb", "china", "taiwan",
    "russia", "ukraine", "nato"
]
BUILD_RELEVANCE_KEYWORDS = [
    "agent", "agents", "ai agent", "llm", "large language model", "model release", "api", "sdk", "developer", "developers", "devtool", "devtools",
    "github", "framework", "open source", "cloud", "edge", "infrastructure", "database", "serverless", "observability", "workflow", "automation",
    "security", "zero-day", "vulnerability", "exploit", "ransomware", "breach"
]
ACTIONABILITY_KEYWORDS = [
    "api", "sdk", "release", "launch", "preview", "beta", "open source", "github", "pricing", "funding", "acquisition", "earnings", "partnership",
    "integration", "developer", "migration", "patch", "update", "advisory", "cve", "zero-day", "breach", "outage", "incident", "sanction",
    "sanctions", "export control", "export controls", "tariff", "rates", "fed", "ecb"
]
SCOPE_KEYWORDS = [
    "ai", "agent", "agents", "ai agent", "llm", "large language model", "model", "model release", "foundation model", "inference", "embedding",
    "openai", "anthropic", "deepmind", "nvidia", "gpu", "github", "developer", "developers", "devtool", "devtools", "developer tools", "software",
    "engineering", "api", "apis", "sdk", "cloudflare", "vercel", "security", "cyber", "cybersecurity", "zero-day", "ransomware", "breach", "exploit",
    "vulnerability", "economy", "market", "markets", "business", "startup", "startups", "funding", "ipo", "acquisition", "earnings", "valuation",
    "venture", "saas", "inflation", "gdp", "fed", "ecb", "rates", "sanctions", "export controls", "tariff", "chip", "chips", "semiconductor",
    "taiwan", "china", "energy", "cloud", "cloud infrastructure", "datacenter", "data center", "serverless", "edge", "database", "observability"
]
MAJOR_SECURITY_KEYWORDS = [
    "active exploit", "actively exploited", "breach", "critical", "cisa", "data leak", "emergency patch", "exploited in the wild", "major outage",
    "nation-state", "ransomware", "supply chain", "zero-day", "0-day"
]
DEVELOPER_SECURITY_KEYWORDS = [
    "api", "cloud", "cloudflare", "cve", "developer", "github", "infrastructure", "kubernetes", "npm", "open source", "package", "patch", "python",
    "registry", "sdk", "software supply chain", "vulnerability"
]
GEOPOLITICS_KEYWORDS = [
    "sanction", "sanctions", "export control", "export controls", "war", "taiwan", "china", "russia", "ukraine", "energy", "chip", "chips",
    "semiconductor", "nato", "tariff", "tariffs"
]
#: Practical buckets in the order in which they are tried.
BUCKET_KEYWORDS = {
    "infrastructure_outage": ["cloud outage", "dns", "incident", "latency", "outage", "region down", "service disruption"],
    "security_risk": ["breach", "cve", "exploit", "ransomware", "security", "vulnerability", "zero-day", "0-day", "data leak"],
    "regulatory_risk": ["antitrust", "ban", "compliance", "export control", "export controls", "regulation", "sanction"],
    "geopolitical_risk": ["china", "nato", "russia", "taiwan", "ukraine", "war", "sanction", "tariff", "energy"],
    "market_risk": ["fed", "ecb", "rate", "rates", "inflation", "recession", "selloff", "market", "markets", "yield"],
    "investment_signal": ["earnings", "funding", "ipo", "revenue", "valuation", "venture", "guidance", "capex"],
    "build_opportunity": ["agent", "agents", "api", "sdk", "developer", "devtool", "devtools", "github", "open source", "integration", "framework", "workflow"],
    "competitive_intelligence": ["acquisition", "anthropic", "competitor", "deepmind", "microsoft", "openai", "partnership", "pricing", "startup"],
    "product_trend": ["launch", "release", "rollout", "preview", "beta", "model", "llm", "ai", "feature"],
}
BUCKET_ACTIONS = {
    "build_opportunity": "Check whether this creates a product, automation, or integration opportunity.",
    "product_trend": "Track adoption and compare against current AI/product roadmap assumptions.",
    "market_risk": "Watch second-order effects on tech valuations, budgets, and customer spend.",
    "security_risk": "Review exposure, patches, dependencies, and vendor advisories.",
    "regulatory_risk": "Assess impact on go-to-market, vendor access, chips, data, or compliance.",
    "competitive_intelligence": "Compare positioning, pricing, distribution, and partnership implications.",
    "investment_signal": "Use as a signal for capital flows, startup demand, or public-market sentiment.",
    "geopolitical_risk": "Monitor business impact on supply chains, chips, energy, sanctions, or security.",
    "infrastructure_outage": "Check dependency status pages and incident reports if this touches your stack.",
    "ignore": "No action recommended unless the story becomes more directly relevant.",
}
DEDUPE_STOPWORDS = [
    "a", "about", "after", "again", "against", "all", "amid", "an", "and", "are", "as", "at", "be", "been", "being", "by", "for", "from", "has",
    "have", "how", "in", "into", "is", "it", "its", "latest", "live", "new", "news", "of", "on", "or", "over", "report", "reports", "says", "that",
    "the", "this", "to", "under", "update", "updates", "was", "what", "when", "why", "will", "with"
]
FEEDBACK_STOPWORDS = [
    "about", "after", "also", "amid", "from", "have", "into", "more", "over", "said", "that", "their", "this", "with", "will", "would", "your",
    "oraz", "jest", "jako", "przez", "tego", "tych", "dla", "się"
]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "mc_cid", "mc_eid", "at_campaign", "at_medium"
]
#: (feed, parts of a lower-case category), tried in order; what has none is geopolitics.
FEED_RULES = [
    ("security", ["cyber", "security", "bezpieczeństwo"]),
    ("geopolitics", ["ważne wydarzenia", "geopol", "politics", "world"]),
    ("ai", ["ai", "sztuczna inteligencja"]),
    ("software", ["software", "devtools", "engineering", "status"]),
    ("business", ["gospodarka", "giełda", "biznes", "business", "makro", "market", "rynk", "bank centralny", "regulator", "energy"]),
]
FEEDS = ["geopolitics", "business", "ai", "software", "security"]
NON_CONTENT_ELEMENTS = [
    "script", "style", "nav", "footer", "header", "aside", "form", "button", "svg", "noscript", "template"
]
ENTITIES = {"amp": "&", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "apos": "'"}
FEED_METADATA = [r"\bArticle URL:\s+\S+", r"\bComments URL:\s+\S+", r"\bPoints:\s+\d+", r"#\s*Comments:\s+\d+"]
AUDIO_SIGNAL = r"""<audio\b|type=["']audio/|(?:spotify|soundcloud|megaphone|omny|podbean|audioboom)\.com|(?:audio|podcast)[-_ ]player|data-audio"""
VIDEO_SIGNAL = r"""<video\b|type=["']video/|(?:youtube|youtu\.be|vimeo)\.com|(?:video)[-_ ]player|data-video"""
ACCESS_WALL = r"(?:subscribe|sign in|log in|register)\s+(?:now\s+)?to\s+(?:continue|keep reading|read|unlock)|already (?:a )?subscriber|subscriber-only|dla subskrybentów|zaloguj się,? aby|wykup (?:dostęp|subskrypcję)"
IMPLICIT_WEIGHTS = {"fast_read": 0.5, "read": 1.25, "save": 2.0, "source_open": 0.75}
#: Behavioural signals: (weight, confidence).
BEHAVIOUR = {"save": (0.8, 0.85), "read": (0.5, 0.65), "source_open": (0.4, 0.6), "fast_read": (0.25, 0.4)}
HALF_LIFE_DAYS = 45
STAGES = ["source_fetch", "article_normalization", "story_clustering", "enrichment", "editorial_scoring", "reader_publication", "finalization"]
# End of fixed values.

# Groups of keywords that a reader turns on as one, by kind.
KEYWORD_GROUPS = {
    "avoid": {
        "celebrity": ["celebrity", "influencer", "royal family", "red carpet", "box office", "gossip"],
        "sports": ["sports", "football", "soccer", "nba", "nfl", "tennis", "olympics"],
        "crypto-price": ["bitcoin price", "crypto rally", "memecoin", "token", "airdrop", "nft"],
        "soft-launches": ["launches", "teases", "rumor", "leak", "unboxing", "preview"],
    },
    "prefer": {
        "ai-infra": ["ai", "nvidia", "gpu", "semiconductor", "data center", "model", "inference"],
        "markets-policy": ["markets", "inflation", "central bank", "fed", "ecb", "energy", "regulation"],
        "security-incidents": ["security", "breach", "ransomware", "vulnerability", "cve", "exploit", "incident"],
        "engineering": ["software", "developer", "open source", "cloud", "kubernetes", "database", "api"],
        "geopolitics": ["china", "russia", "ukraine", "trade", "sanctions", "nato", "election"],
    },
}
# End of fixed values.
