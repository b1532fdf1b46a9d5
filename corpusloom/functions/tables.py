"""Small fixed tables that results depend on."""

from __future__ import annotations

# Words that indexing leaves out.
INDEX_STOP_WORDS = """
the a an is in of and or for to how what why when does with from that this these those would should could
which about their its are was were been being have has had having do did doing will shall may might can must
not no nor but if then else so than too very just only also more most some any each every all both few many
much such own same other into over after before between under above below up down out off on at by as be it
he she we they me him her us them my your his our you i
""".split()

# Words that planning leaves out of a topic.
PLAN_STOP_WORDS = """
the a an is in of and or for to how what why when does with from that could which about their this these those
would should current hypothetical scenarios lead
""".split()

# Words that the report leaves out of a topic.
REPORT_STOP_WORDS = "the a an is in of and or for to how what why when does with from its".split()

# Domains in order, with score, by tier.
DOMAINS = {
    "academic": {
        "arxiv.org": 95, "pubmed.ncbi.nlm.nih.gov": 98, "ncbi.nlm.nih.gov": 97, "nature.com": 98, "science.org": 98,
        "sciencedirect.com": 93, "ieee.org": 93, "acm.org": 92, "springer.com": 90, "wiley.com": 90,
        "researchgate.net": 84, "semanticscholar.org": 86, "jstor.org": 88, "plos.org": 88, "cell.com": 96,
        "thelancet.com": 96, "nejm.org": 97, "bmj.com": 94,
    },
    "government": {
        "who.int": 93, "cdc.gov": 93, "nih.gov": 95, "nasa.gov": 92, "un.org": 88, "europa.eu": 87,
        "worldbank.org": 88, "imf.org": 87, "fda.gov": 93, "nist.gov": 90, "epa.gov": 88,
    },
    "reference": {
        "wikipedia.org": 80, "britannica.com": 85, "merriam-webster.com": 83, "investopedia.com": 74,
        "healthline.com": 72, "mayoclinic.org": 90, "webmd.com": 71, "khanacademy.org": 80, "howstuffworks.com": 62,
    },
    "news": {
        "reuters.com": 90, "apnews.com": 90, "bbc.com": 84, "bbc.co.uk": 84, "theguardian.com": 80,
        "nytimes.com": 82, "washingtonpost.com": 81, "economist.com": 85, "ft.com": 85, "bloomberg.com": 80,
        "wsj.com": 80, "npr.org": 82, "pbs.org": 80, "wired.com": 74, "arstechnica.com": 74,
        "technologyreview.com": 82, "scientificamerican.com": 86, "newscientist.com": 82, "theatlantic.com": 78,
        "vox.com": 70, "techcrunch.com": 65, "theverge.com": 68, "time.com": 72,
    },
    "professional": {
        "developer.mozilla.org": 90, "docs.python.org": 90, "docs.microsoft.com": 84, "learn.microsoft.com": 84,
        "developers.google.com": 86, "cloud.google.com": 82, "aws.amazon.com": 80, "github.com": 72,
        "stackoverflow.com": 68, "docs.github.com": 84,
    },
    "general": {"medium.com": 48, "substack.com": 46, "forbes.com": 62, "businessinsider.com": 58, "huffpost.com": 52},
    "low": {
        "reddit.com": 35, "quora.com": 30, "pinterest.com": 8, "twitter.com": 20, "x.com": 20, "facebook.com": 10,
        "instagram.com": 8, "youtube.com": 30, "tiktok.com": 5,
    },
}

# Suffixes in order, with score and tier; anything else is 48, general.
SUFFIXES = [
    (".edu", 88, "academic"), (".gov", 88, "government"), (".ac", 82, "academic"), (".int", 82, "government"),
    (".mil", 75, "government"), (".org", 58, "general"), (".com", 50, "general"), (".net", 45, "general"),
    (".io", 50, "professional"), (".co", 45, "general"),
]
OTHER_DOMAIN = (48, "general")

# What a URL loses (from 70) for each pattern, and what it gains.
URL_BASE = 70
URL_RULES = [
    ("(?i)/tag/", -35), ("(?i)/category/", -25), ("(?i)/search[/?]", -45), ("(?i)/page/[0-9]+", -20),
    ("(?i)/author/", -25), ("(?i)[?&](s|q|query)=", -30), ("#", -8), ("(?i)\\.(jpg|png|gif|pdf|zip|mp4)$", -55),
    ("(?i)/feed/", -30), ("(?i)/archive/", -15),
    ("/[0-9]{4}/[0-9]{2}/", 12), ("(?i)/research/", 12), ("(?i)/study/", 12), ("(?i)/paper/", 14),
    ("(?i)/report/", 10), ("(?i)/article/", 6), ("(?i)/analysis/", 10), ("(?i)/findings/", 12), ("(?i)/news/", 6),
    ("(?i)/blog/[0-9]{4}", 8),
]

# Dimensions in order: id, label, keywords, query templates.
DIMENSIONS = [
    ("overview", "Overview & Definition",
     ["what is", "definition", "refers to", "is a type", "means", "overview", "introduction"],
     ["what is {t}", "{t} definition and overview", "{t} explained simply", "{t} introduction guide"]),
    ("mechanism", "How It Works",
     ["how", "process", "mechanism", "steps", "works by", "procedure", "method", "approach"],
     ["how does {t} work", "{t} mechanism process explained", "{t} technical architecture", "{t} step by step process"]),
    ("history", "History & Origins",
     ["history", "origin", "founded", "invented", "developed", "background", "timeline", "evolution"],
     ["{t} history origin development", "{t} timeline evolution", "who invented {t}"]),
    ("current", "Current State & Recent Developments",
     ["2024", "2025", "2026", "recently", "current", "today", "latest", "new", "update", "now"],
     ["{t} latest news 2025", "{t} current state developments", "{t} recent updates 2026", "{t} latest breakthroughs"]),
    ("applications", "Applications & Use Cases",
     ["application", "use case", "used for", "example", "industry", "practice", "deploy", "implement"],
     ["{t} real world applications examples", "{t} use cases industry", "{t} implementation case studies", "{t} practical deployment"]),
    ("challenges", "Challenges & Limitations",
     ["challenge", "limitation", "problem", "issue", "drawback", "disadvantage", "concern", "risk", "obstacle"],
     ["{t} challenges limitations problems", "{t} risks concerns drawbacks", "{t} common issues failures", "{t} barriers to adoption"]),
    ("comparison", "Comparisons & Alternatives",
     ["vs", "versus", "compared to", "alternative", "difference", "better than", "similar to"],
     ["{t} vs alternatives comparison", "{t} compared to competitors", "best {t} alternatives", "{t} benchmark comparison"]),
    ("evidence", "Research Evidence & Data",
     ["study", "research", "found that", "evidence", "data", "analysis", "survey", "paper", "peer-reviewed"],
     ["{t} research study evidence peer-reviewed", "{t} scientific data analysis", "{t} statistics survey data", "{t} quantitative evidence"]),
    ("expert", "Expert Opinion & Analysis",
     ["expert", "according to", "opinion", "analyst", "researcher", "professor", "scientist", "specialist"],
     ["{t} expert opinion analysis", "{t} leading researchers views", "{t} industry expert perspectives"]),
    ("future", "Future Outlook & Trends",
     ["future", "trend", "predict", "forecast", "outlook", "next", "coming", "prospect", "potential"],
     ["{t} future trends predictions", "{t} forecast outlook 2026 2027", "{t} emerging trends next generation"]),
    ("controversy", "Controversy & Criticism",
     ["controversy", "criticism", "debate", "oppose", "critique", "disagree", "concern", "ethical"],
     ["{t} criticism controversy ethical debate", "{t} opposition arguments against", "{t} ethical concerns criticism"]),
    ("economics", "Economics & Market Impact",
     ["cost", "price", "market", "economic", "billion", "million", "revenue", "growth", "industry size"],
     ["{t} economic impact market size cost", "{t} market growth revenue forecast", "{t} pricing economics ROI"]),
]

# Which dimensions a role looks into, in the role's own order.
ROLE_DIMENSIONS = {
    "breadth": ["overview", "applications", "history", "economics"],
    "depth": ["mechanism", "evidence", "expert"],
    "recency": ["current", "future"],
    "academic": ["evidence", "expert", "mechanism"],
    "critical": ["challenges", "controversy", "comparison"],
    "statistical": ["evidence", "economics", "overview"],
    "regulatory": ["challenges", "controversy", "current"],
    "technical": ["mechanism", "applications", "evidence"],
    "primary": ["evidence", "expert", "history"],
    "comparative": ["comparison", "challenges", "applications"],
}

# Who fills a gap, whether links are followed, and which tiers are preferred.
GAP_ROLES = {
    "overview": ("breadth", False, []),
    "mechanism": ("technical", True, []),
    "history": ("breadth", False, []),
    "current": ("recency", False, []),
    "applications": ("breadth", False, []),
    "challenges": ("critical", False, []),
    "comparison": ("comparative", False, []),
    "evidence": ("academic", True, ["academic", "government", "reference"]),
    "expert": ("primary", True, ["academic", "news"]),
    "future": ("recency", False, []),
    "controversy": ("critical", False, []),
    "economics": ("statistical", False, []),
}

# Library tags that serve a role.
ROLE_TAGS = {
    "academic": ["academic", "technical"],
    "regulatory": ["legal", "policy"],
    "technical": ["technical", "code"],
    "statistical": ["financial", "reports"],
    "primary": ["reports", "general"],
    "depth": ["technical", "academic"],
    "breadth": ["general", "reports"],
    "recency": ["general", "reports"],
    "critical": ["academic", "policy"],
    "comparative": ["reports", "general"],
}

# Phrases that mark an informative sentence.
KEY_MARKERS = [
    "is a", "is the", "refers to", "known as", "defined as", "found that", "shows that", "research", "study",
    "according to", "estimated", "reported", "discovered", "demonstrated", "evidence", "however", "although",
    "despite", "unlike", "compared to", "increased", "decreased", "improved", "reduced", "percent", "%", "million",
    "billion", "2024", "2025", "2026",
]

# Library priorities in order of preference; score of a local source; its bonus.
PRIORITIES = [("proprietary", 95, 0.15), ("internal", 90, 0.10), ("reference", 85, 0.05), ("general", 75, 0.0)]

# Extensions of files that are indexed.
EXTENSIONS = """
pdf txt md markdown rst org html htm xhtml csv tsv json jsonl xml log yaml yml ini cfg conf tex bib py js ts java c cpp h hpp rs go rb php
swift kt scala sh bash zsh ps1 sql r css scss less ipynb toml env properties
""".split()

# A file's tags by its extension, then by a word in its name.
FILE_TAGS = [
    ("code", "py js ts java c cpp rs go".split()), ("academic", "tex bib".split()), ("data", "sql csv tsv".split()),
    ("document", "md txt rst".split()), ("config", "yaml yml json xml toml".split()),
]
NAME_TAGS = [("legal", "legal contract policy".split()), ("report", "report analysis".split())]

# Selectors of what is not the page's own text.
BOILERPLATE = """
nav header footer .nav .navbar .navigation .header .footer .sidebar .side-bar .widget .cookie-banner .cookie-consent .cookie-notice .gdpr
.consent .popup .modal .overlay .ad .ads .advertisement .advert .banner-ad .social-share .social-links .share-buttons .sharing
.related-posts .related-articles .recommended .comments .comment-section #comments .newsletter .subscribe .subscription .signup .sign-up
.breadcrumb .breadcrumbs .pagination .pager .menu .toc .table-of-contents [role="navigation"] [role="banner"] [role="contentinfo"]
[role="complementary"] [aria-label="cookie"] [class*="cookie"] [id*="cookie"] [class*="gdpr"] [class*="popup"] [class*="modal"]
[class*="overlay"] [class*="sidebar"] [class*="footer"] [class*="header"] [class*="nav-"] [class*="ad-"] [class*="promo"] aside figcaption
noscript iframe
""".split()

# Selectors of elements that tell a page's date.
DATE_SELECTORS = """
meta[property="article:published_time"] meta[name="date"] meta[name="pubdate"] meta[name="DC.date"] meta[itemprop="datePublished"]
time[itemprop="datePublished"] time[datetime]
""".split()
DATE_KEYS = ["datePublished", "dateModified", "uploadDate"]

# URLs that serve a PDF, whatever they end in.
PDF_URLS = [
    r"(?i)\.pdf(\?.*)?$", r"(?i)arxiv\.org/pdf/", r"(?i)arxiv\.org/ftp/", r"(?i)biorxiv\.org/content/.*\.full\.pdf",
    r"(?i)medrxiv\.org/content/.*\.full\.pdf", r"(?i)papers\.ssrn\.com/sol3/Delivery\.cfm", r"(?i)dl\.acm\.org/doi/pdf/",
    r"(?i)ieeexplore\.ieee\.org/stampPDF", r"(?i)link\.springer\.com/content/pdf/", r"(?i)pdfs\.semanticscholar\.org/",
    r"(?i)openreview\.net/pdf", r"(?i)proceedings\.neurips\.cc/paper_files/.*\.pdf", r"(?i)aclanthology\.org/.*\.pdf",
    r"(?i)pnas\.org/doi/pdf/", r"(?i)science\.org/doi/pdf/", r"(?i)nature\.com/articles/.*\.pdf", r"(?i)researchgate\.net/.*/download",
]
PDF_DATE_KEYS = ["CreationDate", "ModDate", "created", "modified"]

# How roles are called, which of them follow links, and which tiers some prefer.
ROLE_LABELS = {
    "breadth": "Breadth", "depth": "Depth", "recency": "Recency", "academic": "Academic", "critical": "Critical",
    "statistical": "Statistical/Data", "regulatory": "Regulatory/Policy", "technical": "Technical Deep-Dive",
    "primary": "Primary Sources", "comparative": "Comparative Analysis",
}
LINK_ROLES = ["depth", "academic", "technical", "primary"]
TIER_ROLES = ["academic", "regulatory"]
SOLID_TIERS = ["academic", "government", "reference"]
