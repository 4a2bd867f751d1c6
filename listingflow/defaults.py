"""Shipped rule sets. All of them are parameters: pass your own to the operators."""

from __future__ import annotations

from listingflow.functions.score import ScoreRules

# Skill terms by category.
SKILL_LEXICONS = {
    "data_analyst": (
        "sql", "python", "pandas", "numpy", "excel", "power bi", "tableau", "dashboard",
        "visualization", "analytics", "kpi", "reporting", "etl", "data modeling",
        "statistics", "hypothesis testing", "a/b testing",
    ),
    "finance_roles": (
        "financial analysis", "fp&a", "budgeting", "forecasting", "excel",
        "financial statements", "variance analysis", "profitability", "cash flow",
        "accounting", "taxation", "sap", "audit", "reconciliation",
    ),
    "agentic_ai": (
        "machine learning", "python", "pandas", "numpy", "scikit-learn", "deep learning",
        "transformers", "huggingface", "mlops", "tensorflow", "pytorch",
        "neural networks", "llm", "rag",
    ),
    "genai_llm": (
        "generative ai", "llm", "rag", "langchain", "prompt engineering", "gpt", "llama",
        "vector database", "chroma", "huggingface", "fine-tuning", "embedding",
        "semantic search",
    ),
    "fresher_ai_ml": (
        "python", "sql", "machine learning", "deep learning", "statistics",
        "data analysis", "pandas", "numpy", "linear algebra",
    ),
}

# Terms that reveal a role.
ROLE_TERMS = {
    "data analyst": ("data analyst", "business analyst", "bi analyst", "analytics"),
    "data scientist": ("data scientist", "ml engineer", "machine learning"),
    "ai engineer": ("ai engineer", "artificial intelligence", "llm", "genai", "rag"),
    "financial analyst": ("financial analyst", "fp&a", "finance analyst"),
    "developer": ("developer", "engineer", "software", "programmer"),
}

SCORE_RULES = ScoreRules(ROLE_TERMS, SKILL_LEXICONS, "data_analyst")

# Thresholds.
MIN_SCORE = 6.0
TARGET_LISTINGS = 50
DUPLICATE_STOP_SHARE = 0.5
ZERO_RUNS_UNHEALTHY = 3
MAX_PAGES = 10

# Keyword to category, first rule with a contained term wins.
CATEGORY_RULES = [
    (("data analyst", "business analyst", "business intelligence", "power bi", "sql", "analytics"), "data_analyst"),
    (("financial", "fp&a", "finance", "accounts", "accountant", "sap"), "finance_roles"),
    (("ai engineer", "machine learning", "ml engineer"), "agentic_ai"),
    (("genai", "llm", "rag", "prompt", "generative"), "genai_llm"),
    (("intern", "fresher"), "fresher_ai_ml"),
    (("data scientist", "data engineer"), "agentic_ai"),
]
DEFAULT_CATEGORY = "data_analyst"

# Title patterns by label.
TITLE_PATTERNS = {
    "genai": (r"\bgenai\b", r"\bgenerative\s+ai\b"),
    "llm": (r"\bllm\b", r"\blarge\s+language\s+model"),
    "sap fico": (r"\bsap\s+fico\b",),
    "agentic ai": (r"\bagentic\s+ai\b",),
    "ai engineer": (r"\bai\s+engineer\b",),
    "machine learning engineer": (r"\bmachine\s+learning\b", r"\bml\s+engineer\b"),
    "business intelligence analyst": (r"\bbusiness\s+intelligence\b", r"\bbi\s+analyst\b"),
    "financial analyst": (r"\bfinancial\s+analyst\b",),
    "data analyst": (r"\bdata\s+analyst\b",),
    "data science": (r"\bdata\s+scientist\b",),
    "data engineering": (r"\bdata\s+engineer\b",),
    "power bi": (r"\bpower\s+bi\b",),
    "fp&a": (r"\bfp&a\b", r"\bfinancial\s+planning\b"),
}

# Precedence of the labels above.
TITLE_PRECEDENCE = (
    "agentic ai", "genai", "llm", "ai engineer", "machine learning engineer",
    "data science", "sap fico", "financial analyst", "fp&a",
    "business intelligence analyst", "power bi", "data engineering", "data analyst",
)

# Keywords by label.
PROFILE_KEYWORDS = {
    "data analyst": (
        "sql", "power bi", "tableau", "excel", "python", "pandas", "numpy", "dashboard",
        "visualization", "analytics", "kpi", "reporting",
    ),
    "business intelligence analyst": (
        "power bi", "tableau", "sql", "dashboard", "reporting", "visualization", "etl",
        "data modeling", "kpi", "business intelligence", "analytics",
    ),
    "financial analyst": (
        "financial analysis", "fp&a", "budgeting", "forecasting", "excel",
        "financial statements", "variance analysis", "profitability", "cash flow",
        "ms excel", "ms-office", "tally", "day-to-day accounting", "data entry",
        "financial record maintenance", "billing", "invoicing", "expense tracking",
    ),
    "ai engineer": (
        "llm", "rag", "langchain", "crewai", "vector database", "chroma", "huggingface",
        "python", "groq", "agentic ai", "prompt engineering",
    ),
    "machine learning engineer": (
        "machine learning", "python", "pandas", "numpy", "scikit-learn", "deep learning",
        "transformers", "huggingface", "mlops",
    ),
    "genai": (
        "generative ai", "llm", "rag", "langchain", "prompt engineering", "gpt", "llama",
        "groq", "vector database", "chroma",
    ),
    "llm": (
        "llm", "large language models", "rag", "langchain", "prompt engineering",
        "fine-tuning", "vector database", "chroma", "huggingface", "groq",
    ),
    "sap fico": (
        "sap", "sap fico", "sap s4 hana", "sap sac", "financial accounting",
        "controlling", "finance", "accounting",
    ),
    "data science": (
        "machine learning", "deep learning", "statistics", "python", "r",
        "predictive modeling", "classification", "regression", "nlp",
    ),
    "power bi": (
        "power bi", "dax", "power query", "power bi service", "dashboard", "reporting",
        "visualization", "data modeling",
    ),
    "fp&a": (
        "fp&a", "financial planning", "budgeting", "forecasting", "variance analysis",
        "financial modeling", "excel", "planning", "ms excel", "ms-office", "tally",
        "day-to-day accounting", "data entry", "financial record maintenance",
        "billing", "invoicing", "expense tracking",
    ),
    "data engineering": (
        "etl", "data pipeline", "data warehouse", "sql", "python", "spark", "airflow",
        "big data", "data integration",
    ),
    "agentic ai": (
        "crewai", "langgraph", "multi-agent", "agent orchestration", "llm", "tool use",
        "autonomous systems", "python", "groq",
    ),
}

# Tie order of the keyword score, and the label when nothing matches.
KEYWORD_PREFERENCE = (
    "agentic ai", "ai engineer", "machine learning engineer", "genai", "llm",
    "data science", "sap fico", "fp&a", "financial analyst",
    "business intelligence analyst", "power bi", "data engineering", "data analyst",
)
DEFAULT_LABEL = "data analyst"

# Labels a response may carry.
RESPONSE_LABELS = (
    "Business Intelligence", "Power BI", "Financial Planning", "Commercial Analytics",
    "GenAI", "Machine Learning", "Data Science", "Python", "Finance Transformation",
    "FP&A", "Data Engineering", "Data Analyst", "AI Engineer",
)

# Opening words and phrases of explanatory lines.
NOTE_PREFIXES = ("i've", "i have", "i added", "i've added", "note:", "note -")
NOTE_PHRASES = ("i've added relevant keywords",)

# Section headings of a document and their labels.
SECTION_HEADINGS = [
    ("PROFESSIONAL SUMMARY", "summary"),
    ("TECHNICAL SKILLS", "skills"),
    ("WORK EXPERIENCE", "work"),
    ("GITHUB PROJECTS", "projects"),
    ("DSA PROJECTS", "dsa_projects"),
    ("EDUCATION", "education"),
    ("CERTIFICATIONS", "certs"),
]

# Sub-headings of the skills section.
SKILL_HEADINGS = (
    "DATA ANALYTICS", "VISUALIZATION & REPORTING", "AI / ML & GENAI", "OTHER SKILLS",
    "PROGRAMMING", "AGENTIC AI", "SAP & ERP", "FINANCE & ACCOUNTING",
)

# Prefixes of link lines in project sections.
LINK_PREFIXES = ("GitHub", "GreatLearning")

# Experience level to the code each source uses.
EXPERIENCE_CODES = {
    "naukri": {
        "Internship": "fresher", "Fresher": "fresher", "0-1 years": "0",
        "1-3 years": "1", "Mid level": "3", "Experienced": "5",
    },
    "linkedin": {
        "Internship": "1", "Fresher": "2", "0-1 years": "2",
        "1-3 years": "3", "Mid level": "4", "Experienced": "5",
    },
    "indeed": {
        "Internship": "entry_level", "Fresher": "entry_level", "0-1 years": "entry_level",
        "1-3 years": "mid_level", "Mid level": "mid_level", "Experienced": "senior_level",
    },
}

# Report columns.
SCRAPED_COLUMNS = ["title", "company", "location", "category", "source", "date", "url", "job_id"]
FILTERED_COLUMNS = ["title", "company", "location", "source", "rejection_reason"]
RECOMMENDED_COLUMNS = [
    "title", "company", "location", "category", "score", "role_score", "skills_score",
    "experience_score", "location_score", "salary_score", "recency_score", "score_reason",
]
APPLIED_COLUMNS = ["title", "company", "location", "score", "profile", "match_pct", "folder"]
REJECTION_REASON = "Blacklisted company/keyword match"
