"""Word lists, weights, thresholds and patterns that results depend on."""

# Results are defined by these exact lists, numbers and patterns.

ONSITE_PHRASES = [
    "onsite", "on-site", "on site", "in-office", "in office", "hybrid", "days per week", "days a week in",
    "required in office", "must be local", "must live in", "relocation required", "relocation",
]
SCAM_HARD_PHRASES = [
    "upfront fee", "pay an upfront", "wire transfer", "western union", "send money", "pay for training",
    "training fee", "purchase the equipment", "purchase equipment",
]
SCAM_SOFT_PHRASES = ["telegram", "whatsapp", "no interview", "guaranteed income", "earn $", "get rich", "no experience necessary"]
TOXIC_PHRASES = [
    "unpaid overtime", "nights and weekends", "work hard, play hard", "we are a family", "we're a family", "wear many hats",
    "always on", "high-pressure", "high pressure", "do whatever it takes", "no work-life balance",
]
STAFFING_PHRASES = [
    "on behalf of our client", "our client is seeking", "our client is looking", "our client, a", "staffing firm",
    "recruitment agency", "recruiting agency", "contract through us", "staffing agency",
]
STAFFING_COMPANY_WORDS = ["staffing", "recruiting", "talent acquisition"]
ILLEGAL_PHRASES = ["unpaid training", "training is unpaid", "must purchase your own", "buy your own equipment", "pay for your equipment"]
SKILL_WORDS = [
    "typescript", "javascript", "python", "java", "golang", "go", "rust", "php", "c#", "c++",
    "react", "vue", "angular", "svelte", "next.js", "nuxt", "node.js", "express", "fastapi",
    "django", "laravel", "rails", "spring", ".net",
    "sql", "postgres", "mysql", "sqlite", "mongodb", "redis", "elasticsearch",
    "docker", "kubernetes", "terraform", "aws", "gcp", "azure", "ci/cd", "jenkins", "github actions",
    "graphql", "rest", "grpc", "kafka", "rabbitmq",
    "linux", "bash", "git", "figma", "jira",
    "machine learning", "ml", "llm", "prompt engineering", "data pipeline", "etl",
    "microservices", "serverless", "websockets", "oauth", "jwt",
    "unit testing", "tdd", "agile", "scrum", "kanban",
]
#: Title words and the years they usually ask for, first match first.
TITLE_YEARS = [
    (["principal"], 10), (["staff"], 8), (["lead", "manager", "director"], 7),
    (["senior", "sr."], 5), (["junior", "jr."], 1), (["intern"], 0),
]
CANADA_NAMES = [
    "canada", "québec", "quebec", "ontario", "british columbia", "alberta", "manitoba", "saskatchewan", "nova scotia",
    "new brunswick", "newfoundland", "prince edward", "toronto", "montréal", "montreal", "vancouver", "calgary", "ottawa",
    "edmonton", "winnipeg", "waterloo", "halifax",
]
CANADA_CODES = ["bc", "on", "qc", "ab", "mb", "sk", "ns", "nb", "nl", "pe"]
US_NAMES = [
    "united states", "usa", "u.s.", "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming", "district of columbia", "san francisco", "seattle", "austin",
    "boston", "chicago", "denver", "los angeles", "san jose", "san diego", "portland", "atlanta", "dallas", "houston",
    "phoenix", "miami",
]
US_CODES = [
    "us", "al", "ak", "az", "ar", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md",
    "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc",
    "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
]
#: Role families and the title words for them, first match first.
ROLE_FAMILIES = [
    ("product manager", ["product manager", "product owner"]),
    ("ux designer", ["ux", "ui designer", "product designer", "user experience"]),
    ("data scientist", ["data scientist", "machine learning", "ml engineer", "ai engineer"]),
    ("data engineer", ["data engineer", "data engineering", "analytics engineer"]),
    ("devops / sre", ["devops", "site reliability", "sre", "platform engineer", "infrastructure engineer", "cloud engineer"]),
    ("qa / tester", ["qa", "quality assurance", "test engineer", "sdet"]),
    ("frontend developer", [
        "frontend", "front-end", "front end", "react developer", "angular developer", "vue developer", "ui developer",
        "web developer",
    ]),
    ("system administrator / it support", [
        "system administrator", "sysadmin", "systems administrator", "it support", "help desk", "network administrator",
        "it technician",
    ]),
    ("software developer", [
        "software", "developer", "engineer", "programmer", "backend", "back-end", "full stack", "full-stack", "mobile",
        "android", "ios",
    ]),
]
JUNIOR_TITLE_WORDS = ["junior", "jr.", "entry", "intern", "co-op", "coop", "new grad", "associate"]
SENIOR_TITLE_WORDS = ["senior", "sr.", "lead", "principal", "staff", "architect"]
BAND_MULTIPLIERS = {"junior": 0.7, "mid": 1.0, "senior": 1.3}
#: Country, currency, role family, lower quartile, median, upper quartile of yearly pay.
SALARY_BENCHMARKS = [
    ("CA", "CAD", "data engineer", 90000, 115000, 145000),
    ("CA", "CAD", "data scientist", 85000, 110000, 140000),
    ("CA", "CAD", "devops / sre", 90000, 118000, 150000),
    ("CA", "CAD", "frontend developer", 75000, 98000, 125000),
    ("CA", "CAD", "product manager", 95000, 125000, 160000),
    ("CA", "CAD", "qa / tester", 55000, 72000, 92000),
    ("CA", "CAD", "software developer", 82000, 108000, 138000),
    ("CA", "CAD", "system administrator / it support", 55000, 75000, 95000),
    ("CA", "CAD", "ux designer", 65000, 85000, 108000),
    ("US", "USD", "data engineer", 108000, 140000, 178000),
    ("US", "USD", "data scientist", 105000, 136000, 175000),
    ("US", "USD", "devops / sre", 110000, 142000, 182000),
    ("US", "USD", "frontend developer", 88000, 118000, 152000),
    ("US", "USD", "product manager", 115000, 150000, 190000),
    ("US", "USD", "qa / tester", 65000, 85000, 110000),
    ("US", "USD", "software developer", 98000, 130000, 170000),
    ("US", "USD", "system administrator / it support", 62000, 82000, 106000),
    ("US", "USD", "ux designer", 78000, 103000, 135000),
]
SECTION_GROUPS = [
    ("responsibilities", ["responsibilities", "you will", "what you'll do", "day-to-day", "your role"]),
    ("tech stack", ["tech stack", "technologies", "tools we use", "stack:"]),
    ("company/team", ["about us", "about the company", "our team", "who we are"]),
    ("compensation/benefits", ["benefits", "perks", "compensation", "pto", "health insurance"]),
]
QUEBEC_PLACES = [
    "québec", "quebec", "montréal", "montreal", "laval", "gatineau", "longueuil", "sherbrooke", "saguenay", "lévis", "levis",
    "trois-rivières", "trois-rivieres", "terrebonne", "saint-jean-sur-richelieu", "repentigny", "drummondville", "granby",
    "rimouski", "shawinigan", "chicoutimi", "brossard", "mirabel", "blainville",
]
FRENCH_WORDS = [
    "le", "la", "les", "des", "de", "du", "est", "sont", "nous", "vous", "une", "dans", "pour", "avec", "sur", "qui", "que",
    "aux", "cette", "ces", "être", "avoir", "plus", "par", "vos", "nos", "votre", "notre", "aussi", "comme", "mais", "chez",
    "entre", "poste", "équipe", "travail", "emploi", "entreprise", "candidat", "expérience", "compétences",
]
FRENCH_LETTERS = "[àâäéèêëîïôöùûüç]"
LANGUAGES = [
    ("en", "English", ["english", "anglais"]),
    ("fr", "French", ["french", "français", "francais"]),
    ("es", "Spanish", ["spanish", "espagnol", "español", "espanol"]),
    ("de", "German", ["german", "allemand", "deutsch"]),
    ("pt", "Portuguese", ["portuguese", "portugais", "português", "portugues"]),
    ("it", "Italian", ["italian", "italien", "italiano"]),
    ("zh", "Mandarin", ["mandarin", "chinese", "chinois", "普通话", "中文"]),
    ("ar", "Arabic", ["arabic", "arabe", "العربية"]),
]
#: Phrases that require a language; {name} stands for its written forms.
LANGUAGE_PHRASES = [
    "fluent(?:ly)? in {name}",
    "fluency in {name}",
    "{name} (?:is )?(?:required|mandatory|essential)",
    "(?:must|required to) speak {name}",
    "speaking {name}",
    "{name}[- ]speaking",
    "proficien(?:t|cy) in {name}",
    "(?:bilingual|bilingue)(?: in)? {name}",
    "maîtrise (?:du|de la|de l['’]|de) {name}",
    "{name} (?:exigé|exigée|exigés|exigées|requis|requise|requises|obligatoire|indispensable)",
    "{name} courant(?:e|s|es)?",
    "(?:doit|devra|doivent) parler (?:le |la |l['’]|les )?{name}",
]
#: Phrases that require two languages.
LANGUAGE_PAIR_PHRASES = [
    r"(?:bilingual|bilingue) ({name})\s*(?:et|and|/|-)\s*({name})",
    "fluent in ({name}) (?:and|et) ({name})",
    "maîtrise (?:du|de la|de l['’]|de) ({name}) (?:et|and) ({name})",
    "({name}) (?:and|et) ({name}) (?:is )?(?:required|mandatory|essential|exigé|exigée|requis|requise|obligatoire)",
]
SALARY_RANGE = r"([$€£])\s*([\d,]+(?:\.\d+)?)\s*([kK])?\s*(?:-|–|—|to)\s*([$€£])?\s*([\d,]+(?:\.\d+)?)\s*([kK])?"
SALARY_HOURLY = r"(?i)([$€£])\s*([\d,]+(?:\.\d+)?)\s*(?:/hr|/hour|per hour)"
SALARY_SINGLE = r"([$€£])\s*([\d,]+(?:\.\d+)?)\s*([kK])?"
YEARS_ASKED = r"(?i)(\d+)\s*\+?\s*years?\s+(of\s+)?(experience|exp(?![A-Za-z0-9_]))"
COMPANY_FORMS = ["inc", "llc", "ltd", "corp", "co", "gmbh", "sas", "pty"]
COMPANY_FORM_TOKENS = [
    "inc", "ltd", "llc", "llp", "corp", "corporation", "company", "co", "group", "holdings", "plc", "sa", "ag", "gmbh", "bv",
    "nv", "srl", "sarl", "pty", "ltée", "ltee",
]
SECRET_PARAMETERS = ["app_id", "app_key", "api_key", "apikey", "access_token", "token", "secret", "password", "auth"]
REVIEW_HOSTS = ["glassdoor.", "indeed."]
FLAG_TYPES = [
    "scam_risk", "fake_repost", "remote_misleading", "salary_below_market", "toxic_culture", "illegal_practice",
    "staffing_intermediary", "quebec_language_law",
]
CHANCE_WEIGHTS = {"skill_overlap": 0.5, "seniority_fit": 0.3, "realism": 0.2, "learned_match": 0.15}
QUALITY_WEIGHTS = {"salary_transparency": 0.25, "remote_credibility": 0.35, "description_completeness": 0.4, "company_reputation": 0.2}
COMBINED_WEIGHTS = {"chance": 0.55, "quality": 0.45}
SENTIMENT_SCORES = {"positive": 0.85, "mixed": 0.55, "negative": 0.25}
VALIDATOR_COST = {"keyword": 0, "semantic": 1, "llm_judge": 2}
DUPLICATE_SIMILARITY = 0.92
SEMANTIC_DEFAULT = 0.5
FLAG_SIMILARITY = 0.65
REPOSTS_FOR_FLAG = 3
SALARY_FLOOR = 30000
FRENCH_SIGNALS = 10
REPOST_WINDOW_MS = 90 * 86_400_000
INTEL_FRESH_MS = 30 * 86_400_000
LABELS_NEEDED, LABELS_OF_EACH = 20, 5
CLUSTER_ITEMS, CLUSTER_CORROBORATION = 2, 100
#: Tracks of planned searches and the planner's keys for them.
PLAN_KEYS = {"blended": "blendedQueries", "positive": "positiveQueries", "negative": "negativeQueries"}
PLANNED_PER_TRACK, PLANNED_QUERIES = 2, 6
EVIDENCE_CHARACTERS = 16000
NO_REPUTATION = "no notable reputation signals found"
MODEL_FAMILY, MODEL_PUBLISHER = "bge-[^/]*$", "BAAI"
SEARCH_ANCHOR = r'(?is)<a[^>]*rel="nofollow"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
SEARCH_TARGET = "uddg=([^&\"']+)"
#: Names under which review payloads hold lists and fields, first that is there.
REVIEW_LISTS = ["results", "companies", "reviews", "items"]
REVIEW_FIELDS = {
    "candidate_name": ["name", "company_name", "title"],
    "candidate_id": ["id", "company_id", "companyId"],
    "overall_rating": ["overall_rating", "rating", "overallRating"],
    "review_count": ["review_count", "reviews_count", "reviewCount", "total_reviews"],
    "overview_url": ["link", "url", "glassdoor_url", "website"],
    "summary": ["summary", "headline", "title"],
    "pros": ["pros"],
    "cons": ["cons"],
    "advice": ["advice_to_management", "advice"],
    "job_title": ["job_title", "jobTitle"],
    "rating": ["rating", "overall_rating"],
    "review_url": ["url", "link"],
}
#: One board's categories by what users write.
MUSE_CATEGORIES = {
    "software": "Software Engineering", "software engineering": "Software Engineering", "engineering": "Engineering", "data": "Data Science",
    "data science": "Data Science", "design": "Design", "ux": "Design", "marketing": "Marketing", "product": "Product Management",
    "product management": "Product Management", "sales": "Sales", "operations": "Operations", "hr": "Human Resources",
    "human resources": "Human Resources", "finance": "Finance", "legal": "Legal",
}
ADZUNA_PAGE_ROWS, ADZUNA_PAGES = 50, 2
DEFAULT_SOURCES = ["hackernews", "remoteok", "arbeitnow", "themuse"]
#: Answers that users choose from, and what they stand for.
SALARY_FLOORS = {"any": None, "60000": 60000, "80000": 80000, "100000": 100000, "120000": 120000}
EXPERIENCE_YEARS = {"any": None, "0-2": 1, "3-5": 4, "6-9": 7, "10+": 12}
WORK_MODES = ["any", "remote", "hybrid", "onsite"]
SESSION_STATES = ["evaluating", "scoring", "researching", "done", "failed"]
SESSION_RETENTION_MS = 24 * 60 * 60 * 1000
SESSION_INTEL_BUDGET_S, SESSION_INTEL_POLL_S, SESSION_INTEL_COMPANIES = 180, 2, 5
CARD_TITLE, CARD_TEXT, CARD_TEXT_LEAST, PAGE_TEXT = 256, 1100, 200, 6000
FLAG_LABELS = {
    "scam_risk": ("Scam risk", "Risque d’arnaque"),
    "fake_repost": ("Fake repost", "Republication suspecte"),
    "remote_misleading": ("Misleading remote", "Télétravail trompeur"),
    "salary_below_market": ("Salary below market", "Salaire sous le marché"),
    "toxic_culture": ("Toxic culture", "Culture toxique"),
    "illegal_practice": ("Illegal practice", "Pratique illégale"),
    "staffing_intermediary": ("Staffing intermediary", "Intermédiaire de placement"),
    "quebec_language_law": ("Québec language law", "Charte de la langue française"),
}
#: Settings of model services in the environment, and their defaults.
MODEL_SETTINGS = {
    "LLM_PROVIDER": "ollama", "LLM_DEEP_PROVIDER": "", "LLM_MODEL": "hermes3:8b", "LLM_DEEP_MODEL": "", "LLM_TIMEOUT_SECONDS": "120",
    "OLLAMA_BASE_URL": "http://llm:11434", "LLAMACPP_BASE_URL": "http://host.docker.internal:8080", "HOSTED_BASE_URL": "", "HOSTED_API_KEY": "",
    "EMBEDDING_MODEL": "bge-small-en-v1.5",
}
