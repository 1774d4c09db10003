"""Rule tables and constants (data only).

FIXED VALUES: everything in this module must equal the behaviour being
re-implemented (labels, order, patterns, rates).  Patterns are written in
Python/Java regex syntax; ``paygrid.functions.regex`` turns them into Spark
expressions.  Lists are ordered: the first matching rule wins.
"""

# --- FIXED VALUES: currency rates to USD -----------------------------------
TO_USD = {
    "USD": 1.0,
    "EUR": 1.05,
    "GBP": 1.27,
    "CAD": 0.72,
    "AUD": 0.64,
}

# --- FIXED VALUES: department of a posting, from its title (16 labels + Other)
DEPARTMENT_RULES = [
    ("Technical Program Management",
     r"technical program manage|TPM\b"),
    ("Safeguards (Trust & Safety)",
     r"threat (investigat|collect)|account abuse|CBRN"
     r"|safeguards analyst|safeguards.{0,15}(infrastructure|data infra)"
     r"|biological safety|red team engineer.{0,10}safeguards"
     r"|product policy manager|policy manager.{0,20}(harm|cyber|frontier)"
     r"|offensive security research.{0,10}safeguards|scaled abuse"),
    ("AI Public Policy & Societal Impacts",
     r"policy|external affairs|geopolitics|national security"
     r"|societal impacts?|research economist"),
    ("Communications",
     r"communications (manager|lead|director)|head of.{0,15}communications"),
    ("Compute",
     r"data center|compute (capacity|efficiency|platform)"
     r"|transaction manager|research compute|capacity.{0,10}(delivery|efficiency)"),
    ("Data Science & Analytics",
     r"analytics data|data (science|analytics)|analytics.{0,5}engineering"),
    ("Finance",
     r"finance|accounti?n?g|(?<!\w)tax(?!onom)|payroll|revenue (account|system)"
     r"|deal desk|order management|corporate (development|finance)"
     r"|FP&A|treasury|SOX|billing|government incentive|transfer pricing"),
    ("Legal",
     r"counsel|(?<!\w)legal|ediscovery|contracts manager"
     r"|compliance (oversight|lead)|trade compliance|IP legal"),
    ("People",
     r"recruit|immigration|administrative business partner"
     r"|internal mobility|people (program|senior)|(?<!\w)HR(?!\w)"
     r"|human resources|onboarding.{0,10}lead"),
    ("Marketing & Brand",
     r"marketing|(?<!\w)brand(?!\w)|video (director|producer)"
     r"|social media|event designer|presentation design"
     r"|copy and content|developer community|community lead|GTM narrative"),
    ("Sales",
     r"account (executive|coordinator)|solutions? architect"
     r"|customer success|business development|(?<!\w)[BS]DR(?!\w)"
     r"|forward deployed|applied AI|partner (sales|solutions|operations)"
     r"|evangelist|incentive compensation|reseller|cosell"
     r"|GTM (strategy|systems|onboarding)|nonprofit account"
     r"|partner.{0,5}(lead|manager).{0,15}(cloud|system|global|reseller)"
     r"|head of.{0,15}(GTM|solution)"),
    ("Security",
     r"application security|IT (support|systems|engineering|audiovisual)"
     r"|platform.{0,10}security|security (engineer|software|GRC|risk|technology)"
     r"|cloud security|detection.{0,5}response|insider risk"
     r"|offensive security(?!.*safeguards)|protective intelligence"
     r"|campus security|access management|customer trust|GRC"
     r"|audiovisual|security development|vulnerability"),
    ("Product Management, Support, & Operations",
     r"product (manager|lead|support|operations|management)"
     r"|developer relations|support operations|research product manager"),
    ("AI Research & Engineering",
     r"research (engineer|scientist|manager)|machine learning|(?<!\w)ML(?!\w)"
     r"|alignment|interpretability|pre-?training|post.?training"
     r"|reinforcement learning|frontier red team|kernel engineer"
     r"|performance engineer|discovery|safety fellow|security fellow"
     r"|reward model|data operations manager|AI observability"
     r"|developer education|education (labs|platform)|certification content"
     r"|training content|human data|encoding librar"),
    ("Software Engineering - Infrastructure",
     r"inference|(?<!\w)systems(?!\w)|sandboxing|networking"
     r"|continuous integration|observability|developer productivity"
     r"|data infrastructure|database|AI reliability|autonomous agent infra"
     r"|accelerator platform"),
    ("Engineering & Design - Product",
     r"software engineer|engineering manager|design engineer"
     r"|prompt engineer|model quality|full.?stack"),
]
DEFAULT_DEPARTMENT = "Other"

# --- FIXED VALUES: seniority from title (first match wins, default Mid-Level)
SENIORITY_RULES = [
    ("Intern / Fellow", r"\b(intern|fellow|apprentice)\b"),
    ("Junior", r"\b(junior|jr\.?|entry[ -]level|associate)\b"),
    ("Senior", r"\b(senior|sr\.?)\b"),
    ("Staff / Principal", r"\b(staff|principal)\b"),
    ("Lead", r"\b(lead\b|tech lead)\b"),
    ("Manager", r"\b(manager|management)\b"),
    ("Director+", r"\b(director|head of|VP|vice president|chief|president|C-suite)\b"),
]
DEFAULT_SENIORITY = "Mid-Level"

SENIORITY_ORDER = [
    "Intern / Fellow", "Junior", "Mid-Level", "Senior",
    "Staff / Principal", "Lead", "Manager", "Director+",
]

# --- FIXED VALUES: 15-bucket department from the board's department name ----
NORMALIZED_DEPARTMENT_RULES = [
    ("Research", r"\bresearch\b"),
    ("Manufacturing", r"\bmanufactur"),
    ("Design", r"\bdesign\b"),
    ("Engineering", r"\bengineering\b|\bsoftware\b|\bhardware\b|\binfrastructure\b"),
    ("Product", r"\bproduct\b"),
    ("People", r"\bpeople\b|\brecruit|\bHR\b|\bhuman resources\b"),
    ("Finance", r"\bfinance\b|\baccounting\b"),
    ("Legal", r"\blegal\b|\bcounsel\b"),
    ("Sales & BD", r"\bsales\b|\bbusiness development\b|\b[BS]DR\b|\bBD\b|\bGTM\b|\bgo.to.market\b"),
    ("Marketing & Comms", r"\bmarketing\b|\bbrand\b|\bcommunication"),
    ("Public Policy", r"\bpolicy\b|\bpublic affairs\b|\bsocietal impacts?\b|\bgeopolitics\b"),
    ("Security & Compliance", r"\bsecurity\b|\bsafeguard|\bcompliance\b"),
    ("IT", r"\bIT\b|\binformation technology\b"),
    ("Operations", r"\boperation|\bcompute\b|\bdata center\b|\bprocurement\b|\breal estate\b|\bsupply chain\b"),
]

WORK_MODES = ["Remote-Friendly", "Office-Only", "Unknown"]

# --- FIXED VALUES: skill keywords searched in descriptions (case-insensitive)
SKILL_KEYWORDS = [
    ("Python", r"\bPython\b"),
    ("Java", r"\bJava\b(?!Script)"),
    ("JavaScript", r"\bJavaScript\b"),
    ("TypeScript", r"\bTypeScript\b"),
    ("Go", r"\bGo(?:lang)?\b"),
    ("Rust", r"\bRust\b"),
    ("C/C++", r"\bC\+\+\b|\bC programming\b"),
    ("SQL", r"\bSQL\b"),
    ("R", r"\bR\b(?= programming| language| (?:and|or) )"),
    ("Scala", r"\bScala\b"),
    ("Kotlin", r"\bKotlin\b"),
    ("Ruby", r"\bRuby\b"),
    ("PyTorch", r"\bPyTorch\b"),
    ("TensorFlow", r"\bTensorFlow\b"),
    ("JAX", r"\bJAX\b"),
    ("LLMs", r"\bLLM[s]?\b|large language model"),
    ("NLP", r"\bNLP\b|natural language processing"),
    ("Deep Learning", r"\bdeep learning\b"),
    ("Machine Learning", r"\bmachine learning\b"),
    ("Transformers", r"\btransformer[s]?\b"),
    ("RLHF", r"\bRLHF\b"),
    ("Fine-tuning", r"\bfine[- ]?tun"),
    ("RAG", r"\bRAG\b"),
    ("AWS", r"\bAWS\b"),
    ("GCP", r"\bGCP\b|Google Cloud"),
    ("Azure", r"\bAzure\b"),
    ("Kubernetes", r"\bKubernetes\b|\bk8s\b"),
    ("Docker", r"\bDocker\b"),
    ("Terraform", r"\bTerraform\b"),
    ("Linux", r"\bLinux\b"),
    ("Spark", r"\bSpark\b"),
    ("Snowflake", r"\bSnowflake\b"),
    ("dbt", r"\bdbt\b"),
    ("Postgres", r"\bPostgres\b|\bPostgreSQL\b"),
    ("Redis", r"\bRedis\b"),
    ("Git", r"\bGit\b(?!Hub)"),
    ("CI/CD", r"\bCI/?CD\b"),
    ("Agile", r"\bAgile\b|\bScrum\b"),
    ("React", r"\bReact\b"),
    ("Node.js", r"\bNode\.?js\b"),
    ("APIs", r"\bAPI[s]?\b"),
    ("GraphQL", r"\bGraphQL\b"),
    ("REST", r"\bREST\b(?:ful)?"),
    ("Cross-functional", r"\bcross[- ]?functional\b"),
    ("Stakeholder mgmt", r"\bstakeholder\b"),
    ("AI Safety", r"\bAI safety\b|\bsafety research\b"),
]

# --- FIXED VALUES: education requirement patterns (case-insensitive) -------
EDU_PATTERNS = [
    ("PhD / Doctorate", r"\bPh\.?D\b|\bdoctora[lt]e?\b"),
    ("Master's", r"\bMaster'?s?\b|\bM\.?S\.?\b(?= in| degree)|\bMBA\b"),
    ("Bachelor's", r"\bBachelor'?s?\b|\bB\.?S\.?\b(?= in| degree)|\bB\.?A\.?\b(?= in| degree)|\bundergraduate degree\b"),
    ("CS / CompSci", r"\bcomputer science\b|\bCS\b(?= degree| or)"),
    ("Math / Statistics", r"\bmathematics\b|\bstatistics\b|\bmath\b(?= or| degree)"),
    ("Physics", r"\bphysics\b"),
    ("JD / Law", r"\bJ\.?D\.?\b|\blaw degree\b|\bbar\b(?= admission| exam)"),
]

# --- FIXED VALUES: experience patterns -------------------------------------
YOE_PATTERN = (
    r"(\d{1,2})\s*(?:\+|or more)?\s*(?:-\s*(\d{1,2})\s*)?(?:\+)?\s*years?\b"
    r"(?:\s+of\s+(?:relevant\s+|professional\s+|industry\s+|hands[- ]on\s+)?"
    r"(?:experience|work))?"
)
YOE_FIRST_PATTERN = r"(\d+)\+?\s*years?"
YOE_MIN, YOE_MAX = 1, 25

# --- FIXED VALUES: scope signals searched in lower-cased descriptions ------
SCOPE_BASE = 5
BUILDER_PATTERNS = [
    r"from scratch", r"ground up", r"greenfield", r"first hire",
    r"founding", r"build out", r"build\b.*from",
]
OWNER_PATTERNS = [
    r"\bown\b", r"define the strategy", r"set the vision",
    r"\broadmap\b", r"lead the\b", r"shape the",
]
LEADER_PATTERNS = [
    r"hire and manage", r"build a team", r"cross-functional leadership",
    r"manage a team", r"grow the team",
]
CONTRIBUTOR_PATTERNS = [
    r"contribute to", r"\bassist\b", r"join a team",
    r"report to", r"work under", r"support the team",
]
SCOPE_WEIGHTS = (2, 2, 1, -1)  # builder, owner, leader, contributor

# --- FIXED VALUES: content-family titles ----------------------------------
CONTENT_FAMILY_PATTERNS = [
    r"content.*knowledge|knowledge.*management",
    r"certification content|training content",
    r"content (designer|design|developer|engineer|lead|marketing|manager)",
    r"copy and content",
    r"technical video content",
    r"technical (documentation|writer|writing)",
    r"prompt engineer.*librarian",
    r"\bcopywriter\b",
    r"\beditorial\b|managing editor",
    r"developer education|consumer education",
]
CONTENT_FAMILY_EXCLUDE = r"brand designer"

# --- FIXED VALUES: salary text grammar -------------------------------------
DASH = r"(?:–|—|-|–|—|\s+to\s+|\s+and\s+)"
CURRENCY_SYMBOL = r"(\$|£|€)"
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
UNIT_SUFFIX = r"(?:/\w+)?"
CURRENCY_CODE = r"\b(USD|EUR|GBP|CAD|AUD)\b"
SYMBOL_CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP"}
UNIT_RULES = [
    ("annual", r"\bAnnual\b|\bper year\b|\byearly\b"),
    ("hourly", r"\bhour\b|\bhourly\b|\bper hour\b|/hr\b"),
    ("monthly", r"\bmonth\b|\bmonthly\b|\bper month\b"),
    ("weekly", r"\bweek\b|\bweekly\b|\bper week\b"),
]
# second ("re-parse") grammar knows two units and a shorter dash set
REPARSE_UNIT_RULES = [
    ("annual", r"\bAnnual\b|\bper year\b|\byearly\b"),
    ("hourly", r"\bhour\b|\bhourly\b"),
]
REPARSE_DASH = r"(?:–|—|-|—|\s+to\s+)"
DESCRIPTION_CLASS = r"job[-_]?description"
BODY_CLASS = r"body"
COMPENSATION_SENTENCE = r"Compensation will be[^.]*\$[^.]+\."
SALARY_HEADINGS = [r"\bAnnual Salary\b", r"\bSalary\b", r"\bCompensation\b", r"\bPay\b"]
SALARY_MENTION = r"(Annual Salary|Salary|Compensation).{0,400}"
SALARY_BLOCK_TAGS = ["h1", "h2", "h3", "h4", "strong", "b", "p", "span", "div", "li"]
SALARY_SIBLINGS = 8
SALARY_WINDOW = 500
SALARY_CONTEXT = 80

# --- FIXED VALUES: histogram bin counts -------------------------------------
BINS_MID = 30
BINS_RANGE = 25
BINS_DASHBOARD = 25
BINS_DAYS_OPEN = 40
BINS_ROLE_GAP = 35

# --- FIXED VALUES: comparables ladder ---------------------------------------
SCOPE_TOLERANCE = 2
SCOPE_TOLERANCE_WIDE = 3
MIN_COMPARABLES = 5

# --- FIXED VALUES: extra stopwords for word frequencies (job-posting boilerplate)
WORD_FREQ_EXTRA_STOPWORDS = """
    company team work role working will also join help us our we you your
    strong experience years including ability new across within well one may able use
    including make take first best mission create position expected salary range annual
    compensation hybrid location san francisco new york seattle logistics requirements
    workspace offer benefits equity remote friendly travel required states united
    applicant knowledge education abilities internal alignment market data offers
    restricted stock units bonus determined paid
""".split()
WORD_TOKEN = r"[a-z][a-z']+"
WORD_MIN_LEN = 3          # length > 2
WORD_TOP_N = 200
DEPT_MIN_TEXT = 100       # department text must exceed 100 characters

# --- FIXED VALUES: bigram phrase extraction stopwords -----------------------
PHRASE_STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "you", "will",
    "our", "are", "from", "have", "your", "about", "been", "more",
    "their", "into", "also", "who", "can", "all", "has", "than",
    "its", "may", "other", "new", "not", "but", "what", "which",
    "when", "how", "each", "some", "such", "both", "between",
    "should", "would", "could", "across", "within", "including",
    "through", "well", "these", "those", "ability", "experience",
    "work", "working", "team", "role", "join", "looking", "ideal",
    "candidate", "strong", "years", "minimum", "preferred", "plus",
]
PHRASE_TOP_N = 12
PHRASE_MIN_COUNT = 2
OVERLAP_ROLES = 20

# --- FIXED VALUES: text clustering -----------------------------------------
TFIDF_MAX_FEATURES = 3000
TFIDF_MIN_DF = 3
TFIDF_MAX_DF = 0.85
KMEANS_K = 8
KMEANS_SEED = 42
KMEANS_RESTARTS = 10
CLUSTER_TOP_TERMS = 8
CLUSTER_TOP_DEPTS = 3

# --- FIXED VALUES: Spark ML's default English stop-word list (181 words) -----
# Same list as ``StopWordsRemover.loadDefaultStopWords("english")``; kept as
# text so SQL oracles can use it without a JVM.
SPARK_ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's
we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could
here's how's let's ought that's there's what's when's where's who's why's would
""".split()

WORD_FREQ_STOPWORDS = sorted(set(SPARK_ENGLISH_STOPWORDS) | set(WORD_FREQ_EXTRA_STOPWORDS))
