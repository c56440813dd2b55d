"""Fixed values. The lists, labels, limits and patterns below decide results and must keep these values."""

import sys

# --- identity and envelope
RESUME_PREFIX = "A"
POSTING_PREFIX = "B"
TOPIC_RESUMES = "raw_resumes"
TOPIC_JOBS = "raw_jobs"
TOPIC_TABLES = {
    "processed_schema_cv": "schema_cv",
    "processed_text_cv": "text_cv",
    "processed_personal_info_cv": "info_cv",
    "processed_schema_job": "schema_job",
    "processed_text_job": "text_job",
}
DEFAULT_CSV_COLUMN = "Resume_str"
PLACEHOLDERS = ["unknown", "not provided"]
AS_OF_YEAR = 2026

# --- feature text
QUERY_PREFIX = "Query: "
PASSAGE_PREFIX = "Passage: "
COMPANY_PLACEHOLDERS = ["Company", ""]
LOCATION_PLACEHOLDERS = ["Unknown", "City , State", ""]
DEGREE_PLACEHOLDERS = ["Degree Not Found", ""]
INSTITUTION_PLACEHOLDERS = ["Institution Not Found", ""]

# --- matching and scoring
VECTOR_SIZE = 64
DEFAULT_K = 10
FUNNEL_K = 50
TOP_SHOWN = 5
REPORT_TOP_N = 10
COSINE_WEIGHT = 1.0
JACCARD_WEIGHT = 0.5
TITLE_GROUP_WEIGHT = 0.1
TITLE_TEXT_WEIGHT = 0.1
LEVEL_PHRASES = ["internship level", "junior level", "mid-level", "senior level"]
OVER_LEVEL_FACTOR = 0.05
UNDER_LEVEL_FACTOR = 0.15
UNDER_LEVEL_PENALTY = -0.05
OVER_LEVEL_PENALTY = 0.15

# --- dates
# A date, or two joined by "to" or a dash where the second may be an open end. The free-form résumés know one open end more.
DATASET_DATE = r"(?iU)\b(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May(?:)?|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-2]\d{3}|[0-2]\d{3}\s*[-]\s*[0-3]\d\s*[-]\s*[0-3]\d|[0-2]\d\s*[-/ ]\s*[0-2]\d{3}|[0-2]\d{3})(?:\s*(?:to|[-–—])\s*(?:(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May(?:)?|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-2]\d{3}|[0-2]\d{3}\s*[-]\s*[0-3]\d\s*[-]\s*[0-3]\d|[0-2]\d\s*[-/ ]\s*[0-2]\d{3}|[0-2]\d{3})|Present|Current|Now))?\b"
TEXT_DATE = r"(?iU)\b(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May(?:)?|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-2]\d{3}|[0-2]\d{3}\s*[-]\s*[0-3]\d\s*[-]\s*[0-3]\d|[0-2]\d\s*[-/ ]\s*[0-2]\d{3}|[0-2]\d{3})(?:\s*(?:to|[-–—])\s*(?:(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May(?:)?|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+[0-2]\d{3}|[0-2]\d{3}\s*[-]\s*[0-3]\d\s*[-]\s*[0-3]\d|[0-2]\d\s*[-/ ]\s*[0-2]\d{3}|[0-2]\d{3})|Present|Current|Now|Today))?\b"
YEAR_PATTERN = r"\b(19\d{2}|20\d{2})\b"
ONGOING_WORDS = ["present", "current", "now", "today"]
MIN_BARE_YEAR = 1970
MAX_BARE_YEAR = 2030
CONTINUATION_WORDS = ["to", "present", "current", "now", "until"]
DATE_PREPOSITIONS = ["in", "during", "around", "since"]
NARRATIVE_VERBS = [
    "participated", "delivered", "presented", "completed", "awarded", "selected", "graduated", "received",
    "managed", "led", "worked", "assisted", "created", "developed", "organized",
]

# --- free-form résumés: headings and sections
BOILERPLATE_TITLES = ["curriculum vitae", "resume", "cv"]
TEXT_HEADINGS = [
    r"WORK\s+EXPERIENCE", r"EXPERIENCE", r"PROFESSIONAL\s+EXPERIENCE", r"EDUCATION", r"ACADEMIC\s+BACKGROUND",
    r"SKILLS(?:\s+AND\s+COMPETENCIES)?", r"TECHNICAL\s+SKILLS", r"CORE\s+SKILLS", r"COMPETENCIES",
    r"CERTIFICATIONS?", r"CERTIFICATIONS?\s+AND\s+TRAINING", r"SUMMARY", r"PROFESSIONAL\s+SUMMARY", r"OBJECTIVE",
    r"LANGUAGES?", r"INTERESTS?", r"REFERENCES?",
]
SECTION_OF_HEADING = {
    "EXPERIENCE": "Experience", "WORK EXPERIENCE": "Experience", "PROFESSIONAL EXPERIENCE": "Experience",
    "EDUCATION": "Education", "ACADEMIC BACKGROUND": "Education",
    "SKILLS": "Skills", "TECHNICAL SKILLS": "Skills", "CORE SKILLS": "Skills", "COMPETENCIES": "Skills",
    "SKILLS AND COMPETENCIES": "Skills",
    "CERTIFICATIONS": "Certifications", "CERTIFICATION": "Certifications",
    "CERTIFICATIONS AND TRAINING": "Certifications",
    "SUMMARY": "Summary", "PROFESSIONAL SUMMARY": "Summary", "OBJECTIVE": "Summary",
    "LANGUAGES": "Languages", "LANGUAGE": "Languages",
    "INTERESTS": "Interests", "INTEREST": "Interests",
    "REFERENCES": "References", "REFERENCE": "References",
}
FALLBACK_SECTION_THRESHOLD = 0.3

# --- free-form résumés: jobs
# A run between bars and line ends either has a bar behind it or not, so it is tried from its first character only and never given back.
TITLE_BAR_COMPANY = r"(?<![^\n\|])([^\n\|]++)\s*\|\s*([^\n]+)"
LEADING_BULLET = r"^[\s•\-\*]+"
NOT_A_TITLE = r"^[0-9\-/]+$"
NOT_A_COMPANY = r"^[A-Z][a-z]+,?\s*[A-Z][a-z]+$"

# --- free-form résumés: names, titles, places
HEADER_EXCLUDED_NAME = [
    "personal information", "contact", "curriculum vitae", "resume", "cv", "profile", "summary", "objective",
]
HEADER_EXCLUDED_TITLE = [
    "personal information", "contact", "curriculum vitae", "resume", "cv", "profile", "summary", "experience",
    "education", "skills", "objective", "professional summary",
]
TITLE_INDICATORS = [
    "manager", "director", "engineer", "developer", "analyst", "specialist", "coordinator", "lead", "senior",
    "junior", "consultant", "architect",
]
NOT_A_PLACE = [
    "personal information", "curriculum vitae", "resume", "contact", "email", "phone", "www.", "http", "@", "name:",
]
NOT_A_PLACE_ORGANISATION = ["university", "college", "limited", "gmbh", "inc.", "ltd"]
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LINKEDIN_PATTERN = r"(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
PLACE_LINE_PATTERN = r"^([A-Z][a-zA-Z\.\s-]+,\s*[A-Z][a-zA-Z\.\s-]+)$"
NAME_LABEL_PATTERN = r"(?:Full\s+)?Name\s*:\s*([A-Z][a-zA-Z\s\.]+?)(?:\n|$)"
NAME_LINE_PATTERN = r"^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?(?:\s+[A-Z][a-z]+){0,2})$"
TITLE_KINDS = ["POSITION", "JOB_TITLE", "TITLE"]
DEFAULT_TITLE = "Professional"

# --- education and certificates
DEGREE_WORDS = [
    "Master of Arts", "Bachelor of Arts", "Master", "Bachelor", "B.A.", "BA", "M.A.", "High School Diploma", "PhD",
    "Associate", "of Science", "Diploma", "Doctorate", "M.S.", "B.S.", "MBA", "Studies",
]
CERTIFICATE_WORDS = ["Certification", "Certificate", "Licensure", "Credential", "Certified"]
INSTITUTION_WORDS = ["university", "college", "institute", "school", "academy", "università"]
COMPLETION_WORDS = ["graduated", "completed", "diploma obtained"]
EDUCATION_WORDS = ["university", "college", "school", "major", "gpa", "studies", "degree", "diploma"]
EVALUATION_WORDS = ["performance", "evaluation", "merit", "proposal", "hiring"]
SENTENCE_STARTS = [
    "I", "We", "He", "She", "They", "It", "My",
    "Additionally", "Also", "Furthermore", "Moreover", "However",
    "In", "On", "At", "During", "Since", "While", "Following",
]
CERTIFICATE_PHRASE = (
    r"(?:hold|held|earned|obtained|received|completed|awarded)\s+(?:a\s+|an\s+|the\s+)?(.*?)"
    r"(\s+(?:credential|certification|certificate|diploma|licensure)|$|in\s+)"
)
CERTIFICATE_PREFIX = r"^([A-Z0-9][a-zA-Z0-9\s\(\)\-]+)"
CERTIFICATE_RUN = r"([A-Z][a-zA-Z0-9\s\(\)\-]+)"
CERTIFICATE_TAIL = r"\s+(?:and|from|with|at|by)$"

# --- skills
SHORT_SKILLS = [
    "c", "r", "go", "c#", "f#", "c++", "vb", "js", "aws", "git", "npm", "pip", "bi", "db", "ai", "ml", "qa", "ui",
    "ux", "seo", "sem", "os", "ip", "ci", "cd",
]
FLUENCY_PATTERN = r"\b(fluent|native|proficient|conversational|intermediate|basic|advanced)\s+in\s+([A-Z][a-z]+)\b"
SKILL_NOISE = [
    r"my technical repertoire includes", r"my technical competencies include", r"my skills include",
    r"i am (?:highly )?skilled in", r"proficiency in", r"proficient in", r"include", r"including", r"such as", r"like",
    r"knowledge covers", r"expertise lies in", r"experience with", r"programming languages?", r"frameworks?",
    r"libraries", r"tools?", r"infrastructure", r"regarding", r"advanced proficiency in",
]
DOTTED_SKILLS = {"Node.js": "NodeJS", ".NET": "DotNet", "Vue.js": "VueJS"}
SENTENCE_WORDS = [" i ", " my ", " am ", " is ", " are ", " was ", " were ", " have ", " has "]
SKILL_BULLET = r"\n\s*[-•*]\s*"
SKILL_SPLIT = r"[,;.]|\s+as well as\s+"
SKILL_LEAD = r"^(?:and|or|also|with)\s+"
SKILL_KINDS = ["PROGRAMMING_LANGUAGE", "FRAMEWORK", "TOOL", "SOFTWARE", "TECHNICAL_SKILL", "SOFT_SKILL", "LANGUAGE"]

# --- dataset résumés (run-on spacing)
DATASET_HEADINGS = {
    "Experience": (
        r"\s\s+(?:(?:Military\s+)?(?:Work\s+)?(?:Relevant\s+)?(?:Professional\s+)?(?:Production\s+)?"
        r"(?:Visual\s+Merchandise\s+)?(?:Teaching\s+)?Experience|(?:Work\s+)?History|Career\s+Accomplishments|"
        r"PROFESSIONAL\s+EXPERIENCE)\s\s+"
    ),
    "Education": (
        r"\s\s(?:(?:General\s+)?Education(?:\s+and\s+Training)?(?:\s+and\s+Credentials)?"
        r"(?:\s+and\s+Professional\s+Training)?(?:\s+and\s+Certifications)?|Educational\s+Background|EDUCATION|"
        r"Academic\s+Background|Certifications)\s\s+"
    ),
    "Skills": (
        r"\s\s+(?:Summary\s+of\s+)?(?:Technical\s+)?(?:Key\s+)?(?:Additional\s+)?(?:Computer\s+)?Skills"
        r"(?:\s+and\s+(?:Qualifications|Expertise|Competencies|Accomplishments))?\s\s+"
    ),
}
DATASET_TITLE_EXCLUDED = ["summary", "experience", "skills"]
DATASET_MENTION_EXCLUDED = ["summary", "experience", "education"]
TEXT_BEFORE_HEADING = r"^(.+?)(?:Summary|Experience|Skills|Accomplishments)"
NOT_A_JOB_TITLE = ["experience", "work history", "summary", "skills"]
DATASET_JOB_KINDS = ["POSITION", "JOB_TITLE", "TITLE", "COMPANY", "ORG"]
COMPANY_KINDS = ["COMPANY", "ORG"]
SCHOOL_KINDS = ["ORG", "SCHOOL", "UNIVERSITY"]
DEGREE_KINDS = ["DEGREE", "QUALIFICATION"]
PLACE_KINDS = ["LOCATION", "GPE", "CITY", "STATE", "PLACE"]
DEFAULT_JOB_TITLE = "Position"
DEFAULT_COMPANY = "Company"
CHUNK_SPLIT_PATTERN = r"\n|\r|\s{2,}|\s[|•]\s"
EDGE_PUNCTUATION_TAIL = r"\s*[,|\-–]\s*$"
EDGE_PUNCTUATION_HEAD = r"^[,|\-–]\s*"
LEADING_HEADING = r"^(Experience|Work History|Professional Experience|History)\s+"
AFTER_DATE_PATTERN = r"^\s*(.*?)(?=\n|\s{2,}|－|—|\||Company)"
DESCRIPTION_HEAD = r"^[\s,.\-–|]+"
DESCRIPTION_PLACE = r"^[A-Za-z\s]+\s*,\s*[A-Z]{2}[A-Za-z\s]*"
PLACE_SPACED_COMMA = r"([A-Z][a-zA-Z\s]+?)\s+,\s+([A-Z][a-zA-Z\s]+?)(?:\s+|,|\.|\d)"
PLACE_STATE_CODE = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s*,\s*([A-Z]{2})\b"
PLACE_AFTER_COMPANY = r"Company Name\s*[－\-]\s*([^,]+)\s*,\s*([^.\d]+?)(?:\s|$)"
COMPANY_BOILERPLATE = [
    "Company Name － City , State", "Company Name - City , State", "Company Name City , State", "Company Name",
]

# --- two-column profile exports
COLUMN_SPLIT_X = 200.0
PAGE_FOOTER_PATTERN = r"Page [0-9]+ of [0-9]+"
LANGUAGE_NAMES = {
    "Lingua inglese": "English", "inglese": "English", "Inglese": "English", "Tedesco": "German",
    "Francese": "French", "Italiano": "Italian",
}
CHARACTER_FIXES = {"\u00a0": " ", "\u2013": "-", "\u2014": "-"}
ORGANISATION_WORDS = [
    "university", "università", "studiorum", "school", "academy", "srl", "spa", "inc", "gmbh", "ltd", "limited",
]
KNOWN_PLACES = [
    "italy", "italia", "france", "germany", "bologna", "trento", "rimini", "forlì", "milan", "roma",
]
DURATION_PATTERN = r"^\d+\s+(year|yr|mo|month)s?(\s+\d+.*)?$"
PROFILE_DATE_PATTERN = (
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}.*?"
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Present|\d{4})"
)
DATE_CONTINUATION = r"^[\d\)]+$"
DATE_ONLY_LINES = [r"^\(.*?\d{4}.*?\)$", r"\d{4}.*?\d{4}"]
PROFILE_DEGREE_WORDS = ["degree", "master", "bachelor", "diploma", "phd"]

# --- character classes, by rule
WHITESPACE = "".join(chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace())
ALWAYS_COMPOSED_PATTERN = r"^[\u0000-\u02ff]*$"
