"""Domains, mapping tables, patterns, limits.

Everything here is a published constant that results depend on; it is stated
as data so that the operators stay free of literals.
"""

from __future__ import annotations

# ---- fixed values: enum domains in declaration order -------------------------
SUBJECTS = ["DEUTSCH", "RELIGION", "ETHIK"]
CONFESSIONS = [
    "EVANGELISCH",
    "KATHOLISCH",
    "KONFESSIONSSENSIBEL_UEBERGREIFEND",
    "RELIGIONSKUNDLICH",
    "NICHT_ANWENDBAR",
]
SCHOOL_FORMS = ["GESAMTSCHULE", "GEMEINSCHAFTSSCHULE"]
TRUST_LEVELS = ["OFFICIAL_BINDING", "OFFICIAL_GUIDANCE", "OPEN_CURATED", "USER_APPROVED", "UNVERIFIED"]
LIFECYCLE = [
    "DISCOVERED",
    "UNDER_REVIEW",
    "REGISTERED",
    "APPROVED",
    "INGESTED",
    "VERSIONED",
    "EVALUATED",
    "REVOKED",
]

# ---- fixed values: trust order and grounded levels ---------------------------
TRUST_ORDINAL = {
    "OFFICIAL_BINDING": 4,
    "OFFICIAL_GUIDANCE": 3,
    "OPEN_CURATED": 2,
    "USER_APPROVED": 1,
    "UNVERIFIED": 0,
}
GROUNDED_TRUST = ["OFFICIAL_BINDING", "OFFICIAL_GUIDANCE"]

# ---- fixed values: which confession contexts a subject may carry --------------
SUBJECT_CONTEXTS = {
    "RELIGION": ["EVANGELISCH", "KATHOLISCH", "KONFESSIONSSENSIBEL_UEBERGREIFEND"],
    "ETHIK": ["RELIGIONSKUNDLICH", "NICHT_ANWENDBAR"],
    "DEUTSCH": ["NICHT_ANWENDBAR"],
}

# ---- fixed values: display subject -> (subject, confession, search contexts) --
DISPLAY_SUBJECTS = {
    "deutsch": ("DEUTSCH", "NICHT_ANWENDBAR", []),
    "evangelische-religion": ("RELIGION", "EVANGELISCH", ["EVANGELISCH", "KONFESSIONSSENSIBEL_UEBERGREIFEND"]),
    "katholische-religion": ("RELIGION", "KATHOLISCH", ["KATHOLISCH", "KONFESSIONSSENSIBEL_UEBERGREIFEND"]),
    "ethik": ("ETHIK", "RELIGIONSKUNDLICH", ["RELIGIONSKUNDLICH"]),
}
SUBJECT_LABELS = {
    "deutsch": "Deutsch",
    "evangelische-religion": "Ev. Religion",
    "katholische-religion": "Kath. Religion",
    "ethik": "Ethik",
}

# ---- fixed values: retrieval, chunking, evaluation ----------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
MIN_CHUNK = 50
TOP_K = 5
OVERSAMPLE = 3
SEARCH_LIMIT = 10
MMR_LAMBDA = 0.7
DRIFT_THRESHOLD = 0.05
DRIFT_EPSILON = 1e-9
EMBED_BATCH = 96

# ---- fixed values: golden question domains ------------------------------------
QUESTION_DOMAINS = ["DEUTSCH", "RELIGION"]
QUESTION_CONFESSIONS = ["NICHT_ANWENDBAR", "evangelisch", "katholisch", "uebergreifend"]
QUESTION_STATUSES = ["active", "blocked-source-not-approved", "blocked-no-registered-source"]

# ---- fixed values: MIME by extension ------------------------------------------
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
    ".md": "text/plain",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
}
MIME_FALLBACK = "application/octet-stream"

# ---- fixed values: path classification ----------------------------------------
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".txt", ".html", ".htm", ".md"]
TOOLING_FRAGMENTS = [
    "__pycache__",
    "/site-packages/",
    "/_report",
    "node_modules",
    "/.venv",
    "/venv/",
    "/bin/",
    "/lib/python",
]
PERSONAL_PATH = (
    r"(zeugnis|notenübersicht|notenubersicht|\bnoten?\b|klassenarbeit|klausur|pr(?:ü|ue|u)fung|klassenliste"
    r"|sch[üu]lerliste|diagnos|f[öo]rderplan|gutachten|korrekturhinweise|auswertung|anwesenheit|fehlzeit|datev"
    r"|freistellung|krankmeld|elternbrief|facharbeit|seminararbeit|bewertung|leseprobe|feedback)"
)
ASSESSMENT_PATH = r"(^|/)(KA|LK)[ _]"
OFF_SUBJECT_DIRECTORY = (
    r"(biolog|englisch|\bmathe|physik|chemie|\bgeschichte\b|geograf|\bmusik|\bkunst|\bsport|informatik)"
)
RELIGION_FOLDERS = ["3_religion", "3_religion_rag_auswahl"]
RELIGION_PATH = r"relig"
ETHICS_PATH = r"\bethik"
SCANNED_FOLDERS = [
    "2_Deutsch",
    "3_Religion",
    "3_Religion_RAG_Auswahl",
    "Materialsammlung-RAG",
    "Lehrpläne Schulgesetz Sachsen Anhalt",
    "Lernbüro 6 2024_2025",
]

# ---- fixed values: folder -> (trust, publisher, licence) ----------------------
FOLDER_RULES = {
    "lehrplaene": ("OFFICIAL_BINDING", "Ministerium für Bildung LSA (LISA)", "Amtlich, kostenfrei zugänglich"),
    "bildungsstandards-kmk": ("OFFICIAL_BINDING", "KMK", "Amtlich, kostenfrei zugänglich"),
    "niveaubestimmende-aufgaben": ("OFFICIAL_GUIDANCE", "LISA Sachsen-Anhalt", "Amtlich, kostenfrei zugänglich"),
    "lektueren-gemeinfrei": ("OPEN_CURATED", "Project Gutenberg/Wikisource", "Public Domain (gemeinfrei)"),
}
GUIDANCE_FILE_PREFIXES = ["Lektuereempfehlungen", "Lekt_reempfehlungen"]
GUIDANCE_FILE_NAMES = ["Lektuereliste_VOLLTEXT.txt"]
FOLDER_BANDS = {"sek_kl5": "KS5", "sek_kl7": "KS7", "sek_kl9": "KS9"}  # prefixes
FOLDER_BAND_EXACT = {"sek_2012": "KS9"}

# ---- fixed values: registry entry mapping -------------------------------------
BINDING_TYPES = ["framework", "law", "curriculum"]
REGISTRY_SUBJECTS = {
    "DEUTSCH": ("DEUTSCH", "NICHT_ANWENDBAR"),
    "ETHIK": ("ETHIK", "RELIGIONSKUNDLICH"),
    "RELIGION_EV": ("RELIGION", "EVANGELISCH"),
    "RELIGION_KA": ("RELIGION", "KATHOLISCH"),
    "RELIGION": ("RELIGION", "KONFESSIONSSENSIBEL_UEBERGREIFEND"),
}

# ---- fixed values: white space as JavaScript and Unicode text tools see it ----
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = (
    "\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# ---- fixed values: redaction categories in order, patterns in order -----------
# \b and \s are written in the portable form; functions.privacy turns them into
# the exact ASCII word boundary and the white-space class above.
REDACTION = [
    (
        "student_id",
        "[SCHÜLER_ID_REDACTED]",
        [
            (r"\bS(?:N)?[-_]?\d{4,8}\b", True),
            (r"\bID\s*[:=]\s*\d{4,10}\b", True),
            (r"(?:Schüler(?:in)?(?:nummer|ausweis|ID)?|Matrikel(?:nummer)?)\s*[:=]?\s*\d{4,10}\b", True),
        ],
    ),
    (
        "contact",
        "[KONTAKT_REDACTED]",
        [
            (r"[\w.+-]+@[\w.-]+\.\w{2,}", True),
            (r"(?:\+49|0049|0)\s*(?:\d[\s-]?){7,14}\d", False),
            (r"\+\d{1,3}[\s-]?\(?\d+\)?[\s-]?\d[\s\d-]{5,}", False),
        ],
    ),
    (
        "birthdate",
        "[DATUM_REDACTED]",
        [
            (r"\b\d{2}\.\d{2}\.\d{4}\b", False),
            (r"\b\d{4}-\d{2}-\d{2}\b", False),
            (r"\b\d{2}[/-]\d{2}[/-]\d{4}\b", False),
            (r"(?:geboren\s+am|geb\.?|Geburtsdatum\s*[:=]?)\s+\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", True),
        ],
    ),
    (
        "address",
        "[ADRESSE_REDACTED]",
        [
            (r"\b\d{5}\s+[A-ZÄÖÜ][a-zäöüß]+(?:[-\s][A-ZÄÖÜ][a-zäöüß]+)*", False),
            (
                r"[A-ZÄÖÜ][a-zäöüß]+(?:[-\s][A-ZÄÖÜ][a-zäöüß]+)*"
                r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer)\s+\d+[a-z]?",
                True,
            ),
            (r"(?:Adresse|Anschrift|wohnhaft\s+in|wohnhaft\s+bei)\s*[:=]?\s*[^\n,;]{5,60}", True),
        ],
    ),
    (
        "sensitive_attribute",
        "[MERKMAL_REDACTED]",
        [
            (
                r"\b(?:LRS|Legasthenie|Dyskalkulie|ADHS|ADS|ASS|Autismus|Förderbedarf|Nachteilsausgleich"
                r"|sonderpädagogisch(?:er?\s+Förderbedarf)?)\b",
                True,
            ),
            (r"\b(?:evangelisch|katholisch|konfessionslos|muslimisch|islamisch|jüdisch|konfessionell)\b", True),
            (r"\b(?:Aufenthaltserlaubnis|Aufenthaltsstatus|Asylantrag|Duldung|Flüchtlingsstatus)\b", True),
        ],
    ),
    (
        "name",
        "[SCHÜLER_PSEUDONYM]",
        [
            (
                r"(?:Name|Schüler(?:in)?|Vorname|Nachname|Familienname)\s*[:=]\s*[A-ZÄÖÜ][a-zäöüß\s-]{2,40}",
                True,
            ),
            (r"\[SCHÜLER_PSEUDONYM\]\s+[A-ZÄÖÜ][a-zäöüß]{1,}", False),
        ],
    ),
]

# ---- fixed values: residual personal data, in order ---------------------------
GUARD = [
    (r"(?:Name|Schüler(?:in)?|Vorname|Nachname|Familienname)\s*[:=]\s*[A-ZÄÖÜ]", True),
    (r"\d{2,4}-\d{2}-\d{2}", False),
    (r"\d{5} [A-ZÄÖÜ]", False),
    (r"lrs|dyskalkulie|adhs", True),
    (r"[\w.+-]+@[\w.-]+\.\w{2,}", True),
    (r"\b\d{2}\.\d{2}\.\d{4}\b", False),
]

# ---- fixed values: phases, difficulties, limits of reports --------------------
PHASES = ["Einstieg", "Erarbeitung", "Sicherung", "Hausaufgabe"]
DIFFICULTIES = {"Foerder": "EASY", "Basis": "MEDIUM", "Erweiterung": "HARD"}
RECENT_WORK = 4
ACTIVITY_FEED = 6
QUICK_ACCESS = 3
CURRICULUM_FIT = 6
MAX_CONSTRAINTS = 12
SNIPPET = 240
DEFAULT_GRADE = 8

# ---- fixed values: retention in days or months per data class -----------------
RETENTION_MONTHS = {
    "PERSONAL_TEACHER": 12,
    "INTERNAL": 84,
    "SENSITIVE_STUDENT": 24,
    "SENSITIVE_STUDENT_RELIGION": 12,
    "INTERNAL_USER_UPLOAD": 36,
}  # PUBLIC has no limit
GRACE_DAYS = 30
PSEUDONYM_MONTHS = 12

# ---- fixed values: targets -----------------------------------------------------
LATENCY_P95_TARGET_MS = 3000.0
ERROR_RATE_LIMIT = 0.01
