"""Rule packs for Latin-script fixtures. Packs are plain tuples: small by construction, inlined as literals.

The word choices fit the test tables; category names and weights live in `docreview.packs.fixed`.
"""

from __future__ import annotations

from docreview.functions.scalars import keyword_pattern

# Category -> words; the first category with a word in the text wins, else "general".
CATEGORY_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("non_compete", ("token", "eauelle", "thatnd")),
    ("probation_salary", ("thedst", "derung")),
    ("probation_insurance", ("threea", "mentoi")),
    ("salary_deduction", ("blewh", "eauaux")),
    ("job_description", ("ionhe", "ciónta")),
    ("obedience_clause", ("ungkeit", "onhere", "erthre")),
    ("resignation", ("tionre", "queeau")),
    ("leave_rights", ("ouwh", "stthe")),
    ("jurisdiction", ("icense", "eshe")),
    ("training_bond", ("onou", "ente")),
)

# Intent -> keywords, in order of preference on ties.
INTENTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("law_query", ("from", "that", "por", "nicht")),
    ("risk_analysis", ("was", "pour", "ist")),
    ("negotiation", ("with", "avec", "mit")),
    ("clause_explain", ("this", "une", "ein")),
    ("procedure", ("for", "dans", "als", "los")),
    ("chitchat", ("by", "und", "el", "éon")),
)

# Ordered literal corrections.
FIXES: tuple[tuple[str, str], ...] = ((" ouen ", " open "), ("thth", "th"), ("### ", " "), ("ciónción", "ción"))

# Word groups of the document classifier.
LEXICON: dict[str, tuple[str, ...]] = {
    "party": ("thereof", "erthon", "eauaux", "mentoi", "ciónta", "blewh"),
    "struct": ("thble", "queaux", "ering", "ntre", "hentre"),
    "sign": ("onwh", "eauon", "heti"),
    "oblige": ("ertion", "elleai", "ndwh", "reing"),
    "labor": ("anand", "inin", "enelle", "stion", "ciónes"),
    "service": ("license", "token", "ouble"),
    "resume": ("shha", "lehe", "thio", "sta ", "aion"),
    "news": ("@mail", "555-", "licensed", "+1"),
    "novel": ("sch ", "ung ", "kei", "gen ", "lich"),
    "invoice": ("$$$", "###", "%%%", "&&&"),
    "privacy": ("token =", "@mail", "555-"),
    "noise": ("nav", " | ", "***", "!!", "lyly", "###"),
}

CLAUSE_NUMBER = r"\|"
TRIGGERS: tuple[str, ...] = ("tionre", "eauelle", "ciónta", "icense", "ungkeit")

OBLIGATIONS: tuple[tuple[str, str], ...] = (
    ("icense", "licence terms"), ("token", "credential handling"), ("@mail", "contact data"), (" | ", "tabular annex"),
)
DATE_PATTERN = r"\b\d{3}-\d{4}\b|\b\d{3} \d{4}\b"
AMOUNT_PATTERN = r"\d+(?:\.\d+)?\s*(?:%|\$)"
HEADING_PATTERN = r"(\d+\.\d+)([^0-9]*)"

RULE_SET_MARKERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("licensed", ("License", "icensed under")),
    ("tabular", (" | ", "###", "%%%")),
    ("romance", (" de ", " la ", " que ")),
)
DEFAULT_RULE_SET = "general"


# A rule says what to find for a fact, whether it must be there, and what a gap report says.
_CONTACT = {
    "fact": "contact", "must": True, "find": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"\+1 ?\(?(\d{3})"),
    "gap": {"title": "Contact address", "why": "No address for notices was found.", "law": "Notice rules, s. 1", "add": "State an address for notices."}}
_LICENSE = {
    "fact": "license", "must": True, "find": (r"[Ll]icensed under ([^\n,.]+)", r"GNU General Public"),
    "gap": {"title": "Licence", "why": "The terms of use are open.", "law": "Licence rules, s. 2", "add": "Name the licence and its version."}}
_SECRET = {
    "fact": "credential", "must": False, "find": (r'token = "([0-9a-f]{8})',),
    "gap": {"title": "Credential", "why": "A credential may be exposed.", "law": "Security rules, s. 4", "add": "Remove credentials from the text."}}
_PARTY = {
    "fact": "party_a", "must": True, "find": (r"\n(Th[a-z]{4,12}) ", r"(Éa[a-zé]{3,12}) ", r"Cion"),
    "gap": {"title": "First party", "why": "The first party is not named.", "law": "Form rules, s. 1", "add": "Name the first party in full."}}
_TERM = {
    "fact": "term", "must": True, "find": (r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", r"\d{7,}"),
    "gap": {"title": "Term", "why": "The term is open.", "law": "Form rules, s. 3", "add": "State start and end."}}
_SCOPE = {
    "fact": "scope", "must": False, "find": (r"([a-z]{5,20}) \| ", r" (?:thea|threa)[a-z]+", r"para "),
    "gap": {"title": "Scope", "why": "The scope is open.", "law": "Form rules, s. 5", "add": "List the scope."}}

RULE_SETS: dict[str, tuple[dict, ...]] = {
    "general": (_PARTY, _TERM, _SCOPE, _CONTACT),
    "licensed": (_PARTY, _LICENSE, _CONTACT),
    "tabular": (_SCOPE, _TERM, _SECRET),
    "romance": (_PARTY, _TERM, _LICENSE, _SECRET, _SCOPE),
}
CRITICAL_KEYS: tuple[str, ...] = ("party_a", "license")

# Fact key -> patterns that contradict it, in order.
CONTRADICTIONS: dict[str, tuple[str, ...]] = {
    "party_a": (r"onth[a-z]+ er[a-z]+", r"eauaux[a-z]*"),
    "term": (r"ti[a-z]* on[a-z]+ the",),
    "license": (r"[Nn]on[Cc]ommercial", r"BY-NC"),
    "scope": (r"edth[a-z]+ ",),
}

TEMPLATES: dict[str, str] = {
    "non_compete": "The restriction ends after the agreed term and is paid for.",
    "salary_deduction": "Deductions need a written reason and stay below the agreed share.",
    "resignation": "Either side may end the agreement with the agreed notice.",
    "jurisdiction": "Disputes go to the court at the place of performance.",
}
DEFAULT_TEMPLATE = "Both sides agree on this point in writing."
CONFLICT_PATTERN = r"(?i)token|eauelle|onou"

TIPS: dict[str, str] = {
    "non_compete": "Ask for a payment that matches the restriction.",
    "job_description": "Ask for the duties in writing.",
    "leave_rights": "Ask how leave is recorded.",
}
DEFAULT_TIP = "Ask for this point in writing."

FOLLOWUPS: dict[str, tuple[str, ...]] = {
    "non_compete": ("How long does the restriction last?", "What is paid for it?"),
    "salary_deduction": ("Which deductions are allowed?", "Who decides on deductions?"),
    "resignation": ("How much notice is needed?", "What is paid for it?"),
    "leave_rights": ("How much leave is there?",),
    "jurisdiction": ("Which court decides?", "How long does it take?", "What does it cost?"),
}
FALLBACK_FOLLOWUPS: tuple[str, ...] = ("What should I check first?", "Which clause is the weakest?")


# --- the same packs as SQL text, for the equivalence checks ------------------------------------------------

def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contains_any_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(w)})" for w in words) + ")"


def category_sql(column: str, rules=CATEGORY_RULES, default: str = "'general'") -> str:
    whens = " ".join(f"WHEN {contains_any_sql(column, words)} THEN {quote(name)}" for name, words in rules)
    return f"CASE {whens} ELSE {default} END"


def hit_count_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({column}, {quote(w)})::INTEGER" for w in words) + ")"


def intent_hits_sql(column: str, words: tuple[str, ...]) -> str:
    tests = [f"regexp_matches({column}, {quote(keyword_pattern(w))})" if w.isascii() else f"contains({column}, {quote(w)})"
             for w in words]
    return "(" + " + ".join(f"({t})::INTEGER" for t in tests) + ")"


def intent_is_sql(column: str, intent: str, minimum: float) -> str:
    """True where the intent wins (strictly against earlier ones) with at least the given confidence."""
    own = intent_hits_sql(column, dict(INTENTS)[intent])
    before = True
    parts = []
    for name, words in INTENTS:
        if name == intent:
            before = False
            continue
        parts.append(f"{own} {'>' if before else '>='} {intent_hits_sql(column, words)}")
    return f"({own} > 0 AND least(1.0, 0.45 + 0.2 * {own}) >= {minimum} AND " + " AND ".join(parts) + ")"
