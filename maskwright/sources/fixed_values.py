"""Rules, word lists and formats that results depend on.

They are data, kept in one place and in their natural order. A user replaces
them with JSON files of the same shape, see catalog.load_catalog().
"""

# Text rules as (label, specificity, pattern). Patterns are in Python's dialect.
TEXT_RULES = [
    ("NRIC_SG", 95, r"\b[STFG]\d{7}[A-Z]\b"),
    ("PASSPORT_ID", 90, r"\b[A-Z]\d{7,8}[A-Z]?\b"),
    ("EMAIL", 90, r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z0-9-]{2,}\b"),
    ("PHONE_SG", 88, r"\b(?:(?:\+65|\(65\))[\s-]?)?(?:6|8|9)\d{3}[\s-]?\d{4}\b"),
    ("BANK_ACCOUNT_SG", 92, r"\b\d{3}-\d{3}-\d{3,4}-\d\b|\b\d{9,12}\b"),
    ("DATE", 80, r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"),
    ("ACCOUNT_ID", 92, r"\b(?:Tenancy|Ref|Reference|Order)[\s:#]*[A-Z0-9#-]+\b"),
    ("ADDRESS_LINE", 95, r"\b\d{1,4}[A-Z]?\s+[\w\s,.'()-]+(?:#\d{2,4}-\d{2,4}[\w\s,.]*)?Singapore\s+\d{6}\b"),
    ("CARD_CVC", 85, r"(?i)\b(?:CVC|CVV|Security Code)[\s\w]*of\s*(\d{3,4})\b"),
    ("ORG", 75, r"\b[A-Z][A-Za-z'\s-]+\s(?:Pte Ltd|Ltd|LLC|Inc)\b"),
    ("PERSON", 70, r"\b(?:Mr|Ms|Mrs|Dr)\.?[\s]+[A-Z][a-z'-]+(?:\s+[A-Z][a-z.'-]+){0,3}\b"),
    ("PERSON", 40, r"\b[A-Z][a-z'-]+\s+[A-Z][.a-z'-]+\b"),
]

# Keyword rules as (label, window, keys, value pattern).
CONTEXT_RULES = [
    ("NRIC_SG", 32, ["nric is", "nric:", "nric", "ic number is"], r"\b[STFG]\d{7}[A-Z]\b"),
    ("PASSPORT_ID", 32, ["passport number", "passport no", "passport:"], r"\b[A-Z]\d{7,8}[A-Z]?\b"),
    ("PHONE_SG", 32, ["mobile number", "contact number", "handphone no"],
     r"\b(?:\+65[\s-]?)?(?:6|8|9)\d{3}[\s-]?\d{4}\b"),
    ("BANK_ACCOUNT_SG", 48, ["account number", "account no.", "account no", "acct no", "savings account"],
     r"[\d-]{9,18}\b"),
    ("ACCOUNT_ID", 48, ["reference code", "reference no"], r"'?[A-Za-z0-9#_-]{5,20}'?"),
    ("EMAIL", 48, ["email is", "e-mail", "my email"], r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z0-9]{2,}\b"),
    ("CARD_CVC", 10, ["cvc of", "cvc"], r"\b\d{3,4}\b"),
]

# Canonical label -> other names for it.
SYNONYMS = {
    "PERSON": ["NAME", "PER"],
    "LOCATION": ["GPE", "LOC"],
    "ORG": ["ORGANIZATION", "ORGANISATION"],
    "DATE": ["DOB"],
    "EMAIL": ["EMAIL_ADDRESS"],
    "PHONE_SG": ["PHONE", "PHONE_NUMBER", "CONTACT_NUMBER"],
    "CREDIT_CARD": ["CREDITCARD"],
    "CARD_CVC": ["CVV", "CVC", "CSC"],
    "NRIC_SG": ["NATIONAL_ID"],
    "PASSPORT_ID": ["PASSPORT_NO", "PASSPORT"],
    "ACCOUNT_ID": ["USER_ID", "REFERENCE_CODE"],
    "BANK_ACCOUNT_SG": ["BANK_ACCOUNT"],
    "IGNORE": ["MONEY", "NORP", "CARDINAL", "QUANTITY", "ORDINAL", "PRODUCT"],
}

# Words near or in an organisation name that raise its specificity.
ORG_KEYWORDS = [
    "payment to", "working for", "partnered with", "employed by", "invoice from", "submitted to",
    "agent is from", "company", "solutions", "innovate", "realty",
]
ORG_KEYWORD_REACH = 20

# Texts that are never an entity of the given label.
FALSE_POSITIVES = {"ORG": ["nric", "cvc", "ssn", "iban"]}

# Specificities.
DEFAULT_SPECIFICITY = 50
CONTEXT_SPECIFICITY = 85
NER_SPECIFICITY = 60
ORG_BOOSTED_SPECIFICITY = 80

# What a person / address gap may hold, and its limits.
PERSON_GAP = r"^[ .'-]*$"
PERSON_GAP_WORD_BELOW = 7
ADDRESS_GAP = r"^[,\s]*$"
ADDRESS_GAP_BELOW = 5
ADDRESS_LABELS = ["ADDRESS_LINE", "LOCATION"]

# Rendering.
PLACEHOLDER = "***[%s#%d]***"
PREVIEW_LENGTH = 10
PREVIEW_TAIL = "..."
LISTING_LENGTH = 32
LISTING_TAIL = "…"
NEAR_LIMIT = 9000
OVER_LIMIT = 10000

# Words without which a rule cannot match, by pattern: a cheap containment test
# spares the regex. Ours, not part of the rules; a rule without an entry is always run.
NEEDS = {
    TEXT_RULES[2][2]: ["@"],
    TEXT_RULES[6][2]: ["Tenancy", "Ref", "Order"],
    TEXT_RULES[7][2]: ["Singapore"],
    TEXT_RULES[9][2]: ["Ltd", "LLC", "Inc"],
    TEXT_RULES[10][2]: ["Mr", "Ms", "Dr"],
}
