"""Word lists, limits, patterns and tables that results depend on. Do not change them."""

ALIASES = {"paracetamol": "acetaminophen", "panadol": "acetaminophen", "tylenol": "acetaminophen", "apap": "acetaminophen"}
ALIAS_SCORE, OK_THRESHOLD, LOW_THRESHOLD, TYPO_THRESHOLD = 95.0, 0.85, 0.60, 85.0
TOP_K, MIN_SCORE, MAX_BRANDS = 5, 80.0, 20

DOSAGE = r"\b\d+(\.\d+)?\s*(mg|g|mcg|µg|ug|ml|l|iu|%)\b|\b\d+\s*(tablet|tab|tabs|capsule|cap|caps|pill|pills)\b|\b(tablet|tab|tabs|capsule|cap|caps|pill|pills)\b|\b(syrup|suspension|susp|injection|injectable|oral|iv|im)\b|\b(once|twice|daily|bd|tds|qid|od)\b|\b\d+\b"

TEXT_LIMITS = {"indications": 2500, "dosage_and_administration": 3500, "warnings": 3000, "contraindications": 2000}
LIST_LIMITS = {"side_effects_all": 250, "side_effects_label_confirmed": 200}
ROUTES = ["ORAL", "INTRAVENOUS", "INTRAMUSCULAR", "SUBCUTANEOUS", "INHALATION", "RESPIRATORY (INHALATION)", "NASAL", "OPHTHALMIC", "OTIC", "RECTAL", "VAGINAL", "TRANSDERMAL", "BUCCAL", "SUBLINGUAL", "TOPICAL"]
BLACKLIST = [
    "above original", "woman", "beauty", "makeup", "foundation", "lipstick", "mascara", "sunscreen", "spf", "moisturizer", "lotion", "cream", "shampoo", "soap",
    "hand sanitizer", "sanitizer", "disinfectant", "deodorant", "antiperspirant", "mouthwash", "oral rinse", "tooth", "teeth", "dental", "toothpaste", "toothbrush",
    "cleanser", "toner", "face wash", "facial", "scar gel", "rash", "anti-chafing", "chafing", "overnight healing", "acne cleanser", "acne toner", "acne treatment pads",
    "homeopathic", "herbal", "supplement", "dietary", "extract", "essential oil", "vitamin", "multivitamin", "mineral", "probiotic", "omega", "fish oil",
    "seed", "leaf", "root", "bark", "flower", "fruit", "abies nigra", "absinthium",
]
NICOTINE = ["nicotine", "patch", "patches", "gum", "lozenge", "lozenges", "quit smoking", "cessation"]
MIXTURE = r"\s-\s|;|\b and \b|\b with \b|\b plus \b|\b combination \b"
BAD_GENERIC = r"\bto deliver\b|^\(.*?\)\s*|^\d+(\.\d+)?%\s*"
MAX_WORDS, MAX_LEN = 3, 32
BUCKET_SIZES = {"common": 12, "less_common": 10, "rare": 8, "postmarketing": 8, "unknown": 8}
BAD_ENCODING = r"câ|â€¦|Â|Ã|â€™|â€œ|â€|�"
LABELS = ["Liver Warning", "Allergy Alert", "Do not use", "Ask a doctor before use", "Ask a doctor or pharmacist before use", "Stop use and ask a doctor if", "Stop use and ask a doctor"]
MOJIBAKE = [("â€¢", "•"), ("â€“", "-"), ("â€”", "-"), ("â€™", "'"), ("â€œ", '"'), ("â€�", '"'), ("Â", ""), ("\u00a0", " "), ("•", "-")]
TRUNCATIONS = [("â€¦", "..."), ("â¦", "..."), ("â€¯", " "), ("Â", " "), ("\u00a0", " "), ("â€“", "-"), ("â€”", "-"), ("â€˜", "'"), ("â€™", "'"), ("â€œ", '"'), ("â€ ", '"'), ("â€¢", "•"), ("câ¦", "...")]
WINDOW_WORDS, LONG_TEXT = 18, 1200

SECTION_CAPS = {
    "Liver Warning": 280, "Allergy Alert": 260, "Do not use": 360, "Ask a doctor before use": 260, "Ask a doctor or pharmacist before use": 260,
    "Stop use and ask a doctor if": 520, "Pregnancy / Breastfeeding": 220, "Boxed Warning": 520, "Warnings": 520, "Warnings And Precautions": 520, "Precautions": 420,
    "Adverse Reactions": 420, "Drug Interactions": 320, "Use In Specific Populations": 320, "Pregnancy": 220, "Lactation": 220, "Overdosage": 280,
    "Dosage And Administration": 320, "Contraindications": 320,
}
OTHER_SECTION_CAP = 420
WARNING_SECTIONS = [
    ("Liver Warning", r"\bliver warning\b"), ("Allergy Alert", r"\ballergy alert\b"), ("Do not use", r"\bdo not use\b"), ("Ask a doctor before use", r"\bask a doctor before use\b"),
    ("Ask a doctor or pharmacist before use", r"\bask a doctor or pharmacist before use\b"), ("Stop use and ask a doctor if", r"\bstop use\b.*?\bask a doctor\b"),
    ("Pregnancy / Breastfeeding", r"\bif pregnant\b|\bpregnan|\bbreast[\s-]?feed\b"),
]
OPENFDA_HEADINGS = ["BOXED WARNING", "WARNINGS AND PRECAUTIONS", "WARNINGS", "PRECAUTIONS", "CONTRAINDICATIONS", "ADVERSE REACTIONS", "DRUG INTERACTIONS", "USE IN SPECIFIC POPULATIONS", "PREGNANCY", "LACTATION", "OVERDOSAGE", "DOSAGE AND ADMINISTRATION"]
LONG_TEXT_HEADINGS = ["INDICATIONS", "INDICATIONS AND USAGE", "DOSAGE AND ADMINISTRATION", "CONTRAINDICATIONS", "WARNINGS", "WARNINGS AND PRECAUTIONS", "PRECAUTIONS", "ADVERSE REACTIONS", "CLINICAL PHARMACOLOGY", "DESCRIPTION", "HOW SUPPLIED"]
HEADLINE_STARTS = ("warning:", "warnings:", "boxed warning")
WARNING_STARTS = ("warning", "boxed warning")
HEADLINE_BREAK = r"(?i)(?<!^)\s+(?=(?:boxed warning\b|warning\s*:|warnings\s*:))"
UNIT_BREAK = (
    r"(?i)(?<!^)(?<!\n)\s*(?=(?:keep out of reach of children|keep away from fire|for external use only|boxed warning\b|warning\b|warnings\b|precautions\b|do not use\b"
    r"|when using this product\b|ask a doctor before use\b|ask a doctor or pharmacist before use\b|stop use and ask (?:a )?doctor\b|if swallowed\b|in case of overdose\b|poison control\b))"
)
SENTENCE_END = r"(?<=[.!?])\s+"
#: Where a sentence begins that no stop precedes: what is found, and what stands in its place.
SENTENCE_MARKS = [(r"(?i)\bDirections\b\s*:?", "\nDirections:\n"), (r"(\(\s*\d+(?:\.\d+)*\s*\))", r"\n\1 "), (r"(?<!\w)(\d+(?:\.\d+)*)(?=\s+[A-Z])", r"\n\1")]
#: Texts that say the same: kept ones looked back at, ratio, coverage of the shorter one.
SAME_HEADLINE, SAME_WARNING, SAME_UNIT, SAME_SENTENCE, SAME_LINE = (6, 0.88, 0.55), (6, 0.86, 0.55), (4, 0.92, None), (10, 0.88, 0.70), (4, 0.92, 0.70)
SAME_RATIO, COVERED_LEAST, SAME_HALVES = 0.92, 60, 0.94
SAME_BODY, COVERED_BODY, COVERED_OVERDOSE = 0.90, 0.70, 0.40
OVERDOSE_PAIR = {"warnings", "overdosage"}
TINY_CHARS, TINY_WORDS = 18, 4
#: A prefix told again: least length of the text, characters probed, of the snippet at most and at least, where to look from, share of the text before it, least to keep.
PREFIX = {"text": 350, "probe": 220, "most": 180, "least": 80, "after": 120, "share": 0.75, "keep": 120}
WINDOW_KEEP, WINDOW_PASSES, HALVES_KEY, HALVES_KEEP, SENTENCES_FROM = 180, 4, 320, 120, 220
#: Space that punctuation does not take when words are put together again.
SPACING = [(r"\s+([,.;:!?])", r"\1"), (r"\s+([\)\]\}])", r"\1"), (r"([\(\[\{])\s+", r"\1"), (r"\s{2,}", " ")]
BULLETS = "[■▪•]"
#: Remarks that go from long texts if there are at least so many of them.
REMARKS = [(r"(?i)\bclick (?:or tap )?here to enter text\.?\b", 0), (r"\(\s*\d+(?:\.\d+)*\s*\)", 3), (r"(?i)\[\s*see [^\]]+\]", 2)]
#: A name that lost its first letter, whole and cut, in any case; and what it is. What is left of an ellipsis, and what it was.
CUT_NAMES, WHOLE_NAME = [r"\bcetaminophen\b", r"\bcetamino\b"], "acetaminophen"
CUT_ELLIPSIS, ELLIPSIS = r"â.{1,2}", "..."
#: A number before a heading, where a heading stands, and what follows it; what follows one with a number.
HEADING_NUMBER, HEADING_PLACE, HEADING_END, NUMBERED_END = r"(?:\d+(?:\.\d+)*\s+)?", rf"(?:(?<=^)|(?<=\n)|{SENTENCE_END})\s*", r"\s*:?\s*", r"[,.\-]*\s*"
ONLY_PUNCTUATION, LEADING_PUNCTUATION = r"^[:;\-–—•\.\s]+$", r"^\s*[:;\-–—•]+\s*"
SHOWN_TEXT, SHOWN_LINE = 1500, 20
SIDE_EFFECT_BUCKETS = ["common", "less_common", "rare", "postmarketing", "unknown_frequency"]
#: Rank of a frequency word, by the summary and by the buckets.
PRIORITY_SUMMARY = {"very common": 1, "common": 2, "frequent": 2, "uncommon": 3, "rare": 4, "very rare": 5, "postmarketing": 6}
PRIORITY_BUCKETS = {"very common": 1, "common": 2, "frequent": 3, "infrequent": 4, "uncommon": 4, "rare": 5, "very rare": 6, "postmarketing": 7}
FREQUENCY_WORDS = {"common": ["very common", "common", "frequent"], "less_common": ["uncommon", "infrequent"], "rare": ["rare", "very rare"], "postmarketing": ["postmarketing"]}
ROUTE_CODES = ["iv", "im", "sc", "sq", "po"]
NAME_PREFIXES = [r"^\(.*?\)\s*", r"^\d+(\.\d+)?%\s*", r"\bto deliver\b"]
NAME_CHARS, GENERIC_CHARS = r"[^a-z0-9\s\-]+", r"[^a-z0-9\s\-/+.]"
#: Texts that a cleaner remembers, and how long they are at most; rows of a batch of which results are strings of Python's at once.
KEPT_TEXTS, KEPT_CHARS, PART_ROWS = 256, 4096, 250
#: Without one of these words a pattern finds nothing: of units, of a cut name, of each warning section. Words of a window that are compared first.
UNIT_STARTS = ("keep out of reach of children", "keep away from fire", "for external use only", "warning", "precautions", "do not use", "when using this product", "ask a doctor before use", "ask a doctor or pharmacist before use", "stop use and ask", "if swallowed", "in case of overdose", "poison control")
CUT_NAME, WINDOW_PART = "cetamino", 6
#: Keys of at most so many characters are compared with all kept ones at once; of those from so many on, grams are counted first.
BESIDE_CHARS, GRAMS_FROM = 1024, 200
WARNING_WORDS = {title: ("pregnan", "breast") if "Pregnancy" in title else (title.lower().removesuffix(" and ask a doctor if"),) for title, _ in WARNING_SECTIONS}
