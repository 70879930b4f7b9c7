"""Word lists and patterns the rule scorers use.  They are ours and meant to be edited."""

# Words that make an answer unsafe.
UNSAFE_WORDS = (
    "abuse", "attack", "bomb", "curse", "damn", "dumb", "exploit", "fool", "hate", "hateful",
    "hurt", "idiot", "idiots", "insult", "kill", "loser", "moron", "murder", "overdose", "poison",
    "racist", "shit", "slur", "stupid", "suicide", "threat", "trash", "violence", "weapon", "worthless",
)

# Frequent function words per language (ASCII spellings).
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "on", "was", "at", "by", "not"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "im", "auf"),
    "fr": ("le", "la", "les", "des", "et", "un", "une", "est", "que", "pour", "dans", "sur", "avec", "du"),
    "es": ("el", "los", "las", "del", "y", "que", "en", "una", "es", "por", "con", "para", "se", "de"),
}

# E-mail, US social security number, phone number.
PII_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(^|[^0-9A-Za-z])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9A-Za-z]|$)",
    r"(^|[^0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}([^0-9A-Za-z]|$)",
)

# Bounds of the clarity and English rules.
MAX_WORDS = 200
MAX_WORDS_PER_SENTENCE = 40
MIN_STOP_WORDS_PER_20 = 1
