"""Short stop-word lists that the queries and their SQL share; the built-in lists need a running JVM."""

STOPWORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
           "the", "this", "to", "was", "with"),
    "fr": ("dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui",
           "sur", "un", "une"),
    "de": ("als", "auf", "auch", "das", "den", "der", "des", "die", "ein", "eine", "es", "für", "im", "ist", "mit",
           "nicht", "sich", "und", "von", "zu"),
    "es": ("con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un",
           "una", "y"),
}
