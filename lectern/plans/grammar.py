"""The words and patterns of French queries."""

from __future__ import annotations

import re

# The patterns that decide what a query means.
MONTH = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
DAY_NUMERIC = r"\b\d{1,2}[/\-\s]+\d{1,2}[/\-\s]+\d{4}\b"
DAY_NAMED = rf"\b\d{{1,2}}\s+(?:{MONTH})\s+\d{{4}}\b"
MONTH_NUMERIC = r"\b\d{1,2}[/\-\s]+\d{4}\b"
MONTH_NAMED = rf"\b(?:{MONTH})\s+\d{{4}}\b"
YEAR = r"\b(?:19\d{2}|20\d{2})\b"
OF = r"(?:de la|de l[']|de|du|des|d['])"
BETWEEN_DAYS = rf"\bentre\s+(?:le\s+)?(?P<start>{DAY_NUMERIC}|{DAY_NAMED})\s+et\s+(?:le\s+)?(?P<end>{DAY_NUMERIC}|{DAY_NAMED})\b"
BETWEEN_MONTHS = rf"\bentre\s+(?P<start>{MONTH_NUMERIC}|{MONTH_NAMED})\s+et\s+(?P<end>{MONTH_NUMERIC}|{MONTH_NAMED})\b"
BETWEEN_YEARS = rf"\bentre\s+(?P<start>{YEAR})\s+et\s+(?P<end>{YEAR})\b"
RUBRIQUE = (
    r"\b(?:(?:dans|sur|pour|provenant|de|du|des|d['])\s+)?(?:la|le|les|l['])?\s*\brubrique\s+(?:est\s+|se\s+nomme\s+)?(?P<rubrique>.+?)"
    r"(?=$|\b(?:et|ou|sans|mais|dont|qui|parlant|traitant|mentionnant|contenant|évoquant|impliquant|portant|provenant|datant)\b)"
)
OPERATOR = r"\bet\s+non\s+pas\b|\bnon\s+pas\b|\bmais\s+pas\b|\bsans\b|\bet\b|\bou\b"
TITLE = (
    r"\bdont\s+le\s+titre\s+(?:contient|évoque)\s+(?:le\s+mot|les\s+mots|le\s+terme)?\s*"
    r"\"?(?P<value>[^\"]+?)\"?(?:$|\b(?:et|ou|mais\s+pas|sans)\b)"
)
WITH_IMAGE = r"\bavec\s+des?\s+images?\b|\bavec\s+image\b|\bcontenant\s+une?\s+image\b|\bqui\s+ont\s+des?\s+images?\b"
WITHOUT_IMAGE = r"\bsans\s+image\b|\bsans\s+images\b"
DENIED_THEME = (
    r"\bn[']?e?\s*(?:parl(?:e|ent|ait|aient|ant|er)|trait(?:e|ent|ait|aient|ant|er)|évoqu(?:e|ent|ait|aient|ant|er)"
    r"|mentionn(?:e|ent|ait|aient|ant|er)|concern(?:e|ent|ait|aient)|port(?:e|ent|ait|aient|ant|er))\s+pas\s+"
    rf"{OF}(?P<theme>.+)"
)
THEME = (
    rf"\b(?:parl(?:e|ent|ant|er)(?:\s+{OF})?|trait(?:e|ant|er)\s+{OF}|sur|a\s+propos\s+{OF}|évoqu(?:e|ent|ant|er)"
    r"|mentionn(?:e|ent|ant|er)|port(?:e|ent|ant|er)\s+sur|li(?:e|es)\s+a|concern(?:e|ent)|contien(?:t|nent)|contenant"
    r"|possèd[e]?(?:nt)?|possédant|impliqu(?:e|ent|ant|er)|comport(?:e|ent|ant|er))\b\s*(?P<theme>.+)"
)
ARTICLE_WORD = r"\barticles?\b"
# A theme may be led by "le mot", "les termes" and the like, and by one of these, of which the first that fits counts.
NAMING = (("le", "les"), ("mot", "mots", "terme", "termes"))
LEADING_ARTICLES = ("des", "du", "de la", "de l'", "d'", "de", "les", "la", "le", "l'")
LEADING_NOT = r"^(?:non\s+pas|pas)\s+"
OF_SOMETHING = r"\b(?:des|de l[']|de la|de|du|d['])\s*(.+)$"
LEADING_OPERATOR = r"^(?:et|ou)\s+"
LEADING_TITLE_WORDS = r"^(?:le|les)\s+(?:mot|mots|terme|termes)\s*"
TEMPORAL_WORDS = ("mois", "annee", "an", "apres", "avant", "depuis", "partir", "date", "publie")
NEGATIVE_OPERATORS = ("sans", "mais pas", "non pas", "et non pas")
DATE_KINDS = (
    ("between_dmy", BETWEEN_DAYS),
    ("between_my", BETWEEN_MONTHS),
    ("between_y", BETWEEN_YEARS),
    ("dmy", DAY_NUMERIC),
    ("dmy", DAY_NAMED),
    ("my", MONTH_NUMERIC),
    ("my", MONTH_NAMED),
    ("y", YEAR),
)
# Words of queries that are never corrected.
CONTROL_WORDS = (
    "rubrique", "rubriques", "titre", "titres", "article", "articles", "contient", "contiennent", "contenant", "evoque", "evoquant", "parle",
    "parlent", "parlant", "parler", "traite", "traitent", "traitant", "traiter", "mentionne", "mentionnent", "mentionnant", "mentionner", "concerne",
    "concernent", "porte", "portent", "portant", "implique", "impliquent", "impliquant", "impliquer", "mot", "mots", "terme", "termes", "entre", "et",
    "ou", "sans", "non", "pas", "mais", "dont", "qui", "que", "des", "du", "de", "la", "le", "les", "un", "une", "il", "ils", "elle", "elles", "se",
    "son", "sa", "ses", "image", "images", "avec", "sur", "dans", "pour", "par", "veux", "voudrais", "vouloir", "afficher", "liste", "donner",
    "trouver", "chercher", "obtenir", "recuperer", "presenter", "datant", "publie", "publies", "publiee", "publiees", "paru", "parus", "annee",
    "annees", "mois", "jour", "jours", "an", "ans", "janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre",
    "novembre", "decembre", "depuis", "apres", "avant", "partir", "date", "dates", "ce", "cette", "ces", "tout", "tous", "toute", "toutes", "comme",
    "ainsi", "deux", "trois", "premier", "premiere", "auteur", "auteurs", "redacteur", "redacteurs", "redactrice",
)


def pattern(text: str) -> re.Pattern[str]:
    return re.compile(text, re.IGNORECASE)
