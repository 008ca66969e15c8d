"""Short own word lists; callers may pass longer ones."""

# Frequent function words of four languages.
STOPWORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "so"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "he", "are", "this", "at", "from", "or", "an", "be", "have", "not", "you"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como", "más", "o", "pero", "sus"),
    "fr": ("le", "la", "de", "et", "les", "des", "en", "un", "une", "du", "est", "que", "dans", "qui", "par", "pour", "au", "sur", "pas", "plus", "ne", "ce", "il", "se", "avec"),
}
#: Insults by language; "en" counts in every language. Callers pass longer lists, or learn them from labels.
FLAGGED: dict[str, tuple[str, ...]] = {
    "de": ("idiot", "trottel", "vollidiot", "dummkopf", "abschaum", "arschloch", "scheiße", "wertlos"),
    "en": ("idiot", "moron", "stupid", "loser", "clown", "disgusting", "pathetic", "trash", "scum", "worthless"),
    "es": ("idiota", "imbécil", "estúpido", "payaso", "basura", "escoria", "inútil", "patético"),
    "fr": ("idiot", "imbécile", "stupide", "clown", "ordure", "racaille", "minable", "pathétique"),
}
#: Terms that weigh a thousand times as much in ``banned_ratio``; a parameter, no list is shipped.
BANNED: dict[str, tuple[str, ...]] = {}

# Codes of languages whose text is counted by characters.
CJK_LANGS = ("zh", "zh-classical", "zh-min-nan", "zh-yue", "ko", "ja", "th", "jv_tr")
# Characters that count as special; the space is none of them.
JUNK = '꧊꧌꧍꧁꧂꧇꧃꧋꧆꧉,{}[]()|\\"\'“”《》«»~!@#$%^&*_–+=-0987654321`<>、،./?:;\t\nπه☆●¦″．۩۱（☛₨➩°・■↑☻๑º‹€σ٪’Ø·−♥ıॽ٥‘©。¨﴿！★×✱´٬→±x：¹？£―▷ф¡Г♫∟™ª₪®▬「—¯；¼❖․ø•」٣，٢◦‑←§١ー٤）˚›٩▼٠¢¸٨³½˜٭ˈ¿¬ι۞⌐¥►†ƒ∙²¤…﴾⠀′ا✓¶'
# Marks taken off words before they are looked up.
STRIP = JUNK + " "
# Languages that identifiers take for each other; the first group that names a language is its own.
LANG_GROUPS: tuple[tuple[str, str], ...] = (
    ("ig sn ny st zu xh rw sw yo so", ""), ("mr ne hi", ""), ("fr br", "la"), ("pt", "la gl"), ("eo es oc ca eu an gl", "la"),
    ("arz ar fa ur az azb ckb ps", ""), ("id ms", ""), ("as bn bpy", ""), ("af nl", ""), ("bo dz", ""), ("bs hr", ""), ("bxr mn", ""),
    ("ceb tl", ""), ("cs sk", ""), ("da no", ""), ("eml wa", ""), ("de lb pl dsb", ""), ("jv", "id ms tl"), ("av ru bg ba kk ky uk be ce cv", ""),
)


def lang_group(lang: str | None) -> tuple[str, ...]:
    """Languages that ``lang`` may be taken for, itself included."""
    for names, more in LANG_GROUPS:
        if lang in names.split():
            return tuple(sorted({*names.split(), *more.split()}))
    return (lang,) if lang else ()
