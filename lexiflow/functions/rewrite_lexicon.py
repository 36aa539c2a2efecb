"""Fixed values of rewriting: words, patterns and limits."""

from __future__ import annotations

# What rewriting never looks into, and ranges of numbers.
PROTECTED = "https?://[^\\s<>()]+|\\[[^\\]\\n]{1,400}\\]|«[^»\\n]{0,1200}»|“[^”\\n]{0,1200}”|\"[^\"\\n]{0,1200}\"|`[^`\\n]+`"
NUMBER_RANGE = "[0-9]+(?:[.,][0-9]+)?\\s*[—–-]\\s*[0-9]+(?:[.,][0-9]+)?"
DASH = "[—–]|(?<=\\s)-(?=\\s)"
LIST_LINE = "\\s*(?:[-*•▪◦—–]|[0-9]+[.)])\\s+"
# Limits in words, and spreads that rhythm and paragraphs should have.
RHYTHM_CV, SPLIT_LEAST, MERGE_MOST, OPERATIONS = 0.6, 4, 45, 0.4
PARAGRAPH_LEAST, PARAGRAPH_MOST, PARAGRAPH_CV, SHORT_TAIL = 55, 90, 0.3, 8
ADVERBIAL_LEAST, ADVERBIAL_MOST, REST_LEAST = 2, 5, 4
# Words that open a clause of its own, link two, or may lose their capital.
STARTERS = {
    "ru": "он она оно они мы здесь там тогда этот эта эти такой такая такие".split(),
    "en": "it they this these we there such".split(),
}
LINKS = {
    "ru": {"но": "Однако", "однако": "Однако", "поэтому": "Поэтому", "следовательно": "Следовательно", "а": ""},
    "en": {"but": "However,", "yet": "However,", "so": "Therefore,", "and": ""},
}
LOOSE_LINKS = {
    "ru": {"но": "Но", "однако": "Но", "а": "А", "и": "И", "поэтому": "Поэтому", "следовательно": "Значит"},
    "en": {"but": "But", "yet": "But", "and": "And", "so": "So"},
}
SAFE_LOWER = {
    "ru": "это эти этот эта он она они там здесь такой такая такие при в для на однако поэтому следовательно".split(),
    "en": "it its they their this these there such the a an however therefore in for at on".split(),
}
COPULA = {"ru": ["это"], "en": ["is", "are", "was", "were"]}
# What tells that a clause has a verb of its own.
FINITE = {
    "en": (
        "\\b(is|are|was|were|be|been|has|have|had|does|do|did|can|could|will|would|should|shall|may|might|must|shows?|showed|confirms?|confirmed|demonstrates?|"
        "demonstrated|provides?|provided|requires?|required|allows?|allowed|reduces?|reduced|increases?|increased|remains?|remained|indicates?|indicated|"
        "suggests?|suggested|enables?|enabled|produces?|produced|makes?|made|becomes?|became)\\b"
    ),
    "ru": (
        "(?<![\\p{L}\\p{N}_-])(?:\\p{L}+(?:тся|ться)|явля(?:ется|ются)|показ(?:ал|ала|али|ывает|ывают)|позвол(?:яет|яют)|требу(?:ет|ют)|обеспечива(?:ет|"
        "ют)|содерж(?:ит|ат)|включа(?:ет|ют)|описыва(?:ет|ют)|определя(?:ет|ют)|использу(?:ет|ют)|получен[аыо]?|основан[аыо]?|был[аио]?|буд(?:ет|ут)|"
        "мо(?:жет|гут)|должн[аоы]?|имеет|имеют)(?![\\p{L}\\p{N}_-])"
    ),
}
# Contrasts and what they fold into.
ANTITHESIS = {
    "en": [
        ("not only ([^,.!?—]{2,60}?),?\\s*but also\\s+", "both \\1 and "),
        ("not only ([^,.!?—]{2,60}?),\\s*but\\s+", "both \\1 and "),
        ("not just ([^,.!?—]{2,60}?)[,—]\\s*but\\s+", "\\1, and also "),
        ("it is not merely\\s+", "it is more than "),
        ("not ([^,.!?—]{2,40}?),\\s*but rather\\s+", "rather than \\1, "),
    ],
    "ru": [
        ("не только ([^,.!?—]{2,60}?), но и\\s+", "и \\1, и "),
        ("не просто ([^,.!?—]{2,60}?)[,—]\\s*а\\s+", "\\1, а также "),
    ],
}
# Prepositions and nouns of adverbials that may move to the other end of a sentence.
FRONT = {
    "ru": "в во на за при по после перед до с со через среди около".split(),
    "en": "in on at by after before during within across through since".split(),
}
FRONT_NOUNS = {
    "ru": "году год года годах квартале квартал месяце месяц неделе период периоде течение ходе рамках результате начале конце середине".split(),
    "en": "year years quarter month months week weeks period phase stage beginning end middle course".split(),
}
# Bookish openers and plain ones, in order.
BOOKISH = {
    "ru": [
        ("Однако", "Но "), ("Тем не менее", "И всё же "), ("Следовательно", "Значит, "), ("Вместе с тем", "При этом "), ("Таким образом", "Значит, "),
        ("В связи с этим", "Поэтому "), ("В частности", "Например, "),
    ],
    "en": [
        ("Nevertheless", "But "), ("Nonetheless", "Still, "), ("Consequently", "So "), ("Therefore", "So "), ("Furthermore", "Also, "),
        ("Additionally", "Also, "), ("Hence", "So "), ("Thus", "So "), ("In addition", "Also, "), ("Moreover", "Also, "),
    ],
}
