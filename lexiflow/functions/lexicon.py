"""Fixed values that results depend on: word lists, rates and zones."""

from __future__ import annotations

# Phrases that read as worn out.
CLICHE_EN = [
    "it is important to note", "it should be noted", "it is worth noting", "moreover", "furthermore", "additionally", "in today's world",
    "plays a key role", "plays a crucial role", "a testament to", "delve into", "cutting-edge", "state-of-the-art", "seamless", "leverage",
    "in the realm of", "a wide range of", "due to the fact that", "at the end of the day", "paradigm shift", "holistic approach",
    "game-changing", "unlock the potential", "comprehensive framework", "proactive risk management", "strategic goals", "well-positioned to",
    "significant market share", "rigorous monitoring", "structured implementation approach", "in a dynamic environment",
    "data-driven decision-making", "key stakeholders", "core competencies", "competitive landscape", "significant potential",
    "plays a pivotal role", "going forward", "robust solution", "drive significant",
]
CLICHE_RU = [
    "стоит подчеркнуть", "нельзя не отметить", "следует сказать", "можно сделать вывод", "играет ключевую роль", "не подлежит сомнению",
    "в современном мире", "на сегодняшний день", "трудно переоценить", "неотъемлемой частью", "широкий спектр",
]
# Sentence openers that link, and hedges.
DISCOURSE_RU = [
    "кроме того", "более того", "таким образом", "следовательно", "в связи с этим", "вместе с тем", "при этом", "в то же время",
    "с одной стороны", "с другой стороны", "в заключение", "подводя итог", "в целом", "в частности", "во-первых", "во-вторых", "в-третьих",
    "наконец", "итак", "тем не менее", "однако", "поэтому", "также", "важно отметить", "следует отметить", "стоит отметить",
    "необходимо отметить", "наряду с этим", "помимо этого", "к тому же", "в результате", "в итоге", "отметим", "заметим", "подчеркнём",
]
DISCOURSE_EN = [
    "moreover", "furthermore", "additionally", "in addition", "therefore", "thus", "consequently", "however", "nevertheless", "nonetheless",
    "on the one hand", "on the other hand", "in conclusion", "to summarise", "to summarize", "overall", "in general", "in particular",
    "firstly", "secondly", "thirdly", "finally", "it is important to note", "it should be noted", "it is worth noting", "notably",
    "as a result", "in other words", "that said", "also", "beyond that", "to conclude", "in brief",
]
HEDGE_RU = [
    "возможно", "вероятно", "как правило", "в некоторой степени", "относительно", "довольно", "достаточно часто", "скорее всего",
    "может быть", "по-видимому", "в определённой мере", "в известной мере", "как известно", "принято считать", "можно предположить",
    "представляется", "зачастую", "порой", "иногда", "в ряде случаев", "потенциально", "теоретически", "в целом можно",
]
HEDGE_EN = [
    "possibly", "probably", "arguably", "relatively", "somewhat", "rather", "generally", "typically", "often", "sometimes", "in some cases",
    "to some extent", "it seems", "it appears", "may suggest", "might suggest", "could suggest", "potentially", "presumably", "roughly",
    "more or less", "fairly",
]
# Free rates per language before a score counts.
DASH_RATE = {"ru": 0.3, "en": 0.08}
DISCOURSE_RATE = {"ru": 0.12, "en": 0.09}
OPENER_RATE = {"ru": 0.3, "en": 0.54}
HEDGE_RATE = {"ru": 0.68, "en": 0.27}
MARK_FLOOR = {"ru": 0.22, "en": 0.15}
LONG_FLOOR = {"ru": 0.029, "en": 0.117}
ANTITHESIS_FREE = {"ru": 1, "en": 0}
# The score's weights.
WEIGHTS = {"em_dash": 0.26, "burstiness": 0.22, "cliche": 0.16, "flatness": 0.14, "discourse": 0.10, "hedge": 0.06, "paragraphs": 0.06}
# Patterns of rhetorical contrast, by language.
ANTITHESIS_STRONG = {
    "en": "\\bnot just [^,.!?—]{2,40}[,—] but |\\bnot only [^,.!?—]{2,40},? but also |\\bit is not merely ",
    "ru": "не просто [^,.!?—]{2,40}[,—] а |не только [^,.!?—]{2,40}, но и |это не просто",
}
ANTITHESIS_WEAK = {
    "en": "\\bnot [^,.!?—]{2,30}, but rather [^,.!?—]{2,40}[.,!?]",
    "ru": "(?<!\\p{L})не (?!просто\\b|только\\b)[^,.!?—]{2,30}, а [^,.!?—]{2,40}[.,!?]",
}
# Word shapes of nominal, passive and abstract style.
NOMINAL = {
    "en": "\\p{L}{4,}(?:tion|sion|ment|ance|ence|ency|ancy|ity|ness|ism)s?",
    "ru": "\\p{L}{3,}(?:ание|ение|ация|изация|ирование|ность|ость|ство|изм)[аеиоуыюя]{0,2}",
}
ABSTRACT = {
    "en": "\\p{L}{4,}(?:ity|ism|ness|tion|sion|ance|ence|ology|hood|ship)s?",
    "ru": "\\p{L}{4,}(?:ость|ность|изм|ство|ация|ение|ание|итет|изация)[аеиоуыюя]{0,2}",
}
PASSIVE = {
    "en": "(?:is|are|was|were|be|been|being)\\s+(?:\\p{L}+ly\\s+)?\\p{L}{3,}(?:ed|en)",
    "ru": "(?:(?:был[аио]?|будет|будут)\\s+\\p{L}{4,}(?:ан|ана|ано|аны|ен|ена|ено|ены)|\\p{L}{4,}(?:ирует|ируют|ается|аются|яется|яются|ется|ются|ился|илась|илось|ились)ся?)",
}
# Calibrated zones (low, high, overshoot) of the academic genre, by language; None has no such bound.
ZONES = {
    "ru": {
        "sentenceCv": (0.58, 1.26, 2.2), "shortPerParagraph": (0.14, 1.39, 2.93), "discourseShare": (None, 0.119, 0.157),
        "hedgeDensity": (None, 0.68, 0.93), "nominalizationDensity": (None, 4.35, 5.37), "paragraphCv": (0.66, 1.28, 1.55),
        "openerRepeat": (0.037, 0.295, 0.409), "ngramRepeat": (0.006, 0.184, 0.25), "abstractShare": (None, 0.042, 0.054),
        "dashShare": (None, 0.147, 0.219), "punctInventory": (0.22, 0.93, 1.4), "longSentences": (0.029, 0.161, 0.213),
        "triadShare": (None, 0.066, 0.119),
    },
    "en": {
        "sentenceCv": (0.48, 1.03, 1.43), "shortPerParagraph": (0.01, 0.25, 0.59), "discourseShare": (None, 0.093, 0.153),
        "hedgeDensity": (None, 0.27, 0.61), "nominalizationDensity": (None, 9.83, 11.37), "paragraphCv": (0.86, 1.85, 2.37),
        "openerRepeat": (0.162, 0.536, 0.628), "ngramRepeat": (0.111, 0.444, 0.541), "abstractShare": (None, 0.067, 0.088),
        "dashShare": (None, 0.033, 0.065), "punctInventory": (0.15, 0.89, 1.28), "longSentences": (0.117, 0.327, 0.468),
        "triadShare": (None, 0.207, 0.331),
    },
}
# Zones (low, high, overshoot) of the other genres, for either language.
GENRE_ZONES = {
    "tech-post": {
        "sentenceCv": (0.5, 0.85, 1.2), "shortPerParagraph": (0.5, 2, 3), "discourseShare": (None, 0.12, 0.4), "hedgeDensity": (None, 2, 5),
        "nominalizationDensity": (None, 8, 18), "paragraphCv": (0.3, 1, 1.4), "openerRepeat": (0.1, 0.3, 0.6), "ngramRepeat": (0.01, 0.06, 0.15),
        "abstractShare": (None, 0.08, 0.15), "dashShare": (None, 0.35, 0.5), "punctInventory": (0.15, 2.5, 4), "longSentences": (0.02, 0.35, 0.5),
        "triadShare": (None, 0.2, 0.35),
    },
    "note": {
        "sentenceCv": (0.5, 0.95, 1.3), "shortPerParagraph": (0.5, 2.5, 3.5), "discourseShare": (None, 0.12, 0.4), "hedgeDensity": (None, 2.5, 6),
        "nominalizationDensity": (None, 7, 16), "paragraphCv": (0.3, 1.1, 1.5), "openerRepeat": (0.1, 0.35, 0.6), "ngramRepeat": (0.01, 0.07, 0.16),
        "abstractShare": (None, 0.07, 0.14), "dashShare": (None, 0.4, 0.55), "punctInventory": (0.2, 3, 4.5), "longSentences": (0, 0.2, 0.35),
        "triadShare": (None, 0.25, 0.4),
    },
    "landing": {
        "sentenceCv": (0.5, 1, 1.4), "shortPerParagraph": (0.8, 3, 4), "discourseShare": (None, 0.1, 0.35), "hedgeDensity": (None, 1, 3),
        "nominalizationDensity": (None, 6, 14), "paragraphCv": (0.3, 1.2, 1.6), "openerRepeat": (0.1, 0.3, 0.6), "ngramRepeat": (0.01, 0.08, 0.18),
        "abstractShare": (None, 0.06, 0.12), "dashShare": (None, 0.4, 0.55), "punctInventory": (0.2, 3, 4.5), "longSentences": (0, 0.2, 0.35),
        "triadShare": (None, 0.25, 0.4),
    },
}
# Metrics for which less is better, and those that need 120 words and 5 sentences.
DOWNWARD = ["discourseShare", "hedgeDensity", "nominalizationDensity", "abstractShare", "dashShare", "triadShare"]
NEEDS_MATERIAL = ["sentenceCv", "shortPerParagraph", "paragraphCv", "openerRepeat", "ngramRepeat", "punctInventory", "longSentences", "triadShare"]
# Groups of qualifiers whose counts an edit must keep.
QUALIFIERS = {
    "limit": ["only", "solely", "exclusively", "только", "исключительно"],
    "universal": ["all", "every", "always", "everyone", "everything", "всегда", "все", "каждый", "каждая", "каждое"],
    "frequency": ["often", "usually", "sometimes", "rarely", "часто", "обычно", "иногда", "редко"],
    "condition": ["if", "unless", "provided", "если"],
    "guarantee": ["guarantee", "guarantees", "guaranteed", "certainly", "definitely", "обязательно", "гарантирует", "гарантированно"],
    "precision": ["accurate", "accurately", "exact", "exactly", "точный", "точные", "точность", "точно"],
    "realism": ["realistic", "realistically", "реалистичный", "реалистичные", "реалистично"],
    "accent": ["especially", "particularly", "особенно", "прежде всего"],
    "ability": ["can", "able", "способен", "способна", "способны"],
    "association": ["associated", "correlated", "correlation", "корреляция", "коррелирует", "связано", "связаны"],
}
# Dates, versions, and units after a digit (\\b bounds ASCII words).
EVIDENCE = {
    "date": "\\b(?:[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\\s+(?:янв|фев|мар|апр|мая|май|июн|июл|авг|сен|окт|ноя|дек)[а-я]*\\s+[0-9]{4}|"
    "(?:january|february|march|april|may|june|july|august|september|october|november|december)\\s+[0-9]{1,2},?\\s+[0-9]{4}|[0-9]{4}\\s*(?:г\\.|году|year)|Q[1-4]\\s*[0-9]{4})",
    "version": "\\bv?[0-9]+(?:\\.[0-9]+){1,4}\\b",
}
UNITS = (
    "%|₽|\\$|€|руб\\.?|долл\\.?|тыс\\.?|млн|млрд|трлн|шт\\.?|чел\\.?|кг|г(?=\\b)|т(?=\\b)|км|мм|см|м(?=\\b)|л(?=\\b)|ч(?=\\b)|мин|сек|"
    "дн(?:ей|я)?|мес(?:яц[ае]в?)?|лет|год[а]?|p\\.?p\\.?|bn|mn|k(?=\\b)|kg|km|USD|EUR|RUB|GB|MB|pt|px"
)
# Words that start sentences, so that a capital says nothing.
OPENER_STOP = [
    "the", "a", "an", "this", "that", "these", "those", "it", "we", "they", "he", "she", "in", "on", "at", "for", "to", "by", "with", "as",
    "if", "when", "while", "however", "moreover", "furthermore", "therefore", "thus", "also", "but", "and", "such",
    "и", "а", "но", "в", "во", "на", "по", "при", "для", "как", "что", "это", "этот", "эта", "эти", "тот", "та", "те", "он", "она", "они",
    "мы", "вы", "так", "таким", "кроме", "однако", "поэтому", "если", "когда", "чтобы", "после", "перед", "затем", "далее", "первый",
    "второй", "третий", "также", "более", "менее", "все", "всё", "весь",
]
# Words of a claim, for a whole text and for one sentence.
CLAIMS = {
    "ru": "(?:позволя|обеспечива|улучша|повыша|снижа|способству|гарантиру)[ею]т?|(?:значительн|существенн|эффективн|ключев|важн|комплексн|современн|инновационн|успешн|устойчив)\\p{L}*",
    "en": "provides?|ensures?|enables?|delivers?|improves?|increases?|reduces?|supports?|drives?|allows?|helps?|significant|comprehensive|robust|effective|efficient|strategic|innovative|"
    "successful|seamless|scalable|sustainable|critical|essential|key",
}
SENTENCE_CLAIMS = {
    "ru": "(?:позволя|обеспечива|улучша|повыша|снижа|способству)[ею]т?|(?:значительн|эффективн|ключев|важн|комплексн|успешн)\\p{L}*",
    "en": "provides?|ensures?|enables?|delivers?|improves?|increases?|reduces?|supports?|significant|comprehensive|robust|effective|efficient|strategic|key",
}
WEAK_WEIGHTS = {"discourse": 25, "cliche": 20, "hedge": 15, "empty_claim": 25, "repeated_opener": 15, "average_length": 10, "concrete": -20}
# Abbreviations that need no expansion.
COMMON_ABBREVIATIONS = [
    "AI", "B2B", "B2C", "B2G", "CAGR", "CAPEX", "CEO", "CFO", "CRM", "DCF", "EBIT", "EBITDA", "ERP", "ESG", "EU", "FCF", "GDP", "GMV", "GPS",
    "HR", "IRR", "IT", "KPI", "LLC", "LTV", "MVP", "NPV", "OPEX", "PR", "R&D", "ROI", "SEO", "SME", "SWOT", "UK", "URL", "USA", "USD", "VAT",
    "WACC", "ВВП", "ГОСТ", "ЕС", "ИП", "НДС", "ООО", "РФ", "СМИ", "США", "ЦБ",
]
# Words that say nothing of a sentence's content.
STOP_WORDS = frozenset("и в на с по для что как это все или the and for with that this from are was were has have".split())
