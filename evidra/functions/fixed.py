"""Lists, patterns and weights that define results.

They must be what they are for results to be right; none of them is tuned
to data. Patterns are written for Java's regular expressions, where
``(?U)`` makes word classes and boundaries Unicode-aware and ``(?iu)``
folds the case of all letters.
"""

# --- URLs -----------------------------------------------------------------
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "ref", "ref_src"]
CREDENTIAL_SCHEMES = ["http", "https", "ftp", "ftps", "ssh", "git"]

HUB_HOST = "huggingface.co"
HUB_PAGE = r"(?i)^https://huggingface\.co/api/models(?:[?#].*)?$"
NEXT_LINK = r"<([^>]+)>;\s*rel=\"next\""
LOOPBACK_HOSTS = ["127.0.0.1", "localhost", "[::1]"]

# --- Ranking --------------------------------------------------------------
NOISE_PAGES = [r"(?i)cookie\s*policy", r"(?i)accept\s+all\s+cookies", r"(?i)sign\s+up\s+for\s+our\s+newsletter", r"(?i)all\s+rights\s+reserved", r"(?i)\A\s*404\b"]
NOISE_MATCHES = r"(?i)(cookie\s+(policy|consent)|subscribe\s+to|paywall|sign\s+up\s+for|enable\s+javascript|gdpr|advertisement|sponsored)"
ENGINE_WEIGHTS = {
    "wikipedia": 0.85, "wikidata": 0.80, "bing": 0.75, "bing news": 0.85, "duckduckgo": 0.70, "duckduckgo news": 0.85, "github": 0.85, "stackoverflow": 0.80,
    "semantic scholar": 0.90, "arxiv": 0.85, "mojeek": 0.65, "presearch": 0.55, "brave": 0.70, "brave news": 0.80, "google": 0.75, "google news": 0.85,
}
LEGACY_STOP_WORDS = ["и", "в", "на", "с", "по", "о", "у", "для", "the", "a", "an", "in", "on", "of", "to", "is", "are", "was", "were"]

REFORMULATIONS = {"погода": "weather", "новости": "news", "атака": "attack", "мэр": "mayor", "уничтожен": "destroyed", "сбит": "shot down"}

# --- Time -----------------------------------------------------------------
TIME_WORDS = {
    "day": ["сегодня", "сейчас", "только что", "за сутки", "сегодняшний", "today", "now", "latest", "breaking", "just now", "this hour"],
    "week": ["вчера", "на этой неделе", "за неделю", "этой неделе", "yesterday", "this week", "past week", "last week"],
    "month": ["в этом месяце", "за месяц", "этом месяце", "текущий месяц", "this month", "past month", "last month"],
}
YEAR_PATTERNS = [r"(?U)\b(?:в|за|in|during)\s+(19\d{2}|20\d{2})\b", r"(?U)\b(19\d{2}|20\d{2})\s*(?:год|году|year)\b"]
RECENCY = {
    "day": [r"\btoday\b", r"\bсегодня\b", r"\bвчера\b", r"\byesterday\b", r"\bbreaking\b", r"\bтолько что\b"],
    "week": [r"\bthis week\b", r"\bна этой неделе\b", r"\bнедавн[ио]\b", r"\blast\s+48\s+hours?\b", r"\bpast\s+48\s+hours?\b", r"\bпоследн(?:ие|их)\s+48\s+час", r"\bза\s+последн(?:ие|их)\s+48\s+час"],
    "month": [r"\bthis month\b", r"\bв этом месяце\b"],
    "year": [r"\b2026\b", r"\b2025\b", r"\bthis year\b", r"\bв этом году\b"],
}

# --- Routes, in the order that breaks ties --------------------------------
ROUTE_PATTERNS = {
    "llm_release": [
        r"\b(?:new|latest|released?|launch(?:ed)?|upcoming)\b.{0,50}\b(?:llms?|language models?|foundation models?)\b",
        r"\b(?:llms?|language models?|foundation models?)\b.{0,50}\b(?:released?|releases?|launch(?:ed)?|announcement)\b",
        r"\b(?:нов(?:ая|ые|ый)|свеж(?:ая|ие|ий)|вышедш(?:ая|ие|ий))\b.{0,50}\b(?:llm|языков(?:ая|ые|ой) модел[ьи])\b",
        r"\b(?:llm|языков(?:ая|ые|ой) модел[ьи])\b.{0,50}\b(?:релиз|вышл[аи]?|выпущен[аы]?|анонс)\b",
    ],
    "security": [r"\bcve\b", r"\bvulnerab(ilit)?y\b", r"\bexploit\b", r"\b0[- ]?day\b", r"\bsecurity advisory\b", r"\bpatch(ed)?\b", r"\bуязвимост[ьи]\b", r"\bэксплойт[ау]?\b"],
    "academic": [r"\barxiv\b", r"\bresearch paper\b", r"\bисследовани[ея]\b", r"\bстать[яьи]\b", r"\bpaper[s]?\b", r"\bpubmed\b", r"\bsemantics? scholar\b", r"\bpeer[- ]reviewed\b", r"\bacademic\b", r"\bнаучн[аыо]\b", r"\bдиссертаци[яи]\b", r"\bstudy\b"],
    "github": [r"\bgithub\b", r"\brepo(sitory)?\b", r"\bрепозитори[йя]\b", r"\bsource code\b", r"\bисходник[иа]?\b", r"\bgit clone\b"],
    "news": [
        r"\bnews\b", r"\bновост[ьи]\b", r"сегодня", r"вчера", r"latest", r"breaking", r"событи[ея]", r"сообщил[аи]?", r"\bв\s+(20[2-9]\d)\s+год[ау]?\b", r"\b(20[2-9]\d)\s+год[ау]?\b", r"\bin\s+(20[2-9]\d)\b", r"\b(20[2-9]\d)\s+launch",
        r"\bвышел\b", r"\bвышла\b", r"\bвыпустил[аи]?\b", r"\bзапущен[аы]?\b", r"\bзапустил[аи]?\b", r"\bрелиз[а-яё]*\b", r"\bанонсиров[а-яё]*\b", r"\bпредстав[а-яё]*\b", r"\bcurrent\b", r"\bтекущ[аио]?\b",
    ],
    "docs": [r"\bдокументаци[яи]\b", r"\bdocs?\b", r"\bdocumentation\b", r"\bapi reference\b", r"\btutorial\b", r"\bгайд[ау]?\b", r"\bhow to\b", r"\bmanual\b", r"\bруководств[оа]\b", r"\bgetting started\b"],
    "forums": [r"\breddit\b", r"\bфорум[ауом]?\b", r"\bforum[s]?\b", r"\bdiscussion\b", r"\bdiscourse\b", r"\bсообществ[ао]\b", r"hacker ?news", r"\bhn\b", r"\bобсуждени[ея]\b"],
    "reviews": [r"\bотзыв[аыу]?\b", r"\breview[s]?\b", r"\buser experience\b", r"\bопыт\b", r"мнени[ея] польз[ователей]*", r"\bopinions?\b", r"что дума[ею]т[ь]? о", r"стоит ли покупать"],
    "product": [r"\bvs\.?\b", r"\bcompared?\b", r"\bсравн[еи]ть?\b", r"\balternative[s]?\b", r"\bаналог[иа]?\b", r"\bобзор[аы]?\b", r"\bpricing\b", r"\bchangelog\b", r"\bbenchmark[s]?\b"],
    "technical": [
        r"\bspacex\b", r"\bfalcon\s*9\b", r"\bfalcon\s*heavy\b", r"\bnasa\b", r"\broscosmos\b", r"\bESA\b", r"\bapple\b", r"\biphone\b", r"\bmacbook\b", r"\bipad\b", r"\bnvidia\b", r"\btesla\b", r"\bamd\b", r"\bintel\b", r"\bsamsung\b", r"\bgoogle\b", r"\bmicrosoft\b",
        r"\bgpt[- ]?\d?\b", r"\bchatgpt\b", r"\bclaude\b", r"\bgemini\b", r"\bllama\b", r"\bdeepseek\b", r"\bmistral\b",
        r"\bракет[аыу]?\b", r"\bспутник[иа]?\b", r"\bстарт[аы]?\b", r"\bзапус[кт][а-яё]*\b", r"\bступен[ьи]\w*\b", r"\brocket[s]?\b", r"\blaunch(es)?\b", r"\bsatellite[s]?\b",
        r"\btda?\b", r"\bgpu\b", r"\bcpu\b", r"\bram\b", r"\bssd\b", r"\bprocessor\b", r"\bчип[ау]?\b", r"\bвидеокарт[аыу]?\b", r"\bпроцессор[ау]?\b", r"\bоперативн[аяо][\s-]?памят[ьи]\b",
    ],
    "wiki": [
        r"\bчто такое\b", r"\bчто\s+значит\b", r"\bопределени[ея]\b", r"\bwhat is\b", r"\bwhat are\b", r"\bdefine\b", r"\bdefinition\b",
        r"\bоснован[аы]?\b", r"\bосновани[ея]\b", r"\bобразован[аы]?\b", r"\bсоздан[аы]?\b", r"\bучрежд[ёе]н[аы]?\b", r"\bfounded\b", r"\bestablished\b", r"\bformation\b",
        r"\bстран[аыуо]?\s*[-\s]?член[аов]?\b", r"\bстран[аыуо]?\b", r"\bгород[ау]?\b", r"\bнаселённ[аыо]?\w*\b", r"\bстолиц[аыу]?\b", r"\bнаселение\b", r"\bтерритори[яи]\b", r"\bcountry\b", r"\bcity\b", r"\bpopulation\b", r"\bcapital\b",
        r"\bтемператур[аыу]?\s+плавлени[яе]\b", r"\bмасса\b", r"\bатомн[аыо]\s+масс[аыу]?\b", r"\bмолекул[аыу]?\b", r"\bэлемент[аы]?\b", r"\bвселенн[аыу]?\b", r"\bпланет[аыу]?\b", r"\bзвезд[аыу]?\b", r"\bматери[яи]\b", r"\bэнерги[яи]\b", r"\bквантов[аыо]?\b",
        r"\bgalaxy\b", r"\buniverse\b", r"\bplanet[s]?\b", r"\bstar[s]?\b", r"\bmatter\b", r"\benergy\b", r"\bquantum\b",
    ],
}
RECENT_YEAR = r"\b(20[2-9]\d)\b"
#: engines, categories, default time range
ROUTE_PARAMS = {
    "general": (None, None, None),
    "news": (None, "news", "month"),
    "llm_release": ("presearch,bing,mojeek", None, "week"),
    "forums": ("reddit,stackoverflow,hackernews,github", None, None),
    "docs": ("github,mdn,stackoverflow,wikidata", None, None),
    "academic": ("arxiv,semanticscholar,pubmed,openalex", "science", "year"),
    "github": ("github", None, None),
    "reviews": (None, None, None),
    "security": ("github,nvd,cve,securitytracker", None, "year"),
    "product": (None, None, None),
    "technical": ("wikipedia,arxiv,semanticscholar", "general", "year"),
    "wiki": ("wikipedia,wikidata", "general", None),
}
ROUTE_VARIANTS = {
    "reviews": [" reddit", " forum", " user experience", " отзывы"],
    "product": [" review", " pricing", " changelog"],
    "forums": [" reddit", " site:reddit.com", " discussion"],
    "docs": [" site:github.com", " documentation", " tutorial"],
    "llm_release": [" official announcement", " open weights Hugging Face GitHub"],
}
FALSIFICATION_ROUTES = ["news", "security", "product", "technical"]
FALSIFICATION_TERMS = [" criticism", " controversy", " debunked OR false", " опровержение"]

# --- Entities of a question -----------------------------------------------
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "for", "of", "to", "in", "on", "is", "are", "was", "were", "be", "been", "this", "that", "it", "i", "you",
    "we", "they", "my", "your", "our", "their", "with", "from", "as", "by", "at", "do", "does", "did", "have", "has", "had", "can", "could", "would",
    "should", "will", "may", "might", "must", "need", "want", "know", "tell", "explain", "understand", "looking", "find", "some", "any", "all", "how",
    "what", "why", "when", "where", "which", "more", "most", "best", "good", "see", "use", "using", "used", "и", "в", "на", "с", "по", "для", "не",
    "что", "это", "как", "или", "из", "за", "к", "у", "о", "от", "до", "при", "так", "его", "её", "их", "мы", "вы", "он", "она", "они", "быть", "был",
    "была", "было", "мне", "тебе", "нам", "вам", "есть", "нет", "да", "могу", "может", "хочу", "надо", "нужно", "можно", "также", "ещё", "еще",
    "которые", "этот", "эта", "эти", "тот", "та", "те", "который", "которая",
]
CONTENT_BLACKLIST = [
    "сколько", "когда", "где", "кто", "что", "какой", "какая", "какое", "какие", "почему", "зачем", "как", "чем", "каким", "какую", "есть", "было",
    "была", "были", "будет", "будут", "является", "также", "пожалуйста", "вообще", "именно", "этот", "эта", "это", "эти", "тот", "та", "те", "сейчас",
    "сегодня", "вчера", "завтра", "недавно", "давно",
]
INTRO_WORDS = [
    "расскажи", "подробно", "опиши", "опишите", "сравни", "сравните", "найди", "найдите", "покажи", "покажите", "хочу", "хотел", "хотела", "хотелось",
    "можешь", "может", "давай", "давайте", "про", "об", "specifically", "generally", "basically", "actually", "really", "please", "kindly",
    "describe", "explain", "tell", "show", "find", "want", "wanted", "looking", "give", "gives", "overview",
]
SIZE_UNITS = [
    "человек", "людей", "люди", "месяц", "месяца", "месяцев", "неделя", "недели", "недель", "год", "года", "лет", "день", "дня", "дней", "час",
    "часа", "часов", "минут", "минута", "минуты", "вариант", "варианта", "вариантов", "способ", "способа", "способов", "пункт", "пункта", "пунктов",
    "пример", "примера", "примеров", "проект", "проекта", "проектов", "задач", "задача", "задачи", "шаг", "шага", "шагов", "этап", "этапа", "этапов",
    "раз", "раза", "штук", "штука", "штуки", "days", "day", "weeks", "week", "months", "month", "years", "year", "hours", "hour", "minutes", "minute",
    "seconds", "second", "times", "items", "units", "steps", "lines", "examples", "people", "person", "users", "user", "customers", "customer",
    "projects", "project", "tasks", "task", "stories", "story", "options", "option", "ways", "way", "methods", "method", "points", "point", "things",
    "thing",
]
PRODUCT_ENTITY = (
    r"(?U)\b([A-ZА-ЯЁ][a-zа-яё]{2,}|\d+[A-ZА-ЯЁ]+[a-zа-яё]*|[a-zа-яё]*[A-ZА-ЯЁ][a-zа-яё]+)(?:\s+\d+[A-ZА-ЯЁ]?(?:\.\d+)?[a-zа-яё]*)*(?:\s+[A-ZА-ЯЁ][a-zа-яё]{2,})?(?:\s+\d+[A-ZА-ЯЁ]?)?"
)

# --- Facts ----------------------------------------------------------------
FACT_STOP_WORDS = [
    "это", "что", "как", "или", "для", "при", "его", "её", "их", "этот", "эта", "эти", "тот", "та", "те", "все", "весь", "однако", "также", "котор",
    "методы", "учимся", "сегодня", "вчера", "сейчас", "теперь", "the", "and", "for", "with", "this", "that", "from", "into", "what", "how",
]
FACT_SKIP_UNITS = [
    "год", "года", "году", "годом", "годы", "лет", "item", "items", "line", "lines", "example", "examples", "код", "кода", "коды", "пример",
    "примеры", "примеров", "раз", "раза", "размер", "размера", "size", "sizes", "pixel", "pixels", "px", "msk", "мин", "минут", "сек", "секунд",
    "час", "часа", "часов", "hours", "minutes", "seconds",
]
FACT_NUMBER = r"\b(\d{1,4})\s+([а-яёa-z]{3,})\b"
FACT_DATE = (
    r"\b(\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b"
)
FACT_ANCHOR = r"\b[А-ЯЁA-Z][а-яёa-z]{2,}\b"
FACT_NEXT = r"\s+([А-ЯЁA-Za-zЁёА-Яа-я]{2,})"
NAVIGATION_WORDS = [
    "category", "file", "upload", "version", "block", "subcategory", "subcategories", "appearance", "flight", "current", "media", "wiki",
]

# --- Matching -------------------------------------------------------------
SYNONYMS = {
    "append": ["add", "push", "insert"],
    "delete": ["remove", "pop", "discard"],
    "дрон": ["бпла", "беспилотник", "квадрокоптер", "uav", "drone"],
    "бпла": ["дрон", "беспилотник", "uav", "drone"],
    "беспилотник": ["бпла", "дрон", "uav", "drone"],
    "сбит": ["уничтожен", "перехвачен", "перехватили", "сбили", "shot down"],
    "уничтожен": ["сбит", "ликвидирован", "destroyed"],
    "аэропорт": ["воздушная гавань", "airport"],
    "python": ["питон", "python3"],
    "async": ["asynchronous", "асинхронный"],
    "function": ["функция", "method", "метод"],
}
STEMS = {
    "дрона": "дрон", "дронов": "дрон", "дроны": "дрон", "дроне": "дрон", "дрону": "дрон", "дроном": "дрон",
    "беспилотника": "беспилотник", "беспилотников": "беспилотник", "беспилотники": "беспилотник",
    "бпла": "бпла",
    "сбито": "сбит", "сбиты": "сбит", "сбита": "сбит", "сбит": "сбит",
    "обнаружено": "обнаруж", "обнаружены": "обнаруж", "обнаружена": "обнаруж", "обнаружен": "обнаруж",
    "перехвачено": "перехвач", "перехвачены": "перехвач", "перехвачена": "перехвач", "перехвачен": "перехвач",
    "уничтожено": "уничтож", "уничтожены": "уничтож", "уничтожена": "уничтож", "уничтожен": "уничтож",
    "часа": "час", "часов": "час", "часы": "час", "часу": "час", "часом": "час",
    "минуты": "мин", "минут": "мин", "минуту": "мин", "минутой": "мин",
    "drone": "drone", "drones": "drone",
    "vehicle": "vehicle", "vehicles": "vehicle",
    "missile": "missile", "missiles": "missile",
    "attack": "attack", "attacks": "attack",
    "shot": "shot", "shots": "shot",
    "detected": "detect", "detects": "detect",
}
#: Ending, least length of the word above which it is cut, and what takes its place.
ENDINGS = [("ies", 4, "y"), ("es", 3, ""), ("s", 3, ""), ("ов", 3, ""), ("ев", 3, ""), ("ы", 3, ""), ("а", 3, ""), ("у", 3, ""), ("ом", 3, ""), ("ей", 3, ""), ("ть", 3, "")]
NUMBER_UNIT = r"(?iUu)\b(\d+)\s+([а-яёa-z]{3,})\b"
FUZZY_LEAST = 75
NEGATION_BEFORE_FACT = r"(?:^|[^а-яёa-z0-9])(не|нет|без|не\s+был[аи]?|ни|н[еи]\s+одного|ни\s+одного|ни\s+одной)\s+(?:\w+\s+){0,4}"
NEGATION_AFTER_FACT = r"\w*\s+(?:\w+\s+){0,3}(не|нет|не\s+был[аи]?|ни\s+сбит|не\s+сбит|не\s+обнаружен|ни\s+одного)"
NEGATION_ENGLISH = r"(?:^|[^а-яёa-z0-9])(no|not)\s+(?:\w+\s+){0,3}"
WORD_END = r"(?:\b|[^а-яёa-z0-9])"

# --- Critic ---------------------------------------------------------------
CLAIM_NUMBER = r"\b\d{1,3}(?:[.,]\d+)?(?:[KkMm]|%|×)?\b"
CLAIM_YEAR = r"\b(?:19\d{2}|20\d{2})\b"
CLAIM_ENTITY = r"\b([A-Z][a-zA-Zа-яА-Я]+(?:\s+[A-Z][a-zA-Zа-яА-Я]+){0,3})\b"
CLAIM_ENTITY_RU = r"(?U)\b([А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){0,3})\b"
CITATION_MARK = r"\[(\d{1,3})\]"
TEXT_URL = r"https?://[^\s\)\]\"'<>]+"
SEVERITY_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.1}
ADVICE = {
    "numeric_consistency": "Проверьте числовые расхождения между источниками вручную",
    "entity_hallucination": "Уточните у источников имена/компании, упомянутые в claims",
    "self_contradiction": "Синтез противоречит сам себе — пересмотрите логику",
    "citation_integrity": "Исправьте broken citations / missing URLs",
    "temporal_consistency": "Проверьте временные привязки — anachronism",
}
ADVICE_HIGH = "HIGH severity: требуется ручная проверка перед delivery"
ADVICE_MEDIUM = "MEDIUM severity: рекомендуется review"

# --- Gaps: what a kind of gap asks for next -------------------------------
GAP_TASKS = {
    "too_few_sources": ("", "retry with original query"),
    "low_source_diversity": ("", "retry without engine filter"),
    "too_many_unsupported_claims": (" facts evidence sources", "reformulate to specific"),
    "contradictions_unresolved": (" review", "add review query"),
    "low_confidence": (" official documentation", "seek authoritative sources"),
}

# --- Redaction ------------------------------------------------------------
SECRET_NAMES = r"(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|PRIVATE[_-]?KEY|ACCESS[_-]?KEY|CLIENT[_-]?SECRET|MTPROTO[_-]?SECRET|MTSecret|SECRET[_-]?KEY)"
SECRET_ENV = r"([A-Z_][A-Z0-9_]*(?:_|\.)?" + SECRET_NAMES + r"(?:_[A-Z0-9_]+)?)\s*[:=]\s*"
SECRET_URL = r"(?i)([a-z][a-z0-9+\-.]*://)([^:@\s/]+):([^@\s/]+)@([^\s\"'<>)]*)"
SECRET_BOT = r"(\b\d{6,12}):([A-Za-z0-9_\-]{30,})"
SECRET_BEARER = r"([Bb]earer\s+)([A-Za-z0-9._\-+/=]{20,})"
SECRET_LITERAL = r"\b(sk-or-v1-|sk-ant-|sk-|ghp_|gho_|ghu_|ghs_|ghr_|AIza[0-9A-Za-z_\-]{20,}|AKIA[0-9A-Z]{8,}|sk_live_|sk_test_|pk_live_|pk_test_|rk_live_|xoxb-|xoxp-|xoxa-)([A-Za-z0-9_\-]{8,})"
SECRET_PARTS = ["KEY", "SECRET", "TOKEN", "PASSWORD", "PASSWD", "PASS", "PRIVATE", "CREDENTIAL", "AUTH"]
REDACTED = ["***", "****", "<redacted>", "REDACTED"]

# --- Evaluation -----------------------------------------------------------
DENIED_URL_PARTS = [
    "commons.wikimedia.org/wiki/Category", "/wiki/Category:", "vk.com/wall-", "vk.com/wall", "instagram.com/p/", "facebook.com/", "twitter.com/", "t.me/",
    "youtube.com/watch", "?action=",
]
SKIP_COUNTERS = [
    "urls_total", "urls_skipped_duplicate", "urls_skipped_deny_pattern", "urls_skipped_canonical", "fetch_errors", "urls_empty_or_error",
    "search_errors", "search_no_results", "verify_errors", "synthesis_errors", "review_errors",
]
FRESH_STATUSES = ["release", "limited_release"]
HUB_AVAILABILITY = ["open_weights", "gated_open_weights", "adapter_weights"]
HUB_RELATIONS = ["adapter", "finetune", "merge", "quantized"]
