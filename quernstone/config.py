"""Parameters of the operators, and the fixed values their results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: text ------------------------------------------------------------------------------------------

#: Words that the search index leaves out.
STOP_WORDS = (
    "about after also and are can could did does for from have how immigration into not that the their "
    "this uscis was what when where which who will with would you your"
).split()

#: Words of a command that name no step of a checklist.
STEP_STOP_WORDS = tuple(
    "a an and are for i is it me my of on or please step the this to with mark check complete finish done undo uncheck remove not all tps tpa ead work permit travel authorization "
    "um uma os as e ou de do da dos das para por meu minha marcar marque concluir concluido desmarcar remover pendente todos todas trabalho viagem autorizacao "
    "un una il lo la i gli le e o di del della dei delle per mio mia segna segnare completa completato deseleziona rimuovi mancante tutti lavoro viaggio".split()
)

#: Endings that stemming strips, the long ones first, each list once.
LONG_SUFFIXES = "ization ational fulness ousness iveness".split()
SHORT_SUFFIXES = "ments ment ingly edly ation ities ity ing ers ies ed es s".split()

#: Fixed value: names of languages that end the path of a translated page.
TRANSLATED_SUFFIX = (
    "-(?:arabic|bengali|bulgarian|chinese|croatian|czech|danish|dutch|estonian|finnish|french|german|greek|hindi|"
    "hungarian|irish|italian|latvian|lithuanian|maltese|polish|portuguese|romanian|russian|slovak|slovenian|"
    "spanish|swedish|tagalog|turkish)(?:$|/)"
)

#: Fixed value: the same for sources of an answer.
TRANSLATED_SOURCE = (
    "(?i)(?:^|[-/])(?:arabic|bengali|burmese|chinese|dari|farsi|french|haitian-creole|hindi|korean|pashto|portuguese|"
    "punjabi|russian|somali|spanish|tagalog|urdu|vietnamese)-translation(?:/|$)"
)

#: Domains whose pages may be cited, and the label of each.
OFFICIAL_DOMAINS = ("uscis.gov", "state.gov", "cbp.gov", "dhs.gov", "ice.gov", "justice.gov", "dol.gov")
#: The domains of a question on visits.
VISITOR_DOMAINS = ("state.gov", "cbp.gov")

#: What stands for a personal identifier. Word boundaries are spelt out, as they differ between engines.
SENSITIVE_PATTERNS = {
    "a_number": r"(?i)(^|[^A-Za-z0-9_])A[-\s]?[0-9]{7,9}($|[^A-Za-z0-9_])",
    "receipt": r"(?i)(^|[^A-Za-z0-9_])[A-Z]{3}[0-9]{10}($|[^A-Za-z0-9_])",
    "ssn": r"(^|[^A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^A-Za-z0-9_])",
    "card": r"(^|[^A-Za-z0-9_])(?:[0-9][ -]*?){13,19}($|[^A-Za-z0-9_])",
    "passport": r"(?i)(^|[^A-Za-z0-9_])(?:passport|pasaporte|passeport|passaporto|pasaport|reisepass)\s*(?:number|no\.?|num(?:ber|ero)?|n[uú]mero)?\s*[:#-]?\s*[A-Z0-9]{6,12}($|[^A-Za-z0-9_])",
}

# --- parameters --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.35
    b: float = 0.72
    title_weight: float = 5.0
    base_share: float = 0.65  # of the score, whatever share of the query's terms match
    body_phrase: float = 8.0
    title_phrase: float = 12.0
    phrase_over: int = 8  # characters that a query must exceed to count as a phrase
    preferred: float = 40.0
    url_boosts: tuple[tuple[str, float], ...] = (("/policy-manual/", 4.0), ("/forms/", 2.0), ("/newsroom/", -3.0))
    translated: float = -25.0
    broadcast_terms: int = 200_000  # query terms above which they are joined by a shuffle
    per_page: int = 2
    excerpt: int = 2000


@dataclass(frozen=True)
class ChunkParams:
    pack_length: int = 1800
    pack_overlap: int = 220
    split_length: int = 2000
    split_overlap: int = 240
    cut_after: int = 1300  # a part is cut at a natural place only beyond this many characters
    min_text: int = 160
    separator: str = "\n\n+"
    joiner: str = "\n\n"


@dataclass(frozen=True)
class Topic:
    """One topic of query expansion: phrases that name it, terms it adds, paths it prefers."""

    name: str
    phrases: tuple[str, ...]
    terms: tuple[str, ...]
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class UrlRules:
    """Which paths of one origin belong to the corpus; excludes go before includes."""

    origin: str = "https://www.uscis.gov"
    #: Fixed values.
    include_prefixes: tuple[str, ...] = tuple(
        "/addresschange /administrative-appeals /adoption /citizenship /citizenship-resource-center /family /file-online "
        "/forms /green-card /humanitarian /laws-and-policy /military /policy-manual /records /scams-fraud-and-misconduct "
        "/tools /visit-the-united-states /visit-the-us /working-in-the-united-states /newsroom/alerts "
        "/about-us/contact-us /about-us/find-a-uscis-office".split()
    )
    include_exact: tuple[str, ...] = tuple("/alerts /avoid-scams /case-status /contactcenter /employment-authorization".split())
    exclude_exact: tuple[str, ...] = tuple(
        "/administrative-appeals/aao-practice-manual/search "
        "/citizenship-resource-center/resources-for-educational-programs/citizenship-teacher-training-registration "
        "/forms/filing-guidance/forms-by-mail-confirmation /forms/myaccount-redirect /tools/a-z-index/site-map "
        "/tools/top-ten-ways-uscis-is-improving-the-integrity-of-the-immigration-system".split()
    )
    exclude_prefixes: tuple[str, ...] = tuple(
        "/archive /archive-alerts /archive-forms-updates /archive-laws /archive-reports "
        "/archive-testimonies-and-speeches /es /i-9-central /news /outreach /save /sites /website-policies".split()
    )
    exclude_extensions: tuple[str, ...] = tuple("avi csv doc docx gif jpg jpeg json mp3 mp4 pdf png ppt pptx svg txt webp xls xlsx xml zip".split())


@dataclass(frozen=True)
class LimiterParams:
    limit: int = 30
    window_seconds: int = 600


@dataclass(frozen=True)
class CacheParams:
    ttl_seconds: int = 300
    entries: int = 80


@dataclass(frozen=True)
class QuotaParams:
    limit: int = 5


@dataclass(frozen=True)
class AnswerParams:
    max_question: int = 4000
    max_context: int = 12_000
    max_language: int = 20
    min_sentence: int = 45
    max_sentence: int = 520
    sentences: int = 3
    fallback_chars: int = 900
    max_sources: int = 6
    relative_cut: float = 0.85
    supporting: int = 4
    follow_up_under: int = 7  # tokens: shorter questions take the previous one along
    cache_chars: int = 900
    copy: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "en": {"intro": "This is what the indexed pages say:", "verify": "Check the linked page before you act on it.", "missing": "No indexed page matches this question."},
            "es": {"intro": "Esto dicen las páginas indexadas:", "verify": "Compruebe la página enlazada antes de actuar.", "missing": "Ninguna página indexada responde a esta pregunta.", "source_language": "El texto está en inglés."},
            "fr": {"intro": "Voici ce que disent les pages indexées :", "verify": "Vérifiez la page liée avant d'agir.", "missing": "Aucune page indexée ne répond à cette question.", "source_language": "Le texte est en anglais."},
        }
    )
