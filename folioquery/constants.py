"""Settings, labels and word lists that results depend on."""

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
SEPARATORS = ("\n\n", "\n", ". ", " ")  # tried in this order, then single characters

TOP_K = 5
# Relevance thresholds by vector provider; each has its own score scale.
THRESHOLDS = {"local": 0.78, "voyage": 0.35, "lexical": 0.35}
# Scores are ranked, compared and reported at this precision, so that the order in which
# partial products were added up cannot change a result.
SCORE_DIGITS = 6
HISTORY_MESSAGES = 6
EXTRACT_CHARS = 180
LOGGED_ANSWER_CHARS = 300

PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

DEFAULT_CATEGORY = "General"
ALL_CATEGORIES = "Todas"
CATEGORY_FILE = "_categorias.json"

FIRST_SECTION = "Inicio"
TABLE_SECTION = "tabla "
NOTES_LABEL = "Notas del orador: "

LABEL_PAGE = "página "
LABEL_SLIDE = "diapositiva "
LABEL_SECTION = "sección "
LABEL_ROW = "fila "
LABEL_FRAGMENT = "Fragmento "
LABEL_SOURCE = "Fuente: "
LABEL_CATEGORY = "Categoría: "
FRAGMENT_SEPARATOR = "\n\n---\n\n"

PRICE_FROM = "desde"
MAINTENANCE = "Mantenimiento "
DEFAULT_PLAN = "Pro"
PAYMENT_TERMS = "50% de anticipo y 50% contra entrega"
FROM_PRICE_NOTE = (
    "Incluye precios 'desde': el total es el punto de partida y puede variar según el alcance final."
)

FEEDBACK_POSITIVE = "positivo"
FEEDBACK_NEGATIVE = "negativo"

# Cell texts that a table reader treats as missing.
NULL_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

HTML_DROPPED_TAGS = ("script", "style", "nav", "footer")
HTML_HEADING_TAGS = ("h1", "h2", "h3")
HTML_TEXT_TAGS = ("p", "li", "td", "th")
