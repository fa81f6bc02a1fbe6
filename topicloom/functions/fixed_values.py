"""Fixed values.

Everything in this module is a fixed value: results are only right when these
lists, patterns and constants are exactly as given here.
"""

# Fixed value: the id that marks posts whose employer recruits through the job centre.
JOBCENTER_ID = "Virksomheden har valgt at rekruttere via jobcentret"
# Fixed value: prefix of the ids that replace it.
JOBCENTER_PREFIX = "jobcenter_"

# Fixed value: language kept by default, and the name for texts without a decision.
DEFAULT_LANGUAGE = "DAN"
UNKNOWN_LANGUAGE = "unknown"

# ISO 639-1 code to ISO 639-3 name.
ISO_639_3 = {
    "da": "DAN",
    "de": "DEU",
    "en": "ENG",
    "es": "SPA",
    "fr": "FRA",
    "nb": "NOB",
    "nn": "NNO",
    "sv": "SWE",
}

# Patterns of text to remove.
HTML_TAG = r"<[^>]+>"
ESCAPED_TAB = "_x0009_"
BLANKS = r"[ \t]+"
PARAGRAPH_BREAK = r"(?:\r?\n){2,}"
LINE_BREAKS = r"[\r\n]+"

# Patterns of sensitive text (date, phone number, e-mail, web address).
DATE = (
    r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
    r"|\d{1,2}\.\s*(jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec"
    r"|januar|februar|marts|april|maj|juni|juli|august|september|oktober|november|december)"
    r"[a-zæøå]*\s*\d{4})\b"
)
PHONE = r"\b(\d{8}|(\d{2}\s){3}\d{2})\b"
EMAIL = r"\b[\w\.-]+@[\w\.-]+\.\w+\b"
HOMEPAGE = (
    r"http[s]?://\S+|www\.\S+"
    r"|\b[\w\.-]+\.(dk|com|net|org|info|eu|io|co|biz|gov|edu)\b"
)

# Fixed value: a token is a run of two or more word characters.
TOKEN = r"[\p{L}\p{M}\p{N}_]{2,}"

# Danish stop words.
DANISH_STOPWORDS = tuple(
    """
    ad af aldrig alle alt anden andet andre at bare begge blev blive bliver da de dem den denne der
    deres det dette dig din dine disse dit dog du efter ej eller en end ene eneste enhver er et far
    fem fik fire flere fleste for fordi forrige fra få får før god godt ham han hans har havde have
    hej helt hende hendes her hos hun hvad hvem hver hvilken hvis hvor hvordan hvorfor hvornår i
    ikke ind ingen intet ja jeg jer jeres jo kan kom komme kommer kun kunne lad lav lidt lige lille
    man mand mange med meget men mens mere mig min mine mit mod må ned nej ni nogen noget nogle nu
    ny nyt når nær næste næsten og også okay om op os otte over på se seks selv ser ses sig sige sin
    sine sit skal skulle som stor store syv så sådan tag tage thi ti til to tre ud under var ved vi
    vil ville vor vores være været
    """.split()
)
