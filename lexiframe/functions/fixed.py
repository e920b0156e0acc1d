"""Fixed values that must equal the behaviour being reproduced.

They are stated once, plainly, and imported everywhere else.
"""

# --- Fixed values: Python ``str.split()`` / ``str.strip()`` whitespace -------------
# The characters Python treats as whitespace (``str.isspace``), as one Java
# regex class.  ``\s`` is not the same set.
WS_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_WS_CLASS = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_RUN = WS_CLASS + "+"

# The same class written for RE2 (DuckDB oracle text).
WS_CLASS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# --- Fixed values: Python ``str.splitlines()`` line boundaries ----------------------
LINE_BREAKS = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
LINE_BREAKS_RE2 = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# --- Fixed values: label-code mapping of the scorer ---------------------------------
LABEL_MAPPING = {
    "LABEL_0": "Action",
    "LABEL_1": "Result",
    "LABEL_2": "Situation",
    "LABEL_3": "Task",
}

# --- Fixed values: special tokens dropped from attention rankings ------------------
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]")
SUBWORD_PREFIX = "##"

# --- Fixed values: English stop words (the 179-word NLTK English list) -------------
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what",
    "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn",
    "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
)

# --- Fixed values: HTML escaping (``html.escape(s, quote=True)``), applied in order --
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))

# --- Fixed values: NA tokens a pandas CSV reader turns into missing values ----------
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: library defaults of the workflow ---------------------------------
DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2
DEFAULT_MAX_LENGTH = 128
Z_LIMIT = 3.0
BOX_WHIS = 1.5
KDE_GRIDSIZE = 200
KDE_CUT = 3.0
