"""SQL fragments shared by the oracle statements."""

from carnet import constants as K


def words_in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SP = r"[\s\p{Z}]"
W = r"\p{L}\p{N}_"
LET = "A-Za-zÀ-ÖØ-öø-ÿ"
FUNCTION_WORDS = words_in(K.FUNCTION_WORDS)
STOPWORDS = words_in(K.FRENCH_STOPWORDS)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^{W}\s\p{{Z}}]', ' ', 'g'), '{SP}+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def is_function_word(x: str) -> str:
    return f"(length({x}) <= 2 OR lower({x}) IN {FUNCTION_WORDS})"


def sentences(x: str) -> str:
    """Sentence list: the look-behind split is written as a mark after final punctuation."""
    marked = rf"regexp_replace(replace({x}, '|', '. '), '([.!?]){SP}+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({marked}, chr(1) || '|\n+'), lambda s: {strip('s')}), lambda s: s <> '')"


def join_sentences(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END), ' ')"


def upper(x: str) -> str:
    """Capitals the way both the JVM and Python spell them: a sharp s becomes SS."""
    return f"upper(replace({x}, 'ß', 'ss'))"
