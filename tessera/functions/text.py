"""Text rules as native Column expressions.

Python's ``str.strip()`` / ``str.split()`` treat every Unicode whitespace
character as a separator; Java's ``\\s`` is ASCII-only.  ``WS`` below is the
exact Python whitespace set written as a regex class, so ``length``,
``word_count`` and the filters agree with the original Python rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

# Python str.isspace() characters: ASCII controls, the 0x1C-0x1F separators,
# NEL and every Unicode space/line/paragraph separator (category Z).
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NON_WS = r"[^\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# Python's \w with re.UNICODE: letters, digits (all scripts) and underscore.
NON_WORD_NON_SPACE = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"^{WS}+|{WS}+$", "")


def words(col) -> Column:
    """``str.split()``: non-empty runs of non-whitespace, as an array."""
    return F.regexp_extract_all(_c(col), F.lit(f"{NON_WS}+"), 0)


def word_count(col) -> Column:
    """``len(str.split())`` without materialising the array."""
    return F.regexp_count(_c(col), F.lit(f"{NON_WS}+"))


def utterance_length(col) -> Column:
    """``len(str)``: code points, unstripped."""
    return F.length(_c(col))


def contains_any(col, needles) -> Column:
    c = _c(col)
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def is_short_or_empty(col, min_stripped: int = C.PRE_FILTER_MIN_STRIPPED) -> Column:
    """Pre-filter Q-0: missing/empty text or fewer than N stripped chars."""
    c = _c(col)
    return c.isNull() | (F.length(py_strip(c)) < min_stripped)


FEATURES = ["_len", "_low", "_slen", "_plen", "_rep"]


def stripped_bounds(c: Column):
    """(leading, trailing) whitespace run lengths, both from anchored
    matches (the trailing one on the reversed text), so stripping never
    scans the text with an unanchored trailing-whitespace pattern."""
    lead = F.length(F.regexp_extract(c, f"^{WS}*", 0))
    trail = F.length(F.regexp_extract(F.reverse(c), f"^{WS}*", 0))
    return lead, trail


def with_text_features(df, col: str):
    """Stage the inputs of the Q-1..Q-6 classifier as plain columns so each
    regex runs once per row, however often the reason refers to it.

    Only the length and the stripped length are needed for every row; the
    lower-cased text, the punctuation test and the word split feed rules
    that a text longer than 2000 characters never reaches (it is already
    ``extreme_length``), so they are computed for short texts only."""
    c = F.col(col)
    n = C.REPETITION_PHRASE_WORDS
    length = F.length(c)
    short = length <= C.MAX_UTTERANCE_CHARS
    lead, trail = stripped_bounds(c)
    staged = df.select(
        "*",
        length.alias("_len"),
        F.greatest(length - lead - trail, F.lit(0)).alias("_slen"),
        lead.alias("_lead"),
        F.when(short, F.lower(c)).alias("_low"),
        F.when(short & (length > C.REPETITION_MIN_CHARS), words(c)).alias("_words"),
    )
    stripped = F.substring(F.col(col), F.col("_lead") + 1, F.col("_slen"))
    w = F.col("_words")
    first = F.array_join(F.slice(w, 1, n), " ")
    rest = F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(1))), " ")
    return staged.select(
        *[x for x in df.columns], "_len", "_low", "_slen",
        F.when(F.col("_len") <= C.MAX_UTTERANCE_CHARS,
               F.length(F.translate(stripped, C.PUNCT_REMOVED, ""))).alias("_plen"),
        F.coalesce((F.size(w) > C.REPETITION_MIN_WORDS) & rest.contains(first), F.lit(False)).alias("_rep"),
    )


def staged_skip_reason() -> Column:
    """Q-1..Q-6 over the columns staged by :func:`with_text_features`."""
    length, low = F.col("_len"), F.col("_low")
    return (
        F.when(length > C.MAX_UTTERANCE_CHARS, F.lit("extreme_length"))
        .when(contains_any(low, C.CORRUPTION_MARKERS), F.lit("corrupted data"))
        .when(F.col("_rep"), F.lit("repetitive corruption"))
        .when((length < C.MEANINGFUL_MIN_LENGTH) & ~contains_any(low, C.EMOTIONAL_KEYWORDS),
              F.lit("too short and no emotional content"))
        .when(F.col("_slen") < C.NOISE_MIN_STRIPPED, F.lit("too short"))
        .when(F.col("_plen") < C.PUNCT_MIN_REMAINING, F.lit("mostly punctuation"))
    )


def meaningful_texts(df, col: str):
    """Rows whose text passes Q-1..Q-6, with the ``_len`` and ``_slen`` of the
    text, so that sources made of these rows need not run the rules again."""
    from .plan import fence
    rules = with_text_features(df, col)
    judged = fence(rules.select(*df.columns, "_len", "_slen", staged_skip_reason().alias("_text_reason")))
    return judged.filter(F.col("_text_reason").isNull() & F.col(col).isNotNull()).drop("_text_reason")


def carried(df) -> list[Column]:
    """The lengths that :func:`meaningful_texts` has put beside a text."""
    return [F.col(c) for c in ("_len", "_slen") if c in df.columns]


# ---------------------------------------------------------------- seeds ---

def clean_seed(col) -> Column:
    """Q-11: collapse whitespace and strip; null when unusable."""
    c = _c(col)
    # strip, then collapse runs: leading/trailing runs collapse to a single
    # space that the final trim removes (the result has no other whitespace)
    collapsed = F.trim(F.regexp_replace(c, f"{WS}+", " "))
    low = F.lower(collapsed)
    word_chars = F.regexp_replace(collapsed, NON_WORD_NON_SPACE, "")
    return (
        F.when(c.isNull() | (c == ""), F.lit(None))
        .when(contains_any(low, C.SEED_ARTIFACTS), F.lit(None))
        .when(F.length(collapsed) < C.SEED_MIN_CHARS, F.lit(None))
        .when(F.length(word_chars) < C.SEED_MIN_WORD_CHARS, F.lit(None))
        .otherwise(collapsed)
    )


def seed_complexity(col) -> Column:
    """Q-13: punctuation marks + conjunction tokens + any descriptive word."""
    c = _c(col)
    low = F.lower(py_strip(c))
    punct = F.length(c) - F.length(F.translate(c, C.COMPLEXITY_PUNCT, ""))
    conj = F.size(F.filter(words(c), lambda w: F.lower(w).isin(C.CONJUNCTIONS)))
    desc = contains_any(low, C.DESCRIPTIVE_WORDS).cast("int")
    return punct + conj + desc


def seed_reason(col, min_words: int = C.SEED_MIN_WORDS, max_words: int = C.SEED_MAX_WORDS) -> Column:
    """Q-12: ordered seed classifier; ``good_seed`` when accepted."""
    c = _c(col)
    n = word_count(c)
    low = F.lower(py_strip(c))
    simple = reduce(lambda a, b: a | b, [low.rlike(p) for p in _java_patterns()])
    return (
        F.when(c.isNull() | (c == ""), F.lit("empty"))
        .when(n < min_words, F.lit("too_short"))
        .when(n > max_words, F.lit("too_long"))
        .when(simple, F.lit("too_simple"))
        .when(contains_any(low, C.QUESTION_WORDS) & (n < C.QUESTION_MAX_WORDS), F.lit("simple_question"))
        .when((seed_complexity(c) == 0) & (n < C.BASIC_MAX_WORDS), F.lit("too_basic"))
        .otherwise(F.lit("good_seed"))
    )


def _java_patterns():
    # Python's \s in these patterns is Unicode whitespace; substitute WS.
    return [p.replace(r"\s", WS) for p in C.SIMPLE_SEED_PATTERNS]


# ------------------------------------------------------------- shingles ---

def with_shingles(df, col: str, out: str = "shingles", n: int = C.SHINGLE_WORDS):
    """D-1: distinct n-word shingles of the lowercased whitespace tokens.

    Tokens are staged as a column (behind a fence) first: inside a lambda an
    un-staged token expression would be re-evaluated for every shingle."""
    from .plan import fence
    staged = fence(df.withColumn("_toks", words(F.lower(F.col(col)))))
    toks = F.col("_toks")
    count = F.size(toks) - (n - 1)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
        lambda i: F.array_join(F.slice(toks, i + 1, n), " "),
    )
    return staged.withColumn(
        out, F.when(count > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))
    ).drop("_toks")
