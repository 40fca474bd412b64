"""English lexemes: the Snowball project's English stemmer and stop words as column functions, meant for tables of distinct words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the Snowball project's English list.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if
or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now""".split()
)

# Words with stems of their own, and words that stay as they are once plurals are gone.
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# Suffixes and what stands in their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

#: What a word must end in for any step to change it; an apostrophe anywhere counts as well.
CHANGED = f"'|({'|'.join(dict.fromkeys(('s', 'ed', 'ing', 'y', 'e', 'l', *SECOND, *THIRD, *FOURTH)))})$"

_V, _C = "[aeiouy]", "[^aeiouy]"
#: A syllable at the end that lengthens its vowel if an e follows; consonantal y is Y by then.
_SHORT_END = rf"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _suffix(word: Column, suffixes: object) -> Column:
    """The longest of the suffixes that a word ends in, or an empty string."""
    return F.regexp_extract(word, f"({'|'.join(suffixes)})$", 1)


def _cut(word: Column, n: int | Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _replaced(word: Column, suffix: Column, by: dict[str, str]) -> Column:
    """The word with its suffix replaced."""
    return F.concat(_cut(word, F.length(suffix)), F.create_map(*[F.lit(x) for pair in by.items() for x in pair])[suffix])


def with_stems(words: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """The rows with the stem of a lower-case word.

    Words that aren't all of a-z and apostrophes, such as numbers and words of other scripts, are their own stems; so are null and
    words without an ending that a step would change, for which no step is worked out.  Every step is a projection, so that no expression repeats the
    ones before it.
    """
    keep = [F.col(c) for c in words.columns]
    w, suffix = F.col("_w"), F.col("_s")
    in_r1, in_r2 = F.length(w) - F.length(suffix) >= F.col("_r1"), F.length(w) - F.length(suffix) >= F.col("_r2")

    def step(rows: DataFrame, new: Column, suffix: Column | None = None, cond: Column | None = None) -> DataFrame:
        """Put ``new`` in the place of the words in work that fit."""
        if suffix is not None:
            rows = rows.select(*keep, "_w", "_r1", "_r2", "_done", F.when(~F.col("_done"), suffix).alias("_s"))
        fits = ~F.col("_done") & cond if cond is not None else ~F.col("_done")
        return rows.select(*keep, F.when(fits, new).otherwise(w).alias("_w"), "_r1", "_r2", "_done")

    own = F.create_map(*[F.lit(x) for pair in OWN_STEMS.items() for x in pair])[F.col(word)]
    plain = F.col(word).rlike("^[a-z']{3,}$") & own.isNull() & F.col(word).rlike(CHANGED)
    start = F.regexp_replace(F.col(word), "^'", "")
    # a y that stands first or follows a vowel is a consonant
    marked = F.regexp_replace(F.regexp_replace(start, "^y", "Y"), f"({_V})y", "$1Y")
    rows = words.select(*keep, F.when(plain, marked).otherwise(F.coalesce(own, F.col(word))).alias("_w"), (~F.coalesce(plain, F.lit(False))).alias("_done"))
    region = lambda from_: F.length(F.regexp_extract(from_, f"^.*?{_V}{_C}", 0))
    after = lambda n: F.when(n > 0, n)
    first = F.coalesce(after(F.length(F.regexp_extract(w, "^(gener|commun|arsen)", 0))), after(region(w)), F.length(w))
    rows = rows.select(*keep, "_w", "_done", first.alias("_r1"))
    rest = F.substring(w, F.col("_r1") + 1, F.length(w))
    rows = rows.select(*keep, "_w", "_r1", (F.col("_r1") + F.coalesce(after(region(rest)), F.length(rest))).alias("_r2"), "_done")

    rows = step(rows, F.regexp_replace(w, "('s'|'s|')$", ""))
    # plurals
    s = _suffix(w, ("sses", "ied", "ies", "us", "ss", "s"))
    short = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
    plural = F.when(suffix == "sses", _cut(w, 2)).when(suffix.isin("ied", "ies"), short).when((suffix == "s") & w.rlike(f"{_V}.+s$"), _cut(w, 1)).otherwise(w)
    rows = step(rows, plural, s, suffix != "")
    rows = rows.select(*keep, "_w", "_r1", "_r2", (F.col("_done") | w.isin(*LEFT_ALONE)).alias("_done"))
    # past tenses and participles
    s = _suffix(w, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    bare = _cut(w, F.length(suffix))
    mended = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _cut(bare, 1))
    mended = mended.when(bare.rlike(_SHORT_END) & (F.length(bare) <= F.col("_r1")), F.concat(bare, F.lit("e"))).otherwise(bare)
    past = F.when(suffix.isin("eed", "eedly"), F.when(in_r1, F.concat(bare, F.lit("ee"))).otherwise(w)).when(bare.rlike(_V), mended).otherwise(w)
    rows = step(rows, past, s, suffix != "")
    rows = step(rows, F.concat(_cut(w, 1), F.lit("i")), cond=w.rlike(f"^.+{_C}[yY]$"))
    # longer suffixes
    valid = (F.when(suffix == "ogi", w.rlike("logi$")).when(suffix == "li", w.rlike("[cdeghkmnrt]li$")).otherwise(True)) & in_r1
    rows = step(rows, _replaced(w, suffix, SECOND), _suffix(w, SECOND), (suffix != "") & valid)
    rows = step(rows, _replaced(w, suffix, THIRD), _suffix(w, THIRD), (suffix != "") & in_r1 & ((suffix != "ative") | in_r2))
    rows = step(rows, _cut(w, F.length(suffix)), _suffix(w, FOURTH), (suffix != "") & in_r2 & ((suffix != "ion") | w.rlike("[st]ion$")))
    ends_short = _cut(w, 1).rlike(_SHORT_END)
    s = _suffix(w, ("e", "l"))
    last = ((suffix == "e") & (in_r2 | (in_r1 & ~ends_short))) | ((suffix == "l") & in_r2 & w.rlike("ll$"))
    rows = step(rows, _cut(w, 1), s, last)
    return rows.select(*keep, F.when(F.col("_done") & ~w.isin(*LEFT_ALONE), w).otherwise(F.regexp_replace(w, "Y", "y")).alias(stem))


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-case, in order; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexemes(words: DataFrame, word: str = "word") -> DataFrame:
    """Distinct ``word, lexeme``: stems of the words that aren't stop words."""
    kept = words.select(F.col(word).alias("word")).where(F.col("word").isNotNull() & ~F.col("word").isin(*STOP_WORDS)).distinct()
    return with_stems(kept, "word", "lexeme")
