"""Text analysis as Spark expressions: folding, tokens, stop words, stems.

Everything here stays in the JVM. Each function takes a column and returns one; ``*_sql`` gives the
same rule in DuckDB's SQL, for comparison.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.rules import DERIVED, DOUBLES, PLURALS, STOP_WORDS, TOKEN_PATTERN, UNDOUBLED, UNSTEMMED, VERBS

@lru_cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """From Unicode's NFKD: characters that fold to one ASCII character, those characters, and the
    characters that fold to several. All others outside ASCII fold to nothing."""
    single, several = {}, {}
    for point in range(128, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[chr(point)] = plain
        elif plain:
            several[chr(point)] = plain
    return "".join(single), "".join(single.values()), several


def fold(text: Column) -> Column:
    """NFKD, then only ASCII, then small letters; null folds to nothing.

    ASCII texts need small letters only, and one pass of ``translate`` does nearly all others; only
    texts that hold a character that folds to several take the replacements as well.
    """
    source, target, several = fold_tables()
    # one literal, which the optimizer splits once: a character and what it folds to
    pairs = F.split(F.lit("\n".join(k + v for k, v in several.items())), "\n")
    expand = lambda t: F.aggregate(pairs, t, lambda t, p: F.replace(t, F.substring(p, 1, 1), F.substring(p, F.lit(2), F.length(p))))
    plain = F.translate(text, source, target)
    other = F.regexp_replace(plain, r"[\x00-\x7F]+", "")  # what is left to look at, mostly nothing
    plain = F.when((other != "") & other.rlike("[" + "".join(several) + "]"), expand(plain)).otherwise(plain)
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]+", "")
    return F.lower(F.coalesce(F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text), F.lit("")))


def fold_sql(text: str) -> str:
    source, target, several = fold_tables()
    out = text
    for k, v in several.items():
        out = f"replace({out},'{k}','{_quoted(v)}')"
    return rf"lower(regexp_replace(coalesce(translate({out},'{source}','{_quoted(target)}'),''),'[^\x00-\x7F]+','','g'))"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def stripped(text: Column) -> Column:
    """Without the white space around it; of ASCII texts."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def stripped_sql(text: str) -> str:
    return rf"regexp_replace({text},'^[\s\x0b\x1c-\x1f]+|[\s\x0b\x1c-\x1f]+$','','g')"


def tokens(text: Column) -> Column:
    """The tokens of a text in order, folded."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({fold_sql(text)},'{TOKEN_PATTERN}')"


def is_stop_word(token: Column) -> Column:
    return token.isin(STOP_WORDS)


def is_stop_word_sql(token: str) -> str:
    return f"({token} IN ({','.join(repr(w) if chr(39) not in w else chr(39) + _quoted(w) + chr(39) for w in STOP_WORDS)}))"


def content_tokens(words: Column, least: int = 2) -> Column:
    """Without stop words and tokens shorter than ``least``."""
    return F.filter(words, lambda w: ~is_stop_word(w) & (F.length(w) >= least))


def _stage(word: Column, rules, undouble: bool = False) -> Column:
    out = None
    for ending, least, cut, added in rules:
        short = F.substring(word, F.lit(1), F.length(word) - cut)
        if undouble and ending in UNDOUBLED:
            short = F.when(F.substring(short, -2, 2).isin(*DOUBLES), F.substring(short, F.lit(1), F.length(short) - 1)).otherwise(short)
        if added:
            short = F.concat(short, F.lit(added))
        fits = word.endswith(ending) & (F.length(word) >= least)
        out = F.when(fits, short) if out is None else out.when(fits, short)
    return out.otherwise(word)


def stems(words: Column) -> Column:
    """The stem of each word of an array. Each stage is a pass of its own, so that what a stage
    makes is computed once and not again for every rule of the next one."""
    staged = F.transform(words, lambda w: F.when(F.length(w) > UNSTEMMED, _stage(w, PLURALS)).otherwise(w))
    pairs = F.arrays_zip(words.alias("w"), staged.alias("s"))
    keep = lambda p, s: F.when(F.length(p["w"]) > UNSTEMMED, s).otherwise(p["w"])
    pairs = F.transform(pairs, lambda p: F.struct(p["w"].alias("w"), keep(p, _stage(p["s"], VERBS, True)).alias("s")))
    return F.transform(pairs, lambda p: keep(p, _stage(p["s"], DERIVED)))


def stem(word: Column) -> Column:
    """The stem of a word that is in small letters."""
    return stems(F.array(word))[0]


def _stage_sql(word: str, rules, undouble: bool = False) -> str:
    out = "CASE"
    for ending, least, cut, added in rules:
        short = f"substr({word},1,length({word})-{cut})"
        if undouble and ending in UNDOUBLED:
            doubles = ",".join(f"'{d}'" for d in DOUBLES)
            short = f"CASE WHEN right({short},2) IN ({doubles}) THEN substr({word},1,length({word})-{cut + 1}) ELSE {short} END"
        out += f" WHEN ends_with({word},'{ending}') AND length({word})>={least} THEN {short}" + (f"||'{added}'" if added else "")
    return out + f" ELSE {word} END"


def stem_sql(word: str) -> str:
    """The stem of ``word``, an expression that is in small letters. Evaluates lambdas stage by stage."""
    staged = f"[{word}]"
    for rules, undouble in ((PLURALS, False), (VERBS, True), (DERIVED, False)):
        staged = f"list_transform({staged}, lambda w: {_stage_sql('w', rules, undouble)})"
    return f"(CASE WHEN length({word})<={UNSTEMMED} THEN {word} ELSE ({staged})[1] END)"


def with_stem(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df`` with the stem of the column ``word``. Each stage is a column of its own, which the optimizer
    doesn't copy into the next, so the rules stay compiled code over exploded words."""
    w = F.col(word)
    df = df.withColumn("__1", _stage(w, PLURALS))
    df = df.withColumn("__2", _stage(F.col("__1"), VERBS, True))
    df = df.withColumn(out, F.when(F.length(w) > UNSTEMMED, _stage(F.col("__2"), DERIVED)).otherwise(w))
    return df.drop("__1", "__2")


#: White space between words, as a pattern: all that Unicode calls so, and the ASCII separators.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"


def word_count(text: Column) -> Column:
    """The number of runs between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0))


def word_count_sql(text: str) -> str:
    return f"coalesce(len(list_filter(regexp_split_to_array({text},'{SPACE_SQL}'), lambda w: w <> '')),0)"
