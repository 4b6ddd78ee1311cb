"""Quality rules, line first: rules judge every line, failing lines go, and documents that lose too much text are rejected.

Everything is built from DataFrame functions; nothing is exploded, joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, positional

SYMBOLS = "#*$%&|<>"
#: Line rules. A line's share is counted over its characters without white space, in hundredths.
MAX_SYMBOLS, MIN_BARS, MAX_CAPITALS, MIN_LONG_LINE = 5, 3, 60, 40
#: Marks between the entries of a navigation line.
BARS = "|»›•·"
#: Phrases that mark a line as boilerplate, compared without case: English, German, French, Spanish.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to", "enable javascript", "javascript is disabled",
    "log in to continue", "privacy policy", "sign up for our newsletter", "skip to content", "terms of service", "we use cookies",
    "alle cookies akzeptieren", "alle rechte vorbehalten", "bitte aktivieren sie javascript", "datenschutzerklärung", "nach oben scrollen", "newsletter abonnieren", "wir verwenden cookies", "zum inhalt springen",
    "accepter tous les cookies", "aller au contenu", "conditions d'utilisation", "inscrivez-vous à notre newsletter", "nous utilisons des cookies", "politique de confidentialité", "retour en haut", "tous droits réservés",
    "aceptar todas las cookies", "ir al contenido", "política de privacidad", "suscríbete a nuestro boletín", "términos de servicio", "todos los derechos reservados", "utilizamos cookies", "volver arriba",
)
#: A document goes if its lines that fail hold more than so many hundredths of its text.
MAX_LOST = 30


def _without(s: Column, chars: str) -> Column:
    """s without the given characters; one pass over the bytes per character, which is much faster than translate()."""
    for c in chars:
        s = F.replace(s, F.lit(c), F.lit(""))
    return s


def _bare(s: Column) -> Column:
    """Code points outside white space."""
    return F.char_length(_without(s, WS_CHARS))


def _has_word(s: Column) -> Column:
    return s.rlike(r"[^\x20\x09-\x0D]")


def _phrase(s: Column) -> Column:
    s, found = F.lower(s), F.lit(False)
    for p in BOILERPLATE:
        found = found | s.contains(p)
    return found


def _has_bars(s: Column) -> Column:
    found = F.lit(False)
    for c in BARS:
        found = found | s.contains(c)
    return found


def line_fails(line: Column, symbols_in_text: Column | None = None, bars_in_text: Column | None = None, phrase_in_text: Column | None = None) -> Column:
    """Whether a line with words is dropped.

    Punctuation: symbols above 5 % of the line, or a line of 40 characters or more in which no mark ends a sentence or
    clause, or at least three exclamation marks where over 60 % are capitals. Navigation: three or more marks that stand
    between entries. Boilerplate: one of the fixed phrases. The optional columns say what the whole text holds, which
    spares lines the tests that cannot succeed.
    """
    bare = _bare(line)
    symbols = (F.char_length(line) - F.char_length(_without(line, SYMBOLS))) * 100 > bare * MAX_SYMBOLS
    bars = line.rlike("(?s)" + f"[{BARS}].*?" * MIN_BARS)
    phrase = _phrase(line)
    if symbols_in_text is not None:
        symbols, bars, phrase = (symbols_in_text > 0) & symbols, bars_in_text & bars, phrase_in_text & phrase
    capitals = F.char_length(line) - F.char_length(F.regexp_replace(line, r"\p{Lu}", ""))
    unmarked = ~line.rlike("[.,;:!?…。！？]") & (bare >= MIN_LONG_LINE)
    shouts = line.rlike(r"(?s)!.*?!.*?!") & (capitals * 100 > bare * MAX_CAPITALS)
    return symbols | bars | unmarked | shouts | phrase


def measure(df: DataFrame, text: str) -> DataFrame:
    """The rows of df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars (all long)
    and clean, the text without the lines that fail.

    Columns of df must not begin with two underscores.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Each array is a column of its own and is named twice where it is used: folded into a lambda it would be rebuilt
    # for every element.
    df = df.withColumn("__words", F.array_remove(F.split(whole, f"{WS}+"), "")).withColumn("__all", F.split(whole, "\n"))
    df = df.withColumn("__lines", F.filter("__all", _has_word)).withColumn("__bars", _has_bars(whole))
    df = df.withColumn("__n", F.size("__words")).withColumn("__phrase", _phrase(whole))
    df = df.withColumn("__symbols", F.char_length(whole) - F.char_length(_without(whole, SYMBOLS)))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("__n") - 3),
        lambda k: F.xxhash64(F.get("__words", k), F.get("__words", k + 1), F.get("__words", k + 2)),
    )
    df = df.withColumn("__windows", F.when(F.col("__n") >= 3, windows))
    repeats = F.size(F.array_distinct("__windows")) < F.col("__n") - 2
    placed = F.sort_array(F.transform("__windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    df = df.withColumn("__placed", F.when(repeats, placed))
    again = F.filter("__placed", lambda x, k: (x.h == F.get("__placed", k - 1).h) | (x.h == F.get("__placed", k + 1).h))
    # Places of the windows found again, in order; each covers three words, less where the next begins before its end.
    df = df.withColumn("__at", F.sort_array(F.transform(again, lambda x: x.k)))
    covered = F.aggregate(
        F.zip_with("__at", F.slice("__at", F.lit(2), F.size("__at")), lambda a, b: F.least(F.lit(3), b - a)),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    df = df.withColumn("__fails", F.transform("__all", lambda x: _has_word(x) & line_fails(x, F.col("__symbols"), F.col("__bars"), F.col("__phrase"))))
    failed = F.size(F.filter("__fails", lambda x: x)).cast("long")
    lost = F.when(F.array_contains("__fails", True), F.filter("__all", lambda x, k: F.get("__fails", k))).otherwise(F.array())
    clean = F.array_join(F.filter("__all", lambda x, k: ~F.get("__fails", k)), "\n")
    return df.select(
        *(c for c in df.columns if not c.startswith("__")),
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.size("__at") > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        failed.alias("n_failed_lines"),
        _bare(F.array_join(lost, "")).cast("long").alias("lost_chars"),
        F.when(F.array_contains("__fails", True), clean).otherwise(whole).alias("clean"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _kept() -> Column:
    return ~_base_failed() & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measures, base_failed, kept, n_failed_lines, lost_chars and clean_md5 (of the text without its failing lines)
    for every row.

    Defined cases: a null or empty text, or one of white space only, has no words, fails the base rules and is not
    kept; texts are read whole; repeated rows are each judged; an empty table gives no rows; other columns are ignored
    whatever their names. A symbol is counted wherever it stands; a line counts as doubled if it equals an earlier one
    byte for byte; lines without words stay.
    """
    cells = measure(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return cells.select(F.col("id").alias(id_col), *measures, _base_failed().alias("base_failed"), _kept().alias("kept"), "n_failed_lines", "lost_chars", F.md5("clean").alias("clean_md5"))


def kept(df: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The rows of df whose text is kept, their failing lines removed; a column of that name counts the new text's characters.

    Rows whose lines all pass are unchanged. Other columns stay whatever their names; the cases are those of quality().
    """
    names = df.columns
    place, count = names.index(text_col), names.index(count_col) if count_col in names else None
    cells = measure(positional(df), f"c{place}")
    touched = F.col("n_failed_lines") > 0
    own = [F.col(f"c{k}") for k in range(len(names))]
    own[place] = F.when(touched, F.col("clean")).otherwise(own[place])
    if count is not None:
        own[count] = F.when(touched, F.char_length("clean").cast(df.schema[count].dataType)).otherwise(own[count])
    row = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(own)))
    # Not a filter: that would be pushed below the measures, with all of them written out in it again and again.
    return cells.select(F.inline(F.when(_kept(), F.array(row)))).toDF(*names)
