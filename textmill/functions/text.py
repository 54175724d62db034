"""Cleaning, normalising and tokenising text, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What strip() removes from ASCII text.
BLANKS = " \t\n\r\x0b\x0c"
# Patterns of the ingest cleaner.
INGEST_EMAIL, INGEST_PHONE = r"\S+@\S+", r"\+?\d[\d -]{8,12}\d"
# Patterns of personal data, in the order in which they are removed.
PERSONAL = [
    r"\S+@\S+\.\S+",
    r"(\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}",
    r"https?://\S+|www\.\S+",
    r"(?i)linkedin\.com/\S+",
    r"(?i)github\.com/\S+",
]
# Bullets at the start of a line; characters that stay.
BULLET = r"(?m)^[\s]*[•●○▪▸►◆★✦✓✔→\-\*]\s*"
SPECIAL = r"[^\w\s\.\,\;\:\-\+\#\(\)\/\&]"
DASHES = "‐‑‒–—―−"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column, email: str = "", phone: str = "") -> Column:
    """Batch ingest: e-mail addresses and phone numbers go (or become the given marks), runs of line feeds are one."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), INGEST_EMAIL, email)
    out = F.regexp_replace(out, INGEST_PHONE, phone)
    return strip(F.regexp_replace(out, r"\n+", "\n"))


def mask_personal(text: Column) -> Column:
    """Upload variant: marks instead of removal; at most one blank line in a row."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), INGEST_EMAIL, "[email]")
    out = F.regexp_replace(out, INGEST_PHONE, "[phone]")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def remove_personal(text: Column) -> Column:
    out = text
    for pattern in PERSONAL:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(""))
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it, in branches too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folds() -> tuple[str, str, str, list[str]]:
    """Characters outside ASCII whose compatibility decomposition has ASCII characters: those with one, and that one;
    those with several, and these."""
    one, target, several, targets = [], [], [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            one.append(chr(code))
            target.append(kept)
        elif kept:
            several.append(chr(code))
            targets.append(kept)
    return "".join(one), "".join(target), "".join(several), targets


FOLD_FROM, FOLD_TO, FOLD_SEVERAL, FOLD_STRINGS = _folds()


def fold_ascii(text: Column) -> Column:
    """The ASCII characters of the text's compatibility decomposition (NFKD), in the JVM: marked letters become plain
    ones, ligatures, fractions, full-width and enclosed characters what they are made of, all else outside ASCII goes.

    Texts in ASCII pass as they are. Every test is a lookup by character or a comparison of lengths, none a class of
    characters; only texts with a character of several are taken apart."""
    def several(t: Column) -> Column:
        strings = F.array(*map(F.lit, FOLD_STRINGS))

        def expand(c: Column) -> Column:
            at = F.instr(F.lit(FOLD_SEVERAL), c)
            return F.when((c > "\x7f") & (at > 0), F.get(strings, at - 1)).otherwise(c)

        taken = F.array_join(F.transform(F.split(t, ""), expand), "")
        return F.when(F.translate(t, FOLD_SEVERAL, "") != t, taken).otherwise(t)

    def plain(t: Column) -> Column:
        return F.octet_length(t) == F.char_length(t)

    def left_over(t: Column) -> Column:
        return F.when(plain(t), t).otherwise(F.regexp_replace(t, r"[^\x00-\x7F]+", ""))

    folded = let(text, lambda t: F.when(plain(t), t).otherwise(F.translate(several(t), FOLD_FROM, FOLD_TO)))
    return let(folded, left_over)


def fold_ascii_exact():
    """The full decomposition, by Arrow batches."""
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    return fold


def normalize_bullets(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(BULLET), F.lit("- "))


def clean_whitespace(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(out, "\n", -1), strip), "\n")


def normalize_text(text: Column, remove_personal_info: bool = True, lowercase: bool = False, bullets_first: bool = True, lemmatize=None, fold=fold_ascii) -> Column:
    """The whole chain; null is ''. bullets_first keeps bullets and dashes that folding would delete before they are
    seen; False gives the literal order. lemmatize is a function of a Column, fold likewise."""
    out = F.coalesce(text, F.lit(""))
    if bullets_first:
        out = F.translate(normalize_bullets(out), DASHES, "-" * len(DASHES))
    out = fold(out)
    if remove_personal_info:
        out = remove_personal(out)
    out = F.regexp_replace(normalize_bullets(out), F.lit(SPECIAL), F.lit(" "))
    out = clean_whitespace(out)
    if lemmatize is not None:
        out = lemmatize(out)
    return strip(F.lower(out) if lowercase else out)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscores. No word boundaries: engines disagree about them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))


def keywords(text: Column, stop_words: list[str] | None = None) -> Column:
    """Distinct words of three characters or more, without stop words."""
    found = F.array_distinct(tokens(text, 3))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def lemmatizer(model: str = "en_core_web_sm"):
    """A function of a Column: lower-cased lemmas without stop words, punctuation and blanks, if the optional library
    spaCy and its model are there; the text itself if not. The model is loaded once a task."""
    try:
        import spacy

        spacy.load(model)
    except (ImportError, OSError):
        return lambda text: text

    @F.pandas_udf("string")
    def lemmas(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = spacy.load(model)
        for texts in parts:
            yield pd.Series([" ".join(t.lemma_.lower() for t in doc if not (t.is_stop or t.is_punct or t.is_space)) for doc in run.pipe(texts.fillna(""))], index=texts.index)

    return lemmas
