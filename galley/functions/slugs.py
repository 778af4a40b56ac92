"""URL slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let

# Letters whose ASCII form is not their decomposition.
SPECIAL_LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D",
    "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H",
}


def _fold_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    source, target = [], []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha() and chr(code) not in SPECIAL_LETTERS:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def ascii_fold(text: Column) -> Column:
    folded = F.translate(text, *_fold_pairs())
    for letter, plain in SPECIAL_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(folded, r"\p{M}", "")


def _replace_pairs(text: Column, pairs: Column | Sequence[Sequence[str]] | None) -> Column:
    if pairs is None:
        return text
    if isinstance(pairs, Column):
        return F.aggregate(
            F.coalesce(pairs, F.array().cast("array<array<string>>")), text,
            lambda acc, p: F.replace(acc, p[0], p[1]),
        )
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def slugify(
    text: Column,
    separator: Column | str = "-",
    stopwords: Column | Iterable[str] = (),
    replacements: Column | Sequence[Sequence[str]] | None = None,
) -> Column:
    """Lower-case ASCII slug. Options may be literals or columns, so each site can bring its own."""
    plain = ascii_fold(F.regexp_replace(_replace_pairs(text, replacements), "'+", "-"))
    plain = F.regexp_replace(F.lower(plain), r"(?<=\d),(?=\d)", "")
    dashed = F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", "-"), F.lit("-"))
    if not isinstance(stopwords, Column):
        stopwords = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    stop = F.transform(F.coalesce(stopwords, F.array().cast("array<string>")), F.lower)
    kept = let(
        F.struct(dashed.alias("text"), stop.alias("stop")),
        lambda x: F.when(
            F.size(x["stop"]) > 0,
            F.array_join(F.filter(F.split(x["text"], "-"), lambda w: ~F.array_contains(x["stop"], w)), "-"),
        ).otherwise(x["text"]),
    )
    sep = separator if isinstance(separator, Column) else F.lit(separator)
    sep = F.when(F.coalesce(sep, F.lit("")) == "", F.lit("-")).otherwise(sep)
    return F.replace(_replace_pairs(kept, replacements), F.lit("-"), sep)
