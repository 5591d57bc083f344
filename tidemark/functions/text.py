"""Text functions, of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edition words, and words that tell versions of a title apart.
EDITIONS = "deluxe|remaster(ed)?|expanded|bonus track|anniversary|special"
MODIFIERS = ("live", "remix", "acoustic", "cover", "remaster", "demo", "instrumental")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def album_key(artist: str | Column, album: str | Column) -> Column:
    """Key that editions of an album share. Nulls count as empty."""
    both = F.lower(F.concat(F.trim(F.coalesce(_c(artist), F.lit(""))), F.lit("|"), F.trim(F.coalesce(_c(album), F.lit("")))))
    return squeeze(F.regexp_replace(both, rf"(?i)\s*[\(\[]({EDITIONS})[^\)\]]*[\)\]]\s*", " "))


def modifiers(x: str | Column) -> Column:
    """The version words in a title, in the order of the list."""
    low = F.lower(_c(x))
    return F.array_compact(F.array(*[F.when(low.rlike(rf"\b{m}\w*\b"), F.lit(m)) for m in MODIFIERS]))


def clean_title(x: str | Column) -> Column:
    """A title without brackets, version words and punctuation."""
    t = F.regexp_replace(F.lower(_c(x)), r"\b(feat|ft)\b\.?", " ")
    t = F.regexp_replace(t, r"[\(\[][^\)\]]*[\)\]]", " ")
    t = F.regexp_replace(t, rf"\b({'|'.join(MODIFIERS)})\w*\b", " ")
    return squeeze(F.regexp_replace(t, "[^a-z0-9 ]", " "))


def split_query(x: str | Column) -> tuple[Column, Column]:
    """(artist, title) of "Artist - Title"; without a dash there is no artist."""
    t = _c(x)
    at = F.instr(t, " - ")
    return F.when(at > 0, F.trim(F.substring(t, F.lit(1), at - 1))).otherwise(""), F.when(at > 0, F.trim(F.substring(t, at + 3, F.length(t)))).otherwise(F.trim(t))


def fold_suffix(x: str | Column) -> Column:
    """ "A - B" as "A (B)"."""
    return F.regexp_replace(_c(x), r"^(.*?) - (.*)$", "$1 ($2)")


def base_title(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.split(F.lower(_c(x)), " - ")[0], r"\([^)]*\)", ""))


def slug(x: str | Column, most: int = 40) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def cell(x: str | Column, whole: bool = False) -> Column:
    """A number as a table shows it: thousands apart, at most three decimals and no zeros at their end; nulls are empty."""
    shown = F.format_number(_c(x), 0) if whole else F.regexp_replace(F.format_number(_c(x), 3), r"\.?0+$", "")
    return F.coalesce(shown, F.lit(""))


def noise(key: str | Column, n: int) -> Column:
    """n numbers that look normally distributed and follow from the key alone: two hashes each, by Box and Muller."""

    def share(i: Column, which: str) -> Column:
        h = F.md5(F.concat_ws("/", _c(key).cast("string"), i.cast("string"), F.lit(which)))
        return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") + 1) / F.lit(2.0**32 + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sqrt(-2 * F.ln(share(i, "r"))) * F.cos(2 * F.pi() * share(i, "a")))


def config_hash(config: str | Column) -> Column:
    """Eight characters for a configuration said as JSON with ordered keys."""
    return F.substring(F.sha2(_c(config), 256), 1, 8)


def clock_label(hour: str | Column) -> Column:
    h = _c(hour)
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))
