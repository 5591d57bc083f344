"""Fill-in-the-middle: texts cut at two random units and put in another order, and put back again.

A unit ends where a predicate on two adjacent characters holds. Texts are cut into chunks that overlap by one character, so
that every pair of neighbours lies in just one chunk; boundaries are counted chunk by chunk, prefix sums of the counts send
each cut's rank to the chunk that owns it, and only that chunk is looked at again for the place. All of this happens beside the
text, in built-in functions: nothing is shuffled, and a row needs a few times its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units by (the character that ends one, the character that must follow).
UNITS = {"char": ("(?s:.)", "(?s:.)"), "word": (r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"), "line": (r"\n", "(?s:.)")}
#: Code points of a chunk. Smaller ones cost more calls, larger ones more marks in the two that are looked at again.
CHUNK = 256
#: Marks of prefix, suffix and middle. A text that holds one of them is never cut.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many stay plain, and of 100 others so many put the suffix first.
PLAIN, SPM = 10, 20
#: A private character that marks boundaries, and what stands in for it in texts that hold it.
_MARK, _STAND_IN = "\ue000", "\ue001"


def _numbers(seed: int, key: str) -> list[Column]:
    """Four numbers below 2^32 for each row: the first groups of eight digits of a hash of seed and key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _boundary(unit: str) -> str:
    """The pattern of a character that ends a unit."""
    left, right = UNITS[unit]
    return f"{left}(?={right})"


def _marked(window: Column, unit: str) -> Column:
    """A chunk with the next one's first character, a mark put in after each character that ends a unit."""
    return F.regexp_replace(F.replace(window, F.lit(_MARK), F.lit(_STAND_IN)), _boundary(unit), f"$0{_MARK}")


def cut(docs: DataFrame, ranks, unit: str = "char", chunk: int = CHUNK) -> DataFrame:
    """`docs` with `_n` (units of `text`) and `_cuts`: the places, in code points, after as many units as `ranks(_n)` say.

    `ranks` takes the column of n and gives a list of columns of numbers from 0 to n. Null texts count as empty: n is 0.
    """
    # the pattern takes whole code points, so each chunk but the last has exactly `chunk` of them
    d = docs.withColumn("_chunks", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s:.{{1,{chunk}}}+)"), F.lit(0)))
    following = F.concat(F.slice("_chunks", F.lit(2), F.greatest(F.size("_chunks") - 1, F.lit(0))), F.array(F.lit("")))
    d = d.withColumn("_windows", F.when(F.size("_chunks") > 0, F.zip_with("_chunks", following, lambda own, after: F.concat(own, F.left(after, F.lit(1))))).otherwise(F.array().cast("array<string>")))
    # one pass over the whole text: boundaries of each chunk, taken out in runs, as that costs far less than marks put in one by one
    d = d.withColumn("_counts", F.transform("_windows", lambda w: (F.length(w) - F.length(F.regexp_replace(w, f"(?:{_boundary(unit)})++", ""))).cast("long")))
    d = d.withColumn("_n", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x) + F.when(F.size("_windows") > 0, 1).otherwise(0))
    wanted = ranks(F.col("_n"))
    d = d.withColumns({f"_rank{i}": r for i, r in enumerate(wanted)})
    for i in range(len(wanted)):
        rank = F.col(f"_rank{i}")
        # prefix sums of the counts up to the chunk that owns the rank: (its number, boundaries before it)
        start = F.struct(rank.alias("rank"), F.lit(-1).cast("long").alias("own"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))

        def step(acc: Column, count: Column) -> Column:
            here = (acc["own"] < 0) & (acc["before"] + count >= acc["rank"])
            found = acc["own"] >= 0
            return F.struct(acc["rank"].alias("rank"), F.when(here, acc["at"]).otherwise(acc["own"]).alias("own"), (acc["at"] + 1).alias("at"), F.when(found | here, acc["before"]).otherwise(acc["before"] + count).alias("before"))

        d = d.withColumn(f"_owner{i}", F.aggregate("_counts", start, step))
        owner = F.col(f"_owner{i}")
        left = (rank - owner["before"]).cast("int")
        # a column of its own, so that a window that owns a cut is marked again once, and no other one is
        d = d.withColumn(f"_again{i}", F.when((rank > 0) & (rank < F.col("_n")), _marked(F.get("_windows", owner["own"].cast("int")), unit)))
        # the place of the mark numbered `left`, less the marks before it
        place = owner["own"] * chunk + F.length(F.expr(f"substring_index(_again{i}, '{_MARK}', cast(_rank{i} - _owner{i}.before as int))")) - (left - 1)
        d = d.withColumn(f"_cut{i}", F.when(rank <= 0, F.lit(0)).when(rank >= F.col("_n"), F.length(F.coalesce("text", F.lit("")))).otherwise(place).cast("long"))
    made = [c for i in range(len(wanted)) for c in (f"_rank{i}", f"_owner{i}", f"_again{i}", f"_cut{i}")]
    return d.withColumn("_cuts", F.array(*[f"_cut{i}" for i in range(len(wanted))])).drop("_chunks", "_windows", "_counts", *made)


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, marks: tuple[str, str, str] = MARKS, plain: int = PLAIN, spm: int = SPM, key: str = "doc_id") -> DataFrame:
    """`docs` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if plain) and output.

    psm is prefix, suffix, middle and spm suffix, prefix, middle, each part after its mark. The cuts and the form follow from a
    hash of seed and `key`, so equal keys are treated alike and a null key is a key like others. Null and empty texts and texts
    that hold a mark are plain; a null text's output is empty. Columns of these names are replaced, others stay.
    """
    h1, h2, h3, h4 = _numbers(seed, key)
    names = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    got = cut(docs.select(*names), lambda n: [F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))], unit)
    text, p, s, m = F.coalesce("text", F.lit("")), *map(F.lit, marks)
    stays = (F.col("_n") == 0) | (h3 % 100 >= 100 - plain)
    for mark in marks:
        stays = stays | text.contains(mark)
    form = F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    first, second = F.get("_cuts", F.lit(0)), F.get("_cuts", F.lit(1))
    got = got.withColumn("form", form).withColumn("prefix_chars", F.when(F.col("form") != "plain", first)).withColumn("middle_chars", F.when(F.col("form") != "plain", second - first))
    part = lambda start, length: F.substring(text, start.cast("int"), length.cast("int"))
    prefix, middle, suffix = part(F.lit(1), first), part(first + 1, second - first), part(second + 1, F.length(text))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    return got.select(*names, F.col("_n").alias("n"), "form", "prefix_chars", "middle_chars", output.alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again. Marks begin and end with characters that can't be joined to another one's, so an output is split at its own
    three and nowhere else. It is looked through once: the parts are bound to a name."""
    split = F.split(output, "|".join(f"\\Q{mark}\\E" for mark in marks), -1)
    back = F.transform(F.array(split), lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).otherwise(F.concat(x[2], x[3], x[1])))
    return F.when(form.isin("psm", "spm"), F.get(back, F.lit(0))).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
