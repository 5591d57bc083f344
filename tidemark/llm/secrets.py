"""Secret scan with DataFrame functions only: base patterns, and a battery of randomness tests on long tokens.

Places come from the text itself: every match is wrapped in a mark, the marked text is split, and running lengths of the
parts are code-point offsets. Tokens of 20 or more characters are then tested for looking random in their encoding (hex,
letters of one case, base 32, 36, 62 or 64): a chi-squared test of uniform characters, a runs test and a serial correlation
test. Tokens that these reject are out. What is left is held against written text: how uniform its letters are, and how often it
changes between kinds of character; the smaller of the two p-values is cut with a false discovery rate that is controlled
within classes of length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: The base patterns in the order of their kinds, and least lengths. Quotes are spelled \x22 and \x27.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Candidate tokens of the battery: runs of one of the usual alphabets.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Share of false discoveries that is accepted in each class of length.
FDR = 0.01
#: In written words one step in so many goes from one kind of character (digit, capital, small letter, other) to another.
WRITTEN_CHANGES = 0.05
#: Sum of squares of the letters' shares in written English; other languages that use them are less even.
WRITTEN_LETTERS = 0.0655
#: A token is taken for random if the combined tests don't reject that at this level.
LEAST_RANDOM = 0.001
#: Two private characters: one wraps matches; where a text holds it, the other stands in for it (neither is in a pattern).
_MARK, _STAND_IN = "\ue000", "\ue001"


_SPAN_LIST = "array<struct<s:long,e:long,o:int,kind:string,v:string>>"


def _spans(d: DataFrame, finders: dict[str, tuple]) -> DataFrame:
    """Adds for each kind of {kind: (order, pattern, gate, ok)} a column [(start, end, order, kind, match)] of the matches in `t`
    for which ok(match) holds, if the gate does. The gate must be a necessary condition; it is far cheaper than marking a text.

    Texts are split at their matches: gap, match, gap, ..., gap. Lengths are added up by a fold that keeps the running offset beside
    its result. As a fold copies its result at each match, parts are taken in runs of about the square root of their number, whose
    first offsets are added up beforehand. What is looked at more than once is a column of its own, or each would compute it again.
    """
    names = d.columns
    parts = {k: F.when(gate, F.split(F.regexp_replace("t", pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)) for k, (_, pattern, gate, _ok) in finders.items()}
    d = d.withColumns({f"_{k}_parts": x for k, x in parts.items()})
    # an even number, so that a run begins with a gap
    d = d.withColumns({f"_{k}_each": (2 * F.ceil(F.sqrt(F.size(f"_{k}_parts")) / 2)).cast("int") for k in finders})

    def runs(k: str) -> Column:
        each = F.col(f"_{k}_each")
        return F.when(each > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(f"_{k}_parts") / each).cast("int") - 1), lambda i: F.slice(f"_{k}_parts", i * each + 1, each)))

    def firsts(k: str) -> Column:
        total = F.transform(f"_{k}_runs", lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(total, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def spans(k: str, order: int, ok) -> Column:
        start = lambda at: F.struct(at.alias("at"), F.lit(False).alias("inside"), F.array().cast(_SPAN_LIST).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.length(x)
            one = F.array(F.struct(acc["at"].alias("s"), end.alias("e"), F.lit(order).alias("o"), F.lit(k).alias("kind"), x.alias("v")))
            return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"] & ok(x), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        found = F.transform(F.arrays_zip(F.col(f"_{k}_runs").alias("run"), F.col(f"_{k}_first").alias("first")), lambda x: F.aggregate(x["run"], start(x["first"]), step, lambda acc: acc["out"]))
        return F.coalesce(F.flatten(found), F.array().cast(_SPAN_LIST))

    d = d.withColumns({f"_{k}_runs": runs(k) for k in finders}).withColumns({f"_{k}_first": firsts(k) for k in finders})
    return d.select(*names, *[spans(k, order, ok).alias(k) for k, (order, _p, _g, ok) in finders.items()])


def base_spans(docs: DataFrame) -> DataFrame:
    """row_id and rest of `docs` with `base` (spans by start, then kind as listed) and `long_tokens` (candidates of the battery)."""
    text, t = F.coalesce("text", F.lit("")), F.col("t")
    d = docs.select("row_id", "rest", F.when(text.contains(_MARK), F.translate(text, _MARK, _STAND_IN)).otherwise(text).alias("t"))
    # runs of hexadecimal digits are maximal, so those of 16 and more are the matches that stay
    finders = {
        "assign": (0, ASSIGN, t.rlike(ASSIGN), lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= LEAST["assign"]),
        "access": (1, ACCESS, t.contains("AKIA"), lambda x: F.length(x) >= LEAST["access"]),
        "hex": (2, f"{HEX[:-1]}{{{LEAST['hex']},}}", t.rlike(f"{HEX[:-1]}{{{LEAST['hex']}}}"), lambda x: F.lit(True)),
        "random": (3, TOKEN, t.rlike(TOKEN), lambda x: F.lit(True)),
    }
    found = _spans(d, finders)
    return found.select("row_id", "rest", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.col("random").alias("long_tokens"))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 26.2.17; error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / 2.5066282746310002 * poly)


def chi_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    a = 2.0 / (9.0 * df)
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - a)) / F.sqrt(a)
    half = normal_tail(z) / 2
    return F.when(z > 0, half).otherwise(1 - half)


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to tokens (column v) their inferred encoding, the tests' p-values, p_random, p and its bin and length class.

    p_uniform, p_runs and p_serial test a uniform random string of the encoding; p_random is their Fisher combination.
    p is that of written text, whose false discoveries are controlled: twice the smaller of the chance that a written word changes
    between kinds of characters as often as this one (runs), and that its letters are as uniform (chi-squared: below its value for
    the letters of English, which has a non-central distribution). It is 1 for tokens that the battery rejects.
    """
    v, n = F.col("v"), F.col("n")
    encoding = F.when(v.rlike("^[0-9a-f]+$") | v.rlike("^[0-9A-F]+$"), "hex").when(v.rlike("^[a-z]+$") | v.rlike("^[A-Z]+$"), "letters").when(v.rlike("^[A-Z2-7]+=*$"), "base32").when(v.rlike("^[a-z0-9]+$") | v.rlike("^[A-Z0-9]+$"), "base36").when(v.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    by_encoding = lambda *x: F.element_at(F.create_map(*[F.lit(y) for pair in zip(("hex", "letters", "base32", "base36", "base62", "base64"), x) for y in pair]), F.col("encoding"))
    t = tokens.withColumn("encoding", encoding).withColumn("n", F.length("v").cast("double")).withColumn("chars", F.split("v", "")).withColumn("c", F.transform("chars", lambda x: F.ascii(x).cast("double")))
    t = t.withColumn("size", by_encoding(16.0, 26.0, 32.0, 36.0, 62.0, 64.0))
    total = lambda column, f: F.aggregate(column, F.lit(0.0), lambda a, x: a + f(x))
    counts = F.transform(F.array_distinct("c"), lambda x: F.size(F.filter("c", lambda y: y == x)).cast("double"))
    chi = total(counts, lambda k: k * k) * F.col("size") / n - n
    # no lambda looks at another column: Catalyst may put that column's expression in its place, once for each element
    t = t.withColumn("sum", total("c", lambda x: x)).withColumn("squares", total("c", lambda x: x * x))
    # letters of one case have one kind: their runs are those in the first and the second half of the alphabet
    half = F.col("encoding") == "letters"
    kind = lambda x: F.when(x.between(48, 57), 0).when(x.between(97, 122), 1).when(x.between(65, 90), 2).otherwise(3)
    t = t.withColumn("k", F.when(half, F.transform("c", lambda x: F.when((x % 32) < 14, 4).otherwise(5))).otherwise(F.transform("c", kind)))
    neighbours = lambda column: F.arrays_zip(F.slice(column, F.lit(1), F.size(column) - 1).alias("a"), F.slice(column, F.lit(2), F.size(column) - 1).alias("b"))
    mean, ends = F.col("sum") / n, F.element_at("c", 1) + F.element_at("c", -1)
    serial = (total(neighbours("c"), lambda p: p["a"] * p["b"]) - mean * (2 * F.col("sum") - ends) + (n - 1) * mean * mean) / F.nullif(F.col("squares") - n * mean * mean, F.lit(0.0))
    changes = total(neighbours("k"), lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0))
    t = t.withColumn("serial", F.coalesce(serial, F.lit(1.0))).withColumn("changes", changes).withColumn("chi", chi)
    # chance that two random characters differ in kind: one letter case for the first four encodings, two for the others
    digit = by_encoding(10 / 16, 0.5, 6 / 32, 10 / 36, 10 / 62, 10 / 64)
    letter = F.when(F.col("encoding").isin("base62", "base64"), (1 - digit) / 2).otherwise(1 - digit)
    two = 1 - digit * digit - letter * letter * F.when(F.col("encoding").isin("base62", "base64"), 2).otherwise(1)
    steps = n - 1
    above = lambda rate: (F.col("changes") - steps * rate) / F.sqrt(steps * rate * (1 - rate))
    t = t.withColumn("p_uniform", chi_tail(F.col("chi"), F.col("size") - 1)).withColumn("p_runs", normal_tail(above(two))).withColumn("p_serial", normal_tail(F.col("serial") * F.sqrt("n")))
    fisher = -2 * sum(F.ln(F.greatest(F.col(p), F.lit(1e-300))) for p in ("p_uniform", "p_runs", "p_serial"))
    z = above(F.lit(WRITTEN_CHANGES))
    # letters, whatever their case: chi-squared of 26, of which written ones have more than random ones
    t = t.withColumn("letters", F.regexp_replace(F.lower("v"), "[^a-z]", "")).withColumn("nl", F.length("letters").cast("double"))
    # a sum over counts as a fold, not 26 terms: those would be put in wherever the sum is used, beyond what compiles
    t = t.withColumn("lc", F.filter(F.split("letters", ""), lambda x: x != ""))
    t = t.withColumn("even", total(F.transform(F.array_distinct("lc"), lambda x: F.size(F.filter("lc", lambda y: y == x)).cast("double")), lambda k: k * k))
    nl, more = F.col("nl"), F.col("nl") * (26 * WRITTEN_LETTERS - 1)
    even = (F.col("even") * 26.0 / F.nullif(nl, F.lit(0.0)) - nl - 25 - more) / F.sqrt(2 * (25 + 2 * more))
    uniform = F.when((even < 0) & (nl >= 20), normal_tail(even) / 2).otherwise(F.lit(1.0))
    changing = F.when((z > 0) & ~half, normal_tail(z) / 2).otherwise(F.lit(1.0))
    written = F.least(F.lit(1.0), 2 * F.least(changing, uniform))
    t = t.withColumn("p_random", chi_tail(fisher, F.lit(6.0))).withColumn("p", F.when(F.col("p_random") >= LEAST_RANDOM, written).otherwise(F.lit(1.0)))
    t = t.withColumn("length_class", F.floor(F.log2("n")).cast("int")).withColumn("bin", F.floor(F.least(-10 * F.log10(F.greatest("p", F.lit(1e-40))), F.lit(400.0))).cast("int"))
    return t.drop("chars", "c", "k", "sum", "squares", "size", "chi", "letters", "nl", "lc", "even")


def discoveries(tokens: DataFrame, rate: float = FDR) -> DataFrame:
    """(length_class, cut): within a class, tokens whose bin of -10 log10 p reaches `cut` are discoveries.

    Benjamini-Hochberg on the histogram of bins within classes of length that double. Only the histogram (classes times 401
    bins) is ranked, so its size doesn't follow the corpus, and the rule is exact up to a bin, on the safe side.
    """
    h = tokens.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    h = h.withColumn("found", F.sum("n").over(down)).withColumn("all", F.sum("n").over(Window.partitionBy("length_class")))
    return h.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= rate * F.col("found") / F.col("all")).groupBy("length_class").agg(F.min("bin").alias("cut"))


def _clear(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Tokens (row_id, x) that overlap no base span of their row.

    Both are rows by their start, so each token is held against the farthest end before it and the nearest start after it. A
    token never carries the spans of its text, which would be quadratic in their number.
    """
    at = lambda x, token: F.struct(x["s"].alias("s"), F.lit(token).alias("token"), x["e"].alias("e"))
    base = rows.select("row_id", F.explode("base").alias("x")).select("row_id", at(F.col("x"), False).alias("at"), F.lit(None).cast(tokens.schema["x"].dataType).alias("x"))
    both = base.join(tokens.select("row_id").distinct(), "row_id", "left_semi").unionByName(tokens.select("row_id", at(F.col("x"), True).alias("at"), "x"))
    # running values in both directions: a frame that ends with the partition is computed anew for each row
    up, down = (Window.partitionBy("row_id").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("at"), F.desc("at")))
    span = lambda c: F.when(~F.col("at.token"), F.col(f"at.{c}"))
    near = both.withColumns({"_end": F.max(span("e")).over(up), "_start": F.min(span("s")).over(down)}).where("at.token")
    return near.where((F.coalesce("_end", F.col("at.s")) <= F.col("at.s")) & (F.coalesce("_start", F.col("at.e")) >= F.col("at.e"))).select("row_id", "x")


def scan(docs: DataFrame, rate: float = FDR) -> DataFrame:
    """`docs` without `text`, with `base` (spans of the base patterns) and `found` (those of the battery too), both by start, then
    kind; these replace columns of such names.

    Each text is scanned once and the spans, without the text, are written to the shared folder; the battery then judges
    every long token against the histogram of all, of which one row for each class of length is broadcast. Tokens that
    overlap a base span add nothing. Null and empty texts have no spans; repeated rows and doc_ids are judged each.
    """
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "base", "found")])
    rows = materialise(base_spans(docs.select(F.monotonically_increasing_id().alias("row_id"), rest.alias("rest"), "text")), "spans")
    tokens = materialise(battery(rows.select("row_id", F.explode("long_tokens").alias("x")).select("row_id", "x", "x.v")), "tokens")
    cuts = F.broadcast(discoveries(tokens, rate))
    found = tokens.join(cuts, "length_class").where(F.col("bin") >= F.col("cut")).select("row_id", "x")
    added = _clear(found, rows).groupBy("row_id").agg(F.collect_list("x").alias("added"))
    got = rows.join(added, "row_id", "left")
    return got.select("rest.*", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN_LIST)))).alias("found"))


def join_spans(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(join_spans("base"), 256).alias("base_sha256"), join_spans("found").alias("spans"))


def redact(docs: DataFrame, rate: float = FDR, mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret in `text` replaced by a mark, other columns as they are but n_chars, where there is one.

    Only texts that change are joined back, by doc_id and a hash of the text, so equal rows change alike. Null texts stay.
    """
    key = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64("text", F.lit(1)).alias("_k2")]
    own = docs.select("doc_id", "text", *key)
    found = scan(own, rate).where(F.size("found") > 0).groupBy("_k1", "_k2").agg(F.min("found").alias("_found"))
    names = docs.columns
    got = docs.select("*", *key).join(found, ["_k1", "_k2"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        apart = F.struct(x["e"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        overlap = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], apart).otherwise(overlap)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    changed = F.when(F.col("_found").isNotNull(), F.aggregate("_found", start, step, rest)).otherwise(F.col("text"))
    got = got.withColumn("text", changed)
    if "n_chars" in names:
        got = got.withColumn("n_chars", F.when(F.col("_found").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.select(*names)
