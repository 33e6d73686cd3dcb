"""Secret scan: base patterns plus a randomness test battery (operator 7). DataFrame functions only.

Base spans come from three fixed patterns. Every other long run of
encoded-looking characters gets an inferred encoding and tests of the
hypothesis that its characters are uniform random draws: chi-squared over the
alphabet and over its classes (lower case, upper case, the rest), runs above
and below the middle, and lag-one serial correlation. The Bonferroni-combined
p-value is a score: random strings spread evenly over it, names made of words
lie near zero.

What is reported is controlled, not what is thrown away. The null hypothesis
is that a run is a name made of words and numbers; made names of many styles
and lengths give the score's distribution under it. Within strata
of encoding and length class, Benjamini-Hochberg at rate ``q`` picks the runs
that look more random than names do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.llm.common import store

# fixed values: the base patterns and their least lengths
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"          # a whole run of [0-9a-f] that has 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# (name, pattern a token must have wholly, alphabet); the first that fits holds
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", DIGITS + UPPER + LOWER + "-_"),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("digits", r"^[0-9]+$", DIGITS),
)
# fixed values: words that names in programs are made of
NAME_WORDS = """get set is on to by id user name file path index count value key list item node size start end time date
 type code data base test page form text line word field table row column cache server client request response handler
 manager service factory builder config option default parent child total update create delete insert select order
 price number group member message error status result source target buffer stream thread""".split()
DECOYS = 512                    # made names per style, ending and length class; they fix the null distribution
LONGEST_CLASS = 6               # runs of 64 and more characters are one class
SCAN = 32                       # values per block of a running combination
# fixed values: polynomial of the normal tail, Abramowitz and Stegun 26.2.17
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_SCALE = 0.2316419
BINS = 100                      # per decade of p


def bind(value: Column, use) -> Column:
    """``use(x)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, combine, levels: int = 3) -> Column:
    """Inclusive running combination of an array of non-negative ints (0 is neutral).

    Blocks of SCAN values are run one by one and shifted by the running
    totals of the blocks before, found the same way: linear in the array,
    where one growing array would be copied per value.
    """
    def plain(v):
        return F.aggregate(v, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(
            combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x).cast("int"))))

    if not levels:
        return plain(values)

    def shifted(blocks):
        totals = F.transform(blocks, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0)))
        return bind(running(totals, combine, levels - 1), lambda t: F.flatten(F.transform(
            blocks, lambda x, i: F.transform(x, lambda y: combine(F.coalesce(F.get(t, i - 1), F.lit(0)), y)))))

    return bind(values, lambda v: bind(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(SCAN)),
        lambda i: plain(F.slice(v, i + 1, F.lit(SCAN)))), shifted))


def match_spans(text: Column, pattern: str, extra: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array of (start, end, hit, extra), in code points.

    ``extra`` names a group whose text is kept too. Ends follow from the
    running lengths of the matches and of the pieces between them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.struct(hits.alias("hits"), F.regexp_extract_all(
        text, F.lit(pattern), F.lit(0 if extra is None else extra)).alias("extra"),
        F.split(text, pattern, -1).alias("pieces"))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,extra:string>>")

    def walk(r):
        lengths = F.transform(r["hits"], lambda h, i: F.length(F.get(r["pieces"], i)) + F.length(h))
        return bind(running(lengths, lambda x, y: x + y), lambda ends: F.transform(r["hits"], lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit"),
            F.get(r["extra"], i).alias("extra"))))

    return F.when(text.rlike(pattern), bind(rows, walk)).otherwise(empty)


def outside(tokens: Column, base: Column) -> Column:
    """The tokens that lie in no span of ``base``: none that starts before reaches their end."""
    def event(of, s, i):
        return F.struct(s["start"].alias("start"), F.lit(of).alias("of"), s["end"].alias("end"), i.alias("i"))

    events = F.array_sort(F.concat(F.transform(base, lambda s, i: event(0, s, i)),
                                   F.transform(tokens, lambda s, i: event(1, s, i))))

    def judge(e):
        reach = running(F.transform(e, lambda x: F.when(x["of"] == 0, x["end"]).otherwise(0)), F.greatest)
        free = bind(reach, lambda r: F.filter(e, lambda x, i: (x["of"] == 1) & (F.get(r, i) < x["end"])))
        return F.transform(free, lambda x: F.get(tokens, x["i"]))

    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), bind(events, judge)).otherwise(tokens)


def normal_tail(z: Column) -> Column:
    """P(N > |z|), one-sided."""
    def poly(a):
        t = 1 / (1 + TAIL_SCALE * a)
        s = F.lit(0.0)
        for b in reversed(TAIL):
            s = (s + b) * t
        return F.exp(-a * a / 2) / 2.5066282746310002 * s
    return bind(F.abs(z), poly)


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern, _ in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _alphabet(encoding: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, letters in ENCODINGS:
        out = F.when(encoding == name, F.lit(letters)).otherwise(out)
    return out


def chi_squared_p(chi: Column, df: Column) -> Column:
    """Upper tail of a chi-squared statistic by its cube root; 1 without degrees of freedom."""
    spread = 2 / (9 * df)
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread)
    return F.when(df > 0, bind(z, lambda x: F.when(x > 0, normal_tail(x)).otherwise(1.0))).otherwise(1.0)


def randomness_p(token: Column, alphabet: Column) -> Column:
    """Combined p-value of the battery: small if ``token`` is not uniform over ``alphabet``."""
    def class_counts(s):
        """Characters of lower case, of upper case, and the rest."""
        lower, rest = F.length(F.translate(s, LOWER, "")), F.length(F.translate(s, UPPER + LOWER, ""))
        return F.array(F.length(s) - lower, lower - rest, rest)

    def battery(v):
        t, letters, n, k = v["t"], v["a"], v["n"], v["k"]
        squares = F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0.0), lambda acc, i: acc + F.pow(
            n - F.length(F.replace(t, F.substring(letters, i, F.lit(1)), F.lit(""))), 2))
        # classes of the alphabet: few characters say more about them than about single letters
        classes = F.filter(F.arrays_zip(v["seen"].alias("seen"), v["of"].alias("of")), lambda c: c["of"] > 0)
        pooled = bind(classes, lambda c: chi_squared_p(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.pow(
            x["seen"] - n * x["of"] / k, 2) / (n * x["of"] / k)), F.size(c).cast("double") - 1))
        codes = F.transform(F.split(t, ""), lambda c: F.instr(letters, c).cast("double") - 1)

        def series(c):
            mean = F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / n
            high = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.when(x >= k / 2, 1.0).otherwise(0.0))
            pairs = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.struct(
                x.alias("x"), y.alias("y")))

            def of_pairs(d):
                p, m, h = d["pairs"], d["mean"], d["high"]
                var = F.aggregate(c, F.lit(0.0), lambda s, x: s + F.pow(x - m, 2))
                cov = F.aggregate(p, F.lit(0.0), lambda s, x: s + (x["x"] - m) * (x["y"] - m))
                serial = bind(var, lambda x: F.when(x > 0, 2 * normal_tail(cov / x * F.sqrt(n))).otherwise(0.0))
                runs = F.aggregate(p, F.lit(1.0), lambda s, x: s + F.when(
                    (x["x"] >= k / 2) != (x["y"] >= k / 2), 1.0).otherwise(0.0))
                mu = 1 + 2 * h * (n - h) / n
                by_runs = bind((mu - 1) * (mu - 2) / (n - 1), lambda x: F.when(
                    x > 0, 2 * normal_tail((runs - mu) / F.sqrt(x))).otherwise(0.0))
                return F.least(serial, by_runs)

            return bind(F.struct(pairs.alias("pairs"), mean.alias("mean"), high.alias("high")), of_pairs)

        return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), 4 * F.least(
            chi_squared_p(k / n * squares - n, k - 1), pooled, bind(codes, series))))

    return bind(F.struct(token.alias("t"), alphabet.alias("a"), F.length(token).cast("double").alias("n"),
                         F.length(alphabet).cast("double").alias("k"), class_counts(token).alias("seen"),
                         class_counts(alphabet).alias("of")), battery)


def made_names(spark: SparkSession, seed: int = 1) -> DataFrame:
    """(token): DECOYS names of words and numbers per style, ending and length class, the same in every run."""
    pick = lambda n, *by: F.pmod(F.xxhash64(F.lit(seed), "id", *by), F.lit(n)).cast("int")
    vocabulary = F.array(*map(F.lit, NAME_WORDS))
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))
    # by style: what a word becomes, given its number in the name
    styles = (
        lambda w, i: w,
        lambda w, i: F.upper(w),
        lambda w, i: F.when(i == 0, w).otherwise(title(w)),
        lambda w, i: F.concat(title(w), F.when(pick(2, F.lit(3), i) == 0, "_").otherwise("")),
        lambda w, i: F.concat(title(w), F.lit("-")),
        lambda w, i: F.concat(title(w), F.when(pick(3, F.lit(4), i) == 0, "/").otherwise("")),
        # numbers as names have them: years, and dates written together
        lambda w, i: F.concat(F.regexp_replace(w, "[^a-f]", ""), (2000 + pick(26, F.lit(5), i)).cast("string")),
        lambda w, i: (20000101 + pick(26, F.lit(6), i) * 10000 + pick(12, F.lit(7), i) * 100
                      + pick(28, F.lit(8), i)).cast("string"),
    )
    classes = list(range(4, LONGEST_CLASS + 1))
    made = spark.range(DECOYS * len(styles) * 3 * len(classes))
    style = F.pmod("id", F.lit(len(styles)))
    nth = F.floor(F.col("id") / len(styles))
    ending = F.pmod(nth, F.lit(3))          # no number, a number, a number without 0, 1, 8 and 9
    least = F.element_at(F.array(*[F.lit(max(20, 1 << c)) for c in classes]),
                         (F.pmod(F.floor(nth / 3), F.lit(len(classes))) + 1).cast("int"))
    size = least + F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(1)), F.greatest(F.lit(12), F.when(
        least > 20, least).otherwise(F.lit(12))))
    number = pick(10 ** 4, F.lit(2)).cast("string")
    number = F.when(ending == 0, "").when(ending == 1, number).otherwise(F.translate(number, "0189", "2345"))

    def spelled(use):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: use(
            F.get(vocabulary, pick(len(NAME_WORDS), F.lit(9), i)), i)), "")

    body = F.lit(None).cast("string")
    for k, use in reversed(list(enumerate(styles))):
        body = F.when(style == k, spelled(use)).otherwise(body)
    made = made.select("id", style.alias("style"), body.alias("body"), number.alias("number"), size.alias("size"))
    token = F.concat(F.expr("substring(body, 1, cast(size - length(number) AS int))"), "number")
    # the number style in upper case too, as hexadecimal is written both ways
    return made.select(F.when((F.col("style") == 6) & (F.pmod(F.floor(F.col("id") / len(styles)), F.lit(2)) == 0),
                              F.upper(token)).otherwise(token).alias("token"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05) -> DataFrame:
    """(id_col, spans): one row per input row; ``spans`` an array of (kind, start, end).

    Spans are sorted by start, then kind in the order assign, access, hex,
    random; code points, end exclusive. Base spans (the first three kinds)
    are all that their patterns find; ``random`` spans are runs outside any
    base span that look more random than names do, at false-discovery rate
    ``q`` of the reported runs of a stratum. Null and empty texts have no
    spans. Repeated rows are scanned one by one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = {k: i for i, k in enumerate(KINDS)}

    def base(name, spans, keep):
        return F.transform(F.filter(spans, keep), lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind[name]).alias("kind"), s["end"].alias("end")))

    src = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = src.select(
        "id",
        F.concat(base("assign", match_spans(F.col("text"), ASSIGN, 2), lambda s: F.length(s["extra"]) >= ASSIGN_LEAST),
                 base("access", match_spans(F.col("text"), ACCESS), lambda s: F.length(s["hit"]) >= ACCESS_LEAST),
                 base("hex", match_spans(F.col("text"), HEX), lambda s: F.lit(True))).alias("base"),
        match_spans(F.col("text"), TOKEN).alias("tokens"))

    def scored(hit):
        """(encoding, length class, bin of the battery's p-value) of a run; null without an encoding."""
        def with_encoding(h, enc):
            return F.when(enc.isNotNull(), F.struct(
                enc.alias("enc"),
                F.least(F.floor(F.log2(F.length(h))), F.lit(LONGEST_CLASS)).cast("int").alias("len_class"),
                F.floor(-F.log10(randomness_p(h, _alphabet(enc))) * BINS).cast("int").alias("bin")))

        return bind(hit, lambda h: bind(_encoding(h), lambda enc: with_encoding(h, enc)))

    found = found.select("id", "base", outside(F.col("tokens"), F.col("base")).alias("tokens"))
    found = store(found.select("id", "base", F.filter(F.transform("tokens", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), scored(s["hit"]).alias("score"))),
        lambda s: s["score"].isNotNull()).alias("tokens")), "spans")
    stratum = ["enc", "len_class"]
    runs = found.select(F.explode("tokens").alias("t")).select("t.score.*", F.lit(0).alias("made"))
    # a generator, so that no later step computes a score again; names without an encoding are a stratum without runs
    names = (made_names(docs.sparkSession).select(F.inline(F.array(scored(F.col("token")))))
             .withColumn("made", F.lit(1)))
    # at most (len(ENCODINGS) x 3 strata) x (300 x BINS bins) of binned scores, at any input size
    hist = (runs.unionByName(names).groupBy(*stratum, "bin")
            .agg(F.sum(1 - F.col("made")).alias("n"), F.sum("made").alias("made")))
    w = Window.partitionBy(*stratum)
    up = w.orderBy("bin")
    reported, as_random = F.sum("n").over(up), F.sum("made").over(up)
    false = F.sum("n").over(w) * (1 + as_random) / (1 + F.sum("made").over(w))
    cut = (hist.select(*stratum, "bin", reported.alias("reported"), false.alias("false"))
           .filter((F.col("reported") > 0) & (F.col("false") <= q * F.col("reported")))
           .groupBy(*stratum).agg(F.max("bin").alias("cut")))
    cuts = [x for r in cut.collect() for x in (F.lit(f"{r['enc']}/{r['len_class']}"), F.lit(r["cut"]))]
    limit = F.create_map(*cuts) if cuts else F.lit(None).cast("map<string,int>")

    def discovered(t):
        at = F.concat(t["score"]["enc"], F.lit("/"), t["score"]["len_class"].cast("string"))
        return t["score"]["bin"] <= F.coalesce(F.element_at(limit, at), F.lit(-1))

    random = F.transform(F.filter("tokens", discovered), lambda t: F.struct(
        t["start"].alias("start"), F.lit(kind["random"]).alias("kind"), t["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.select(F.col("id").alias(id_col), F.transform(
        F.array_sort(F.concat("base", random)), lambda s: F.struct(
            F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
