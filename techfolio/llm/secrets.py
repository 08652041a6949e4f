"""Secret scan: fixed patterns, and a randomness test battery under false-discovery control. Spark expressions only.

Base spans are those of three patterns. Beside them every run of 20 or more symbols of the usual encodings with a letter
is a candidate; ``=`` belongs to it only as padding at its end. Of a run with separators its longest pieces within the
alphabets of base64 and base64url and those without separators are candidates. A candidate's encoding is inferred from its alphabet, and three tests ask whether it looks
like uniform random symbols: chi-squared for the alphabet, the number of runs above and below the middle, and the
serial correlation of neighbours. The smallest of the three p-values, times three, is the candidate's. The power of the
tests grows with length, so candidates are judged within strata of encoding and length: in each, the Benjamini-Hochberg
procedure sets aside those that are significantly not random at ``alpha``.

That a candidate is left proves nothing, so those left are tested against ordinary tokens: slugs, camel case and file
names, whose words are spelled like the words of the corpus. ``q`` is the likelihood under that model over the one
under uniform symbols, at most 1. An ordinary token has a ``q`` of t or less with a probability of t at most, whatever
its length, and Benjamini-Hochberg on ``q`` in each stratum makes a ``random`` span a rejection: the expected share of
ordinary tokens among them is at most ``alpha``, as far as the model holds.

Defined results: null and empty text has no spans; a random span that lies inside a base span is not repeated; repeated
rows and null ids give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their order.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A maximal run that is too short holds no run that is long enough, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

# Padding counts for the least length of 20, so that the patterns begin at 18.
CANDIDATE = r"[A-Za-z0-9+/_-]{18,}+={0,2}"
PIECES = (r"[A-Za-z0-9+/]{18,}+={0,2}", r"[A-Za-z0-9_-]{18,}+={0,2}", r"[A-Za-z0-9]{18,}+={0,2}")
CANDIDATE_LEAST = 20

# Alphabets of the encodings, the first that holds a token is taken.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_MEMBERS = {"hex": "[0-9a-f]+|[0-9A-F]+", "base32": "[A-Z2-7]+", "base36": "[a-z0-9]+", "base64": "[A-Za-z0-9+/]+", "base64url": "[A-Za-z0-9_-]+"}
BINS = 2000

# The model of ordinary tokens. Shares of the kind of the next symbol (lower, upper, digit, separator)
# after each kind; a token begins as after a separator. Within words, letters follow each other as in the words counted;
# the shares of pairs, single letters and any letter are mixed, so that no pair is impossible.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"
NEXT_KIND = ((0.85, 0.05, 0.03, 0.07), (0.35, 0.5, 0.05, 0.1), (0.15, 0.1, 0.5, 0.25), (0.5, 0.3, 0.18, 0.02))
MIXED = (0.85, 0.1, 0.05)
# What the counts hold before any text is read, each word once: small tables have few words of their own.
WORDS = """about access account action address after again against all also always and annual answer any application archive
around array article background backup balance because before begin between big board book branch bridge brown budget
build business button camera center change chapter character check child city class clear client close code color come
command common company component config contact content control copy could country course create current customer data
database date day default delete design detail device different directory disk display document does down download draft
each early edit email end energy english enter error even event every example execute export family feature field file
final find first follow form format found from function game general get give global good great green group guide half
handler hand have head health help here high history home house how identifier image import important index information
input install integer interface internal international into introduction island item journal jump just keep key know
label language large last later layout lazy learn left length letter level library life light limit line link list little
local lock login long look machine main make manager map market master matrix maximum may member memory menu message
method minimum mobile mode model module month more most move much multiple music name nature network never new next night
node north note number object october office often old only open option order other output over own package page paper
parameter parent part path pattern people person phone photo picture place plan player point policy position power
present previous print private problem process product profile program project property provider public quality query
question quick random range read record reference release remote report request resource response result retry return
review right river road room root rule run sample save school science score screen script search season second section
security select sequence server service session set short should show side simple since size small social software some
source south space special standard start state station status still stock stop storage story street string structure
student style subject such summary support surface system table tag target task team technology template test text thank
that the their them then there these they thing think this those thread through time title today together tool total
track training transfer travel tree two type under unit universe until update upload use user utility value variable
vector version very video view village visit volume walk wall want watch water way weather website week well were west
what when where which while white who width wiki will window winter with word work world would write year young"""

_SPAN = "array<struct<start: int, end: int>>"


def _located(text: Column, pattern: str, found: Column, keep=None) -> Column:
    """Spans of the matches ``found`` of ``pattern`` in ``text``, in code points, from the pieces between them."""
    pieces = F.split(text, pattern, -1)

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    both = F.zip_with(pieces, found, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    none = F.array().cast(_SPAN)
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(both, first, step, lambda s: s["out"])).otherwise(none)


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans ``assign``, ``access`` and ``hex``, and ``candidates``, of the column ``text``.

    Step by step, so that every pattern is run once over a text, and pieces are made only where something was found.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | low.contains(word)
    empty = F.array().cast("array<string>")
    hits = docs.withColumns(
        {
            "_assign": F.when(named, _hits(text, ASSIGN)).otherwise(empty),
            "_access": F.when(text.contains("AKIA"), _hits(text, ACCESS)).otherwise(empty),
            "_runs": _hits(text, CANDIDATE),
            "_hex": _hits(text, HEX),
        }
    )
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST
    fit = lambda hit: (F.length(hit) >= CANDIDATE_LEAST) & hit.rlike("[A-Za-z]")
    # nothing of a text without a fitting run needs a place
    runs = F.when(F.exists("_runs", fit), F.col("_runs")).otherwise(empty)
    placed = hits.withColumns(
        {
            "assign": _located(text, ASSIGN, F.col("_assign"), value),
            "access": _located(text, ACCESS, F.col("_access")),
            "hex": _located(text, HEX, F.col("_hex")),
            "_places": _located(text, CANDIDATE, runs),
        }
    ).withColumn("_runs", runs)
    both = F.zip_with("_places", "_runs", lambda place, hit: F.struct(place["start"].alias("start"), place["end"].alias("end"), hit.alias("hit")))
    placed = placed.withColumn("_fit", F.filter(both, lambda x: fit(x["hit"])))

    def pieces_of(x):
        def within(pattern):
            places = _located(x["hit"], pattern, _hits(x["hit"], pattern), fit)
            return F.transform(places, lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), F.substring(x["hit"], y["start"] + 1, y["end"] - y["start"]).alias("hit")))

        parts = F.array_distinct(F.concat(*(within(pattern) for pattern in PIECES)))
        return F.when(x["hit"].rlike("[+/_-]"), parts).otherwise(F.array(x))

    placed = placed.withColumn("_fit", F.flatten(F.transform("_fit", pieces_of)))
    token = lambda x: F.rtrim(F.translate(x["hit"], "=", " "))  # noqa: E731  padding at the end is no symbol
    candidates = F.transform("_fit", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), token(x).alias("token")))
    return placed.withColumn("candidates", candidates).drop("_assign", "_access", "_hex", "_runs", "_places", "_fit")


def _two_sided(z: Column) -> Column:
    """Probability of a standard normal value further out than z, by the logistic approximation (error below 0.0003)."""
    a = F.least(F.abs(z), F.lit(12.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(0.07056) * a * a * a + F.lit(1.5976) * a))


def letter_counts(docs: DataFrame) -> list[list[float]]:
    """How often each letter (columns a to z) begins a word (row 0) or follows another (rows a to z), in the words of all
    of ``docs`` (text) and in ``WORDS``. Words are whole runs of letters, too short for candidates; each is counted where it
    is read, and its pairs are counted once for all its places."""
    whole = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,17}+(?![A-Za-z0-9+/_=-])"
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(whole), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.length("w") - 1), lambda i: F.substring(F.concat(F.lit(" "), "w"), i + 1, F.lit(2)))).alias("pair"))
    counts = [[0.0] * 26 for _ in range(27)]
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    for pair, n in [*found.items(), *((f" {w}"[k : k + 2], 1) for w in WORDS.split() for k in range(len(w)))]:
        # what a locale lower-cases to other letters is no pair of these
        if pair[0] in " abcdefghijklmnopqrstuvwxyz" and "a" <= pair[1] <= "z":
            counts[" abcdefghijklmnopqrstuvwxyz".index(pair[0])][ord(pair[1]) - 97] += n
    return counts


def _costs(counts: list[list[float]] | None = None) -> list[float]:
    """-log probability of each symbol after a separator or at the start (row 0) and after each symbol, row by row."""
    import math

    if counts is None:
        counts = [[0.0] * 26 for _ in range(27)]
        for w in WORDS.split():
            for a, b in zip(" " + w, w):  # noqa: B905
                counts[" abcdefghijklmnopqrstuvwxyz".index(a)][ord(b) - 97] += 1
    single = [sum(row[j] for row in counts) for j in range(26)]
    total = sum(single)

    def letter(before: int, j: int) -> float:
        row = counts[before]
        all_ = sum(row)
        pair = row[j] / all_ if all_ else single[j] / total
        return MIXED[0] * pair + MIXED[1] * single[j] / total + MIXED[2] / 26

    kind = lambda k: 0 if k < 26 else 1 if k < 52 else 2 if k < 62 else 3
    out = []
    for a in range(-1, len(SYMBOLS)):
        was = 3 if a < 0 else kind(a)
        for b in range(len(SYMBOLS)):
            now = kind(b)
            # a capital after a small letter begins a word
            before = a % 26 + 1 if was < 2 and not (was == 0 and now == 1) else 0
            share = letter(before, b % 26) if now < 2 else 0.1 if now == 2 else 0.25
            out.append(-math.log(NEXT_KIND[was][now] * share))
    return out


def battery(docs: DataFrame, column: str = "candidates", costs: list[float] | None = None) -> DataFrame:
    """``docs`` whose candidates (an array of structs with ``token``) also hold ``stratum``, ``p``, the combined p-value
    against randomness, and ``q``, the one against ordinary tokens of the model ``costs``; those that no encoding fits
    go. One step builds on the fields of the one before, so that nothing is
    worked out twice for a token."""

    def step_on(df: DataFrame, **fields) -> DataFrame:
        def extend(x):
            for name, of in fields.items():
                x = x.withField(name, of(x))
            return x

        return df.withColumn(column, F.transform(column, extend))

    def encoding_of(x):
        out = F.lit(None).cast("string")
        for name in reversed(ALPHABETS):
            out = F.when(x["token"].rlike(f"^(?:{_MEMBERS[name]})$"), name).otherwise(out)
        return out

    def alphabet_of(x):
        out = F.lit(None).cast("string")
        for name, letters in ALPHABETS.items():
            out = F.when(x["encoding"] == name, letters).otherwise(out)
        return out

    def values_of(x):
        # a symbol's value is its place in the alphabet
        spelled = F.when(x["encoding"].isin("hex", "base36"), F.lower(x["token"])).otherwise(x["token"])
        return F.transform(F.split(spelled, "(?!^)"), lambda c: (F.instr(x["letters"], c) - 1).cast("double"))

    zero = F.lit(0.0)

    def sums_of(x):
        half = x["k"] / 2

        def add(a, v):
            side = (v >= half).cast("double")
            turn = (a["last"] < 0) | (side != (a["last"] >= half).cast("double"))
            return F.struct(
                (a["s"] + v).alias("s"),
                (a["ss"] + v * v).alias("ss"),
                (a["c"] + F.when(a["last"] < 0, zero).otherwise(v * a["last"])).alias("c"),
                (a["runs"] + turn.cast("double")).alias("runs"),
                (a["high"] + side).alias("high"),
                v.alias("last"),
            )

        start = F.struct(zero.alias("s"), zero.alias("ss"), zero.alias("c"), zero.alias("runs"), zero.alias("high"), F.lit(-1.0).alias("last"))
        return F.aggregate(x["values"], start, add)

    def squares_of(x):
        counts = F.transform(F.array_distinct(x["values"]), lambda d: F.size(F.filter(x["values"], lambda v: v == d)).cast("double"))
        return F.aggregate(counts, zero, lambda a, c: a + c * c)

    def chi_of(x):
        n, k = x["n"], x["k"]
        return (x["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    far = F.lit(12.0)

    def runs_of(x):
        n, high = x["n"], x["sums"]["high"]
        expected = 2 * high * (n - high) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        return F.when(spread > 0, (x["sums"]["runs"] - expected) / F.sqrt(spread)).otherwise(far)

    def serial_of(x):
        n, s = x["n"], x["sums"]
        mean = s["s"] / n
        spread = s["ss"] - n * mean * mean
        around = s["c"] - mean * (2 * s["s"] - F.element_at(x["values"], 1) - s["last"]) + (n - 1) * mean * mean
        return F.when(spread > 0, (around / spread + 1 / (n - 1)) * F.sqrt(n)).otherwise(far)

    def p_of(x):
        return F.least(F.lit(1.0), 3 * F.least(_two_sided(x["chi"]), _two_sided(x["turns"]), _two_sided(x["serial"])))

    # one value for the planner, however many numbers it holds
    table = F.split(F.lit(",".join(f"{c:.6f}" for c in costs or _costs())), ",").cast("array<double>")
    width = len(SYMBOLS)

    def cost_of(x):
        def add(a, c):
            at = F.instr(F.lit(SYMBOLS), c)
            return F.struct((a["sum"] + F.element_at(table, a["last"] * width + at)).alias("sum"), at.alias("last"))

        start = F.struct(zero.alias("sum"), F.lit(0).alias("last"))
        return F.aggregate(F.split(x["token"], "(?!^)"), start, add, lambda a: a["sum"])

    def q_of(x):
        # beyond the last class of the counts all are alike
        return F.exp(F.greatest(F.lit(-60.0), F.least(zero, x["n"] * F.log(x["k"]) - x["cost"])))

    def stratum_of(x):
        # strata of encoding and of length by half octaves, the longest open
        return F.concat_ws(":", x["encoding"], F.least(F.lit(12), F.floor(2 * F.log2(x["n"] / 20))).cast("string"))

    df = step_on(docs, encoding=encoding_of)
    df = df.withColumn(column, F.filter(column, lambda x: x["encoding"].isNotNull()))
    df = step_on(df, letters=alphabet_of)
    df = step_on(df, k=lambda x: F.length(x["letters"]).cast("double"), values=values_of)
    df = step_on(df, n=lambda x: F.size(x["values"]).cast("double"), sums=sums_of, squares=squares_of)
    df = step_on(df, chi=chi_of, turns=runs_of, serial=serial_of)
    df = step_on(df, p=p_of, stratum=stratum_of, cost=cost_of)
    df = step_on(df, q=q_of)
    slim = lambda x: F.struct(*(x[name].alias(name) for name in ("start", "end", "stratum", "p", "q")))
    return df.withColumn(column, F.transform(column, slim))


def _each(tested: DataFrame) -> DataFrame:
    return tested.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.stratum", "c.p", "c.q")


def _step_up(each: DataFrame, value: str, alpha: float) -> dict[str, float]:
    """Benjamini-Hochberg threshold of the p-values ``value`` in each stratum of ``each``: those at or below it are rejected.

    Works on counts in ``BINS`` classes of -log p, so at most strata x BINS rows are ordered, whatever the number of
    candidates; a class counts with its upper edge, which is the careful side.
    """
    from pyspark.sql import Window

    edge = lambda b: F.exp(-b / (BINS / 40.0))
    binned = each.select("stratum", F.least(F.lit(BINS), F.floor(-F.log(value) * (BINS / 40.0))).cast("int").alias("bin"))
    counts = binned.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("stratum")
    ranked = counts.withColumns({"below": F.sum("n").over(upto), "total": F.sum("n").over(every), "edge": edge(F.col("bin"))})
    cut = ranked.filter(F.col("edge") <= alpha * F.col("below") / F.col("total")).groupBy("stratum").agg(F.max("edge").alias("cut"))
    return {r["stratum"]: r["cut"] for r in cut.collect()}


def _cut_of(stratum: Column, cuts: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in sorted(cuts.items()):
        out = F.when(stratum == name, F.lit(value)).otherwise(out)
    return out


def thresholds(tested: DataFrame, alpha: float = 0.01) -> dict[str, float]:
    """Threshold of each stratum of ``tested`` (with ``candidates``) for ``p``: at or below it a candidate is not random."""
    return _step_up(_each(tested), "p", alpha)


def both_thresholds(tested: DataFrame, alpha: float = 0.01) -> tuple[dict[str, float], dict[str, float]]:
    """Those of ``thresholds``, and those for ``q`` among the candidates that are left: at or below it one is a secret.

    The values of all candidates, without texts, are checkpointed once.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(tested.sparkSession)
    each = _each(tested).checkpoint()
    plain = _step_up(each, "p", alpha)
    return plain, _step_up(each.filter(F.col("p") > _cut_of(F.col("stratum"), plain)), "q", alpha)


def with_random(tested: DataFrame, cuts: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """``tested`` with ``random``: the candidates that ``cuts`` (of ``both_thresholds``) leave as random and reject as
    ordinary, and that lie in no base span; without candidates."""
    base = F.concat("assign", "access", "hex")
    inside = lambda x: F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    found = lambda x: (x["p"] > _cut_of(x["stratum"], cuts[0])) & (x["q"] <= _cut_of(x["stratum"], cuts[1]))
    kept = F.filter("candidates", lambda x: found(x) & ~inside(x))
    # a piece of a found run is not repeated: by start and the longest first, it ends no later than one before it
    lined = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"))))

    def outer(a, x):
        span = F.struct(x["start"].alias("start"), (-x["back"]).alias("end"))
        return F.when(-x["back"] > a["end"], F.struct((-x["back"]).alias("end"), F.array_append(a["out"], span).alias("out"))).otherwise(a)

    none = F.array().cast(_SPAN)
    plain = F.aggregate(lined, F.struct(F.lit(0).alias("end"), none.alias("out")), outer, lambda a: a["out"])
    return tested.withColumn("random", F.when(F.size("candidates") > 0, plain).otherwise(none)).drop("candidates")


def listed(kinds: tuple[str, ...] = KINDS) -> Column:
    """The spans of ``kinds`` as structs (start, order of the kind, end, kind), by start and then by kind."""

    def tagged(order: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(tagged(k, kind) for k, kind in enumerate(kinds))))


def written(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, *, alpha: float = 0.01) -> DataFrame:
    """(doc_id, assign, access, hex, random): the spans of every row of ``docs`` (doc_id, text).

    All texts give the spelling of ordinary words. A second pass leaves spans and p-values, which are checkpointed without
    the texts; the thresholds then follow from counts by stratum, a bounded number.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    costs = _costs(letter_counts(docs))
    tested = battery(spans(docs.select("doc_id", "text")), costs=costs).drop("text").checkpoint()
    return with_random(tested, both_thresholds(tested, alpha))


def redact(docs: DataFrame, *, alpha: float = 0.01, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; other columns unchanged, null text stays null.

    One narrow pass over the texts after the counts of letters: rows and their tested candidates are checkpointed, the
    thresholds follow from the candidates, and no text is shuffled. Spans that touch or overlap are replaced once.
    """
    from ..session import ensure_checkpoint_dir

    names = docs.columns
    ensure_checkpoint_dir(docs.sparkSession)
    costs = _costs(letter_counts(docs.select("text")))
    # the caller's columns may have any names, so they travel in one struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text"))
    tested = battery(spans(rows), costs=costs).checkpoint()
    found = with_random(tested, both_thresholds(tested, alpha)).withColumn("_spans", listed())

    def step(a, x):
        # what lies between the end of the last span and this one is kept, then the mark
        gap = F.substring(F.col("text"), a["end"] + 1, F.greatest(F.lit(0), x["start"] - a["end"]))
        fresh = (x["start"] > a["end"]) | (a["end"] == 0)
        out = F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["end"], x["end"]).alias("end"), out.alias("out"))

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["end"] + 1, F.length("text"))))
    found = found.withColumn("_clean", F.when(F.col("text").isNotNull() & (F.size("_spans") > 0), clean).otherwise(F.col("text")))
    return found.select(*[F.col("_clean").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names])
