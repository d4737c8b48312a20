"""Secret scans with DataFrame functions only: fixed formats, and two character Markov models.

Long tokens are scored by the log-likelihood ratio of a first-order model of random strings against one
of ordinary identifiers, as a whole and, where the whole is ordinary, by their best-scoring windows, so that
a key among ordinary parts is not averaged away. Both models are counted from labelled samples with DataFrame operations; the
table of log ratios has len(ALPHABET) ** 2 entries, whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import spans as S
from cairn.llm.spans import let

# Fixed formats of the contract.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# Kind, pattern, the group that is judged and its least length, in the order of the contract.
FIXED = [("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32)]
# Tokens that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzU9-"
FOLD_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="
FOLD_TO = "U" * 26 + "9" * 10 + "-" * 4
# A token is random if the ratio summed over it reaches LEAST nats and LEAST_EACH nats a character.
LEAST, LEAST_EACH = 12.0, 0.35
# Least length of what is judged, and least number of distinct letters and digits in it: rules and borders are no secrets.
LENGTH, DISTINCT = 20, 5
N_SAMPLES = 2000
# Ordinary identifier parts from which the labelled ordinary sample is built.
PARTS = """account action active address agent amount array average balance batch before between binary block body
branch buffer build bytes cache callback cancel center change channel check child class client close cluster code
column command comment commit common config connection content context control convert copy count create current
cursor data date default delete depth detail device direction document double driver element email empty enable
encoding engine entry error event execute export factory field file filter final first flag folder format frame
function general global group handler hash header height history host image import index info initial input insert
instance integer interface internal invoice item iterator journal kernel label language latest layer layout length
level library limit line link list local location lock logger login machine manager market master match matrix
maximum member memory message method metric minimum mode model module month mount name network node normal number
object offset operation option order origin output package page parameter parent parser partition path pattern
payment percent period permission person pipeline platform pointer policy position prefix previous price primary
printer private process product profile program project property protocol provider public query queue random range
rate reader record recover reference region register release remote render repository request reset resource
response result return role root route row sample scale schedule schema scope score screen search section segment
select sender sequence server service session setting shape shared signal size slice socket source space special
stack standard start state static status storage stream string structure style subject summary support switch symbol
system table target task temporary template test text thread threshold time title total trace track transaction
transfer transform tree trigger type unique update upload user utility valid value variable vector version video
view visible volume warning weight width window worker wrapper writer year zone the and that with from this which
they have were been their other there would about these into time than could them also some only make what over such
tion ing ment ness able ible ance ence heit keit schaft ung lich isch eur elle ette ique ción dad mente ando iendo""".split()


def samples(spark: SparkSession) -> DataFrame:
    """(label, token): random strings in three alphabets, and identifiers of two to six ordinary parts in three styles."""
    words = F.array(*[F.lit(w) for w in PARTS])
    n = len(PARTS)
    ids = spark.range(N_SAMPLES)
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256)
    ten = F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "xYz"), 1, 32)
    random = ids.select(F.lit("random").alias("label"), F.explode(F.array(F.substring(digest, 1, 40), F.substring(F.base64(F.unhex(digest)), 1, 40), ten)).alias("token"))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(n)) + 1).cast("int"))
    chosen = F.slice(F.array(*[pick(k) for k in range(6)]), 1, (F.pmod(F.col("id"), F.lit(5)) + 2).cast("int"))
    capital = F.transform(chosen, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99)))
    number = F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")
    styles = F.array(F.array_join(chosen, "_"), F.array_join(capital, ""), F.array_join(chosen, ""), F.concat(F.array_join(chosen, "-"), F.lit("_"), number))
    ordinary = ids.select(F.lit("ordinary").alias("label"), F.explode(styles).alias("token"))
    return random.unionByName(ordinary)


def folded(token: Column) -> Column:
    """Capitals, digits and signs as one symbol each; letters stay."""
    return F.translate(token, FOLD_FROM, FOLD_TO)


def log_ratios(labelled: DataFrame) -> list[float]:
    """log P_random(b | a) - log P_ordinary(b | a) for the pairs of ALPHABET, row by row, with add-one smoothing."""
    token = folded(F.col("token"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substr(token, i, F.lit(2)))
    counts = labelled.where(F.length("token") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    table = {(r["label"], r["pair"]): r["count"] for r in counts.collect()}  # at most two rows for each pair of symbols
    out = []
    for a in ALPHABET:
        row = {k: sum(table.get((k, a + b), 0) + 1 for b in ALPHABET) for k in ("random", "ordinary")}
        out += [math.log((table.get(("random", a + b), 0) + 1) / row["random"]) - math.log((table.get(("ordinary", a + b), 0) + 1) / row["ordinary"]) for b in ALPHABET]
    return out


def ratios(token: Column, table: Column) -> Column:
    """The log-likelihood ratio of each pair of neighbours in a token; 0 for two signs, which say nothing about the rest."""
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    symbols = F.filter(F.transform(F.split(folded(token), ""), code), lambda c: c > 0)
    n = len(ALPHABET)
    of = lambda a, b: F.when((a == n) & (b == n), 0.0).otherwise(F.element_at(table, (a - 1) * n + b))
    return let(symbols, lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, 1 << 30), of))


def windows(values: Column) -> Column:
    """Windows (start, end) of a token, by the ratios of its pairs, in which the ratio sums to LEAST or more at LEAST_EACH a character.

    The running sum of what exceeds LEAST_EACH opens a window where it leaves 0 and closes it at its peak,
    once it is 0 or LEAST below the peak; the next window begins behind.
    """
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(*[F.lit(0).alias(c) for c in ("at", "start", "end")], *[F.lit(0.0).alias(c) for c in ("run", "peak")], F.expr(f"cast(array() as {kind})").alias("out"))

    def closed(acc: Column) -> Column:
        one = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))).cast(kind)
        enough = acc["peak"] + LEAST_EACH * (acc["end"] - acc["start"]) >= LEAST
        return F.when((acc["peak"] > 0) & enough, F.concat(acc["out"], one)).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        def onward(run: Column) -> Column:
            at = acc["at"] + 1
            done = (run <= 0) | (run <= acc["peak"] - LEAST)
            higher = run > acc["peak"]
            fresh = F.when(acc["run"] <= 0, acc["at"]).otherwise(acc["start"])
            return F.when(
                done, F.struct(at.alias("at"), at.alias("start"), at.alias("end"), F.lit(0.0).alias("run"), F.lit(0.0).alias("peak"), closed(acc).alias("out"))
            ).otherwise(
                F.struct(at.alias("at"), fresh.alias("start"), F.when(higher, at + 1).otherwise(acc["end"]).alias("end"), run.alias("run"), F.greatest(run, acc["peak"]).alias("peak"), acc["out"].alias("out"))
            )

        return let(acc["run"] + x - LEAST_EACH, onward)

    return F.aggregate(values, zero, step, closed)


def varied(token: Column) -> Column:
    """Whether a token has DISTINCT different letters and digits or more."""
    return F.size(F.array_distinct(F.split(F.regexp_replace(token, "[^A-Za-z0-9]", ""), ""))) >= DISTINCT


def random_in(token: Column, table: Column) -> Column:
    """Stretches (start, end) of a token judged random: the whole token, else its windows, each fitted to the signs around it."""
    kind = "array<struct<start:int,end:int>>"
    size = F.length(token)
    none = F.expr(f"cast(array() as {kind})")

    def widened(w: Column) -> Column:
        inside = F.substr(token, w["start"] + 1, w["end"] - w["start"])
        length = lambda part, pattern: F.length(F.regexp_extract(part, pattern, 0))
        before = length(F.substr(token, F.lit(1), w["start"]), "[A-Za-z0-9]*$")
        after = length(F.substr(token, w["end"] + 1), "^[A-Za-z0-9]*")
        # a part of which the smaller half lies in the window is left out with its sign, any other is taken whole
        head, tail = length(inside, "^[A-Za-z0-9]*(?=[+/_=-])"), length(inside, "(?<=[+/_=-])[A-Za-z0-9]*$")
        signed = inside.rlike("[+/_=-]")
        start = F.when(signed & (head < before), w["start"] + length(inside, "^[A-Za-z0-9]*[+/_=-]+")).otherwise(w["start"] - before)
        end = F.when(signed & (tail < after), w["end"] - length(inside, "[+/_=-]+[A-Za-z0-9]*$")).otherwise(w["end"] + after)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def fits(w: Column) -> Column:
        return (w["end"] - w["start"] >= LENGTH) & varied(F.substr(token, w["start"] + 1, w["end"] - w["start"]))

    def judged(values: Column) -> Column:
        score = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        whole = let(score, lambda v: (v >= LEAST) & (v >= LEAST_EACH * size))
        parts = F.array_distinct(F.filter(F.transform(windows(values), widened), fits))
        return F.when(whole, F.array(F.struct(F.lit(0).alias("start"), size.alias("end"))).cast(kind)).otherwise(parts)

    return F.when(varied(token), let(ratios(token, table), judged)).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", labelled: DataFrame | None = None, names: tuple[str, str] = ("base", "added")) -> DataFrame:
    """docs with base (spans of the fixed formats) and added (spans of random tokens in what the base spans leave).

    Tokens are sought in the text with the base spans blanked out, so each stretch beside one is judged on its own.
    A null text counts as empty and has no spans; repeated rows are scanned each; an empty table gives no
    rows. Columns of docs named like a new one, in any case, are replaced; names gives the new ones other names.
    A text's matches are gathered in steps of S.STEP, so work grows with its length, whatever the number of matches.
    """
    spark = docs.sparkSession
    table = F.lit([float(x) for x in log_ratios(labelled if labelled is not None else samples(spark))])
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(*[S.match_spans(body, pattern, kind, rank, group, least) for rank, (kind, pattern, group, least) in enumerate(FIXED)])
    blank = lambda rest, pattern, group, least: let(rest, lambda t: S.blanked(t, pattern, group, least))
    rest = body
    for _, pattern, group, least in FIXED:
        rest = blank(rest, pattern, group, least)
    candidates, = S.free_names(docs, "candidates")
    kept = [c for c in docs.columns if c.lower() not in (x.lower() for x in names)]
    out = docs.select(*kept, base.alias(names[0]), let(rest, lambda t: S.match_texts(t, CANDIDATE)).alias(candidates))

    def added(x: Column) -> Column:
        one = lambda w: F.struct((x["start"] + w["start"]).alias("start"), (x["start"] + w["end"]).alias("end"), F.lit(3).alias("rank"), F.lit("random").alias("kind")).cast(S.SPAN)
        return F.transform(random_in(x["hit"], table), one)

    return out.select(*kept, names[0], F.flatten(F.transform(candidates, added)).alias(names[1]))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark and n_chars set to the new length; texts without a secret stay as they are.

    Other columns stay as they are, whatever their names.
    """
    base, added = S.free_names(docs, "base", "added")
    found = with_spans(docs, names=(base, added)).withColumn(base, F.concat(base, added))
    out = found.withColumn("text", F.when(F.size(base) > 0, S.masked(F.col("text"), F.col(base), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(base) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(docs.columns)
