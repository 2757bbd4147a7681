"""Secret scans: fixed patterns, and character Markov models for strings that only look random.

Base kinds (``assign``, ``access``, ``hex``) are regular expressions over the whole text. The ``markov`` kind takes
runs of ``LEAST_RUN`` or more of ``A-Za-z0-9+/_=-``, less what base spans cover, and compares two first-order character models by
their log-likelihood ratio: one of random strings, one of ordinary identifiers. Each part that is left of a run is taken
whole where its ratio is enough; elsewhere its stretches of enough ratio are found by running sums, so that ordinary
words before or after a random string don't average it away. The least ratio grows with the length.

Both models are trained from labelled samples. Random strings: digests of row numbers in hexadecimal, base64, base62 and upper-case
base 36. Ordinary identifiers: the words of ``ORDINARY_DOCS`` documents (those of smallest md5(doc_id); a bounded training
sample) less what base spans cover, and ``ORDINARY_NAMES`` names, paths, numbers, dates, versions and series built from ``WORDS``. The ratio is kept in
whole thousandths of a nat, so that scores do not depend on the order of additions.

Spans are found in time that grows little faster than the text and its matches: running sums and maxima in two
levels of chunks, binary search among spans, and blocks of text in place of substrings from its start.

Spans are half-open code point ranges. Everything runs in built-in expressions of one projection: no shuffle of
texts, no Python. Null texts count as empty; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The base patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_START = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"
ACCESS = "AKIA[A-Z0-9]{12,}"  # the same spans as AKIA[A-Z0-9]+ of 16 or more characters: runs end alike
HEX = "[0-9a-f]{32,}"  # likewise: a match takes its whole run
LEAST_RUN = 12
RUN = f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ORDINARY_DOCS = 1_000
RANDOM_STRINGS = 6_000
SMOOTHING = 0.5
ORDINARY_NAMES = 12_000
#: A run is a secret when its ratio is this much in all and this much for each transition, in thousandths of a nat.
LEAST_TOTAL, LEAST_MEAN = 9_000, 450
#: The first of the characters in ALPHABET that join words (transitions from and to them count nothing in the search for stretches).
JOINER = ALPHABET.index("/")
#: Elements of a chunk in running sums, characters of a block of text, and powers of two for binary search (2**25 spans of a text).
CHUNK, BLOCK, POWERS = 256, 1024, 25

# Common words of program names and paths.
WORDS = (
    "access account action active address admin agent alert alias api app archive array async auth backup base batch binary block body bool buffer build byte cache call cancel "
    "chart check child class clean client clone close cloud cluster code color column command comment commit common compute config connect content context control copy core count "
    "create current custom data date debug default delete deploy detail device dialog diff direct domain double down draft driver edit email empty enable end engine entry error event "
    "example export extra factory feature field file filter find first flag float folder font form format frame from function gateway get global graph group handler hash header "
    "height history home host http icon image import index info init input insert int item job join key label language last layout length level lib limit line link list load local "
    "lock log main make manager map mask match max media member memory menu merge message meta method min mode model module monitor name network node note null number object offset"
).split()

SPAN = "array<struct<start:int,kind:int,stop:int>>"
PART = "array<struct<start:int,stop:int,codes:array<int>>>"


def ordinary_names(spark: SparkSession) -> DataFrame:
    """Ordinary identifiers (s, label 0): names in the usual styles, paths, numbers, dates, versions, series."""
    words = F.array(*map(F.lit, WORDS))
    draw = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    w = [F.get(words, draw(i, len(WORDS)).cast("int")) for i in range(4)]
    up = [F.initcap(x) for x in w]
    digits = F.concat(*[draw(i, 10**6).cast("string") for i in range(10, 14)])
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), draw(20, 20_000).cast("int")), "yyyy-MM-dd")
    small, clock = draw(21, 30).cast("string"), F.lpad(draw(22, 240_000).cast("string"), 6, "0")
    series = "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 01234567890123456789 qwertyuiopasdfghjkl".split()
    kinds = [
        F.concat_ws("_", *w[:3]), F.concat(w[0], *up[1:]), F.concat(up[0], up[1], F.lit("By"), up[2], small), F.concat(*up[:2], small, F.lit("From"), *up[2:]),
        F.concat_ws("-", *w[:3]), F.upper(F.concat_ws("_", *w[:3])), F.concat(F.lit("/"), F.concat_ws("/", *w)), F.concat(F.lit("/"), F.concat_ws("/", w[0], F.concat(w[1], small), F.concat_ws("-", *w[2:]))),
        F.concat(F.regexp_replace(day, "-", ""), clock), F.concat(day, F.lit("-"), clock), digits, F.concat(w[0], F.lit("="), w[1], F.lit("_"), w[2]),
        F.concat_ws("_", w[0], w[1], F.substring(day, 1, 4)), F.repeat(F.substring(F.lit(ALPHABET), 1 + draw(23, len(ALPHABET)).cast("int"), F.lit(1)), (16 + draw(24, 64)).cast("int")),
        F.concat(*w[:3]), F.concat(F.lit("v"), small, F.lit("-"), draw(25, 30).cast("string"), F.lit("-"), w[0]), F.get(F.array(*map(F.lit, series)), draw(26, len(series)).cast("int")),
    ]
    ids = spark.range(ORDINARY_NAMES, numPartitions=2)
    return ids.select(F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int")).alias("s"), F.lit(0).alias("label"))


def train_markov(documents: DataFrame) -> list[int]:
    """Log-likelihood ratios (random over ordinary) of all character pairs of ALPHABET, row by row."""
    spark = documents.sparkSession
    ids = documents.filter("doc_id is not null").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("m")).orderBy("m", "doc_id").limit(ORDINARY_DOCS).select("doc_id").distinct()
    texts = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    plain = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    ordinary = texts.select(F.explode(F.regexp_extract_all(plain, F.lit("[A-Za-z][A-Za-z_]{4,}"), 0)).alias("s"), F.lit(0).alias("label"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    letters = F.regexp_replace(coded, "[+/=]", "")
    strings = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, coded).when(F.col("id") % 4 == 2, letters).otherwise(F.upper(letters))
    random = spark.range(RANDOM_STRINGS, numPartitions=2).select(strings.alias("s"), F.lit(1).alias("label"))
    chars = random.unionByName(ordinary).unionByName(ordinary_names(spark)).select("label", F.split("s", "").alias("c")).filter(F.size("c") > 1)
    pairs = chars.select("label", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> concat(c[i - 1], c[i]))")).alias("pair"))
    seen: dict[tuple[int, str], int] = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    n = len(ALPHABET)
    out = []
    for a in ALPHABET:
        rows = [[seen.get((label, a + b), 0) + SMOOTHING for b in ALPHABET] for label in (0, 1)]
        out += [round(1000 * (math.log(rows[1][j] / sum(rows[1])) - math.log(rows[0][j] / sum(rows[0])))) for j in range(n)]
    return out


def codes_of(run: Column) -> Column:
    return F.transform(F.split(run, ""), lambda c: (F.instr(F.lit(ALPHABET), c) - 1).cast("int"))


def ratio_of(codes: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of a run, in thousandths of a nat."""
    table = F.from_json(F.lit(json.dumps(model)), "array<int>")
    step = lambda acc, c: F.struct(F.when(acc["last"] < 0, acc["sum"]).otherwise(acc["sum"] + F.get(table, acc["last"] * len(ALPHABET) + c)).alias("sum"), c.cast("int").alias("last"))
    return F.aggregate(codes, F.struct(F.lit(0).alias("sum"), F.lit(-1).alias("last")), step, lambda acc: acc["sum"])


def stretches(codes: Column, at: Column, model: list[int]) -> Column:
    """Spans of the stretches of a run with these codes that starts ``at``: from where the running sum of the ratios less LEAST_MEAN last
    left 0 to its maximum. A fall by LEAST_TOTAL from there ends a stretch."""
    table = F.from_json(F.lit(json.dumps(model)), "array<int>")
    ratio = lambda a, b: F.when((a >= JOINER) | (b >= JOINER), 0).otherwise(F.get(table, a * len(ALPHABET) + b)) - LEAST_MEAN
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), ratio)

    def held(acc: Column) -> Column:
        size = acc["stop"] - acc["start"]
        good = (size >= LEAST_RUN) & (acc["best"] + LEAST_MEAN * (size - 1) >= LEAST_TOTAL)
        span = F.array(F.struct((at + acc["start"]).cast("int").alias("start"), F.lit(3).alias("kind"), (at + acc["stop"]).cast("int").alias("stop")))
        return F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        now, place = acc["sum"] + x, acc["place"] + 1
        ends, more = (now <= 0) | (now <= acc["best"] - LEAST_TOTAL), now > acc["best"]
        return F.struct(
            place.alias("place"), F.when(ends, place).otherwise(acc["start"]).alias("start"), F.when(ends, 0).otherwise(now).alias("sum"),
            F.when(ends, 0).when(more, now).otherwise(acc["best"]).alias("best"), F.when(ends | more, place + 1).otherwise(acc["stop"]).alias("stop"),
            F.when(ends, held(acc)).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(*[F.lit(v).alias(k) for k, v in (("place", 0), ("start", 0), ("sum", 0), ("best", 0), ("stop", 1))], none().alias("out"))
    return F.aggregate(steps, zero, step, held)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, though f's lambdas use it again and again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, zero: int, op) -> Column:
    """op over all elements up to each one, in two levels of chunks."""

    def scan(c: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(c, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def body(v: Column) -> Column:
        number = F.greatest(F.ceil(F.size(v) / CHUNK), F.lit(1)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.slice(v, k * CHUNK + 1, CHUNK))
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), op))
        before = F.concat(F.array(F.lit(zero)), F.slice(scan(totals, F.lit(zero)), 1, number - 1))
        return F.flatten(F.zip_with(chunks, before, scan))

    return let(values, body)


def below(sorted_: Column, x: Column, strictly: bool = True) -> Column:
    """How many elements of a sorted array are less than x (or not more), by binary search."""
    fits = lambda y: y < x if strictly else y <= x
    step = lambda acc, p: F.when((acc + p <= F.size(sorted_)) & fits(F.get(sorted_, acc + p - 1)), acc + p).otherwise(acc)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(POWERS))]), F.lit(0), step)


def located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans, each with its string, of all leftmost non-overlapping matches that ``keep`` accepts."""
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def body(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))), 0, lambda a, b: a + b)
        spans = F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["hit"])).alias("start"), F.lit(kind).alias("kind"), end.alias("stop"), x["hit"].alias("hit")))
        return F.filter(spans, lambda x: x["hit"].isNotNull() & (keep(x["hit"]) if keep else F.lit(True)))

    return let(parts, body)


def none(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


def uncovered(run: Column, base: Column) -> Column:
    """The parts of a run of LEAST_RUN or more that no base span covers, with their codes, less the characters that join them to one."""

    def part(codes: Column, a: Column, b: Column) -> Column:
        def body(own: Column) -> Column:
            place = lambda c: F.array_position(F.transform(c, lambda x: x < JOINER), True).cast("int")
            joins = lambda c: F.when(place(c) > 0, place(c) - 1).otherwise(F.size(c))
            first = F.when(a > run["start"], joins(own)).otherwise(0)
            last = F.size(own) - F.when(b < run["stop"], joins(F.reverse(own))).otherwise(0)
            kept = F.slice(own, first + 1, F.greatest(last - first, F.lit(0)))
            return F.struct((a + first).cast("int").alias("start"), (a + last).cast("int").alias("stop"), kept.alias("codes"))

        found = F.array(let(F.slice(codes, a - run["start"] + 1, b - a), body))
        return F.when(b - a >= LEAST_RUN, F.filter(found, lambda s: s["stop"] - s["start"] >= LEAST_RUN)).otherwise(none(PART))

    def body(codes: Column) -> Column:
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], part(codes, acc["at"], b["start"])).alias("out"))
        zero = F.struct(run["start"].alias("at"), none(PART).alias("out"))
        return F.aggregate(base, zero, step, lambda acc: F.concat(acc["out"], part(codes, acc["at"], run["stop"])))

    return let(codes_of(run["hit"]), body)


def random_spans(part: Column, model: list[int]) -> Column:
    """A part of a run, if its ratio is enough, or else its stretches of enough ratio."""
    codes = part["codes"]
    whole = ratio_of(codes, model) >= F.greatest(F.lit(LEAST_TOTAL), LEAST_MEAN * (F.size(codes) - 1))
    span = F.struct(part["start"].alias("start"), F.lit(3).alias("kind"), part["stop"].alias("stop"))
    return F.when(whole, F.array(span)).otherwise(stretches(codes, part["start"], model))


def find_spans(documents: DataFrame, model: list[int]) -> DataFrame:
    """Adds ``secret_base`` and ``secret_all``: arrays of (start, kind index, stop) sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))
    assign = F.when(text.rlike(ASSIGN_START), bare(located(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8))).otherwise(none())
    access = F.when(F.contains(text, F.lit("AKIA")), bare(located(text, ACCESS, 1))).otherwise(none())
    hexes = F.when(text.rlike("[0-9a-f]{32}"), bare(located(text, HEX, 2))).otherwise(none())
    runs = F.when(text.rlike(RUN), located(text, RUN, 3)).otherwise(none("array<struct<start:int,kind:int,stop:int,hit:string>>"))
    out = documents.withColumn("secret_base", F.array_sort(F.concat(assign, access, hexes))).withColumn("secret_runs", runs)
    out = out.withColumn("secret_starts", F.transform("secret_base", lambda b: b["start"])).withColumn("secret_ends", running(F.transform("secret_base", lambda b: b["stop"]), 0, lambda a, b: F.greatest(a, b)))

    def touching(run: Column) -> Column:
        low, high = below(F.col("secret_ends"), run["start"], False), below(F.col("secret_starts"), run["stop"])
        near = F.slice("secret_base", low + 1, F.greatest(high - low, F.lit(0)))
        return F.filter(near, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"]))

    parts = F.flatten(F.transform("secret_runs", lambda r: uncovered(r, F.when(F.size("secret_base") > 0, touching(r)).otherwise(none()))))
    found = F.flatten(F.transform(parts, lambda p: random_spans(p, model)))
    # Filters on the result would be pushed below and evaluate the whole search once for each use in them; they stop at a column that isn't deterministic.
    every = F.when(F.monotonically_increasing_id() >= 0, F.array_sort(F.concat("secret_base", found))).otherwise(none())
    return out.withColumn("secret_all", every).drop("secret_runs", "secret_starts", "secret_ends")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end`` joined by commas), n_markov."""
    found = find_spans(documents.select("doc_id", "text"), train_markov(documents))
    count = lambda k: F.size(F.filter("secret_all", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"), written(F.col("secret_all")).alias("spans"), count(3).alias("n_markov"),
    )


def redact_secrets(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each run of overlapping spans replaced by ``mark``; n_chars follows, where there is one."""
    whole = documents.select(F.struct(*documents.columns).alias("row"), "text")
    found = find_spans(whole, train_markov(documents))

    found = found.withColumn("secret_starts", F.transform("secret_all", lambda s: s["start"])).withColumn("secret_ends", running(F.transform("secret_all", lambda s: s["stop"]), 0, lambda a, b: F.greatest(a, b)))

    def cleaned(block: Column, number: Column) -> Column:
        """A block with a mark where a run of spans starts, less what spans cover."""
        first = number * BLOCK
        low, high = below(F.col("secret_starts"), first), below(F.col("secret_starts"), first + F.length(block))

        def step(acc: Column, s: Column) -> Column:
            piece = F.concat(acc["text"], F.substr(block, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], piece).otherwise(acc["text"]).alias("text"))

        zero = F.struct(F.greatest(first, F.when(low > 0, F.get("secret_ends", low - 1)).otherwise(0)).alias("at"), F.lit("").alias("text"))
        return F.aggregate(F.slice("secret_all", low + 1, high - low), zero, step, lambda acc: F.concat(acc["text"], F.substr(block, acc["at"] - first + 1)))

    clean = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cleaned), "")
    hit = F.size("secret_all") > 0
    found = found.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(hit, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
