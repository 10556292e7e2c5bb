"""Personal data by patterns, extended by bootstrapped contextual extraction.

Four kinds of identifiers are found by regular expression and check (the base). They are the seeds of
a graph between instances (identifier-like tokens) and lexical patterns (the words around them): a
pattern is as good as the share of its distinct instances that are known to be of one kind, an unknown
instance as good as the noisy-or of its patterns. In each round the patterns are scored anew and the
confident instances join the known ones; their places are reported with the kind they were found as.
An instance keeps its first kind and its weight never falls, so patterns never get worse either; rounds
go on until one changes nothing, weights taken to four decimals.

A pattern is confident if the lower Wilson bound of its share passes ``MIN_SHARE`` and is clearly above
the kind's share among all instances: ``MIN_LIFT`` times that or, for kinds that are so common that few
or no shares reach it, ``MIN_GAIN`` of the way from there to 1. So contexts which say nothing (a common
word pair) add nothing, however frequent they are, and a pattern whose instances are all known passes
once there are enough of them.

Texts are read once, for the base spans and the contexts; from then on only contexts are shuffled, as
hashes, and pattern and instance counts are combined map-side. All state between rounds lies in
checkpoints.

Defined results: a NULL or empty text has no spans; repeated rows are judged one by one; the base
never depends on other documents, found spans never overlap base spans. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolelens.llm.text import fresh, let, prefix_sums, running, text_key
from rolelens.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")

# The kinds' patterns. Possessive quantifiers and look-behinds only keep a search from
# starting again inside a run that it has already read, so that long runs cost linear time; \G lets a
# match begin where the last one ended.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without this in a text, the kind's pattern cannot match.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PART = r"0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"

#: Identifier-like: a run of identifier characters with a digit.
TOKEN = r"(?<![A-Za-z0-9._%+@/-])[A-Za-z._%+@/-]*+[0-9][A-Za-z0-9._%+@/-]*+"

MIN_SHARE = 0.5
MIN_LIFT = 1.5
MIN_GAIN = 1 / 3
MIN_CONFIDENCE = 0.75
_Z = 1.645
#: Characters on either side from which context words are taken.
_REACH = 80


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        x = F.ascii(digits.substr(i, F.lit(1))) - 48
        twice = 2 * x - F.when(x > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), let(digits, _luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches in order: {start, kind_no, end, value, left, right}; kind_no is -1 for tokens."""
    number = KINDS.index(kind) if kind in KINDS else -1

    def located(pieces: Column, found: Column) -> Column:
        steps = F.transform(
            found, lambda m, i: (F.char_length(F.get(pieces, i)) + F.char_length(m)).cast("long")
        )

        def placed(ends: Column) -> Column:
            def place(m, i):
                return F.struct(
                    (F.get(ends, i) - F.char_length(m)).alias("start"),
                    F.lit(number).alias("kind_no"),
                    F.get(ends, i).alias("end"),
                    m.alias("value"),
                    F.right(F.get(pieces, i), F.lit(_REACH)).alias("left"),
                    F.left(F.get(pieces, i + 1), F.lit(_REACH)).alias("right"),
                )

            return F.transform(found, place)

        return let(steps, lambda s: let(prefix_sums(s), placed))

    every = let(
        F.split(text, pattern, -1),
        lambda pieces: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: located(pieces, m)),
    )
    return F.filter(every, lambda m: _passes(kind, m["value"])) if kind in KINDS else every


_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint>>"


def _found(text: Column, tokens: bool) -> Column:
    """Base spans, and with ``tokens`` identifier-like tokens too, with their surroundings."""
    none = F.array().cast(
        "array<struct<start:bigint,kind_no:int,end:bigint,value:string,left:string,right:string>>"
    )
    parts = []
    for kind in KINDS:
        needs = _NEEDS[kind]
        found = _matches(text, _PATTERNS[kind], kind)
        parts.append(F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found)
    if tokens:
        parts.append(_matches(text, TOKEN, "token"))
    # an address without any digit has no token, but is a base span all the same
    return F.when(text.rlike("[0-9@]"), F.concat(*parts)).otherwise(none)


def _occurrences(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base per row (_row, _key, doc_id, base), and one row per seed or free token with its patterns."""
    read = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        text_key(F.col("doc_id"), F.col("text")).alias("_key"),
        "doc_id",
        _found(F.coalesce(F.col("text"), F.lit("")), tokens=True).alias("found"),
    )
    slim = F.transform(
        "found",
        lambda m: F.struct(
            m["start"].alias("start"), m["kind_no"].alias("kind_no"), m["end"].alias("end"),
            F.xxhash64(m["value"]).alias("instance"), _patterns(m).alias("patterns"),
        ),
    )
    rows = read.select("_row", "_key", "doc_id", slim.alias("found")).checkpoint()
    base = F.filter("found", lambda m: m["kind_no"] >= 0)
    per_row = rows.select(
        "_row", "_key", "doc_id",
        F.sort_array(F.transform(base, lambda m: F.struct(m["start"], m["kind_no"], m["end"]))).alias("base"),
    )
    each = rows.select("_row", F.inline("found"))
    # tokens that touch a base span are dropped: the furthest base end before, the first base start after
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    same_start = Window.partitionBy("_row").orderBy("start").rangeBetween(0, 0)
    is_base = F.col("kind_no") >= 0
    after = Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    free = each.select(
        "*",
        F.max(F.when(is_base, F.col("end"))).over(before).alias("reach"),
        F.min(F.when(is_base, F.col("start"))).over(after).alias("next"),
        F.max(is_base).over(same_start).alias("shared"),
    ).where(
        is_base
        | (
            (F.coalesce(F.col("reach"), F.lit(-1)) <= F.col("start"))
            & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
            & ~F.col("shared")
        )
    )
    return per_row, free.select("_row", "start", "end", "kind_no", "instance", "patterns").checkpoint()


def _patterns(m: Column) -> Column:
    def words(c: Column) -> Column:
        return F.split(F.lower(F.trim(F.translate(c, "\n\t\r", "   "))), " +")

    def hashed(before: Column, after: Column) -> Column:
        pair = F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2))
        return F.array(
            F.xxhash64(F.lit("before"), F.array_join(pair, " ")),
            F.xxhash64(F.lit("around"), F.get(before, F.size(before) - 1), F.get(after, F.lit(0))),
        )

    return let(words(m["left"]), lambda b: let(words(m["right"]), lambda a: hashed(b, a)))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """Unseen instances that the graph finds: instance, kind_no.

    ``occurrences`` has kind_no (-1 if unknown), instance and patterns.
    """
    instances = occurrences.groupBy("instance").agg(F.max("kind_no").alias("kind_no")).checkpoint()
    counts = {r["kind_no"]: r["count"] for r in instances.groupBy("kind_no").count().collect()}  # one row per kind
    usual = [counts.get(k, 0) / max(1, sum(counts.values())) for k in range(len(KINDS))]
    edges = occurrences.select("instance", F.explode("patterns").alias("pattern")).distinct().checkpoint()
    seeds = instances.where("kind_no >= 0").withColumn("weight", F.lit(1.0))
    found = seeds.where("false")
    while True:
        noisy_or = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        new = (
            edges.join(_score_patterns(edges, seeds.unionByName(found), usual), "pattern")
            .groupBy("instance", "kind_no")
            .agg(F.round(noisy_or, 4).alias("weight"))
            .where(F.col("weight") >= MIN_CONFIDENCE)
            .join(seeds.select("instance"), "instance", "left_anti")
            .join(found.select("instance", F.col("kind_no").alias("first")), "instance", "left")
            .where("first IS NULL OR first = kind_no")
            .select("instance", "kind_no", "weight")
            .unionByName(found)
            .groupBy("instance")
            .agg(F.max(F.struct("weight", "kind_no")).alias("best"))
            .select("instance", "best.kind_no", "best.weight")
            .checkpoint()
        )
        if new.join(found, ["instance", "kind_no", "weight"], "left_anti").isEmpty():
            return new.select("instance", "kind_no")
        found = new


def _score_patterns(edges: DataFrame, known: DataFrame, usual: list[float]) -> DataFrame:
    """pattern, kind_no, confidence of the patterns that pass the bounds."""
    sums = [
        F.sum(F.when(F.col("kind_no") == k, F.col("weight")).otherwise(0.0)).alias(f"k{k}")
        for k in range(len(KINDS))
    ]
    counted = edges.join(known, "instance", "left").groupBy("pattern").agg(F.count("*").alias("n"), *sums)
    scored = [
        F.struct(F.lit(k).alias("kind_no"), F.col(f"k{k}").alias("good"), F.lit(u).alias("usual"))
        for k, u in enumerate(usual)
    ]
    n, share = F.col("n"), F.col("g.good") / F.col("n")
    usually = F.col("g.usual")
    clear = F.least(MIN_LIFT * usually, usually + MIN_GAIN * (1 - usually))
    spread = F.sqrt(F.greatest(share * (1 - share) / n + _Z * _Z / (4 * n * n), F.lit(0.0)))
    lower = (share + _Z * _Z / (2 * n) - _Z * spread) / (1 + _Z * _Z / n)
    return (
        counted.select("pattern", "n", F.explode(F.array(*scored)).alias("g"))
        .select("pattern", "g.kind_no", lower.alias("lower"), clear.alias("clear"))
        .where((F.col("lower") >= MIN_SHARE) & (F.col("lower") >= F.col("clear")))
        .select("pattern", "kind_no", F.least("lower", F.lit(0.99)).alias("confidence"))
    )


def find(documents: DataFrame) -> DataFrame:
    """Per row: _key, doc_id, base, extra and spans (both together), arrays of {start, kind_no, end} in order."""
    ensure_checkpoint_dir(documents.sparkSession)
    per_row, occurrences = _occurrences(documents)
    unseen = bootstrap(occurrences)
    free = occurrences.where("kind_no < 0").select("_row", "start", "end", "instance")
    extra = (
        free.join(unseen, "instance")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "kind_no", "end")).alias("extra"))
    )
    found = F.coalesce("extra", F.array().cast(_SPANS))
    return per_row.join(extra, "_row", "left").select(
        "_key", "doc_id", "base", found.alias("extra"), F.sort_array(F.concat("base", found)).alias("spans")
    )


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ","
    )


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_<kind> and base_sha256 of the base, spans (base and found) as text."""
    counts = [_count(k) for k in range(len(KINDS))]
    return find(documents).select(
        "doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long").alias(f"n_{KINDS[k]}")



def redact(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, with every span of their texts replaced by its kind: ``<EMAIL>``.

    Overlapping spans become one, named by the first. Base spans are found again in the row itself, so
    that only what the graph has found is joined. A NULL text stays NULL.
    """
    extra_key, extra_spans = fresh(documents, "extra_key"), fresh(documents, "extra_spans")
    extra = (
        find(documents)
        .where(F.size("extra") > 0)
        .groupBy(F.col("_key").alias(extra_key))
        .agg(F.first("extra").alias(extra_spans))
    )
    names = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])

    def rebuilt(spans: Column) -> Column:
        return let(F.transform(spans, lambda s: s["end"]), lambda ends: let(running(ends, lambda a, b: F.greatest(a, b)), lambda reach: let(
            F.split("text", ""), lambda chars: F.array_join(F.concat(pieces(spans, reach, chars), tail(reach, chars)), "")
        )))

    def pieces(spans: Column, reach: Column, chars: Column) -> Column:
        def piece(s, i):
            before = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            kept = F.slice(chars, (before + 1).cast("int"), (s["start"] - before).cast("int"))
            return F.when(
                s["start"] >= before, F.concat(F.array_join(kept, ""), F.get(names, s["kind_no"]))
            ).otherwise("")

        return F.transform(spans, piece)

    def tail(reach: Column, chars: Column) -> Column:
        last = F.get(reach, F.size(reach) - 1).cast("int")
        return F.slice(chars, last + 1, F.size(chars) - last)

    base = F.transform(
        _found(F.col("text"), tokens=False),
        lambda m: F.struct(m["start"].alias("start"), m["kind_no"].alias("kind_no"), m["end"].alias("end")),
    )
    spans = F.sort_array(F.concat(base, F.coalesce(extra_spans, F.array().cast(_SPANS))))
    text = let(spans, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(F.col("text")))
    new = F.when(F.col("text").isNotNull(), text)
    joined = documents.join(extra, text_key(F.col("doc_id"), F.col("text")) == F.col(extra_key), "left")
    return joined.select(*[new.alias("text") if c == "text" else F.col(c) for c in documents.columns])
