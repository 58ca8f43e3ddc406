"""Personal data by weak supervision, in DataFrame functions only.

Base findings follow fixed patterns and checks (an address's parts, Luhn's sum, a number's
digits) and always stay. Beside them, candidates are what the base patterns match but the
checks refuse, numbers and addresses written otherwise. Labelers vote on every candidate,
base ones included: 1 for personal data, 0 against, null for no opinion. They are

* regex: the base check, and the shape usual for the kind;
* gazetteer: known issuers' digits, country codes, top-level domains, private networks;
* context: words near the candidate that speak for or against it, and what it touches.

Expectation-maximisation over the counts of vote patterns (at most 3 to the number of
labelers per kind, the only thing collected) estimates how reliable each labeler is, but for
checks whose rates are known beforehand (one random number in ten passes Luhn's sum, and a
real card always does), so a check that fails speaks strongly against. Shape, contents and
what a candidate touches speak only where they speak against it. The posterior labels then train a logistic regression on the candidate's own features, from at
most ``train_rows`` candidates chosen by a hash. Candidates it accepts that overlap no base
finding are added.

Matching never goes over a line end. Quantifiers are possessive and starts are anchored
where that changes no match, so long runs of digits or letters take linear time and no stack.

Defined results: a null text counts as empty and has no spans; ids are carried and never
compared, so null and repeated ones come back as they came; without candidates nothing is
learned or added; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .tables import stored

KINDS = ("email", "ip", "card", "phone")
_NAME = "A-Za-z0-9._%+-"
#: Name to pattern and what must occur in a text that has a match.
PATTERNS = {
    "email": (rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "email_spelled": (rf"(?<![{_NAME}])[{_NAME}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
    "phone_local": (r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])", r"[0-9][\x20.-][0-9]{4}"),
}
LABELERS = ("checked", "shape", "gazetteer", "context", "contents", "edges")
#: Words that speak for a kind, or against any.
WORDS = {
    "email": "e-?mail|mail|contact|write|reply",
    "ip": "ip|address|host|server|client|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment|pay",
    "phone": "phone|tel|mobile|cell|call|fax|contact",
}
AGAINST = "version|release|isbn|issn|doi|invoice|order|token|sha|md5|hash|commit|build|license|rfc|chapter|page"
TRAIN_ROWS = 20_000
#: How often the check passes what is no such data, and what is: of random digits one in ten has
#: Luhn's sum; dotted numbers such as versions are often small; most runs after a plus have 10 to 15 digits.
CHECK_RATES = {"card": (0.1, 0.98), "ip": (0.3, 0.99), "phone": (0.5, 0.95)}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: Column, value: Column) -> Column:
    """The base check of a match."""
    digits = _digits(value)
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", n.between(14, 19) & F.call_function("luhn_check", F.when(n.between(14, 19), digits).otherwise("1")))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def by_size(kind: Column, n: Column) -> Column:
    """Whether a match that fails the base check has as many digits as a candidate may."""
    return F.when(kind == "card", n.between(12, 19)).when(kind == "phone", n.between(7, 15)).otherwise(True)


def candidates(found: DataFrame) -> DataFrame:
    """Matches with their ``kind``, whether they are ``base``, votes and features."""
    value, kind = F.col("value"), F.split_part("pattern", F.lit("_"), F.lit(1))
    rows = found.withColumn("kind", kind).withColumn("digits", _digits(value)).withColumn("n", F.length("digits"))
    base = F.col("pattern").isin(*KINDS) & _passes(F.col("pattern"), value)
    rows = rows.withColumn("base", base)
    # runs of a few digits, and of several numbers, are no candidates
    right_size = by_size(F.col("kind"), F.col("n"))
    rows = rows.where(F.col("base") | right_size)
    near = F.lower(F.concat_ws(" ", "before", "after"))
    word = F.lit(None).cast("boolean")
    for name, words in WORDS.items():
        word = F.when(F.col("kind") == name, near.rlike(rf"\b(?:{words})\b")).otherwise(word)
    against = F.lower("before").rlike(rf"\b(?:{AGAINST})\W{{0,12}}$")
    by_kind = lambda **of: F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in of.items()])
    # a shape that is usual says nothing, one that is not speaks against
    shape = by_kind(
        email=F.lit(None).cast("boolean"),
        ip=F.when(~F.forall(F.split(value, r"\."), lambda p: F.length(p) <= 3), False),
        card=F.when(~F.col("n").isin(15, 16), False),
        phone=F.when(~F.col("n").between(10, 12), False),
    )
    gazetteer = by_kind(
        email=F.when(F.lower(value).rlike(r"(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)[\])]?$"), True),
        ip=F.when(value.rlike(r"^(?:10|127|192\.168|169\.254|0)\."), False),
        card=F.col("digits").rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"),
        phone=F.when(value.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), True),
    )
    contents = F.when(F.length(F.array_join(F.array_distinct(F.split("digits", "")), "")) <= 2, F.col("kind") == "email")
    touches = F.col("before").rlike(r"[0-9A-Za-z_]$") | F.col("after").rlike(r"^[0-9A-Za-z_]")
    votes = {
        # numbers and addresses written otherwise are under no check
        "checked": F.when(F.col("pattern").isin(*KINDS), F.col("base")),
        "shape": shape,
        "gazetteer": gazetteer,
        "context": F.when(against, False).when(word, True),
        "contents": contents,
        "edges": F.when(touches, False),
    }
    rows = rows.withColumns({f"vote_{k}": v.cast("int") for k, v in votes.items()})
    features = [F.length(value) / 40, F.col("n") / 20, F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")) / 8]
    features += [F.coalesce(F.col(f"vote_{k}"), F.lit(0.5)) * 2 - 1 for k in LABELERS]
    each = [F.when(F.col("kind") == k, x).otherwise(0.0) for k in KINDS for x in (F.lit(1.0), *features)]
    return rows.withColumn("features", F.array(*[x.cast("double") for x in each]))


def reliabilities(counts: list[tuple], labelers: int, rounds: int = 60, known: dict[str, tuple[float, float]] | None = None) -> dict[tuple, float]:
    """The posterior of each ``(kind, votes)`` pattern from ``(kind, votes, count)`` rows, by EM.

    Votes are 1, 0 or None. Every labeler starts as right four times in five, and keeps that
    as a prior of a few votes, so that the classes do not change places. The first labeler is
    the check; where its rates are known they stay as they are.
    """
    known = known or {}
    posterior: dict[tuple, float] = {}
    by_kind = defaultdict(list)
    for kind, votes, count in counts:
        by_kind[kind].append((votes, count))
    for kind, rows in by_kind.items():
        prior, right = 0.5, [[0.2, 0.8] for _ in range(labelers)]  # of voting 1 when the truth is 0, 1
        right[0] = list(known.get(kind, right[0]))
        for _ in range(rounds):
            total = positive = 0.0
            said = [[[2.0, 10.0], [8.0, 10.0]] for _ in range(labelers)]
            for votes, count in rows:
                log = [math.log(1 - prior), math.log(prior)]
                for vote, p in zip(votes, right, strict=True):
                    if vote is not None:
                        for truth in (0, 1):
                            log[truth] += math.log(p[truth] if vote else 1 - p[truth])
                p = 1 / (1 + math.exp(min(60, max(-60, log[0] - log[1]))))
                posterior[kind, votes] = p
                total += count
                positive += count * p
                for vote, sums in zip(votes, said, strict=True):
                    if vote is not None:
                        for truth, share in ((0, 1 - p), (1, p)):
                            sums[truth][0] += count * share * vote
                            sums[truth][1] += count * share
            prior = (positive + 1) / (total + 2)
            right = [[sums[0][0] / sums[0][1], sums[1][0] / sums[1][1]] for sums in said]
            right[0] = list(known.get(kind, right[0]))
    return posterior


def classifier(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Column | None:
    """The final classifier's probability as an expression over ``features``; None without candidates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    votes = [f"vote_{k}" for k in LABELERS]
    counts = [(r[0], tuple(r[1:-1]), r[-1]) for r in rows.groupBy("kind", *votes).agg(F.count("*")).collect()]
    if not counts:
        return None
    posterior = reliabilities(counts, len(LABELERS), known=CHECK_RATES)
    spark = rows.sparkSession
    labels = spark.createDataFrame([(k, *v, p) for (k, v), p in posterior.items()], "kind string, " + ", ".join(f"{v} int" for v in votes) + ", p double")
    order = F.xxhash64("kind", "value", "row", "start")
    sample = rows.orderBy(order, "row", "start").limit(train_rows).alias("c")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("kind", *votes)]
    soft = sample.join(F.broadcast(labels.alias("l")), same).select("features", F.greatest(F.least("p", F.lit(0.99)), F.lit(0.01)).alias("p"))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    training = stored(soft.select(array_to_vector("features").alias("features"), both.alias("x")).select("features", "x.*"), "soft-labels")
    fitted = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=30).fit(training)
    weights = F.array(*[F.lit(float(w)) for w in fitted.coefficients])
    products = F.zip_with("features", weights, lambda a, b: a * b)
    return 1 / (1 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.lit(float(fitted.intercept)))))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id_col, found``: the spans of each row as ``array<struct<kind, start, end, base, probability>>``, by start and kind."""
    table = spans.marked(docs, id_col, text_col, PATTERNS, "pii-matches")
    rows = stored(candidates(spans.rows(table, list(PATTERNS))), "pii-candidates")
    probability = classifier(rows, train_rows)
    scored = rows.withColumn("probability", F.lit(None).cast("double") if probability is None else probability)
    kept = scored.where(F.col("base") | (F.col("probability") >= threshold))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "base", "probability")
    gathered = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # an added span gives way to any base one it touches
    base = F.filter("spans", lambda s: s["base"])
    free = F.filter("spans", lambda s: s["base"] | ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    gathered = gathered.withColumn("base_spans", base).select("row", F.transform(free, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["probability"].alias("probability"))).alias("found"))
    none = F.array().cast(gathered.schema["found"].dataType)
    return table.select("row", F.col("id").alias(id_col)).join(gathered, "row", "left").select(id_col, F.coalesce("found", none).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, their digest, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
