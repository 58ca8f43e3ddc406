"""Secrets by patterns, and a random forest that removes false positives, in DataFrame functions only.

Candidates are runs of key characters that hold a digit, without a ``NAME=`` before them, and
values of any kind given to a name such as ``token``: quoted (up to the closing quote) or not (up
to a blank, quote, bracket, comma, semicolon or ``&``, without full stops at the end). The forest
judges each by

* its length, the share of adjacent characters that change their class, and how usual its
  adjacent characters are in the corpus (mean logarithm over its transitions);
* dictionary coverage: the share of its letters in parts that are words of the corpus, a word
  being what at least ``word_docs`` distinct texts hold, and a share of ``WORD_SHARE`` of them,
  as a token of letters only that is no value given to a secret's name;
* its path: words such as test or example, depth and length;
* the words beside it: names of secrets, names of harmless codes, an assignment, quotes.

It is trained on labelled findings: given ones, or else those that ``label`` can tell for
certain, at most ``train_rows`` of either label, chosen by a hash. The corpus's words are
counted with a combine before the shuffle; the transitions are a table of 28 times 28 classes
of characters. Nothing else reaches the driver but the forest.

Defined results: null texts count as empty; a null path has no words; ids are carried and
never compared; repeated rows are judged each; without findings of both labels every
candidate gets the share of label 1 among the labelled, or 0.5 if there are none; other
columns of the input are not looked at; an empty table gives no findings; very long texts are
searched whole, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .tables import stored

# '=' is a key character at the end of a run, as padding; between two runs it assigns
_RUN = "A-Za-z0-9_+/-"
_KEY = f"{_RUN}="
_NAMES = "token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer"
_NAMED = rf"(?i)(?:{_NAMES})(?:s|[_-]?[0-9]{{1,4}}|[_-][a-z0-9_-]{{1,32}})?+[\"'\])]{{0,2}}"
_GIVEN = r"[\x20\t]{0,3}(?::[\x20\t]{0,3}[a-z][a-z0-9_.]{0,30}[\x20\t]{1,3}=(?=[\x20\t])|(?>:=|=>|={1,3}|:))[\x20\t]{0,3}+"
#: A value in quotes, or one without (or whose quote is never closed on its line).
_VALUE = r"(?:\"[^\"\r\n]++(?=\")|'[^'\r\n]++(?=')|[\"']?[^\s\"'`,;&<>(){}\[\]]+(?<!\.))"
PATTERNS = {
    "token": (rf"(?<![{_RUN}])(?=[{_RUN}]{{16}}|[{_RUN}]{{1,15}}+=++(?![{_RUN}]))[A-Za-z_+/-]*+[0-9][{_RUN}]*+(?:=++(?![{_RUN}]))?+", r"[0-9]"),
    "assigned": (_NAMED + _GIVEN + _VALUE, _NAMED + _GIVEN),
}
#: Names that stand before harmless codes.
_HARMLESS = "sha-?(?:1|256|512)?|md5|commit|checksum|digest|revision|uuid|isbn|issn|doi|version|phone|card|invoice|order"
#: Characters of a token without an assigned name, at least; the pattern says so, too.
LEAST = 16
WORD_DOCS = 5
#: The share of the distinct texts that hold a word, at least: chance runs of letters grow with the corpus.
WORD_SHARE = 1e-5
TRAIN_ROWS = 4000
FEATURES = (
    "length", "changes", "usual", "coverage", "distinct", "digit_share", "upper_share", "hex", "named", "assigned",
    "quoted", "harmless", "alone", "path_test", "path_depth", "path_length",
)


def words(docs: DataFrame, text_col: str, least_docs: int = WORD_DOCS, share: float = WORD_SHARE) -> DataFrame:
    """``word, docs``: tokens of three or more letters, in lower case, that enough distinct texts hold.

    Copies count once. A token with other key characters than letters is no word, nor is what a
    secret's name is given, so a key never puts parts of itself into the dictionary.
    """
    pattern, trigger = PATTERNS["assigned"]
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    outside = F.when(F.col("text").rlike(trigger), F.regexp_replace("text", pattern, " ")).otherwise(F.col("text"))
    held = F.filter(F.split(F.lower(outside), r"[^\p{L}\p{N}_+/=-]+"), lambda w: w.rlike(r"^\p{L}{3,40}$"))
    # the empty word stands in every text once and counts them
    found = texts.select(F.explode(F.array_union(held, F.array(F.lit("")))).alias("word"))
    counted = stored(found.groupBy("word").agg(F.count("*").alias("docs")).where((F.col("docs") >= least_docs) | (F.col("word") == "")), "words")
    total = counted.where("word = ''").agg(F.max("docs").alias("texts"))
    return counted.where("word <> ''").join(F.broadcast(total), F.col("docs") >= F.col("texts") * share).drop("texts")


def _classes(value: Column) -> Column:
    """Letters a to z in lower case, 0 for digits, _ for all else."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "_")


def _pairs(value: Column) -> Column:
    """Adjacent characters, two by two; in linear time, which taking parts of the text would not be."""
    characters = F.split(value, "")
    both = F.zip_with(characters, F.slice(characters, 2, F.greatest(F.size(characters), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.filter(both, lambda p: F.length(p) == 2)


def transitions(dictionary: DataFrame) -> dict[str, float]:
    """The logarithm of each pair of character classes' share among those that begin alike."""
    spelled = F.concat(F.lit("_"), _classes(F.col("word")), F.lit("_"))
    counted = dictionary.select(F.explode(_pairs(spelled)).alias("pair"), "docs").groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = {r[0]: r[1] for r in counted.collect()}
    import math

    first: dict[str, int] = {}
    for pair, n in counts.items():
        first[pair[0]] = first.get(pair[0], 0) + n
    return {pair: math.log(n / first[pair[0]]) for pair, n in counts.items()}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> tuple[DataFrame, DataFrame]:
    """The table of rows (``row, id, path``), and the candidates (``row``, place, value, neighbourhood)."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    both = docs.select(F.struct(F.col(id_col).alias("id"), path.alias("path")).alias("known"), F.col(text_col).alias("text"))
    table = spans.marked(both, "known", "text", PATTERNS, "secret-matches")
    found = spans.rows(table, list(PATTERNS))
    # an assignment is matched whole: its name, sign and opening quote belong to what stands before the value
    given = F.when(F.col("pattern") == "assigned", F.regexp_extract("value", rf"^{_NAMED}{_GIVEN}[\"']?", 0)).otherwise("")
    found = found.withColumn("given", given).withColumns({
        "value": F.substring(F.col("value"), F.length("given") + 1, F.length("value")),
        "start": F.col("start") + F.length("given"),
        "before": F.right(F.concat("before", "given"), F.lit(spans.BEFORE)),
    }).drop("given").where((F.col("pattern") == "assigned") | (F.length("value") >= LEAST))
    # a value found by both patterns is one candidate
    best = F.min_by(F.struct("value", "before", "after", "pattern"), "pattern")
    one = found.groupBy("row", "start", "end").agg(best.alias("b")).select("row", "start", "end", "b.*")
    known = table.select("row", F.col("id.id").alias("id"), F.col("id.path").alias("path"))
    return known, stored(one.join(known, "row"), "secret-candidates")


def described(found: DataFrame, dictionary: DataFrame, usual: dict[str, float]) -> DataFrame:
    """The candidates with the columns of ``FEATURES``."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    part = F.explode(F.array_distinct(F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))).alias("word")
    known = found.select("value", part).distinct().join(dictionary.select("word"), "word")
    covered = known.groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    changes = F.regexp_count(value, F.lit("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"))
    lookup = F.create_map(*[F.lit(x) for item in (usual or {"__": 0.0}).items() for x in item])
    logs = F.transform(_pairs(_classes(value)), lambda p: F.coalesce(F.try_element_at(lookup, p), F.lit(-9.0)))
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    before, after, path = F.lower(F.coalesce("before", F.lit(""))), F.coalesce("after", F.lit("")), F.lower(F.coalesce("path", F.lit("")))
    near = F.array_join(F.reverse(F.slice(F.reverse(F.split(F.trim(before), r"\s+")), 1, 4)), " ")  # the last four words
    features = {
        "length": F.log1p(n),
        "changes": changes / n,
        "usual": F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.greatest(F.size(logs), F.lit(1)),
        "coverage": F.coalesce(F.col("covered") / n, F.lit(0.0)),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "named": near.rlike(_NAMES),
        "assigned": before.rlike(r"(?:[=:]|=>)\s{0,3}[\"']?$"),
        "quoted": before.rlike(r"[\"']$") & after.rlike(r"^[\"']"),
        "harmless": near.rlike(rf"\b(?:{_HARMLESS})\b"),
        "alone": before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:$|\s)"),
        "path_test": path.rlike(r"test|example|sample|fixture|mock|demo"),
        "path_depth": F.length(F.regexp_replace(path, "[^/]", "")),
        "path_length": F.log1p(F.length(path)),
    }
    rows = found.join(covered, "value", "left")
    return rows.withColumns({k: features[k].cast("double") for k in FEATURES}).drop("covered")


def label() -> Column:
    """1 for findings certain to be secrets, 0 for those certain not to be, else null.

    A value with digits and many characters, given to a secret's name, is one; a number, a
    placeholder, spelled words and what follows a harmless name are not.
    """
    value = F.col("value")
    placeholder = F.lower(value).rlike(r"^(?:x+|\*+|your.*|example.*|changeme.*|test.*|dummy.*|placeholder.*|(.)\1+)$")
    varied = F.col("distinct") * F.length("value") >= 8
    secret = (F.col("named") == 1) & (F.col("assigned") == 1) & varied & (F.col("digit_share") > 0.1) & (F.col("digit_share") < 1) & (F.length(value) >= LEAST)
    return F.when(placeholder | (F.col("digit_share") == 1) | (F.col("coverage") > 0.7) | (F.col("harmless") == 1), 0.0).when(secret, 1.0)


def forest(labelled: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 24, depth: int = 6, seed: int = 11):
    """The fitted forest, or the share of label 1 if only one label is there."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    order = F.xxhash64("value", "before", "start")
    parts = [labelled.where(F.col("label") == y).orderBy(order, "value", "row", "start").limit(train_rows) for y in (0.0, 1.0)]
    rows = stored(parts[0].union(parts[1]).select(array_to_vector(F.array(*FEATURES)).alias("features"), "label"), "labelled-findings")
    counts = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if len(counts) < 2:
        return 1.0 if 1.0 in counts else 0.0 if counts else 0.5
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def findings(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS, word_docs: int = WORD_DOCS,
) -> DataFrame:
    """``id_col, start, end, pattern, value, probability`` of every candidate.

    ``labelled``: findings with ``value, before, after, path, label``; else ``label`` names them.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    _, found = candidates(docs, id_col, text_col, path_col)
    dictionary = stored(words(docs, text_col, word_docs), "dictionary")
    usual = transitions(dictionary)
    rows = stored(described(found, dictionary, usual), "described-candidates")
    if labelled is None:
        train = rows.withColumn("label", label())
    else:
        given = labelled.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("value", "before", "after", "path")], F.col("label").cast("double").alias("label")).withColumns({"row": F.lit(0), "start": F.lit(0)})
        train = described(given, dictionary, usual)
    model = forest(train.where("label IS NOT NULL"), train_rows)
    if isinstance(model, float):
        scored = rows.withColumn("p", F.lit(model))
    else:
        scored = model.transform(rows.withColumn("features", array_to_vector(F.array(*FEATURES)))).withColumn("p", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "start", "end", "pattern", "value", F.col("p").alias("probability"))


def secrets(docs: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col, start, end, pattern, value_sha256, probability`` of the candidates the forest accepts."""
    found = findings(docs, id_col=id_col, **options).where(F.col("probability") >= threshold)
    return found.select(id_col, "start", "end", "pattern", F.sha2("value", 256).alias("value_sha256"), "probability")
