"""Removing secrets from text and nested values, and finding secrets in JSON."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# The mask, the two text patterns (with what replaces a match), words of
# which each pattern needs one, the key words whose values are masked whole, and those
# that mark a literal secret.
MASK = "***REDACTED***"
PATTERNS = {
    "assignment": (r"(?i)(token|password|secret)=([^;\s,&]+)", rf"$1={MASK}"),
    "credential": (
        r"(?i)(bearer\s+|(?:token|password|secret|api[_-]?key)\s*[=:]\s*)[^\s,;]+",
        rf"$1{MASK}",
    ),
}
NEEDED = {
    "assignment": ("token=", "password=", "secret="),
    "credential": ("bearer", "token", "password", "secret", "api"),
}
KEY_WORDS = ("password", "secret", "token", "credential", "private_key", "authorization")
SECRET_KEYS = ("password", "token", "secret", "api_key", "apikey", "access_key", "private_key")
REFERENCE = "secret://"


def _usable(secrets: Mapping[str, str] | None, min_length: int) -> dict[str, str]:
    named = sorted((secrets or {}).items())
    return {name: value for name, value in named if value and len(value) >= min_length}


def _clean(column: Column, secrets: Mapping[str, str], patterns: Sequence[str]) -> Column:
    if secrets:
        # one pass, longer values first: a secret that holds another goes whole, and a mask is not searched again
        values = sorted(set(secrets.values()), key=lambda v: (-len(v), v))
        any_of = reduce(lambda a, b: a | b, [F.contains(column, F.lit(v)) for v in values])
        quoted = "|".join(re.sub(r"([\x00-/:-@\[-`{-\x7f])", r"\\\1", v) for v in values)
        column = F.when(any_of, F.regexp_replace(column, quoted, MASK)).otherwise(column)
    for name in patterns:
        pattern, mask = PATTERNS[name]
        column = F.when(_may_match(column, name), F.regexp_replace(column, pattern, mask)).otherwise(column)
    return column


def _may_match(column: Column, name: str) -> Column:
    """False only where the pattern cannot match: no word it needs is in the text. Most
    texts are told apart this way at a small part of the regular expression's cost.
    """
    lowered = F.lower(column)
    tests = [F.contains(lowered, F.lit(word)) for word in NEEDED[name]]
    return reduce(lambda a, b: a | b, tests)


def redact_value(
    column: Column,
    data_type: DataType,
    secrets: Mapping[str, str] | None = None,
    patterns: Sequence[str] = ("credential",),
    key: str | Column = "",
    min_length: int = 1,
) -> Column:
    """Redact strings anywhere inside a struct, map or array.

    A string under a field or map key that holds one of the key words is masked
    whole; other strings go through the text patterns.
    """
    usable = _usable(secrets, min_length)

    def walk(value: Column, kind: DataType, under: str | Column) -> Column:
        if isinstance(kind, StringType):
            if isinstance(under, str):
                if any(word in under.lower() for word in KEY_WORDS):
                    return F.when(value.isNotNull(), F.lit(MASK))
                return _clean(value, usable, patterns)
            named = F.lower(under).rlike("|".join(KEY_WORDS))
            masked = F.when(named, F.lit(MASK)).otherwise(_clean(value, usable, patterns))
            return F.when(value.isNotNull(), masked)
        if isinstance(kind, StructType):
            fields = [walk(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda item: walk(item, kind.elementType, under))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda k, v: walk(v, kind.valueType, k))
        return value

    return walk(column, data_type, key)


def redact(
    df: DataFrame,
    columns: Sequence[str],
    secrets: Mapping[str, str] | None = None,
    patterns: Sequence[str] = ("assignment", "credential"),
    min_length: int = 1,
    matched: str | None = None,
) -> DataFrame:
    """Redact text columns: registered secret values first, then the patterns in order.

    Every registered value that is not empty is redacted; ``min_length`` can leave short ones.

    ``matched`` names a column for the sorted names of the secrets found in the row.
    Row-local; nothing is shuffled.
    """
    usable = _usable(secrets, min_length)
    if matched is not None:
        hits = [
            F.when(
                F.greatest(
                    *[F.coalesce(F.contains(F.col(c), F.lit(v)), F.lit(False)) for c in columns],
                    F.lit(False),
                ),
                F.lit(name),
            )
            for name, v in usable.items()
        ]
        names = F.array(*hits) if hits else F.array().cast("array<string>")
        df = df.withColumn(matched, F.array_compact(names))
    return df.withColumns({c: _clean(F.col(c), usable, patterns) for c in columns})


def redaction_counts(
    df: DataFrame, columns: Sequence[str], secrets: Mapping[str, str] | None = None
) -> DataFrame:
    """How often each pattern and each registered secret occurs in each column, in one
    aggregate: ``(column, kind, name, matches, rows)``.
    """
    probes: list[tuple[str, str, str, Column]] = []
    for column in columns:
        text = F.coalesce(F.col(column), F.lit(""))
        for name, (pattern, _) in PATTERNS.items():
            hits = F.when(_may_match(text, name), F.regexp_count(text, F.lit(pattern)))
            probes.append((column, "pattern", name, F.coalesce(hits, F.lit(0))))
        for name, value in _usable(secrets, 1).items():
            gone = F.length(text) - F.length(F.replace(text, F.lit(value), F.lit("")))
            probes.append((column, "secret", name, (gone / len(value)).cast("int")))
    sums: list[Column] = []
    for i, (*_, count) in enumerate(probes):
        sums += [F.sum(count).alias(f"__m{i}"), F.count_if(count > 0).alias(f"__r{i}")]
    rows = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            F.coalesce(F.col(f"__m{i}"), F.lit(0)).alias("matches"),
            F.col(f"__r{i}").alias("rows"),
        )
        for i, (column, kind, name, _) in enumerate(probes)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


# The pieces of a JSON text that matter: strings, brackets and commas; colons, numbers and names do not.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],]'


def _unquoted(token: Column) -> Column:
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(plain)


def _findings(tokens: Column, root: str) -> Column:
    """The literal secrets of a JSON text, met token by token with a stack of what is open."""
    words = "|".join(SECRET_KEYS)
    finding = "struct<path: string, value_length: int>"
    # paths: of every open object or list; at: the position in it (-1 in an object); key: of the value that comes next
    begin = F.struct(
        F.array().cast("array<string>").alias("paths"),
        F.array().cast("array<int>").alias("at"),
        F.lit(None).cast("string").alias("key"),
        F.array().cast(f"array<{finding}>").alias("found"),
    )

    def state(acc: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(name, acc[name]).alias(name) for name in ("paths", "at", "key", "found")])

    def step(acc: Column, token: Column) -> Column:
        sign, text = token["sign"], token["text"]
        depth = F.size(acc["paths"])
        here, index = F.get(acc["paths"], depth - 1), F.get(acc["at"], depth - 1)
        path = F.when(depth == 0, F.lit(root)).when(index == -1, F.concat(here, F.lit("."), acc["key"])).otherwise(
            F.concat(here, F.lit("["), index, F.lit("]"))
        )
        no_key = F.lit(None).cast("string")
        outer = F.greatest(depth - 1, F.lit(0))
        hit = F.lower(acc["key"]).rlike(words) & (F.length(text) > 0) & ~F.startswith(text, F.lit(REFERENCE))
        finding = F.struct(path.alias("path"), F.length(text).alias("value_length"))
        # one branch a token; what does not change is handed on as it is
        return (
            F.when((sign == '"') & (index == -1) & acc["key"].isNull(), state(acc, key=text))
            .when((sign == '"') & (index == -1) & hit, state(acc, found=F.array_append(acc["found"], finding)))
            .when(sign == '"', acc)
            .when((sign == ",") & (index >= 0), state(acc, at=F.array_append(F.slice(acc["at"], 1, outer), index + 1)))
            .when(sign == ",", state(acc, key=no_key))
            .when(
                sign.isin("{", "["),
                state(acc, paths=F.array_append(acc["paths"], path), at=F.array_append(acc["at"], F.when(sign == "{", -1).otherwise(0)), key=no_key),
            )
            .otherwise(state(acc, paths=F.slice(acc["paths"], 1, outer), at=F.slice(acc["at"], 1, outer), key=no_key))
        )

    signed = F.transform(
        tokens, lambda t: F.struct(F.substring(t, 1, 1).alias("sign"), F.when(F.startswith(t, F.lit('"')), _unquoted(t)).alias("text"))
    )
    return F.aggregate(signed, begin, step)["found"]


def _json_text(df: DataFrame, column: str) -> DataFrame:
    return df if isinstance(df.schema[column].dataType, StringType) else df.withColumn(column, F.to_json(column))


def secret_literals(df: DataFrame, column: str, keys: Sequence[str] = (), root: str = "config") -> DataFrame:
    """Paths in a JSON text column (or map, or struct) that look like literal secrets:
    a key with one of the secret words over a non-empty string that is no
    ``secret://`` reference. Gives ``(keys.., path, value_length)``.

    A text without any of the words is not taken apart; any other is read once, token by
    token, with a stack of the objects and lists that are open, so nesting of any depth costs
    one pass. Nothing is shuffled and no job runs while planning. Texts that are no JSON
    have no findings; :func:`unparsable` reports them.
    """
    keys = list(keys)
    text = F.col(column)
    lowered = F.lower(text)
    # a word may hide behind an escape
    may = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in (*SECRET_KEYS, "\\u")])
    texts = _json_text(df, column).where(may & F.try_parse_json(text).isNotNull())
    found = _findings(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), root)
    return texts.select(*keys, F.inline_outer(found)).where("path IS NOT NULL")


def unparsable(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys.., problem)`` of the rows whose text in ``column`` is no JSON, and which no scan could look into."""
    bad = _json_text(df, column).where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())
    return bad.select(*keys, F.concat(F.lit("no JSON in "), F.lit(column)).alias("problem"))
