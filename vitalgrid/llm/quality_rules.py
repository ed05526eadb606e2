"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import ASCII_SPACE, let, shielded

SYMBOLS = "#*$%&|<>"
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it was for on are with as this be by at from have "
    "der die das und ist nicht ein eine zu den auf mit von des "
    "le la les et un une de est que pour dans qui sur en au du "
    "el los las y a se por con del lo es"
).split()
WIDTH = 5


@dataclass(frozen=True)
class Rule:
    """Rejects a document whose ``measure`` (SQL over the measures) lies outside [low, high], where ``applies`` holds."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    applies: str = "true"

    def sql(self) -> str:
        tests = ([f"({self.measure}) < {self.low}"] if self.low is not None else []) + ([f"({self.measure}) > {self.high}"] if self.high is not None else [])
        return f"(({self.applies}) and ({' or '.join(tests)}))"


RULES = (
    Rule("mean_word_length", "cast(word_chars as double) / greatest(n_words, 1)", 2.0, 20.0),
    Rule("symbols_per_word", "cast(n_symbols as double) / greatest(n_words, 1)", high=0.25),
    Rule("shouts_per_word", "cast(n_shouts as double) / greatest(n_words, 1)", high=0.9),
    Rule("stop_word_share", "cast(n_stop_words as double) / greatest(n_words, 1)", low=0.01, applies="n_words >= 50"),
    Rule("repeated_line_share", "cast(n_dup_lines as double) / greatest(n_lines, 1)", high=0.5, applies="n_lines >= 5"),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _repeated(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more: a hash pass clears texts without any, the rest compare strings."""
    n = F.size(w)
    at = F.sequence(F.lit(1), n - (WIDTH - 1))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WIDTH)]))

    def exact() -> Column:
        grams = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, WIDTH)).alias("g"), i.alias("p"))))

        def positions(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["g"] == x["g"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WIDTH).alias("last"))
        step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(WIDTH), p - acc["last"])).alias("total"), p.alias("last"))
        return let(let(grams, positions), lambda p: F.aggregate(p, start, step, lambda acc: acc["total"]))

    none = F.lit(0).cast("long")
    return F.when(n <= WIDTH, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(exact())))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``_m`` of the measures; null text counts as empty.

    The struct comes out of an array of one, so that a filter on a measure stays above it and does not evaluate it once more a mention.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = _words(t)
    lines = F.filter(F.split(t, "\n", -1), lambda x: _without(x, ASCII_SPACE) != "")
    long = lambda c: c.cast("long")
    by_words = let(w, lambda a: F.struct(
        long(F.size(a)).alias("n_words"),
        long(F.size(F.filter(a, lambda x: x.isin(STOP_WORDS)))).alias("n_stop_words"),
        _repeated(a).alias("n_repeat_words"),
    ))
    by_lines = let(lines, lambda a: F.struct(long(F.size(a)).alias("n_lines"), long(F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines")))
    return docs.withColumn("_m", F.explode(F.array(F.struct(
        by_words.alias("w"), by_lines.alias("l"),
        long(F.length(_without(t, ASCII_SPACE))).alias("word_chars"),
        long(F.length(t) - F.length(_without(t, SYMBOLS))).alias("n_symbols"),
        long(F.length(t) - F.length(_without(t, "!"))).alias("n_shouts"),
    ))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_stop_words", "n_lines")


@shielded(("quality",), "text")
def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with a struct ``quality``: the measures, ``base_failed``, ``failed`` (names of broken rules), ``kept``.

    Null and empty texts have no words and fail the base rules. Rows are judged one by one, so repeated
    rows get equal results and an empty table gives an empty one; a column named ``quality`` is replaced,
    any other stays, whatever its name.
    """
    m = measure(docs, text)
    flat = {"n_words": "w", "n_stop_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    values = [F.col(f"_m.{flat[k]}.{k}" if k in flat else f"_m.{k}").alias(k) for k in MEASURES]
    m = m.withColumn("_m", F.struct(*values))
    of = lambda sql: F.expr(_qualified(sql))
    base = of("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    failed = F.filter(F.array(*[F.when(of(r.sql()), F.lit(r.name)) for r in rules]) if rules else F.array().cast("array<string>"), lambda x: x.isNotNull())
    m = m.withColumn("_b", F.struct(base.alias("base_failed"), failed.alias("failed")))
    return m.withColumn("quality", F.struct(
        *[F.col(f"_m.{k}").alias(k) for k in MEASURES], F.col("_b.base_failed").alias("base_failed"), F.col("_b.failed").alias("failed"),
        (~F.col("_b.base_failed") & (F.size("_b.failed") == 0)).alias("kept"),
    )).drop("_m", "_b")


def _qualified(sql: str) -> str:
    for name in MEASURES:
        sql = sql.replace(name, f"_m.{name}")
    return sql
