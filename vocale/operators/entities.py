"""Entity stand-in: patterns and a gazetteer as JVM-side columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocale.functions.analysis import keep_entities
from vocale.functions.lexicon import ORGANISATIONS, PLACES

# The patterns, in the order they are tried at each position. The local part of an
# e-mail address is taken whole, of any length (++: it has no '@' to give back). It is tried only
# where such a run begins or the match before ends, so a long run is read once.
LOCAL = r"[A-Za-z0-9._%+\-]"
RUN_START = rf"(?:(?<!{LOCAL})|\G)"
EMAIL = rf"{RUN_START}{LOCAL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}"
PHONE = r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
NAME = r"\p{Lu}[\p{L}0-9]*(?: \p{Lu}[\p{L}0-9]*)*"
ANY = f"{EMAIL}|{PHONE}|{IP}|{NAME}"
NO_EMAIL = f"{PHONE}|{IP}|{NAME}"

# Label and score per kind; single capitalised words stay below the 0.80 threshold.
SCORES = {"EMAIL": 0.99, "PHONE": 0.95, "IP": 0.90, "ORG": 0.95, "LOC": 0.92, "MISC": 0.85}
WEAK_SCORE = 0.60


def _any_word(names) -> str:
    return f"(?:^| )(?:{'|'.join(names)})(?: |$)"


def _label(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "EMAIL")
        .when(match.startswith("+"), "PHONE")
        .when(match.rlike("^[0-9]"), "IP")
        .when(match.rlike(_any_word(ORGANISATIONS)), "ORG")
        .when(match.rlike(_any_word(PLACES)), "LOC")
        .otherwise("MISC")
    )


def _score(match: Column, label: Column) -> Column:
    strong = F.when(match.contains(" "), SCORES["MISC"]).otherwise(WEAK_SCORE)
    for name, value in SCORES.items():
        if name != "MISC":
            strong = F.when(label == name, value).otherwise(strong)
    return strong.cast("float")


def running_starts(steps: Column, first: Column, block: int = 16) -> Column:
    """first, first + steps[1], first + steps[1] + steps[2], ...: one value per step.

    Appending copies an array, so sums run inside blocks of ``block`` steps and over the blocks'
    totals; the time is about linear in the number of steps.
    """
    def sums(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    last = F.floor((F.size(steps) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * block + 1, F.lit(block)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
    starts = F.zip_with(blocks, F.slice(sums(totals, first), F.lit(1), last + 1), lambda b, s: F.slice(sums(b, s), F.lit(1), F.size(b)))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(F.flatten(starts))


def raw_entities(df: DataFrame, text: str = "norm", offsets: bool = True) -> DataFrame:
    """Add raw_entities, every match in order of appearance.

    Offsets count code points of the text: the length of all pieces between and of the matches
    before it. ``offsets=False`` leaves them 0 for jobs that only count mentions.
    """
    source = F.col(text)

    def with_pattern(apply) -> Column:
        # Without an '@' there is no address, and the costly pattern is not tried at every letter.
        return F.when(source.contains("@"), apply(ANY)).otherwise(apply(NO_EMAIL))

    found = df.withColumn(
        "_match", with_pattern(lambda p: F.regexp_extract_all(source, F.lit(p), F.lit(0)))
    )
    if offsets:
        gaps = F.transform(with_pattern(lambda p: F.split(source, p, -1)), F.length)
        steps = F.zip_with(
            F.col("_match"), F.slice(gaps, 2, F.size("_match")), lambda m, gap: F.length(m) + gap
        )
        found = found.withColumns({"_steps": steps, "_first": F.element_at(gaps, 1)}).withColumn(
            "_start", running_starts(F.col("_steps"), F.col("_first"))
        )
        pairs = F.arrays_zip(F.col("_match").alias("m"), F.slice("_start", 1, F.size("_match")).alias("s"))
    else:
        pairs = F.transform("_match", lambda m: F.struct(m.alias("m"), F.lit(0).alias("s")))

    # Two steps, so that the label of a match is worked out once.
    named = F.transform(
        pairs, lambda p: F.struct(p["m"].alias("m"), p["s"].alias("s"), _label(p["m"]).alias("label"))
    )
    entities = F.transform(
        named,
        lambda n: F.struct(
            n["m"].alias("text"),
            n["label"].alias("label"),
            n["s"].alias("start"),
            (n["s"] + F.length(n["m"])).alias("end"),
            _score(n["m"], n["label"]).alias("score"),
        ),
    )
    return found.select(*df.columns, entities.alias("raw_entities"))


def extract_entities(df: DataFrame, text: str = "norm", offsets: bool = True) -> DataFrame:
    """Add entities: the matches at or above the confidence threshold."""
    found = raw_entities(df, text, offsets)
    return found.select(*df.columns, keep_entities(F.col("raw_entities")).alias("entities"))
