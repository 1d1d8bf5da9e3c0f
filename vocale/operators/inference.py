"""Python model inference: token-budget packs, per-document fallback, stage metrics.

Packs are built inside each partition from rows sorted by length there, so the job needs no
shuffle; which rows share a pack depends on the partitioning, the output of a row does not.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and tokens per pack.
MAX_ROWS = 32
MAX_TOKENS = 6000

# A scorer gets the texts of one pack and gives one value per text, or raises.
Scorer = Callable[[list[str]], list]


def token_count(text: Column) -> Column:
    """Approximate tokens: words plus the two special tokens."""
    return (F.size(F.split(text, " ")) + 2).cast("int")


def first_tokens(text: Column, max_length: int) -> Column:
    """The words of a text that a model of ``max_length`` tokens reads."""
    return F.array_join(F.slice(F.split(text, " "), 1, max_length - 2), " ")


def _packs(frames: Iterator[pd.DataFrame], max_rows: int, max_tokens: int) -> Iterator[pd.DataFrame]:
    """Cut a stream of frames into packs; a pack may span two Arrow batches."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        begin = tokens = 0
        for at, n in enumerate(frame["n_tokens"].tolist()):
            if at > begin and (at - begin >= max_rows or tokens + n > max_tokens):
                yield frame.iloc[begin:at]
                begin, tokens = at, 0
            tokens += n
        rest = frame.iloc[begin:]
    if rest is not None and len(rest):
        yield rest


def _by_length(df: DataFrame, text: str, key: str, max_length: int | None = None) -> DataFrame:
    if max_length is not None:
        df = df.withColumn(text, first_tokens(F.col(text), max_length))
    return df.withColumn("n_tokens", token_count(F.col(text))).sortWithinPartitions("n_tokens", key)


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in fields])


def pack(
    df: DataFrame, text: str = "norm", key: str = "doc_id", max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS, max_length: int | None = None,
) -> DataFrame:
    """Rows (key, n_tokens, pack_id, pack_rows, pack_tokens); pack_id is unique per partition and pack.

    A text over the budget is a pack of its own. ``max_length`` is for models that read so many
    tokens of a text: it cuts the text itself, so that counts and load agree.
    """
    slim = _by_length(df.select(key, text), text, key, max_length).select(key, "n_tokens")

    def run(frames):
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(_packs(frames, max_rows, max_tokens)):
            yield rows.assign(
                pack_id=f"{part}-{number}", pack_rows=len(rows), pack_tokens=int(rows["n_tokens"].sum())
            )

    fields = (("pack_id", T.StringType()), ("pack_rows", T.IntegerType()), ("pack_tokens", T.IntegerType()))
    return slim.mapInPandas(run, _with(slim, *fields))


def _score_pack(scorer: Scorer, texts: list[str]) -> tuple[list, list]:
    """Score a pack; when it fails, score each text alone and keep the error of the bad ones."""
    try:
        values = scorer(texts)
        if len(values) != len(texts):
            raise ValueError(f"expected {len(texts)} values, got {len(values)}")
        return list(values), [None] * len(texts)
    except Exception:
        pass
    values, errors = [], []
    for text in texts:
        try:
            values.append(scorer([text])[0])
            errors.append(None)
        except Exception as exc:
            values.append(None)
            errors.append(str(exc) or type(exc).__name__)
    return values, errors


def score(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text: str = "norm",
    key: str = "doc_id",
    max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS,
    max_length: int | None = None,
) -> DataFrame:
    """Add raw_label, raw_score, error and seconds (the row's share of its pack's time).

    ``make_scorer`` runs once per task, so a model is loaded there and not sent with the plan.
    A scorer value is a dict with label and score.
    """
    ready = _by_length(df, text, key, max_length)

    def run(frames):
        scorer = make_scorer()
        for rows in _packs(frames, max_rows, max_tokens):
            t0 = time.perf_counter()
            values, errors = _score_pack(scorer, rows[text].tolist())
            share = (time.perf_counter() - t0) / len(rows)
            yield rows.assign(
                raw_label=[None if v is None else v.get("label", "") for v in values],
                raw_score=[None if v is None else float(v.get("score", 0.0)) for v in values],
                error=[e if v is not None or e else "unknown_error" for v, e in zip(values, errors)],
                seconds=share,
            )

    fields = (
        ("raw_label", T.StringType()), ("raw_score", T.DoubleType()),
        ("error", T.StringType()), ("seconds", T.DoubleType()),
    )
    return ready.mapInPandas(run, _with(ready, *fields))


def extract(
    df: DataFrame,
    make_extractor: Callable[[], Scorer],
    text: str = "norm",
    key: str = "doc_id",
    max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS,
    max_length: int | None = None,
) -> DataFrame:
    """Add raw_entities, error and seconds; an extractor value is a list of entity dicts with
    text, label, start, end, score. Offsets are those of the given text."""
    from vocale.schemas import ENTITIES_DDL

    ready = _by_length(df, text, key, max_length)

    def run(frames):
        extractor = make_extractor()
        for rows in _packs(frames, max_rows, max_tokens):
            t0 = time.perf_counter()
            values, errors = _score_pack(extractor, rows[text].tolist())
            share = (time.perf_counter() - t0) / len(rows)
            yield rows.assign(raw_entities=[v or [] for v in values], error=errors, seconds=share)

    fields = (
        ("raw_entities", T.StructType.fromDDL(f"e {ENTITIES_DDL}")["e"].dataType),
        ("error", T.StringType()), ("seconds", T.DoubleType()),
    )
    return ready.mapInPandas(run, _with(ready, *fields))


def stage_metrics(scored: DataFrame, stage: str) -> DataFrame:
    """Texts, failures, seconds and texts per second of one scored stage."""
    return scored.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    ).select(
        F.lit(stage).alias("stage"),
        "texts",
        "failed",
        "seconds",
        F.try_divide(F.col("texts").cast("double"), F.col("seconds")).alias("texts_per_second"),
    )


def pattern_extractor() -> Scorer:
    """The entity patterns as a Python extractor: all matches, scored as the columns score them."""
    import regex

    from vocale.functions.lexicon import ORGANISATIONS, PLACES
    from vocale.operators.entities import EMAIL, IP, NAME, PHONE, RUN_START, SCORES, WEAK_SCORE

    # The module has no mark for the end of the last match, but tells where a run begins.
    found = regex.compile("|".join((EMAIL.replace(RUN_START, ""), PHONE, IP, NAME)))
    # Without an '@' there is no address: only the places where another match can begin are tried.
    no_email = regex.compile(rf"(?=[+0-9\p{{Lu}}])(?:{'|'.join((PHONE, IP, NAME))})")
    organisations, places = frozenset(ORGANISATIONS), frozenset(PLACES)

    def label_of(match: str) -> str:
        words = set(match.split(" "))
        if "@" in match:
            return "EMAIL"
        if match.startswith("+"):
            return "PHONE"
        if "0" <= match[0] <= "9":
            return "IP"
        return "ORG" if words & organisations else "LOC" if words & places else "MISC"

    def run(texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            rows = []
            for m in (found if "@" in text else no_email).finditer(text):
                label = label_of(m.group())
                score = WEAK_SCORE if label == "MISC" and " " not in m.group() else SCORES[label]
                rows.append({"text": m.group(), "label": label, "start": m.start(), "end": m.end(), "score": score})
            out.append(rows)
        return out

    return run


def lexicon_scorer() -> Scorer:
    """The lexicon as a Python scorer; a text without any letter is refused."""
    import regex

    from vocale.functions.lexicon import NEGATIVE_TERMS, POSITIVE_TERMS, flat

    negative, positive = frozenset(flat(NEGATIVE_TERMS)), frozenset(flat(POSITIVE_TERMS))
    letters = regex.compile(r"\p{L}+")

    def run(texts: list[str]) -> list[dict]:
        out = []
        for text in texts:
            found = set(letters.findall(text.lower()))
            if not found:
                raise ValueError("no words")
            d = len(found & positive) - len(found & negative)
            label = "negative" if d < 0 else "positive" if d > 0 else "neutral"
            out.append({"label": label, "score": abs(d) / (abs(d) + 1)})
        return out

    return run
